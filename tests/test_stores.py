"""Stores and sinks that write: compaction that breaks off, batches that run twice, places that fail, metric text, ticks, long secrets."""

import hashlib
import hmac
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import ops, preflight, records
from folioflow.operators.store import JobStore
from folioflow.sources import exposition
from folioflow.sources.files import scratch
from folioflow.streaming.receipts import Receipts

T0 = datetime(2026, 1, 1)


def place(spark):
    return f"{scratch(spark)}/test-{uuid.uuid4().hex}"


# -- job store -------------------------------------------------------------------------
def life(spark, rows):
    t = spark.createDataFrame([(j, f"t{j % 2}", T0 + timedelta(hours=h), n, kind) for n, (j, h, kind) in enumerate(rows)], "job_id long, tenant_id string, at timestamp, seq long, kind string")
    own = F.concat(F.lit("v"), F.col("seq").cast("string"))
    return t.select("*", *(own.alias(c) for c in ("artifact_bucket", "artifact_key", "workflow_id", "error_code", "error_message")))


def test_compaction_that_breaks_off_changes_nothing(spark, monkeypatch):
    rows = [(j, h, kind) for j in range(6) for h, kind in ((j, "RECEIVED"), (j + 1, "STORED"), (j + 2, "QUEUED"))] + [(2, 30, "FAILED"), (3, 40, "STORED")]
    events = life(spark, rows)
    store = JobStore(spark, place(spark), events.schema, buckets=4)
    for batch in (0, 1, 1):
        store.append(events.filter(F.col("seq") % 2 == batch), batch)
    want = sorted(map(tuple, store.jobs().collect()))
    assert len(want) == 6 and {r.job_id: r.status for r in store.jobs().collect()} == {0: "QUEUED", 1: "QUEUED", 2: "FAILED", 3: "STORED", 4: "QUEUED", 5: "QUEUED"}
    with monkeypatch.context() as m:
        m.setattr(store, "_drop", lambda *a, **k: None)  # it ends before the batches are dropped
        store.compact(1)
    assert sorted(map(tuple, store.jobs().collect())) == want
    store.compact(1)
    assert store.events().count() == 0 and sorted(map(tuple, store.jobs().collect())) == want
    store.expire(T0 + timedelta(hours=3), 2)
    assert sorted(r.job_id for r in store.jobs().collect()) == [3, 4, 5]
    store.compact(2)
    assert sorted(r.job_id for r in store.jobs().collect()) == [3, 4, 5]
    assert store.snapshot().filter("job_id < 3").isEmpty()


def test_audit_rows_expire_to_the_second(spark):
    store = JobStore(spark, place(spark), life(spark, [(1, 0, "RECEIVED")]).schema)
    rows = spark.createDataFrame([(k, T0 + timedelta(hours=5 * k)) for k in range(20)], "job_id long, created_at timestamp")
    for _ in range(2):
        store.audit(rows, 0)
    store.expire_audit(T0 + timedelta(hours=31))
    assert sorted(r.job_id for r in store.audits().collect()) == list(range(7, 20))


# -- receipts --------------------------------------------------------------------------
def test_receipts_once_a_key_over_crashes_and_places(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{k % 30}", k) for k in range(90)], "event_key string, n long")
    sink = Receipts(spark, place(spark), df.select("event_key", "n").schema, "event_key", F.col("event_key") == "k7", buckets=4)
    sink.write(df.filter("n < 20"), 0)
    put = sink.put

    def breaks(rows, where):
        put(rows.limit(1), where)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sink, "put", breaks)
        with pytest.raises(RuntimeError):
            sink.write(df.filter("n BETWEEN 10 AND 28"), 1)
    sink.write(df.filter("n BETWEEN 10 AND 28"), 1)  # the batch runs again

    def closed(rows, where):
        if where == "primary":
            raise PySparkException("gone")
        put(rows, where)

    with monkeypatch.context() as m:
        m.setattr(sink, "put", closed)
        sink.write(df, 2)
    got = {r.event_key: (r.place, r.batch) for r in sink.all().collect()}
    assert sink.all().count() == 30 and set(got) == {f"k{k}" for k in range(30)}
    assert got["k7"] == ("secondary", "0-0") and got["k3"] == ("primary", "0-0") and got["k25"] == ("primary", "0-1") and got["k29"] == ("secondary", "0-2")
    sink.write(df, 0, "another stream")
    assert sink.all().count() == 30


# -- metric text -----------------------------------------------------------------------
def test_metric_text_and_back(spark, tmp_path):
    rows = [("a_total", {"x": 'q"uo\\te\nd', "y": ""}, 3.0), ("a_total", {}, float("nan")), ("b", {"le": "+Inf", "z": "{},="}, float("inf")), ("b", {"le": "1"}, -1.5e-9), ("b", {"w": "\\n"}, 1e300)]
    t = spark.createDataFrame([(n, dict(m), v) for n, m, v in rows], "name string, labels map<string,string>, value double").withColumns({"family": F.col("name"), "kind": F.lit("counter"), "help": F.lit("two\nlines")})
    exposition.write(t, f"file://{tmp_path}/m")
    got = [(r.name, r.labels, r.value) for r in exposition.read(spark, f"file://{tmp_path}/m").collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    (tmp_path / "t.txt").write_text('# c\n\nup 1\nup{a="b"} 2.5 1700000000000\n  bad line here\nx{a="b} 1\ny{a="b",} +Inf\n')
    got = sorted((r.name, r.labels, r.value, r.millis) for r in exposition.read(spark, f"file://{tmp_path}/t.txt").collect() if r.name != "up" or r.labels)
    assert got == [("up", {"a": "b"}, 2.5, 1700000000000), ("y", {"a": "b"}, float("inf"), None)]


# -- ticks -----------------------------------------------------------------------------
@pytest.mark.parametrize("slot", [30, 100, 10**6])
def test_values_on_ticks(spark, slot):
    rng = random.Random(slot)
    rows = [(rng.choice(["a", None]), k, rng.randrange(0, 3000), rng.random()) for k in range(120)]
    df = spark.createDataFrame(rows, "s string, id long, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    want = set()
    for s in ("a", None):
        own = sorted((t, i, v) for x, i, t, v in rows if x == s)
        for tick in range(0, 3400, 15):
            seen = [v for t, _, v in own if tick - 60 <= t <= tick]
            if seen:
                want.add((s, tick, seen[-1]))
    got = {(r.s, r.at, r.value) for r in ops.instant(df, ["s"], 15, 60, slot).collect()}
    assert got == want


# -- small functions -------------------------------------------------------------------
def test_signatures_of_long_secrets(spark):
    for secret in ("s", "x" * 64, "é" * 80):
        got = spark.range(1).select(records.signature(secret, F.lit("body é")).alias("s")).first().s
        assert got == hmac.new(secret.encode(), "body é".encode(), hashlib.sha256).hexdigest()


def test_rotation_times_are_of_utc(spark):
    now = F.lit("2026-05-11 12:00:00").cast("timestamp")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2026-05-01T00:00:00",), ("2026",), ("2026-05",), ("2026-05-01",), ("2026-05-01T00:00:00+02:00",), ("2026-05-01 10:00:00Z",), ("x",)], "v string")
        utc = F.lit("2026-05-11T00:00:00Z").cast("timestamp")
        got = [r.m for r in rows.select(preflight._age("K", F.col("v"), F.lit(10), utc).alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [m is None for m in got] == [True, False, False, True, False, True, False] and now is not None


def test_word_error_rate_of_long_texts(spark):
    rng = random.Random(2)
    e = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    p = [w for w in e if rng.random() > 0.1]
    row = spark.createDataFrame([(" ".join(e), " ".join(p)), ("a b", ""), ("", "x"), ("a b c a", "a c b a")], "e string, p string").select(X.folded_wer(F.col("e"), F.col("p")).alias("w")).collect()
    assert [r.w for r in row] == [round((len(e) - len(p)) / len(e), 6), 1.0, None, 0.5]
