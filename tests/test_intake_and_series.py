"""Intake, anchored de-duplication, percentiles and series against plain versions, over several batches and hot keys."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from folioflow.operators import ingest
from folioflow.operators.rank import percentiles
from folioflow.sources.files import scratch
from folioflow.streaming import intake, series, streams


# -- anchored de-duplication -----------------------------------------------------------
def plain_dedupe(rows, span):
    out, last = {}, {}
    for tenant, sha, job, at, failed in sorted(rows, key=lambda r: (r[3], r[2])):
        a = last.get((tenant, sha))
        dup = a is not None and a[0] >= at - span and not a[2]
        out[job] = a[1] if dup else None
        if not dup:
            last[tenant, sha] = (at, job, failed)
    return out


def as_jobs(spark, rows):
    t = spark.createDataFrame(rows, "tenant_id string, sha256 string, job_id long, at long, failed boolean")
    return t.select("tenant_id", "sha256", "job_id", F.timestamp_seconds("at").alias("created_at"), F.when(F.col("failed"), "FAILED").otherwise("QUEUED").alias("status"))


@pytest.mark.parametrize("slot", [60, 3600, 10**7])
def test_dedupe_against_a_plain_fold(spark, slot):
    rng = random.Random(slot)
    rows = [(f"t{rng.randrange(2)}", rng.choice("abc"), k, rng.randrange(0, 400_000), rng.random() < 0.2) for k in range(500)]
    rows += [(None, "x", 1000 + k, 50_000 * k // 2, False) for k in range(6)]
    got = ingest.dedupe_anchored(as_jobs(spark, rows), 24, slot=slot).collect()
    assert {r.job_id: r.duplicate_of for r in got} == plain_dedupe(rows, 86400) and len(got) == len(rows)


def test_dedupe_of_jobs_without_a_time(spark):
    t = as_jobs(spark, [("t", "a", 1, 5, False), ("t", "a", 2, 6, False)]).withColumn("created_at", F.when(F.col("job_id") == 2, F.col("created_at")))
    assert sorted(map(tuple, ingest.dedupe_anchored(t).select("job_id", "duplicate_of").collect())) == [(1, None), (2, None)]
    assert ingest.dedupe_anchored(t.limit(0)).count() == 0


def test_dedupe_of_a_million_rows_of_one_key(spark):
    n, step = 1_000_000, 30
    t = spark.range(n).select(F.lit("t").alias("tenant_id"), F.lit("a").alias("sha256"), F.col("id").alias("job_id"), F.timestamp_seconds(F.col("id") * step).alias("created_at"), F.lit("QUEUED").alias("status"))
    got = ingest.dedupe_anchored(t)
    per = 86400 // step + 1  # from one accepted job to the next
    bad = got.filter(~F.col("duplicate_of").eqNullSafe(F.when(F.col("job_id") % per != 0, F.col("job_id") - F.col("job_id") % per)))
    assert got.count() == n and bad.isEmpty()


def test_dedupe_in_batches_and_a_batch_that_runs_twice(spark):
    rng = random.Random(9)
    rows = sorted(((f"t{rng.randrange(2)}", rng.choice("ab"), k, rng.randrange(0, 900_000), rng.random() < 0.2) for k in range(200)), key=lambda r: (r[3], r[2]))
    base = f"{scratch(spark)}/test-{uuid.uuid4().hex}"
    jobs = as_jobs(spark, rows)
    for k in range(4):
        jobs.filter(F.floor(F.unix_seconds("created_at") / 225_000) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
        streams.dedupe(spark.readStream.schema(jobs.schema).parquet(f"{base}/in"), base)
    got = streams.given(spark, "job_id long, duplicate_of long", base)
    assert {r.job_id: r.duplicate_of for r in got.collect()} == plain_dedupe(rows, 86400) and got.count() == 200


# -- percentiles -----------------------------------------------------------------------
def plain_percentile(values, p):
    ordered = sorted(values)
    rank = (len(ordered) - 1) * p
    low = int(rank)
    return ordered[low] if low == rank else ordered[low] + (ordered[low + 1] - ordered[low]) * (rank - low)


@pytest.mark.parametrize("buckets,listed", [(4, 3), (4096, 4096)])
def test_percentiles_against_sorting(spark, buckets, listed):
    rng = random.Random(5)
    of = {"a": [rng.gauss(0, 1) for _ in range(400)], None: [rng.choice([1.5, 1.5, 2.5, -0.0, 0.0]) for _ in range(300)], "c": [10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(200)], "d": [7.0], "e": [1e308, -1e308, float("inf"), 5e-324, 0.0, 1.0]}
    rows = [(g, v) for g, vs in of.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "`g.x` string, v double").withColumnRenamed("g.x", "g")
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in percentiles(df, "v", ps, ["g"], buckets, listed).collect()}
    assert set(got) == {*of, "none"} and got["none"].p50 is None
    for g, vs in of.items():
        for name, p in ps.items():
            assert got[g][name] == pytest.approx(plain_percentile(vs, p), rel=1e-12), (g, name)


def test_percentiles_without_groups_or_rows(spark):
    df = spark.range(10_001).select((F.col("id") * 1.0).alias("v"))
    (r,) = percentiles(df, "v", {"m": 0.5, "q": 0.99}, [], 64, 100).collect()
    assert (r.m, r.q) == (5000.0, 9900.0)
    (r,) = percentiles(df.limit(0), "v", {"m": 0.5}, []).collect()
    assert r.m is None


# -- uploads ---------------------------------------------------------------------------
def test_intake_answers_keys_before_contents_over_restarts(spark):
    base = f"{scratch(spark)}/test-{uuid.uuid4().hex}"
    pdf = "%PDF-1.4 x"
    day = [
        [("t", "k1", "api", "application/pdf", 100, 1, "a.pdf", pdf), ("t", "k1", "api", None, 101, 2, "a.pdf", pdf), ("t", "k2", "api", None, 102, 3, "b.pdf", pdf), ("u", None, "API", None, 103, 4, "b.pdf", pdf), ("t", None, "fax", None, 104, 5, "b.pdf", pdf)],
        [("t", "k1", "api", None, 90_000, 6, "c.pdf", "%PDF-other"), ("t", "k2", "api", None, 86_500, 7, "b.pdf", pdf), ("t", "k2", "api", None, 90_000, 8, "b.pdf", pdf), ("t", "k2", "api", None, 90_001, 9, "b.pdf", pdf)],
        [("t", None, "email", None, 200_000, 10, "x.pdf", "%PDF-f"), ("t", None, "email", None, 200_001, 11, "x.pdf", "%PDF-f"), (None, None, "api", None, 200_002, 12, "x.exe", "MZ")],
    ]
    schema = "tenant_id string, idempotency_key string, source string, declared string, at long, seq long, name string, body string"
    for rows in day:
        intake.submit(spark.createDataFrame(rows, schema), f"{base}/up")
        requests = intake.uploads(spark, f"{base}/up")
        streams.advance(intake.taken_in(requests, F.expr("CASE WHEN seq = 10 THEN 'QUEUE_PUBLISH_FAILED' END")), base)
    got = {r.seq: (r.outcome, r.http_status, r.job_id, r.status) for r in streams.given(spark, intake.RESULT, base).collect()}
    assert got == {
        1: ("accepted", 202, 1, "QUEUED"), 2: ("idempotent_replay", 202, 1, "QUEUED"), 3: ("deduplicated", 202, 1, "QUEUED"), 4: ("accepted", 202, 4, "QUEUED"), 5: ("rejected", 422, None, None),
        6: ("idempotent_replay", 202, 1, "QUEUED"), 7: ("deduplicated", 202, 1, "QUEUED"), 8: ("accepted", 202, 8, "QUEUED"), 9: ("idempotent_replay", 202, 8, "QUEUED"),
        10: ("failed", 503, 10, "FAILED"), 11: ("accepted", 202, 11, "QUEUED"), 12: ("rejected", 415, None, None),
    }


def test_many_uploads_are_few_files(spark):
    base = f"{scratch(spark)}/test-{uuid.uuid4().hex}"
    t = spark.range(0, 3000, 1, 4).selectExpr("'t' AS tenant_id", "'' AS idempotency_key", "'api' AS source", "CAST(NULL AS string) AS declared", "id AS at", "id AS seq", "concat('a|b/', id, '.pdf') AS name", "IF(id = 7, NULL, concat('%PDF-', id)) AS body")
    intake.submit(t, f"{base}/up")
    assert len(spark.read.parquet(f"{base}/up").inputFiles()) <= 4
    rows = intake.uploads(spark, f"{base}/up")
    streams.advance(rows.select("idempotency_key", "seq", "name", "size_bytes", "sha256"), base)
    got = streams.given(spark, "idempotency_key string, seq long, name string, size_bytes long, sha256 string", base).drop("batch")
    own = F.coalesce("body", F.lit(""))
    expected = t.select(F.lit(None).cast("string"), "seq", "name", F.length(own).cast("long") + 1, F.sha2(F.concat(own, F.lit("\n")).cast("binary"), 256))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(map(tuple, expected.collect()), key=lambda r: r[1])


# -- series ----------------------------------------------------------------------------
def test_alert_life_by_timers(spark):
    base = f"{scratch(spark)}/test-{uuid.uuid4().hex}"
    batches = [[("a", 0, False), ("a", 10, True), ("b", 5, True), ("c", 0, True)], [("a", 40, True), ("z", 60, False)], [("a", 75, True), ("c", 80, True), ("a", 90, False), ("z", 400, False)]]
    schema = "s string, id long, t long, bad boolean"
    n = 0
    for rows in batches:
        rows = [(s, n + k, t, bad) for k, (s, t, bad) in enumerate(rows)]
        n += len(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        samples = spark.readStream.schema(schema).parquet(f"{base}/in").select("s", "id", F.timestamp_seconds(F.col("t") + 1000).alias("ts"), "bad")
        streams.advance(series.alert_life(samples, 30, 50, ["s"]), base)
    got = sorted((r.s, r.at - 1000, r.state) for r in streams.given(spark, "s string, at long, state string", base).collect())
    assert got == [("a", 10, "pending"), ("a", 40, "firing"), ("a", 90, "resolved"), ("b", 5, "pending"), ("b", 35, "firing"), ("b", 55, "resolved"), ("c", 0, "pending"), ("c", 30, "firing"), ("c", 50, "resolved"), ("c", 80, "pending"), ("c", 110, "firing"), ("c", 130, "resolved")]


def test_rates_with_resets_over_batches(spark):
    base = f"{scratch(spark)}/test-{uuid.uuid4().hex}"
    schema = "s string, id long, t long, value double"
    for rows in ([("a", 1, 0, 5.0), ("a", 2, 10, 9.0)], [("a", 3, 20, 2.0), ("a", 4, 30, 4.0)], [("a", 5, 12, 99.0), ("a", 6, 100, 5.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        samples = spark.readStream.schema(schema).parquet(f"{base}/in").select("s", "id", F.timestamp_seconds("t").alias("ts"), "value")
        streams.advance(series.rates(samples, 20, ["s"]), base)
    got = sorted((r.id, r.rate) for r in streams.given(spark, "s string, id long, at long, rate double", base).collect() if r.id != 5)
    assert got == [(1, None), (2, 0.4), (3, 0.3), (4, 0.2), (6, None)]


def test_alert_states_over_slots_and_starts_need_no_python(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from folioflow.streaming import streams

    rng, rows = random.Random(6), []
    for k in range(600):
        at = k * 700 + rng.randrange(5)
        for key in ("a", None, "b"):
            # a: short and long runs; b: bad through most slots; rows of one second go by id
            bad = {"a": rng.random() < 0.8, "b": rng.random() < 0.99, None: rng.random() < 0.5}[key]
            rows += [(len(rows), key, at, bad)] + [(len(rows) + 1, key, at, not bad)] * (k % 50 == 7)
    expected, since = {}, {}
    for part in (rows[:900], rows[900:]):
        for i, key, at, bad in sorted(part, key=lambda r: (r[2], r[0])):
            since[key] = (at if since.get(key) is None else since[key]) if bad else None
            expected[i] = "inactive" if not bad else "firing" if at - since[key] >= 1800 else "pending"
    base = str(tmp_path)
    for part in (rows[:900], rows[900:]):
        t = spark.createDataFrame(part, "id long, k string, at long, bad boolean").withColumn("ts", F.timestamp_seconds("at")).drop("at")
        t.write.mode("append").parquet(f"{base}/in")
        s = spark.readStream.schema(t.schema).parquet(f"{base}/in")
        streams.alerts(s, f"{base}/run", 1800, "k")
    got = streams.given(spark, "id long, state string", f"{base}/run")
    assert {r.id: r.state for r in got.collect()} == expected and got.count() == len(rows)
