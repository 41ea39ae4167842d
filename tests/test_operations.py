import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioflow.operators import ingest, layout, ops, quality, retention

T0 = dt.datetime(2026, 1, 1)
JOBS = "job_id long, tenant_id string, sha256 string, idempotency_key string, created_at timestamp, status string"


def jobs(spark, hours, status=None):
    return spark.createDataFrame([(k, "t", "x", None, T0 + dt.timedelta(hours=h), (status or {}).get(k, "QUEUED")) for k, h in enumerate(hours)], JOBS)


def test_duplicate_does_not_extend_the_window(spark):
    got = {r.job_id: r.duplicate_of for r in ingest.dedupe_anchored(jobs(spark, [0, 20, 30, 43, 60])).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 2, 4: None}


def test_failed_job_hides_older_one(spark):
    got = {r.job_id: r.duplicate_of for r in ingest.dedupe_anchored(jobs(spark, [0, 30, 31], {1: "FAILED"})).collect()}
    assert got == {0: None, 1: None, 2: None}


def test_lines_follow_the_running_mean(spark):
    rows = [(1, k, f"w{k}", 0, cy - 5, 10, cy + 5, 0.9) for k, cy in enumerate([10, 25, 37, 70])]
    t = layout.normalise_tokens(spark.createDataFrame(rows, "job_id long, index int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"))
    got = {r.line: r.text for r in layout.line_blocks(t).collect()}
    assert got == {0: "w0 w1", 1: "w2", 2: "w3"}


def test_overlap_join_is_not_nested_loop(spark):
    t = layout.normalise_tokens(spark.createDataFrame([(1, 0, "a", 0, 0, 10, 10, 0.9), (1, 1, "b", 200, 0, 210, 10, 0.8)], "job_id long, index int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"))
    b = spark.createDataFrame([(1, "b0", 0, 0, 100, 50)], "job_id long, id string, x1 int, y1 int, x2 int, y2 int")
    pairs = layout.assign(t, b)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [r["index"] for r in pairs.collect()] == [0]
    assert layout.unassigned(t, pairs).first().token_count == 1


def series(spark, values, step=60):
    return spark.createDataFrame([("s", T0 + dt.timedelta(seconds=step * k), float(v)) for k, v in enumerate(values)], "service string, ts timestamp, value double")


def test_rate_counts_resets(spark):
    got = [r.rate for r in ops.rate(series(spark, [0, 60, 120, 10]), 300, ["service"]).orderBy("ts").collect()]
    assert got[0] is None and got[1] == 1.0 and got[3] == pytest.approx(130 / 180)


def test_histogram_quantile(spark):
    b = spark.createDataFrame([("s", 5.0, 1.0), ("s", 10.0, 10.0), ("s", float("inf"), 10.0)], "service string, le double, cum double")
    assert ops.histogram_quantile(b, 0.95, ["service"]).first().value == pytest.approx(9.7222, abs=1e-3)


def test_alert_needs_its_duration(spark):
    t = series(spark, [1] * 5).withColumn("bad", F.col("value") > 0)
    assert [r.state for r in ops.firing(t, 180, ["service"]).orderBy("ts").collect()] == ["pending"] * 3 + ["firing"] * 2


def test_gate_fails_without_value(spark):
    m = spark.createDataFrame([("COMPLETED", True, True, 1.0, 0.9, None, None, True, False, 10.0), ("FAILED", True, True, None, None, 0.2, 0.3, None, False, 20.0)], "runtime_status string, contract_passed boolean, route_match boolean, field_f1 double, extraction_confidence double, ocr_cer double, ocr_wer double, validation_correct boolean, requires_review boolean, latency double")
    a = quality.aggregate(m, 30.0)
    r = a.first()
    assert (r.completion_rate, r.ocr_cer_mean, r.latency_p50_seconds, r.latency_p95_seconds, r.throughput_documents_per_minute) == (0.5, 0.2, 15.0, 19.5, 2.0)
    empty = quality.aggregate(m.filter("false"), 30.0)
    checks = {c.metric: c.passed for c in quality.gate(empty).collect()}
    assert checks["ocr_cer_mean"] is False
    assert quality.gate_passed(quality.gate(a, (("completion_rate", ">=", 0.4),)), 0).first().passed


def test_retention_policy():
    retention.Policy(30, 90, 365)
    with pytest.raises(ValueError):
        retention.Policy(30, 90, 60)


def test_every_query_has_a_name_and_a_frame():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
