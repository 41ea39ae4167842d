"""Windows of intake over times with fractions of a second, as their SQL takes them: to the nearest second."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.plans import intake, streams

#: Of two seconds each the fractions differ in whether the nearest second lies a day apart; the ids of the later half are the smaller ones.
TIMES = [(0.6, 86_401.4), (0.4, 86_400.6), (0.5, 86_401.5), (1.5, 86_402.5), (7.2, 86_407.2), (0.3, 43_200.7), (86_399.7, 86_400.2, 172_799.9, 172_800.1)]


def events(spark, path, ids=1):
    rows = [(ids * (7 * u + 3 - k), round(at * 1e6), u, "view") for u, times in enumerate(TIMES) for k, at in enumerate(times)]
    t = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string")
    t.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def by_sql(path, sql):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return sorted(c.sql(sql).fetchall())


@pytest.mark.parametrize("module,name,ids", [(intake, "dedupe_24h", 1), (intake, "recent_job_by_hash", 1), (intake, "recent_job_by_hash", 9_999_999), (streams, "stream_dedupe_24h", 1)])
def test_windows_of_nearest_seconds(spark, tmp_path, module, name, ids):
    path = events(spark, tmp_path, ids)
    assert sorted(map(tuple, module.QUERIES[name](spark, path).collect())) == by_sql(path, module.ORACLE_SQL[name])


def test_order_of_recent_jobs(spark, tmp_path):
    from folioflow.operators import ingest

    rows = [(1, 20_000_000, 10.0), (2, 1, 11.0), (3, 5, 12.0)]
    t = spark.createDataFrame([("t", "a", job, at) for _, job, at in rows], "tenant_id string, sha256 string, job_id long, at double").withColumn("created_at", F.timestamp_seconds("at"))
    got = lambda **kw: {r.job_id: r.recent_job for r in ingest.recent_by_hash(t, **kw).collect()}
    assert got() == {20_000_000: None, 1: 20_000_000, 5: 1}
    assert got(order=F.col("_at") * 10_000_000 + F.col("job_id")) == {20_000_000: None, 1: 20_000_000, 5: 20_000_000}
