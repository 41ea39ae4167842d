"""Queries over the life of jobs; a job is one of 997 numbers of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import lifecycle as LC
from folioflow.operators import retention
from folioflow.plans.intake import JOBS as SUBMITTED
from folioflow.plans.register import registry
from folioflow.sources.tables import plain_sql, run_sql, table

QUERIES, ORACLE_SQL, query = registry()

LIFE = """SELECT event_id % 997 AS job_id, ts AS at, event_id AS seq, CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'STORED' WHEN 'purchase' THEN 'QUEUED' WHEN 'error' THEN 'FAILED' ELSE 'STORED' END AS kind,
 'raw' AS artifact_bucket, 'k/' || cast(event_id as string) AS artifact_key, 'w' || cast(event_id as string) AS workflow_id, 'code_' || cast(event_id % 9 as string) AS error_code, repeat('m', cast(event_id % 900 as int)) AS error_message FROM {events}"""
E = plain_sql(LIFE).replace("AS at,", 'AS "at",')


@query(f"""WITH e AS (SELECT *, "at" AS tm FROM ({E})), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tm DESC, seq DESC) AS n, row_number() OVER (PARTITION BY job_id, kind ORDER BY tm DESC, seq DESC) AS k FROM e)
SELECT job_id, max(kind) FILTER (n = 1) AS status, max(artifact_bucket) FILTER (k = 1 AND kind = 'STORED') AS artifact_bucket, max(artifact_key) FILTER (k = 1 AND kind = 'STORED') AS artifact_key, max(workflow_id) FILTER (k = 1 AND kind = 'QUEUED') AS workflow_id,
 max(error_code) FILTER (k = 1 AND kind = 'FAILED') AS error_code, max(left(error_message, 500)) FILTER (k = 1 AND kind = 'FAILED') AS error_message, min(tm) AS created_at, max(tm) AS updated_at FROM r GROUP BY job_id""")
def job_lifecycle(spark, sf_dir):
    return LC.jobs(run_sql(spark, sf_dir, LIFE))


@query(f"""SELECT job_id, string_agg(kind, ',' ORDER BY "at", seq) AS history FROM ({E}) GROUP BY job_id""")
def status_history(spark, sf_dir):
    polls = run_sql(spark, sf_dir, LIFE).withColumnRenamed("kind", "status")
    return LC.history(polls).select("job_id", F.array_join("history", ",").alias("history"))


@query("SELECT event_id AS job_id, 't' || cast(user_id % 5 AS varchar) AS tenant_id, 'RECEIVED' AS status, cast(NULL AS varchar) AS artifact_key, cast(length(props) AS bigint) AS size_bytes, ts AS created_at, ts AS updated_at FROM events")
def created_jobs(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"), F.length("props").cast("long").alias("size_bytes"), "ts")
    return LC.received(t, F.col("ts")).select("job_id", "tenant_id", "status", "artifact_key", "size_bytes", "created_at", "updated_at")


AUDIT = "SELECT event_id AS id, user_id % 50 AS job_id, 't' || cast(user_id % 5 as string) AS tenant_id, event_type, props AS event_payload, ts AS created_at FROM {events}"


@query(f"SELECT id, event_type, created_at FROM ({plain_sql(AUDIT)}) WHERE tenant_id = 't2' AND job_id = 7 ORDER BY created_at DESC, id DESC LIMIT 100")
def audit_events_topk(spark, sf_dir):
    return LC.audit_of(run_sql(spark, sf_dir, AUDIT), "t2", F.lit(7), 100).select("id", "event_type", "created_at")


@query(f"SELECT job_id, status FROM ({plain_sql(SUBMITTED)}) WHERE tenant_id = 't3' AND job_id = (SELECT min(event_id) FROM events WHERE user_id % 5 = 3)")
def job_by_id(spark, sf_dir):
    jobs = run_sql(spark, sf_dir, SUBMITTED)
    first = jobs.filter("tenant_id = 't3'").agg(F.min("job_id")).first()[0]
    return LC.job_of(jobs, "t3", first).select("job_id", "status")


@query(f"WITH a AS ({plain_sql(AUDIT)}), m AS (SELECT max(created_at) AS now FROM a) SELECT tenant_id, count(*) FILTER (created_at >= now - INTERVAL 20 DAY) AS kept, count(*) FILTER (created_at < now - INTERVAL 20 DAY) AS deleted FROM a, m GROUP BY tenant_id")
def retention_audit(spark, sf_dir):
    t = run_sql(spark, sf_dir, AUDIT)
    gone = retention.older(F.col("created_at"), F.lit(t.agg(F.max("created_at")).first()[0]), 20)
    return t.groupBy("tenant_id").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(cast(microsecond(ts) % 1000000 AS varchar), 6, '0') END AS at FROM events".replace(" AS at ", ' AS "at" '))
def iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", LC.iso(F.col("ts")).alias("at"))


@query("SELECT event_type, count(*) AS audited, count(*) FILTER (event_id % 10 = 0) AS failures FROM events GROUP BY event_type")
def audit_appends(spark, sf_dir):
    # an audit row that cannot be written is counted and holds nothing up
    t = table(spark, sf_dir, "events")
    return t.groupBy("event_type").agg(F.count("*").alias("audited"), F.count_if(F.col("event_id") % 10 == 0).alias("failures"))
