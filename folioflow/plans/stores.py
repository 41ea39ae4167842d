"""Queries that write and read back: the job store, receipts in two places, metric text; and an alert on a grid of ticks."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import nested, ops
from folioflow.operators.store import JobStore
from folioflow.plans.register import registry
from folioflow.sources import exposition
from folioflow.sources.files import keep, scratch
from folioflow.sources.tables import plain_sql, run_sql, table
from folioflow.streaming.receipts import Receipts

QUERIES, ORACLE_SQL, query = registry()

#: Seven events in a row are the life of a job.
LIFE = """SELECT cast(floor(event_id / 7) as bigint) AS job_id, 't' || cast(user_id % 5 as string) AS tenant_id, ts AS `at`, event_id AS seq, CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'STORED' WHEN 'purchase' THEN 'QUEUED' WHEN 'error' THEN 'FAILED' ELSE 'STORED' END AS kind,
 'raw' AS artifact_bucket, 'k/' || cast(event_id as string) AS artifact_key, 'w' || cast(event_id as string) AS workflow_id, 'code_' || cast(event_id % 9 as string) AS error_code, event_type AS error_message FROM {events}"""
E = plain_sql(LIFE).replace("`at`", "tm")


@query(f"""WITH e AS ({E}), n AS (SELECT max(tm) - INTERVAL 20 DAY AS horizon, max(tm) - INTERVAL 25 DAY AS audit_horizon FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tm DESC, seq DESC) AS n, row_number() OVER (PARTITION BY job_id, kind ORDER BY tm DESC, seq DESC) AS k FROM e),
j AS (SELECT job_id, max(tenant_id) FILTER (n = 1) AS tenant_id, max(kind) FILTER (n = 1) AS status, max(artifact_key) FILTER (k = 1 AND kind = 'STORED') AS artifact_key, max(workflow_id) FILTER (k = 1 AND kind = 'QUEUED') AS workflow_id, max(error_code) FILTER (k = 1 AND kind = 'FAILED') AS error_code, min(tm) AS created_at, max(tm) AS updated_at FROM r GROUP BY job_id),
a AS (SELECT job_id, count(*) AS n FROM e, n WHERE tm >= audit_horizon GROUP BY job_id)
SELECT j.*, coalesce(a.n, 0) AS audited FROM j LEFT JOIN a ON a.job_id = j.job_id, n WHERE created_at >= horizon""")
def job_store(spark, sf_dir):
    """Three batches, the second written twice and the first two compacted; audit rows beside them; then retention, another compaction, and all is read back."""
    events = keep(run_sql(spark, sf_dir, LIFE), "life")
    store = JobStore(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}", events.schema)
    first, last = events.agg(F.min("seq"), F.max("at")).first()
    if first is None:
        return store.jobs().select("job_id", "tenant_id", "status", "artifact_key", "workflow_id", "error_code", "created_at", "updated_at", F.lit(0).cast("long").alias("audited"))
    for batch in (0, 1, 1, 2):
        own = events.filter(F.col("seq") % 3 == batch)
        store.append(own, batch)
        store.audit(own.select("job_id", F.lower("kind").alias("event_type"), F.col("at").alias("created_at")), batch)
        if batch == 1:
            store.compact(1)
    store.expire(last - timedelta(days=20), 3)
    store.compact(3)
    store.expire_audit(last - timedelta(days=25))
    audited = store.audits().groupBy("job_id").agg(F.count("*").alias("audited"))
    t = store.jobs().join(audited, "job_id", "left")
    return t.select("job_id", "tenant_id", "status", "artifact_key", "workflow_id", "error_code", "created_at", "updated_at", F.coalesce("audited", F.lit(0)).cast("long").alias("audited"))


@query("SELECT DISTINCT 'evt-' || cast(user_id AS varchar) || '-' || event_type AS event_key, CASE WHEN user_id % 7 = 0 THEN 'secondary' ELSE 'primary' END AS place, 1::bigint AS receipts FROM events")
def receipts_in_two_places(spark, sf_dir):
    """Three batches by a stream's sink; the first place refuses some keys, and the last batch runs twice."""
    e = keep(table(spark, sf_dir, "events").select(F.concat(F.lit("evt-"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("event_key"), "user_id", "event_id"), "sent")
    sink = Receipts(spark, f"{scratch(spark)}/receipts-{uuid.uuid4().hex}", e.select("event_key", "user_id").schema, "event_key", F.col("user_id") % 7 == 0)
    for batch in (0, 1, 2, 2):
        sink.write(e.filter(F.col("event_id") % 3 == batch), batch)
    return sink.all().groupBy("event_key", "place").agg(F.count("*").alias("receipts"))


@query("""WITH c AS (SELECT event_type, user_id % 20 AS part, count(*) AS n, sum(value) AS s, count(value) AS m, count(*) FILTER (value <= 10) AS b1, count(*) FILTER (value <= 50) AS b2 FROM events GROUP BY ALL),
r AS (SELECT 'requests_total' AS name, 'kind="a\\b' || chr(10) || '"' || event_type || ' part=' || part AS labels, n::double AS value FROM c
 UNION ALL SELECT 'value_bucket', event_type || ' le=10 part=' || part, b1 FROM c UNION ALL SELECT 'value_bucket', event_type || ' le=50 part=' || part, b2 FROM c UNION ALL SELECT 'value_bucket', event_type || ' le=+Inf part=' || part, m FROM c
 UNION ALL SELECT 'value_count', event_type || ' part=' || part, m FROM c UNION ALL SELECT 'value_sum', event_type || ' part=' || part, round(s, 3) FROM c)
SELECT * FROM r""")
def exposition_round_trip(spark, sf_dir):
    """Counters and a histogram of the events as metric text, written, read back and parsed."""
    part = (F.col("user_id") % 20).cast("string")
    c = table(spark, sf_dir, "events").groupBy("event_type", part.alias("part")).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.count("value").alias("m"), F.count_if(F.col("value") <= 10).alias("b1"), F.count_if(F.col("value") <= 50).alias("b2"))

    def sample(family, name, type_, value, **labels):
        of = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), v)))
        return F.struct(F.lit(family).alias("family"), F.lit(name).alias("name"), F.lit(type_).alias("kind"), F.lit("of events").alias("help"), of.alias("labels"), F.col(value).cast("double").alias("value"))

    odd = F.concat(F.lit('"a\\b\n"'), "event_type")
    rows = F.array(
        sample("requests_total", "requests_total", "counter", "n", kind=odd, part=F.col("part")), *(sample("value", "value_bucket", "histogram", b, le=F.lit(le), kind=F.col("event_type"), part=F.col("part")) for b, le in (("b1", "10"), ("b2", "50"), ("m", "+Inf"))),
        sample("value", "value_count", "histogram", "m", kind=F.col("event_type"), part=F.col("part")), sample("value", "value_sum", "histogram", "s", kind=F.col("event_type"), part=F.col("part")),
    )
    path = f"{scratch(spark)}/metrics-{uuid.uuid4().hex}"
    exposition.write(c.select(F.explode(rows).alias("r")).select("r.*"), path)
    got = exposition.read(spark, path)
    at = lambda k: F.try_element_at("labels", F.lit(k))
    shown = F.concat(F.when(F.col("name") == "requests_total", "kind=").otherwise(""), at("kind"), F.coalesce(F.concat(F.lit(" le="), at("le")), F.lit("")), F.lit(" part="), at("part"))
    return got.select("name", shown.alias("labels"), F.when(F.col("name") == "value_sum", F.round("value", 3)).otherwise(F.col("value")).alias("value"))


@query("""WITH e AS (SELECT event_type, user_id % 20 AS part, event_id AS id, epoch_us(ts) // 1000000 AS tm, value FROM events WHERE ts IS NOT NULL),
n AS (SELECT *, lead(tm) OVER (PARTITION BY event_type, part ORDER BY tm, id) AS next_tm FROM e),
h AS (SELECT event_type, part, value, unnest(range(CAST(ceil(tm / 15.0) AS BIGINT) * 15, least(coalesce(next_tm, tm + 301) - 1, tm + 300) + 1, 15)) AS tick FROM n),
s AS (SELECT event_type, tick, coalesce(avg(value) > 60, false) AS bad FROM h GROUP BY ALL),
b AS (SELECT *, coalesce(tick - lag(tick) OVER (PARTITION BY event_type ORDER BY tick) > 15, false) AS late FROM s),
t AS (SELECT *, sum(CASE WHEN bad AND NOT late THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY tick) AS turn FROM b),
f AS (SELECT *, min(CASE WHEN bad THEN tick END) OVER (PARTITION BY event_type, turn) AS since FROM t)
SELECT event_type, CASE WHEN NOT bad THEN 'inactive' WHEN tick - since >= 120 THEN 'firing' ELSE 'pending' END AS state, count(*) AS ticks, min(tick) AS first_tick, max(tick) AS last_tick FROM f GROUP BY ALL""")
def tick_alert(spark, sf_dir):
    """An alert rule on the real samples of the events: the mean over their parts, every 15 seconds, above a bound for two minutes."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).alias("part"), F.col("event_id").alias("id"), "ts", "value")
    ticks = ops.instant(e, ["event_type", "part"]).groupBy("event_type", "at").agg(F.avg("value").alias("value"))
    states = ops.firing(ticks.select("event_type", F.timestamp_seconds("at").alias("ts"), "at", F.coalesce(F.col("value") > 60, F.lit(False)).alias("bad")), 120, ["event_type"], gap=15)
    return states.groupBy("event_type", "state").agg(F.count("*").alias("ticks"), F.min("at").alias("first_tick"), F.max("at").alias("last_tick"))


#: Deliveries with names at several depths; every text holds quotes, white space or other scripts.
NESTED = """SELECT event_id, '{"user":{"ssn":{"digits":[1,2,' || cast(event_id as string) || ']},"name":"  A  ' || chr(92) || '"B' || chr(92) || '" é"},"items":[{"token":"t' || cast(user_id as string) || '","n":' || cast(user_id as string) || '},[],{},[{"ssn":null}]],"kind":"' || event_type || '"' || CASE WHEN event_id % 5 = 0 THEN ',"token":[true]' ELSE '' END || '}' AS payload FROM {events}"""


@query("""SELECT event_id, '{"items":[{"n":' || user_id || ',"token":"[REDACTED]"},[],{},[{"ssn":"[REDACTED]"}]],"kind":"' || event_type || '"' || CASE WHEN event_id % 5 = 0 THEN ',"token":"[REDACTED]"' ELSE '' END || ',"user":{"name":"A ' || chr(92) || '"B' || chr(92) || '" é","ssn":"[REDACTED]"}}' AS payload, 'ssn,token' AS hidden FROM events""")
def nested_redaction(spark, sf_dir):
    """Keys hidden and texts cleaned at any depth."""
    t = nested.rewrite(run_sql(spark, sf_dir, NESTED), "payload", ["ssn", "token"], X.collapse)
    return t.select("event_id", "payload", F.array_join("payload_hidden", ",").alias("hidden"))
