"""Streaming queries, drained; the oracle is the batch SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.operators import ingest as I
from folioflow.plans.intake import J
from folioflow.plans.intake import ORACLE_SQL as INTAKE_SQL
from folioflow.sources.files import keep, scratch
from folioflow.sources.tables import plain_sql, run_sql, spread, table
from folioflow.streaming import intake as IN
from folioflow.streaming import series as SE
from folioflow.streaming import streams as ST
from folioflow.streaming.receipts import Receipts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def deliveries(df, by, parts=4):
    """A table in parts of its span of ``by`` (a number), in order; none where it is empty."""
    rows = keep(df, "deliveries")
    first, last = rows.agg(F.min(by), F.max(by)).first()
    for k in range(parts if first is not None else 0):
        of = F.least(F.floor((by - first) * parts / (last - first + 1)), F.lit(parts - 1))
        yield rows.filter(of == k), rows.schema


def delivered(spark, df, base, second=F.unix_seconds):
    """A table of events as such a stream; every step has it written one part further, by all cores. second: of a time, so that no second is in two parts."""
    for part, schema in deliveries(spread(df), second(F.col("ts"))):
        part.write.mode("append").parquet(f"{base}/in")
        yield spark.readStream.schema(schema).parquet(f"{base}/in")


def jobs(e):
    status = F.when(F.col("event_id") % 17 == 0, "FAILED").when(F.col("event_id") % 2 == 0, "QUEUED").otherwise("STORED")
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), (F.col("event_id") % 500).cast("string")))
    return e.select(F.col("event_id").alias("job_id"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("sha256"), key.alias("idempotency_key"), F.col("ts").alias("created_at"), status.alias("status"))


def timed(spark, sf_dir):
    return table(spark, sf_dir, "events").drop("props").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_requests(spark, sf_dir):
    t = ST.drain(ST.tumbling(ST.source(spark, sf_dir, "events"), ["event_type"]), ["window", "event_type"])
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type FROM events), w AS (SELECT hour - to_hours(k) AS start, event_type FROM h, (SELECT unnest([0, 1, 2]) AS k)) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def stream_sliding_rate(spark, sf_dir):
    t = ST.drain(ST.sliding(ST.source(spark, sf_dir, "events"), ["event_type"], "3 hours", "1 hour"), ["window", "event_type"])
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"WITH j AS ({J}) SELECT DISTINCT tenant_id, idempotency_key FROM j WHERE idempotency_key IS NOT NULL")
def stream_idempotent_intake(spark, sf_dir):
    s = jobs(ST.source(spark, sf_dir, "events")).filter("idempotency_key IS NOT NULL")
    return ST.drain(ST.first_by_key(s, ["tenant_id", "idempotency_key"])).select("tenant_id", "idempotency_key")


@query(INTAKE_SQL["dedupe_24h"])
def stream_dedupe_24h(spark, sf_dir):
    base = f"{scratch(spark)}/dedupe-{uuid.uuid4().hex}"
    for e in delivered(spark, timed(spark, sf_dir), base, I.second):
        ST.dedupe(jobs(e), base)
    return ST.given(spark, "job_id long, duplicate_of long", base).drop("batch")


@query("WITH e AS (SELECT event_id AS id, event_type, epoch(ts)::bigint AS tm, coalesce(value > 60, false) AS bad FROM events), t AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY tm, id ROWS UNBOUNDED PRECEDING) AS turn FROM e), s AS (SELECT *, min(CASE WHEN bad THEN tm END) OVER (PARTITION BY event_type, turn) AS since FROM t) SELECT id, CASE WHEN NOT bad THEN 'inactive' WHEN tm - since >= 1800 THEN 'firing' ELSE 'pending' END AS state FROM s")
def stream_alert_state(spark, sf_dir):
    s = ST.source(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "ts", F.coalesce(F.col("value") > 60, F.lit(False)).alias("bad"))
    base = f"{scratch(spark)}/alert-state-{uuid.uuid4().hex}"
    ST.alerts(s, base, 1800, "event_type")
    return ST.given(spark, "id long, state string", base).drop("batch")


@query("SELECT DISTINCT 'evt-' || cast(user_id AS varchar) || '-' || event_type AS event_key FROM events")
def stream_webhook_receipts(spark, sf_dir):
    """Terminal events are sent once: a receipt a key, whatever the batches."""
    base = f"{scratch(spark)}/receipts-{uuid.uuid4().hex}"
    e = ST.source(spark, sf_dir, "events").select(F.concat(F.lit("evt-"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("event_key"))
    sink = Receipts(spark, f"{base}/out", e.schema, "event_key")
    for run in range(2):  # a second stream of the same events finds all receipts there
        sink.run(e, f"{base}/state-{run}")
    return sink.all().select("event_key")


#: Every document is uploaded, a third of them again later: under the same key, another or none. Some have a signature, some the wrong type, source or name.
REQUESTS = """WITH d AS (SELECT doc_id, 0 AS k, 2 * doc_id AS seq, coalesce(text, '') AS text FROM {documents} UNION ALL SELECT doc_id, 1, 2 * doc_id + 1, coalesce(text, '') FROM {documents} WHERE doc_id % 3 = 0)
SELECT 't' || cast(doc_id % 3 as string) AS tenant_id, CASE WHEN doc_id % 5 = 0 THEN 'k' || cast(doc_id % 400 as string) WHEN seq % 7 = 0 THEN 'only' || cast(seq as string) END AS idempotency_key,
 CASE doc_id % 41 WHEN 7 THEN 'fax' ELSE 'email' END AS source, CASE doc_id % 6 WHEN 0 THEN 'application/pdf; charset=x' WHEN 1 THEN 'text/html' ELSE 'application/octet-stream' END AS declared,
 1700000000 + 300 * doc_id + k * CASE doc_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 40000 WHEN 2 THEN 86400 ELSE 90000 END AS at, seq, CASE doc_id % 11 WHEN 3 THEN 'notes.txt' ELSE 'Scan ' || cast(doc_id as string) || '.pdf' END AS name,
 CASE doc_id % 13 WHEN 5 THEN 'BM' WHEN 6 THEN '' ELSE '%PDF-' END || text AS body FROM d""".replace(" AS at,", " AS `at`,")
FAILS = "CASE WHEN seq % 17 = 2 THEN 'ARTIFACT_UPLOAD_FAILED' WHEN seq % 17 = 3 THEN 'QUEUE_PUBLISH_FAILED' END"
RQ = plain_sql(REQUESTS).replace("`at`", '"at"')


@query(f"""WITH RECURSIVE q AS ({RQ}),
c AS (SELECT seq, tenant_id, idempotency_key AS k, "at" AS tm, sha256(body || chr(10)) AS sha, {FAILS} AS failure,
 CASE WHEN source = 'fax' THEN 422 WHEN name LIKE '%.txt' THEN 415 WHEN declared = 'text/html' THEN 415 WHEN starts_with(body, 'BM') THEN 415 ELSE 200 END AS http FROM q),
s AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY tm, seq) AS n FROM c WHERE http = 200),
f AS (SELECT tenant_id, 0::BIGINT AS n, NULL::BIGINT AS seq, '' AS outcome, NULL::BIGINT AS job, '' AS status, MAP {{}}::MAP(VARCHAR, STRUCT(job BIGINT, status VARCHAR)) AS keys, MAP {{}}::MAP(VARCHAR, STRUCT(job BIGINT, tm BIGINT, status VARCHAR)) AS seen FROM (SELECT DISTINCT tenant_id FROM s)
 UNION ALL SELECT tenant_id, n, seq, outcome, job, status,
  CASE WHEN outcome IN ('accepted', 'failed') AND k IS NOT NULL THEN map_concat(keys, MAP {{k: {{'job': job, 'status': status}}}}) ELSE keys END,
  CASE WHEN outcome IN ('accepted', 'failed') THEN map_concat(seen, MAP {{sha: {{'job': job, 'tm': tm, 'status': status}}}}) ELSE seen END
 FROM (SELECT *, CASE WHEN kj IS NOT NULL THEN kj.job WHEN dup THEN cj.job ELSE seq END AS job, CASE WHEN kj IS NOT NULL THEN kj.status WHEN dup THEN cj.status WHEN failure IS NULL THEN 'QUEUED' ELSE 'FAILED' END AS status,
   CASE WHEN kj IS NOT NULL THEN 'idempotent_replay' WHEN dup THEN 'deduplicated' WHEN failure IS NULL THEN 'accepted' ELSE 'failed' END AS outcome
  FROM (SELECT *, coalesce(cj.tm >= tm - 86400 AND cj.status <> 'FAILED', false) AS dup FROM (SELECT s.*, f.keys, f.seen, f.keys[s.k] AS kj, f.seen[s.sha] AS cj FROM f JOIN s ON s.tenant_id = f.tenant_id AND s.n = f.n + 1)))),
r AS (SELECT seq, outcome, job, status FROM f WHERE n > 0)
SELECT c.seq, c.tenant_id, coalesce(r.outcome, 'rejected') AS outcome, cast(CASE WHEN http <> 200 THEN http WHEN r.outcome = 'failed' THEN 503 ELSE 202 END AS int) AS http_status, r.job AS job_id, r.status,
 CASE r.outcome WHEN 'idempotent_replay' THEN 'idempotency_replay' WHEN 'deduplicated' THEN 'duplicate_detected' WHEN 'accepted' THEN 'job_registered,artifact_persisted,workflow_queued'
  WHEN 'failed' THEN CASE failure WHEN 'ARTIFACT_UPLOAD_FAILED' THEN 'job_registered,artifact_upload_failed' ELSE 'job_registered,artifact_persisted,queue_publish_failed' END ELSE '' END AS audit
FROM c LEFT JOIN r ON c.seq = r.seq""")
def stream_intake(spark, sf_dir):
    """Four deliveries of files; after each the stream is started anew from its state."""
    base = f"{scratch(spark)}/intake-{uuid.uuid4().hex}"
    for part, _ in deliveries(run_sql(spark, sf_dir, REQUESTS), F.col("at")):
        IN.submit(part, f"{base}/uploads")
        ST.advance(IN.taken_in(IN.uploads(spark, f"{base}/uploads"), F.expr(FAILS)), base)
    return ST.given(spark, IN.RESULT, base).drop("batch")


@query("""WITH e AS (SELECT event_type, user_id % 20 AS part, event_id AS id, epoch_us(ts) // 1000000 AS tm, value AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
u AS (SELECT *, lag(v) OVER w AS b FROM e WINDOW w AS (PARTITION BY event_type, part ORDER BY tm, id)),
c AS (SELECT *, sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) OVER (PARTITION BY event_type, part ORDER BY tm, id ROWS UNBOUNDED PRECEDING) AS total FROM u),
f AS (SELECT a.id, arg_min(b.total, (b.tm, b.id)) AS total0, min(b.tm) AS tm0 FROM c a JOIN c b ON a.event_type = b.event_type AND a.part = b.part AND b.tm BETWEEN a.tm - 21600 AND a.tm GROUP BY a.id)
SELECT id, round(CASE WHEN tm > tm0 THEN (total - total0) / (tm - tm0) END, 6) AS rate FROM c JOIN f USING (id)""")
def stream_rate(spark, sf_dir):
    """Rates over six hours, the state carried over four starts of the stream."""
    base = f"{scratch(spark)}/rate-{uuid.uuid4().hex}"
    labels = ["event_type", "part"]
    for e in delivered(spark, timed(spark, sf_dir), base):
        s = e.select("event_type", (F.col("user_id") % 20).alias("part"), F.col("event_id").alias("id"), "ts", "value")
        ST.advance(SE.rates(s, 21600, labels), base)
    return ST.given(spark, "id long, rate double", base).select("id", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT event_type, user_id % 20 AS part, event_id AS id, epoch_us(ts) // 1000000 AS tm, coalesce(value > 60, false) AS bad FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, lag(tm) OVER w AS before, lag(bad) OVER w AS bad_before, lead(tm) OVER w AS next_tm FROM e WINDOW w AS (PARTITION BY event_type, part ORDER BY tm, id)),
i AS (SELECT *, sum(CASE WHEN bad AND bad_before AND tm - before <= 14400 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type, part ORDER BY tm, id) AS run FROM b),
r AS (SELECT event_type, part, min(tm) AS since, max(tm) AS last, arg_max_null(next_tm, (tm, id)) AS next_tm FROM i WHERE bad GROUP BY event_type, part, run),
s AS (SELECT *, least(coalesce(next_tm, last + 14400), last + 14400) AS over FROM r), w AS (SELECT floor(max(epoch_ms(ts)) / 1000.0) AS now FROM events),
c AS (SELECT event_type, part, since AS tm, 'pending' AS state FROM s UNION ALL SELECT event_type, part, since + 3600, 'firing' FROM s WHERE over > since + 3600 UNION ALL SELECT event_type, part, over, CASE WHEN over > since + 3600 THEN 'resolved' ELSE 'inactive' END FROM s)
SELECT event_type, part, tm AS changed_at, state FROM c, w WHERE tm <= now""")
def stream_alert_changes(spark, sf_dir):
    """The life of an alert that holds for an hour and is stale after four, over four starts of the stream."""
    base = f"{scratch(spark)}/alerts-{uuid.uuid4().hex}"
    for e in delivered(spark, timed(spark, sf_dir), base):
        s = e.select("event_type", (F.col("user_id") % 20).alias("part"), F.col("event_id").alias("id"), "ts", (F.col("value") > 60).alias("bad"))
        ST.advance(SE.alert_life(s, 3600, 14400, ["event_type", "part"]), base)
    return ST.given(spark, "event_type string, part long, at long, state string", base).select("event_type", "part", F.col("at").alias("changed_at"), "state")
