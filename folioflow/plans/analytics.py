"""Queries over evaluation, outcomes, operational series and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions import text as X
from folioflow.operators import ops, outcome, quality, retention
from folioflow.operators.extract import extract
from folioflow.operators.rank import percentiles
from folioflow.plans import oracle as O
from folioflow.plans.documents import validated
from folioflow.plans.intake import JOBS
from folioflow.sources.tables import CORPUS, corpus, plain_sql, run_sql, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Predictions: some texts with a letter lost or a word changed.
PREDICTED = f"SELECT job_id, expected_route, text, CASE job_id % 5 WHEN 0 THEN replace(text, 'a', 'o') WHEN 1 THEN replace(text, 'Date', 'Dute now') WHEN 2 THEN substr(text, 1, 40) ELSE text END AS predicted FROM ({CORPUS})"


def predicted(spark, sf_dir):
    return run_sql(spark, sf_dir, PREDICTED, orders=spread(table(spark, sf_dir, "orders")))


@query(f"SELECT job_id, round(levenshtein(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(predicted, '\\s+', ' ', 'g')))) / cast(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as double), 6) AS cer FROM ({plain_sql(PREDICTED)})")
def ocr_cer(spark, sf_dir):
    return X.error_rates(predicted(spark, sf_dir), "text", "predicted", words=False).select("job_id", "cer")


#: The edit distance of two word lists, a word of the first a step: what a step costs without insertions, then the cheapest run of insertions up to each place.
WER = f"""WITH RECURSIVE p AS (SELECT job_id, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS e, list_filter(string_split(lower(trim(regexp_replace(predicted, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM ({plain_sql(PREDICTED)})),
d AS (SELECT job_id, e, w, 0 AS i, range(0, len(w) + 1) AS r FROM p
 UNION ALL SELECT job_id, e, w, i + 1, list_transform(range(1, len(w) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: c[k] + j - k))) FROM (SELECT *, list_transform(range(0, len(w) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(r[j + 1] + 1, r[j] + CASE WHEN w[j] = e[i + 1] THEN 0 ELSE 1 END) END) AS c FROM d WHERE i < len(e)))
SELECT job_id, round(r[len(w) + 1] / cast(len(e) AS double), 6) AS wer FROM d WHERE i = len(e)"""


@query(WER)
def ocr_wer(spark, sf_dir):
    return X.error_rates(predicted(spark, sf_dir), "text", "predicted").select("job_id", "wer")


def _fields(spark, sf_dir):
    """Expected and predicted maps of receipts: the total as digits, the tax with a prefix."""
    t = extract(corpus(spark, sf_dir).filter("kind = 1").withColumn("route", F.lit("receipt")))
    expected = F.create_map(F.lit("total_amount"), F.concat(F.lit("Rp "), F.col("total").cast("string")), F.lit("tax_amount"), F.lit("3,00"), F.lit("merchant_name"), F.concat(F.lit("CORNER  store "), F.col("customer").cast("string")))
    return quality.scores(t.withColumn("c", quality.compare_fields(expected, F.col("fields"))))


RECEIPT = S.PATTERNS["receipt"]
PRF = f"""WITH corpus AS ({plain_sql(CORPUS)}), f AS (SELECT job_id, {O.field_sql(RECEIPT['total_amount'])} AS a, {O.field_sql(RECEIPT['tax_amount'])} AS b, {O.field_sql(RECEIPT['merchant_name'])} AS c, total, customer FROM corpus WHERE kind = 1),
m AS (SELECT job_id, a <> '' AS pa, b <> '' AS pb, c <> '' AS pc, coalesce(try_cast(replace(a, '$', '') AS double) = cast(total AS double), false) AS ma, b = '$3.00' AS mb, lower(c) = 'corner store ' || cast(customer AS varchar) AS mc FROM f),
n AS (SELECT job_id, ma::int + mb::int + mc::int AS correct, pa::int + pb::int + pc::int AS present FROM m),
r AS (SELECT *, CASE WHEN present > 0 THEN correct / cast(present AS double) ELSE 0.0 END AS p, correct / cast(3 AS double) AS r FROM n)
SELECT job_id, correct AS correct_field_count, round(p, 6) AS field_precision, round(r, 6) AS field_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS field_f1 FROM r"""


@query(PRF)
def field_prf1(spark, sf_dir):
    return _fields(spark, sf_dir).select("job_id", F.col("c.correct_field_count").alias("correct_field_count"), "field_precision", "field_recall", "field_f1")


#: Sample metrics from events: some latencies and error rates missing.
SAMPLES = """SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS runtime_status, event_id % 31 <> 0 AS contract_passed, event_id % 9 <> 0 AS route_match,
 CASE WHEN event_id % 10 = 0 THEN NULL ELSE cast(event_id % 100 as double) / 100 END AS field_f1, cast(event_id % 50 as double) / 50 AS extraction_confidence, CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(event_id % 20 as double) / 100 END AS ocr_cer,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(event_id % 30 as double) / 100 END AS ocr_wer, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 7 <> 0 END AS validation_correct, event_id % 3 = 0 AS requires_review, CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS latency FROM {events}"""
AGG = f"""SELECT cast(count(*) as double) AS sample_count, round(avg(CASE WHEN runtime_status = 'COMPLETED' THEN 1.0 ELSE 0.0 END), 6) AS completion_rate, round(avg(CASE WHEN contract_passed THEN 1.0 ELSE 0.0 END), 6) AS pipeline_contract_pass_rate, round(avg(CASE WHEN route_match THEN 1.0 ELSE 0.0 END), 6) AS route_accuracy,
 round(avg(coalesce(field_f1, 0)), 6) AS field_f1_mean, round(avg(coalesce(extraction_confidence, 0)), 6) AS extraction_confidence_mean, round(avg(ocr_cer), 6) AS ocr_cer_mean, round(avg(ocr_wer), 6) AS ocr_wer_mean, round(avg(CASE WHEN validation_correct THEN 1.0 WHEN NOT validation_correct THEN 0.0 END), 6) AS validation_accuracy,
 round(avg(CASE WHEN requires_review THEN 1.0 ELSE 0.0 END), 6) AS human_review_rate, round(quantile_cont(latency, 0.5), 6) AS latency_p50_seconds, round(quantile_cont(latency, 0.95), 6) AS latency_p95_seconds, round(sum(CASE WHEN runtime_status = 'COMPLETED' THEN 1 ELSE 0 END) * 60 / cast(3600 as double), 6) AS throughput_documents_per_minute FROM ({plain_sql(SAMPLES)})"""


def _aggregate(spark, sf_dir):
    return quality.aggregate(run_sql(spark, sf_dir, SAMPLES), 3600.0)


@query(AGG)
def aggregate_metrics(spark, sf_dir):
    return _aggregate(spark, sf_dir)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    t = percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])
    return t.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


GATE = f"WITH a AS ({AGG}), g AS (" + " UNION ALL ".join(f"SELECT {k} AS turn, '{m}' AS metric, '{op}' AS operator, cast({t} as double) AS threshold, {m} AS actual, coalesce({m} {op} {t}, false) AS passed FROM a" for k, (m, op, t) in enumerate(S.GATES)) + ")"


@query(GATE + " SELECT * FROM g")
def quality_gate(spark, sf_dir):
    return quality.gate(_aggregate(spark, sf_dir))


POLICY = [("route_accuracy", 0.85), ("field_f1_mean", 0.75), ("unknown_metric", 1.0), ("sample_count", 20.0), ("human_review_rate", 0.5), ("latency_p95_seconds", 180.0)]


@query(GATE + ", p AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', cast({t} as double))" for m, t in POLICY) + ") v(metric, threshold)) SELECT * FROM (SELECT p.metric, CASE WHEN g.metric IS NULL THEN 'missing' WHEN abs(g.threshold - p.threshold) > 1e-9 THEN 'threshold_mismatch' WHEN NOT g.passed THEN 'failed' END AS reason FROM p LEFT JOIN g ON p.metric = g.metric) WHERE reason IS NOT NULL")
def promotion_evidence(spark, sf_dir):
    return quality.promotion_failures(quality.gate(_aggregate(spark, sf_dir)), spark.createDataFrame(POLICY, "metric string, threshold double"))



V = O.VALIDATED





@query("SELECT c_custkey, '[REDACTED]' AS name, c_mktsegment AS segment, 'Name' AS redacted FROM customer")
def redact_fields(spark, sf_dir):
    m = F.create_map(F.lit("Name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    t = table(spark, sf_dir, "customer").withColumn("m", outcome.redact(m, ["name", "ssn"])).withColumn("r", outcome.redacted_names(m, ["name", "ssn"]))
    return t.select("c_custkey", F.element_at("m", "Name").alias("name"), F.element_at("m", "segment").alias("segment"), F.array_join("r", ",").alias("redacted"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN lower(coalesce(scheme, '')) NOT IN ('http', 'https') OR coalesce(host, '') = '' THEN 'not_absolute' WHEN host <> 'hooks.example.com' THEN 'host_not_allowed' END AS reason FROM u""")
def webhook_events(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", outcome.webhook_reason(F.col("url"), ["hooks.example.com"]).alias("reason"))



@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def replay_antijoin(spark, sf_dir):
    receipts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "success").otherwise("failed").alias("status"))
    return outcome.to_do(table(spark, sf_dir, "orders").select("o_orderkey"), receipts, "o_orderkey")



RESULTS = "SELECT event_id, 'k' AS ocr_key, 'k' AS layout_key, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'k' END AS classification_key, 'k' AS extraction_key, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'k' END AS validation_key, CASE event_id % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN 'pending_human_review' WHEN 2 THEN 'failed' ELSE 'odd' END AS final_status, CASE WHEN event_id % 8 = 1 THEN 'r' END AS review_task_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' END AS total FROM {events}"


@query(f"""SELECT event_id, concat_ws('|', CASE WHEN trim(classification_key) = '' THEN 'missing_stage:classification' END, CASE WHEN validation_key IS NULL THEN 'missing_stage:validation' END, CASE WHEN final_status = 'odd' THEN 'unknown_status' END,
 CASE WHEN final_status = 'delivered' AND total = '' THEN 'delivered_without:total_amount' END, CASE WHEN final_status = 'pending_human_review' AND review_task_id IS NULL THEN 'missing_review_task' END) AS errors FROM ({plain_sql(RESULTS)})""")
def contract_errors(spark, sf_dir):
    t = run_sql(spark, sf_dir, RESULTS)
    t = t.withColumn("fields", F.create_map(F.lit("invoice_number"), F.lit("n"), F.lit("invoice_date"), F.lit("d"), F.lit("total_amount"), F.col("total")))
    return t.select("event_id", F.array_join(outcome.contract_errors(t), "|").alias("errors"))


@query(V + " SELECT CASE verdict WHEN 'auto_approved' THEN 'delivery' ELSE 'human_review' END AS branch, count(*) AS n FROM verdicts GROUP BY ALL")
def pipeline_branch_counts(spark, sf_dir):
    return validated(spark, sf_dir).groupBy(F.when(F.col("verdict") == "auto_approved", "delivery").otherwise("human_review").alias("branch")).agg(F.count("*").alias("n"))


# -- operational series: a request log from events, sampled by minute into counters -------
LOG = "SELECT event_type AS service, '/p' || cast(event_id % 20 as string) AS path, CASE WHEN event_id % 50 < 3 THEN 500 WHEN event_id % 50 < 8 THEN 404 ELSE 200 END AS status, date_trunc('hour', ts) AS hour, ts, event_id, value / 10 AS duration FROM {events}"
L = plain_sql(LOG)
COUNTER = "SELECT service, hour AS ts, cast(sum(n) OVER (PARTITION BY service ORDER BY hour) as double) AS value FROM (SELECT event_type AS service, date_trunc('hour', ts) AS hour, count(*) AS n FROM {events} GROUP BY 1, 2)"


@query(f"WITH c AS ({plain_sql(COUNTER)}), u AS (SELECT *, epoch(ts)::bigint AS tm, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS up FROM c WINDOW w AS (PARTITION BY service ORDER BY ts)), s AS (SELECT service, ts, count(*) OVER x AS n, (sum(up) OVER x - first_value(up) OVER x) AS inc, tm - min(tm) OVER x AS span FROM u WINDOW x AS (PARTITION BY service ORDER BY tm RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)) SELECT service, ts, round(CASE WHEN n > 1 THEN inc / span END, 9) AS rate FROM s")
def counter_rate(spark, sf_dir):
    t = ops.rate(run_sql(spark, sf_dir, COUNTER), 21600, ["service"])
    return t.select("service", "ts", F.round("rate", 9).alias("rate"))


@query(f"WITH l AS ({L}) SELECT service, hour, round(sum(CASE WHEN status >= 500 THEN 1 ELSE 0 END) / cast(count(*) as double), 6) AS error_rate, count(*) AS n FROM l GROUP BY ALL")
def error_rate_by_service(spark, sf_dir):
    bad = F.sum(F.when(F.col("status") >= 500, 1).otherwise(0))
    return run_sql(spark, sf_dir, LOG).groupBy("service", "hour").agg(F.round(bad / F.count("*"), 6).alias("error_rate"), F.count("*").alias("n"))


BOUNDS = [0.5, 1.0, 2.5, 5.0, 7.5, 10.0]
HIST = f"WITH l AS ({L}), b AS (" + " UNION ALL ".join(f"SELECT service, cast({b} as double) AS le, cast(sum(CASE WHEN duration <= {b} THEN 1 ELSE 0 END) as double) AS cum FROM l GROUP BY service" for b in BOUNDS) + " UNION ALL SELECT service, cast('Infinity' as double) AS le, cast(count(duration) as double) AS cum FROM l GROUP BY service)"


@query(HIST + " SELECT service, CASE WHEN le > 1e300 THEN -1.0 ELSE le END AS le, cum FROM b")
def histogram_buckets(spark, sf_dir):
    t = ops.cumulative_buckets(run_sql(spark, sf_dir, LOG), "duration", BOUNDS, ["service"])
    return t.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query(HIST + ", w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY service ORDER BY le), 0.0) AS low, coalesce(lag(cum) OVER (PARTITION BY service ORDER BY le), 0.0) AS under, 0.95 * max(cum) OVER (PARTITION BY service) AS rnk FROM b), h AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY le) AS k FROM w WHERE cum >= rnk AND rnk > 0) SELECT service, round(CASE WHEN le > 1e300 THEN low ELSE low + (le - low) * (rnk - under) / (cum - under) END, 6) AS value FROM h WHERE k = 1")
def histogram_quantile_p95(spark, sf_dir):
    b = ops.cumulative_buckets(run_sql(spark, sf_dir, LOG), "duration", BOUNDS, ["service"])
    return ops.histogram_quantile(b, 0.95, ["service"]).select("service", F.round("value", 6).alias("value"))


@query(f"WITH l AS ({L}) SELECT service, path, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, service, path LIMIT 15")
def topk_endpoints(spark, sf_dir):
    t = run_sql(spark, sf_dir, LOG).groupBy("service", "path").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "service", "path").limit(15)


@query(f"WITH l AS ({L}), s AS (SELECT DISTINCT service FROM l), h AS (SELECT DISTINCT hour FROM l) SELECT s.service, h.hour FROM s CROSS JOIN h WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.service = s.service AND l.hour = h.hour)")
def absent_series(spark, sf_dir):
    seen = run_sql(spark, sf_dir, LOG).select("service", "hour").distinct()
    spine = seen.select("service").distinct().crossJoin(seen.select("hour").distinct())
    return ops.absent(spine, seen, ["service", "hour"])


BAD = "SELECT service, hour AS ts, max(value) > 60 AS bad FROM (SELECT event_type AS service, date_trunc('hour', ts) AS hour, value FROM {events}) GROUP BY 1, 2"


@query(f"WITH c AS ({plain_sql(BAD)}), t AS (SELECT *, epoch(ts)::bigint AS tm, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY service ORDER BY ts) AS turn FROM c), s AS (SELECT *, min(CASE WHEN bad THEN tm END) OVER (PARTITION BY service, turn) AS since FROM t) SELECT service, ts, CASE WHEN NOT bad THEN 'inactive' WHEN tm - since >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM s")
def alert_for_duration(spark, sf_dir):
    t = run_sql(spark, sf_dir, BAD).withColumn("bad", F.coalesce("bad", F.lit(False)))
    return ops.firing(t, 7200, ["service"]).select("service", "ts", "state")


@query("SELECT n_nationkey, round(a.avail / b.size, 6) AS ratio FROM nation JOIN (SELECT c_nationkey, sum(c_acctbal) AS avail FROM customer GROUP BY 1) a ON n_nationkey = c_nationkey JOIN (SELECT s_nationkey, sum(abs(s_acctbal)) + 1 AS size FROM supplier GROUP BY 1) b ON n_nationkey = s_nationkey WHERE a.avail / b.size < 15")
def disk_ratio_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("avail"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.sum(F.abs("s_acctbal")) + 1).alias("size"))
    t = table(spark, sf_dir, "nation").select("n_nationkey").join(a, "n_nationkey").join(b, "n_nationkey")
    return t.withColumn("r", F.col("avail") / F.col("size")).filter("r < 15").select("n_nationkey", F.round("r", 6).alias("ratio"))


@query(f"WITH l AS ({L}) SELECT status, service, count(*) AS n FROM l GROUP BY ALL")
def requests_by_status(spark, sf_dir):
    return run_sql(spark, sf_dir, LOG).groupBy("status", "service").agg(F.count("*").alias("n"))


# -- retention -------------------------------------------------------------------------
KEPT = f"SELECT job_id, created_at, CASE WHEN status <> 'FAILED' THEN 'jobs/' || cast(job_id as string) END AS artifact_key FROM ({JOBS})"
R = plain_sql(KEPT)
POLICY_DAYS = retention.Policy(5, 10, 20)


def _now(spark, sf_dir):
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0])


@query(f"WITH j AS ({R}), m AS (SELECT max(created_at) AS now FROM j) SELECT sum(CASE WHEN created_at < now - INTERVAL 5 DAY AND artifact_key IS NOT NULL THEN 1 ELSE 0 END)::bigint AS raw, sum(CASE WHEN created_at < now - INTERVAL 10 DAY THEN 1 ELSE 0 END)::bigint AS derived, sum(CASE WHEN created_at < now - INTERVAL 20 DAY THEN 1 ELSE 0 END)::bigint AS audit FROM j, m")
def retention_candidates(spark, sf_dir):
    return retention.candidates(run_sql(spark, sf_dir, KEPT), _now(spark, sf_dir), POLICY_DAYS)


@query(f"WITH j AS ({R}), m AS (SELECT max(created_at) AS now FROM j) SELECT job_id, CASE WHEN created_at >= now - INTERVAL 5 DAY THEN artifact_key END AS artifact_key FROM j, m WHERE created_at >= now - INTERVAL 10 DAY")
def retention_apply(spark, sf_dir):
    return retention.apply(run_sql(spark, sf_dir, KEPT), _now(spark, sf_dir), POLICY_DAYS).select("job_id", "artifact_key")


@query(f"WITH j AS ({R}), m AS (SELECT max(created_at) AS now FROM j), b AS (SELECT unnest([{', '.join(map(O.q, retention.BUCKETS))}]) AS bucket) SELECT bucket, count(*) AS n, min('jobs/' || cast(job_id as varchar) || '/') AS first_prefix FROM j, m, b WHERE created_at < now - INTERVAL 10 DAY GROUP BY bucket")
def derived_prefix_cross(spark, sf_dir):
    t = retention.prefixes(run_sql(spark, sf_dir, KEPT), _now(spark, sf_dir), POLICY_DAYS)
    return t.groupBy("bucket").agg(F.count("*").alias("n"), F.min("prefix").alias("first_prefix"))
