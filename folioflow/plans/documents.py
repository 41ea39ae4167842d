"""Queries over the document dataflow: normalise, classify, extract, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions import text as X
from folioflow.operators.classify import classify, scores
from folioflow.operators.extract import extract, filled, merge_model_fields
from folioflow.operators.validate import infer_route, validate
from folioflow.plans import oracle as O
from folioflow.sources.tables import CORPUS, corpus, plain_sql, run_sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(corpus(spark, sf_dir))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(classified(spark, sf_dir))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(extracted(spark, sf_dir))


def unrolled(df: DataFrame, values: str, *names: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode a computed column. The outer form keeps Spark from deriving a filter that would repeat the whole expression below."""
    return df.select(*keep, F.explode_outer(values).alias(*names)).filter(F.col(names[0]).isNotNull())


def field(name: str) -> Column:
    return F.element_at("fields", name)


@query(O.VALIDATED + " SELECT route, verdict, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM verdicts GROUP BY route, verdict")
def flagship_route_verdict(spark, sf_dir):
    return validated(spark, sf_dir).groupBy("route", "verdict").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"), F.length(X.collapse(F.col("text"))).cast("long").alias("n"))


AMOUNTS = "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Rp ' || cast(o_custkey % 900 + 100 as string) || '.000' WHEN 1 THEN cast(o_custkey as string) || ',416' WHEN 2 THEN '$1,234.' || cast(10 + o_orderkey % 90 as string) WHEN 3 THEN '1.234,' || cast(10 + o_orderkey % 90 as string) WHEN 4 THEN cast(o_custkey as string) || ',5' WHEN 5 THEN '1.234.5' WHEN 6 THEN 'none' ELSE cast(cast(o_totalprice as decimal(18,2)) as string) END AS raw FROM {orders}"


@query(f"""WITH a AS ({plain_sql(AMOUNTS)}), k AS (SELECT *, regexp_replace(raw, '[^0-9,.\\-]', '', 'g') AS t FROM a),
u AS (SELECT *, CASE WHEN contains(t, ',') AND contains(t, '.') AND length(split_part(t, ',', -1)) < length(split_part(t, '.', -1)) THEN replace(replace(t, '.', ''), ',', '.')
  WHEN contains(t, ',') AND contains(t, '.') THEN replace(t, ',', '') WHEN contains(t, ',') AND length(split_part(t, ',', -1)) = 3 THEN replace(t, ',', '') WHEN contains(t, ',') THEN replace(t, ',', '.')
  WHEN regexp_full_match(t, '[^.]*(\\.[^.]{{3}})+') THEN replace(t, '.', '') ELSE t END AS v FROM k),
d AS (SELECT *, CASE WHEN regexp_full_match(v, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast(v AS double) END AS x FROM u)
SELECT o_orderkey, raw, CASE WHEN v = '' THEN '' WHEN x IS NULL THEN v WHEN x = floor(x) THEN cast(cast(x as bigint) as varchar) ELSE regexp_replace(regexp_replace(printf('%.2f', x), '0+$', ''), '\\.$', '') END AS amount FROM d""")
def norm_amount(spark, sf_dir):
    return run_sql(spark, sf_dir, AMOUNTS).select("o_orderkey", "raw", X.amount(F.col("raw")).alias("amount"))


ROUTE_TEXTS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Invoice' WHEN 1 THEN ' purchase-order ' WHEN 2 THEN 'Bank Statement!' WHEN 3 THEN event_type WHEN 4 THEN '__contract__' ELSE NULL END AS raw FROM {events}"


@query(f"""WITH a AS ({plain_sql(ROUTE_TEXTS)}), b AS (SELECT *, trim(regexp_replace(lower(coalesce(raw, '')), '[^a-z0-9_]+', '_', 'g'), '_') AS s FROM a)
SELECT event_id, CASE WHEN s IN ({', '.join(map(O.q, S.ROUTES))}) THEN s ELSE 'generic' END AS route FROM b""")
def norm_route(spark, sf_dir):
    return run_sql(spark, sf_dir, ROUTE_TEXTS).select("event_id", X.route_name(F.col("raw")).alias("route"))


CASTS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN cast(value as string) WHEN 1 THEN 'x' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL ELSE '1e3' END AS raw FROM {events}"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN coalesce(value, 0) WHEN 4 THEN 1000.0 ELSE 0.0 END::double AS x, CASE WHEN event_id % 5 = 0 AND value IS NULL OR event_id % 5 = 3 THEN '' WHEN event_id % 5 = 0 THEN 'v' WHEN event_id % 5 = 1 THEN 'x' WHEN event_id % 5 = 2 THEN 'NaN' ELSE '1e3' END AS first_of FROM events")
def safe_cast(spark, sf_dir):
    t = run_sql(spark, sf_dir, CASTS)
    shown = F.when((F.col("event_id") % 5 == 0) & F.col("raw").isNotNull(), "v").otherwise(F.col("raw"))
    return t.select("event_id", X.number_or(F.col("raw")).alias("x"), X.first_text(shown, F.lit("  ")).alias("first_of"))


@query(O.CLASSIFIED + " SELECT job_id, route, classification_confidence, matched_signal_count, reason FROM classified")
def classify_documents(spark, sf_dir):
    return classified(spark, sf_dir).select("job_id", "route", "classification_confidence", "matched_signal_count", "reason")


@query(O.CLASSIFIED + " SELECT job_id, route, confidence, signals, threshold FROM cand")
def route_scores_long(spark, sf_dir):
    return scores(corpus(spark, sf_dir))


@query(O.CLASSIFIED + " SELECT job_id, route, confidence FROM best")
def route_argmax(spark, sf_dir):
    order = F.create_map(*(F.lit(x) for k, r in enumerate(S.ROUTE_RULES) for x in (r[0], -k)))
    s = scores(corpus(spark, sf_dir)).withColumn("turn", F.element_at(order, F.col("route")))
    return s.groupBy("job_id").agg(F.max_by("route", F.struct("confidence", "signals", "turn")).alias("route"), F.max("confidence").alias("confidence"))


@query(O.CLASSIFIED + ", b AS (SELECT route, CASE WHEN classification_confidence >= 0.85 THEN 'high' WHEN classification_confidence >= 0.68 THEN 'medium' ELSE 'low' END AS confidence_band, classification_confidence >= 0.68 AND route <> 'generic' AS auto_route FROM classified) SELECT route, confidence_band, auto_route, count(*) AS n FROM b GROUP BY ALL")
def confidence_band(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("route", "confidence_band", "auto_route").agg(F.count("*").alias("n"))


@query(O.CLASSIFIED + " SELECT expected_route, route AS predicted_route, count(*) AS n, round(avg(CASE WHEN expected_route = route THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM classified GROUP BY ALL")
def route_confusion(spark, sf_dir):
    hit = F.when(F.col("expected_route") == F.col("route"), 1.0).otherwise(0.0)
    return classified(spark, sf_dir).groupBy("expected_route", F.col("route").alias("predicted_route")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def _extraction(route: str):
    def run(spark, sf_dir):
        from folioflow.operators.extract import fields_of

        t = corpus(spark, sf_dir).filter(F.col("expected_route") == route).withColumn("fields", fields_of(F.col("text"), route))
        return t.select("job_id", *(field(n).alias(n) for n in S.FIELDS[route]))

    run.__name__ = f"extract_{route}"
    names = ", ".join(f"{O.field_sql(S.PATTERNS[route][n])} AS {n}" for n in S.FIELDS[route])
    query(f"WITH corpus AS ({plain_sql(CORPUS)}) SELECT job_id, {names} FROM corpus WHERE expected_route = {O.q(route)}")(run)


for _route in S.ROUTES:
    _extraction(_route)


@query(O.EXTRACTED + " SELECT job_id, route, (f0 <> '')::int + (f1 <> '')::int + (f2 <> '')::int + (f3 <> '')::int + (f4 <> '')::int AS filled, confidence FROM extracted")
def field_fill_ratio(spark, sf_dir):
    return extracted(spark, sf_dir).select("job_id", "route", filled(F.col("fields")).alias("filled"), "confidence")


@query(O.EXTRACTED + ", long AS (" + " UNION ALL ".join(f"SELECT job_id, {O.name_sql(k)} AS field, CASE WHEN f{k} <> '' THEN cast(printf('%.4f', least(cast(0.99 as double), ocr_confidence * cast(0.75 as double) + cast(0.20 as double) + 0.0)) as double) ELSE 0.0 END AS confidence FROM extracted" for k in range(5)) + ") SELECT field, count(*) AS n, round(sum(confidence), 4) AS total FROM long GROUP BY field")
def field_confidences(spark, sf_dir):
    t = unrolled(extracted(spark, sf_dir), "field_confidences", "field", "confidence")
    return t.groupBy("field").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query(f"WITH corpus AS ({plain_sql(CORPUS)}), f AS (SELECT job_id, {O.field_sql(S.PATTERNS['invoice']['invoice_date'])} AS d, {O.field_sql(S.PATTERNS['invoice']['invoice_number'])} AS n FROM corpus WHERE kind = 0) SELECT job_id, n AS invoice_number, CASE WHEN d = '' THEN 'model date' ELSE d END AS invoice_date FROM f")
def merge_fallback_fields(spark, sf_dir):
    from folioflow.operators.extract import fields_of

    model = F.create_map(F.lit("invoice_date"), F.lit("  model   date"), F.lit("invoice_number"), F.lit("never"))
    t = corpus(spark, sf_dir).filter("kind = 0").withColumn("fields", merge_model_fields(fields_of(F.col("text"), "invoice"), model))
    return t.select("job_id", field("invoice_number").alias("invoice_number"), field("invoice_date").alias("invoice_date"))


@query(O.VALIDATED + " SELECT job_id, resolved_route, verdict, reasons <> '' AS requires_human_review, warnings FROM verdicts")
def validate_rules(spark, sf_dir):
    return validated(spark, sf_dir).select("job_id", "resolved_route", "verdict", "requires_human_review", F.array_join("warnings", "|").alias("warnings"))


@query(O.VALIDATED + ", long AS (SELECT route, unnest(string_split(reasons, '|')) AS reason FROM verdicts WHERE reasons <> '') SELECT route, reason, count(*) AS n FROM long GROUP BY ALL")
def validate_reasons(spark, sf_dir):
    t = unrolled(validated(spark, sf_dir), "reasons", "reason", keep=("route",))
    return t.groupBy("route", "reason").agg(F.count("*").alias("n"))


_RULES = (("required_fields_present", "no_req <> ''", "failed"), ("recommended_fields_present", "no_rec <> ''", "warning"), ("date_format", "bad_date <> ''", "failed"), ("money_format", "bad_money <> ''", "failed"), ("required_field_confidence", "low <> ''", "failed"), ("document_confidence", "confidence < 0.9", "failed"), ("llm_fallback_policy", "false", "failed"))


@query(O.VALIDATED + ", long AS (" + " UNION ALL ".join(f"SELECT {O.q(r)} AS rule, CASE WHEN {t} THEN {O.q(w)} ELSE 'passed' END AS status FROM verdicts" for r, t, w in _RULES) + ") SELECT rule, status, count(*) AS n FROM long GROUP BY ALL")
def rule_results_long(spark, sf_dir):
    return unrolled(validated(spark, sf_dir), "rule_results", "r").groupBy("r.rule", "r.status").agg(F.count("*").alias("n"))


HINTED = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'merchant_name' WHEN 1 THEN 'supplier_name' WHEN 2 THEN 'closing_balance' WHEN 3 THEN 'parties' ELSE 'other' END AS k, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' END AS v, CASE WHEN event_id % 11 = 0 THEN 'Contract' ELSE NULL END AS explicit FROM {events}"


@query(f"WITH a AS ({plain_sql(HINTED)}) SELECT event_id, CASE WHEN explicit IS NOT NULL THEN 'contract' WHEN v = '' THEN 'generic' WHEN k = 'merchant_name' THEN 'receipt' WHEN k = 'supplier_name' THEN 'purchase_order' WHEN k = 'closing_balance' THEN 'bank_statement' WHEN k = 'parties' THEN 'contract' ELSE 'generic' END AS route FROM a")
def infer_route_from_fields(spark, sf_dir):
    t = run_sql(spark, sf_dir, HINTED).withColumn("fields", F.create_map("k", "v"))
    return t.select("event_id", infer_route(F.col("fields"), F.col("explicit")).alias("route"))


@query(O.VALIDATED + " SELECT verdict, order_status, count(*) AS n, cast(sum(total) as double) AS total FROM verdicts GROUP BY ALL")
def verdict_counts(spark, sf_dir):
    return validated(spark, sf_dir).groupBy("verdict", "order_status").agg(F.count("*").alias("n"), F.sum("total").cast("double").alias("total"))


@query(O.VALIDATED + " SELECT job_id, resolved_route, low FROM checked WHERE low <> ''")
def low_confidence_fields(spark, sf_dir):
    t = unrolled(validated(spark, sf_dir), "reasons", "reason", keep=("job_id", "resolved_route"))
    return t.filter(F.col("reason").startswith("low_field_confidence:")).select("job_id", "resolved_route", F.expr("substring(reason, 22)").alias("low"))


@query(O.VALIDATED + " SELECT coalesce(route, 'all') AS route, coalesce(verdict, 'all') AS verdict, count(*) AS n FROM verdicts GROUP BY ROLLUP (route, verdict)")
def rollup_route_verdict(spark, sf_dir):
    t = validated(spark, sf_dir).rollup("route", "verdict").agg(F.count("*").alias("n"))
    return t.select(F.coalesce("route", F.lit("all")).alias("route"), F.coalesce("verdict", F.lit("all")).alias("verdict"), "n")
