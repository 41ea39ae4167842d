"""Queries over benchmark samples, their metrics and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import benchmark as B
from folioflow.plans import analytics as A
from folioflow.plans.register import registry
from folioflow.sources.tables import plain_sql, run_sql, spread_sql

QUERIES, ORACLE_SQL, query = registry()

PRICE = "cast(cast(o_totalprice as decimal(18,2)) as string)"
#: Receipts as JSON: fields under one name or the other, a menu that is a list, an object or missing, lines with blank words.
TRUTH = f"""SELECT o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'r' || cast(o_orderkey as string) END AS id, o_orderkey, {PRICE} AS price,
 '{{"gt_parse":' || CASE WHEN o_orderkey % 17 = 0 THEN '[]' ELSE '{{"total":' || CASE o_orderkey % 4 WHEN 0 THEN '{{"total_price":"' || {PRICE} || '","cashprice":" "}}' WHEN 1 THEN '{{"total":"' || {PRICE} || '","cash_price":"50"}}' ELSE '"x"' END
 || CASE o_orderkey % 5 WHEN 0 THEN ',"total_price":"9.99"' ELSE '' END || ',"sub_total":' || CASE o_orderkey % 3 WHEN 0 THEN '{{"tax_price":"3.000","subtotal_price":"30.000"}}' ELSE '{{}}' END
 || CASE o_orderkey % 6 WHEN 0 THEN ',"menu":[{{"nm":"a"}},{{"nm":"b"}}, "c"]' WHEN 1 THEN ',"menu":{{"nm":"a"}}' WHEN 2 THEN ',"menu":[]' ELSE '' END || '}}' END
 || ',"valid_line":[{{"words":[{{"text":" To"}},{{"text":" "}},{{"text":"tal"}}]}},{{"words":[{{"text":""}}]}},{{"words":[{{"text":"' || {PRICE} || '"}}]}}]}}' AS ground_truth FROM {{orders}}"""
G = plain_sql(TRUTH)
_X = lambda p: f"nullif(trim(coalesce(json_extract_string(ground_truth, '$.gt_parse.{p}'), '')), '')"
FIELDS = {
    "total_amount": f"coalesce({_X('total.total_price')}, {_X('total.total')}, {_X('total_price')})", "tax_amount": f"coalesce({_X('sub_total.tax_price')}, {_X('sub_total.tax')})",
    "subtotal_amount": f"coalesce({_X('sub_total.subtotal_price')}, {_X('sub_total.subtotal')})", "cash_amount": f"coalesce({_X('total.cashprice')}, {_X('total.cash_price')})",
    "line_item_count": "CASE WHEN o_orderkey % 17 <> 0 THEN CASE o_orderkey % 6 WHEN 0 THEN '2' WHEN 1 THEN '1' END END",
}
SHOWN = "concat_ws(';', " + ", ".join(f"'{k}=' || {v}" for k, v in sorted(FIELDS.items())) + ")"


@query(f"""WITH g AS ({G}) SELECT position, {SHOWN} AS fields, 'To tal' || chr(10) || price AS text FROM g""")
def receipt_truth(spark, sf_dir):
    t = run_sql(spark, sf_dir, TRUTH).withColumn("t", F.try_parse_json("ground_truth"))
    from folioflow.operators import contracts as C

    shown = F.transform(F.array_sort(F.map_entries(B.receipt_fields(C.part(F.col("t"), "gt_parse")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.select("position", F.array_join(shown, ";").alias("fields"), B.receipt_text(F.col("t")).alias("text"))


@query(f"""WITH g AS ({G}), s AS (SELECT *, row_number() OVER (ORDER BY position) - 1 AS k FROM g QUALIFY k >= 20 AND k < 220) SELECT coalesce(nullif(id, ''), 'test-' || cast(k AS varchar)) AS sample_id, 'receipt' AS expected_route, {SHOWN} AS fields, CASE WHEN position % 17 = 0 THEN 'ground_truth is missing gt_parse object' END AS error FROM s""")
def receipt_samples(spark, sf_dir):
    t = B.receipts(run_sql(spark, sf_dir, TRUTH), "test", 20, 200)
    shown = F.transform(F.array_sort(F.map_entries("expected_fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.select("sample_id", "expected_route", F.array_join(shown, ";").alias("fields"), "error")


#: Samples with their answers: routes come from three stages, verdicts may be expected or not.
ANSWERS = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'invoice' ELSE 'receipt' END AS expected_route, CASE event_id % 4 WHEN 0 THEN 'auto_approved' WHEN 1 THEN ' ' ELSE NULL END AS expected_verdict, CASE event_id % 5 WHEN 0 THEN '' ELSE 'Total amount 12 due' END AS expected_text,
 'COMPLETED' AS runtime_status, CASE WHEN event_id % 31 = 0 THEN '{"error":"x"}' ELSE '{"result":{"extraction":{' || CASE event_id % 4 WHEN 0 THEN '"route":"receipt",' ELSE '' END || '"confidence":' || CASE event_id % 6 WHEN 0 THEN '"bad"' ELSE '0.75' END
 || ',"fields":' || CASE event_id % 7 WHEN 0 THEN '[]' ELSE '{"total_amount":"' || CASE event_id % 2 WHEN 0 THEN '33,000' ELSE '$7' END || '","merchant_name":' || CASE event_id % 3 WHEN 0 THEN '" ACME  cafe"' ELSE 'null' END || '}' END
 || '},"validation":{"verdict":"' || CASE event_id % 5 WHEN 0 THEN 'auto_approved' ELSE 'needs_review' END || '","requires_human_review":' || CASE event_id % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN '0' ELSE '"yes"' END || CASE event_id % 5 WHEN 1 THEN ',"route":"invoice"' ELSE '' END
 || '},"classification":{"route":"' || CASE event_id % 3 WHEN 1 THEN 'receipt' ELSE '' END || '"},"ocr":{"mean_confidence":0.5,"full_text":"total amont 12 now"}}}' END AS answer_json FROM {events}"""
SCORED = f"""WITH a AS ({plain_sql(ANSWERS)}), f AS (SELECT *, event_id % 31 = 0 AS none, event_id % 31 <> 0 AND event_id % 7 <> 0 AS has FROM a),
c AS (SELECT *, CASE WHEN has AND event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN has AND event_id % 3 = 0 THEN 1 ELSE 0 END AS correct, CASE WHEN has THEN 1 ELSE 0 END + CASE WHEN has AND event_id % 3 = 0 THEN 1 ELSE 0 END AS present FROM f),
p AS (SELECT *, CASE WHEN present > 0 THEN correct / cast(present AS double) ELSE 0.0 END AS p, correct / cast(2 AS double) AS r FROM c), s AS (SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p),
v AS (SELECT *, CASE WHEN none THEN 'unknown' WHEN event_id % 4 = 0 THEN 'receipt' WHEN event_id % 5 = 1 THEN 'invoice' WHEN event_id % 3 = 1 THEN 'receipt' ELSE 'unknown' END AS predicted_route, CASE WHEN none THEN 'unknown' WHEN event_id % 5 = 0 THEN 'auto_approved' ELSE 'needs_review' END AS verdict, NOT none AND event_id % 4 IN (1, 3) AS review FROM s)"""


@query(SCORED + """ SELECT event_id, predicted_route, predicted_route = expected_route AS route_match, f1 AS field_f1, CASE WHEN none OR event_id % 6 = 0 THEN 0.0 ELSE cast(0.75 AS double) END AS extraction_confidence, CASE WHEN none THEN 0.0 ELSE cast(0.5 AS double) END AS ocr_confidence,
 CASE WHEN expected_text = '' THEN NULL WHEN none THEN 1.0 ELSE round(4 / cast(19 AS double), 6) END AS ocr_cer, CASE WHEN expected_text = '' THEN NULL WHEN none THEN 1.0 ELSE cast(0.5 AS double) END AS ocr_wer, review AS requires_review,
 CASE WHEN event_id % 4 = 0 THEN 'explicit_verdict' ELSE 'field_correctness' END AS expectation, CASE WHEN event_id % 4 = 0 THEN verdict = 'auto_approved' ELSE review = (f1 < 1) END AS validation_correct, event_id % 10 <> 0 AS contract_passed FROM v""")
def sample_metrics(spark, sf_dir):
    t = spread_sql(spark, sf_dir, ANSWERS).withColumn("answer", F.try_parse_json("answer_json")).withColumn("expected_fields", F.create_map(F.lit("total_amount"), F.lit("33.000"), F.lit("merchant_name"), F.lit("Acme Cafe"), F.lit("line_item_count"), F.lit("2")))
    t = t.withColumn("errors", F.when(F.col("event_id") % 10 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")))
    m = B.sample_metrics(t.drop("answer_json"))
    return m.select("event_id", "predicted_route", "route_match", "field_f1", "extraction_confidence", "ocr_confidence", "ocr_cer", "ocr_wer", "requires_review", "expectation", "validation_correct", "contract_passed")


@query(SCORED + " SELECT expected_route, count(*) AS n, round(avg(CASE WHEN event_id % 4 = 0 THEN (verdict = 'auto_approved')::int ELSE (review = (f1 < 1))::int END), 6) AS accuracy FROM v GROUP BY expected_route")
def validation_accuracy(spark, sf_dir):
    m = sample_metrics(spark, sf_dir).join(run_sql(spark, sf_dir, ANSWERS).select("event_id", "expected_route"), "event_id")
    return m.groupBy("expected_route").agg(F.count("*").alias("n"), F.round(F.avg(F.col("validation_correct").cast("int")), 6).alias("accuracy"))


#: A threshold an event: given, from a file, from both, from neither; some are no numbers or out of bounds.
LIMITS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'min_sample_count' WHEN 1 THEN 'min_completion_rate' WHEN 2 THEN 'min_route_accuracy' WHEN 3 THEN 'min_field_f1' WHEN 4 THEN 'max_ocr_cer' WHEN 5 THEN 'max_p95_latency_seconds' ELSE 'max_ocr_wer' END AS name,
 CASE WHEN event_id % 3 = 0 THEN cast(user_id % 5 - 1 as string) WHEN event_id % 11 = 1 THEN '0.5' END AS given, CASE event_id % 4 WHEN 0 THEN cast(user_id % 4 as string) WHEN 1 THEN 'x' || event_type WHEN 2 THEN '0.25' END AS from_file FROM {events}"""


@query(f"""WITH t AS (SELECT *, coalesce(try_cast(given AS double), try_cast(from_file AS double)) AS v FROM ({plain_sql(LIMITS)})),
e AS (SELECT *, CASE WHEN from_file IS NOT NULL AND try_cast(from_file AS double) IS NULL THEN 'threshold ' || name || ' must be numeric' WHEN (contains(name, 'rate') OR contains(name, 'accuracy') OR contains(name, 'f1')) AND NOT v BETWEEN 0 AND 1 THEN name || ' must be between 0 and 1' WHEN v < 0 THEN name || ' must be zero or greater' END AS error FROM t)
SELECT event_id, name, CASE WHEN error IS NULL THEN CASE WHEN name = 'min_sample_count' THEN CASE WHEN v IS NULL OR v < 1 THEN 1.0 ELSE floor(v) END ELSE v END END AS value, error FROM e""")
def gate_thresholds(spark, sf_dir):
    return B.thresholds(run_sql(spark, sf_dir, LIMITS))


@query(f"WITH a AS ({A.AGG}) SELECT metric, value FROM (UNPIVOT (SELECT * EXCLUDE (sample_count) FROM a) ON COLUMNS(*) INTO NAME metric VALUE value) WHERE value IS NOT NULL")
def aggregate_evaluation(spark, sf_dir):
    return B.custom_metrics(A._aggregate(spark, sf_dir))


RUN = "SELECT event_id AS index, CASE WHEN event_type = 'error' THEN repeat('e', cast(event_id % 800 as int)) END AS error, CASE WHEN event_id % 6 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, value AS latency FROM {events}"
_RUN = plain_sql(RUN).replace("AS index", 'AS "index"')


@query(f"SELECT \"index\", CASE WHEN error IS NOT NULL THEN 'error' ELSE 'metrics' END AS kind, left(error, 500) AS error, status, latency FROM ({_RUN})")
def run_outcomes(spark, sf_dir):
    return B.outcomes(run_sql(spark, sf_dir, RUN))


@query(f"SELECT kind, status, count(*) AS n, count(latency) AS timed FROM (SELECT CASE WHEN error IS NOT NULL THEN 'error' ELSE 'metrics' END AS kind, 'DRY_RUN' AS status, cast(NULL AS double) AS latency FROM ({_RUN})) GROUP BY ALL")
def dry_run_outcomes(spark, sf_dir):
    return B.outcomes(run_sql(spark, sf_dir, RUN), dry_run=True).groupBy("kind", "status").agg(F.count("*").alias("n"), F.count("latency").alias("timed"))
