"""Queries over stage contracts: results are JSON texts made from events, with every kind of defect in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import contracts as C
from folioflow.plans.register import registry
from folioflow.sources.tables import plain_sql, run_sql, spread_sql

QUERIES, ORACLE_SQL, query = registry()

#: One JSON text a stage and event; the defects follow from the event's number.
STAGE_TEXTS = """SELECT event_id, event_type, user_id,
 '{"job_id":"j' || cast(event_id as string) || '","raw_bucket":' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"  "' ELSE '"raw"' END || ',"raw_key":' || CASE event_id % 7 WHEN 0 THEN '7' ELSE '" k/1 "' END || '}' AS start_json,
 CASE event_id % 9 WHEN 0 THEN '{}' ELSE '{"preprocessed_key":"pp/' || cast(event_id as string) || '"}' END AS preprocess_json,
 '{"ocr_key":' || CASE event_id % 11 WHEN 0 THEN '""' ELSE '"o/' || cast(event_id as string) || '"' END || ',"mean_confidence":' || CASE event_id % 6 WHEN 0 THEN '"0.75"' WHEN 1 THEN '"high"' WHEN 2 THEN 'null' WHEN 3 THEN '[1]' WHEN 4 THEN 'true' ELSE '0.875' END || '}' AS ocr_json,
 CASE event_id % 13 WHEN 0 THEN '{"layout_key":false}' ELSE '{"layout_key":"l/1"}' END AS layout_json,
 '{"route":' || CASE event_id % 8 WHEN 0 THEN 'null' WHEN 1 THEN '" invoice "' ELSE '"receipt"' END || CASE WHEN event_id % 2 = 0 THEN ',"strategy_profile":"p1"' ELSE '' END || '}' AS classification_json,
 '{"extraction_key":"x/1","fields":' || CASE event_id % 10 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN '{"total_amount":" "}' ELSE '{"invoice_number":"n","invoice_date":"2026-01-0' || cast(1 + event_id % 9 as string) || '","total_amount":' || CASE event_id % 3 WHEN 0 THEN '""' WHEN 1 THEN '"5"' ELSE 'null' END || '}' END
   || ',"confidence":' || CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '" .5 "' ELSE '0.5' END || ',"used_vlm_fallback":' || CASE event_id % 5 WHEN 0 THEN '" Yes "' WHEN 1 THEN '"no"' WHEN 2 THEN '"maybe"' WHEN 3 THEN 'true' ELSE 'false' END
   || CASE WHEN event_id % 4 = 0 THEN ',"extraction_bucket":" b ","route":"contract"' WHEN event_id % 4 = 1 THEN ',"extraction_bucket":"","route":3' ELSE '' END || '}' AS extraction_json,
 '{"validation_key":"v/1","verdict":' || CASE event_id % 6 WHEN 0 THEN '""' ELSE '"needs_review"' END || ',"reasons":' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '["a","b"]' WHEN 2 THEN '"a"' WHEN 3 THEN '["a",1]' ELSE '[]' END
   || ',"requires_human_review":' || CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"0"' WHEN 2 THEN '5' ELSE 'false' END || ',"route":"bank"}' AS validation_json
 FROM {events}"""
T = plain_sql(STAGE_TEXTS)


def parsed(spark, sf_dir):
    t = spread_sql(spark, sf_dir, STAGE_TEXTS)
    return t.select("event_id", "event_type", "user_id", *(F.try_parse_json(f"{s}_json").alias(s) for s in ("start", *C.STAGES)))


def tp(col: str, key: str) -> str:
    return f"coalesce(json_type({col}_json, '$.{key}'), 'NULL')"


def s_(col: str, key: str) -> str:
    return f"CASE WHEN {tp(col, key)} = 'VARCHAR' THEN nullif(trim(json_extract_string({col}_json, '$.{key}')), '') END"


def f_(col: str, key: str) -> str:
    x = f"json_extract_string({col}_json, '$.{key}')"
    return f"CASE WHEN {tp(col, key)} IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN cast({x} AS double) WHEN {tp(col, key)} = 'BOOLEAN' THEN CASE WHEN {x} = 'true' THEN 1.0 ELSE 0.0 END WHEN {tp(col, key)} = 'VARCHAR' THEN try_cast(trim({x}) AS double) END"


def b_(col: str, key: str) -> str:
    x = f"lower(trim(json_extract_string({col}_json, '$.{key}')))"
    return f"CASE WHEN {tp(col, key)} = 'BOOLEAN' THEN {x} = 'true' WHEN {tp(col, key)} = 'VARCHAR' THEN CASE WHEN {x} IN ('true', '1', 'yes') THEN true WHEN {x} IN ('false', '0', 'no') THEN false END END"


def d_(col: str, key: str) -> str:
    return f"CASE WHEN {tp(col, key)} = 'OBJECT' THEN cast(json_extract({col}_json, '$.{key}') AS varchar) END"


def no_s(col: str, key: str, stage: str | None = None) -> str:
    return f"CASE WHEN ({s_(col, key)}) IS NULL THEN '{stage or col}: expected non-empty string field ''{key}''' END"


def no_f(col: str, key: str) -> str:
    return f"CASE WHEN {tp(col, key)} = 'NULL' THEN '{col}: missing numeric field ''{key}''' WHEN ({f_(col, key)}) IS NULL THEN '{col}: invalid numeric field ''{key}''' END"


def no_b(col: str, key: str) -> str:
    return f"CASE WHEN ({b_(col, key)}) IS NULL THEN '{col}: invalid boolean field ''{key}''' END"


def no_d(col: str, key: str) -> str:
    return f"CASE WHEN {tp(col, key)} <> 'OBJECT' THEN '{col}: expected object field ''{key}''' END"


LIST_ERROR = "CASE WHEN {t} NOT IN ('NULL', 'ARRAY') THEN 'validation: expected list field ''reasons''' WHEN json_type(validation_json, '$.reasons[1]') NOT IN ('VARCHAR') THEN 'validation: expected ''reasons[1]'' to be string' END".format(t=tp("validation", "reasons"))


def payload_sql(values: dict[str, str], errors: list[str]) -> str:
    return f"WITH t AS ({T}), e AS (SELECT *, coalesce({', '.join(errors)}, NULL) AS error FROM t) SELECT event_id, error, " + ", ".join(f"CASE WHEN error IS NULL THEN {v} END AS {k}" for k, v in values.items()) + " FROM e"


FIELD_TEXT = "'{' || array_to_string(list_transform(list_sort(json_keys(extraction_json, '$.fields')), lambda k: k || '=' || coalesce('\"' || replace(json_extract_string(extraction_json, '$.fields.' || k), ' ', '') || '\"', 'null')), ',') || '}'"


def flat(t, payload):
    return t.select("event_id", payload.alias("p")).select("event_id", "p.*")


@query(payload_sql({"job_id": s_("start", "job_id"), "raw_bucket": s_("start", "raw_bucket"), "raw_key": s_("start", "raw_key")}, [no_s("start", k, "workflow_input") for k in ("job_id", "raw_bucket", "raw_key")]))
def preprocess_payload(spark, sf_dir):
    return flat(parsed(spark, sf_dir), C.preprocess_payload(F.col("start")))


@query(payload_sql({"preprocessed_key": s_("preprocess", "preprocessed_key")}, [no_s("preprocess", "preprocessed_key")]))
def ocr_payload(spark, sf_dir):
    return flat(parsed(spark, sf_dir), C.ocr_payload(F.col("preprocess")))


@query(payload_sql({"preprocessed_key": s_("preprocess", "preprocessed_key"), "ocr_key": s_("ocr", "ocr_key")}, [no_s("preprocess", "preprocessed_key"), no_s("ocr", "ocr_key")]))
def layout_payload(spark, sf_dir):
    return flat(parsed(spark, sf_dir), C.layout_payload(F.col("preprocess"), F.col("ocr")))


@query(payload_sql({"ocr_key": s_("ocr", "ocr_key")}, [no_s("ocr", "ocr_key")]))
def classification_payload(spark, sf_dir):
    return flat(parsed(spark, sf_dir), C.classification_payload(F.col("ocr")))


@query(payload_sql(
    {"ocr_key": s_("ocr", "ocr_key"), "layout_key": s_("layout", "layout_key"), "ocr_confidence": f_("ocr", "mean_confidence"), "route": s_("classification", "route"), "strategy_profile": "json_extract_string(classification_json, '$.strategy_profile')", "extraction_mode": "cast(NULL AS varchar)"},
    [no_s("ocr", "ocr_key"), no_s("layout", "layout_key"), no_s("classification", "route"), no_f("ocr", "mean_confidence")]))
def extraction_payload(spark, sf_dir):
    return flat(parsed(spark, sf_dir), C.extraction_payload(F.col("ocr"), F.col("layout"), F.col("classification")))


@query(payload_sql(
    {"extraction_key": s_("extraction", "extraction_key"), "fields": d_("extraction", "fields"), "confidence": f_("extraction", "confidence"), "used_vlm_fallback": b_("extraction", "used_vlm_fallback"), "extraction_bucket": s_("extraction", "extraction_bucket"), "route": s_("extraction", "route")},
    [no_s("extraction", "extraction_key"), no_d("extraction", "fields"), no_f("extraction", "confidence"), no_b("extraction", "used_vlm_fallback")]).replace("cast(json_extract(extraction_json, '$.fields') AS varchar)", FIELD_TEXT))
def validation_payload(spark, sf_dir):
    t = flat(parsed(spark, sf_dir), C.validation_payload(F.col("extraction")))
    pairs = F.transform(F.array_sort(F.map_entries(F.from_json("fields", "map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.concat(F.lit('"'), e["value"], F.lit('"')), F.lit("null"))))
    return t.withColumn("fields", F.when(F.col("fields").isNotNull(), F.concat(F.lit("{"), F.regexp_replace(F.array_join(pairs, ","), " ", ""), F.lit("}"))))


@query(payload_sql(
    {"reasons": "coalesce(array_to_string(from_json(json_extract(validation_json, '$.reasons'), '[\"VARCHAR\"]'), ','), '')", "confidence": f_("extraction", "confidence"), "extraction_bucket": s_("extraction", "extraction_bucket"), "extraction_key": s_("extraction", "extraction_key"), "route": s_("extraction", "route"), "validation_bucket": "cast(NULL AS varchar)", "validation_key": s_("validation", "validation_key"), "verdict": s_("validation", "verdict")},
    [LIST_ERROR, no_d("extraction", "fields"), no_f("extraction", "confidence")]))
def review_payload(spark, sf_dir):
    t = flat(parsed(spark, sf_dir), C.review_payload(F.col("extraction"), F.col("validation")))
    return t.withColumn("reasons", F.array_join("reasons", ",")).drop("fields")


@query(payload_sql(
    {"approval_status": s_("validation", "verdict"), "extraction_bucket": s_("extraction", "extraction_bucket"), "extraction_key": s_("extraction", "extraction_key"), "validation_bucket": "cast(NULL AS varchar)", "validation_key": s_("validation", "validation_key"), "route": s_("extraction", "route")},
    [no_d("extraction", "fields"), no_s("validation", "verdict")]))
def delivery_payload(spark, sf_dir):
    return flat(parsed(spark, sf_dir), C.delivery_payload(F.col("extraction"), F.col("validation"))).drop("payload")


FIELD_LIST = "json_keys(extraction_json, '$.fields')"


@query(f"""WITH t AS ({T}) SELECT event_id, event_type AS status, coalesce({f_('ocr', 'mean_confidence')}, 0.0) AS ocr_confidence, coalesce({f_('extraction', 'confidence')}, 0.0) AS extraction_confidence,
 coalesce({b_('extraction', 'used_vlm_fallback')}, false) AS used_vlm_fallback, coalesce({b_('validation', 'requires_human_review')}, false) AS requires_human_review, {s_('validation', 'route')} AS route, {s_('validation', 'verdict')} AS validation_verdict,
 CASE WHEN {tp('extraction', 'fields')} = 'OBJECT' THEN len({FIELD_LIST})::int END AS field_count, CASE WHEN {tp('extraction', 'fields')} = 'OBJECT' THEN len(list_filter({FIELD_LIST}, lambda k: trim(coalesce(json_extract_string(extraction_json, '$.fields.' || k), '')) <> ''))::int END AS populated_field_count FROM t""")
def evaluation_payload(spark, sf_dir):
    t = parsed(spark, sf_dir)
    return flat(t, C.evaluation_payload(F.col("event_type"), F.col("ocr"), F.col("extraction"), F.col("validation")))


@query("""SELECT event_id, 'document.' || event_type AS event_type, CASE WHEN event_id % 4 = 0 THEN 'default' ELSE 't' || cast(user_id % 5 AS varchar) END AS tenant_id, event_type AS status, nullif(left(repeat('x', (event_id % 900)::int), 500), '') AS error,
 'document.' || event_type || ':' || CASE WHEN event_id % 4 = 0 THEN 'default' ELSE 't' || cast(user_id % 5 AS varchar) END || ':j' || cast(event_id AS varchar) || ':' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'w' || cast(event_id AS varchar) END AS idempotency_key FROM events""")
def event_payload(spark, sf_dir):
    t = run_sql(spark, sf_dir, "SELECT event_id, 'document.' || event_type AS name, CASE WHEN event_id % 4 = 0 THEN '' ELSE 't' || cast(user_id % 5 as string) END AS tenant, 'j' || cast(event_id as string) AS job, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'w' || cast(event_id as string) END AS workflow, event_type, repeat('x', cast(event_id % 900 as int)) AS why FROM {events}")
    return flat(t, C.event_payload(*(F.col(c) for c in ("name", "tenant", "job", "workflow", "event_type", "why"))))


#: Whole results: now and then a stage is no object, or the result is missing.
RESULT_TEXTS = f"""SELECT event_id, CASE WHEN event_id % 29 = 0 THEN '{{"job_id":"j"}}' ELSE '{{"job_id":"j","result":{{"status":"' || CASE event_id % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN 'pending_human_review' WHEN 2 THEN 'delivered' ELSE 'failed' END || '"'
 || CASE WHEN event_id % 17 = 0 THEN '' ELSE ',"preprocess":' || preprocess_json END || ',"ocr":' || ocr_json || ',"layout":' || CASE WHEN event_id % 19 = 0 THEN '[]' ELSE layout_json END || ',"classification":' || classification_json
 || ',"extraction":' || extraction_json || ',"validation":' || validation_json || CASE event_id % 3 WHEN 0 THEN ',"delivery":{{"delivery_status":"success","delivery_id":"d","delivery_receipt_key":"k"}}' WHEN 1 THEN ',"delivery":{{"delivery_status":"failed"}},"review_task":{{"review_task_id":"r","review_status":" "}}' ELSE '' END || '}}}}' END AS result_json FROM ({STAGE_TEXTS})"""


def _result_sql() -> str:
    j = lambda s, k: f"json_type(result_json, '$.result.{s}.{k}')"
    x = lambda s, k: f"json_extract_string(result_json, '$.result.{s}.{k}')"
    st = "coalesce(json_extract_string(result_json, '$.result.status'), 'unknown')"
    stage = lambda s: f"CASE WHEN coalesce(json_type(result_json, '$.result.{s}'), 'NULL') <> 'OBJECT' THEN 'missing_or_invalid_stage:{s}' END"
    txt = lambda s, k: f"CASE WHEN coalesce({j(s, k)}, 'NULL') <> 'VARCHAR' OR trim({x(s, k)}) = '' THEN '{s}:missing_{k}' END"
    num = lambda s, k: f"CASE WHEN coalesce({j(s, k)}, 'NULL') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'BOOLEAN') THEN '{s}:missing_or_invalid_{k}' END"
    is_ = lambda s, k, t: f"CASE WHEN coalesce({j(s, k)}, 'NULL') <> '{t}' THEN '{s}:missing_{k}' END"
    when = lambda c, e: f"CASE WHEN {st} = '{c}' THEN {e} END"
    lacking = "concat_ws(',', " + ", ".join(f"CASE WHEN trim(coalesce(json_extract_string(result_json, '$.result.extraction.fields.{f}'), '')) = '' THEN '{f}' END" for f in C.INVOICE_FIELDS) + ")"
    stages = [stage(s) for s in C.STAGES]
    checks = [f"CASE WHEN {st} NOT IN ('delivered', 'pending_human_review') THEN 'unexpected_final_status:' || {st} END", *stages, *stages, txt("preprocess", "preprocessed_key"), txt("ocr", "ocr_key"), num("ocr", "mean_confidence"), txt("layout", "layout_key"), txt("classification", "route"), txt("extraction", "extraction_key"), num("extraction", "confidence"), is_("extraction", "fields", "OBJECT"), is_("extraction", "used_vlm_fallback", "BOOLEAN"), txt("validation", "verdict"), is_("validation", "requires_human_review", "BOOLEAN"), when("delivered", stage("delivery")), when("delivered", f"CASE WHEN coalesce({x('delivery', 'delivery_status')}, '') <> 'success' THEN 'delivery:status_not_success' END"), when("delivered", txt("delivery", "delivery_id")), when("delivered", txt("delivery", "delivery_receipt_key")), when("delivered", f"'delivered_with_missing_required_fields:' || nullif({lacking}, '')"), when("pending_human_review", stage("review_task")), when("pending_human_review", txt("review_task", "review_task_id")), when("pending_human_review", txt("review_task", "review_status"))]
    return f"WITH t AS ({plain_sql(RESULT_TEXTS)}) SELECT event_id, CASE WHEN json_type(result_json, '$.result') IS NULL THEN 'missing_result_object' ELSE concat_ws('|', {', '.join(checks)}) END AS errors FROM t"


@query(_result_sql())
def pipeline_result_errors(spark, sf_dir):
    t = spread_sql(spark, sf_dir, RESULT_TEXTS).withColumn("r", F.try_parse_json("result_json"))
    return t.select("event_id", F.array_join(C.result_errors(F.col("r")), "|").alias("errors"))


CALLS = "SELECT event_id, cast(CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 408 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 503 WHEN 6 THEN 422 ELSE 0 END as int) AS status, CASE event_id % 5 WHEN 0 THEN 'ocr: network error calling http://x' WHEN 1 THEN 'downstream HTTP 503' WHEN 2 THEN 'ReadTimeout' WHEN 3 THEN NULL ELSE 'other' END AS error FROM {events}"


@query(f"WITH c AS ({plain_sql(CALLS)}) SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status BETWEEN 400 AND 499 AND status NOT IN (408, 429) THEN 'fatal' WHEN regexp_matches(coalesce(error, ''), 'network error calling|downstream HTTP 5|ReadTimeout|ConnectError') THEN 'ocr_fallback' ELSE 'retry' END AS outcome FROM c")
def stage_call_outcome(spark, sf_dir):
    return run_sql(spark, sf_dir, CALLS).select("event_id", C.retry_class(F.col("status"), F.col("error")).alias("outcome"))


DETAILS = "SELECT event_id, cast(CASE event_id % 6 WHEN 0 THEN 400 WHEN 1 THEN 404 WHEN 2 THEN 413 WHEN 3 THEN 500 WHEN 4 THEN 418 ELSE 429 END as int) AS status, CASE event_id % 5 WHEN 0 THEN '\"Job not found: J-' || cast(event_id as string) || '\"' WHEN 1 THEN '{\"message\":\"bad ' || event_type || '\"}' WHEN 2 THEN '[1,2]' WHEN 3 THEN '\"\"' ELSE '{\"message\":7}' END AS detail FROM {events}"


@query(f"""WITH d AS ({plain_sql(DETAILS)}), p AS (SELECT *, json_type(detail) AS k, json_extract_string(detail, '$') AS s, CASE WHEN json_type(detail, '$.message') = 'VARCHAR' THEN json_extract_string(detail, '$.message') END AS m FROM d),
c AS (SELECT *, CASE WHEN k = 'VARCHAR' THEN left(trim(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '_'), 80) ELSE '' END AS slug FROM p)
SELECT event_id, status, CASE WHEN slug <> '' THEN slug ELSE CASE status WHEN 400 THEN 'bad_request' WHEN 404 THEN 'not_found' WHEN 413 THEN 'payload_too_large' WHEN 429 THEN 'rate_limited' WHEN 500 THEN 'internal_server_error' ELSE 'request_failed' END END AS code,
 coalesce(nullif(CASE WHEN k = 'VARCHAR' THEN s ELSE m END, ''), 'Request failed') AS message, k IN ('OBJECT', 'ARRAY') AS has_details FROM c""")
def error_envelope(spark, sf_dir):
    t = run_sql(spark, sf_dir, DETAILS).withColumn("d", F.try_parse_json("detail"))
    own = F.when(C.kind(F.col("d")) == "string", F.variant_get("d", "$", "string"))
    return t.select("event_id", "status", X.error_code(own, F.col("status")).alias("code"), C.error_message(F.col("d"), F.lit("Request failed")).alias("message"), C.kind(F.col("d")).isin("object", "array").alias("has_details"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'tok-' || cast(event_id AS varchar) WHEN 1 THEN 'tok' WHEN 2 THEN 'tok en' END AS token, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 0 THEN 'exact' ELSE 'lower' END AS api_key FROM events""")
def auth_headers(spark, sf_dir):
    t = run_sql(spark, sf_dir, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Bearer tok-' || cast(event_id as string) WHEN 1 THEN ' bearer  tok ' WHEN 2 THEN 'BEARER tok en' WHEN 3 THEN 'Basic abc' WHEN 4 THEN 'bearer' ELSE NULL END AS auth FROM {events}")
    headers = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("x-api-key"), F.lit("lower"), F.lit("X-API-Key"), F.lit("exact"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("x-api-key"), F.lit("lower"))).otherwise(F.create_map(F.lit("Other"), F.lit("x")))
    return t.select("event_id", C.bearer(F.col("auth")).alias("token"), C.header(headers, "X-API-Key").alias("api_key"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') AND event_id % 4 <> 0 THEN 202 ELSE 422 END AS http_status FROM events")
def source_allow_list(spark, sf_dir):
    t = run_sql(spark, sf_dir, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL ELSE event_type END AS source FROM {events}")
    return t.select("event_id", F.when(F.coalesce(F.col("source").isin("click", "view", "purchase"), F.lit(False)), 202).otherwise(422).alias("http_status"))
