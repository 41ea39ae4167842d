"""Queries over review, delivery, webhook and evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import canonical as J
from folioflow.functions import text as X
from folioflow.operators import contracts as C
from folioflow.operators import outcome
from folioflow.operators import records as R
from folioflow.plans.register import registry
from folioflow.sources.tables import plain_sql, run_sql, spread_sql, table

QUERIES, ORACLE_SQL, query = registry()

#: Requests from events. Two of the values need escapes in JSON.
REQUESTS = """SELECT event_id, event_type, user_id, 'j' || cast(event_id as string) AS job, cast(event_id % 1000 as double) / 1000 AS confidence,
 CASE event_id % 5 WHEN 0 THEN 'low_confidence:0.500|invalid_date_format:a' WHEN 1 THEN 'reject_unusable_extraction' WHEN 2 THEN '' WHEN 3 THEN 'no_match' ELSE 'b|a' END AS reasons,
 CASE event_id % 4 WHEN 0 THEN 'Urgent ' WHEN 1 THEN '' ELSE NULL END AS given, CASE event_id % 3 WHEN 0 THEN 'Café' WHEN 1 THEN 'say "x"' ELSE 'plain' END AS name,
 CASE event_id % 6 WHEN 0 THEN 'auto_approved' WHEN 1 THEN ' Human_Approved ' WHEN 2 THEN 'needs_review' WHEN 3 THEN NULL ELSE 'auto_approved' END AS approval,
 CASE event_id % 7 WHEN 0 THEN ' key ' || cast(event_id % 100 as string) || ' ' WHEN 1 THEN '' ELSE NULL END AS idem FROM {events}"""
Q = plain_sql(REQUESTS)
NAME_JSON = """CASE event_id % 3 WHEN 0 THEN '"Caf\\u00e9"' WHEN 1 THEN '"say \\"x\\""' ELSE '"plain"' END"""
NUM = "CASE WHEN confidence = floor(confidence) THEN cast(confidence::bigint AS varchar) || '.0' ELSE regexp_replace(cast(cast(confidence AS decimal(10,4)) AS varchar), '0+$', '') END"
LISTED = "'[' || array_to_string(list_transform(list_sort(list_filter(string_split(reasons, '|'), lambda x: x <> '')), lambda x: '\"' || x || '\"'), ',') || ']'"


def requests(spark, sf_dir):
    t = run_sql(spark, sf_dir, REQUESTS)
    return t.withColumn("reasons", F.filter(F.split("reasons", r"\|"), lambda x: x != "")).withColumn("fields", F.create_map(F.lit("vendor_name"), F.col("name"), F.lit("currency"), F.lit("EUR")))


@query(f"""WITH q AS ({Q}), b AS (SELECT *, '{{"confidence":' || {NUM} || ',"fields":{{"currency":"EUR","vendor_name":' || {NAME_JSON} || '}},"job_id":"' || job || '","reasons":' || {LISTED} || '}}' AS body FROM q)
SELECT event_id, 'review-' || left(sha256(body), 24) AS review_task_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS route, CASE WHEN event_id % 5 = 1 THEN 'rejected' ELSE 'needs_review' END AS verdict,
 CASE WHEN event_id % 4 = 0 THEN 'urgent' WHEN confidence < 0.5 OR contains(reasons, 'reject_') THEN 'high' WHEN confidence < 0.9 THEN 'medium' ELSE 'normal' END AS priority, round(confidence, 4) AS confidence FROM b""")
def review_tasks(spark, sf_dir):
    route, verdict = F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("event_id") % 5 == 1, "rejected").otherwise("")
    t = requests(spark, sf_dir)
    return t.select("event_id", R.review_record(F.col("job"), route, verdict, F.col("reasons"), F.col("fields"), F.col("confidence"), F.col("given")).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'urgent' WHEN value IS NULL THEN 'normal' WHEN value / 100 < 0.5 THEN 'high' WHEN value / 100 < 0.9 THEN 'medium' ELSE 'normal' END AS priority FROM events")
def review_priority(spark, sf_dir):
    # no confidence is not a low one
    t = table(spark, sf_dir, "events")
    return t.select("event_id", R.review_priority(F.col("value") / 100, F.array().cast("array<string>"), F.when(F.col("event_id") % 5 == 0, " Urgent ")).alias("priority"))


DEST = "CASE event_id % 4 WHEN 0 THEN '[\"webhook\",\"object_storage\"]' WHEN 1 THEN '[\"object_storage\"]' ELSE '[\"webhook\"]' END"
DELIVERY = f"""WITH q AS ({Q}), b AS (SELECT *, CASE WHEN coalesce(idem, '') <> '' THEN trim(idem) ELSE '{{"approval_status":' || coalesce('"' || approval || '"', 'null') || ',"destinations":' || {DEST} || ',"job_id":"' || job || '","payload":{{"currency":"EUR","vendor_name":' || {NAME_JSON} || '}},"webhook_url":""}}' END AS body FROM q),
d AS (SELECT *, 'delivery-' || left(sha256(body), 24) AS delivery_id FROM b), r AS (SELECT DISTINCT delivery_id FROM d WHERE event_id % 9 = 0)"""


@query(DELIVERY + """ SELECT event_id, d.delivery_id, CASE WHEN lower(trim(coalesce(approval, ''))) NOT IN ('auto_approved', 'human_approved') THEN 409 ELSE 200 END AS http_status,
 CASE WHEN lower(trim(coalesce(approval, ''))) NOT IN ('auto_approved', 'human_approved') THEN 'refused' WHEN r.delivery_id IS NOT NULL THEN 'replay' ELSE 'success' END AS outcome, 'jobs/' || job || '/delivery/' || d.delivery_id || '/receipt.json' AS receipt_key FROM d LEFT JOIN r ON d.delivery_id = r.delivery_id""")
def delivery_receipts(spark, sf_dir):
    places = F.when(F.col("event_id") % 4 == 0, " Webhook,object_storage, webhook").when(F.col("event_id") % 4 == 1, " , ").otherwise("WEBHOOK")
    t = requests(spark, sf_dir).withColumn("destinations", R.provider_names(places, "object_storage"))
    t = t.withColumn("delivery_id", R.delivery_id(F.col("idem"), F.col("job"), F.col("fields"), F.col("approval"), F.col("destinations"), F.lit(None).cast("string")))
    receipts = t.select("delivery_id", F.when(F.col("event_id") % 9 == 0, "success").otherwise("failed").alias("status"))
    done = R.answered(t, receipts, "delivery_id", "status")
    ok = outcome.approved(F.col("approval"))
    return done.select("event_id", "delivery_id", F.when(ok, 200).otherwise(409).alias("http_status"), F.when(~ok, "refused").when(F.col("replay"), "replay").otherwise("success").alias("outcome"), R.receipt_key(F.col("job"), "delivery", F.col("delivery_id")).alias("receipt_key"))


SECRET = "folio-demo-secret"
_PADS = ["".join(f"\\x{b ^ m:02X}" for b in SECRET.encode().ljust(64, b"\0")) for m in (0x36, 0x5C)]
EVENTS = f"""WITH q AS ({Q}), b AS (SELECT *, '{{"data":{{"status":"' || event_type || '"}},"event_type":"document.' || event_type || '","job_id":"' || job || '","tenant_id":"t' || cast(user_id % 5 AS varchar) || '","workflow_id":""}}' AS body FROM q)"""


@query(EVENTS + f""" SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'given-' || cast(event_id AS varchar) ELSE 'evt-' || left(sha256(CASE WHEN coalesce(idem, '') <> '' THEN trim(idem) ELSE body END), 24) END AS webhook_event_id,
 sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(body)))) AS signature FROM b""")
def webhook_signatures(spark, sf_dir):
    t = requests(spark, sf_dir)
    kind, tenant = F.concat(F.lit("document."), "event_type"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))
    data, none = F.create_map(F.lit("status"), F.col("event_type")), F.lit(None).cast("string")
    body = J.json_object(data=J.json_map(data), event_type=J.json_text(kind), job_id=J.json_text(F.col("job")), tenant_id=J.json_text(tenant), workflow_id=F.lit('""'))
    given = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit(" given-"), F.col("event_id").cast("string")))
    return t.select("event_id", R.event_id(given, F.col("idem"), kind, tenant, F.col("job"), none, data).alias("webhook_event_id"), R.signature(SECRET, body).alias("signature"))


@query(EVENTS + f""", i AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'given-' || cast(event_id AS varchar) ELSE 'evt-' || left(sha256(CASE WHEN coalesce(idem, '') <> '' THEN trim(idem) ELSE body END), 24) END AS evt FROM b),
v AS (SELECT *, '{{"data":{{"status":"' || event_type || '"}},"event_id":"' || evt || '","event_type":"document.' || event_type || '","job_id":"' || job || '","occurred_at":"2026-01-01T00:00:00+00:00","schema_version":"1.0","tenant_id":"t' || cast(user_id % 5 AS varchar) || '","workflow_id":null}}' AS envelope FROM i)
SELECT event_id, envelope AS body, 'Content-Type=application/json;Idempotency-Key=' || evt || ';X-Doc-Event-Id=' || evt || ';X-Doc-Event-Type=document.' || event_type || ';X-Doc-Job-Id=' || job || ';X-Doc-Signature-256=sha256=' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(envelope)))) || ';X-Doc-Tenant-Id=t' || cast(user_id % 5 AS varchar) AS headers FROM v""")
def webhook_requests(spark, sf_dir):
    """The envelope and the headers of every event, signed over the envelope."""
    t = requests(spark, sf_dir)
    kind, tenant = F.concat(F.lit("document."), "event_type"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))
    data, none = F.create_map(F.lit("status"), F.col("event_type")), F.lit(None).cast("string")
    given = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit(" given-"), F.col("event_id").cast("string")))
    t = t.withColumn("evt", R.event_id(given, F.col("idem"), kind, tenant, F.col("job"), none, data))
    t = t.withColumn("body", R.envelope(F.col("evt"), kind, F.lit("2026-01-01T00:00:00+00:00"), tenant, F.col("job"), none, data))
    sent = F.array_sort(F.map_entries(R.headers(F.col("evt"), kind, tenant, F.col("job"), F.col("body"), SECRET, "X-Doc")))
    return t.select("event_id", "body", F.array_join(F.transform(sent, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))


URLS = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://hooks.example.net/x' WHEN 2 THEN 'HTTP://Hooks.Example.net:8080/' WHEN 3 THEN 'ftp://hooks.example.net/x' WHEN 4 THEN '/relative' ELSE url END AS url, CASE page_id % 3 WHEN 0 THEN ' https://own.example.net/in ' WHEN 1 THEN 'own' ELSE NULL END AS own FROM {pages}"


def _webhook_sql(allowed_requests: bool) -> str:
    first = "CASE WHEN u.url <> '' THEN 'per-request webhook_url is disabled'" if not allowed_requests else "CASE WHEN u.url <> '' AND coalesce(host, '') <> 'hooks.example.net' THEN 'webhook_url host is not allowed'"
    return f"""WITH u AS ({plain_sql(URLS)}), c AS (SELECT *, coalesce(nullif(url, ''), nullif(trim(coalesce(own, '')), '')) AS target FROM u),
u2 AS (SELECT *, lower(regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, nullif(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '') AS host FROM c),
p AS (SELECT *, {first} WHEN target IS NOT NULL AND (scheme NOT IN ('http', 'https') OR host IS NULL) THEN 'webhook_url must be an absolute http(s) URL' END AS problem FROM u2 u)
SELECT page_id, CASE WHEN problem IS NULL THEN target END AS url, problem, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN target IS NULL THEN 'skipped' ELSE 'sent' END AS outcome FROM p"""


def _webhooks(spark, sf_dir, allowed: bool):
    t = run_sql(spark, sf_dir, URLS).select("page_id", R.webhook_target(F.col("url"), F.col("own"), ["hooks.example.net"], allowed).alias("w")).select("page_id", "w.*")
    return t.withColumn("outcome", F.when(F.col("problem").isNotNull(), "refused").when(F.col("url").isNull(), "skipped").otherwise("sent"))


@query(_webhook_sql(True))
def webhook_targets(spark, sf_dir):
    return _webhooks(spark, sf_dir, True)


@query(_webhook_sql(False))
def webhook_targets_of_requests_disabled(spark, sf_dir):
    return _webhooks(spark, sf_dir, False)


SENDS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '200' WHEN 1 THEN '500,204' WHEN 2 THEN '503,,301,200' WHEN 3 THEN ',' ELSE '404' END AS codes FROM {events}"


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'success' ELSE 'failed' END AS status, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS tries,
 CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 4 THEN 404 END AS last_code, cast(CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 WHEN 3 THEN 0.5 ELSE 0.0 END AS double) AS waited FROM events""")
def send_attempts(spark, sf_dir):
    t = run_sql(spark, sf_dir, SENDS).withColumn("codes", F.transform(F.split("codes", ","), lambda c: F.nullif(c, F.lit("")).try_cast("int")))
    return t.select("event_id", R.attempts(F.col("codes"), 2, 0.5).alias("a")).select("event_id", "a.*")


ANSWERS = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{\"task_id\":5,\"id\":6}' WHEN 1 THEN '{\"id\":\"a\"}' WHEN 2 THEN '{\"task_ids\":[9,8]}' WHEN 3 THEN '[{\"task_id\":3}]' WHEN 4 THEN '[{\"id\":4,\"task_id\":3}]' WHEN 5 THEN '[]' ELSE '{\"task_ids\":[]}' END AS answer FROM {events}"


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '5' WHEN 1 THEN 'a' WHEN 2 THEN '9' WHEN 3 THEN '3' WHEN 4 THEN '4' ELSE 'own-' || cast(event_id AS varchar) END AS task, CASE event_id % 4 WHEN 0 THEN 'pat' WHEN 1 THEN 'token' WHEN 2 THEN 'bearer' END AS mode,
 CASE event_id % 3 WHEN 0 THEN 'label_studio' WHEN 1 THEN 'local_queue' ELSE CASE WHEN event_id % 2 = 0 THEN 'label_studio' ELSE 'local_queue' END END AS provider FROM events""")
def review_task_references(spark, sf_dir):
    e = F.col("event_id")
    scheme, token = F.when(e % 4 < 2, "Auto").when(e % 4 == 2, " Bearer ").otherwise("odd"), F.when(e % 4 == 0, "a.b.c").otherwise("a.b")
    chosen = F.when(e % 3 == 0, " Label_Studio").when(e % 3 == 1, "local_queue").otherwise("auto")
    t = run_sql(spark, sf_dir, ANSWERS)
    return t.select("event_id", R.task_reference(F.try_parse_json("answer"), F.concat(F.lit("own-"), e.cast("string"))).alias("task"), R.auth_mode(scheme, token).alias("mode"), R.review_provider(chosen, e % 2 == 0).alias("provider"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_custkey AS n FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS k, min(l_returnflag) AS status, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS job, coalesce(a.status, b.status) AS status, CASE WHEN a.k IS NOT NULL THEN 'primary' ELSE 'secondary' END AS place FROM a FULL JOIN b ON a.k = b.k""")
def receipts_by_place(spark, sf_dir):
    primary = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"))
    secondary = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.min("l_returnflag").alias("status"))
    return R.receipt_of(primary, secondary, "job", ["status"])


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 's3://a' WHEN 1 THEN 's3://b' ELSE '' END AS artifact, CASE event_id % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'success' ELSE 'failed' END AS webhook FROM events""")
def delivery_response(spark, sf_dir):
    one = lambda p, s, a: F.struct(F.lit(p).alias("provider"), F.lit(s).alias("status"), F.lit(a).alias("artifact"))
    e = F.col("event_id") % 3
    results = F.when(e == 0, F.array(one("object_storage", "success", "s3://a"))).when(e == 1, F.array(one("webhook", "success", ""), one("object_storage", "success", "s3://b"), one("object_storage", "success", "s3://c"))).otherwise(F.array(one("webhook", "failed", "")))
    t = table(spark, sf_dir, "events").select("event_id", results.alias("r"))
    return t.select("event_id", F.coalesce(R.result_of(F.col("r"), "object_storage")["artifact"], F.lit("")).alias("artifact"), F.coalesce(R.result_of(F.col("r"), "webhook")["status"], F.lit("skipped")).alias("webhook"))


@query("SELECT event_id, 's3://raw/jobs/' || cast(event_id AS varchar) || '/ocr/ocr.json' AS uri, 'jobs/' || cast(event_id AS varchar) || '/webhooks/e1/receipt.json' AS receipt FROM events")
def object_keys(spark, sf_dir):
    from folioflow.sources.files import object_uri

    job = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", object_uri(F.lit("raw"), F.concat_ws("/", F.lit("jobs"), job, F.lit("ocr/ocr.json"))).alias("uri"), R.receipt_key(job, "webhooks", F.lit("e1")).alias("receipt"))


RUNS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN 'pending_human_review' ELSE 'failed' END AS status, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'x' ELSE cast(cast(event_id % 100 as double) / 100 as string) END AS ocr, cast(cast(event_id % 7 as double) / 10 as string) AS extraction,
 cast(CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 4 END as int) AS fields, cast(CASE event_id % 3 WHEN 0 THEN NULL ELSE event_id % 6 END as int) AS populated FROM {events}"""


@query(f"""WITH r AS ({plain_sql(RUNS)}), c AS (SELECT *, CASE WHEN event_id % 5 < 2 THEN 0.0 ELSE cast(ocr AS double) END AS a, cast(extraction AS double) AS b FROM r),
m AS (SELECT event_id, unnest([struct_pack(k := 'ocr_confidence', v := a), struct_pack(k := 'extraction_confidence', v := b), struct_pack(k := 'confidence_mean', v := CASE WHEN event_id % 2 = 0 THEN 7.0 ELSE round((a + b) / 2, 6) END), struct_pack(k := 'confidence_gap', v := round(abs(a - b), 6)),
 struct_pack(k := 'used_vlm_fallback', v := CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END), struct_pack(k := 'requires_human_review', v := CASE WHEN status = 'pending_human_review' THEN 1.0 ELSE 0.0 END), struct_pack(k := 'outcome_delivered', v := CASE WHEN status = 'delivered' THEN 1.0 ELSE 0.0 END),
 struct_pack(k := 'outcome_pending_human_review', v := CASE WHEN status = 'pending_human_review' THEN 1.0 ELSE 0.0 END), struct_pack(k := 'outcome_failed', v := CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END), struct_pack(k := 'field_count', v := cast(fields AS double)), struct_pack(k := 'populated_field_count', v := cast(populated AS double)),
 struct_pack(k := 'field_completeness', v := CASE WHEN fields > 0 AND populated IS NOT NULL THEN round(least(1.0, populated / cast(fields AS double)), 6) END), struct_pack(k := 'custom', v := CASE WHEN event_id % 2 = 0 THEN 0.0 END)]) AS x FROM c)
SELECT event_id, x.k AS metric, x.v AS value FROM m WHERE x.v IS NOT NULL""")
def evaluation_run_metrics(spark, sf_dir):
    t = spread_sql(spark, sf_dir, RUNS)
    custom = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("confidence_mean"), F.lit("7"), F.lit("custom"), F.lit("inf"))).otherwise(F.create_map().cast("map<string,string>"))
    m = R.evaluation_metrics(F.col("ocr"), F.col("extraction"), F.col("event_id") % 2 == 0, F.col("status") == "pending_human_review", F.col("status"), F.col("fields"), F.col("populated"), custom)
    return t.select("event_id", F.explode(m).alias("metric", "value"))


@query("""SELECT event_id, 'dataset_version=' || CASE WHEN event_id % 2 = 0 THEN 'v2' ELSE 'production' END || ';note=' || CASE WHEN event_id % 3 = 0 THEN 'None' ELSE repeat('n', least(500, (event_id % 700)::int)) END || ';route=' || CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS parameters,
 'evaluation-' || left(sha256(CASE WHEN event_id % 2 = 0 THEN 'k' || cast(event_id AS varchar) ELSE '{"job_id":"j' || cast(event_id AS varchar) || '","route":"' || event_type || '"}' END), 24) AS evaluation_id FROM events""")
def evaluation_parameters(spark, sf_dir):
    e = F.col("event_id")
    t = table(spark, sf_dir, "events")
    defaults = F.create_map(F.lit("route"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("unknown"), F.lit("dataset_version"), F.lit("production"))
    note = F.when(e % 3 != 0, F.repeat(F.lit("n"), (e % 700).cast("int")))
    given = F.when(e % 2 == 0, F.create_map(F.lit("dataset_version"), F.lit("v2"), F.lit("note"), note)).otherwise(F.create_map(F.lit("note"), note))
    shown = F.transform(F.array_sort(F.map_entries(R.run_parameters(defaults, given))), lambda x: F.concat_ws("=", x["key"], x["value"]))
    source = F.when(e % 2 == 0, F.concat(F.lit("k"), e.cast("string"))).otherwise(J.json_object(job_id=J.json_text(F.concat(F.lit("j"), e.cast("string"))), route=J.json_text(F.col("event_type"))))
    return t.select("event_id", F.array_join(shown, ";").alias("parameters"), J.digest("evaluation-", source).alias("evaluation_id"))


@query("SELECT user_id, CASE WHEN sum((event_type <> 'error')::int) = count(*) THEN 'success' WHEN sum((event_type <> 'error')::int) > 0 THEN 'partial_success' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY user_id")
def evaluation_metrics(spark, sf_dir):
    good = F.count_if(F.col("event_type") != "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(R.tracking_status(good, F.count("*")).alias("status"), F.count("*").alias("n"))


@query(r"""SELECT doc_id, '"' || array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) = 10 THEN '\n' WHEN unicode(c) = 9 THEN '\t' WHEN unicode(c) = 13 THEN '\r'
 WHEN unicode(c) < 65536 THEN '\u' || format('{:04x}', unicode(c)) ELSE '\u' || format('{:04x}', 55296 + (unicode(c) - 65536) // 1024) || '\u' || format('{:04x}', 56320 + (unicode(c) - 65536) % 1024) END), '') || '"' AS json FROM documents""")
def canonical_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", J.json_text(F.col("text")).alias("json"))
