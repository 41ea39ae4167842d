"""Queries over release checks, page images, object sinks and small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import pixels as P
from folioflow.operators import skew as SK
from folioflow.operators import preflight as PF
from folioflow.operators import records as R
from folioflow.plans.register import registry
from folioflow.sources import files
from folioflow.sources.tables import plain_sql, run_sql, spread, table

QUERIES, ORACLE_SQL, query = registry()

LONG = "0123456789abcdef0123456789abcdef"
#: A configuration without fault.
GOOD = {
    "ENVIRONMENT": "Production", "PUBLIC_BASE_URL": "https://docs.acme.net", "POSTGRES_PASSWORD": LONG, "S3_ACCESS_KEY": "AKXY", "S3_SECRET_KEY": LONG, "GATEWAY_HTTPS_HOST_PORT": "443", "INGESTION_REQUIRE_AUTH": "true",
    "INGESTION_API_KEYS": f"{LONG}:t1,{LONG}x:t2", "LABEL_STUDIO_PASSWORD": LONG, "GRAFANA_ADMIN_PASSWORD": LONG, "INGESTION_KEYS_ROTATED_AT": "2026-05-01T00:00:00Z", "DATABASE_CREDENTIALS_ROTATED_AT": "2026-05-20T10:00:00+00:00",
    "CREDENTIAL_MAX_AGE_DAYS": "90", "RAW_ARTIFACT_RETENTION_DAYS": "30", "DERIVED_ARTIFACT_RETENTION_DAYS": "90", "AUDIT_RETENTION_DAYS": "365", "BACKUP_RETENTION_DAYS": "14", "BACKUP_ENCRYPTION_ENABLED": "Yes",
    "BACKUP_ENCRYPTION_KEY": LONG, "INFRASTRUCTURE_PROFILE": "dedicated-persistent", "OCR_BACKEND": "Tesseract", "LABEL_STUDIO_AUTH_SCHEME": "PAT",
}
NOW = "timestamp'2026-06-01 00:00:00'"
#: One change a configuration (by its number modulo the length) and all that is then wrong, written down by hand.
CHANGES: list[tuple[str, str | None, list[str]]] = [
    ("ENVIRONMENT", "Production", []),
    ("PUBLIC_BASE_URL", "http://docs.example.com", ["PUBLIC_BASE_URL must be set to the real production URL", "PUBLIC_BASE_URL must use https in production"]),
    ("ENVIRONMENT", None, ["ENVIRONMENT is required", "ENVIRONMENT must be production"]),
    ("INGESTION_REQUIRE_AUTH", " Off ", ["INGESTION_REQUIRE_AUTH must be true in production"]),
    ("POSTGRES_PASSWORD", "changeme", ["POSTGRES_PASSWORD still looks like a development default or placeholder", "POSTGRES_PASSWORD should be at least 24 characters"]),
    ("S3_SECRET_KEY", "short", ["S3_SECRET_KEY should be at least 24 characters"]),
    ("INGESTION_API_KEYS", f"abc:t1,{LONG}:,nokey,{LONG}:t3", ["INGESTION_API_KEYS must use high-entropy keys of at least 24 characters", "INGESTION_API_KEYS entries must include a tenant id", "INGESTION_API_KEYS entries must use api-key:tenant-id format", "INGESTION_API_KEYS must not contain duplicate API keys"]),
    ("DELIVERY_WEBHOOK_REQUIRE_SIGNATURE", "no", ["DELIVERY_WEBHOOK_REQUIRE_SIGNATURE should stay true in production"]),
    ("DELIVERY_ALLOW_REQUEST_WEBHOOK_URL", "True", ["DELIVERY_ALLOW_REQUEST_WEBHOOK_URL should stay false unless SSRF controls are reviewed"]),
    ("EXTRACTION_ENABLE_VLM_FALLBACK", "true", ["VLLM_API_KEY must be a real secret when EXTRACTION_ENABLE_VLM_FALLBACK=true"]),
    ("METRICS_BIND", "0.0.0.0", ["METRICS_BIND=0.0.0.0 exposes the service directly; put it behind a reverse proxy or private interface"]),
    ("INGESTION_BIND", "0.0.0.0", ["INGESTION_BIND=0.0.0.0 exposes the service directly; put it behind a reverse proxy or private interface", "INGESTION_BIND should stay on 127.0.0.1 in production; expose the API through the gateway"]),
    ("GATEWAY_HTTP_BIND", "0.0.0.0", ["GATEWAY_HTTP_BIND should stay on 127.0.0.1 unless HTTP is intentionally exposed"]),
    ("GATEWAY_HTTPS_BIND", "0.0.0.0", []),
    ("CREDENTIAL_MAX_AGE_DAYS", "0", ["CREDENTIAL_MAX_AGE_DAYS must be a positive integer"]),
    ("CREDENTIAL_MAX_AGE_DAYS", "20", ["INGESTION_KEYS_ROTATED_AT is older than CREDENTIAL_MAX_AGE_DAYS=20"]),
    ("INGESTION_KEYS_ROTATED_AT", "yesterday", ["INGESTION_KEYS_ROTATED_AT must be an ISO-8601 timestamp"]),
    ("DATABASE_CREDENTIALS_ROTATED_AT", "2026-06-03T00:00:01Z", ["DATABASE_CREDENTIALS_ROTATED_AT cannot be in the future"]),
    ("DERIVED_ARTIFACT_RETENTION_DAYS", "29", ["DERIVED_ARTIFACT_RETENTION_DAYS must be at least RAW_ARTIFACT_RETENTION_DAYS"]),
    ("AUDIT_RETENTION_DAYS", "60", ["AUDIT_RETENTION_DAYS must be at least DERIVED_ARTIFACT_RETENTION_DAYS"]),
    ("BACKUP_RETENTION_DAYS", "x", ["BACKUP_RETENTION_DAYS must be a positive integer"]),
    ("BACKUP_ENCRYPTION_ENABLED", "false", ["BACKUP_ENCRYPTION_ENABLED must be true"]),
    ("BACKUP_ENCRYPTION_KEY", "0123", ["BACKUP_ENCRYPTION_KEY must contain at least 32 characters"]),
    ("OCR_FORCE_FALLBACK", "on", ["OCR_FORCE_FALLBACK must be false"]),
    ("INFRASTRUCTURE_PROFILE", "shared", ["INFRASTRUCTURE_PROFILE must be dedicated-persistent in production"]),
    ("REVIEW_FALLBACK_TO_LOCAL_QUEUE", "1", ["REVIEW_FALLBACK_TO_LOCAL_QUEUE must be false in production"]),
    ("LABEL_STUDIO_AUTH_SCHEME", "token", ["LABEL_STUDIO_AUTH_SCHEME must be pat or bearer in production"]),
    ("LABEL_STUDIO_ENABLE_LEGACY_API_TOKEN", "true", ["LABEL_STUDIO_ENABLE_LEGACY_API_TOKEN must be false in production"]),
    ("ORCHESTRATOR_ENABLE_OCR_NETWORK_FALLBACK", "true", ["ORCHESTRATOR_ENABLE_OCR_NETWORK_FALLBACK must be false in production"]),
    ("OCR_BACKEND", "paddle", ["OCR_BACKEND must match the currently published and benchmarked tesseract release profile"]),
    ("LABEL_STUDIO_TOKEN", "dev-token", ["LABEL_STUDIO_TOKEN still looks like a development default or placeholder"]),
]


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in v) + ")" for v in values)


@query(f"SELECT c_custkey AS config, failure FROM customer JOIN (VALUES {_rows([(k, f) for k, (_, _, said) in enumerate(CHANGES) for f in said])}) v(k, failure) ON c_custkey % {len(CHANGES)} = k")
def preflight_failures(spark, sf_dir):
    k = F.col("c_custkey") % len(CHANGES)
    names, values = F.array(*(F.lit(n) for n, *_ in CHANGES)), F.array(*(F.lit(v).cast("string") for _, v, _ in CHANGES))
    t = spread(table(spark, sf_dir, "customer")).select("c_custkey", F.element_at(names, (k + 1).cast("int")).alias("_n"), F.element_at(values, (k + 1).cast("int")).alias("_v"))
    good = F.map_filter(F.create_map(*(F.lit(x) for kv in GOOD.items() for x in kv)), lambda n, v: n != F.col("_n"))
    settings = F.when(F.col("_v").isNull(), good).otherwise(F.map_concat(good, F.create_map("_n", "_v")))
    t = t.select(F.col("c_custkey").alias("config"), settings.alias("settings"))
    return t.select("config", F.explode(PF.failures(F.col("settings"), F.expr(NOW))).alias("failure"))


SHA = "a" * 40
#: One change of the evidence a release, and what is then wrong.
EVIDENCE = [
    ({}, []),
    ({"sha": "A" * 40, "pipeline_version": "A" * 40}, ["expected release SHA must contain exactly 40 lowercase hexadecimal characters"]),
    ({"pipeline_version": "b" * 40}, ["benchmark pipeline_version does not match the requested release SHA"]),
    ({"policy_status": "bootstrap"}, ["release acceptance policy status must be approved"]),
    ({"gate_enabled": False}, ["benchmark quality gate was not enabled"]),
    ({"gate_passed": False, "summary_passed": False}, ["benchmark quality gate did not pass", "benchmark summary does not report a passing quality gate"]),
    ({"error_count": 2}, ["benchmark summary contains execution errors"]),
    ({"sample_count": 19}, ["benchmark sample_count=19 is below required 20"]),
    ({"no_policy": "max_ocr_cer"}, ["release acceptance policy is missing max_ocr_cer"]),
    ({"no_check": "route_accuracy"}, ["benchmark gate is missing route_accuracy"]),
    ({"other": "field_f1_mean"}, ["benchmark threshold for field_f1_mean does not match the approved policy"]),
    ({"failed": "human_review_rate"}, ["benchmark check failed: human_review_rate"]),
]


@query(f"SELECT c_custkey AS release, failure FROM customer JOIN (VALUES {_rows([(k, f) for k, (_, said) in enumerate(EVIDENCE) for f in said])}) v(k, failure) ON c_custkey % {len(EVIDENCE)} = k")
def promotion_failures(spark, sf_dir):
    k = F.col("c_custkey") % len(EVIDENCE)

    def column(name: str, default, kind: str):
        return F.element_at(F.array(*(F.lit(change.get(name, default)).cast(kind) for change, _ in EVIDENCE)), (k + 1).cast("int")).alias(name)

    limits = {n: (20.0 if n == "min_sample_count" else 0.5) for n in PF.POLICY_METRICS}
    named = lambda x: column(x, "", "string")
    policy = F.map_filter(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), lambda n, v: n != named("no_policy"))
    checks = [(F.lit(m), F.struct((F.lit(limits[n]) + F.when(named("other") == m, 1.0).otherwise(0.0)).alias("threshold"), (named("failed") != m).alias("passed"))) for n, m in PF.POLICY_METRICS.items()]
    kept = F.map_filter(F.create_map(*(x for c in checks for x in c)), lambda n, v: n != named("no_check"))
    t = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("release"), column("sha", SHA, "string"), column("pipeline_version", SHA, "string"), column("policy_status", "approved", "string"), column("gate_enabled", True, "boolean"), column("gate_passed", True, "boolean"),
        column("summary_passed", True, "boolean"), column("error_count", 0, "int"), column("sample_count", 25, "int"), policy.alias("policy"), kept.alias("checks"))
    return t.select("release", F.explode(PF.evidence_failures(t)).alias("failure"))


# -- page images ------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, greatest(0, least(255, floor(cast(0.114 AS double) * (l_partkey % 300) + cast(0.587 AS double) * (l_suppkey % 256) + cast(0.299 AS double) * (l_quantity * 5))))::int AS gray, CASE l_linenumber % 4 WHEN 1 THEN 'repeat' WHEN 3 THEN 'keep' WHEN 0 THEN 'drop_alpha' END AS channels FROM lineitem")
def gray_pixels(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.gray(F.col("l_partkey") % 300, F.col("l_suppkey") % 256, F.col("l_quantity") * 5).alias("gray"), P.channels(F.when(n == 0, 4).when(n == 2, 2).otherwise(n)).alias("channels"))


@query("""WITH p AS (SELECT l_orderkey, (400 + l_partkey % 4000)::int AS w, (300 + l_suppkey * 31)::int AS h, l_discount * 1800 - 90 AS angle, (l_quantity * 3)::int AS n FROM lineitem), s AS (SELECT *, CASE WHEN greatest(w, h) > 2200 THEN 2200 / cast(greatest(w, h) AS double) ELSE 1.0 END AS scale, CASE WHEN angle < -45 THEN angle + 90 WHEN angle > 45 THEN angle - 90 ELSE angle END AS turn FROM p)
SELECT l_orderkey, CASE WHEN scale < 1 THEN greatest(1, round_even(w * scale, 0))::int ELSE w END AS width, CASE WHEN scale < 1 THEN greatest(1, round_even(h * scale, 0))::int ELSE h END AS height, round(scale, 6) AS scale, round(CASE WHEN n < 64 OR abs(turn) > 15 THEN 0.0 ELSE turn END, 4) AS turn,
 concat_ws(',', CASE WHEN scale = 1 THEN 'resize_skipped' ELSE 'resize' END, 'grayscale', 'denoise', 'clahe', CASE WHEN n < 64 OR abs(turn) > 15 OR abs(turn) <= 0.25 THEN 'deskew_skipped' ELSE 'deskew' END, 'adaptive_threshold', 'median_blur') AS steps FROM s""")
def page_geometry(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", P.resized((400 + F.col("l_partkey") % 4000).cast("int"), (300 + F.col("l_suppkey") * 31).cast("int")).alias("r"), P.correction(F.col("l_discount") * 1800 - 90, (F.col("l_quantity") * 3).cast("int")).alias("turn"))
    return t.select("l_orderkey", "r.width", "r.height", "r.scale", F.round("turn", 4).alias("turn"), F.array_join(P.steps(F.col("r.scale"), True, F.col("turn"), True, 3), ",").alias("steps"))


@query("""WITH v AS (SELECT l_orderkey AS k, ((l_partkey * 7 + l_suppkey) % 256)::int AS x FROM lineitem), h AS (SELECT k, x, count(*) AS c FROM v GROUP BY ALL), t AS (SELECT k, count(*) AS n, sum(x)::double AS total FROM v GROUP BY k),
c AS (SELECT h.k, h.x, t.n, t.total, sum(c) OVER w AS low, sum(c * x) OVER w AS mass FROM h JOIN t ON h.k = t.k WINDOW w AS (PARTITION BY h.k ORDER BY x ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN n > low THEN low * (n - low) * pow(mass / cast(low AS double) - (total - mass) / (n - low), 2) ELSE 0.0 END AS spread FROM c), b AS (SELECT k, max(spread) AS best FROM s GROUP BY k)
SELECT s.k AS job_id, CASE WHEN max(best) <= 1e-9 THEN 0 ELSE min(x) FILTER (spread >= best - 1e-9) END::int AS threshold, max(n)::int AS pixels FROM s JOIN b ON s.k = b.k GROUP BY s.k""")
def otsu_thresholds(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.collect_list(((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 256).cast("int")).alias("v"))
    return t.select("job_id", P.otsu(F.col("v")).alias("threshold"), F.size("v").alias("pixels"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unsupported_format' WHEN event_id % 3 <> 0 THEN 'processed' WHEN event_id % 2 = 0 THEN 'fallback_original_image' ELSE 'preprocess_and_encode_failed' END AS outcome,
 'jobs/' || cast(event_id AS varchar) || CASE WHEN event_id % 5 <> 0 AND (event_id % 3 <> 0 OR event_id % 2 = 0) THEN '/preprocessed/page-0001.png' ELSE '/preprocessed/source.bin' END AS key, CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN left('bad shape' || repeat('!', (event_id % 400)::int), 200) END AS reason FROM events""")
def preprocess_outcomes(spark, sf_dir):
    e = F.col("event_id")
    why = F.when(e % 3 == 0, F.concat(F.lit("bad\nshape"), F.repeat(F.lit("!"), (e % 400).cast("int"))))
    return table(spark, sf_dir, "events").select("event_id", P.preprocessed(e.cast("string"), e % 5 != 0, why, e % 2 == 0).alias("p")).select("event_id", "p.*")


#: The outline of a box of 1200 by 300 pixels a customer, turned by a whole number of degrees; the last side is left open for some.
OUTLINE = """SELECT page, cast(round(600 + u * cos(radians(degree)) - v * sin(radians(degree))) as int) AS x, cast(round(600 + u * sin(radians(degree)) + v * cos(radians(degree))) as int) AS y
 FROM (SELECT page, degree, CASE side WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 0 ELSE 1200 END AS u, CASE side WHEN 0 THEN 0 WHEN 1 THEN 300 ELSE least(k, 300) END AS v
  FROM (SELECT c_custkey AS page, c_custkey % 25 - 12 AS degree, explode(sequence(0, 1200, 2)) AS k FROM {customer}) LATERAL VIEW explode(array(0, 1, 2, 3)) s AS side)"""


@query("SELECT c_custkey AS page, (c_custkey % 25 - 12)::double AS degrees, CASE WHEN abs(c_custkey % 25 - 12) > 10 THEN 0.0 ELSE (c_custkey % 25 - 12)::double END AS turn FROM customer")
def skew_angles(spark, sf_dir):
    """The skew of planted boxes, measured on their pixels, and the turn that follows from it."""
    t = SK.angles(run_sql(spark, sf_dir, OUTLINE, customer=spread(table(spark, sf_dir, "customer"))), "page")
    degrees = F.when(F.col("angle") > 45, F.col("angle") - 90).otherwise(F.col("angle"))
    turn = P.correction(F.col("angle"), F.col("pixels"), most=10.5)
    return t.select("page", (F.round(degrees) + 0.0).alias("degrees"), (F.round(turn) + 0.0).alias("turn"))


# -- objects and small helpers --------------------------------------------------------------
@query("SELECT c_custkey AS job, 'jobs/' || cast(c_custkey AS varchar) || '/delivery/payload.json' AS key, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def json_objects_round_trip(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    job = F.col("c_custkey").cast("string")
    docs = t.select(F.concat_ws("/", F.lit("jobs"), job, F.lit("delivery/payload.json")).alias("key"), F.to_json(F.struct(F.col("c_custkey").alias("job"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))).alias("body"))
    path = f"{files.scratch(spark)}/objects-{uuid.uuid4().hex}"
    files.put_json(docs, path)
    back = files.get_json(spark, path, "job long, segment string, balance double")
    return back.select("value.job", "key", "value.segment", "value.balance")


@query("SELECT event_id, 'webhook,object_storage' AS providers, CASE WHEN event_id % 2 = 0 THEN greatest(3, event_id % 9) + 1 - greatest(3, event_id % 9) % 2 ELSE greatest(3, event_id % 9) + CASE WHEN greatest(3, event_id % 9) % 2 = 0 THEN 1 ELSE 0 END END AS block, '***' AS api_key, event_type AS tenant FROM events".replace("CASE WHEN event_id % 2 = 0 THEN greatest(3, event_id % 9) + 1 - greatest(3, event_id % 9) % 2 ELSE greatest(3, event_id % 9) + CASE WHEN greatest(3, event_id % 9) % 2 = 0 THEN 1 ELSE 0 END END", "greatest(3, event_id % 9) + CASE WHEN greatest(3, event_id % 9) % 2 = 0 THEN 1 ELSE 0 END"))
def settings_helpers(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    shown = files.masked(t.select("event_id", F.col("event_type").alias("tenant"), F.col("props").alias("api_key")), ["api_key"])
    return shown.select("event_id", F.array_join(R.provider_names(F.lit(" Webhook ,,object_storage, WEBHOOK"), "object_storage"), ",").alias("providers"), X.odd_at_least(F.col("event_id") % 9, 3).alias("block"), "api_key", "tenant")


OVERRIDES = "SELECT event_id AS job, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a' || cast(event_id % 7 as string) END AS a_route, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'r' END AS r_route, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS a_conf, cast(event_id % 10 as double) / 10 AS r_conf FROM {events}"


@query(f"SELECT job, coalesce(nullif(r_route, ''), a_route, '') AS route, coalesce(a_conf, r_conf) AS confidence FROM ({plain_sql(OVERRIDES)})")
def artifact_overrides(spark, sf_dir):
    # the artifact's values win over the request's, but for the route
    t = run_sql(spark, sf_dir, OVERRIDES)
    return t.select("job", F.coalesce(F.nullif("r_route", F.lit("")), "a_route", F.lit("")).alias("route"), F.coalesce("a_conf", "r_conf").alias("confidence"))


@query("SELECT page_id, regexp_matches(split_part(split_part(url, '://', 2), '?', 1), '^[^/]+/(documents|en|fr)(/|$)') AS routed FROM pages")
def gateway_paths(spark, sf_dir):
    path = F.regexp_extract("url", r"^[^:]*://[^/]*([^?]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.rlike("^/(documents|en|fr)(/|$)").alias("routed"))
