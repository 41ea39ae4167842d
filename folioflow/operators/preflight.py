"""Checks before a release: environment settings and benchmark evidence, each as the list of what is wrong.

Settings come as a map of texts a configuration, so all configurations are judged
in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import let, strip

# What betrays a setting that nobody set, the secrets, the settings that must be there.
PLACEHOLDER = r"(?i)(changeme|replace-with|dev-|example\.com|idp_password|idpsecret123|idpadmin)"
SECRETS = (
    "ALERT_EMAIL_PASSWORD", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "BACKUP_ENCRYPTION_KEY", "DELIVERY_WEBHOOK_SECRET", "GRAFANA_ADMIN_PASSWORD", "INGESTION_API_KEYS", "LABEL_STUDIO_PASSWORD", "LABEL_STUDIO_TOKEN",
    "MINIO_ACCESS_KEY", "MINIO_SECRET_KEY", "POSTGRES_PASSWORD", "S3_ACCESS_KEY", "S3_SECRET_KEY", "VLLM_API_KEY",
)
REQUIRED = (
    "AUDIT_RETENTION_DAYS", "BACKUP_ENCRYPTION_ENABLED", "BACKUP_ENCRYPTION_KEY", "BACKUP_RETENTION_DAYS", "CREDENTIAL_MAX_AGE_DAYS", "DATABASE_CREDENTIALS_ROTATED_AT", "DERIVED_ARTIFACT_RETENTION_DAYS", "ENVIRONMENT",
    "GATEWAY_HTTPS_HOST_PORT", "GRAFANA_ADMIN_PASSWORD", "INFRASTRUCTURE_PROFILE", "INGESTION_API_KEYS", "INGESTION_KEYS_ROTATED_AT", "INGESTION_REQUIRE_AUTH", "LABEL_STUDIO_PASSWORD", "OCR_BACKEND", "POSTGRES_PASSWORD",
    "PUBLIC_BASE_URL", "RAW_ARTIFACT_RETENTION_DAYS", "S3_ACCESS_KEY", "S3_SECRET_KEY",
)
WHOLE_DAYS = ("CREDENTIAL_MAX_AGE_DAYS", "RAW_ARTIFACT_RETENTION_DAYS", "DERIVED_ARTIFACT_RETENTION_DAYS", "AUDIT_RETENTION_DAYS", "BACKUP_RETENTION_DAYS")
#: All settings that a rule reads by name.
READ = tuple(dict.fromkeys((
    *REQUIRED, *SECRETS, *WHOLE_DAYS, "DELIVERY_ALLOW_REQUEST_WEBHOOK_URL", "DELIVERY_WEBHOOK_REQUIRE_SIGNATURE", "EXTRACTION_ENABLE_VLM_FALLBACK", "GATEWAY_HTTP_BIND", "GRAFANA_ADMIN_USER", "INGESTION_BIND",
    "LABEL_STUDIO_AUTH_SCHEME", "LABEL_STUDIO_ENABLE_LEGACY_API_TOKEN", "OCR_FORCE_FALLBACK", "ORCHESTRATOR_ENABLE_OCR_NETWORK_FALLBACK", "REVIEW_FALLBACK_TO_LOCAL_QUEUE",
)))
POLICY_METRICS = {
    "min_sample_count": "sample_count", "min_completion_rate": "completion_rate", "min_contract_pass_rate": "pipeline_contract_pass_rate", "min_route_accuracy": "route_accuracy", "min_field_f1": "field_f1_mean",
    "min_validation_accuracy": "validation_accuracy", "min_throughput_documents_per_minute": "throughput_documents_per_minute", "max_human_review_rate": "human_review_rate", "max_ocr_cer": "ocr_cer_mean", "max_ocr_wer": "ocr_wer_mean",
    "max_p95_latency_seconds": "latency_p95_seconds",
}


def is_false(c: Column) -> Column:
    return F.lower(strip(c)).isin("0", "false", "no", "off")


def is_true(c: Column) -> Column:
    return F.lower(strip(c)).isin("1", "true", "yes", "on")


def whole(c: Column) -> Column:
    """A positive whole number, else null."""
    n = strip(c).try_cast("int")
    return F.when(strip(c).rlike(r"^[+-]?\d+$") & (n > 0), n)


def _key_problems(keys: Column) -> list[Column]:
    """What is wrong with a list of api-key:tenant entries: one text an entry and fault, and one for repeated keys."""
    entries = F.split(keys, ",")
    key, tenant = (lambda e: strip(F.substring_index(e, ":", 1))), (lambda e: strip(F.regexp_replace(e, "^[^:]*:", "")))
    formed = F.filter(entries, lambda e: F.contains(e, F.lit(":")))

    def of(e: Column) -> Column:
        odd = ~F.contains(e, F.lit(":"))
        return F.array_compact(F.array(
            F.when(odd, "INGESTION_API_KEYS entries must use api-key:tenant-id format"),
            F.when(~odd & (F.length(key(e)) < 24), "INGESTION_API_KEYS must use high-entropy keys of at least 24 characters"),
            F.when(~odd & (tenant(e) == ""), "INGESTION_API_KEYS entries must include a tenant id")))

    names = F.transform(formed, key)
    twice = F.when(F.size(F.array_distinct(names)) < F.size(names), F.array(F.lit("INGESTION_API_KEYS must not contain duplicate API keys"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return [F.when(keys != "", F.flatten(F.transform(entries, of))).otherwise(none), F.when(keys != "", twice).otherwise(none)]


def failures(settings: Column, now: Column, environment: str = "production") -> Column:
    """All that speaks against a configuration. settings: a map of texts."""
    # each setting is looked up once: all rules written out are a method that is too long for the JVM to compile
    names = [k for k in READ if k not in WHOLE_DAYS]
    found = F.struct(*(F.try_element_at(settings, F.lit(k)).alias(k) for k in names), *(let(F.try_element_at(settings, F.lit(k)), lambda c: F.struct(c.alias("text"), whole(c).alias("days"))).alias(k) for k in WHOLE_DAYS), settings.alias("settings"))
    return let(found, lambda x: _failures(x, now, environment))


def _failures(found: Column, now: Column, environment: str) -> Column:
    """As ``failures``, of settings that are looked up: a struct of texts by name, and of text and number for those of whole days."""
    here = environment == "production"
    settings = found["settings"]
    v = lambda k, default="": F.coalesce(found[k]["text"] if k in WHOLE_DAYS else found[k], F.lit(default))
    fake = lambda c: c.rlike(PLACEHOLDER)
    days = {k: found[k]["days"] for k in WHOLE_DAYS}
    url, model_key = v("PUBLIC_BASE_URL"), v("VLLM_API_KEY")
    rules: list[tuple[Column, str]] = [(v(k) == "", f"{k} is required") for k in REQUIRED]
    rules += [
        (fake(url), "PUBLIC_BASE_URL must be set to the real production URL"),
        (F.lit(here) & ~F.lower(url).startswith("https:"), "PUBLIC_BASE_URL must use https in production"),
        (F.lower(v("ENVIRONMENT")) != environment, f"ENVIRONMENT must be {environment}"),
        (is_false(v("INGESTION_REQUIRE_AUTH")), "INGESTION_REQUIRE_AUTH must be true in production"),
    ]
    for k in SECRETS:
        rules.append((fake(v(k)), f"{k} still looks like a development default or placeholder"))
        if k.endswith(("PASSWORD", "SECRET", "SECRET_KEY")):
            rules.append((v(k).isNotNull() & (v(k) != "") & (F.length(v(k)) < 24), f"{k} should be at least 24 characters"))
    rules += [
        ((F.lower(v("GRAFANA_ADMIN_USER")) == "admin") & (F.lower(v("GRAFANA_ADMIN_PASSWORD")) == "admin"), "Grafana admin/admin is not allowed in production"),
        (is_false(v("DELIVERY_WEBHOOK_REQUIRE_SIGNATURE", "true")), "DELIVERY_WEBHOOK_REQUIRE_SIGNATURE should stay true in production"),
        (F.lower(v("DELIVERY_ALLOW_REQUEST_WEBHOOK_URL", "false")) == "true", "DELIVERY_ALLOW_REQUEST_WEBHOOK_URL should stay false unless SSRF controls are reviewed"),
        ((F.lower(v("EXTRACTION_ENABLE_VLM_FALLBACK", "false")) == "true") & ((model_key == "") | (F.upper(model_key) == "EMPTY") | fake(model_key)), "VLLM_API_KEY must be a real secret when EXTRACTION_ENABLE_VLM_FALLBACK=true"),
        (v("INGESTION_BIND", "127.0.0.1") != "127.0.0.1", "INGESTION_BIND should stay on 127.0.0.1 in production; expose the API through the gateway"),
        (v("GATEWAY_HTTP_BIND", "127.0.0.1") == "0.0.0.0", "GATEWAY_HTTP_BIND should stay on 127.0.0.1 unless HTTP is intentionally exposed"),
        *((days[k].isNull(), f"{k} must be a positive integer") for k in WHOLE_DAYS),
        (days["DERIVED_ARTIFACT_RETENTION_DAYS"] < days["RAW_ARTIFACT_RETENTION_DAYS"], "DERIVED_ARTIFACT_RETENTION_DAYS must be at least RAW_ARTIFACT_RETENTION_DAYS"),
        (days["AUDIT_RETENTION_DAYS"] < days["DERIVED_ARTIFACT_RETENTION_DAYS"], "AUDIT_RETENTION_DAYS must be at least DERIVED_ARTIFACT_RETENTION_DAYS"),
        (~is_true(v("BACKUP_ENCRYPTION_ENABLED")), "BACKUP_ENCRYPTION_ENABLED must be true"),
        (F.length(v("BACKUP_ENCRYPTION_KEY")) < 32, "BACKUP_ENCRYPTION_KEY must contain at least 32 characters"),
        (is_true(v("OCR_FORCE_FALLBACK")), "OCR_FORCE_FALLBACK must be false"),
    ]
    if here:
        rules += [
            (v("INFRASTRUCTURE_PROFILE") != "dedicated-persistent", "INFRASTRUCTURE_PROFILE must be dedicated-persistent in production"),
            (is_true(v("ORCHESTRATOR_ENABLE_OCR_NETWORK_FALLBACK")), "ORCHESTRATOR_ENABLE_OCR_NETWORK_FALLBACK must be false in production"),
            (is_true(v("REVIEW_FALLBACK_TO_LOCAL_QUEUE")), "REVIEW_FALLBACK_TO_LOCAL_QUEUE must be false in production"),
            (is_true(v("LABEL_STUDIO_ENABLE_LEGACY_API_TOKEN")), "LABEL_STUDIO_ENABLE_LEGACY_API_TOKEN must be false in production"),
            (~F.lower(v("LABEL_STUDIO_AUTH_SCHEME")).isin("pat", "bearer"), "LABEL_STUDIO_AUTH_SCHEME must be pat or bearer in production"),
            (F.lower(v("OCR_BACKEND")) != "tesseract", "OCR_BACKEND must match the currently published and benchmarked tesseract release profile"),
        ]
    open_ = F.filter(F.map_keys(settings), lambda k: k.endswith("_BIND") & ~k.isin("GATEWAY_HTTP_BIND", "GATEWAY_HTTPS_BIND") & (F.element_at(settings, k) == "0.0.0.0"))
    exposed = F.transform(F.array_sort(open_), lambda k: F.concat(k, F.lit("=0.0.0.0 exposes the service directly; put it behind a reverse proxy or private interface")))
    ages = [_age(k, v(k), days["CREDENTIAL_MAX_AGE_DAYS"], now) for k in ("INGESTION_KEYS_ROTATED_AT", "DATABASE_CREDENTIALS_ROTATED_AT")]
    said = F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules), *ages))
    return F.flatten(F.array(said, *_key_problems(v("INGESTION_API_KEYS")), exposed))


def _age(name: str, value: Column, most: Column, now: Column) -> Column:
    """A rotation time that is unreadable, ahead of now by over a day, or older than the most days allowed."""
    # a time without a zone is of UTC; a year or a month alone is no time
    zoned = F.when(value.rlike(r"([Zz]|[+-]\d\d(:?\d\d)?)$") & value.rlike(r"\d[T ]\d"), value).when(value.rlike(r"\d[T ]\d"), F.concat(value, F.lit("Z"))).otherwise(F.concat(value, F.lit("T00:00:00Z")))
    at = F.when(value.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(zoned))
    age = (now.cast("double") - at.cast("double")) / 86400
    text = F.when(at.isNull(), F.lit(f"{name} must be an ISO-8601 timestamp")).when(age < -1, F.lit(f"{name} cannot be in the future")).when(age > most, F.format_string(f"{name} is older than CREDENTIAL_MAX_AGE_DAYS=%d", most))
    return F.when((value != "") & most.isNotNull(), text)


def configurations(rows: DataFrame, key: str) -> DataFrame:
    """One map a configuration from rows (key, name, value); a name that comes again counts with its largest value."""
    return rows.groupBy(key, "name").agg(F.max("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("settings"))


def evidence_failures(e: DataFrame) -> Column:
    """What speaks against a promotion. e: sha, policy_status, pipeline_version, gate_enabled, gate_passed, summary_passed, error_count, sample_count, policy (map name -> threshold), checks (map metric -> struct threshold, passed)."""
    policy = lambda k: F.try_element_at("policy", F.lit(k))

    def one(name: str, metric: str) -> Column:
        check = F.try_element_at("checks", F.lit(metric))
        return (
            F.when(policy(name).isNull(), F.lit(f"release acceptance policy is missing {name}")).when(check.isNull(), F.lit(f"benchmark gate is missing {metric}"))
            .when(~F.coalesce(check["threshold"] == policy(name), F.lit(False)), F.lit(f"benchmark threshold for {metric} does not match the approved policy")).when(~F.coalesce(check["passed"], F.lit(False)), F.lit(f"benchmark check failed: {metric}"))
        )

    not_ = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    floor = F.coalesce(policy("min_sample_count").cast("int"), F.lit(0))
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("sha").rlike(r"^[0-9a-f]{40}\z"), F.lit(False)), "expected release SHA must contain exactly 40 lowercase hexadecimal characters"),
        F.when(F.coalesce("policy_status", F.lit("")) != "approved", "release acceptance policy status must be approved"),
        F.when(~F.col("pipeline_version").eqNullSafe(F.col("sha")), "benchmark pipeline_version does not match the requested release SHA"),
        F.when(not_("gate_enabled"), "benchmark quality gate was not enabled"), F.when(not_("gate_passed"), "benchmark quality gate did not pass"),
        F.when(not_("summary_passed"), "benchmark summary does not report a passing quality gate"), F.when(~F.col("error_count").eqNullSafe(F.lit(0)), "benchmark summary contains execution errors"),
        *(one(k, m) for k, m in POLICY_METRICS.items()),
        F.when(F.coalesce("sample_count", F.lit(0)) < floor, F.format_string("benchmark sample_count=%d is below required %d", F.coalesce("sample_count", F.lit(0)), floor))))
