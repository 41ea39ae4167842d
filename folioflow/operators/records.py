"""Records that leave the flow: review tasks, deliveries, webhook events, evaluation runs, and their receipts.

Ids are digests of canonical JSON, so the same request gives the same id on any
machine; signatures are built from SHA-256 alone. No Python runs on the executors.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions import canonical as J
from folioflow.functions.text import csv_set, let, number_or, strip


# -- review ------------------------------------------------------------------------
def review_id(job: Column, reasons: Column, fields: Column, confidence: Column) -> Column:
    body = J.json_object(job_id=J.json_text(job), reasons=J.json_list(F.array_sort(reasons)), fields=J.json_map(fields), confidence=J.json_number(confidence, 4))
    return J.digest("review-", body)


def review_priority(confidence: Column, reasons: Column, given: Column | None = None) -> Column:
    """A given priority counts; else very low confidence and rejection are high, what may not pass alone is medium."""
    rejected = F.exists(reasons, lambda r: r.startswith("reject_"))
    own = F.when((confidence < S.SETTINGS.review_high_priority) | rejected, "high").when(confidence < S.SETTINGS.auto_approve, "medium").otherwise("normal")
    return own if given is None else F.when(F.coalesce(given, F.lit("")) != "", F.lower(strip(given))).otherwise(own)


def review_record(job: Column, route: Column, verdict: Column, reasons: Column, fields: Column, confidence: Column, given: Column) -> Column:
    fallback = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return F.struct(
        review_id(job, reasons, fields, confidence).alias("review_task_id"), fallback(route, "unknown").alias("route"), fallback(verdict, "needs_review").alias("verdict"),
        review_priority(confidence, reasons, given).alias("priority"), F.round(confidence, 4).alias("confidence"),
    )


def review_provider(configured: Column, has_token: Column) -> Column:
    name = F.lower(strip(configured))
    return F.when(name.isin("label_studio", "local_queue"), name).when(has_token, "label_studio").otherwise("local_queue")


def auth_mode(configured: Column, token: Column) -> Column:
    """How a token is presented: ``auto`` tells by its two dots; an unknown scheme gives null."""
    name = F.lower(strip(F.coalesce(F.nullif(configured, F.lit("")), F.lit("token"))))
    return F.when(name == "auto", F.when(F.length(token) - F.length(F.replace(token, F.lit("."), F.lit(""))) == 2, "pat").otherwise("token")).when(name.isin("token", "pat", "bearer"), name)


def task_reference(answer: Column, default: Column) -> Column:
    """The task's id in an import answer of any of its shapes (a variant), else ``default``."""
    at = lambda path: F.try_variant_get(answer, path, "string")
    return F.coalesce(at("$.task_id"), at("$.id"), at("$.task_ids[0]"), at("$[0].id"), at("$[0].task_id"), default)


# -- delivery ----------------------------------------------------------------------
def provider_names(given: Column, default: str) -> Column:
    names = csv_set(given)
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def delivery_id(key: Column, job: Column, payload: Column, status: Column, destinations: Column, url: Column) -> Column:
    body = J.json_object(job_id=J.json_text(job), payload=J.json_map(payload), approval_status=J.json_text(status), destinations=J.json_list(destinations), webhook_url=J.json_text(F.coalesce(url, F.lit(""))))
    return J.digest("delivery-", F.when(F.coalesce(key, F.lit("")) != "", strip(key)).otherwise(body))


def event_id(given: Column, key: Column, event_type: Column, tenant: Column, job: Column, workflow: Column, data: Column) -> Column:
    """data: a map of strings."""
    body = J.json_object(event_type=J.json_text(event_type), tenant_id=J.json_text(tenant), job_id=J.json_text(job), workflow_id=J.json_text(F.coalesce(workflow, F.lit(""))), data=J.json_map(data))
    own = J.digest("evt-", F.when(F.coalesce(key, F.lit("")) != "", strip(key)).otherwise(body))
    return F.when(F.coalesce(given, F.lit("")) != "", strip(given)).otherwise(own)


def signature(secret: str, body: Column) -> Column:
    """HMAC-SHA256 of a text as hex: two SHA-256 over the key, padded and masked, and the text. A key of over 64 bytes counts as its own SHA-256."""
    raw = secret.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    inner, outer = (bytes(b ^ mask for b in raw.ljust(64, b"\0")) for mask in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def envelope(event: Column, event_type: Column, at: Column, tenant: Column, job: Column, workflow: Column, data: Column) -> Column:
    """The canonical body of a webhook event. data: a map of strings; at: an ISO-8601 text."""
    parts = {"event_id": event, "event_type": event_type, "occurred_at": at, "tenant_id": tenant, "job_id": job, "workflow_id": workflow}
    return J.json_object(schema_version=F.lit('"1.0"'), data=J.json_map(data), **{k: J.json_text(v) for k, v in parts.items()})


def headers(event: Column, event_type: Column, tenant: Column, job: Column, body: Column, secret: str, prefix: str, require: bool = True) -> Column:
    """The headers of a webhook request as a map; signed where there is a secret. prefix: of the names of our own."""
    if require and not secret:
        raise ValueError("a secret is required to sign webhook events")
    own = {"Content-Type": F.lit("application/json"), "Idempotency-Key": event, f"{prefix}-Event-Id": event, f"{prefix}-Event-Type": event_type, f"{prefix}-Job-Id": job, f"{prefix}-Tenant-Id": tenant}
    if secret:
        own[f"{prefix}-Signature-256"] = F.concat(F.lit("sha256="), signature(secret, body))
    return F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v)))


def webhook_target(request_url: Column, configured_url: Column, allowed: list[str], request_allowed: bool) -> Column:
    """Struct url and problem: null url and problem mean that nothing is to be sent."""
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    own = blank(request_url)
    url = F.coalesce(own, blank(strip(configured_url)))
    host, scheme = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    problem = (
        F.when(own.isNotNull() & F.lit(not request_allowed), "per-request webhook_url is disabled")
        .when(own.isNotNull() & ~F.coalesce(host.isin(*allowed), F.lit(False)), "webhook_url host is not allowed")
        .when(url.isNotNull() & ~F.coalesce(scheme.isin("http", "https") & host.isNotNull(), F.lit(False)), "webhook_url must be an absolute http(s) URL")
    )
    return F.struct(F.when(problem.isNull(), url).alias("url"), problem.alias("problem"))


def attempts(codes: Column, retry_max: int, backoff: float) -> Column:
    """What becomes of a send whose answers are ``codes`` (null: no connection): struct status, tries, last_code and the seconds waited between them."""
    tried = F.slice(codes, 1, retry_max + 1)
    good = F.array_position(F.transform(tried, lambda c: F.when(F.coalesce(c.between(200, 299), F.lit(False)), 1).otherwise(0)), 1)
    n = F.when(good > 0, good.cast("int")).otherwise(F.size(tried))
    waited = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda a, k: a + F.when(k < n, backoff * F.pow(F.lit(2.0), k - 1)).otherwise(0.0))
    return F.struct(F.when(good > 0, "success").otherwise("failed").alias("status"), n.alias("tries"), F.get(tried, n - 1).alias("last_code"), waited.alias("waited"))


def answered(requests: DataFrame, receipts: DataFrame, key: str, status: str, done: tuple[str, ...] = ("success",)) -> DataFrame:
    """Adds ``replay``: whether a receipt already says that the request was done. receipts: key, status, several a key allowed."""
    finished = receipts.filter(F.col(status).isin(*done)).select(key).distinct().withColumn("_done", F.lit(True))
    return requests.join(finished, key, "left").withColumn("replay", F.coalesce("_done", F.lit(False))).drop("_done")


def receipt_of(primary: DataFrame, secondary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A receipt as the first place has it, else as the second has it, with the place it came from."""
    both = primary.select(key, F.struct(F.lit(1).alias("at"), *columns).alias("r")).unionByName(secondary.select(key, F.struct(F.lit(2).alias("at"), *columns).alias("r")))
    best = both.groupBy(key).agg(F.min("r").alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in columns), F.when(F.col("r.at") == 1, "primary").otherwise("secondary").alias("place"))


def result_of(results: Column, provider: str) -> Column:
    """The first result of a provider in an array of structs."""
    return F.get(F.filter(results, lambda r: r["provider"] == provider), F.lit(0))


def receipt_key(job: Column, kind: str, id_: Column) -> Column:
    return F.concat_ws("/", F.lit("jobs"), job, F.lit(kind), id_, F.lit("receipt.json"))


# -- evaluation --------------------------------------------------------------------
def evaluation_metrics(ocr: Column, extraction: Column, model: Column, review: Column, status: Column, fields: Column, populated: Column, custom: Column) -> Column:
    """Metrics of one run as a map; unreadable numbers count as 0, absent counts are left out, custom ones (a map of texts) win."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        own = {
            "ocr_confidence": a, "extraction_confidence": b, "confidence_mean": F.round((a + b) / 2, 6), "confidence_gap": F.round(F.abs(a - b), 6),
            "used_vlm_fallback": one(model), "requires_human_review": one(review), "outcome_delivered": one(status == "delivered"),
            "outcome_pending_human_review": one(status == "pending_human_review"), "outcome_failed": one(status == "failed"),
            "field_count": fields.cast("double"), "populated_field_count": populated.cast("double"),
            "field_completeness": F.when((fields > 0) & populated.isNotNull(), F.round(F.least(F.lit(1.0), populated / fields), 6)),
        }
        return F.create_map(*(y for k, v in own.items() for y in (F.lit(k), v)))

    base = let(F.struct(number_or(ocr).alias("a"), number_or(extraction).alias("b")), of)
    return overlaid(F.map_filter(base, lambda k, v: v.isNotNull()), F.transform_values(custom, lambda k, v: number_or(v)))


def overlaid(base: Column, more: Column) -> Column:
    """Two maps in one; the second wins. It is made once, not again for every key of the first."""
    return let(more, lambda m: F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(m, k)), m))


def run_parameters(defaults: Column, given: Column) -> Column:
    """Defaults with the caller's texts over them, these cut to 500 characters."""
    return overlaid(defaults, F.transform_values(given, lambda k, v: F.left(F.coalesce(v, F.lit("None")), F.lit(500))))


def tracking_status(successes: Column, results: Column) -> Column:
    return F.when(successes == results, "success").when(successes > 0, "partial_success").otherwise("failed")
