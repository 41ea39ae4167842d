"""Stage contracts over JSON results: typed requirements, the payload of each stage, result checks.

Results are ``variant`` columns (``try_parse_json``). A requirement gives its
value and its error text; a payload is a struct of its values and ``error``, the
text of the first requirement that is not met, and all its values are null then.

What is looked up is bound by ``let``: once a row each, and outside the method that
Spark generates, which all requirements written out make too long for the JVM to compile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let, strip

NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"


@dataclass(frozen=True)
class Need:
    value: Column
    error: Column


#: How the schema of a JSON value begins, by kind; all others are numbers.
SCHEMAS = {"VOID": "null", "STRI": "string", "BOOL": "boolean", "OBJE": "object", "ARRA": "array"}


def part(payload: Column, key: str) -> Column:
    return F.try_variant_get(payload, f"$.{key}", "variant")


def text(payload: Column, key: str) -> Column:
    return F.try_variant_get(payload, f"$.{key}", "string")


def kind(v: Column) -> Column:
    """string, number, boolean, object, array or null."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SCHEMAS.items() for x in kv)), F.left(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), F.lit(4))), F.lit("number"))


def filled(payload: Column, key: str) -> Column:
    """The stripped text of a string field that is not blank, else null."""
    return let(part(payload, key), lambda v: let(strip(F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))), lambda t: F.when(t != "", t)))


def _failed(bad: Column, stage: str, message: str) -> Column:
    return F.when(bad, F.lit(f"{stage}: {message}"))


def required_str(payload: Column, key: str, stage: str) -> Need:
    value = filled(payload, key)
    return Need(value, _failed(value.isNull(), stage, f"expected non-empty string field '{key}'"))


def required_dict(payload: Column, key: str, stage: str) -> Need:
    good = kind(part(payload, key)) == "object"
    return Need(F.when(good, text(payload, key)), _failed(~good, stage, f"expected object field '{key}'"))


def number(payload: Column, key: str) -> Column:
    """The field as a double where it is a number, a boolean or the text of a number."""

    def of(v: Column, k: Column, t: Column) -> Column:
        return F.when(k == "number", F.try_variant_get(v, "$", "double")).when(k == "boolean", F.when(t == "true", 1.0).otherwise(0.0)).when((k == "string") & t.rlike(NUMBER), t.try_cast("double"))

    return let(part(payload, key), lambda v: let(F.struct(kind(v).alias("k"), strip(F.try_variant_get(v, "$", "string")).alias("t")), lambda x: of(v, x["k"], x["t"])))


def required_float(payload: Column, key: str, stage: str) -> Need:
    value, absent = number(payload, key), kind(part(payload, key)) == "null"
    return Need(value, F.coalesce(_failed(absent, stage, f"missing numeric field '{key}'"), _failed(value.isNull(), stage, f"invalid numeric field '{key}'")))


def flag(payload: Column, key: str) -> Column:
    """The field as a boolean where it is one or one of the words for it."""

    def of(k: Column, t: Column) -> Column:
        word = F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)
        return F.when(k == "boolean", t == "true").when(k == "string", word)

    return let(part(payload, key), lambda v: let(F.struct(kind(v).alias("k"), F.lower(strip(F.try_variant_get(v, "$", "string"))).alias("t")), lambda x: of(x["k"], x["t"])))


def required_bool(payload: Column, key: str, stage: str) -> Need:
    value = flag(payload, key)
    return Need(value, _failed(value.isNull(), stage, f"invalid boolean field '{key}'"))


def optional_list_of_str(payload: Column, key: str, stage: str) -> Need:
    k = kind(part(payload, key))
    items = F.try_variant_get(payload, f"$.{key}", "array<variant>")
    odd = F.array_position(F.transform(items, lambda x: F.when(kind(x) == "string", 1).otherwise(0)), 0)
    none = F.array().cast("array<string>")
    value = F.when(k == "null", none).when((k == "array") & (odd == 0), F.try_variant_get(payload, f"$.{key}", "array<string>"))
    at = F.when((k == "array") & (odd > 0), F.format_string(f"{stage}: expected '{key}[%d]' to be string", odd - 1))
    return Need(value, F.coalesce(_failed(~k.isin("null", "array"), stage, f"expected list field '{key}'"), at))


def payload_of(values: dict[str, Column], *needs: Need) -> Column:
    return let(F.coalesce(*(n.error for n in needs)), lambda error: F.struct(*(F.when(error.isNull(), v).alias(k) for k, v in values.items()), error.alias("error")))


def preprocess_payload(start: Column) -> Column:
    job, bucket, key = (required_str(start, k, "workflow_input") for k in ("job_id", "raw_bucket", "raw_key"))
    return payload_of({"job_id": job.value, "raw_bucket": bucket.value, "raw_key": key.value}, job, bucket, key)


def ocr_payload(preprocess: Column) -> Column:
    key = required_str(preprocess, "preprocessed_key", "preprocess")
    return payload_of({"preprocessed_key": key.value}, key)


def layout_payload(preprocess: Column, ocr: Column) -> Column:
    page, key = required_str(preprocess, "preprocessed_key", "preprocess"), required_str(ocr, "ocr_key", "ocr")
    return payload_of({"preprocessed_key": page.value, "ocr_key": key.value}, page, key)


def classification_payload(ocr: Column) -> Column:
    key = required_str(ocr, "ocr_key", "ocr")
    return payload_of({"ocr_key": key.value}, key)


def extraction_payload(ocr: Column, layout: Column, classification: Column) -> Column:
    key, zone = required_str(ocr, "ocr_key", "ocr"), required_str(layout, "layout_key", "layout")
    route, confidence = required_str(classification, "route", "classification"), required_float(ocr, "mean_confidence", "ocr")
    hints = {k: text(classification, k) for k in ("strategy_profile", "extraction_mode")}
    return payload_of({"ocr_key": key.value, "layout_key": zone.value, "ocr_confidence": confidence.value, "route": route.value} | hints, key, zone, route, confidence)


def validation_payload(extraction: Column) -> Column:
    key, fields = required_str(extraction, "extraction_key", "extraction"), required_dict(extraction, "fields", "extraction")
    confidence, model = required_float(extraction, "confidence", "extraction"), required_bool(extraction, "used_vlm_fallback", "extraction")
    values = {"extraction_key": key.value, "fields": fields.value, "confidence": confidence.value, "used_vlm_fallback": model.value}
    return payload_of(values | {k: filled(extraction, k) for k in ("extraction_bucket", "route")}, key, fields, confidence, model)


def review_payload(extraction: Column, validation: Column) -> Column:
    reasons = optional_list_of_str(validation, "reasons", "validation")
    fields, confidence = required_dict(extraction, "fields", "extraction"), required_float(extraction, "confidence", "extraction")
    copied = {k: filled(extraction, k) for k in ("extraction_bucket", "extraction_key", "route")} | {k: filled(validation, k) for k in ("validation_bucket", "validation_key", "verdict")}
    return payload_of({"reasons": reasons.value, "fields": fields.value, "confidence": confidence.value} | copied, reasons, fields, confidence)


def delivery_payload(extraction: Column, validation: Column) -> Column:
    fields, verdict = required_dict(extraction, "fields", "extraction"), required_str(validation, "verdict", "validation")
    copied = {k: filled(extraction, k) for k in ("extraction_bucket", "extraction_key")} | {k: filled(validation, k) for k in ("validation_bucket", "validation_key")}
    return payload_of({"payload": fields.value, "approval_status": verdict.value} | copied | {"route": filled(extraction, "route")}, fields, verdict)


def evaluation_payload(status: Column, ocr: Column, extraction: Column, validation: Column) -> Column:
    """Never fails: what is missing or unreadable counts as 0 or false."""
    fields = F.try_variant_get(extraction, "$.fields", "map<string,string>")
    known = kind(part(extraction, "fields")) == "object"
    return F.struct(
        status.alias("status"), F.coalesce(number(ocr, "mean_confidence"), F.lit(0.0)).alias("ocr_confidence"), F.coalesce(number(extraction, "confidence"), F.lit(0.0)).alias("extraction_confidence"),
        F.coalesce(flag(extraction, "used_vlm_fallback"), F.lit(False)).alias("used_vlm_fallback"), F.coalesce(flag(validation, "requires_human_review"), F.lit(False)).alias("requires_human_review"),
        F.when(known, F.size(fields)).alias("field_count"), F.when(known, F.size(F.filter(F.map_values(fields), lambda v: F.coalesce(strip(v), F.lit("")) != ""))).alias("populated_field_count"),
        filled(validation, "route").alias("route"), filled(validation, "verdict").alias("validation_verdict"),
    )


def event_payload(event_type: Column, tenant: Column, job: Column, workflow: Column, status: Column, error: Column) -> Column:
    """A terminal event: the tenant's default, the error cut to 500 characters and the key under which it is sent once."""
    who = F.coalesce(F.nullif(tenant, F.lit("")), F.lit("default"))
    key = F.concat_ws(":", event_type, who, job, F.coalesce(workflow, F.lit("")))
    return F.struct(event_type.alias("event_type"), who.alias("tenant_id"), status.alias("status"), F.left(F.nullif(error, F.lit("")), F.lit(500)).alias("error"), key.alias("idempotency_key"))


STAGES = ("preprocess", "ocr", "layout", "classification", "extraction", "validation")
FINAL = ("delivered", "pending_human_review")
INVOICE_FIELDS = ("invoice_number", "invoice_date", "total_amount")


def result_errors(payload: Column, strict: bool = False) -> Column:
    """All that a finished pipeline result lacks, in order. A stage that is missing is named by the list of stages and again where it is read."""
    names = (*STAGES, "delivery", "review_task")

    def judged(result: Column) -> Column:
        status = F.coalesce(F.nullif(text(result, "status"), F.lit("")), F.lit("unknown"))
        stages = F.struct(status.alias("status"), *(let(part(result, s), lambda v: F.struct(v.alias("v"), kind(v).alias("k"))).alias(s) for s in names))
        return F.when(kind(result) != "object", F.array(F.lit("missing_result_object"))).otherwise(let(stages, lambda x: _lacks(x, strict)))

    return let(part(payload, "result"), judged)


def _lacks(found: Column, strict: bool) -> Column:
    """What ``result_errors`` says of a result that is an object. found: status and, a stage, its value v and its kind k."""
    status, stage = found["status"], {s: found[s]["v"] for s in (*STAGES, "delivery", "review_task")}

    def no_stage(s: str) -> Column:
        return F.when(found[s]["k"] != "object", F.lit(f"missing_or_invalid_stage:{s}"))

    def no_text(s: str, key: str) -> Column:
        return F.when(filled(stage[s], key).isNull(), F.lit(f"{s}:missing_{key}"))

    def no_number(s: str, key: str) -> Column:
        return F.when(~kind(part(stage[s], key)).isin("number", "boolean"), F.lit(f"{s}:missing_or_invalid_{key}"))

    def no_kind(s: str, key: str, what: str) -> Column:
        return F.when(kind(part(stage[s], key)) != what, F.lit(f"{s}:missing_{key}"))

    fields = let(part(stage["extraction"], "fields"), lambda v: F.when(kind(v) == "object", v))
    blank = let(fields, lambda v: F.array_compact(F.array(*(F.when(F.coalesce(strip(text(v, f)), F.lit("")) == "", F.lit(f)) for f in INVOICE_FIELDS))))
    lacking = let(blank, lambda names: F.when(F.size(names) > 0, F.array_join(names, ",")))
    delivered, pending = status == "delivered", status == "pending_human_review"
    checks = [
        F.when(~status.isin(*FINAL), F.concat(F.lit("unexpected_final_status:"), status)),
        *(no_stage(s) for s in STAGES), *(no_stage(s) for s in STAGES),
        no_text("preprocess", "preprocessed_key"), no_text("ocr", "ocr_key"), no_number("ocr", "mean_confidence"), no_text("layout", "layout_key"), no_text("classification", "route"),
        no_text("extraction", "extraction_key"), no_number("extraction", "confidence"), no_kind("extraction", "fields", "object"), no_kind("extraction", "used_vlm_fallback", "boolean"),
        no_text("validation", "verdict"), no_kind("validation", "requires_human_review", "boolean"),
        F.when(delivered, no_stage("delivery")), F.when(delivered & ~F.coalesce(text(stage["delivery"], "delivery_status") == "success", F.lit(False)), "delivery:status_not_success"),
        F.when(delivered, no_text("delivery", "delivery_id")), F.when(delivered, no_text("delivery", "delivery_receipt_key")),
        F.when(delivered, F.concat(F.lit("delivered_with_missing_required_fields:"), lacking)),
        F.when(pending, no_stage("review_task")), F.when(pending, no_text("review_task", "review_task_id")), F.when(pending, no_text("review_task", "review_status")),
    ]
    if strict:
        checks.append(F.concat(F.lit("missing_required_fields:"), lacking))
    return F.array_compact(F.array(*checks))


def retry_class(status: Column, error: Column) -> Column:
    """How a stage call is to be treated: ok, fatal, retry, or for the reading stage a fallback."""
    fallback = error.contains("network error calling") | error.contains("downstream HTTP 5") | error.contains("ReadTimeout") | error.contains("ConnectError")
    fatal = status.between(400, 499) & ~status.isin(408, 429)
    return F.when(status.between(200, 299), "ok").when(fatal, "fatal").when(F.coalesce(fallback, F.lit(False)), "ocr_fallback").otherwise("retry")


def error_message(detail: Column, default: Column) -> Column:
    """Text details speak for themselves, objects by their message, anything else gives the default."""
    k = kind(detail)
    own = F.when(k == "string", F.variant_get(detail, "$", "string")).when((k == "object") & (kind(part(detail, "message")) == "string"), text(detail, "message"))
    return F.coalesce(F.nullif(own, F.lit("")), default)


def bearer(header: Column) -> Column:
    """The token of an Authorization header; null unless the scheme is bearer."""
    return F.nullif(strip(F.regexp_extract(strip(header), r"(?is)^bearer (.+)$", 1)), F.lit(""))


def header(headers: Column, name: str) -> Column:
    """A header by name: an exact name first, then one in any case."""
    any_case = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.get(any_case, F.lit(0))["value"])
