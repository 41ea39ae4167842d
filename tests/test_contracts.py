"""Stage contracts, records and canonical JSON against Python's own."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import canonical as J
from folioflow.operators import contracts as C
from folioflow.operators import records as R


def first(spark, build, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'map<string,string>' if isinstance(v, dict) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(build.alias("r")).first()["r"]


def stable(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@pytest.mark.parametrize("text", ["plain", "", 'say "x" \\ /', "tab\tline\nret\rbell\x07del\x7f", "Café 日本 😀 ", "\x00"])
def test_json_text(spark, text):
    assert first(spark, J.json_text(F.col("t")), t=text) == json.dumps(text)


@pytest.mark.parametrize("x", [0.0, 1.0, 0.5, 0.1234, 0.12345, 12.5, 0.0001])
def test_json_number(spark, x):
    assert first(spark, J.json_number(F.col("x")), x=x) == json.dumps(round(x, 4))


def test_ids_are_digests_of_canonical_json(spark):
    fields, reasons = {"b": "é", "a": 'x"'}, ["z", "low_confidence:0.720"]
    want = "review-" + hashlib.sha256(stable({"job_id": "j", "reasons": sorted(reasons), "fields": fields, "confidence": 0.72}).encode()).hexdigest()[:24]
    assert first(spark, R.review_id(F.lit("j"), F.col("r"), F.col("f"), F.lit(0.72)), r=reasons, f=fields) == want
    body = {"job_id": "j", "payload": fields, "approval_status": None, "destinations": ["webhook"], "webhook_url": ""}
    none = F.lit(None).cast("string")
    got = R.delivery_id(F.lit(""), F.lit("j"), F.col("f"), none, F.array(F.lit("webhook")), none)
    assert first(spark, got, f=fields) == "delivery-" + hashlib.sha256(stable(body).encode()).hexdigest()[:24]
    assert first(spark, R.delivery_id(F.lit(" k "), F.lit("j"), F.col("f"), none, F.array(), none), f=fields) == "delivery-" + hashlib.sha256(b"k").hexdigest()[:24]
    event = {"event_type": "e", "tenant_id": "t", "job_id": "j", "workflow_id": "", "data": fields}
    assert first(spark, R.event_id(none, none, F.lit("e"), F.lit("t"), F.lit("j"), none, F.col("f")), f=fields) == "evt-" + hashlib.sha256(stable(event).encode()).hexdigest()[:24]


def test_signature_is_hmac(spark):
    assert first(spark, R.signature("secret", F.col("b")), b="body é") == hmac.new(b"secret", "body é".encode(), hashlib.sha256).hexdigest()
    assert first(spark, R.signature("x" * 65, F.col("b")), b="") == hmac.new(b"x" * 65, b"", hashlib.sha256).hexdigest()


@pytest.mark.parametrize(("confidence", "reasons", "given", "want"), [(0.2, [], None, "high"), (0.7, [], None, "medium"), (0.95, [], None, "normal"), (0.95, ["reject_unusable_extraction"], None, "high"), (0.95, [], " Low ", "low"), (0.1, [], "", "high")])
def test_review_priority(spark, confidence, reasons, given, want):
    assert first(spark, R.review_priority(F.lit(confidence), F.col("r"), F.lit(given).cast("string")), r=reasons) == want


REQUIREMENTS = [
    (C.required_str, "k", {"k": " a "}, "a", None), (C.required_str, "k", {"k": " "}, None, "s: expected non-empty string field 'k'"), (C.required_str, "k", {"k": 5}, None, "s: expected non-empty string field 'k'"),
    (C.required_float, "k", {"k": 1}, 1.0, None), (C.required_float, "k", {"k": " .5 "}, 0.5, None), (C.required_float, "k", {"k": True}, 1.0, None), (C.required_float, "k", {"k": None}, None, "s: missing numeric field 'k'"),
    (C.required_float, "k", {"k": "1d"}, None, "s: invalid numeric field 'k'"), (C.required_float, "k", {"k": []}, None, "s: invalid numeric field 'k'"),
    (C.required_bool, "k", {"k": "YES"}, True, None), (C.required_bool, "k", {"k": False}, False, None), (C.required_bool, "k", {"k": 1}, None, "s: invalid boolean field 'k'"),
    (C.required_dict, "k", {"k": {}}, "{}", None), (C.required_dict, "k", {"k": []}, None, "s: expected object field 'k'"),
    (C.optional_list_of_str, "k", {}, [], None), (C.optional_list_of_str, "k", {"k": ["a"]}, ["a"], None), (C.optional_list_of_str, "k", {"k": ["a", 1]}, None, "s: expected 'k[1]' to be string"), (C.optional_list_of_str, "k", {"k": "a"}, None, "s: expected list field 'k'"),
]


@pytest.mark.parametrize(("need", "key", "payload", "value", "error"), REQUIREMENTS)
def test_requirements(spark, need, key, payload, value, error):
    n = need(F.try_parse_json(F.lit(json.dumps(payload))), key, "s")
    r = spark.range(1).select(n.value.alias("v"), n.error.alias("e")).first()
    assert (r.v, r.e) == (value, error)


GOOD = {
    "job_id": "j",
    "result": {
        "status": "delivered", "preprocess": {"preprocessed_key": "p"}, "ocr": {"ocr_key": "o", "mean_confidence": 0.9}, "layout": {"layout_key": "l"}, "classification": {"route": "invoice"},
        "extraction": {"extraction_key": "x", "confidence": 0.9, "used_vlm_fallback": False, "fields": {"invoice_number": "1", "invoice_date": "d", "total_amount": "5"}},
        "validation": {"verdict": "auto_approved", "requires_human_review": False}, "delivery": {"delivery_status": "success", "delivery_id": "d", "delivery_receipt_key": "k"},
    },
}


def changed(**stages):
    r = json.loads(json.dumps(GOOD))
    for stage, values in stages.items():
        if values is None:
            del r["result"][stage]
        elif isinstance(values, dict):
            r["result"][stage] = r["result"].get(stage, {}) | values
        else:
            r["result"][stage] = values
    return r


@pytest.mark.parametrize(("payload", "errors"), [
    (GOOD, []), ({}, ["missing_result_object"]), (changed(layout=None), ["missing_or_invalid_stage:layout"] * 2 + ["layout:missing_layout_key"]),
    (changed(extraction={"fields": {"invoice_number": "1"}}), ["delivered_with_missing_required_fields:invoice_date,total_amount"]),
    (changed(status="odd"), ["unexpected_final_status:odd"]), (changed(delivery={"delivery_status": "failed"}), ["delivery:status_not_success"]),
    (changed(status="pending_human_review", delivery=None), ["missing_or_invalid_stage:review_task", "review_task:missing_review_task_id", "review_task:missing_review_status"]),
    (changed(ocr={"mean_confidence": "0.9"}, validation={"requires_human_review": "no"}), ["ocr:missing_or_invalid_mean_confidence", "validation:missing_requires_human_review"]),
])
def test_result_errors(spark, payload, errors):
    assert first(spark, C.result_errors(F.try_parse_json("t")), t=json.dumps(payload)) == errors


def test_first_places_of_receipts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, s string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, s string")
    assert sorted(map(tuple, R.receipt_of(a, b, "k", ["s"]).collect())) == [(1, "x", "primary"), (2, "y", "primary"), (3, "w", "secondary")]
