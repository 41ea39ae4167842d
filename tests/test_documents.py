import math

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators.classify import classify
from folioflow.operators.extract import extract
from folioflow.operators.validate import validate


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("Rp 51.000", "51000"), ("52,416", "52416"), ("$1,234.50", "1234.5"), ("43.636", "43636"), ("1.234,5", "1234.5"), ("1.234.5", "1.234.5"), ("none", ""), (None, ""), ("-5,25", "-5.25")])
def test_amount(spark, raw, want):
    assert one(spark, raw, X.amount) == want


@pytest.mark.parametrize(("raw", "want"), [(" Purchase-Order ", "purchase_order"), ("odd", "generic"), (None, "generic")])
def test_route_name(spark, raw, want):
    assert one(spark, raw, X.route_name) == want


def test_error_rates(spark):
    df = spark.createDataFrame([("total amount", "total amont"), ("  ", "x"), ("a b c", "a c")], "e string, p string")
    rows = df.select(X.cer(F.col("e"), F.col("p")).alias("c"), X.wer(F.col("e"), F.col("p")).alias("w")).collect()
    assert math.isclose(rows[0].c, round(1 / 12, 6)) and rows[0].w == 0.5
    assert rows[1].c is None and rows[1].w is None
    assert rows[2].w == round(1 / 3, 6)


CASES = [
    ("Invoice Number INV-001 Bill To Acme Corp Amount Due $500 Payment Terms Net 30", 0.92, False, "invoice", "matched_rules"),
    ("ocr_fallback:forced_fallback", 0.2, True, "generic", "ocr_fallback"),
    ("memo", 0.9, False, "generic", "insufficient_text"),
    ("Service Agreement between Party A and Party B. Terms and signature are below.", 0.88, False, "contract", "matched_rules"),
]


@pytest.mark.parametrize(("text", "ocr", "fallback", "route", "reason"), CASES)
def test_classify(spark, text, ocr, fallback, route, reason):
    r = classify(spark.createDataFrame([(1, text, ocr, fallback)], "job_id long, text string, ocr_confidence double, fallback_used boolean")).first()
    assert (r.route, r.reason) == (route, reason)
    assert r.auto_route == (route == "invoice" or (route != "generic" and r.classification_confidence >= 0.68))


@pytest.mark.parametrize(("route", "text", "want"), [
    ("invoice", "From: ACME Ltd\nInvoice Number INV-001\nDate: 2026-06-01\nAmount Due: $500.00\nUSD", {"invoice_number": "INV-001", "total_amount": "$500.00", "currency": "USD", "vendor_name": "ACME Ltd"}),
    ("invoice", "INVOICE\nINVOICE NO: INV-2026-0515", {"invoice_number": "INVOICE"}),
    ("receipt", "Merchant: Corner Store\nDate: 2026/06/01\nSubtotal: $40.00\nTax: $3.00\nTotal: $43.00\nVisa", {"merchant_name": "Corner Store", "tax_amount": "$3.00", "payment_method": "Visa", "total_amount": "$40.00"}),
    ("contract", "Service Agreement between Alpha LLC and Beta Inc. Effective Date: June 1, 2026. Term: 12 months. Governing Law: Lagos.", {"effective_date": "June 1, 2026", "term": "12 months"}),
    ("bank_statement", "Bank Statement Account Number 123456789 Statement Period: 01/01/2026 - 01/31/2026 Opening Balance: $100.00 Closing Balance: $250.00", {"account_number": "123456789", "opening_balance": "$100.00", "closing_balance": "$250.00"}),
])
def test_extract(spark, route, text, want):
    fields = extract(spark.createDataFrame([(1, text, route, 0.9)], "job_id long, text string, route string, ocr_confidence double")).first().fields
    assert {k: fields[k] for k in want} == want


SCHEMA = "fields map<string,string>, confidence double, field_confidences map<string,double>, used_vlm_fallback boolean, route string"


@pytest.mark.parametrize(("fields", "confidence", "route", "verdict", "reason"), [
    ({"invoice_number": "1", "invoice_date": "2026-06-01", "total_amount": "$5.00", "currency": "USD", "vendor_name": "A"}, 0.94, "invoice", "auto_approved", None),
    ({"invoice_number": "1"}, 0.95, "invoice", "needs_review", "missing_required_fields:invoice_date,total_amount"),
    ({"receipt_date": "2026-06-01", "merchant_name": "A", "total_amount": "five hundred"}, 0.72, "receipt", "needs_review", "invalid_money_format:total_amount"),
    ({}, 0.1, "invoice", "rejected", "reject_unusable_extraction"),
    ({"supplier_name": "A"}, 0.95, None, "needs_review", "missing_required_fields:purchase_order_number,total_amount"),
])
def test_validate(spark, fields, confidence, route, verdict, reason):
    r = validate(spark.createDataFrame([(fields, confidence, {}, False, route)], SCHEMA)).first()
    assert r.verdict == verdict
    assert reason is None and not r.reasons or reason in r.reasons
