"""Rounding without lambdas and classification by looked-up sums, against plain versions."""

import random
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions.rounding import fixed_column, rounded_column
from folioflow.operators.classify import shares


def test_columns_are_rounded_by_their_exact_value_without_a_lambda(spark):
    rng = random.Random(4)
    xs = [rng.uniform(-1, 1) for _ in range(500)] + [k / 20000 for k in range(1, 400, 2)] + [k / 32 for k in range(-64, 64)] + [1.0005, 0.00005, 2.0**38 + 0.00005, 0.0, -0.0]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, x double").select("x", rounded_column(F.col("x"), 4).alias("r"), fixed_column(F.col("x"), 3).alias("f"))
    assert "lambda" not in t._jdf.queryExecution().optimizedPlan().toString()
    for r in t.collect():
        assert r.r == float(Decimal(r.x).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)), r.x
        assert float(r.f) == float(Decimal(r.x).quantize(Decimal("0.001"), ROUND_HALF_EVEN)), r.x


def test_sums_of_weights_are_those_of_adding_in_order():
    for *_, patterns in S.ROUTE_RULES:
        for bits, share in enumerate(shares(patterns)):
            assert share == 0.20 + min(reduce(add, (w for j, (_, w) in enumerate(patterns) if bits >> j & 1), 0.0), 0.85)


def test_the_flow_rounds_outside_the_lambda_of_its_fields(spark):
    from folioflow.operators.extract import extract

    docs = spark.range(3).selectExpr("id AS job_id", "concat('Invoice Number INV-', id) AS text", "0.9D AS ocr_confidence", "'invoice' AS route")
    docs = docs.withColumn("ocr_confidence", F.col("job_id") / 7)
    plan = extract(docs).select("field_confidences")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array" not in plan  # a value of one field is not rounded again for each other
