"""Nested rewriting against a plain walk, and exact rounding against Python's."""

import json
import random

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.rounding import fixed, rounded
from folioflow.operators import nested


def walk(v, hide, found):
    if isinstance(v, dict):
        found |= {k for k in v if k in hide}
        return {k: "[REDACTED]" if k in hide else walk(x, hide, found) for k, x in v.items()}
    if isinstance(v, list):
        return [walk(x, hide, found) for x in v]
    return " ".join(v.split()) if isinstance(v, str) else v


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 5 else 4)
    if kind == 0:
        return rng.choice([None, True, 0, -1.5, 12345678901])
    if kind < 4:
        return rng.choice(["", " a  b ", 'q"\\', "é日\n", "ssn", "{}"])
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["ssn", "SSN", "a", 'k"', "b é", "1"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_any_shape_and_depth(spark):
    rng = random.Random(3)
    docs = [made(rng) for _ in range(120)] + [{"ssn": {"deep": [1]}}, [[[[[[["  x  y"]]]]]]], {}]
    rows = [(k % 7, json.dumps(d)) for k, d in enumerate(docs)] + [(1, None), (1, "no json {")]
    df = spark.createDataFrame(rows, "id long, doc string").withColumn("row", F.lit(1))
    got = nested.rewrite(df, "doc", ["ssn", 'k"'], X.collapse)
    assert got.columns == ["id", "doc", "row", "doc_hidden"] and got.count() == len(rows)
    want = []
    for d in docs:
        found = set()
        want.append((json.dumps(walk(d, {"ssn", 'k"'}, found), sort_keys=True), sorted(found)))
    have = [(json.dumps(json.loads(r.doc), sort_keys=True), r.doc_hidden) for r in got.collect() if r.doc is not None]
    assert sorted(map(str, have)) == sorted(map(str, want)) and got.filter("doc IS NULL").count() == 2
    assert nested.rewrite(df.limit(0), "doc", ["ssn"]).count() == 0


def test_rounding_is_of_the_exact_value(spark):
    rng = random.Random(1)
    xs = [0.0, 0.0005, 1.0005, 2.5, 0.5, 1.5, 0.0625, 0.3125, 1e-320, 0.99995, 123456.7895, -1.0005, -2.5, -0.125] + [rng.random() for _ in range(3000)] + [rng.randrange(10**5) / 2 ** rng.randrange(1, 12) for _ in range(2000)] + [(rng.randrange(10**6) + 0.5) / 1000 for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 3, 4, 6):
        for r in df.select("x", rounded(F.col("x"), n).alias("r"), fixed(F.col("x"), n).alias("f")).collect():
            assert r.r == round(r.x, n) and r.f.lstrip("-") == f"{abs(r.x):.{n}f}", (n, r)
    odd = spark.createDataFrame([(None,), (float("inf"),), (1e300,)], "x double").select(rounded(F.col("x"), 3).alias("r"), fixed(F.col("x"), 3).alias("f")).collect()
    assert [r.r for r in odd] == [None, float("inf"), 1e300] and [r.f for r in odd] == [None] * 3
