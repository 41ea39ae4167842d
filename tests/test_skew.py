"""The smallest rectangle around pixels: planted angles, odd shapes, parts of pages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import skew


def box(angle, w, h, fill=1.0, seed=0):
    rng = random.Random(seed)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [(round(2000 + u * c - v * s), round(2000 + u * s + v * c)) for u in range(0, w, 3) for v in range(0, h, 3) if rng.random() < fill or u in (0, w - 1) or v in (0, h - 1)]


@pytest.mark.parametrize("angle", [0, 3.3, -7.25, 14.9, 44, -44])
def test_planted_angles(spark, angle):
    rows = [(1, x, y) for x, y in box(angle, 1801, 601, 0.2)]
    (r,) = skew.angles(spark.createDataFrame(rows, "page int, x int, y int").repartition(4), "page").collect()
    got = r.angle - 90 if r.angle > 45 else r.angle
    assert abs(got - angle) < 0.1 and r.pixels == len(rows)


def test_hull_is_that_of_all_points():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 60, (500, 2))
    h = skew.hull(p)
    d = np.roll(h, -1, axis=0) - h
    for a, e in zip(h, d, strict=True):  # all points are left of every edge
        assert (e[0] * (p[:, 1] - a[1]) - e[1] * (p[:, 0] - a[0]) >= 0).all()


def test_points_and_lines(spark):
    rows = [(1, 5, 5)] + [(2, k, 2 * k) for k in range(50)] + [(3, k, 7) for k in range(9)] + [(3, 4, 7)]
    got = {r.page: r for r in skew.angles(spark.createDataFrame(rows, "page int, x int, y int"), "page").collect()}
    assert (got[1].angle, got[1].pixels) == (0.0, 1) and abs(got[2].angle - math.degrees(math.atan(2))) < 1e-9 and (got[3].angle, got[3].width, got[3].pixels) == (0.0, 8.0, 10)
    assert skew.angles(spark.createDataFrame([], "page int, x int, y int"), "page").count() == 0 and F is not None


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_batches_of_pixels_keep_all_corners(spark, size):
    rng = np.random.default_rng(size)
    rows = [(p, int(x), int(y)) for p in ("a", "b", None) for x, y in rng.integers(-90, 90, (300, 2)) * (1, 7)] + [("c", k, k * k) for k in range(-40, 40)] + [("far", 0, 0), ("far", 1 << 30, 3), ("far", 5, 1 << 30)]
    rng.shuffle(rows)
    t = spark.createDataFrame([(p, int(x), int(y)) for p, x, y in rows] + [("a", None, 3), ("b", 3, None)], "page string, x long, y long")
    want = {p: (*skew.rectangle(np.array([(int(x), int(y)) for q, x, y in rows if q == p])), sum(q == p for q, _, _ in rows)) for p in {p for p, _, _ in rows}}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r.page: (r.angle, r.width, r.height, r.pixels) for r in skew.angles(t, "page").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_few_points_of_a_page_are_shuffled(spark):
    rows = [(1, x, y) for x, y in box(7, 601, 301)]
    assert skew.corners(spark.createDataFrame(rows, "page int, x int, y int").coalesce(1), "page").count() < len(rows) / 100
