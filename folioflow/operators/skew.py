"""The skew of a page from its dark pixels: the smallest rectangle around them.

Of every row of pixels only the first and the last dark one can be a corner of
the hull, and of those no one that lies inside the line between its neighbours
above and below. So a batch of pixels is brought down to few points a page where
it lies, in numpy, before anything is shuffled. Such points of parts of a page can
be joined again, and a page of any size ends in one small row: the convex hull
(monotone chain), and of all rectangles that have a side along one of its edges
(rotating calipers) the one of least area.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workers import on_workers

PASSES = 12  #: over a batch's points; what is left of them is still right, only more


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, against the clock; points on its edges are left out."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains: list[list[list[int]]] = []
    for order in (points.tolist(), points[::-1].tolist()):
        chain: list[list[int]] = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Angle (0 to 90 degrees, from x towards y), length along it and length across of the smallest rectangle around points; of equal ones the first by angle."""
    corners = hull(points).astype(np.float64)
    edges = np.roll(corners, -1, axis=0) - corners
    edges = edges[(edges != 0).any(1)]
    if not len(edges):
        return 0.0, 0.0, 0.0
    angles = np.unique(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2))
    along = corners @ np.stack([np.cos(angles), np.sin(angles)])
    across = corners @ np.stack([-np.sin(angles), np.cos(angles)])
    width, height = np.ptp(along, axis=0), np.ptp(across, axis=0)
    best = int((width * height).argmin())
    return float(np.degrees(angles[best])), float(width[best]), float(height[best])


def rows_of(page: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """page, y, first and last of every row of pixels, in order of page and y."""
    low = [int(c.min()) for c in (page, y, x)]
    size = [int(c.max()) - k + 1 for c, k in zip((page, y, x), low, strict=True)]
    if size[0] * size[1] * size[2] < 1 << 63:  # one number a pixel sorts faster than three
        key = np.sort(((page - low[0]) * size[1] + (y - low[1])) * size[2] + (x - low[2]))
        row, x = np.divmod(key, size[2])
        page, y = np.divmod(row, size[1])
        page, y, x = page + low[0], y + low[1], x + low[2]
    else:
        order = np.lexsort((x, y, page))
        page, y, x = page[order], y[order], x[order]
    cut = np.flatnonzero((page[1:] != page[:-1]) | (y[1:] != y[:-1])) + 1
    begin, end = np.append(0, cut), np.append(cut, len(page)) - 1
    return page[begin], y[begin], x[begin], x[end]


def outer(page: np.ndarray, y: np.ndarray, x: np.ndarray, side: int) -> np.ndarray:
    """Places of the points that may be corners on one side (1: left, -1: right); one point a row, in order of page and y."""
    at = np.arange(len(page))
    for _ in range(PASSES):
        p, v, u = page[at], y[at], x[at] * side
        inside = np.zeros(len(at), bool)
        a, b = v[1:-1] - v[:-2], v[2:] - v[1:-1]
        inside[1:-1] = (p[:-2] == p[2:]) & ((u[1:-1] - u[:-2]) * b >= (u[2:] - u[1:-1]) * a)
        if not inside.any():
            break
        at = at[~inside]
    return at


def corners(pixels: DataFrame, page: str) -> DataFrame:
    """page, x, y and n: points of parts of pages that hold all corners of their hulls, and pixels in number (those of a part stand in one of its points). pixels: page, x, y (dark ones)."""
    kind = pixels.schema[page].dataType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(1).null_count or batch.column(2).null_count:  # no places; a filter would have Spark work them out twice
                batch = batch.filter(pc.and_(batch.column(1).is_valid(), batch.column(2).is_valid()))
            if not batch.num_rows:
                continue
            named = batch.column(0).dictionary_encode(null_encoding="encode")
            of = named.indices.to_numpy().astype(np.int64)
            x, y = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            p, v, first, last = rows_of(of, y, x)
            left, right = outer(p, v, first, 1), outer(p, v, last, -1)
            p, u, v = np.concatenate([p[left], p[right]]), np.concatenate([first[left], last[right]]), np.concatenate([v[left], v[right]])
            n = np.zeros(len(p), np.int64)
            seen, where = np.unique(p, return_index=True)
            n[where] = np.bincount(of)[seen]
            yield pa.record_batch([named.dictionary.take(pa.array(p)), pa.array(u), pa.array(v), pa.array(n)], ["page", "x", "y", "n"])

    on_workers(pixels.sparkSession)
    dark = pixels.select(F.col(page).alias("page"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return dark.mapInArrow(reduce, f"page {kind}, x long, y long, n long")


def angles(pixels: DataFrame, page: str) -> DataFrame:
    """page, angle, width, height and pixels (dark ones) of every page with any. ``pixels.correction`` makes the turn of it."""
    kind = pixels.schema[page].dataType.simpleString()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            edges = points.offsets.to_numpy().tolist()
            first, last, y = (points.values.field(c).to_numpy() for c in ("first", "last", "y"))
            ends = np.stack([np.stack([first, y], 1), np.stack([last, y], 1)], 1)
            found = np.array([rectangle(ends[lo:hi].reshape(-1, 2)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)], np.float64).reshape(-1, 3)
            cols = [pa.array(found[:, k]) for k in range(3)]
            yield pa.record_batch([batch.column("page"), *cols, batch.column("pixels")], ["page", "angle", "width", "height", "pixels"])

    # one shuffle: rows of pixels meet where their page does, two points each however its pixels were dealt
    rows = corners(pixels, page).repartition("page").groupBy("page", "y").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.sum("n").alias("n"))
    pages = rows.groupBy("page").agg(F.collect_list(F.struct("first", "last", "y")).alias("points"), F.sum("n").alias("pixels"))
    return pages.mapInArrow(one, f"page {kind}, angle double, width double, height double, pixels long").withColumnRenamed("page", page)
