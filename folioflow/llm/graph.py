"""Connected components of a large graph, by large-star and small-star rounds.

Every round is two joins on written tables, so lineage stays short and a lost
executor repeats one round at most. A node with very many edges is a hot join
key that adaptive execution splits; minima are summed up before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(a: np.ndarray, b: np.ndarray, chunk_roots: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, smallest node) with the components of the given edges."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = back[: len(a)], back[len(a) :]
    while True:  # hook to the smaller label, then jump to the root
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def contract(edges: DataFrame, hold: int = 1 << 20) -> DataFrame:
    """Replace the edges that a task holds, at most ``hold`` at a time, by a star forest of the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(a) > hold:
                a, b = forest(a, b)
                if len(a) > hold // 2:
                    yield pa.record_batch([a, b], ["a", "b"])
                    a, b = a[:0], b[:0]
        if len(a):
            a, b = forest(a, b)
            yield pa.record_batch([a, b], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to a smaller one; a component's smallest node is left out.

    edges: long columns a, b in any order, repeats and loops allowed.
    """
    storage.on_workers(edges.sparkSession)
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = storage.settle(contract(e), "edges")
    mark = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = large.join(least, large["a"] == least["u"])
        small = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, e = e, storage.settle(small.distinct(), "edges")
        storage.discard(e.sparkSession, before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
