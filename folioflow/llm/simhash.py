"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint's 64 bits are cut into ``bits + 2`` blocks. Two fingerprints that
differ in at most ``bits`` bits agree on two blocks at least, so every pair of
blocks gives a table, keyed by the bits of both, in which such a pair meets.
Only distinct fingerprints are dealt out. A key's fingerprints are compared
with each other where they meet, and only a spanning forest of the verified
links leaves the task. Keys with more than ``bound`` fingerprints are handled
without comparing all pairs: if two fingerprints are at most two bits apart,
one value lies within one bit of both; every hot fingerprint emits its 65 such
values, and fingerprints that share one are linked to the smallest of them.

Defined cases: null, empty and white-space texts have fingerprint zero and are
linked like any other; fewer words than a shingle give one shingle of all;
repeated rows and ids each get a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import graph, storage
from folioflow.llm import tokens as T

SEED = 42
WEIGHT = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(data: bytes, words: int = 3) -> int:
    """The fingerprint of UTF-8 text, as an unsigned number."""
    parts = data.lower().split()  # of bytes: A-Z only, and the white space of ASCII only
    n = len(parts)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    flat = b" ".join(parts)
    if n <= words:
        return int.from_bytes(digest(flat, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    octets = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int(WEIGHT[2 * ones > n].sum())


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    storage.on_workers(df.sparkSession)
    src = df.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                text = pc.fill_null(part.column("text"), "").dictionary_encode()
                own = np.array([fingerprint(t.as_py().encode(), words) for t in text.dictionary], np.uint64).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(own[text.indices.to_numpy(zero_copy_only=False)])], ["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: int) -> list[int]:
    """For each pair of blocks the mask of their bits, as a signed long."""
    n = bits + 2
    edges = [64 * k // n for k in range(n + 1)]
    own = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(n)]
    return [m - 2**64 if m >= 2**63 else m for m in (a | b for a, b in combinations(own, 2))]


def near(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest over the fingerprints that differ in at most ``bits`` bits."""
    a, b = [], []
    plain = fps.view(np.uint64)
    for at in range(0, len(fps), 512):
        far = np.bitwise_count(plain[at : at + 512, None] ^ plain[None, at:])
        u, v = np.nonzero(far <= bits)
        later = v > u
        if later.any():
            x, y = graph.forest(fps[at + u[later]], fps[at + v[later]])
            a.append(x)
            b.append(y)
    if not a:
        return fps[:0], fps[:0]
    return graph.forest(np.concatenate(a), np.concatenate(b))


def links(distinct: DataFrame, bits: int = 2, bound: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join exactly what lies within ``bits`` bits of each other."""
    if bits > 2:
        raise ValueError("hot keys are exact for at most two bits")
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(block_masks(bits)))))
    keyed = distinct.select("fp", tables.alias("x")).select("fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > bound).select("t", "k")
    shared = keyed.join(sizes.filter(F.col("n").between(2, bound)).select("t", "k"), ["t", "k"], "left_semi")
    met = shared.repartition("t", "k").sortWithinPartitions("t", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            new = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("t", "k", "fp")], 1)
            held = np.concatenate([held, new])
            cut = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(1)) + 1
            if len(cut):
                yield from compared(held[: cut[-1]], np.concatenate([[0], cut]))
                held = held[cut[-1] :]
        if len(held):
            yield from compared(held, np.array([0, len(held)]))

    def compared(rows: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            x, y = near(np.ascontiguousarray(rows[lo:hi, 2]), bits)
            a.append(x)
            b.append(y)
        if a:
            yield pa.record_batch([np.concatenate(a), np.concatenate(b)], ["a", "b"])

    found = met.mapInArrow(run, "a long, b long")
    crowd = keyed.join(hot, ["t", "k"], "left_semi").select("fp").distinct()
    flips = [0] + [m - 2**64 if m >= 2**63 else m for m in (1 << k for k in range(64))]
    around = crowd.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m)) for m in flips))).alias("v"))
    least = around.groupBy("v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("v", "b")
    return found.union(around.join(least, "v").filter("fp <> b").select(F.col("fp").alias("a"), "b"))


def groups(df: DataFrame, bits: int = 2, words: int = 3, bound: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id reachable by links."""
    docs = storage.settle(fingerprints(df, words, id_col, text_col), "fingerprints")
    distinct = storage.settle(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    placed = graph.components(links(distinct, bits, bound))
    named = distinct.join(placed, distinct["fp"] == placed["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return docs.join(of, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group; of rows that repeat an id, all or none."""
    id_col = options.get("id_col", "doc_id")
    keep = groups(df, **options).filter("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    # the short side is hashed, so texts are dealt out but not sorted
    return df.join(keep.hint("shuffle_hash"), id_col, "left_semi")
