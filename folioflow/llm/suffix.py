"""Removal of repeated 100-byte strings with suffix arrays.

A byte goes if some 100-byte string that covers it also starts earlier: in a
document of smaller id, or earlier in the same document. The work is exact:

1.  Anchors. Every window of 100 bytes picks the 32-byte string of smallest
    hash inside it; equal windows pick the same one at the same place. A
    window can only repeat if its anchor does. Tasks deal out the anchors of
    their texts by hash, one entry for each distinct anchor of a slice, and
    learn which ones occur twice or more anywhere.
2.  Contexts. A repeated anchor brings the bytes of the windows that picked it,
    168 at most. Contexts are dealt out by anchor; anchors with very many
    contexts are split over several shards.
3.  Shards. A shard sorts the suffixes of its distinct contexts by
    Larsson-Sadakane refinement, finds common prefixes by Kasai's rule, all
    contexts in step, and so groups equal windows and their first place.
4.  Merging. For split anchors every shard hands on its sorted first windows;
    they are merged by binary search, on their bytes, in the sorted list of all.
5.  Spans. What is not first is covered; per document the spans are joined.

Documents with equal ids are ordered by a hash of their text; rows that repeat
an id and a text are one document listed repeatedly and get one answer. Rows
without an id share one that is smaller than all others.

Defined cases: null and empty texts, and texts shorter than a window, lose
nothing; further columns are kept by ``remove`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import storage
from folioflow.llm import tokens as T

WINDOW = 100
GRAM = 32
REACH = WINDOW - GRAM  #: a window starts at most so far before its anchor
CONTEXT = WINDOW + REACH
GAP = 0xFF  #: never a byte of UTF-8
RADIX = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
POWERS = np.array([pow(RADIX, GRAM - 1 - j, 2**64) for j in range(GRAM)], np.uint64)
CONTEXT_POWERS = np.array([pow(0xC2B2AE3D27D4EB4F, j + 1, 2**64) for j in range(CONTEXT)], np.uint64)
#: Anchors with more occurrences than this are split over shards.
HOT = 24_576
SHARD_BYTES = 3 << 20


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte strings, by doubling."""
    h, step = TABLE[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(RADIX, step, 2**64)) + h[step:]
        step *= 2
    return finish(h)


def hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 16):
        part = at[lo : lo + (1 << 16)]
        out[lo : lo + len(part)] = (TABLE[data[part[:, None] + np.arange(GRAM)]] * POWERS).sum(1, dtype=np.uint64)
    return finish(out)


def sliding(x: np.ndarray, width: int, what) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = what(x[:-size], x[size:]), size * 2
    rest = width - size
    return what(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of one text and their hashes. An anchor owns the windows in which it has the smallest hash, of equal ones the last; they are neighbours.

    An anchor is packed as place * 2^16 + (place - first window) * 2^8 + (place - last window).
    """
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    width = REACH + 1
    least = sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == sliding(np.concatenate([pad, least, pad]), width, np.maximum))
    own = h[at]
    lo, hi = np.maximum(at - REACH, 0), np.minimum(at, len(data) - WINDOW)
    for k in range(1, width + 1):  # neighbours that are smaller, or equal and later, bound the windows
        if k >= len(at):
            break
        near = np.flatnonzero(at[k:] - at[:-k] <= REACH)
        if not len(near):
            break
        i, j = near, near + k
        less = own[i] < own[j]
        np.maximum.at(lo, j[less], at[i[less]] + 1)
        np.minimum.at(hi, i[~less], at[j[~less]] - width)
    use = lo <= hi
    at, lo, hi = at[use], lo[use], hi[use]
    return at << 16 | (at - lo) << 8 | (at - hi), own[use]


def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window."""
    at = code >> 16
    return at, at - (code >> 8 & 255), at - (code & 255)


# -- suffix arrays -------------------------------------------------------------
def suffix_array(data: np.ndarray) -> np.ndarray:
    """Sorted suffixes by Larsson and Sadakane's doubling, in which groups of one are left alone.

    Every GAP byte counts as a letter of its own, larger than all bytes and
    than all gaps before it, and the data end with one. So suffixes end at
    their first gap and no two are equal.
    """
    n = len(data)
    gaps = np.flatnonzero(data == GAP)
    to_gap = gaps[np.searchsorted(gaps, np.arange(n))] - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.where(to_gap >= k, padded[k : k + n], 0).astype(np.uint64)
    sa = np.argsort(key)
    short = np.flatnonzero(to_gap[sa] < 8)
    ends = sa[short]
    sa[short] = ends[np.lexsort((ends, key[ends]))]
    new = np.ones(n, bool)
    new[1:] = (key[sa][1:] != key[sa][:-1]) | (to_gap[sa][1:] < 8)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    h = 8
    while True:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            return sa
        pos = sa[slots]
        both = group[slots] << 32 | rank[pos + h]
        order = np.argsort(both)
        pos, both = pos[order], both[order]
        sa[slots] = pos
        first = np.ones(len(slots), bool)
        first[1:] = both[1:] != both[:-1]
        new[slots] = first
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[pos] = group[slots]
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of suffixes with their predecessors in ``sa``, up to ``most`` bytes, by Kasai's rule: one step to the right loses at most one byte.

    Runs of ``lengths`` suffixes that begin at ``starts`` are walked together; 0 elsewhere.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(most + 1, np.uint8)])
    held = np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max(initial=0))):
        run = np.flatnonzero(step < lengths)
        i = starts[run] + step
        j = before[i]
        h = np.maximum(held[run] - 1, 0)
        grow = np.flatnonzero((j >= 0) & (h < most))
        while len(grow):
            grow = grow[padded[i[grow] + h[grow]] == padded[j[grow] + h[grow]]]
            h[grow] += 1
            grow = grow[h[grow] < most]
        h[j < 0] = 0
        lcp[i] = h
        held[run] = h
    return lcp


def equal_windows(contexts: pa.Array) -> tuple[np.ndarray, ...]:
    """All windows of the contexts: their places in the joined bytes, contexts, offsets and groups, and the joined bytes. Equal windows have equal groups.

    Between two equal windows the order holds only windows equal to both, so
    neighbours suffice.
    """
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(contexts)], pa.int32()), contexts), bytes([GAP]))[0].as_py() + bytes([GAP])
    data = np.frombuffer(joined, np.uint8)
    size = pc.binary_length(contexts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(size + 1) - size - 1
    lengths = np.maximum(size - WINDOW + 1, 0)
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa, starts, lengths, WINDOW)
    owner = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(data)) - starts[owner]
    at = sa[offset[sa] < lengths[owner[sa]]]
    return at, owner[at], offset[at], np.cumsum(lcp[at] < WINDOW), data


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at the given places: they say where windows meet, not whether they are equal."""
    h, step, parts = TABLE[data], 1, {}
    while step <= 64:
        parts[step] = h
        if step < 64:
            h = h[:-step] * np.uint64(pow(RADIX, step, 2**64)) + h[step:]
        step *= 2
    k = parts[64][at] * np.uint64(pow(RADIX, 36, 2**64)) + parts[32][at + 64] * np.uint64(pow(RADIX, 4, 2**64)) + parts[4][at + 96]
    return finish(k).view(np.int64)


def window_bytes(data: np.ndarray, at: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(data[at[:, None] + np.arange(WINDOW)])
    edge = np.arange(0, WINDOW * len(at) + 1, WINDOW, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edge), pa.py_buffer(flat)])


def as_strings(windows: pa.Array) -> np.ndarray:
    """Windows as strings of fixed length, which numpy orders by their bytes."""
    off, data = T.buffers(windows)
    return np.ascontiguousarray(data[off[0] : off[-1]]).view(f"S{WINDOW}")


# -- stage 1: repeated anchors ---------------------------------------------------
def _u(x: np.ndarray) -> pa.Scalar:
    return np.ascontiguousarray(x).tobytes()


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def repeated_anchors(src: DataFrame, buckets: int) -> DataFrame:
    """kind 0: (doc_id, h, n = bytes of the text, places of repeated anchors); kind 1: (doc_id = hash, n = shards) of hot anchors."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, limit=16 << 20):
                ids = part.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                own = part.column("h").to_numpy(zero_copy_only=False)
                off, data = T.buffers(pc.fill_null(part.column("text"), ""))
                doc, at, hs = [], [], []
                for k in range(part.num_rows):
                    p, h = anchors(data[off[k] : off[k + 1]])
                    doc.append(np.full(len(p), k, np.int32))
                    at.append(p)
                    hs.append(h)
                doc, at, hs = (np.concatenate(x) for x in (doc, at, hs))
                if not len(hs):
                    continue
                size = np.diff(off)
                order = np.argsort(hs, kind="stable")
                s = hs[order]
                first = np.ones(len(s), bool)
                first[1:] = s[1:] != s[:-1]
                edge = np.flatnonzero(first)
                count = np.diff(np.append(edge, len(s)))
                twice = np.repeat(count > 1, count)
                rows = []
                local = np.sort(order[twice])  # in the order of documents and places
                cut = np.searchsorted(doc[local], np.arange(part.num_rows + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    rows.append((int(ids[k] ^ own[k]) % buckets, 0, int(ids[k]), int(own[k]), int(size[k]), _u(at[local[cut[k] : cut[k + 1]]])))
                rep, n = order[edge], count
                b = (hs[rep] >> np.uint64(40)) % np.uint64(buckets)
                to = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[to], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    r = rep[to[cut[k] : cut[k + 1]]]
                    d, back = np.unique(doc[r], return_inverse=True)
                    head = np.array([len(r), len(d)], np.int64)
                    parts = [head, hs[r], ids[d], own[d], size[d].astype(np.int64), back.astype(np.int32), at[r], np.minimum(n[to[cut[k] : cut[k + 1]]], 2**31 - 1).astype(np.int32)]
                    rows.append((k, 1, 0, 0, 0, b"".join(map(_u, parts))))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "kind", "doc_id", "h", "n", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for batch in batches:
            out = []
            for bucket, kind, doc, h, n, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "doc_id", "h", "n", "blob")), strict=True):
                if kind == 0:
                    out.append((0, doc, h, n, blob))
                    continue
                if bucket != now and held:
                    yield from decided(held)
                    held = []
                now = bucket
                held.append(blob)
            if out:
                yield rows_of(out)
        if held:
            yield from decided(held)

    def decided(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        hs, doc, at, n, ids, own, size, base = [], [], [], [], [], [], [], 0
        for b in blobs:
            m, d = np.frombuffer(b, np.int64, 2).tolist()
            p = 16
            for store, kind, k in ((hs, np.uint64, m), (ids, np.int64, d), (own, np.int64, d), (size, np.int64, d), (doc, np.int32, m), (at, np.int64, m), (n, np.int32, m)):
                store.append(np.frombuffer(b, kind, k, p))
                p += store[-1].nbytes
            doc[-1] = doc[-1].astype(np.int64) + base
            base += d
        hs, doc, at, n, ids, own, size = map(np.concatenate, (hs, doc, at, n, ids, own, size))
        order = np.argsort(hs, kind="stable")
        s = hs[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        edge = np.flatnonzero(first)
        count = np.diff(np.append(edge, len(s)))
        total = np.add.reduceat(n[order].astype(np.int64), edge)
        new = np.repeat(count > 1, count) & (n[order] == 1)  # those with n > 1 are known where they are
        use = order[new]
        use = use[np.lexsort((at[use], doc[use]))]
        # the same document may stand under several numbers: one for each slice
        cut = np.flatnonzero(np.diff(doc[use], prepend=-1))
        ends = np.append(cut, len(use))[1:]
        out = [(0, int(ids[doc[use[a]]]), int(own[doc[use[a]]]), int(size[doc[use[a]]]), _u(at[use[a:b]])) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
        out += [(1, int(v), 0, int(-(-t // HOT)), b"") for v, t in zip(s[edge].view(np.int64)[total > HOT].tolist(), total[total > HOT].tolist(), strict=True)]
        for lo in range(0, len(out), 50_000):
            yield rows_of(out[lo : lo + 50_000])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "doc_id", "h", "n", "places"])

    dealt = src.select("doc_id", "h", "text").mapInArrow(deal, "bucket int, kind int, doc_id long, h long, n long, blob binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "kind int, doc_id long, h long, n long, places binary")


# -- stages 2 to 4: contexts, shards, merging --------------------------------------
def contexts(found: DataFrame) -> DataFrame:
    """found: doc_id, h, text, places (array of blobs). One row for each repeated anchor: the bytes of the windows that it owns. Of equal contexts of a slice only the first is kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, limit=16 << 20):
                ids, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
                off, data = T.buffers(part.column("text"))
                places = [np.unique(np.frombuffer(b"".join(p), np.int64)) for p in part.column("places").to_pylist()]
                doc = np.repeat(np.arange(part.num_rows), [len(p) for p in places])
                code = np.concatenate(places)
                rank = np.lexsort((own, ids))
                turn = np.empty(len(rank), np.int64)
                turn[rank] = np.arange(len(rank))
                for lo in range(0, len(code), 1 << 15):
                    d, c = doc[lo : lo + (1 << 15)], code[lo : lo + (1 << 15)]
                    p, first, last = unpack(c)
                    begin = off[d]
                    size = last - first + WINDOW
                    where = (begin + first)[:, None] + np.arange(CONTEXT)
                    rows = np.where(np.arange(CONTEXT) < size[:, None], data[np.minimum(where, len(data) - 1)], GAP).astype(np.uint8)
                    anchor = hashes_at(data, begin + p)
                    mark = finish((rows * CONTEXT_POWERS).sum(1, dtype=np.uint64))
                    order = np.lexsort((first, turn[d], mark, anchor))
                    same = np.zeros(len(order), bool)
                    same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (mark[order][1:] == mark[order][:-1]) & (rows[order][1:] == rows[order][:-1]).all(1)
                    keep = order[~same]
                    flat = rows[keep][np.arange(CONTEXT) < size[keep][:, None]]
                    edge = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
                    texts = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(edge), pa.py_buffer(flat)])
                    yield pa.record_batch([pa.array(anchor[keep].view(np.int64)), texts, pa.array(ids[d[keep]]), pa.array(own[d[keep]]), pa.array(p[keep].astype(np.int32)), pa.array(first[keep].astype(np.int32))], ["anchor", "context", "doc_id", "h", "place", "first"])

    return found.mapInArrow(cut, "anchor long, context binary, doc_id long, h long, place int, first int")


SHARD_NAMES = ["doc_id", "h", "place", "covered", "key", "window", "start", "shard"]
SHARD_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
SHARD_SCHEMA = "doc_id long, h long, place int, covered array<int>, key long, window binary, start int, shard int"


def shard_results(dealt: DataFrame) -> DataFrame:
    """dealt: rows of ``contexts`` with shard and split, sorted by (anchor, shard).

    Rows with null start: a context with windows that nothing precedes, and its
    covered starts [from, to, ...]. Other rows: such a window of a split anchor,
    to be merged with other shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, shard = batch.column("anchor").to_numpy(), batch.column("shard").to_numpy()
            begin = np.ones(len(anchor), bool)
            begin[1:] = (anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1])
            begin[0] = last != (int(anchor[0]), int(shard[0]))
            last = (int(anchor[-1]), int(shard[-1]))
            total = np.cumsum(pc.binary_length(batch.column("context")).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            for k in np.flatnonzero(begin).tolist():  # a shard may end where a new anchor begins
                here = size + int(total[k - 1] - (total[at - 1] if at else 0)) if k > at else size
                if here > SHARD_BYTES:
                    if k > at:
                        held.append(batch.slice(at, k - at))
                    yield from solved(held)
                    held, size, at = [], 0, k
            held.append(batch.slice(at))
            size += int(total[-1] - (total[at - 1] if at else 0))
        if held:
            yield from solved(held)

    def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        anchor, doc, own, place, first, shard, split = (t[c].to_numpy() for c in ("anchor", "doc_id", "h", "place", "first", "shard", "split"))
        code = t["context"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((first, own, doc, code, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (code[order][1:] != code[order][:-1])
        use = order[new]  # the first place of each distinct context of an anchor
        if len(use) > 1:  # an anchor with one context, not split, has nothing to compare
            a = anchor[use]
            lone = np.ones(len(a), bool)
            lone[1:] &= a[1:] != a[:-1]
            lone[:-1] &= a[:-1] != a[1:]
        else:
            lone = np.ones(len(use), bool)
        lone &= split[use] == 1
        alone, use = use[lone], use[~lone]
        if len(alone):
            none = [pa.nulls(len(alone), kind) for kind in SHARD_TYPES[4:]]
            empty = pa.array([[]], SHARD_TYPES[3]).take(pa.array(np.zeros(len(alone), np.int64)))
            cols = [pa.array(doc[alone]), pa.array(own[alone]), pa.array(place[alone]), empty, *none]
            yield pa.record_batch(cols, SHARD_NAMES)
        if not len(use):
            return
        texts = t["context"].combine_chunks().take(pa.array(use))
        doc, own, place, first, shard, split = (x[use] for x in (doc, own, place, first, shard, split))
        at, where, offset, group, data = equal_windows(texts)
        rank = np.lexsort((own, doc))  # documents in order, as numbers
        turn = np.empty(len(rank), np.int64)
        step = np.ones(len(rank), bool)
        step[1:] = (doc[rank][1:] != doc[rank][:-1]) | (own[rank][1:] != own[rank][:-1])
        turn[rank] = np.cumsum(step)
        start = (first[where] + offset).astype(np.int64)
        mine = turn[where] << 32 | start
        head = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.minimum.reduceat(mine, head)
        is_first = mine == np.repeat(least, np.diff(np.append(head, len(group))))
        fresh = np.bincount(where[is_first], minlength=len(use))
        # covered runs of every context
        order = np.lexsort((start, where))
        w, s, gone = where[order], start[order], ~is_first[order]
        joined = np.zeros(len(w), bool)
        joined[1:] = (w[1:] == w[:-1]) & (s[1:] == s[:-1] + 1)
        opens = gone & ~(joined & np.append(False, gone[:-1]))
        closes = gone & ~np.append(joined[1:] & gone[1:], False)
        runs = np.stack([s[opens], s[closes] + 1], 1).astype(np.int32)
        count = np.bincount(w[opens], minlength=len(use))
        shown = fresh > 0
        runs = runs[shown[w[opens]]].ravel()
        edge = np.concatenate([[0], np.cumsum(2 * count[shown])]).astype(np.int32)
        covered = pa.ListArray.from_arrays(pa.array(edge), pa.array(runs))
        n = int(shown.sum())
        none = [pa.nulls(n, kind) for kind in SHARD_TYPES[4:]]
        yield pa.record_batch([pa.array(doc[shown]), pa.array(own[shown]), pa.array(place[shown]), covered, *none], SHARD_NAMES)
        hand = np.flatnonzero(is_first & (split[where] > 1))
        if len(hand):
            for lo in range(0, len(hand), 100_000):
                part = hand[lo : lo + 100_000]
                x = where[part]
                cols = [pa.array(doc[x]), pa.array(own[x]), pa.array(place[x]), pa.nulls(len(x), SHARD_TYPES[3]), pa.array(window_hashes(data, at[part])), window_bytes(data, at[part]), pa.array(start[part].astype(np.int32)), pa.array(shard[x])]
                yield pa.record_batch(cols, SHARD_NAMES)

    return dealt.mapInArrow(run, SHARD_SCHEMA)


def merge_shards(windows: DataFrame, tasks: int) -> DataFrame:
    """First windows of split anchors from all shards; those that another shard has earlier come back as covered.

    Windows meet by their hash; each shard's sorted run is then looked up, by
    binary search on the bytes themselves, in the sorted list of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = now.column("key").to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1])
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield merged(now.slice(0, end))
            rest = now.slice(end)
        if rest is not None and rest.num_rows:
            yield merged(rest)

    def merged(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, own, place, start, shard = (part.column(c).to_numpy() for c in ("doc_id", "h", "place", "start", "shard"))
        window = as_strings(part.column("window"))
        order = np.lexsort((start, own, doc, window))
        head = np.ones(len(order), bool)
        head[1:] = window[order][1:] != window[order][:-1]
        lead = order[head]  # the first place of each distinct window, in the order of the windows
        known = window[lead]
        late = np.zeros(len(order), bool)
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            ahead = lead[np.searchsorted(known, window[mine])]
            late[mine] = (doc[mine] != doc[ahead]) | (own[mine] != own[ahead]) | (start[mine] != start[ahead])
        runs = np.stack([start[late], start[late] + 1], 1).astype(np.int32).ravel()
        covered = pa.ListArray.from_arrays(pa.array(np.arange(0, len(runs) + 1, 2, dtype=np.int32)), pa.array(runs))
        return pa.record_batch([pa.array(doc[late]), pa.array(own[late]), pa.array(place[late]), covered], ["doc_id", "h", "place", "covered"])

    met = windows.repartition(tasks, "key").sortWithinPartitions("key")
    return met.mapInArrow(run, "doc_id long, h long, place int, covered array<int>")


# -- stage 5 -----------------------------------------------------------------------
def covered_spans(n: int, codes: np.ndarray, firsts: dict[int, list]) -> np.ndarray:
    """Maximal covered spans [from, to, ...] of a text of n bytes: all windows of an anchor whose context comes earlier, and what ``firsts`` names of the others."""
    place, lo, hi = unpack(codes)
    if firsts:
        full = ~np.isin(place, np.fromiter(firsts, np.int64, len(firsts)))
        lo, hi = lo[full], hi[full]
        ranges = np.array([x for r in firsts.values() for x in r], np.int64).reshape(-1, 2)
        lo, hi = np.concatenate([lo, ranges[:, 0]]), np.concatenate([hi, ranges[:, 1] - 1])
    if not len(lo):
        return np.zeros(0, np.int64)
    order = np.argsort(lo)
    lo, end = lo[order], np.maximum.accumulate(hi[order] + WINDOW)
    cut = np.flatnonzero(lo[1:] > end[:-1])
    return np.stack([lo[np.append(0, cut + 1)], end[np.append(cut, len(end) - 1)]], 1).ravel()


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)  # the cleaner works beside us


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, spans): the covered spans of every document that has any."""
    spark = df.sparkSession
    storage.on_workers(spark)
    # one stand-in on both sides of every join
    src = numbered(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * spark.sparkContext.defaultParallelism
    tasks, buckets = max(least, int(total >> 24)), max(least, int(total >> 26))  # by the bytes of the input, not by a setting
    found = storage.settle(repeated_anchors(src, buckets), "anchors")
    free(spark)
    places = found.filter("kind = 0").groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.collect_list("places").alias("places"))
    places = storage.settle(places, "places")
    # written on its own, so that its true size decides how it is joined
    hot = storage.settle(found.filter("kind = 1").select(F.col("doc_id").alias("anchor"), F.col("n").cast("int").alias("split")), "hot-anchors")
    storage.discard(spark, found)
    free(spark)
    near = contexts(src.filter("text IS NOT NULL").join(places.select("doc_id", "h", "places").hint("shuffle_hash"), ["doc_id", "h"]).select("doc_id", "h", "text", "places"))
    dealt = near.join(hot, "anchor", "left").withColumn("split", F.coalesce("split", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "place"), F.col("split")).cast("int"))
    dealt = dealt.repartition(tasks, "anchor", "shard").sortWithinPartitions("anchor", "shard")
    solved = storage.settle(shard_results(dealt), "shards")
    free(spark)
    own = solved.filter("start IS NULL").select("doc_id", "h", "place", "covered")
    more = merge_shards(solved.filter("start IS NOT NULL").select("doc_id", "h", "place", "key", "window", "start", "shard"), tasks)
    firsts = own.union(more).groupBy("doc_id", "h").agg(F.collect_list(F.struct("place", "covered")).alias("firsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, h, n, blobs, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "n", "places", "firsts")), strict=True):
                by: dict[int, list] = {}
                for f in first or ():
                    by.setdefault(f["place"], []).extend(f["covered"] or ())
                spans = covered_spans(n, np.unique(np.frombuffer(b"".join(blobs), np.int64)), by)
                if len(spans):
                    out.append((doc, h, spans.astype(np.int32)))
            if out:
                doc, h, spans = zip(*out, strict=True)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "h", "spans"])

    joined = places.join(firsts, ["doc_id", "h"], "left")
    spans = storage.settle(joined.mapInArrow(run, "doc_id long, h long, spans array<int>"), "spans")
    for done in (solved, places, hot):
        storage.discard(spark, done)
    free(spark)
    return spans


def without(data: bytes, spans: list[int] | None) -> bytes:
    if not spans:
        return data
    edge = [0, *spans, len(data)]
    return b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeats(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cut in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                kept = without(data, cut)
                out.append((len(data), len(data) - len(kept), len(cut or ()) // 2, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.record_batch([batch.column("doc_id"), *map(pa.array, zip(*out, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = numbered(df, id_col, text_col).withColumn("_n", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).join(spans.withColumnRenamed("doc_id", "_n").hint("shuffle_hash"), ["_n", "h"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with repeated bytes cut out of the text; halves of cut characters go too, and ``length_col`` is set anew."""
    return storage.plainly(df, lambda plain: _removed(plain, id_col, text_col, length_col))


def _removed(df: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    columns = df.columns
    n, h, gone = storage.unused(columns, "_n", "_h", "_spans")
    spans = repeats(df, id_col, text_col).select(F.col("doc_id").alias(n), F.col("h").alias(h), F.col("spans").alias(gone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = batch.column(gone).to_pylist()
            texts = batch.column(text_col).to_pylist()
            texts = [without(t.encode(), c).decode(errors="ignore") if c else t for t, c in zip(texts, cut, strict=True)]
            cols = {c: batch.column(c) for c in columns}
            cols[text_col] = pa.array(texts, batch.schema.field(text_col).type)
            if length_col in cols:
                length = pc.utf8_length(cols[text_col]).cast(cols[length_col].type)
                cols[length_col] = pc.if_else(pa.array([bool(c) for c in cut]), length, cols[length_col])
            yield pa.record_batch(list(cols.values()), list(cols))

    keyed = df.withColumn(n, F.coalesce(F.col(storage.quoted(id_col)).cast("long"), F.lit(-(2**63)))).withColumn(h, F.xxhash64(F.col(storage.quoted(text_col))))
    return keyed.join(spans.hint("shuffle_hash"), [n, h], "left").select(*map(storage.quoted, columns), gone).mapInArrow(run, df.schema)
