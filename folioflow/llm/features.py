"""Hashed text features for the two linear models.

A feature is a lower-cased run of letters, its first four letters if it has
more, a digit, a run of symbols, or "the same word again", hashed into a fixed number of slots. Only distinct pieces of
a batch are hashed. A document's value for a slot of letters or digits is
log(1 + occurrences); for a slot of symbols and for repeated words it is three
times the root of their share of the words, so that long texts do not gather it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage
from folioflow.llm import tokens as T

SLOTS = 1 << 18


def slots_of(pieces: list[str]) -> np.ndarray:
    """Even slots for runs of letters and digits, odd ones for symbols."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(p) % SLOTS & ~1 | (not p[:1].isalnum()) for p in pieces), np.int32, len(pieces))


AGAIN = int(slots_of(["\x00again"])[0])


def occurrences(texts: pa.Array, cutter: T.WordBpe, keep: np.ndarray | None = None, tokens: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Text numbers and slots of all occurrences, words per text and, if asked, ids per text; ``keep`` masks the slots of interest."""
    codes, n_words, words = T.split_words(texts)
    n = len(n_words)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), n_words, np.zeros(n, np.int64) if tokens else None
    cut = pieces, flat, n_pieces, odd = cutter.cut_words(words)
    ids = T.sums(cutter.count_words(words, cut)[codes], n_words) if tokens else None
    texts_of = pieces.to_pylist()
    heads = slots_of([p[:4] + "-" for p in texts_of])
    heads[[len(p) <= 4 or not p[0].isalpha() for p in texts_of]] = -1
    slot = np.stack([slots_of(texts_of), heads], 1)[flat].ravel() if len(flat) else np.zeros(0, np.int32)
    n_pieces = 2 * n_pieces
    if odd:  # words of other scripts are one piece each
        at = np.cumsum(n_pieces)[odd] - n_pieces[odd]
        slot = np.insert(slot, at, slots_of([w.lower() for w in words.take(pa.array(odd)).to_pylist()]))
        n_pieces[odd] = 1
    wanted = slot >= 0 if keep is None else keep[slot] & (slot >= 0)
    n_pieces = T.sums(wanted.astype(np.int64), n_pieces)
    slot = slot[wanted]
    doc = np.repeat(np.arange(n, dtype=np.int32), n_words)
    got, spread = T.gather(slot, n_pieces, codes)
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) + 1
    return np.concatenate([np.repeat(doc, spread), doc[again]]), np.concatenate([got, np.full(len(again), AGAIN, np.int32)]), n_words, ids


def grouped(doc: np.ndarray, slot: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs in order, with their values."""
    key, n = np.unique(doc.astype(np.int64) * SLOTS + slot, return_counts=True)
    d, s = (key // SLOTS).astype(np.int32), (key % SLOTS).astype(np.int32)
    return d, s, np.where(s & 1, 3 * np.sqrt(n / np.maximum(n_words[d], 1)), np.log1p(n)).astype(np.float32)


class LinearScores:
    """Scores of texts under one or more columns of slot weights."""

    def __init__(self, weights: np.ndarray, tokenizer: str):
        self.weights = weights.reshape(SLOTS, -1)
        self.keep = (self.weights != 0).any(1)
        self.cutter = T.load(tokenizer)

    def __call__(self, texts: pa.Array, tokens: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(texts, columns) scores and words, or ids, per text."""
        doc, slot, n_words, ids = occurrences(texts, self.cutter, self.keep, tokens)
        d, s, x = grouped(doc, slot, n_words)
        out = np.stack([np.bincount(d, x * self.weights[s, k], len(n_words)) for k in range(self.weights.shape[1])], 1)
        return out, ids if tokens else n_words


def bounded_sample(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """One row a key, its smallest, of about ``rows`` keys at most, chosen by the key's hash; of all keys if there are no more."""
    n = labelled.select(key).distinct().count()
    chance = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_003)) < int(1_000_003 * rows / max(n, 1))
    some = labelled if n <= rows else labelled.filter(chance)
    rest = [c for c in labelled.columns if c != key]
    return some.groupBy(key).agg(F.min(F.struct(*rest)).alias("least")).select(key, *(F.col("least")[c].alias(c) for c in rest))


def training_rows(sample: DataFrame, label_col: str, tokenizer: str, least_docs: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, slots and values of a bounded sample (columns text and ``label_col``), and its labels. Slots of fewer than ``least_docs`` rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = T.load(tokenizer)
        for batch in batches:
            for part in T.slices(batch, limit=4 << 20):
                doc, slot, n_words, _ = occurrences(part.column("text"), cutter)
                d, s, x = grouped(doc, slot, n_words)
                edge = np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v)) for v in (s, x)]
                yield pa.record_batch([part.column("label"), *lists], ["label", "slots", "vals"])

    storage.on_workers(sample.sparkSession)
    src = sample.select(F.col("text"), F.col(label_col).cast("int").alias("label"))
    got = src.mapInArrow(run, "label int, slots array<int>, vals array<float>").toArrow()
    label = got["label"].to_numpy()
    slots, vals = got["slots"].combine_chunks(), got["vals"].combine_chunks()
    row = np.repeat(np.arange(len(label), dtype=np.int32), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
    slot, val = slots.flatten().to_numpy(), vals.flatten().to_numpy()
    del got, slots, vals
    often = np.bincount(slot, minlength=SLOTS) >= least_docs
    use = often[slot]
    row, slot, val = row[use], slot[use], val[use]
    # the order in which tasks end must not change the model
    mark = np.bincount(row, (slot.astype(np.float32) * np.float32(1e-3) + 1) * val, len(label))
    rank = np.empty(len(label), np.int32)
    rank[np.lexsort((label, mark))] = np.arange(len(label), dtype=np.int32)
    order = np.argsort(rank[row], kind="stable")
    return rank[row][order], slot[order], val[order], label[np.argsort(rank)]


def adam(params: list[np.ndarray], gradient, steps: int, rate: float, project=None) -> None:
    """Full-batch Adam in place; ``gradient(params)`` returns one gradient per array, ``project(params)`` follows each step."""
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(params), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        if project is not None:
            project(params)
