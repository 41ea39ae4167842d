"""Exact sub-word encoding of Arrow text columns, one distinct word at a time.

The tokenizer drops white space and never joins across it, so a text's ids are
the concatenation of the ids of its white-space separated words. Each batch is
split and dictionary-encoded by Arrow; only its distinct words are encoded.
Words of printable ASCII and the letters U+00C0 to U+00FF, without
apostrophe, are lower-cased, cut into runs of letters, single digits and runs
of symbols, and merged here, all distinct pieces of one length in one numpy
matrix; every other word, and any that may hold a special token, goes to the
``tokenizers`` library. Both roads give the library's ids.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
#: Texts are handled in slices of about so many bytes, which bounds memory.
SLICE_BYTES = 8 << 20
LONGEST_PIECE = 64

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

BREAK, LETTER, DIGIT, SYMBOL = range(4)
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[10] = BREAK
KINDS[ord("a") : ord("z") + 1] = LETTER
KINDS[0x80:] = LETTER
KINDS[ord("0") : ord("9") + 1] = DIGIT


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Open-addressed map of 64-bit keys to int32 that is probed a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 19):
        self.shift = np.uint64(64 - bits)
        self.mult = np.uint64(0x9E3779B97F4A7C15)
        size = 1 << bits
        self.keys = np.full(size + 64, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(size + 64, NONE, np.int32)
        slot = ((keys * self.mult) >> self.shift).astype(np.int64)
        self.probes = 1
        for k, v, s in zip(keys.tolist(), values.tolist(), slot.tolist(), strict=True):
            n = 1
            while int(self.keys[s]) != 2**64 - 1:
                s, n = s + 1, n + 1
            self.keys[s], self.values[s] = k, v
            self.probes = max(self.probes, n)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * self.mult) >> self.shift).astype(np.int64)
        found = self.keys[slot] == keys
        out = np.where(found, self.values[slot], NONE)
        open_ = np.flatnonzero(~found & (self.values[slot] != NONE))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = slot[open_] + step
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != NONE)]
        return out


class WordBpe:
    """Byte-level BPE with word ends, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # apostrophes may open a contraction, and "<|" a special token
        self.odd = re.compile(r"[^\x21-\x26\x28-\x7e\xc0-\xff\n]|<\|")
        symbols = byte_symbols()
        self.inner = np.full(256, NONE, np.int32)
        self.final = np.full(256, NONE, np.int32)
        for ch, b in symbols.items():
            self.inner[b], self.final[b] = vocab[ch], vocab[ch + self.end]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # the loop below orders merges by the id that they make
        assert (np.diff(made) > 0).all(), "ids must ascend with merge rank"
        self.pairs = PairTable(left << np.uint64(32) | right, made)
        size = int(made.max()) + 1
        self.split_left, self.split_right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.split_left[made], self.split_right[made] = left.astype(np.int32), right.astype(np.int32)
        self.strings = {i: s for s, i in vocab.items()}
        self.symbols = symbols

    def token_bytes(self, i: int) -> tuple[bytes, bool]:
        """The bytes of a token, and whether it ends a word."""
        s = self.strings[i]
        last = s.endswith(self.end)
        return bytes(self.symbols[c] for c in (s[: -len(self.end)] if last else s)), last

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair makes; NONE where no merge joins it."""
        return self.pairs.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))

    # -- distinct pieces -> ids ------------------------------------------------
    def merge_matrix(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces of one length, given as rows of bytes: the ids, left-aligned, and their counts."""
        n, width = data.shape
        ids = self.inner[data]
        ids[:, -1] = self.final[data[:, -1]]
        size = np.full(n, width, np.int64)
        if width == 1:
            return ids, size
        rank = self.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live, work = np.arange(n), ids.copy()
        while len(live):
            best = rank.argmin(1)
            rows = np.arange(len(live))
            go = rank[rows, best] != NONE
            if not go.all():
                ids[live[~go]] = work[~go]
                live, work, rank, best = live[go], work[go], rank[go], best[go]
                if not len(live):
                    break
                rows = np.arange(len(live))
            work[rows, best] = rank[rows, best]
            at = np.arange(work.shape[1] - 1)
            work[:, :-1] = np.take_along_axis(work, at + (at > best[:, None]), 1)
            size[live] -= 1
            length = size[live]
            work[rows, length] = -1
            if rank.shape[1] > 1:
                at = np.arange(rank.shape[1] - 1)
                rank[:, :-1] = np.take_along_axis(rank, at + (at >= best[:, None]), 1)
            rank[:, -1] = NONE
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side + 1 < length))
                rank[ok, side[ok]] = self.merged(work[ok, side[ok]], work[ok, side[ok] + 1])
        return ids, size

    def encode_pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of distinct pre-tokens."""
        off, data = buffers(pieces)
        length = np.diff(off)
        counts = np.zeros(len(length), np.int64)
        parts = []
        for width in np.unique(length).tolist():
            rows = np.flatnonzero(length == width)
            if not width:
                continue
            if width > LONGEST_PIECE:
                for r in rows.tolist():
                    got = self.encode_long(data[off[r] : off[r + 1]])
                    counts[r] = len(got)
                    parts.append((np.array([r]), got[None, :], np.array([len(got)])))
                continue
            ids, size = self.merge_matrix(data[off[rows][:, None] + np.arange(width)])
            counts[rows] = size
            parts.append((rows, ids, size))
        start = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(start[-1], np.int32)
        for rows, ids, size in parts:
            keep = np.arange(ids.shape[1]) < size[:, None]
            flat[(start[rows][:, None] + np.arange(ids.shape[1]))[keep]] = ids[keep]
        return flat, counts

    def encode_long(self, data: np.ndarray) -> np.ndarray:
        """A piece of unusual length: the library's own merge loop is faster than a matrix."""
        return np.array(self.library.encode(bytes(data).decode(), add_special_tokens=False).ids, np.int32)

    def cut_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[int]]:
        """Distinct pieces, each word's piece codes (flat) and their counts, and the words for the library."""
        joined = join_lines(words)
        odd: list[int] = []
        if at := [m.start() for m in self.odd.finditer(joined)]:
            ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            odd = np.unique(np.searchsorted(ends, at, "right")).tolist()
            plain = np.ones(len(words), bool)
            plain[odd] = False
            joined = join_lines(pc.if_else(pa.array(plain), words, ""))
        data = np.frombuffer(joined.lower().encode(), np.uint8)
        kind = KINDS[data]
        for sign in (0x97, 0xB7):  # the two signs among the letters U+00C0 to U+00FF
            lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] == sign))
            kind[lead] = kind[lead + 1] = SYMBOL
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == BREAK)
        start = np.flatnonzero(first)
        off = np.append(start, len(data)).astype(np.int32)
        piece = kind[start] != BREAK
        at = np.flatnonzero(~piece)
        n_pieces = np.diff(np.concatenate([[-1], at, [len(start)]])) - 1
        got = pa.StringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(data)).filter(pa.array(piece)).dictionary_encode()
        return got.dictionary, got.indices.to_numpy(zero_copy_only=False), n_pieces, odd

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of distinct words without white space."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pieces, codes, n_pieces, odd = self.cut_words(words)
        flat, counts = self.encode_pieces(pieces)
        ids, spread = gather(flat, counts, codes)
        per_word = sums(spread, n_pieces)
        if odd:
            ids, per_word = self.patch(ids, per_word, odd, words.take(pa.array(odd)).to_pylist())
        return ids, per_word

    def patch(self, ids: np.ndarray, per_word: np.ndarray, odd: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Put the library's ids of the odd words in their (empty) places."""
        got = [np.array(e.ids, np.int32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        start = np.concatenate([[0], np.cumsum(per_word)])
        ids = np.insert(ids, np.repeat(start[odd], [len(g) for g in got]), np.concatenate(got))
        per_word = per_word.copy()
        per_word[odd] = [len(g) for g in got]
        return ids, per_word

    def count_words(self, words: pa.Array, cut: tuple[pa.Array, np.ndarray, np.ndarray, list[int]]) -> np.ndarray:
        """Ids a word, from the words' cut."""
        pieces, codes, n_pieces, odd = cut
        _, counts = self.encode_pieces(pieces)
        per_word = sums(counts[codes], n_pieces)
        if odd:
            got = self.library.encode_batch(words.take(pa.array(odd)).to_pylist(), add_special_tokens=False)
            per_word[odd] = [len(e.ids) for e in got]
        return per_word

    # -- texts -> ids ----------------------------------------------------------
    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of whole texts; null counts as empty."""
        codes, n_words, words = split_words(texts)
        flat, counts = self.encode_words(words)
        ids, spread = gather(flat, counts, codes)
        at = np.concatenate([[0], np.cumsum(spread)])
        edge = np.concatenate([[0], np.cumsum(n_words)])
        return ids, at[edge[1:]] - at[edge[:-1]]

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        codes, n_words, words = split_words(texts)
        _, counts = self.encode_words(words)
        return sums(counts[codes], n_words)


def join_lines(words: pa.Array) -> str:
    """All words in one string, one a line."""
    off = pa.array([0, len(words)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(off, words), "\n")[0].as_py()


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string array without nulls."""
    big = strings.cast(pa.large_binary())
    off = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1]
    data = big.buffers()[2]
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Codes of all words in order, words per text, and the distinct words. Separators: space and U+0009 to U+000D."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    got = flat.dictionary_encode()
    codes = got.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(got.dictionary, "").as_py()
    if empty >= 0:  # texts that begin or end with white space give empty strings
        keep = codes != empty
        n_words = sums(keep.astype(np.int64), n_words)
        codes = codes[keep]
    return codes, n_words, got.dictionary.cast(pa.string())


def sums(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes."""
    at = np.concatenate([[0], np.cumsum(values)])
    edge = np.concatenate([[0], np.cumsum(groups)])
    return at[edge[1:]] - at[edge[:-1]]


def gather(flat: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs named by ``codes``; also each run's length."""
    start = np.cumsum(counts) - counts
    spread = counts[codes]
    total = int(spread.sum())
    if not total:
        return flat[:0], spread
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    back = start[codes] - (np.cumsum(spread) - spread)
    at = np.repeat(back.astype(kind), spread)
    at += np.arange(total, dtype=kind)
    return flat[at], spread


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``limit`` bytes of text; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One tokenizer for each Python worker."""
    return WordBpe(path)


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
