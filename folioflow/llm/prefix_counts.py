"""Token counts at every prefix by dynamic programming over distinct pieces.

``Piece`` means a pre-token: a run of letters, a digit or a run of symbols.
For a piece of bytes b1..bL the program keeps, for every i, the last token of
the encoding of b1..bi as the inside of a longer piece; that token is the one
vocabulary entry t that ends at i and may follow the last token at i - |t|.
Two tokens may stand side by side when encoding their joined bytes gives the
same two tokens back. One further step with the word-ending tokens gives
``count[i]``, the exact number of tokens of the text that stops at i. A
document's count at any byte is the sum of its earlier words and one look-up
in the table of the word that the cut falls into.

Words of any script go this way. Those that the fast cutter does not take (other
scripts, apostrophes, special strings) are normalised and cut once by the
library's own steps; a cut in a word then falls into one piece, and only three
kinds of cut need a piece of their own: inside a contraction ('r of 're), inside
a special string, and between characters that composition joins.

Defined cases: null and empty text have 0 bytes and 0 tokens; repeated rows
and ids are kept as they come; further columns are ignored; an empty table
gives an empty result. Special strings count as the library counts them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage
from folioflow.llm import tokens as T

RADIX = np.uint64(0x100000001B3)
CONTRACTIONS = {"'re", "'ve", "'ll"}  #: fixed values: those of which a part is two pieces


class PrefixDp:
    def __init__(self, bpe: T.WordBpe):
        self.bpe = bpe
        inner, final = ([], []), ([], [])
        self.longest = 1
        for i, s in bpe.strings.items():
            if s in bpe.specials:
                continue
            data, last = bpe.token_bytes(i)
            h = 0
            for b in data:
                h = (h * int(RADIX) + b + 1) % 2**64
            into = final if last else inner
            into[0].append(h)
            into[1].append(i)
            if len(data) <= T.LONGEST_PIECE:
                self.longest = max(self.longest, len(data))
        for keys, _ in (inner, final):
            assert len(set(keys)) == len(keys), "two tokens share a hash"
        self.inner = T.PairTable(np.array(inner[0], np.uint64), np.array(inner[1], np.int32))
        self.final = T.PairTable(np.array(final[0], np.uint64), np.array(final[1], np.int32))

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of tokens a and b encode to a, b again.

        The merges that made a and b are undone, latest first; if a merge
        across the border would have come before the one just undone, the
        encoder would have taken it.
        """
        left, right = self.bpe.split_left, self.bpe.split_right
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        before = np.full(len(a), 2**40, np.int64)  # merges from here on come later than what is undone
        while len(live):
            joined = self.bpe.merged(a, b)
            bad = (joined != T.NONE) & (joined < before)
            good[live[bad]] = False
            keep = ~bad
            live, a, b = live[keep], a[keep], b[keep]
            if not len(live):
                break
            ra, lb = right[a], left[b]
            can_a, can_b = ra != a, lb != b
            take_a = can_a & ((a > b) | ~can_b)
            go = can_a | can_b
            # among equal merges the leftmost goes first, so one at the border beats the same merge further right
            before = np.where(take_a, a.astype(np.int64), b.astype(np.int64) + 1)[go]
            a, b = np.where(take_a, ra, a)[go], np.where(go & ~take_a, lb, b)[go]
            live = live[go]
        return good

    def table(self, data: np.ndarray) -> np.ndarray:
        """data: rows of bytes of one length. Token counts of every prefix, (rows, length)."""
        n, width = data.shape
        power = np.array([pow(int(RADIX), k, 2**64) for k in range(width + 1)], np.uint64)
        prefix = np.zeros((n, width + 1), np.uint64)
        for i in range(width):
            prefix[:, i + 1] = prefix[:, i] * RADIX + (data[:, i].astype(np.uint64) + np.uint64(1))
        last = np.full((n, width + 1), -1, np.int32)
        inside = np.zeros((n, width + 1), np.int32)
        counts = np.zeros((n, width), np.int32)
        for i in range(1, width + 1):
            for lookup, ending in ((self.final, True), (self.inner, False)):
                if i == width and not ending:
                    continue
                todo = np.arange(n)
                for size in range(min(i, self.longest), 0, -1):
                    key = prefix[todo, i] - prefix[todo, i - size] * power[size]
                    tok = lookup.get(key)
                    here = np.flatnonzero(tok != T.NONE)
                    if not len(here):
                        continue
                    rows = todo[here]
                    if size < i:
                        fits = self.may_follow(last[rows, i - size], tok[here])
                        here, rows = here[fits], rows[fits]
                    if ending:
                        counts[rows, i - 1] = inside[rows, i - size] + 1
                    else:
                        inside[rows, i] = inside[rows, i - size] + 1
                        last[rows, i] = tok[here]
                    todo = np.delete(todo, here)
                    if not len(todo):
                        break
        for i in range(width):  # inside a character: as at its start
            mid = np.flatnonzero((data[:, i + 1] & 0xC0) == 0x80) if i + 1 < width else []
            if len(mid):
                counts[mid, i] = counts[mid, i - 1] if i else 0
        return counts

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every byte of every piece, flat, and the pieces' lengths in bytes."""
        off, data = T.buffers(pieces)
        length = np.diff(off)
        start = np.concatenate([[0], np.cumsum(length)])
        flat = np.zeros(start[-1], np.int32)
        for width in np.unique(length).tolist():
            rows = np.flatnonzero(length == width)
            if width > T.LONGEST_PIECE:
                for r in rows.tolist():
                    flat[start[r] : start[r + 1]] = self.long_piece(data[off[r] : off[r + 1]])
            elif width:
                cut = np.arange(width)
                flat[start[rows][:, None] + cut] = self.table(data[off[rows][:, None] + cut])
        return flat, length

    def long_piece(self, data: np.ndarray) -> np.ndarray:
        """As ``table`` for one long piece, with all look-ups made ahead and the border test remembered."""
        width, back = len(data), np.arange(1, self.longest + 1)
        prefix = np.zeros(width + 1, np.uint64)
        h = 0
        for i, b in enumerate(data.tolist()):
            h = (h * int(RADIX) + b + 1) % 2**64
            prefix[i + 1] = h
        power = np.array([pow(int(RADIX), int(k), 2**64) for k in back], np.uint64)
        last, inside = [-1] * (width + 1), [0] * (width + 1)
        counts = np.zeros(width, np.int32)
        known: dict[tuple[int, int], bool] = {}
        for lo in range(0, width, 1 << 12):
            ends = np.arange(lo + 1, min(lo + (1 << 12), width) + 1)
            at = ends[:, None] - back
            key = prefix[ends, None] - prefix[np.maximum(at, 0)] * power
            ending, inner = (np.where(at >= 0, t.get(key.ravel()).reshape(key.shape), T.NONE) for t in (self.final, self.inner))
            for i in ends.tolist():
                for rows, stop in ((ending, True), (inner, False)):
                    row = rows[i - lo - 1]
                    for k in np.flatnonzero(row != T.NONE)[::-1].tolist():
                        size, tok = k + 1, int(row[k])
                        pair = (last[i - size], tok)
                        if size < i and pair not in known:
                            known[pair] = bool(self.may_follow(np.array([pair[0]]), np.array([tok]))[0])
                        if size == i or known[pair]:
                            if stop:
                                counts[i - 1] = inside[i - size] + 1
                            else:
                                inside[i], last[i] = inside[i - size] + 1, tok
                            break
        for i in np.flatnonzero((data[1:] & 0xC0) == 0x80).tolist():
            counts[i] = counts[i - 1] if i else 0
        return counts

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every byte of every distinct word, flat, and the words' lengths in bytes."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(words):
            return np.zeros(0, np.int32), size
        pieces, codes, n_pieces, odd = self.bpe.cut_words(words)
        flat, length = self.pieces(pieces)
        got, spread = T.gather(flat, length, codes)
        # whole pieces that come earlier in the same word
        whole = flat[np.cumsum(length) - 1][codes] if len(codes) else np.zeros(0, np.int32)
        run = np.cumsum(whole) - whole
        first = np.cumsum(n_pieces) - n_pieces
        base = np.repeat(run[np.minimum(first, max(len(run) - 1, 0))] if len(run) else np.zeros(len(n_pieces), np.int64), n_pieces)
        got = got + np.repeat(run - base, spread)
        if not odd:
            return got.astype(np.int32), size
        out = np.zeros(int(size.sum()), np.int32)
        plain = np.ones(len(words), bool)
        plain[odd] = False
        out[np.repeat(plain, size)] = got
        at = np.cumsum(size) - size
        for k, counts in zip(odd, OddWords(self).counts(words.take(pa.array(odd)).to_pylist()), strict=True):
            out[at[k] : at[k] + size[k]] = counts
        return out, size


class OddWords:
    """Prefix counts of words that the fast cutter does not take."""

    def __init__(self, dp: PrefixDp):
        self.dp, self.library = dp, dp.bpe.library
        self.special = re.compile("(" + "|".join(map(re.escape, dp.bpe.specials)) + ")") if dp.bpe.specials else None
        self.normal: dict[str, str] = {}
        self.needed: dict[str, int] = {}

    def norm(self, text: str) -> str:
        if text not in self.normal:
            self.normal[text] = self.library.normalizer.normalize_str(text)
        return self.normal[text]

    def cut(self, text: str) -> list[tuple[int, int]]:
        """Places of the pieces of normalised text."""
        return [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def piece(self, text: str) -> int:
        return self.needed.setdefault(text, len(self.needed))

    def clusters(self, text: str) -> list[str]:
        """Runs of characters that composition may join; most are one character."""
        out: list[str] = []
        for c in text:
            p = out[-1][-1] if out else ""
            joins = p and (unicodedata.combining(c) or unicodedata.normalize("NFC", p + c) != unicodedata.normalize("NFC", p) + unicodedata.normalize("NFC", c))
            if joins:
                out[-1] += c
            else:
                out.append(c)
        return out

    def plain(self, text: str) -> tuple[list[int], list[tuple[int, list[tuple[int, int]]]]] | None:
        """The pieces of a text without special strings, and for each of its characters what the text up to it consists of: so many of these pieces, then further ones as (piece, bytes of it; -1 for all)."""
        groups = self.clusters(text)
        whole = "".join(self.norm(g) for g in groups)
        if whole.replace(" ", "") != self.library.normalizer.normalize_str(text).replace(" ", ""):
            return None
        places = self.cut(whole)
        names = [self.piece(whole[a:b]) for a, b in places]
        starts = [a for a, _ in places]
        out, at = [], 0
        for g in groups:
            for k in range(1, len(g)):  # a cut inside what composition joins: the last pieces anew
                first = max(bisect_right(starts, at) - 3, 0)
                begin = starts[first] if starts else 0
                tail = whole[begin:at] + self.norm(g[:k])
                out.append((first, [(self.piece(tail[a:b]), -1) for a, b in self.cut(tail)]))
            at += len(self.norm(g))
            k = bisect_right(starts, at - 1) - 1 if at else -1
            if k < 0:
                out.append((0, []))
            elif at >= places[k][1]:
                out.append((k + 1, []))
            elif whole[places[k][0] : places[k][1]] in CONTRACTIONS and at - starts[k] == 2:
                out.append((k, [(self.piece(whole[starts[k]]), -1), (self.piece(whole[at - 1]), -1)]))
            else:
                out.append((k, [(names[k], len(whole[starts[k] : at].encode()))]))
        return names, out

    def counts(self, words: list[str]) -> list[np.ndarray]:
        """Counts at every byte of every word."""
        plans = []
        for word in words:
            parts = self.special.split(word) if self.special else [word]
            plan = []
            for k in range(0, len(parts), 2):
                tail = parts[k + 1] if k + 1 < len(parts) else ""
                # inside a special string the text so far is plain
                plan.append((parts[k], tail, self.plain(parts[k] + tail[:-1])))
            plans.append(plan)
        flat, length = self.dp.pieces(pa.array(list(self.needed), pa.string()))
        ends = np.cumsum(length)
        total = [int(flat[e - 1]) if n else 0 for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
        begin = (ends - length).tolist()
        return [self.word(plan, flat, begin, total) for plan in plans]

    def word(self, plan: list, flat: np.ndarray, begin: list[int], total: list[int]) -> np.ndarray:
        base, out = 0, []
        for text, tail, got in plan:
            shown = text + tail[:-1]
            if got is None:  # no rule covers how this text is normalised: the library's count of every part
                at = [len(e.ids) for e in self.library.encode_batch([shown[: k + 1] for k in range(len(shown))], add_special_tokens=False)]
            else:
                names, cuts = got
                run = np.concatenate([[0], np.cumsum([total[n] for n in names])]).tolist()
                at = [run[k] + sum(total[p] if size < 0 else int(flat[begin[p] + size - 1]) for p, size in rest) for k, rest in cuts]
            before = 0
            for c, n in zip(shown, at, strict=True):
                out += [base + before] * (len(c.encode()) - 1) + [base + n]
                before = n
            if tail:
                base += (at[len(text) - 1] if text else 0) + 1
                out.append(base)
        return np.array(out, np.int32)


class PrefixCounts:
    """Prefix tables of a batch of texts."""

    def __init__(self, dp: PrefixDp, texts: pa.Array):
        self.dp = dp
        self.texts = T.pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        self.codes, self.n_words, self.dictionary = T.split_words(self.texts)
        self.flat, self.size = dp.words(self.dictionary)
        self.end = np.cumsum(self.size)
        # the empty string may stand among the words; no text points to it
        self.per_word = np.where(self.size > 0, self.flat[np.maximum(self.end - 1, 0)], 0) if len(self.flat) else np.zeros(len(self.size), np.int32)
        self.totals = T.sums(self.per_word[self.codes].astype(np.int64), self.n_words)
        self.first = np.cumsum(self.n_words) - self.n_words

    def _words_of(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Codes, first bytes and running counts of text k's words, and its bytes."""
        data = self.texts[k].as_py().encode()
        codes = self.codes[self.first[k] : self.first[k] + self.n_words[k]]
        raw = np.frombuffer(data, np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
        return codes, starts, np.cumsum(self.per_word[codes]), data

    def at(self, k: int) -> np.ndarray:
        """Token counts of text k cut after byte 0, 1, ... n; a cut inside a character counts as one before it."""
        codes, starts, run, data = self._words_of(k)
        out = np.zeros(len(data) + 1, np.int64)
        out[1:] = np.repeat(np.concatenate([[0], run]), np.diff(np.concatenate([[0], starts, [len(data)]])))
        for c, s, r in zip(codes.tolist(), starts.tolist(), run.tolist(), strict=True):
            got = self.inside(c)
            out[s + 1 : s + 1 + len(got)] = r - self.per_word[c] + got
            out[s + 1 + len(got) :] = r
        return out

    def inside(self, code: int) -> np.ndarray:
        """Counts at every byte of a distinct word."""
        return self.flat[self.end[code] - self.size[code] : self.end[code]]

    def fit_bytes(self, k: int, limit: int) -> int:
        """Bytes of the longest prefix such that it and all shorter ones, cut between characters, have at most ``limit`` tokens."""
        if self.totals[k] <= limit:
            codes, starts, run, data = self._words_of(k) if self.totals[k] == limit else (None, None, None, None)
            return len(data) if data is not None else len(self.texts[k].as_py().encode())
        codes, starts, run, data = self._words_of(k)
        j = int(np.searchsorted(run, limit, "right"))  # the first word that ends beyond the limit
        room = limit - (int(run[j - 1]) if j else 0)
        over = np.flatnonzero(self.inside(int(codes[j])) > room)
        cut = int(starts[j] + (over[0] if len(over) else self.size[codes[j]]))
        while cut and cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut -= 1
        return cut


_dps: dict[str, PrefixDp] = {}


def dp_for(path: str) -> PrefixDp:
    if path not in _dps:
        _dps[path] = PrefixDp(T.load(path))
    return _dps[path]


def count_tokens(df: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit and fit_bytes, the bytes that a cut at ``limit`` tokens keeps. One pass without shuffle."""
    storage.on_workers(df.sparkSession)
    path = tokenizer or T.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = dp_for(path)
        for batch in batches:
            for part in T.slices(batch):
                text = part.column("text")
                got = PrefixCounts(dp, text)
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                fit = size.to_numpy(zero_copy_only=False).copy()
                for k in np.flatnonzero(got.totals > limit).tolist():
                    fit[k] = got.fit_bytes(k, limit)
                yield pa.record_batch([part.column("doc_id"), size, pa.array(got.totals), pa.array(got.totals > limit), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    src = df.select(F.col(storage.quoted(id_col)).alias("doc_id"), F.col(storage.quoted(text_col)).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def prefix_tables(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``counts``, the token counts of the text cut after 0, 1, ... n bytes."""
    storage.on_workers(df.sparkSession)
    path = tokenizer or T.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = dp_for(path)
        for batch in batches:
            for part in T.slices(batch, limit=1 << 20):
                got = PrefixCounts(dp, part.column("text"))
                rows = [got.at(k) for k in range(part.num_rows)]
                yield pa.record_batch([part.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "counts"])

    src = df.select(F.col(storage.quoted(id_col)).alias("doc_id"), F.col(storage.quoted(text_col)).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, counts array<long>")
