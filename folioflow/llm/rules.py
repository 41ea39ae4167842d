"""Text quality rules run as a short-circuit cascade.

A rule names the measures that it needs and a test on them. On a sample (its
size is a parameter) every rule is timed and its rejections counted; rules then
run in descending order of rejections per second, each on the texts that no
earlier rule rejected: a rejected text costs nothing more. What is already
known of the surviving texts (their words, their lines, measures) goes on with
them. The verdict does not depend on the order, so it does not depend on the
sample. With ``measures=True`` the measures in ``SHOWN`` are made for all texts,
because the caller asked to see them; then rules on these cost next to nothing
and come first, and all other rules still run on survivors alone.

Words are ``[^\\x20\\x09-\\x0D]+``.

Defined cases: null and empty text have no words and zero measures; repeated
rows stand alone; further columns are ignored; an empty table gives an empty
result and the rules in the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage
from folioflow.llm import tokens as T

SYMBOLS = b"#*$%&|<>"
SPACE = np.zeros(256, np.uint8)
SPACE[[32, *range(9, 14)]] = 1
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(SYMBOLS)] = 1
CONTINUES = np.zeros(256, np.uint8)
CONTINUES[0x80:0xC0] = 1


#: Common words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "le", "la", "les", "de", "des", "et", "un", "une", "est", "que",
    "der", "die", "das", "und", "ein", "eine", "ist", "zu", "den", "mit", "el", "los", "las", "y", "en", "una", "es", "por", "con",
)


class Measures:
    """Measures of a batch of texts, each made when first asked for."""

    def __init__(self, texts: pa.Array | None, parent: tuple[Measures, np.ndarray] | None = None):
        self._texts = None if texts is None else pc.fill_null(texts, "")
        self._parent = parent
        self._made: dict[str, np.ndarray] = {}

    @property
    def texts(self) -> pa.Array:
        if self._texts is None:
            of, keep = self._parent
            self._texts = of.texts.filter(pa.array(keep))
        return self._texts

    def narrow(self, keep: np.ndarray) -> Measures:
        """The texts that ``keep`` marks, with all that is known of them."""
        out = Measures(None, (self, keep))
        for name, got in self._made.items():
            if name == "words":
                codes, n, dictionary = got
                out._made[name] = codes[np.repeat(keep, n)], n[keep], dictionary
            elif name == "lines":
                n, codes, worded, ends = got
                on = np.repeat(keep, n)
                out._made[name] = n[keep], codes[on], worded[on], ends[on]
            elif name != "raw":
                out._made[name] = got[keep]
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def _words(self):
        return T.split_words(self.texts)

    def _raw(self):
        return T.buffers(self.texts)

    def _count(self, table: np.ndarray) -> np.ndarray:
        off, data = self["raw"]
        at = np.concatenate([[0], np.cumsum(table[data[off[0] : off[-1]]], dtype=np.int64)])
        return np.diff(at[off - off[0]])

    def _n_words(self):
        return self["words"][1]

    def _n_chars(self):
        off, _ = self["raw"]
        return np.diff(off) - self._count(CONTINUES)

    def _word_chars(self):
        return self["n_chars"] - self._count(SPACE)

    def _n_symbols(self):
        return self._count(SYMBOL)

    def _lines(self):
        lists = pc.split_pattern(self.texts, "\n")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        got = lists.flatten().dictionary_encode()
        worded = pc.match_substring_regex(got.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
        cut = pc.match_substring_regex(got.dictionary, r"(\.\.\.|…)[\x20\x09-\x0D]*$").to_numpy(zero_copy_only=False)
        codes = got.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        none = np.zeros(0, bool)
        return n, codes, worded.astype(bool)[codes] if len(codes) else none, cut.astype(bool)[codes] if len(codes) else none

    def _n_cut_lines(self):
        """Lines that end with an ellipsis."""
        n, _, _, ends = self["lines"]
        return T.sums(ends.astype(np.int64), n)

    def _of_words(self, mask: np.ndarray) -> np.ndarray:
        codes, n, _ = self["words"]
        return T.sums(mask[codes].astype(np.int64), n)

    def _n_stop_words(self):
        return self._of_words(pc.is_in(pc.ascii_lower(self["words"][2]), pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False))

    def _n_letter_words(self):
        """Words with a letter of ASCII or anything beyond it."""
        return self._of_words(pc.match_substring_regex(self["words"][2], r"[A-Za-z]|[^\x00-\x7F]").to_numpy(zero_copy_only=False).astype(bool))

    def _n_distinct_words(self):
        codes, n, _ = self["words"]
        doc = np.unique(np.repeat(np.arange(len(n)), n) << 32 | codes) >> 32
        return np.bincount(doc, minlength=len(n)).astype(np.int64)

    def _n_lines(self):
        n, _, worded, _ = self["lines"]
        return T.sums(worded.astype(np.int64), n)

    def _n_dup_lines(self):
        n, codes, worded, _ = self["lines"]
        doc = np.repeat(np.arange(len(n)), n)[worded]
        key = doc << 32 | codes[worded]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), np.int64)
        again[first] = 0
        return np.bincount(doc, again, len(n)).astype(np.int64)

    def _n_repeat_words(self):
        """Words in a three-word window that its text holds twice or more."""
        codes, n_words, _ = self["words"]
        doc = np.repeat(np.arange(len(n_words)), n_words)
        if len(codes) < 3:
            return np.zeros(len(n_words), np.int64)
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        a, b, c, d = (x[inside].astype(np.uint64) for x in (codes[:-2], codes[1:-1], codes[2:], doc))
        mix = ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F) + c) * np.uint64(0x165667B19E3779F9) + d
        mix = (mix ^ mix >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(mix, kind="stable")
        same = mix[order][1:] == mix[order][:-1]
        for x in (a, b, c, d):  # equal hashes must mean equal windows
            if (same & (x[order][1:] != x[order][:-1])).any():
                rows = np.stack([a, b, c, d], 1)
                _, back, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
                twice = (n > 1)[back.ravel()]
                break
        else:
            twice = np.zeros(len(mix), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
        covered = np.zeros(len(codes), np.int64)
        for k in range(3):
            covered[inside[twice] + k] = 1
        return T.sums(covered, n_words)


@dataclass(frozen=True)
class Rule:
    """``fails`` maps measures to a mask of the texts that the rule rejects."""

    name: str
    fails: Callable[[Measures], np.ndarray]


BASE = [
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
]
#: Beside the base: symbols over a tenth of the word characters, a mean word length outside 2 to 20, over 30 % repeated lines,
#: under 1 % common words, under 80 % words with a letter, under 10 % distinct words, over 30 % lines that break off.
DEFAULT = [
    *BASE,
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["word_chars"]),
    Rule("word_length", lambda m: (m["word_chars"] > 20 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("no_common_words", lambda m: 100 * m["n_stop_words"] < m["n_words"]),
    Rule("few_letters", lambda m: 10 * m["n_letter_words"] < 8 * m["n_words"]),
    Rule("few_distinct_words", lambda m: 10 * m["n_distinct_words"] < m["n_words"]),
    Rule("broken_lines", lambda m: 10 * m["n_cut_lines"] > 3 * m["n_lines"]),
]
SHOWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def estimate(df: DataFrame, rules: list[Rule], sample_rows: int = 2000, text_col: str = "text", seed: int = 7, shown: list[str] | None = None) -> list[dict]:
    """Each rule's seconds and rejections a text, over about ``sample_rows`` rows spread over the table; what ``shown`` names is there at no cost."""
    storage.on_workers(df.sparkSession)
    n = df.count()
    if not n:
        return [{"rule": r.name, "cost": 0.0, "rejects": 0.0} for r in rules]
    part = df.select(F.col(storage.quoted(text_col)).alias("text")).sample(min(1.0, sample_rows / n), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch):
                rows, base = [], Measures(piece.column("text"))
                for name in shown or ():
                    base[name]
                for r in rules:
                    m = base.narrow(np.ones(piece.num_rows, bool))  # anew, so that the rule pays for all else that it needs
                    t = time.perf_counter()
                    bad = int(np.count_nonzero(r.fails(m)))
                    rows.append((r.name, time.perf_counter() - t, bad, piece.num_rows))
                yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["rule", "s", "bad", "n"])

    got = part.mapInArrow(run, "rule string, s double, bad long, n long").groupBy("rule").agg(F.sum("s"), F.sum("bad"), F.sum("n")).collect()
    by = {r[0]: r[1:] for r in got}  # one row a rule
    return [{"rule": r.name, "cost": by[r.name][0] / by[r.name][2], "rejects": by[r.name][1] / by[r.name][2]} if r.name in by else {"rule": r.name, "cost": 0.0, "rejects": 0.0} for r in rules]


def plan(rules: list[Rule], found: list[dict]) -> list[Rule]:
    """Most rejections per second first; equals as given."""
    by = {f["rule"]: f["rejects"] / max(f["cost"], 1e-12) for f in found}
    return sorted(rules, key=lambda r: -by[r.name])


def short_circuit(whole: Measures, n: int, order: list[Rule]) -> tuple[np.ndarray, list[int]]:
    """For each of n texts the place in ``order`` of the rule that rejects it, -1 if none does; and on how many texts each rule was tried."""
    by, alive, tried, m = np.full(n, -1), np.arange(n), [], whole
    for k, rule in enumerate(order):
        if not len(alive):
            break
        tried.append(len(alive))
        bad = rule.fails(m)
        if bad.any():
            by[alive[bad]] = k
            alive, m = alive[~bad], m.narrow(~bad)
    return by, tried + [0] * (len(order) - len(tried))


def cascade(df: DataFrame, rules: list[Rule] = DEFAULT, base: list[Rule] = BASE, measures: bool = False, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base_failed, kept and the rule that rejected it; with ``measures`` all measures too. Base rules count among ``rules``."""
    shown = SHOWN if measures else []
    order = plan(rules, estimate(df, rules, sample_rows, text_col, shown=shown))
    src = df.select(F.col(storage.quoted(id_col)).alias("doc_id"), F.col(storage.quoted(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                n, whole = part.num_rows, Measures(part.column("text"))
                seen = [pa.array(whole[c].astype(np.int64)) for c in shown]
                by, _ = short_circuit(whole, n, order)
                if measures:
                    base_failed = np.any([r.fails(whole) for r in base], 0) if base else np.zeros(n, bool)
                else:  # an earlier rule may have hidden a failure of a base rule
                    base_failed, hit = np.zeros(n, bool), by >= 0
                    if hit.any() and base:
                        few = whole.narrow(hit)
                        base_failed[hit] = np.any([r.fails(few) for r in base], 0)
                names = [order[k].name if k >= 0 else None for k in by.tolist()]
                cols = [part.column("doc_id"), *seen, pa.array(base_failed), pa.array(by < 0), pa.array(names, pa.string())]
                yield pa.record_batch(cols, ["doc_id", *shown, "base_failed", "kept", "rejected_by"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in shown), "base_failed boolean, kept boolean, rejected_by string"]))
