"""License scan over a positional index of rare words, with DataFrame functions only.

A template is a run of words of a license or of a line that names one; its
mandatory key phrases are marked. Of the words of its key phrases the ``RARE``
of highest inverse document frequency, counted over the whole corpus, enter the
index, with their positions in the template. A text's words that are in the
index are looked up; every posting of a word at text position i and template
position p says that the template would begin at i - p. The postings of a
template's rare words are intersected by that place, the rarest word first. At
the places that are left all key phrases are verified word by word, and the
score is the share of the template's words that stand where they should.

The rare words are key words, so no place of the key phrases is missed and the
result does not depend on the frequencies; those only keep the lists short.

Everything of a text is computed in its row: no shuffle but for the counts of
the template words, of which the driver gets one row a word.

Defined cases: words are runs of ASCII letters and digits and of all characters
beyond ASCII, A-Z lowered; null and empty texts have no word, no label and score
0; rows are independent, so repeated rows, repeated and null ids are results of
their own; further columns are ignored; an empty table gives an empty result;
overlapping places all count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3  #: rare words a template that are looked up
SHIFT, BIAS = 1 << 40, 1 << 20  #: a place is template * SHIFT + BIAS + first word


@dataclass(frozen=True)
class Template:
    """Words in lower case; square brackets hold the mandatory key phrases."""

    label: str
    text: str
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return self.text.replace("[", " ").replace("]", " ").split()

    @cached_property
    def mandatory(self) -> list[int]:
        """Positions of the words of the key phrases."""
        out, at, inside = [], 0, False
        for piece in self.text.replace("[", " [ ").replace("]", " ] ").split():
            if piece in "[]":
                inside = piece == "["
            else:
                out += [at] if inside else []
                at += 1
        return out


#: Phrases that any scan reports.
BASE = [
    Template("gpl", "[gnu general public license]", True),
    Template("apache", "[apache license]", True),
    Template("cc-by", "[cc by]", True),
    Template("mit", "[mit license]", True),
]

#: Lines that name a license, and openings of license texts.
KNOWN = [
    Template("apache-2.0", "licensed under the [apache license version 2 0]"),
    Template("gpl-2.0", "licensed under the gnu [general public license version 2]"),
    Template("gpl-3.0", "licensed under the gnu [general public license version 3]"),
    Template("lgpl", "the terms of the [gnu lesser general public license] as published by the free software foundation"),
    Template("agpl", "the terms of the [gnu affero general public license] as published by the free software foundation"),
    Template("cc-by-4.0", "licensed under [cc by 4 0]"),
    Template("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    Template("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    Template("cc0-1.0", "the person who associated a work with this deed has [dedicated the work to the public domain] by waiving all rights"),
    Template("mit", "permission is [hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to [deal in the software without restriction]"),
    Template("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the [following conditions are met]"),
    Template("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    Template("epl-2.0", "made available under the terms of the [eclipse public license 2 0]"),
    Template("bsl-1.0", "distributed under the [boost software license version 1 0]"),
    Template("zlib", "this software is provided as is without any express or implied warranty [in no event will the authors be held liable] for any damages arising from the use of this software"),
    Template("unlicense", "this is [free and unencumbered software released into the public domain]"),
]


def words_of(text: Column) -> Column:
    """The words of a text, without Python. The Kelvin sign, alone of all characters beyond ASCII, would be lowered to an ASCII letter; it goes before."""
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(low, BETWEEN), "")


def document_counts(words: DataFrame, templates: list[Template]) -> dict[str, int]:
    """In how many texts each word of the key phrases stands; words: column w."""
    vocabulary = sorted({t.words[p] for t in templates for p in t.mandatory})
    seen = words.select(F.explode(F.array_intersect("w", F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in seen.collect()}


def rarest(template: Template, counts: dict[str, int]) -> list[int]:
    """The template positions of ``RARE`` words of highest inverse document frequency; the last again where there are fewer."""
    first = {template.words[p]: p for p in reversed(template.mandatory)}
    order = [first[w] for w in sorted(first, key=lambda w: (counts[w], w))][:RARE]
    return order + order[-1:] * (RARE - len(order))


def lookups(templates: list[Template], counts: dict[str, int]) -> tuple[Column, Callable[[int, Column], Column]]:
    """The positions in column w of words of the index, and a function of a rank and such positions: the places that the templates' words of that rank point to."""
    index: list[dict[str, list[int]]] = [{} for _ in range(RARE)]
    for t, template in enumerate(templates):
        for rank, p in enumerate(rarest(template, counts)):
            index[rank].setdefault(template.words[p], []).append(t * SHIFT + BIAS - p)
    rare = sorted({w for postings in index for w in postings})
    none = F.array().cast("array<bigint>")
    every = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(every, lambda i: F.get("w", i).isin(rare))

    def looked_up(rank: int, at: Column) -> Column:
        postings = F.create_map(*(x for w, begins in index[rank].items() for x in (F.lit(w), F.array(*map(F.lit, begins)).cast("array<bigint>"))))
        return F.flatten(F.transform(at, lambda i: F.transform(F.coalesce(F.try_element_at(postings, F.get("w", i)), none), lambda begin: begin + i)))

    return hits, looked_up


def scan(df: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id as doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    templates = [*BASE, *KNOWN] if templates is None else templates
    col = lambda c: F.col(storage.quoted(c))
    words = df.select(col(id_col).alias("doc_id"), words_of(col(text_col)).alias("w"))
    hits, looked_up = lookups(templates, document_counts(words, templates))
    t_of, at_of = lambda k: F.shiftright(k, 40).cast("int"), lambda k: (k % SHIFT - BIAS).cast("int")
    texts = F.array(*(F.array(*map(F.lit, t.words)) for t in templates))
    needed = F.array(*(F.array(*map(F.lit, t.mandatory)) for t in templates))
    stands = lambda k, p: F.coalesce(F.get("w", at_of(k) + p) == F.get(F.get(texts, t_of(k)), p), F.lit(False))
    share = lambda k: F.size(F.filter(F.sequence(F.lit(0), F.size(F.get(texts, t_of(k))) - 1), lambda p: stands(k, p))) / F.size(F.get(texts, t_of(k)))
    labels = F.array(*(F.lit(t.label) for t in templates))
    base = F.array(*(F.lit(t.base) for t in templates))
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda k: F.get(labels, t_of(k))))), ",")
    t = words.withColumn("hits", hits)
    t = t.withColumn("keys", looked_up(0, F.col("hits")))
    for rank in range(1, RARE):  # the lists of less rare words are only made where the rarer ones agree
        t = t.withColumn("keys", F.when(F.size("keys") > 0, F.array_intersect("keys", looked_up(rank, F.col("hits")))).otherwise(F.col("keys")))
    t = t.withColumn("found", F.filter("keys", lambda k: F.forall(F.get(needed, t_of(k)), lambda p: stands(k, p))))
    own = F.filter("found", lambda k: F.get(base, t_of(k)))
    t = t.select("doc_id", F.size("w").cast("long").alias("n_words"), "found", own.alias("own"), F.transform("found", share).alias("shares"))
    starts = F.transform("own", at_of)
    return t.select(
        "doc_id", "n_words", F.size("own").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(F.col("own")).alias("base_labels"), joined(F.col("found")).alias("labels"), F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("score"),
    )


def scan_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same rows by plain counting: every template at every place of its key phrases."""
    every = [*BASE, *KNOWN]
    rows = ", ".join(f"({t}, {p}, '{w}', {p in set(x.mandatory)})" for t, x in enumerate(every) for p, w in enumerate(x.words))
    heads = ", ".join(f"({t}, '{x.label}', {x.base}, {len(x.mandatory)}, {len(x.words)})" for t, x in enumerate(every))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, {id_col} AS doc_id, list_filter(regexp_split_to_array(translate(coalesce({text_col}, ''), '{upper}', '{lower}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM {table}),
tw AS (SELECT * FROM (VALUES {rows}) v(t, p, word, needed)),
th AS (SELECT * FROM (VALUES {heads}) v(t, label, base, n_needed, n_all)),
u AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
m AS (SELECT k, t, i - p AS place, count(*) AS n_all, count(*) FILTER (needed) AS n_needed FROM u JOIN tw USING (word) GROUP BY ALL),
f AS (SELECT m.k, m.place, th.label, th.base, m.n_all / th.n_all AS share FROM m JOIN th ON m.t = th.t AND m.n_needed = th.n_needed),
g AS (SELECT k, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY k)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN g USING (k)"""
