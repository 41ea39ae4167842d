"""License scan against a plain search for every template at every place."""

import random
import re

from folioflow.llm import licenses, queries

EVERY = [*licenses.BASE, *licenses.KNOWN]


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for t in EVERY:
        for at in range(-len(t.words), len(w)):
            if all(0 <= at + p < len(w) and w[at + p] == t.words[p] for p in t.mandatory):
                found.append((t, at, sum(0 <= at + p < len(w) and w[at + p] == x for p, x in enumerate(t.words)) / len(t.words)))
    own = [at for t, at, _ in found if t.base]
    names = lambda fs: ",".join(sorted({t.label for t, _, _ in fs}))
    return len(w), len(own), min(own, default=None), max(own, default=None), names([f for f in found if f[0].base]), names(found), max((s for _, _, s in found), default=0.0)


def texts():
    rng = random.Random(4)
    pool = sorted({w for t in EVERY for w in t.words}) + ["x", "Ünï", "7"]
    made = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    for t in EVERY:
        made.append(" ".join(rng.choice(pool) for _ in range(5)) + " \n * " + ", ".join(t.words).upper() + " " + " ".join(t.words[1:]))
        w = list(t.words)
        w[rng.randrange(len(w))] = "other"
        made.append(" ".join(w))
    odd = [None, "", " -- ", "MIT\nLicense", "mİt license", "mit licenſe", "KMIT license", "mit licensé", "cc by by cc by", "cc\x00by/cc_by", "the mit license" * 2, "日本 mit license", "gnu general public license " * 3, "mit license", "mit license"]
    return made + odd


def test_scan_against_a_plain_search(spark):
    rows = [(k if k % 7 else None, t, "x", 1) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "`doc.id` long, text string, w string, keys int").repartition(3)
    got = licenses.scan(df, id_col="doc.id")
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r[0], *plain(r[1])) for r in rows), key=str)


def test_long_and_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "see the license of free software in source and public by cc " * 120_000 + "under CC-BY-NC 4.0"
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (1_440_006, 1, 1_440_001, "cc-by,cc-by-nc-4.0")


def test_plan_has_no_python_and_no_shuffle(spark, sf_dir):
    plan = queries.QUERIES["op12_license_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)


def test_registered_scan_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.QUERIES["op12_license_scan"](spark, sf_dir).collect())) == sorted((r.doc_id, *plain(r.text)) for r in rows)
