"""The fitted and the online methods against plain versions of themselves, and inputs of every odd kind."""

import os
import random
import subprocess
import sys
import warnings

import numpy as np
import pytest

from folioflow.llm import features, flatgraph, mixing, nearcopies, ordinal, packing, planes, prefix_counts, rules, simhash, storage, suffix

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import brute_components, brute_repeats, ids_of, prose  # noqa: E402


# -- ordinal regression --------------------------------------------------------------
def plain_loss(w, theta, x, grade, ridge, lasso):
    """Negative log-likelihood of cumulative links over a dense table, with the ridge and the pull of the evidence."""
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        s = sum(a * b for a, b in zip(row, w, strict=True))
        below = [0.0, *(1 / (1 + np.exp(-(t - s))) for t in theta), 1.0]
        total -= np.log(max(below[g + 1] - below[g], 1e-12))
    return total / len(grade) + 0.5 * ridge * float(np.dot(w, w)) - lasso / len(grade) * float(np.sum(w))


def test_ordinal_fit_is_the_minimum():
    rng = np.random.default_rng(1)
    n = 400
    x = rng.integers(0, 3, (n, 3)).astype(float)
    score = -1.5 * x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=n)
    grade = (score > -2.5).astype(int) + (score > -0.5)
    row, slot = np.nonzero(x)
    options = {"ridge": 0.01, "lasso": 0.5}
    m = ordinal.fit_rows(row, slot, x[row, slot], grade, steps=4000, rate=0.02, **options)
    w = m.weights[:3].astype(float)
    best = plain_loss(w, m.thresholds, x, grade, **options)
    assert (w <= 0).all() and m.thresholds[0] < m.thresholds[1] and w[0] < w[1]
    for k in range(200):  # nothing allowed near by, or further off, is better
        step = 0.02 if k < 100 else 0.5
        other = np.minimum(w + rng.normal(size=3) * step, 0)
        assert plain_loss(other, np.sort(m.thresholds + rng.normal(size=2) * step), x, grade, **options) >= best - 1e-5
    p = m.probabilities(x @ w)
    assert np.allclose(p.sum(1), 1) and np.allclose(m.expected(x @ w), p @ np.arange(3))


def test_ids_rated_twice_count_once(spark):
    docs = spark.createDataFrame([(k, prose(random.Random(k), 30)) for k in range(40)] * 2 + [(3, "zz " * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rated = labels.select("doc_id", ordinal.grade_of(labels["quality"], labels["toxic"]).alias("grade")).filter("grade IS NOT NULL")
    got = {r.doc_id: r.grade for r in features.bounded_sample(rated, "doc_id", 1000).collect()}
    assert got[3] == 1 and len(got) == 41
    assert ordinal.score(docs, ordinal.fit(docs, labels)).count() == 81


# -- packing ---------------------------------------------------------------------------
def test_packer_takes_the_level_of_least_squares():
    rng, w = np.random.default_rng(2), 40
    p = packing.Packer(w, max_open=10**6)
    for k in range(600):
        size = int(rng.integers(1, w))
        before = p.count[:w].copy()

        def squares(h):
            after = before.copy()
            if h:
                after[h] -= 1
            if h + size < w:
                after[h + size] += 1
            return int((after[1:] ** 2).sum())

        choices = [h for h in range(w - size + 1) if h == 0 or before[h]]
        least = min(map(squares, choices))
        p.add(k, np.full(size, k, "<u4"))
        want = max(h for h in choices if squares(h) == least)  # of equals the fullest
        after = before.copy()
        if want:
            after[want] -= 1
        if want + size < w:
            after[want + size] += 1
        assert (p.count[:w] == after).all()


# -- mixing ------------------------------------------------------------------------------
def plain_rates(tokens, p, targets, steps=200):
    """Projected gradient over dense arrays."""
    r = np.ones(len(tokens))
    totals = (tokens[:, None] * p).sum(0)
    goal = np.array(targets) / sum(targets) * totals.sum()
    scale = np.maximum((tokens[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0).sum(1), 1e-12)
    for _ in range(steps):
        now = (tokens[:, None] * r[:, None] * p).sum(0)
        if np.abs(now - goal).max() <= 1e-6 * goal.sum():
            break
        r = np.maximum(0, r - p @ ((now - goal) / scale))
    return r, goal


def test_rates_are_those_of_dense_least_squares(spark):
    rng = np.random.default_rng(3)
    p = mixing.on_grid(rng.dirichlet([0.5, 0.5, 0.5], 300))
    tokens = rng.integers(0, 500, 300).astype(float)
    assert np.allclose(p.sum(1), 1) and (p * mixing.GRID == np.rint(p * mixing.GRID)).all()
    table = spark.createDataFrame([(k, int(t), *map(float, row)) for k, (t, row) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n long, a double, b double, c double")
    steps, totals, goal = mixing.fit_rates(table, ["n", "a", "b", "c"], [0.5, 0.3, 0.2])
    got = {r.doc_id: r.rate for r in table.select("doc_id", mixing.rate_column(steps, ["a", "b", "c"]).alias("rate")).collect()}
    want, aim = plain_rates(tokens, p, [0.5, 0.3, 0.2])
    assert np.allclose(goal, aim) and np.allclose(totals, aim, rtol=1e-4)
    assert np.allclose([got[k] for k in range(300)], want, atol=1e-6) and min(got.values()) >= 0


def test_a_target_out_of_reach_is_warned_of(spark):
    table = spark.createDataFrame([(1, 10, 1.0, 0.0)], "doc_id long, n long, a double, b double")
    with pytest.warns(UserWarning, match="misses a target"):
        steps, totals, goal = mixing.fit_rates(table, ["n", "a", "b"], [0.5, 0.5])
    assert totals[1] == 0 and goal[1] == 5
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert mixing.fit_rates(table.filter("false"), ["n", "a", "b"], [0.5, 0.5])[0] == []


# -- names, sizes, sessions ----------------------------------------------------------------
CLASH = "doc_id long, text string, n_chars long, _n int, _h int, _spans int, _tokens int, _p_0 double, _copy int, _id int, _k int, label int, fp long, `a.b` int"


def clashing(spark, texts):
    return spark.createDataFrame([(k, t, len(t or ""), 5 + k, 6, 7, 8, 0.5, 9, 10, 11, 12, 13, 14) for k, t in texts], CLASH)


def test_columns_of_the_caller_survive(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    texts = [(0, "le la les " * 5 + passage), (1, prose(rng, 20) + passage), (2, None), (3, ""), (3, ""), (4, prose(rng, 30))]
    df = clashing(spark, texts)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int")
    own = [c for c in df.columns if c not in ("text", "n_chars")]
    before = sorted(map(str, df.select(*map(storage.quoted, own)).collect()))
    for got in (suffix.remove(df), ordinal.keep_good(df, labels)):
        assert got.columns == df.columns and sorted(map(str, got.select(*map(storage.quoted, own)).collect())) == before
    named = df.selectExpr("doc_id", "text", "CASE WHEN doc_id = 0 THEN 'fr' ELSE 'en' END AS domain")
    for got in (nearcopies.one_of_each(df), mixing.resample(df, named, {"en": 0.5, "fr": 0.5})):
        assert got.columns == df.columns and set(map(str, got.select(*map(storage.quoted, own)).collect())) <= set(before)


def test_empty_tables(spark):
    none = clashing(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    named = none.selectExpr("doc_id", "text", "'en' AS domain")
    for got in (suffix.remove(none), ordinal.keep_good(none, labels), nearcopies.one_of_each(none), mixing.resample(none, named, {"en": 1.0}), ordinal.classify(none, labels), simhash.groups(none), mixing.rates(none, named, {"en": 1.0}), suffix.digest(none)):
        assert got.count() == 0


def test_a_text_beyond_a_slice(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(1_500_000))
    assert len(text) > 8 << 20
    df = spark.createDataFrame([(1, text), (2, "short one"), (3, text[:500])], "doc_id long, text string")
    n = len(ids_of(text))
    assert {r.doc_id: r.n_tokens for r in prefix_counts.count_tokens(df).collect()}[1] == n
    pieces = [r for r in packing.pack(df).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == n + 1 and all(r.doc_tokens == n + 1 for r in pieces)
    assert {r.doc_id: r.n_tokens for r in planes.read(planes.write(df, f"file://{tmp_path}/long")).collect()}[1] == n + 1
    assert {r.doc_id: r.n_words for r in rules.cascade(df, measures=True).collect()}[1] == 1_500_000
    assert simhash.groups(df).count() == 3
    assert {r.doc_id: r.n_removed for r in suffix.digest(df).collect()} == {1: 0, 2: 0, 3: 500}


def test_repeated_rows_of_a_suffix_table(spark):
    rng = random.Random(6)
    text = prose(rng, 60)
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix.digest(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    one = brute_repeats({1: text, 2: text})
    assert got[2][1] == one[2][1]


def test_operators_work_in_a_session_that_knows_only_the_path(tmp_path):
    """Skipped only where a cluster of one small worker cannot be started twice in a row."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
small = {{"spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}", "spark.executor.memory": "512m", "spark.sql.shuffle.partitions": "2"}}
spark = SparkSession.builder.master("local-cluster[1,1,512]").config(map=small).getOrCreate()
spark.range(1).count()
print("STARTED", flush=True)
from folioflow.llm import suffix
df = spark.createDataFrame([(1, "a " * 80), (2, "b " * 90)], "doc_id long, text string")
print("ROWS", suffix.remove(df).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        if "STARTED" in done.stdout:
            break
    else:
        pytest.skip("no local cluster starts here: " + done.stderr[-300:])
    assert "ROWS 2" in done.stdout, done.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(Session())


# -- the pipeline, stage by stage ------------------------------------------------------------
def brute_near(rows):
    """Kept ids: of the groups of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more, the smallest id."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in rows}
    near = lambda a, b: (len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])) if sets[a] or sets[b] else True
    label = brute_components(sorted(sets), near)
    return {k for k in sets if label[k] == k}


def test_pipeline_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(7)
    rows, labels = [], []
    shared = prose(rng, 70)
    for k in range(60):
        t = prose(rng, 80)
        if k % 10 == 1:
            t = rows[-1][1].replace(" the ", " a ", 1)  # a near copy of its predecessor
        if k % 10 == 3:
            t = t + " " + shared
        if k % 10 == 5:
            t = " ".join(w + "$$$" for w in t.split())
        if k % 10 == 7:
            t = t.replace(" and", " scum", 1) + " scum moron scum"
        lang = "en" if k % 2 else "fr"
        rows.append((k, t if lang == "en" else "le la les des " + t, lang, "s", len(t)))
        labels.append((k, int(k % 10 != 5), int(k % 10 == 7)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(C.STAGES)
    now = storage.settle(stages["quality"](spark, docs, sf), "t")
    model = ordinal.fit(docs, ordinal.load_labels(spark, sf))
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in ordinal.score(docs, model).collect() if r.tail_prob >= 0.5}
    after = storage.settle(stages["near_copies"](spark, now, sf), "t")
    assert {r.doc_id for r in after.collect()} == brute_near([(r.doc_id, r.text) for r in now.collect()])
    cut = storage.settle(stages["repeats"](spark, after, sf), "t")
    want = brute_repeats({r.doc_id: r.text for r in after.collect()})
    import hashlib

    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()} == {k: v[3] for k, v in want.items()}
    mixed = storage.settle(stages["mixture"](spark, cut, sf), "t")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(r.text == texts[r.doc_id] for r in mixed.collect()) and mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, sf).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(r.text)) + 1 for r in mixed.collect())
    assert sorted({r.doc_id for r in C.run(spark, sf).collect()}) == sorted({r.doc_id for r in packed})


@pytest.mark.parametrize("label", ["c#1", "a/64", "", "x|0"])
def test_labels_of_any_text_form_crowds(spark, label):
    rng = np.random.default_rng(3)
    rows = [(k, (np.ones(16) + rng.normal(size=16) * 0.01).tolist(), label) for k in range(40)] + [(100 + k, [1.0, k / 8], "a") for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in flatgraph.link(df, most=8, audit_queries=0).collect()}
    assert all(got[k] == (39, 0) for k in range(40)) and got[100] == (2, 100)


def test_draws_of_rows_without_or_with_repeated_ids(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, f"t{k}") for k in range(200)] + [(None, "same")] * 200 + [(5, f"u{k}") for k in range(200)] + [(6, "same")] * 200 + [(k, "v") for k in range(1000, 1200)], "doc_id long, text string")
    known = spark.createDataFrame([(k, "some words", "en") for k in range(4)], "doc_id long, text string, domain string")
    drawn = mixing._drawn(df.repartition(3), known, {"en": 1.0}, {})
    assert drawn.count() == 1000  # a rate of 1 keeps all
    rows = df.withColumn("n", mixing.copies(F.lit(0.5), F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()))
    assert all(60 < r.kept < 140 for r in rows.groupBy("doc_id", "text").count().filter("count > 1").join(rows.groupBy("doc_id", "text").agg(F.sum("n").alias("kept")), "text").select("kept").collect())
