"""Each operator against brute force, round trips and odd inputs, on small frames."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from folioflow.llm import features, flatgraph, graph, mixing, ordinal, packing, planes, prefix_counts, rules, simhash, suffix, urlfilter
from folioflow.llm import tokens as T

WORDS = "the of and in to is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [None, "", "  \n ", "a", "a\x00b it's café 日本語 <|endoftext|> x", "word " * 3000, "same text", "same text", "x" * 300]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, 7, None) for k, t in enumerate(ODD)] + [(3, "a", 7, None)], "doc_id long, text string, bucket int, spans string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library():
    return T.load(T.default_path()).library


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_librarys():
    bpe, rng = T.load(T.default_path()), random.Random(1)
    texts = [t or "" for t in ODD] + [prose(rng, 50) for _ in range(20)] + ["ÀÉ ×÷ ½² ''ll 're don't", "İ Σ ΑΣ ﬁ Ａ", " a b\u0085c"]
    ids, n = bpe.encode_texts(pa.array(texts))
    want = [ids_of(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_prefix_counts_at_every_byte():
    dp, rng = prefix_counts.dp_for(T.default_path()), random.Random(2)
    for text in [prose(rng, 12), "Internationalization!! of thththth 12ab éèÀß it's", "café 日本 x", "q" * 90]:
        at, data = prefix_counts.PrefixCounts(dp, pa.array([text])).at(0), text.encode()
        assert at.tolist() == [len(ids_of(data[:i].decode(errors="ignore"))) for i in range(len(data) + 1)]


def test_prefix_counts_of_all_scripts():
    dp, rng = prefix_counts.dp_for(T.default_path()), random.Random(3)
    texts = [
        "日本語の文章は単語の間に空白がなく、とても長い一つの語になる。" * 4, "Съешь ещё этих мягких французских булок", "they're we'll I've don't 'tis ''re x're' 'r 'l 'v rock'n'roll's",
        "e\u0301te\u0301 cafe\u0301\u0323 o\u0308\u0304z 각각 한\u1100\u1161\u11a8", "a<|endoftext|>b<|startoftext|><|endoftext|>c<|endof<|endoftext|", "İstanbul ﬁ Ω≠=\u0338 K", "ñandú¿qué?…“x” 12٣४ हिन्दी भाषा ภาษาไทย", "x\u00a0y\u2003\u2003z\u0085w 😀👍🏽é",
    ]
    texts += ["".join(rng.choice("ab'rels<|>é\u0301\u0323日5İ \u00a0") for _ in range(60)) for _ in range(30)]
    for text in texts:
        at, data = prefix_counts.PrefixCounts(dp, pa.array([text])).at(0), text.encode()
        want = [len(ids_of(data[:i].decode(errors="ignore"))) for i in range(len(data) + 1)]
        assert at.tolist() == want, text


def test_long_words_of_other_scripts():
    dp = prefix_counts.dp_for(T.default_path())
    text = "長い文" * 3000
    got = prefix_counts.PrefixCounts(dp, pa.array([text])).at(0)
    for i in (1, 2, 3, 100, 9001, len(text) * 3):
        assert got[i] == len(ids_of(text.encode()[:i].decode(errors="ignore")))


def test_count_tokens(odd, none):
    rows = prefix_counts.count_tokens(odd).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == sorted((k, len((t or "").encode()), len(ids_of(t))) for k, t in [*enumerate(ODD), (3, "a")])
    long = next(r for r in rows if r.over_limit)
    assert len(ids_of(ODD[5][: long.fit_bytes])) <= 2048 < len(ids_of(ODD[5][: long.fit_bytes + 5]))
    assert prefix_counts.count_tokens(none).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_round_trip(kind):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 49_408, n).astype("<u4") for n in (0, 1, 700, 5, 3000)]
    out = io.BytesIO()
    w = planes.Writer(out, kind, block=256)
    for k, d in enumerate(docs):
        w.add(np.array([k]), np.array([len(d)]), d)
    w.close()
    r = planes.Reader(out)
    assert all((got == docs[k]).all() for k, got in r.documents())
    assert (r.ids(3, 600) == np.concatenate(docs)[3:603]).all()


def test_plane_data_set(spark, odd, none, tmp_path):
    rows = planes.read(planes.write(odd.repartition(3), f"file://{tmp_path}/p"), with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    at = 0
    for r in rows:
        want = [*ids_of(ODD[r.doc_id]), 2]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert planes.read(planes.write(none, f"file://{tmp_path}/q")).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd, with_ids=True).collect()
    by_window, by_doc = {}, {}
    for r in rows:
        by_window.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for held in by_window.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        assert sum(r.length for r in held) <= 2048
    for doc, held in by_doc.items():
        if doc != 3:
            held.sort(key=lambda r: r.start)
            assert [i for r in held for i in r.ids] == [*ids_of(ODD[doc]), 1]
    assert packing.pack(none).count() == 0


def test_packer_leaves_one_window_open():
    rng, p = np.random.default_rng(4), packing.Packer(64, max_open=10)
    for k in range(500):
        p.add(k, np.full(rng.integers(1, 200), k, "<u4"))
    p.finish()
    fill = {}
    for doc, start, ids, n, seq, at in p.rows:
        assert fill.get(seq, 0) == at
        fill[seq] = at + len(ids)
    assert sum(f < 64 for f in fill.values()) <= 1 + 500 // 10


def brute_measures(t):
    import regex

    words = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if regex.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_rules(spark, none):
    rng = random.Random(5)
    texts = [*(t for t in ODD if t is None or len(t) < 400), "a b c a b c d", "x y\nx y\n \nx y\n", "a#b | <c> " * 9, prose(rng, 200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in rules.cascade(df, measures=True).collect()}
    for k, t in enumerate(texts):
        r, want = rows[k], brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    short = {r.doc_id: (r.kept, r.base_failed) for r in rules.cascade(df).collect()}
    assert short == {k: (r.kept, r.base_failed) for k, r in rows.items()}
    assert rules.cascade(none).count() == 0


def test_cascade_tries_rules_on_survivors_only():
    import pyarrow.compute as pc

    texts = pa.array(["short", "### " * 60, prose(random.Random(1), 80), None, "x y z " * 40, prose(random.Random(2), 90) + " |" * 300, "no thing..\nhere...\n" * 30])
    asked = []

    class Watched(rules.Measures):
        def __getitem__(self, name):
            return super().__getitem__(name)

    def rule(name, fails):
        return rules.Rule(name, lambda m: (asked.append((name, len(m.texts))), fails(m))[1])

    order = [rule(r.name, r.fails) for r in rules.DEFAULT]
    by, tried = rules.short_circuit(Watched(texts), len(texts), order)
    alone = {r.name: r.fails(rules.Measures(texts)) for r in rules.DEFAULT}
    for k in range(len(texts)):
        want = next((j for j, r in enumerate(rules.DEFAULT) if alone[r.name][k]), -1)
        assert by[k] == want
    assert [n for _, n in asked] == tried[: len(asked)]
    assert tried[0] == len(texts) and tried[-1] == (by < 0).sum() + (by == len(order) - 1).sum()
    for name in ("n_stop_words", "n_letter_words", "n_distinct_words", "n_cut_lines"):  # what is carried along is what is made anew
        m = rules.Measures(texts)
        m[name], m["words"], m["lines"]
        keep = np.array(pc.is_valid(texts))
        assert m.narrow(keep)[name].tolist() == rules.Measures(texts.filter(pa.array(keep)))[name].tolist()


def brute_fingerprint(t):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, linked):
    label = {k: k for k in items}
    change = True
    while change:
        change = False
        for a in items:
            for b in items:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    change = True
    return label


@pytest.mark.parametrize("bound", [4096, 1])
def test_simhash(spark, bound):
    rng = random.Random(6)
    base = [prose(rng, 120) for _ in range(6)]
    texts = [*ODD, *base, *(b.replace("the", "a", 1) for b in base), *(b + " zz" for b in base)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.groups(df, bound=bound).collect()}
    fp = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{f:016x}" for k, f in fp.items()}
    want = brute_components(list(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 2)
    assert {k: r.component_id for k, r in got.items()} == want


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    fps += [f ^ (1 << int(a)) ^ (1 << int(b)) for f in fps[:20] for a, b in [rng.integers(0, 62, 2)]]
    df = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    for bound in (4096, 1):
        parts = {r.node: r.component for r in graph.components(simhash.links(df, bound=bound)).collect()}
        want = brute_components(sorted(set(fps)), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
        assert {f: parts.get(f, f) for f in set(fps)} == want


def brute_repeats(texts):
    seen, out = set(), {}
    for k, t in sorted(texts.items()):
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [24_576, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(8)
    passage, long = prose(rng, 40), prose(rng, 400)
    texts = {k: t for k, t in enumerate([None, "", "short", "a" * 400, long, passage + " é " + prose(rng, 30), prose(rng, 9) + passage, long[:700] + "X" + long[701:], long, prose(rng, 20) + passage + passage, "日本" * 90])}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, h int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(df).collect()}
    assert got == brute_repeats(texts)
    assert suffix.digest(df.filter("false")).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(9)
    runs = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (30, 5, 60, 1)]
    data = np.frombuffer(b"\xff".join(runs) + b"\xff", np.uint8)
    cut = [r + bytes([255]) + bytes([k]) for k, r in enumerate(runs)]
    sa = suffix.suffix_array(data)
    owner = np.repeat(np.arange(4), [len(r) + 1 for r in runs])
    starts = np.cumsum([0] + [len(r) + 1 for r in runs])[:4]
    order = [cut[owner[i]][i - starts[owner[i]] :] for i in sa]
    assert order == sorted(order)


def test_components(spark):
    rng = np.random.default_rng(10)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    pairs = {frozenset(e) for e in edges}
    want = brute_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert {n: got.get(n, n) for n in nodes} == want


def brute_vectors(rows, least=0.93):
    """n_links and component of every (position in rows), rows: id, vector, label."""
    good = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    link = lambda a, b: a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least
    links = {k: sum(link(k, j) for j in good) if k in unit else 0 for k in range(len(rows))}
    label = brute_components(good, link)
    names = {}
    for k in good:
        names.setdefault(label[k], []).append(rows[k][0])
    component = {k: min((i for i in names[label[k]] if i is not None), default=None) if k in unit else rows[k][0] for k in range(len(rows))}
    return links, component


def planted_vectors():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 16))
    near = x[:40] + rng.normal(size=(40, 16)) * 0.08
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(np.concatenate([x, near, x[:5]]))]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [1.0, 2.0], 0), (905, [], 0), (906, [None] + [1.0] * 15, 0)]
    rows += [(7, x[90].tolist(), 0), (7, x[90].tolist(), 0), (None, x[3].tolist(), 1), (None, (x[100] * 9 + 50).tolist(), 1)]
    crowd = rng.normal(size=16)
    return rows + [(1000 + k, (crowd * (1 + k)).tolist(), 2) for k in range(90)] + [(2000 + k, (crowd + rng.normal(size=16) * 0.02).tolist(), 3) for k in range(130)]


@pytest.mark.parametrize("options", [{"most": 40, "visitors": 30}, {"most": 25, "exact": True}])
def test_flat_graph(spark, options):
    rows = planted_vectors()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, node string, v double").repartition(3)
    got = flatgraph.link(df, **options).collect()
    links, component = brute_vectors(rows)
    want = sorted((str(rows[k][0]), links[k], str(component[k]), rows[k][0] == component[k]) for k in links)
    have = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got)
    assert [h[0] for h in have] == [w[0] for w in want]
    if options.get("exact"):
        assert have == want
    assert sum(h[1] for h in have) >= 0.98 * sum(w[1] for w in want)
    assert np.mean([h[2:] == w[2:] for h, w in zip(have, want, strict=True)]) >= 0.98


def test_flat_graph_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert flatgraph.link(none).count() == 0


def test_url_rules(spark):
    from folioflow.llm.queries import URL_RULES

    hosts, paths = ["example.org", "a.example.org", "org", "xorg", "b.com", "example.org.net", "EXAMPLE.org"], ["", "/", "/es/1", "/en/12", "/fr/x?q", "/de/#a", "/de", "?/es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/es/", "http://"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    rows = {r.page_id: r for r in urlfilter.judge(df, URL_RULES).collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(h, p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        want = (host, path, best[0] + best[1] if best else None, best[2] if best else "allow")
        assert (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == want, u
    assert {r.page_id: r.rule for r in urlfilter.judge(df, URL_RULES, parts=7).collect()} == {k: r.rule for k, r in rows.items()}


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (best[4], best[3]) if best else (None, "allow")


def test_longest_url_rule_wins_over_many_ranges(spark):
    rng = random.Random(13)
    label = lambda: rng.choice(["a", "b", "c", "com", "org", "x-y"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice("pqr") * rng.randint(1, 3) for _ in range(rng.randint(0, 3)))
    rules = [("com", "/very/long/", "block"), ("a.com", "/", "allow"), ("", "/", "block")] + [(host(), path()[: rng.randint(0, 6)], rng.choice(["allow", "block"])) for _ in range(80)]
    pairs = [("a.com", "/very/long/x")] + [(host(), path()) for _ in range(400)] + [("hot.com", "/p")] * 300
    df = spark.createDataFrame([(k if k % 7 else None, f"http://{h}{p}", 0, "z") for k, (h, p) in enumerate(pairs)], "page_id long, url string, part int, key string").repartition(3)
    for parts in (1, 9):
        got = sorted(((r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules, parts=parts).collect()), key=str)
        assert got == sorted(((h, p, *brute_rule(h, p, rules)) for h, p in pairs), key=str)
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert urlfilter.judge(df, frame).count() == len(pairs)


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, []).collect()) == [("1", "a.b", "/c", None, "allow")] * 2 + [("None", "", "", None, "allow")]
    assert urlfilter.judge(df.filter("false"), [("b", "/", "block")]).count() == 0


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(12)
    rows = []
    for k in range(600):
        kind = k % 5
        t = prose(rng, 60)
        if kind == 0:
            t = t.replace(" the", " scum", 2) + " scum moron"
        if kind == 1:
            t = t.replace(" ", "$$$ ")
        rows.append((k, t, "en" if k % 2 else "fr", 0 if kind == 1 else 1, int(kind == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")


def test_ordinal_on_held_out_rows(spark, rated):
    model = ordinal.fit(rated, rated.filter("doc_id % 4 <> 0"))
    assert model.thresholds[0] < model.thresholds[1] and (model.weights <= 0).all()
    rows = ordinal.score(rated.filter("doc_id % 4 = 0"), model).join(rated, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1 and r.toxic == 0) for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "unseen wordings")], "doc_id long, text string")
    assert all(r.kept for r in ordinal.score(odd, model).collect())
    empty = ordinal.fit(rated, rated.filter("false"))
    assert all(r.kept is not None for r in ordinal.score(odd, empty).collect())


def test_mixing_meets_targets(spark, rated):
    texts = rated.selectExpr("doc_id", "CASE WHEN lang = 'fr' THEN concat('le la ', replace(text, 'the', 'les')) ELSE text END AS text", "lang", "lang AS domain")
    rows = mixing.rates(texts, texts, {"en": 0.7, "fr": 0.3}).collect()
    total = sum(r.tokens for r in rows)
    assert all(r.rate >= 0 for r in rows)
    assert sum(r.rate * r.tokens * r.p_en for r in rows) == pytest.approx(0.7 * total, rel=1e-3)
    drawn = mixing.resample(texts, texts, {"en": 0.7, "fr": 0.3})
    assert drawn.columns == texts.columns and drawn.count() > 0


def test_slots_are_stable():
    assert features.slots_of(["the"])[0] % 2 == 0 and features.slots_of(["$$$"])[0] % 2 == 1
