"""Vector codes and the tree of conversation prefixes against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioflow.llm import prefixtrie, queries, vectorcodes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for c in cut:
                of[near(c[p], books[p])].append(c[p])
            for e, xs in of.items():
                books[p][e] = tuple(sum(col) // len(xs) for col in zip(*xs, strict=True))
    codes = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    label = defaultdict(int)
    for (_, lab, _), e in zip(kept, errors, strict=True):
        label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in k), e, label[lab], digest) for (i, lab, _), k, e in zip(kept, codes, errors, strict=True)), key=str)


def got_codes(df, **options):
    return sorted((tuple(r) for r in vectorcodes.compress(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_nearest_is_the_first_of_the_nearest():
    rng = np.random.default_rng(0)
    for width in (1, 2, 4, 7):
        x, book = rng.integers(-4, 5, (500, width)), rng.integers(-4, 5, (40, width))
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        code, error = vectorcodes.nearest(x, book)
        assert (code == far.argmin(1)).all() and (error == far.min(1)).all()


def test_codes_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.3, 32)], None if k % 11 == 0 else f"l.{k % 3}") for k in range(300)]
    rows += [(1000, None, "a"), (1001, [None] * 32, "a"), (1002, [float("nan")] * 32, "a"), (1003, [float("inf")] * 32, None), (5, rows[7][1], "l.1"), (5, rows[7][1], "l.1"), (None, rows[9][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(5)
    assert got_codes(df) == plain_codes(rows)
    few = spark.createDataFrame(rows[:9], "vec_id long, embedding array<float>, label string")
    assert got_codes(few) == plain_codes(rows[:9])


def test_odd_vectors_and_columns(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert got_codes(empty) == []
    odd = spark.createDataFrame([(1, [1.0, 2.0], 3, 0), (2, [], 3, 0), (3, [1e300, -1e300, 0.5], None, 0)], "`the id` long, `a.b` array<double>, `l``x` int, code int")
    got = vectorcodes.compress(odd, parts=2, id_col="the id", vector_col="a.b", label_col="l`x").orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(1, "0000", 0), (2, "0100", 0), (3, "0202", 0)]
    books = vectorcodes.fit(vectorcodes.integers(odd, "the id", "a.b", "l`x"), 2)
    assert vectorcodes.decode(["0000"], books).tolist() == [[1.0, 2.0, 0.0, 0.0]]


def test_registered_codes_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.QUERIES["op11_vector_codes"](spark, sf_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_codes(rows)


def plain_tree(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    ends = {node: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node)))).encode()).hexdigest() for node, m in members.items()}
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], ends[n]) for n, m in members.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def got_tree(df, **options):
    return sorted((tuple(r) for r in prefixtrie.tree(df, **options).collect()), key=str)


def made_turns(seed, convs, deep=6, choices=2):
    rng = random.Random(seed)
    return [(c, d, rng.choice(["user", "bot"]) if d else "user", f"w{rng.randrange(choices) if d else 0} " * rng.randrange(1, 3)) for c in range(convs) for d in range(rng.randrange(1, deep))]


@pytest.mark.parametrize("held", [4, 40, 1024])
def test_tree_against_a_plain_version(spark, held):
    rows = made_turns(held, 150)
    rows += [(1000 + k, d, "user", f"same {d}") for k in range(30) for d in range(4)]  # copies, with heads of an absent or a present family
    rows += [(2000 + k, d, "user", f"chain {d}" if d < 7 else f"{k} {d}") for k in range(25) for d in range(9)]  # a long common stem
    rows += [(3001, None, None, None), (3001, 0, "", ""), (3001, 0, "a", None), (3001, 0, "a", None), (None, 1, "x", "y"), (3003, 0, "u", "one"), (-45, 0, "u", "minus"), (4000, 0, "u", "long " * 200_000)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert got_tree(df, held=held, together=64) == plain_tree(rows)


def test_hot_copies_are_one_path(spark):
    rows = [(c, d, "user", f"t{d}") for c in range(3000) for d in range(3)]
    df = spark.createDataFrame(rows, TURNS)
    assert got_tree(df, held=2) == plain_tree(rows)


def test_empty_tables_and_other_names(spark):
    assert got_tree(spark.createDataFrame([], TURNS)) == []
    df = spark.createDataFrame([(7, 1, "u", "a b", 1, 2)], "`c.id` long, turn long, role string, `te``xt` string, path int, seg int")
    assert len(got_tree(df, id_col="c.id", text_col="te`xt")) in (1, 2)


def test_registered_tree_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_prefix_trie"](spark, sf_dir).collect()), key=str) == plain_tree(rows)
