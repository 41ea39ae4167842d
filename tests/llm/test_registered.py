"""The registered queries themselves, over whole small tables, against plain versions."""

import os
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

from folioflow.llm import queries

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import ids_of  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    bits = np.zeros(64, np.int64)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        bits += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(grams))


def test_op2(spark, sf_dir, docs):
    prints = {d: fingerprint(t) for d, t in docs.items()}
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op2_simhash_neardup"](spark, sf_dir).collect()}
    assert got == {(d, f"{prints[d]:016x}", find(d)) for d in ids}


def test_op3_op4_op6(spark, sf_dir, docs):
    ids = {d: ids_of(t) for d, t in docs.items()}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op3_prefix_token_counts"](spark, sf_dir).collect()}
    assert counts == {d: (len(docs[d].encode()), len(i), len(i) > 2048) for d, i in ids.items()}
    crc = lambda xs: zlib.crc32(np.array(xs, "<u4").tobytes())
    want, start = {}, 0
    for d in sorted(ids):
        own = [*ids[d], 2]
        want[d] = (start, len(own), crc(own))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op4_bitplane_tokens"](spark, sf_dir).collect()} == want
    pieces = queries.QUERIES["op6_sum_of_squares_packing"](spark, sf_dir).collect()
    windows, seen = {}, {d: 0 for d in ids}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        own = [*ids[p.doc_id], 1]
        assert p.start == seen[p.doc_id] and p.doc_tokens == len(own) and p.ids_crc32 == crc(own[p.start : p.start + p.length])
        seen[p.doc_id] += p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert seen == {d: len(i) + 1 for d, i in ids.items()}
    for own in windows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def test_op8_on_a_table_with_links(spark, tmp_path):
    """The query's own table has no link; here every vector has near copies, in one large crowd and in many small groups."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 32))
    rows = [(k, (base[k % 40] + rng.normal(size=32) * 0.12).astype(float).tolist(), k % 3) for k in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op8_flat_graph_neardup"](spark, f"file://{tmp_path}").collect()}
    x = np.array([np.float32(v) for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([lab for *_, lab in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    root = np.arange(400)
    for _ in range(400):
        low = np.minimum(root, np.where(link, root[None, :], 400).min(1))
        if (low == root).all():
            break
        root = low
    want = {k: (int(link[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(400)}
    assert sum(w[0] for w in want.values()) > 900 and got == want


def test_op9_has_a_row_a_page(spark, sf_dir):
    assert queries.QUERIES["op9_url_range_join"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
