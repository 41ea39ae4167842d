import random

SCHEMA = "doc_id long, text string"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))


def test_unique_rows_without_an_id_stay(spark):
    from folioflow.llm import nearcopies

    rng = random.Random(1)
    a, b, c = (" ".join(word(rng) for _ in range(50)) for _ in range(3))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c), (8, c)]
    got = nearcopies.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (None, b), (7, c)], key=str)


def test_rows_without_an_id_lose_only_what_starts_earlier(spark):
    from folioflow.llm import suffix

    rng = random.Random(2)
    own = [" ".join(word(rng) for _ in range(40)) for _ in range(3)]
    passage = " ".join(word(rng) for _ in range(40))
    rows = [(None, own[0] + passage), (None, own[1] + passage), (5, own[2] + passage)]
    kept = [r.text for r in suffix.remove(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sum(passage in t for t in kept) == 1
    assert all(any(t.startswith(o) for t in kept) for o in own)
    assert sum(map(len, kept)) == sum(map(len, own)) + len(passage)
    digest = suffix.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_removed for r in digest) == [0, len(passage), len(passage)]


def test_plane_files_keep_missing_ids(spark, tmp_path):
    from folioflow.llm import planes

    rows = [(None, "one two"), (0, "three"), (None, ""), (-(2**63), "four")]
    got = planes.read(planes.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/planes")).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
