"""Reading and layout artifacts, snippets, scripts beyond ASCII, release files."""

import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import artifacts as A
from folioflow.operators import pixels as P
from folioflow.sources import files

BOX = "[[10.0,20.0],[30.0,20.0],[30.0,40.0],[10.0,40.0]]"


def page(spark, json_text):
    kind = f"array<{A.PAGE}>"
    return spark.range(1).select(A.tokens(F.from_json(F.lit(json_text), kind)).alias("t")).first()["t"]


def test_tokens_of_both_shapes(spark):
    items = '[{"items":[{"box":%s,"text":"Invoice","score":".95"},{"box":%s,"text":" INV-123 ","score":"x"}]}]' % (BOX, BOX)
    by_place = '[{"rec_texts":["Invoice"," ","INV-123"],"rec_scores":["0.91"],"rec_polys":[%s]}]' % BOX
    got = page(spark, items)
    assert [(t.text, t.confidence, len(t.bbox)) for t in got] == [("Invoice", 0.95, 4), ("INV-123", 0.0, 4)]
    got = page(spark, by_place)
    assert [(t.text, t.confidence, len(t.bbox)) for t in got] == [("Invoice", 0.91, 4), ("INV-123", 0.0, 0)]
    assert len(page(spark, items[:-1] + "," + by_place[1:])) == 4 and page(spark, "null") == []


def test_measured_tokens(spark):
    df = spark.createDataFrame([([("Total", 92.5, 10, 20, 60, 18), ("  ", 90.0, 0, 0, 1, 1), ("x", -1.0, 0, 0, 1, 1)],)], "w array<struct<text:string,conf:double,left:int,top:int,width:int,height:int>>")
    got = df.select(A.measured_tokens(F.col("w")).alias("t")).first()["t"]
    assert [(t.text, t.confidence, t.bbox) for t in got] == [("Total", 0.925, [[10, 20], [70, 20], [70, 38], [10, 38]])]


def test_summary(spark):
    df = spark.createDataFrame([([("Invoice", [], 0.9), ("INV-001", [], 0.8)], None), ([], "ocr_fallback:service_busy")], f"t array<{A.TOKEN}>, full string")
    rows = df.select(A.summary(F.col("t"), F.col("full"), F.lit(0.3), F.lit(False)).alias("s")).collect()
    assert tuple(rows[0].s) == ("Invoice INV-001", 2, 0.85, False) and tuple(rows[1].s) == ("ocr_fallback:service_busy", 0, 0.3, True)


@pytest.mark.parametrize(("points", "want"), [("[[10,20],[30,20],[30,40],[10,40]]", (10, 20, 30, 40)), ("[[10,20,30,40]]", (10, 20, 30, 40)), ("[[1,1],[1,5]]", None), ("[]", None)])
def test_box(spark, points, want):
    r = spark.range(1).select(A.box(F.from_json(F.lit(points), "array<array<double>>")).alias("b")).first()["b"]
    assert (tuple(r) if r else None) == want


def test_blank_and_boxless_tokens_are_not_placed(spark):
    df = spark.createDataFrame([(1, [("a", [[10.0, 20.0], [30.0, 40.0]], 0.9), ("b", [], 0.8), (" ", [[0.0, 0.0], [5.0, 5.0]], 0.7)])], f"job_id long, t array<{A.TOKEN}>")
    assert [(r["index"], r.x1, r.cx) for r in A.placed_tokens(df, "t", F.lit(200), F.lit(100)).collect()] == [(0, 10, 20.0)]


def brute_snippets(pattern, text):
    out = []
    for m in re.finditer(pattern, text):
        s = text[max(0, m.start() - 40) : m.end() + 40].strip()
        if s and s not in out:
            out.append(s)
        if len(out) == 3:
            break
    return out


@pytest.mark.parametrize("text", ["total", "", "no", "total 5 " + "x" * 60 + " total 6", "total total total total", "é total 日本 " * 9, "a " * 30 + "total" + " b" * 30 + " total end"])
def test_snippets(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(A.snippets(F.col("t"), r"\btotal\b").alias("s")).first()["s"]
    assert got == brute_snippets(r"\btotal\b", text)


@pytest.mark.parametrize(("content", "want"), [('x {"a": 1} y', '{"a":1}'), ("none", None), ("} {", None), ('{"a": 1}, {"b": 2}', None), ("[1]", None), ('{"a": ', None)])
def test_answers(spark, content, want):
    got = spark.createDataFrame([(content,)], "t string").select(F.to_json(A.answer_of(F.col("t"))).alias("s")).first()["s"]
    assert got == want


@pytest.mark.parametrize("text", [" a  b ", "\ttab\x1fsep\x85x", "İ É ß", "plain", "", "a　 b"])
def test_white_space_of_all_scripts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(X.collapse(F.col("t")).alias("c"), X.collapsed_value(F.col("t")).alias("d"), X.strip(F.col("t")).alias("s")).first()
    want = re.sub(r"\s+", " ", text).strip()
    assert (r.c, r.d, r.s) == (want, want, text.strip())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_error_rate_of_many_words(spark):
    e, p = [f"w{k}" for k in range(40_000)], [f"w{k}" if k % 1000 else "é" for k in range(39_990)]
    few = spark.createDataFrame([("a b c", "a é c d"), ("日 本", "日"), (" ", "x")], "e string, p string")
    got = [r.w for r in few.select(X.wer(F.col("e"), F.col("p")).alias("w")).collect()]
    assert got == [round(distance("a b c".split(), "a é c d".split()) / 3, 6), 0.5, None]
    from pyspark.sql.functions import size

    many = spark.createDataFrame([(" ".join(e[:300]), " ".join(p[:299]))], "e string, p string").select(X.wer(F.col("e"), F.col("p")).alias("w"), size(F.split("e", " ")).alias("n")).first()
    assert many.w == round(distance(e[:300], p[:299]) / 300, 6)


def test_two_empty_values_match(spark):
    from folioflow.operators import quality as Q

    df = spark.createDataFrame([({"total_amount": "Rp"}, {"total_amount": ""})], "e map<string,string>, p map<string,string>")
    c = df.select(Q.compare_fields(F.col("e"), F.col("p")).alias("c")).first()["c"]
    assert (c.expected_field_count, c.predicted_present_count, c.correct_field_count) == (1, 0, 1)


@pytest.mark.parametrize(("angle", "want"), [(-50.0, 0.0), (-80.0, 10.0), (88.0, -2.0), (50.0, 0.0), (3.0, 3.0)])
def test_correction(spark, angle, want):
    assert spark.range(1).select(P.correction(F.lit(angle), F.lit(100)).alias("c")).first()["c"] == want


def test_checksums_and_masks(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    want = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string")
    assert {r.path: r.reason for r in files.checksums(found, want).collect()} == {"b": "changed", "c": "missing"}
    assert files.masked(found, ["sha256"]).first().sha256 == "***"


def test_thresholds_and_tables(spark, tmp_path):
    from folioflow.operators import lifecycle

    p = tmp_path / "t.json"
    p.write_text('{"min_field_f1": 0.7, "note": "x", "max_ocr_cer": "0.3"}')
    assert {r.metric: r.threshold for r in files.thresholds(spark, str(p)).collect()} == {"min_field_f1": 0.7, "max_ocr_cer": 0.3}
    spark.sql(f"CREATE DATABASE IF NOT EXISTS life LOCATION 'file://{tmp_path}/life'")
    lifecycle.ensure_tables(spark, "life")
    lifecycle.ensure_tables(spark, "life")
    assert spark.table("life.ingestion_jobs").columns[:4] == ["job_id", "tenant_id", "source", "status"] and spark.table("life.ingestion_audit_events").count() == 0
    spark.sql("DROP DATABASE life CASCADE")


def test_layout_analysis_reads_its_tokens_once_beside_kept_blocks(spark, sf_dir):
    from folioflow.plans import artifacts

    plan = artifacts.layout_analysis(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert sum("FileScan" in line and "l_linenumber" in line for line in plan.splitlines()) == 1
    assert "aggregate(" not in plan  # lines are not folded again
