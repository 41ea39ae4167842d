"""Queries over reading and layout artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.operators import artifacts as A
from folioflow.operators import extract as X
from folioflow.operators import layout as L
from folioflow.plans import intake as I
from folioflow.plans import oracle as O
from folioflow.plans.register import registry
from folioflow.sources.files import keep
from folioflow.sources.tables import CORPUS, corpus, plain_sql, run_sql, table

QUERIES, ORACLE_SQL, query = registry()


def results(spark, sf_dir):
    """Engine results over the corpus texts, a token a line: by order key in the one shape, in the other, on two pages, or nothing."""
    t = corpus(spark, sf_dir).select("job_id", F.split("text", "\n").alias("lines"), "ocr_confidence", "fallback_used")
    k, n = F.col("job_id"), F.size("lines")
    score = lambda i: ((k + i) % 10 / 10).cast("string")
    point = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    poly = lambda i: F.array(point(F.lit(10), i * 20), point(10 + (k + i) % 60, i * 20), point(10 + (k + i) % 60, i * 20 + 12), point(F.lit(10), i * 20 + 12))
    places = F.sequence(F.lit(0), n - 1)
    none = F.lit(None)
    by_place = F.struct(F.col("lines").alias("rec_texts"), F.slice(F.transform(places, score), F.lit(1), n - 1).alias("rec_scores"), F.transform(places, poly).alias("rec_polys"), none.cast("array<array<array<double>>>").alias("dt_polys"), none.cast("array<struct<box:array<array<double>>,text:string,score:string>>").alias("items"))
    items = F.transform("lines", lambda x, i: F.struct(poly(i).alias("box"), F.concat(F.lit(" "), x).alias("text"), F.when(i % 4 == 3, "n/a").otherwise(score(i)).alias("score")))
    itemised = F.struct(none.cast("array<string>").alias("rec_texts"), none.cast("array<string>").alias("rec_scores"), none.cast("array<array<array<double>>>").alias("rec_polys"), none.cast("array<array<array<double>>>").alias("dt_polys"), items.alias("items"))
    pages = F.when(k % 4 == 0, F.array(by_place)).when(k % 4 == 1, F.array(itemised)).when(k % 4 == 2, F.array(by_place, itemised)).otherwise(none.cast(f"array<{A.PAGE}>"))
    return t.withColumn("found", A.tokens(pages))


TOK = f"""c AS ({plain_sql(CORPUS)}), l AS (SELECT job_id, ocr_confidence, fallback_used, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM c),
both_ AS (SELECT *, 0 AS page, CASE WHEN i = n - 1 THEN 0.0 ELSE cast((job_id + i) % 10 AS double) / 10 END AS confidence FROM l WHERE job_id % 4 IN (0, 2)
 UNION ALL SELECT *, 1 AS page, CASE WHEN i % 4 = 3 THEN 0.0 ELSE cast((job_id + i) % 10 AS double) / 10 END AS confidence FROM l WHERE job_id % 4 IN (1, 2)),
tok AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS word, row_number() OVER (PARTITION BY job_id ORDER BY page, i) - 1 AS k FROM both_ WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '')"""


@query(f"WITH {TOK} SELECT job_id, k::int AS place, word AS text, confidence, 4 AS points FROM tok")
def ocr_tokens(spark, sf_dir):
    t = results(spark, sf_dir).select("job_id", F.posexplode("found").alias("place", "t"))
    return t.select("job_id", "place", "t.text", "t.confidence", F.size("t.bbox").alias("points"))


SUMS = f"{TOK}, s AS (SELECT job_id, string_agg(word, ' ' ORDER BY k) AS text, string_agg(word, chr(10) ORDER BY k) AS lines, count(*) AS n, round(avg(confidence), 4) AS mean FROM tok GROUP BY job_id)"


@query(f"""WITH {SUMS} SELECT c.job_id, coalesce(s.text, regexp_replace(c.text, '^\\s+|\\s+$', '', 'g')) AS text, coalesce(s.n, 0)::int AS token_count, coalesce(s.mean, c.ocr_confidence) AS mean_confidence, c.fallback_used, len(string_split(coalesce(s.lines, regexp_replace(c.text, '^\\s+|\\s+$', '', 'g')), chr(10)))::int AS n_lines FROM c LEFT JOIN s ON c.job_id = s.job_id""")
def ocr_document_text(spark, sf_dir):
    t = results(spark, sf_dir).join(corpus(spark, sf_dir).select("job_id", "text"), "job_id")
    one = t.select("job_id", A.summary(F.col("found"), F.col("text"), F.col("ocr_confidence"), F.col("fallback_used")).alias("a"), A.summary(F.col("found"), F.col("text"), F.col("ocr_confidence"), F.col("fallback_used"), "\n")["text"].alias("lines"))
    return one.select("job_id", "a.*", F.size(F.split("lines", "\n")).alias("n_lines"))


@query(f"""WITH {SUMS} SELECT c.job_id, CASE WHEN s.n IS NOT NULL THEN s.n ELSE 1 END::int AS token_count, CASE WHEN s.n IS NULL THEN 'ocr_fallback:' || CASE WHEN c.job_id % 5 = 0 THEN 'invalid_image' WHEN c.job_id % 5 = 1 THEN repeat('e', 120) WHEN c.job_id % 5 = 2 THEN 'service_busy' ELSE 'runtime' END END AS reason,
 CASE WHEN s.n IS NULL THEN 0.2 ELSE s.mean END AS mean_confidence, s.n IS NULL AS fallback_used FROM c LEFT JOIN s ON c.job_id = s.job_id""")
def ocr_fallback_token(spark, sf_dir):
    k = F.col("job_id") % 5
    why = A.fallback_text(k != 0, F.when(k == 1, F.repeat(F.lit("e"), 300)), F.when(k == 2, "service_busy").otherwise(""))
    t = results(spark, sf_dir).withColumn("found", A.or_fallback(F.col("found"), why))
    s = A.summary(F.col("found"), F.lit(""), F.lit(0.0), F.lit(False))
    t = t.select("job_id", "found", s.alias("s"))
    return t.select("job_id", "s.token_count", F.when(F.col("s.fallback_used"), F.col("s.text")).alias("reason"), "s.mean_confidence", "s.fallback_used")


WORDS = "SELECT l_orderkey AS job_id, l_linenumber AS k, CASE WHEN l_partkey % 11 = 0 THEN '  ' ELSE ' w' || cast(l_partkey as string) || '  x ' END AS text, CASE WHEN l_suppkey % 7 = 0 THEN -1.0 WHEN l_suppkey % 7 = 1 THEN 140.0 ELSE l_quantity END AS conf, cast(l_partkey % 90 as int) AS left, cast(l_linenumber * 15 as int) AS top, cast(l_quantity as int) AS width, cast(12 as int) AS height FROM {lineitem}"


@query(f"""SELECT job_id, 'w' || trim(substr(trim(text), 2)) AS text, greatest(0.0, least(1.0, conf / 100)) AS confidence, cast("left" AS double) AS x1, cast("top" AS double) AS y1, cast("left" + width AS double) AS x2, cast("top" + height AS double) AS y2 FROM ({plain_sql(WORDS).replace(' AS left', ' AS "left"').replace(' AS top', ' AS "top"')}) WHERE trim(text) <> '' AND conf >= 0""".replace("'w' || trim(substr(trim(text), 2))", "regexp_replace(trim(text), '\\s+', ' ', 'g')"))
def measured_tokens(spark, sf_dir):
    t = run_sql(spark, sf_dir, WORDS).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("k", "text", "conf", "left", "top", "width", "height"))).alias("words"))
    t = t.select("job_id", F.explode(A.measured_tokens(F.col("words"))).alias("t"))
    at = lambda p, c: F.col("t.bbox")[p][c]
    return t.select("job_id", "t.text", "t.confidence", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(2, 0).alias("x2"), at(2, 1).alias("y2"))


@query(f"""WITH {TOK}, b AS (SELECT job_id, k, word, confidence, 10 AS x1, least(100, i * 20) AS y1, least(60, 10 + (job_id + i) % 60) AS x2, least(100, i * 20 + 12) AS y2 FROM tok)
SELECT job_id, k::int AS "index", word AS text, confidence, x1::int AS x1, y1::int AS y1, x2::int AS x2, y2::int AS y2, round((x1 + x2) / cast(2 AS double), 3) AS cx, round((y1 + y2) / cast(2 AS double), 3) AS cy FROM b WHERE x2 > x1 AND y2 > y1""")
def placed_tokens(spark, sf_dir):
    return A.placed_tokens(results(spark, sf_dir), "found", F.lit(60), F.lit(100))


MODEL = "SELECT l_orderkey AS job_id, l_linenumber AS k, l_discount * 5 AS score, CASE l_linenumber % 3 WHEN 0 THEN 'Table' WHEN 1 THEN '' ELSE NULL END AS type, cast(l_partkey % 90 as double) - 20.5 AS x1, cast(l_suppkey % 90 as double) - 10.25 AS y1, cast(l_partkey % 90 as double) + l_quantity AS x2, cast(l_suppkey % 90 as double) + l_quantity / 3 AS y2, cast(70 as int) AS width, cast(50 as int) AS height FROM {lineitem}"


@query(f"""WITH m AS ({plain_sql(MODEL)}), b AS (SELECT *, greatest(0, least(70, round_even(x1, 0)::int)) AS a, greatest(0, least(50, round_even(y1, 0)::int)) AS b_, greatest(0, least(70, round_even(x2, 0)::int)) AS c, greatest(0, least(50, round_even(y2, 0)::int)) AS d FROM m)
SELECT job_id, printf('b%04d', k) AS id, coalesce(nullif(type, ''), 'text') AS type, a AS x1, b_ AS y1, c AS x2, d AS y2, round(score, 4) AS score FROM b WHERE c > a AND d > b_ AND score >= 0.35""")
def detected_blocks(spark, sf_dir):
    return A.detected(run_sql(spark, sf_dir, MODEL))


# -- whole pages: lines, tokens in blocks, what is left over -------------------------
def pages(spark, sf_dir):
    """A page for every order: 200 wide, 70 or 120 high."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit(200).alias("width"), F.when(F.col("o_orderkey") % 2 == 0, 70).otherwise(120).alias("height"))


def page_blocks_of(spark, sf_dir):
    lines = L.line_blocks(I.tokens(spark, sf_dir)).select("job_id", "id", "x1", "y1", "x2", "y2")
    return A.page_blocks(pages(spark, sf_dir), lines)


LINES = I.ORACLE_SQL["line_blocks"]
PAGE_SQL = f"""ln AS ({LINES}), pg AS (SELECT o_orderkey AS job_id, 200 AS width, CASE WHEN o_orderkey % 2 = 0 THEN 70 ELSE 120 END AS height FROM orders),
blk AS (SELECT ln.job_id, printf('b%04d', line::int) AS id, 'text' AS type, x1::int AS x1, y1::int AS y1, least(x2, width)::int AS x2, least(y2, height)::int AS y2, cast(0.65 AS double) AS score, 'heuristic_ocr_line' AS source FROM ln JOIN pg ON ln.job_id = pg.job_id
 UNION ALL SELECT job_id, 'b0000', 'page', 0, 0, width, height, cast(0.5 AS double), 'heuristic_page' FROM pg WHERE job_id NOT IN (SELECT job_id FROM ln))"""


@query(f"WITH {PAGE_SQL} SELECT job_id, id, type, x1, y1, x2, y2, score, source FROM blk")
def page_blocks(spark, sf_dir):
    return page_blocks_of(spark, sf_dir)


@query(f"""WITH {PAGE_SQL}, {I.N}, b AS (SELECT * FROM blk), {I.P}, t AS (SELECT job_id, id, string_agg(text, ' ' ORDER BY y1, x1, "index", text) AS text, count(*) AS k FROM p GROUP BY ALL),
rest AS (SELECT job_id, count(*) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.job_id = n.job_id AND p."index" = n."index") GROUP BY ALL),
o AS (SELECT blk.job_id, blk.id, row_number() OVER (PARTITION BY blk.job_id ORDER BY y1, x1, blk.id) AS r, t.text, t.k FROM blk LEFT JOIN t ON blk.job_id = t.job_id AND blk.id = t.id),
s AS (SELECT job_id, count(*) AS blocks, count(text) AS zones, string_agg(text, chr(10) ORDER BY r) AS full_text FROM o GROUP BY job_id)
SELECT s.job_id, (blocks + CASE WHEN rest.k IS NULL THEN 0 ELSE 1 END)::int AS block_count, (zones + CASE WHEN rest.k IS NULL THEN 0 ELSE 1 END)::int AS text_zone_count, coalesce(rest.k, 0)::int AS left_over, coalesce(full_text, '') AS full_text FROM s LEFT JOIN rest ON s.job_id = rest.job_id""")
def layout_analysis(spark, sf_dir):
    # lines are folded once, tokens meet blocks once: both are read several times
    tokens, blocks = I.tokens(spark, sf_dir), keep(page_blocks_of(spark, sf_dir).select("job_id", "id", "type", "x1", "y1", "x2", "y2"), "layout-blocks")
    found = L.block_texts(L.assign(tokens, blocks, how="left"), F.collect_list("index").alias("places")).select("job_id", F.struct("id", "text", "token_count", "places").alias("of"))
    found = found.groupBy("job_id").agg(F.collect_list("of").alias("found"))
    page = blocks.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "id", "type"))).alias("own")).join(found, "job_id", "left")
    taken, left = F.filter("found", lambda f: f["id"].isNotNull()), F.get(F.filter("found", lambda f: f["id"].isNull()), F.lit(0))
    page = page.withColumn("_text", F.map_from_entries(F.transform(taken, lambda f: F.struct(f["id"], f["text"])))).withColumn("_places", F.flatten(F.transform(taken, lambda f: f["places"]))).withColumn("_left", left)
    # a token that shares its index with one that a block took is not left over
    page = page.withColumn("_rest", F.nullif(F.col("_left.token_count") - F.size(F.filter("_left.places", lambda i: F.array_contains("_places", i))), F.lit(0)))
    page = page.withColumn("blocks", F.transform("own", lambda b, k: F.struct(b["type"].alias("type"), k.alias("reading_order"), F.try_element_at("_text", b["id"]).alias("text"))))
    more = F.when(F.col("_rest").isNull(), 0).otherwise(1)
    zones = F.size(F.filter("blocks", lambda b: F.coalesce(b["text"], F.lit("")) != ""))
    return page.select("job_id", (F.size("blocks") + more).alias("block_count"), (zones + more).alias("text_zone_count"), F.coalesce("_rest", F.lit(0)).cast("int").alias("left_over"), A.layout_text(F.col("blocks")).alias("full_text"))


@query(f"WITH {PAGE_SQL} SELECT job_id, count(*)::int AS block_count, array_to_string(list_sort(list_distinct(list(CASE WHEN id = 'b0001' THEN 'unknown' ELSE type END))), ',') AS block_types FROM blk GROUP BY job_id")
def layout_features(spark, sf_dir):
    t = page_blocks_of(spark, sf_dir).withColumn("type", F.when(F.col("id") == "b0001", "").otherwise(F.col("type")))
    t = t.groupBy("job_id").agg(F.collect_list(F.struct("type", "id")).alias("blocks"))
    return t.select("job_id", F.size("blocks").alias("block_count"), F.array_join(A.block_types(F.col("blocks")), ",").alias("block_types"))


@query("SELECT conv_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY turn, role, text) AS text, count(*) AS blocks FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY conv_id")
def reading_order_text(spark, sf_dir):
    # turns stand in for blocks: their number is the reading order, equal numbers go by role and text
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("reading_order"), "role", "text"))).alias("b"))
    t = t.select("conv_id", A.layout_text(F.col("b")).alias("text"), F.size(F.filter("b", lambda x: F.trim(F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"\s+", " ")) != "")).cast("long").alias("blocks"))
    return t.filter("blocks > 0")


@query(f"""WITH c AS ({plain_sql(CORPUS)}), l AS (SELECT job_id, text, CASE job_id % 4 WHEN 0 THEN NULL WHEN 1 THEN left(text, 15) WHEN 2 THEN left(text, greatest(1, (length(text) // 2)::int)) ELSE replace(text, chr(10), ' ') END AS layout FROM c)
SELECT job_id, coalesce(layout, '') <> '' AND length(coalesce(layout, '')) >= greatest(20, length(text) // 2) AS layout_used, length(CASE WHEN coalesce(layout, '') <> '' AND length(coalesce(layout, '')) >= greatest(20, length(text) // 2) THEN layout ELSE text END) AS n FROM l""")
def chosen_text(spark, sf_dir):
    k = F.col("job_id") % 4
    half = F.greatest(F.lit(1), F.floor(F.length("text") / 2)).cast("int")
    layout = F.when(k == 1, F.left("text", F.lit(15))).when(k == 2, F.left(F.col("text"), half)).when(k == 3, F.replace("text", F.lit("\n"), F.lit(" ")))
    t = corpus(spark, sf_dir).select("job_id", X.chosen_text(F.col("text"), layout).alias("c"))
    return t.select("job_id", "c.layout_used", F.length("c.text").cast("long").alias("n"))


BLOBS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Sure! ```json {"invoice_number": "INV-1", "confidence": 0.8} ``` done' WHEN 1 THEN '{"confidence": "x"}' WHEN 2 THEN 'no answer' WHEN 3 THEN '} {' WHEN 4 THEN '[{"a": 1}, {"b": 2}]' ELSE '{"invoice_number": null, "confidence": 1' END AS content FROM {events}"""


@query("""SELECT event_id, event_id % 6 IN (0, 1) AS found, CASE WHEN event_id % 6 = 0 THEN 'INV-1' END AS invoice_number, CASE WHEN event_id % 6 = 0 THEN cast(0.8 AS double) END AS confidence FROM events""")
def model_answers(spark, sf_dir):
    from folioflow.operators import contracts as C

    t = run_sql(spark, sf_dir, BLOBS).select("event_id", A.answer_of(F.col("content")).alias("a"))
    sure = F.when(C.kind(C.part(F.col("a"), "confidence")) == "number", F.try_variant_get("a", "$.confidence", "double"))
    return t.select("event_id", F.col("a").isNotNull().alias("found"), C.text(F.col("a"), "invoice_number").alias("invoice_number"), sure.alias("confidence"))


#: What a model said beforehand: for some documents the total, for some a confidence, now and then nothing.
def modelled(spark, sf_dir):
    k = F.col("job_id")
    t = corpus(spark, sf_dir).withColumn("route", F.col("expected_route"))
    fields = F.when(k % 3 == 0, F.create_map(F.lit("total_amount"), F.lit(" 7  EUR "), F.lit("supplier_name"), F.lit("never"), F.lit("invoice_date"), F.lit("2026-02-02"))).when(k % 3 == 1, F.create_map(F.lit("summary"), F.lit("")))
    return t.withColumn("said", fields).withColumn("sure", F.when(k % 6 == 0, F.lit(0.99)).when(k % 6 == 1, F.lit(3.0)))


def _decided() -> str:
    """Per document: fields after the model, confidence before and after."""
    asked = "(c0 < 0.8 OR expected_route = 'generic' OR fallback_used) AND job_id % 3 <> 2"
    fix = lambda k: "CASE WHEN " + asked + f" AND job_id % 3 = 0 AND f{k} = '' THEN CASE {O.name_sql(k)} WHEN 'total_amount' THEN '7 EUR' WHEN 'supplier_name' THEN 'never' WHEN 'invoice_date' THEN '2026-02-02' ELSE '' END ELSE f{k} END AS g{k}"
    fill = lambda p: " + ".join(f"({p}{k} <> '')::int" for k in range(5))
    return f"""WITH corpus AS ({plain_sql(CORPUS)}), classified AS (SELECT *, expected_route AS route FROM corpus), slots AS ({" UNION ALL ".join(f"SELECT *, {', '.join(O.slots_sql(r))} FROM classified WHERE route = '{r}'" for r in S.ROUTES)}),
a AS (SELECT *, round(least(0.99, cast(0.60 AS double) * ocr_confidence + cast(0.35 AS double) * (({fill('f')}) / cast(5 AS double))), 4) AS c0 FROM slots),
b AS (SELECT *, {asked} AS asked, {', '.join(map(fix, range(5)))} FROM a),
c AS (SELECT *, ({fill('g')}) AS filled, CASE WHEN asked AND job_id % 6 IN (0, 1) THEN greatest(c0, least(1.0, CASE job_id % 6 WHEN 0 THEN cast(0.99 AS double) ELSE 3.0 END)) ELSE c0 END AS c1 FROM b)
SELECT job_id, asked AS used_vlm_fallback, filled::int AS filled, CASE WHEN filled < 5 THEN least(c1, round(least(0.99, cast(0.60 AS double) * ocr_confidence + cast(0.35 AS double) * (filled / cast(5 AS double))), 4)) ELSE c1 END AS confidence, (5 - filled)::int AS missing FROM c"""


@query(_decided())
def extraction_decisions(spark, sf_dir):
    t = X.extract(modelled(spark, sf_dir), model_fields="said", model_confidence="sure")
    return t.select("job_id", "used_vlm_fallback", X.filled(F.col("fields")).alias("filled"), "confidence", F.size("missing_fields").alias("missing"))


EVIDENCE = r"\btotal\b"


@query(f"""WITH c AS ({plain_sql(CORPUS)}), t AS (SELECT job_id, {O.FOLDED} || ' total ' || {O.FOLDED} AS t FROM c), p AS (SELECT job_id, t, regexp_extract_all(t, '{EVIDENCE}') AS m, string_split_regex(t, '{EVIDENCE}') AS b FROM t),
k AS (SELECT job_id, t, m, b, unnest(range(1, len(m) + 1)) AS i FROM p), s AS (SELECT job_id, i, t, (list_sum(list_transform(b[1:i], lambda x: length(x))) + 5 * (i - 1))::int AS pos FROM k),
e AS (SELECT job_id, i, trim(substr(t, greatest(pos - 40, 0) + 1, 5 + pos - greatest(pos - 40, 0) + 40)) AS snippet FROM s), d AS (SELECT job_id, snippet, min(i) AS i FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i) AS n FROM d)
SELECT job_id, n::int AS n, snippet FROM r WHERE n <= 3""")
def match_evidence(spark, sf_dir):
    from folioflow.functions.text import fold

    # every text stands twice, so that snippets overlap and repeat
    t = corpus(spark, sf_dir).select("job_id", F.concat(fold(F.col("text")), F.lit(" total "), fold(F.col("text"))).alias("t"))
    return t.select("job_id", F.posexplode(A.snippets(F.col("t"), EVIDENCE)).alias("n", "snippet")).select("job_id", (F.col("n") + 1).alias("n"), "snippet")
