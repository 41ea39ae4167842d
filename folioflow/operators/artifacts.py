"""What reading engines and page analysis leave behind: tokens of any result shape, texts, confidences, pages.

A page result is a struct with both known shapes, of which one is filled:
rec_texts, rec_scores, rec_polys (three lists by position), and items (a list of
box, text, score). Boxes are lists of [x, y] points or four numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions.text import collapse, strip

TOKEN = "struct<text:string,bbox:array<array<double>>,confidence:double>"
PAGE = f"struct<rec_texts:array<string>,rec_scores:array<string>,rec_polys:array<array<array<double>>>,dt_polys:array<array<array<double>>>,items:array<struct<box:array<array<double>>,text:string,score:string>>>"


def listed(c: Column, kind: str) -> Column:
    """A list for a column that may be null."""
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def token(text: Column, box: Column, score: Column) -> Column:
    return F.struct(text.alias("text"), listed(box, "array<double>").alias("bbox"), F.coalesce(score.try_cast("double"), F.lit(0.0)).alias("confidence"))


def page_tokens(page: Column) -> Column:
    """Tokens of one page of either shape; blank texts are dropped, a score or box that has no text's place counts as 0 or empty."""
    boxes = F.when(F.size(listed(page["rec_polys"], "array<array<double>>")) > 0, page["rec_polys"]).otherwise(page["dt_polys"])
    by_place = F.transform(listed(page["rec_texts"], "string"), lambda t, k: token(collapse(F.coalesce(t, F.lit(""))), F.get(boxes, k), F.get(page["rec_scores"], k)))
    items = F.transform(listed(page["items"], "struct<box:array<array<double>>,text:string,score:string>"), lambda i: token(collapse(F.coalesce(i["text"], F.lit(""))), i["box"], i["score"]))
    return F.filter(F.concat(by_place, items), lambda t: t["text"] != "")


def tokens(pages: Column) -> Column:
    """All tokens of a result, page after page."""
    return F.flatten(F.transform(listed(pages, PAGE), page_tokens))


def measured_tokens(words: Column) -> Column:
    """Tokens of an engine that gives words with a confidence of 0 to 100 (-1: none) and a box as left, top, width, height."""
    kept = F.filter(words, lambda w: (collapse(F.coalesce(w["text"], F.lit(""))) != "") & (F.coalesce(w["conf"], F.lit(-1.0)) >= 0))

    def one(w: Column) -> Column:
        x, y, right, low = w["left"], w["top"], w["left"] + w["width"], w["top"] + w["height"]
        corner = lambda a, b: F.array(a.cast("double"), b.cast("double"))
        return F.struct(collapse(w["text"]).alias("text"), F.array(corner(x, y), corner(right, y), corner(right, low), corner(x, low)).alias("bbox"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), w["conf"] / 100)).alias("confidence"))

    return F.transform(kept, one)


def fallback_text(valid_image: Column, init_error: Column, reason: Column) -> Column:
    """Why nothing was read: a bad image before a failed start before the reason given."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    why = F.coalesce(F.left(some(init_error), F.lit(120)), F.left(some(reason), F.lit(120)), F.lit("runtime"))
    return F.concat(F.lit("ocr_fallback:"), F.when(valid_image, why).otherwise("invalid_image"))


def or_fallback(found: Column, reason: Column) -> Column:
    """The tokens, or one of low confidence that says why there are none."""
    only = F.array(F.struct(reason.alias("text"), F.array().cast("array<array<double>>").alias("bbox"), F.lit(0.2).alias("confidence")))
    return F.when(F.size(found) > 0, found).otherwise(only)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def summary(found: Column, full_text: Column, said_mean: Column, said_fallback: Column, joint: str = " ") -> Column:
    """What later stages read of an artifact: text, token_count, mean_confidence, fallback_used.

    Without any token text the artifact's own text and confidence count; text
    that names a fallback is one, whatever the artifact says.
    """
    texts = F.filter(F.transform(found, lambda t: strip(F.coalesce(t["text"], F.lit("")))), lambda t: t != "")
    known = F.filter(F.transform(found, lambda t: t["confidence"]), lambda x: x.isNotNull())
    text = F.coalesce(F.nullif(F.array_join(texts, joint), F.lit("")), strip(full_text), F.lit(""))
    fallback = F.coalesce(said_fallback, F.lit(False)) | F.contains(F.lower(text), F.lit("ocr_fallback:"))
    confidence = F.coalesce(F.round(mean(known), 4), said_mean, F.lit(0.0))
    return F.struct(text.alias("text"), F.size(texts).alias("token_count"), confidence.alias("mean_confidence"), fallback.alias("fallback_used"))


# -- boxes -------------------------------------------------------------------------
def box(points: Column) -> Column:
    """Bounds of a list of points, or of four numbers given as one point; null where flat or empty."""
    four = F.size(F.get(points, F.lit(0))) >= 4
    flat = F.get(points, F.lit(0))
    xs = F.when(four, F.array(flat[0], flat[2])).otherwise(F.transform(points, lambda p: p[0]))
    ys = F.when(four, F.array(flat[1], flat[3])).otherwise(F.transform(points, lambda p: p[1]))
    bounds = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return F.when((bounds["x2"] > bounds["x1"]) & (bounds["y2"] > bounds["y1"]), bounds)


def clamped(bounds: Column, width: Column, height: Column) -> Column:
    """Whole pixels inside the page."""
    put = lambda c, most: F.greatest(F.lit(0), F.least(most.cast("int"), F.bround(c).cast("int")))
    return F.struct(put(bounds["x1"], width).alias("x1"), put(bounds["y1"], height).alias("y1"), put(bounds["x2"], width).alias("x2"), put(bounds["y2"], height).alias("y2"))


def placed_tokens(df: DataFrame, found: str, width: Column, height: Column, key: str = "job_id") -> DataFrame:
    """One row a token with text and a box that is not flat on its page: index (its place in the list), text, confidence, box and centre."""
    t = df.select(key, width.alias("_w"), height.alias("_h"), F.posexplode(found).alias("index", "t"))
    t = t.withColumn("b", clamped(box(F.col("t.bbox")), F.col("_w"), F.col("_h"))).filter((strip(F.coalesce("t.text", F.lit(""))) != "") & (F.col("b.x2") > F.col("b.x1")) & (F.col("b.y2") > F.col("b.y1")))
    return t.select(key, "index", strip(F.col("t.text")).alias("text"), F.coalesce("t.confidence", F.lit(0.0)).alias("confidence"), "b.*", F.round((F.col("b.x1") + F.col("b.x2")) / 2, 3).alias("cx"), F.round((F.col("b.y1") + F.col("b.y2")) / 2, 3).alias("cy"))


def detected(items: DataFrame, least: float = S.SETTINGS.layout_min_score) -> DataFrame:
    """Model blocks (x1..y2 in page pixels, score, type, k, width, height) that are sure enough and not flat, clamped to their page."""
    raw = F.struct(F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), F.col("x2").cast("double").alias("x2"), F.col("y2").cast("double").alias("y2"))
    t = items.withColumn("b", clamped(raw, F.col("width"), F.col("height")))
    t = t.filter((F.col("b.x2") > F.col("b.x1")) & (F.col("b.y2") > F.col("b.y1")) & (F.coalesce("score", F.lit(0.0)) >= least))
    return t.select("job_id", F.format_string("b%04d", F.col("k")).alias("id"), F.coalesce(F.nullif("type", F.lit("")), F.lit("text")).alias("type"), "b.*", F.round("score", 4).alias("score"))


def page_blocks(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Line blocks, and for pages without any one block of the whole page. pages: job_id, width, height; lines: job_id, id, x1..y2, clamped here."""
    t, line = pages.join(lines, "job_id", "left"), F.col("id").isNotNull()
    of = lambda own, whole: F.when(line, own).otherwise(whole)
    box = [of(F.col("x1"), F.lit(0)).alias("x1"), of(F.col("y1"), F.lit(0)).alias("y1"), of(F.least("x2", "width"), F.col("width")).alias("x2"), of(F.least("y2", "height"), F.col("height")).alias("y2")]
    return t.select("job_id", F.coalesce("id", F.lit("b0000")).alias("id"), of(F.lit("text"), F.lit("page")).alias("type"), *box, of(F.lit(0.65), F.lit(0.5)).alias("score"), of(F.lit("heuristic_ocr_line"), F.lit("heuristic_page")).alias("source"))


def block_types(blocks: Column) -> Column:
    """Layout features of an array of block structs: their distinct types in order."""
    return F.array_sort(F.array_distinct(F.transform(blocks, lambda b: F.coalesce(F.nullif(b["type"], F.lit("")), F.lit("unknown")))))


def layout_text(blocks: Column) -> Column:
    """Texts of an array of block structs in reading order, equal places as they come, one a line."""
    worded = F.filter(F.transform(blocks, lambda b, k: F.struct(b["reading_order"].alias("at"), k.alias("k"), collapse(F.coalesce(b["text"], F.lit(""))).alias("text"))), lambda b: b["text"] != "")
    return F.array_join(F.transform(F.array_sort(worded), lambda b: b["text"]), "\n")


# -- model answers -----------------------------------------------------------------
def answer_of(content: Column) -> Column:
    """The JSON object between the first opening and the last closing brace, as a variant; null if there is none."""
    first = F.locate("{", content)
    last = F.length(content) - F.length(F.substring_index(content, "}", -1))
    blob = F.when((first > 0) & (last > first), F.substring(content, first, last - first + 1))
    # inside a list, because the parser passes over what follows a first object
    got = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), blob, F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(got) == 1) & F.schema_of_variant(F.get(got, F.lit(0))).startswith("OBJECT"), F.get(got, F.lit(0)))


def snippets(text: Column, pattern: str, around: int = 40, most: int = 3) -> Column:
    """The first distinct surroundings of the matches of a pattern, from the pieces between matches; no Python."""
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    lengths = F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda a, b: F.struct(F.coalesce(a, F.lit(0)).alias("gap"), F.coalesce(b, F.lit(0)).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    places = F.aggregate(lengths, start, lambda a, x: F.struct((a["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")), lambda a: a["out"])
    cut = F.zip_with(F.slice(places, F.lit(1), F.size(found)), found, lambda p, m: strip(F.substring(text, F.greatest(p - around, F.lit(0)) + 1, F.length(m) + p - F.greatest(p - around, F.lit(0)) + around)))
    return F.slice(F.array_distinct(F.filter(cut, lambda s: s != "")), 1, most)
