"""Page geometry: boxes, lines, token-block overlap, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import schemas as S


def box_of(points: Column) -> Column:
    """Bounding box of an array of [x, y] points; null if empty or flat."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.struct(F.bround(F.array_min(xs)).cast("int").alias("x1"), F.bround(F.array_min(ys)).cast("int").alias("y1"), F.bround(F.array_max(xs)).cast("int").alias("x2"), F.bround(F.array_max(ys)).cast("int").alias("y2"))
    return F.when((F.array_max(xs) > F.array_min(xs)) & (F.array_max(ys) > F.array_min(ys)), box)


def normalise_tokens(tokens: DataFrame) -> DataFrame:
    """Drops blank and flat tokens, adds the centre. tokens: job_id, index, text, x1, y1, x2, y2, confidence."""
    t = tokens.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return t.withColumn("cx", F.round((F.col("x1") + F.col("x2")) / 2, 3)).withColumn("cy", F.round((F.col("y1") + F.col("y2")) / 2, 3))


def line_blocks(tokens: DataFrame, tolerance: float = S.SETTINGS.layout_y_tolerance, pad: int = 4) -> DataFrame:
    """Tokens in order of (cy, x1); one opens a new line if it is further from the running mean of the line than the tolerance.

    The fold runs inside one page's array. Gives job_id, line, n, box and text.
    """
    item = F.struct("cy", "x1", "index", "text", "y1", "x2", "y2")
    pages = tokens.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<sum:double,n:int,x1:int,y1:int,x2:int,y2:int,text:string>>"

    def line(sum_: Column, n: Column, x1: Column, y1: Column, x2: Column, y2: Column, text: Column) -> Column:
        return F.struct(sum_.cast("double").alias("sum"), n.cast("int").alias("n"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"), text.alias("text"))

    def step(lines: Column, t: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        same = F.coalesce(F.abs(t["cy"] - last["sum"] / last["n"]) <= tolerance, F.lit(False))
        grown = line(last["sum"] + t["cy"], last["n"] + 1, F.least(last["x1"], t["x1"]), F.least(last["y1"], t["y1"]), F.greatest(last["x2"], t["x2"]), F.greatest(last["y2"], t["y2"]), F.concat_ws(" ", last["text"], t["text"]))
        fresh = line(t["cy"], F.lit(1), t["x1"], t["y1"], t["x2"], t["y2"], t["text"])
        head = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(same, F.concat(head, F.array(grown))).otherwise(F.concat(lines, F.array(fresh)))

    folded = pages.select("job_id", F.aggregate("items", F.array().cast(kind), step).alias("lines"))
    t = folded.select("job_id", F.posexplode_outer("lines").alias("line", "l"))
    return t.select("job_id", "line", F.format_string("b%04d", F.col("line")).alias("id"), F.col("l.n").alias("n"), F.greatest(F.lit(0), F.col("l.x1") - pad).alias("x1"), F.greatest(F.lit(0), F.col("l.y1") - pad).alias("y1"), (F.col("l.x2") + pad).alias("x2"), (F.col("l.y2") + pad).alias("y2"), F.col("l.text").alias("text"))


def assign(tokens: DataFrame, blocks: DataFrame, least: float = S.SETTINGS.layout_min_overlap, how: str = "inner") -> DataFrame:
    """Pairs (token, block) of one page: the block covers enough of the token, or holds its centre. how: left also gives tokens that no block took, without an id.

    The page key is an equality, so Spark hashes or merges on it and the
    geometry is a residual condition.
    """
    t, b = tokens.alias("t"), blocks.alias("b")
    w = F.greatest(F.lit(0), F.least("t.x2", "b.x2") - F.greatest("t.x1", "b.x1"))
    h = F.greatest(F.lit(0), F.least("t.y2", "b.y2") - F.greatest("t.y1", "b.y1"))
    area = (F.col("t.x2") - F.col("t.x1")) * (F.col("t.y2") - F.col("t.y1"))
    inside = F.col("t.cx").between(F.col("b.x1"), F.col("b.x2")) & F.col("t.cy").between(F.col("b.y1"), F.col("b.y2"))
    return t.join(b, (F.col("t.job_id") == F.col("b.job_id")) & ((w * h / area >= least) | inside), how).select("t.job_id", "b.id", "t.index", "t.text", "t.confidence", F.col("t.y1").alias("ty"), F.col("t.x1").alias("tx"))


def block_texts(pairs: DataFrame, *more: Column) -> DataFrame:
    """Tokens, their text in reading order and mean confidence per block, and more aggregates."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("ty", "tx", "index", "text"))), lambda x: x["text"])
    return pairs.groupBy("job_id", "id").agg(F.count("*").alias("token_count"), F.array_join(words, " ").alias("text"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), *more)


def unassigned(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tokens that no block took, gathered in one box a page."""
    rest = tokens.join(pairs.select("job_id", "index"), ["job_id", "index"], "left_anti")
    return rest.groupBy("job_id").agg(F.count("*").alias("token_count"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def reading_order(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("reading_order", F.row_number().over(Window.partitionBy("job_id").orderBy("y1", "x1", "id")) - 1)
