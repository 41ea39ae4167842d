"""Editing JSON documents of any shape and depth as rows, without Python.

A document is exploded level by level into one row a value; rows are edited, and
the tree is rebuilt from the deepest level: the children of a value are joined to
its text in their order. Each level is one pass over the rows that still hold
objects or lists, and is written before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.sources.files import keep

HIDDEN = '"[REDACTED]"'


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _holds(text: Column) -> Column:
    """Whether a JSON text is an object or a list with anything in it."""
    return F.left(text, F.lit(1)).isin("{", "[") & ~text.isin("{}", "[]")


def levels(docs: DataFrame, names: list[str], clean: Callable[[Column], Column] | None) -> list[DataFrame]:
    """One table a depth: row, node, parent, turn, name, text (JSON) and hidden. docs: row, text."""
    spark = docs.sparkSession
    now = docs.select("row", F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("name"), F.to_json(F.try_parse_json("text")).alias("text"))
    out: list[DataFrame] = []
    while True:
        hidden = F.coalesce(F.col("name").isin(names), F.lit(False)) if names else F.lit(False)
        text = F.when(F.col("hidden"), HIDDEN)
        if clean is not None:
            own = F.get_json_object(F.concat(F.lit("["), "text", F.lit("]")), "$[0]")
            text = text.when(F.startswith("text", F.lit('"')), quoted(clean(own)))
        now = keep(now.withColumn("hidden", hidden).withColumn("text", text.otherwise(F.col("text"))), "json-level")
        out.append(now)
        inner = now.filter(_holds(F.col("text")))
        if inner.isEmpty():
            return out
        below = spark.sql("SELECT t.row, concat(t.node, '/', e.pos) AS node, t.node AS parent, e.pos AS turn, e.key AS name, to_json(e.value) AS text FROM {t} t, LATERAL variant_explode(parse_json(t.text)) e", t=inner)
        now = below.withColumn("turn", F.col("turn").cast("int"))


def rewrite(df: DataFrame, column: str, hide: list[str] | None = None, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with the JSON text of ``column`` edited, and ``<column>_hidden``, the sorted names that were found and hidden.

    hide: keys (as they are written) whose values, whatever they hold, become
    ``[REDACTED]``; clean: what becomes of every other string. Objects come out
    with sorted keys and no white space; null and what is no JSON gives null.
    """
    docs = keep(df.withColumn("_row", F.monotonically_increasing_id()), "json-docs")
    all_ = levels(docs.select(F.col("_row").alias("row"), F.col(column).alias("text")), hide or [], clean)
    found = all_[0].filter("hidden")
    for level in all_[1:]:
        found = found.unionByName(level.filter("hidden"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    now = all_[-1]
    for level in reversed(all_[:-1]):
        entry = F.when(F.col("name").isNotNull(), F.concat(quoted(F.col("name")), F.lit(":"), "text")).otherwise(F.col("text"))
        kids = now.groupBy("row", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("text")))).alias("kids"))
        inner = F.array_join(F.transform("kids", lambda x: x["text"]), ",")
        text = F.when(F.col("kids").isNull(), F.col("text")).when(F.startswith("text", F.lit("{")), F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
        now = level.join(kids, ["row", "node"], "left").withColumn("text", text)
    edited = now.select(F.col("row").alias("_row"), F.col("text").alias("_text"))
    met = docs.join(edited, "_row").join(found.select(F.col("row").alias("_row"), "names"), "_row", "left")
    return met.withColumn(column, F.col("_text")).withColumn(f"{column}_hidden", F.coalesce("names", F.array().cast("array<string>"))).select(*df.columns, f"{column}_hidden")
