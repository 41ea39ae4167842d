"""Samples as lines of the text format that metric endpoints speak, and back.

samples: name, labels (a map), value (double), and for the writer family, kind
and help. Histogram families hold the samples name_bucket, name_sum and name_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
LINE = rf'^({NAME})\s*(?:\{{((?:[^"}}]|"(?:[^"\\]|\\.)*")*)\}})?\s+(\S+)(?:\s+(-?\d+))?\s*$'


def escaped(c: Column, quotes: bool = True) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit('"'), F.lit('\\"')) if quotes else out


def plain(c: Column) -> Column:
    """Escapes undone; a backslash before any other character stays."""
    mark = F.lit("\x00")
    out = F.replace(c, F.lit("\\\\"), mark)
    return F.replace(F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), mark, F.lit("\\"))


def number(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def lines(samples: DataFrame) -> DataFrame:
    """(family, turn, line): sorted by these, the text; a family's help and type come first."""
    pairs = F.array_sort(F.map_entries("labels"))
    inner = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit('="'), escaped(F.coalesce(p["value"], F.lit(""))), F.lit('"'))), ",")
    body = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(""), F.lit(" "), number(F.col("value")))
    heads = samples.groupBy("family").agg(F.first("kind", True).alias("kind"), F.first("help", True).alias("help"))
    said = F.array(F.concat(F.lit("# HELP "), "family", F.lit(" "), escaped(F.coalesce("help", F.lit("")), False)), F.concat(F.lit("# TYPE "), "family", F.lit(" "), F.coalesce("kind", F.lit("untyped"))))
    top = heads.select("family", F.posexplode(said).alias("turn", "line")).select("family", F.col("turn").cast("int").alias("turn"), "line")
    return top.unionByName(samples.select("family", F.lit(2).alias("turn"), body.alias("line")))


def write(samples: DataFrame, path: str) -> None:
    """Text files with all lines of a family in one of them, in order."""
    t = lines(samples).repartition("family").sortWithinPartitions("family", "turn", "line")
    t.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """name, labels and value of every sample line; comments and blank lines are left out, as are lines that are no samples."""
    t = spark.read.text(path).filter(~F.ltrim("value").startswith("#") & (F.trim("value") != "") & F.col("value").rlike(LINE))
    part = lambda k: F.regexp_extract("value", LINE, k)
    inner = part(2)
    keys, values = F.regexp_extract_all(inner, F.lit(LABEL), F.lit(1)), F.regexp_extract_all(inner, F.lit(LABEL), F.lit(2))
    raw = part(3)
    value = F.when(F.lower(raw).isin("+inf", "inf"), float("inf")).when(F.lower(raw) == "-inf", float("-inf")).when(F.lower(raw) == "nan", float("nan")).otherwise(raw.try_cast("double"))
    return t.select(part(1).alias("name"), F.map_from_arrays(keys, F.transform(values, plain)).alias("labels"), value.alias("value"), F.nullif(part(4), F.lit("")).cast("long").alias("millis"))
