"""Exact percentiles of groups of any size, by rank selection in histogram passes.

A pass counts values in buckets that a monotone function of the value names, so
a task sends one row a bucket. The bucket that holds a wanted rank becomes the
next pass's range: first one a power of two, then parts of the range between
the least and the greatest value in it. It ends when such a range holds one
value, or few enough rows to be listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.files import keep


def power(v: Column) -> Column:
    """A long that grows with v: the sign and the power of two; infinities and NaN lie outside."""
    size = (F.floor(F.log2(F.abs(v))) + 1100).cast("long")
    return F.when(F.isnan(v), 9999).when(F.abs(v) == float("inf"), F.signum(v) * 9000).when(v == 0, 0).otherwise(F.signum(v) * size).cast("long")


def percentiles(df: DataFrame, value: str, probabilities: dict[str, float], groups: list[str], buckets: int = 4096, listed: int = 4096) -> DataFrame:
    """``groups`` and one column for each of ``probabilities`` (name: share of the rows below), interpolated linearly between ranks.

    Null values are left out; a group without any other has nulls. NaN counts
    as greater than all numbers. Without groups there is one row, also for an
    empty table.
    """
    g = F.struct(F.lit(0).alias("_"), *groups).alias("g")
    src = df.select(g, F.col(value).cast("double").alias("v"))
    sizes = src.groupBy("g").agg(F.count("v").alias("n"))
    if not groups:
        one = df.sparkSession.range(1).select(F.struct(F.lit(0).alias("_")).alias("g"))
        sizes = one.join(sizes, "g", "left").select("g", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    sizes = keep(sizes, "ranks")
    src = src.filter("v IS NOT NULL")
    shares = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probabilities.items()))
    asked = sizes.filter("n > 0").select("g", F.explode(shares).alias("a"), ((F.col("n") - 1) * F.col("a.p")).alias("rank")).select("g", "a.name", "rank", F.floor("rank").alias("low"), F.ceil("rank").alias("high"))
    wanted = asked.select("g", F.explode(F.array_distinct(F.array("low", "high"))).alias("at")).distinct()

    counts = src.groupBy("g", power(F.col("v")).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).withColumn("base", F.lit(0).cast("long")).withColumn("part", F.lit(0.0))
    found: list[DataFrame] = []
    while True:
        # the ranks of a bucket: of all values of the group below it, then on
        ends = Window.partitionBy("g", "part").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("end", F.col("base") + F.sum("n").over(ends)).withColumn("base", F.col("end") - F.col("n"))
        hit = wanted.join(ranked, "g").filter((F.col("at") >= F.col("base")) & (F.col("at") < F.col("end"))).select("g", "at", "base", "n", "least", "most")
        hit = keep(hit, "ranks")
        found.append(hit.filter("least = most").select("g", "at", F.col("least").alias("v")))
        few = hit.filter(f"least <> most AND n <= {listed}")
        if not few.isEmpty():
            ranges = few.select("g", "least", "most").distinct()
            lists = src.join(ranges, "g").filter("v BETWEEN least AND most").groupBy("g", "least", "most").agg(F.array_sort(F.collect_list("v")).alias("all"))
            found.append(few.join(lists, ["g", "least", "most"]).select("g", "at", F.get("all", (F.col("at") - F.col("base")).cast("int")).alias("v")))
        many = hit.filter(f"least <> most AND n > {listed}")
        if many.isEmpty():
            break
        wanted = many.select("g", "at")
        ranges = many.select("g", "base", F.col("least").alias("part"), F.col("most").alias("_most")).distinct()
        inside = src.join(ranges, "g").filter("v BETWEEN part AND _most")
        # halves, because the width of a range may pass the largest number
        b = F.floor((F.col("v") / 2 - F.col("part") / 2) / (F.col("_most") / 2 - F.col("part") / 2) * (buckets - 1))
        counts = inside.groupBy("g", "part", "base", b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    values = keep(values, "ranks")
    low, high = values.select("g", F.col("at").alias("low"), F.col("v").alias("a")), values.select("g", F.col("at").alias("high"), F.col("v").alias("b"))
    got = asked.join(low, ["g", "low"]).join(high, ["g", "high"]).withColumn("v", F.when(F.col("low") == F.col("high"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.col("low"))))
    wide = got.groupBy("g").agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in probabilities))
    return sizes.join(wide, "g", "left").select(*(F.col("g")[c].alias(c) for c in groups), *probabilities)

