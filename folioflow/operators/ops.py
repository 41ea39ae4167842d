"""Operational time series: rates, histogram quantiles, alerts with a duration, absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(samples: DataFrame, seconds: int, labels: list[str]) -> DataFrame:
    """Per-second increase of a counter over the last ``seconds``, resets counted from zero; null with fewer than two samples. samples: labels, ts, value."""
    at = F.col("ts").cast("timestamp").cast("long")
    order = Window.partitionBy(*labels).orderBy("_at")
    t = samples.withColumn("_at", at).withColumn("_before", F.lag("value").over(order))
    t = t.withColumn("_up", F.when(F.col("_before").isNull(), 0.0).when(F.col("value") < F.col("_before"), F.col("value")).otherwise(F.col("value") - F.col("_before")))
    span = order.rangeBetween(-seconds, 0)
    first = F.first("_up").over(span)
    n, begin = F.count("*").over(span), F.min("_at").over(span)
    return t.withColumn("rate", F.when(n > 1, (F.sum("_up").over(span) - first) / (F.col("_at") - begin))).drop("_at", "_before", "_up")


def histogram_quantile(buckets: DataFrame, q: float, groups: list[str]) -> DataFrame:
    """Quantile inside cumulative buckets (columns le, cum): linear in the first bucket that reaches it; in the open bucket its lower bound."""
    w = Window.partitionBy(*groups).orderBy("le")
    t = buckets.withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_under", F.coalesce(F.lag("cum").over(w), F.lit(0.0)))
    t = t.withColumn("_rank", q * F.max("cum").over(Window.partitionBy(*groups)))
    hit = t.filter((F.col("cum") >= F.col("_rank")) & (F.col("_rank") > 0))
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_under")) / F.nullif(F.col("cum") - F.col("_under"), F.lit(0.0))
    return hit.groupBy(*groups).agg(F.min_by(F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(F.coalesce(inside, F.col("le"))), "le").alias("value"))


def _held(samples: DataFrame, hold_seconds: int, labels: list[str], gap: int | None) -> DataFrame:
    """Samples with their state and ``_us``, their time. All windows are of one order, so a series is sorted once."""
    at = F.col("ts").cast("timestamp")
    w = Window.partitionBy(*labels).orderBy("_us")
    t = samples.withColumn("_us", F.unix_micros(at)).withColumn("_at", F.unix_seconds(at))
    late = F.lit(False) if gap is None else F.coalesce(F.col("_at") - F.lag("_at").over(w) > gap, F.lit(False))
    t = t.withColumn("_late", late)
    # a run of bad samples starts at the first that has no other between itself and the last break
    broken = F.max(F.when(~F.coalesce(F.col("bad") & ~F.col("_late"), F.lit(False)), F.col("_us"))).over(w)
    before = F.max(F.when(F.col("bad"), F.col("_us"))).over(w.rangeBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_broken", broken).withColumn("_before", before)
    start = F.when(F.col("bad") & (F.col("_before").isNull() | F.coalesce(F.col("_before") < F.col("_broken"), F.lit(False))), F.col("_at"))
    t = t.withColumn("_start", start).withColumn("_since", F.when(F.col("bad"), F.max("_start").over(w)))
    state = F.when(~F.col("bad"), "inactive").when(F.col("_at") - F.col("_since") >= hold_seconds, "firing").otherwise("pending")
    return t.withColumn("state", state).drop("_at", "_late", "_broken", "_before", "_start", "_since")


def firing(samples: DataFrame, hold_seconds: int, labels: list[str], gap: int | None = None) -> DataFrame:
    """Samples at which a boolean condition (column bad) has held for ``hold_seconds`` without a break. With ``gap``, a longer time without a sample is a break too."""
    return _held(samples, hold_seconds, labels, gap).drop("_us")


def alert_states(samples: DataFrame, hold_seconds: int, labels: list[str]) -> DataFrame:
    """States of a boolean condition (column bad): inactive, pending, firing once it has held for ``hold_seconds``, resolved at the first sample after that."""
    t = _held(samples, hold_seconds, labels, None)
    before = F.lag("state").over(Window.partitionBy(*labels).orderBy("_us"))
    return t.withColumn("state", F.when((F.col("state") == "inactive") & (before == "firing"), "resolved").otherwise(F.col("state"))).drop("_us")


def instant(samples: DataFrame, labels: list[str], step: int = 15, lookback: int = 300, slot: int = 3600) -> DataFrame:
    """Values on a grid of ticks every ``step`` seconds: at each the last sample of its series that is no older than ``lookback``. samples: labels, id, ts, value; gives labels, at (seconds) and value.

    A sample holds from its own tick to the one before the next sample, so what
    it takes is the time of that next sample; among samples of one second the
    last id counts. Samples of a series meet in slots of time and the slots by
    one row each, so a busy series is many tasks' work.
    """
    t = samples.filter("ts IS NOT NULL").select(*labels, "id", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    t = t.withColumn("_slot", F.floor(F.col("at") / slot))
    t = t.withColumn("_next", F.lead("at").over(Window.partitionBy(*labels, "_slot").orderBy("at", "id")))
    heads = t.groupBy(*labels, "_slot").agg(F.min("at").alias("_head"))
    heads = heads.withColumn("_later", F.lead("_head").over(Window.partitionBy(*labels).orderBy("_slot"))).drop("_head")
    met = t.join(heads.toDF(*(f"_{c}" for c in labels), "_of", "_later"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in labels] + [F.col("_slot") == F.col("_of")])
    until = F.least(F.coalesce("_next", "_later", F.col("at") + lookback + 1) - 1, F.col("at") + lookback)
    first, last = F.ceil(F.col("at") / step) * step, F.floor(until / step) * step
    return met.filter(first <= last).select(*labels, F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("at"), "value")


def sum_by(samples: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    """One value for each time and set of labels."""
    return samples.groupBy(*labels, "ts").agg(F.sum(value).alias(value))


def missing_ticks(ticks: DataFrame, samples: DataFrame) -> DataFrame:
    """Every tick with whether any sample has its time; ticks: ts."""
    seen = samples.select("ts").distinct().withColumn("_seen", F.lit(True))
    return ticks.join(seen, "ts", "left").select("ts", F.col("_seen").isNull().alias("bad"))


def ratio(over: DataFrame, under: DataFrame, labels: list[str]) -> DataFrame:
    """The quotient of two series with the same labels and times; times that only one has are left out.

    Both are shuffled: of a series that is made from few rows Spark expects few rows, and would collect one side in the driver.
    """
    a, b = over.select(*labels, "ts", F.col("value").alias("_a")), under.select(*labels, "ts", F.col("value").alias("_b"))
    return a.join(b.hint("merge"), [*labels, "ts"]).select(*labels, "ts", (F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0))).alias("value"))


def flushes(alerts: DataFrame, groups: list[str], wait: int = 30, interval: int = 300) -> DataFrame:
    """Notifications of grouped alerts: a group's first goes out ``wait`` seconds after its first change, and from then on at most one every ``interval`` seconds with all changes since. alerts: groups, ts, state (firing or resolved changes)."""
    at = F.col("ts").cast("timestamp").cast("long")
    t = alerts.withColumn("_at", at).withColumn("_first", F.min("_at").over(Window.partitionBy(*groups)))
    k = F.greatest(F.lit(0), F.ceil((F.col("_at") - F.col("_first") - wait) / interval)).cast("long")
    t = t.withColumn("flush", (F.col("_first") + wait + k * interval).cast("timestamp"))
    return t.groupBy(*groups, "flush").agg(F.count_if(F.col("state") == "firing").alias("firing"), F.count_if(F.col("state") == "resolved").alias("resolved"))


def repeats(flushed: DataFrame, groups: list[str], until: Column, every: int = 14400) -> DataFrame:
    """The notifications of ``flushes`` and, while alerts of a group still fire, a repeat ``every`` seconds after its last one, up to ``until`` (seconds). Adds active, the alerts that fire after it, and repeated."""
    w = Window.partitionBy(*groups).orderBy("flush")
    active = F.sum(F.col("firing") - F.col("resolved")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.unix_seconds(F.col("flush").cast("timestamp"))
    t = flushed.withColumn("active", active).withColumn("_at", at).withColumn("_end", F.coalesce(F.lead("_at").over(w) - 1, until))
    last = F.when((F.col("active") > 0) & (F.col("_end") >= F.col("_at") + every), F.col("_end")).otherwise(F.col("_at"))
    t = t.withColumn("_t", F.explode(F.sequence("_at", last, F.lit(every).cast("long")))).withColumn("repeated", F.col("_t") > F.col("_at"))
    own = [F.when(F.col("repeated"), 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("firing", "resolved")]
    return t.select(*groups, F.timestamp_seconds("_t").alias("flush"), *own, "active", "repeated")


def running_counters(log: DataFrame, labels: list[str]) -> DataFrame:
    """Counter samples of a request log: the number of requests of the labels up to each time."""
    n = log.groupBy(*labels, "ts").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*labels).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return n.select(*labels, "ts", F.sum("_n").over(w).cast("double").alias("value"))


def histogram_totals(log: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """The sum and count series beside a histogram's buckets."""
    return log.groupBy(*labels).agg(F.sum(value).alias("sum"), F.count(value).alias("count"))


def absent(spine: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    return spine.join(samples, keys, "left_anti")


def cumulative_buckets(df: DataFrame, value: str, bounds: list[float], groups: list[str]) -> DataFrame:
    """Counts at or below each bound, the last one open: one aggregate, then unrolled."""
    sums = [F.count_if(F.col(value) <= b).cast("double").alias(f"_b{k}") for k, b in enumerate(bounds)] + [F.count(value).cast("double").alias(f"_b{len(bounds)}")]
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{k}").alias("cum")) for k, b in enumerate([*bounds, float("inf")])))
    return df.groupBy(*groups).agg(*sums).select(*groups, F.explode_outer(rows).alias("b")).select(*groups, "b.le", "b.cum")
