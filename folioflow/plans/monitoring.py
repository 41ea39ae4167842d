"""Alert rules from samples to states, panels and readiness checks, over one sample a minute and instance.

Instances are customers, services their nations. ``VALUES`` gives every series as
an expression of the instance c and the minute m that means the same in Spark
and in the SQL of the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import ops
from folioflow.plans.register import registry
from folioflow.sources.tables import plain_sql, run_sql, spread, table

QUERIES, ORACLE_SQL, query = registry()

MINUTES = 40
START = "timestamp'2026-01-01 00:00:00'"
START_HERE = "timestamp_ntz'2026-01-01 00:00:00'"  #: the same in Spark
VALUES = {
    "up": "CASE WHEN (c + floor(m / 6.0)) % 9 = 0 THEN 0.0 ELSE 1.0 END",
    "errors_5xx": "CASE WHEN c % 4 = 0 AND m > 10 THEN (CASE WHEN m >= 26 THEN m - 26 ELSE m - 10 END) * 2.0 ELSE 0.0 END",
    "errors_4xx": "CASE WHEN c % 3 = 0 AND m > 4 AND m < 30 THEN (m - 4) * 3.1 WHEN c % 3 = 0 AND m >= 30 THEN 80.6 ELSE 0.0 END",
    "requests": "CASE WHEN s % 5 = 0 THEN 7.0 ELSE m * 4.0 + c % 3 END",
    "backlog": "c % 2 + CASE WHEN m BETWEEN 10 AND 22 THEN (c % 3) * 1.0 ELSE 0.0 END",
    "last_success": "CASE WHEN m BETWEEN 12 AND 18 AND c % 5 = 0 THEN 11.0 ELSE m * 1.0 END * 60.0",
    "le_5": "CASE WHEN c % 6 = 0 THEN m * 1.0 ELSE m * 9.0 END",
    "le_10": "m * 10.0",
    "le_inf": "m * 10.0",
    "avail": "CASE WHEN c % 7 = 0 THEN 20.0 - m * 0.4 ELSE 50.0 END",
    "size": "CASE WHEN c % 11 = 3 THEN 0.0 ELSE 100.0 END",
}
#: Samples that the series lacks: nothing at all was scraped in these minutes.
GAPS = {"up": "m BETWEEN 30 AND 33", "backlog": "m BETWEEN 34 AND 35"}


def series(spark, sf_dir, name: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1))).alias("m"))
    t = t.filter(f"NOT ({GAPS[name]})") if name in GAPS else t
    return t.select(F.col("c").alias("instance"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("service"), F.expr(f"{START_HERE} + make_interval(0, 0, 0, 0, 0, m, 0)").alias("ts"), F.expr(VALUES[name]).cast("double").alias("value"))


def series_sql(name: str) -> str:
    gap = f"WHERE NOT ({GAPS[name]})" if name in GAPS else ""
    return f"(SELECT c AS instance, 's' || cast(s AS varchar) AS service, {START} + to_minutes(m) AS ts, cast({VALUES[name]} AS double) AS value FROM (SELECT c_custkey AS c, c_nationkey AS s, unnest(range({MINUTES})) AS m FROM customer) {gap})"


def ticks(spark) -> DataFrame:
    return spark.range(MINUTES).select(F.expr(f"{START_HERE} + make_interval(0, 0, 0, 0, 0, cast(id as int), 0)").alias("ts"))


TICKS = f"(SELECT {START} + to_minutes(m) AS ts FROM (SELECT unnest(range({MINUTES})) AS m))"


def rate_sql(name: str, seconds: int) -> str:
    """Per instance, as ``ops.rate``."""
    return f"""(SELECT instance, service, ts, CASE WHEN count(*) OVER x > 1 THEN (sum(up) OVER x - first_value(up) OVER x) / (tm - min(tm) OVER x) END AS value FROM (SELECT *, epoch(ts)::bigint AS tm, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS up FROM {series_sql(name)} WINDOW w AS (PARTITION BY instance, service ORDER BY ts)) WINDOW x AS (PARTITION BY instance, service ORDER BY tm RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW))"""


def rate(spark, sf_dir, name: str, seconds: int) -> DataFrame:
    return ops.rate(series(spark, sf_dir, name), seconds, ["instance", "service"]).withColumn("value", F.col("rate")).drop("rate")


def state_sql(expr: str, labels: list[str], hold: int) -> str:
    """Labels, ts and state of every sample that is not inactive."""
    by, cols = ", ".join(labels) or "1", "".join(f"{x}, " for x in labels)
    return f"""WITH e AS ({expr}), t AS (SELECT *, epoch(ts)::bigint AS tm, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY ts) AS turn FROM e), s AS (SELECT *, min(CASE WHEN bad THEN tm END) OVER (PARTITION BY {by}, turn) AS since FROM t),
a AS (SELECT *, CASE WHEN NOT bad THEN 'inactive' WHEN tm - since >= {hold} THEN 'firing' ELSE 'pending' END AS st FROM s), b AS (SELECT *, CASE WHEN st = 'inactive' AND lag(st) OVER (PARTITION BY {by} ORDER BY ts) = 'firing' THEN 'resolved' ELSE st END AS state FROM a) SELECT {cols}ts, state FROM b WHERE state <> 'inactive'"""


def states(df: DataFrame, labels: list[str], hold: int) -> DataFrame:
    t = df.withColumn("bad", F.coalesce("bad", F.lit(False)))
    return ops.alert_states(t if labels else t.withColumn("_all", F.lit(1)), hold, labels or ["_all"]).filter("state <> 'inactive'").select(*labels, "ts", "state")


def rule(name: str, hold: int, labels: list[str], frame: Callable, expr: str) -> None:
    """Register an alert rule: ``frame(spark, sf_dir)`` and the SQL ``expr`` give labels, ts and bad."""

    def run(spark, sf_dir):
        return states(frame(spark, sf_dir), labels, hold)

    run.__name__ = f"alert_{name}"
    query(state_sql(expr, labels, hold))(run)


def over(df: DataFrame, test: str) -> DataFrame:
    return df.withColumn("bad", F.expr(test))


ONE = ["instance", "service"]
rule("service_down", 120, ONE, lambda s, d: over(series(s, d, "up"), "value = 0"), f"SELECT *, value = 0 AS bad FROM {series_sql('up')}")
rule("scrape_missing", 120, [], lambda s, d: ops.missing_ticks(ticks(s), series(s, d, "up")), f"SELECT ts, ts NOT IN (SELECT ts FROM {series_sql('up')}) AS bad FROM {TICKS}")


def summed(name: str, seconds: int, where: str = "true"):
    return lambda s, d: ops.sum_by(rate(s, d, name, seconds).filter(where), ["service"])


def summed_sql(name: str, seconds: int, where: str = "true") -> str:
    return f"(SELECT service, ts, sum(value) AS value FROM {rate_sql(name, seconds)} WHERE {where} GROUP BY ALL)"


CRITICAL = "service IN ('s1', 's2', 's3')"
for _name, _hold, _series, _window, _test, _where in (
    ("high_5xx_rate", 300, "errors_5xx", 300, "value > 0.05", "true"),
    ("critical_5xx_rate", 180, "errors_5xx", 300, "value > 0", CRITICAL),
    ("high_4xx_rate", 600, "errors_4xx", 300, "value > 0.2", "true"),
    ("no_recent_traffic", 1800, "requests", 1800, "value = 0", "true"),
):
    rule(_name, _hold, ["service"], lambda s, d, x=(_series, _window, _where), t=_test: over(summed(*x)(s, d), t), f"SELECT *, coalesce({_test}, false) AS bad FROM {summed_sql(_series, _window, _where)}")

LES = (("le_5", "5.0"), ("le_10", "10.0"), ("le_inf", "'Infinity'"))


def quantile(spark, sf_dir, q: float, labels: list[str]) -> DataFrame:
    """The quantile of request durations from the summed rates of the buckets."""
    parts = [ops.sum_by(rate(spark, sf_dir, n, 300).withColumn("le", F.lit(float(le.strip("'").replace("Infinity", "inf")))), [*labels, "le"]) for n, le in LES]
    rates = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("value", "cum")
    return ops.histogram_quantile(rates.filter("cum IS NOT NULL"), q, [*labels, "ts"])


def quantile_sql(q: float, labels: list[str]) -> str:
    by = ", ".join([*labels, "ts"])
    rates = " UNION ALL ".join(f"SELECT {by}, cast({le} AS double) AS le, sum(value) AS cum FROM {rate_sql(n, 300)} WHERE value IS NOT NULL GROUP BY {by}" for n, le in LES)
    return f"""(WITH r AS ({rates}), w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY {by} ORDER BY le), 0.0) AS low, coalesce(lag(cum) OVER (PARTITION BY {by} ORDER BY le), 0.0) AS under, {q} * max(cum) OVER (PARTITION BY {by}) AS rnk FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY le) AS k FROM w WHERE cum >= rnk AND rnk > 0) SELECT {by}, CASE WHEN le > 1e300 THEN low ELSE low + (le - low) * (rnk - under) / (cum - under) END AS value FROM h WHERE k = 1)"""


rule("high_p95_latency", 600, ["service"], lambda s, d: over(quantile(s, d, 0.95, ["service"]), "value > 5.5"), f"SELECT *, value > 5.5 AS bad FROM {quantile_sql(0.95, ['service'])}")
rule("queue_backlog_high", 300, ["service"], lambda s, d: over(ops.sum_by(series(s, d, "backlog"), ["service"]), "value > 40"), f"SELECT service, ts, sum(value) > 40 AS bad FROM {series_sql('backlog')} GROUP BY ALL")
rule("queue_metrics_stale", 120, ONE, lambda s, d: over(series(s, d, "last_success"), f"unix_timestamp(ts) - unix_timestamp({START_HERE}) - value > 120"), f"SELECT *, epoch(ts) - epoch({START}) - value > 120 AS bad FROM {series_sql('last_success')}")
rule("queue_metrics_missing", 60, [], lambda s, d: ops.missing_ticks(ticks(s), series(s, d, "backlog")), f"SELECT ts, ts NOT IN (SELECT ts FROM {series_sql('backlog')}) AS bad FROM {TICKS}")
RATIO = f"(SELECT a.instance, a.service, a.ts, a.value / nullif(b.value, 0) AS value FROM {series_sql('avail')} a JOIN {series_sql('size')} b ON a.instance = b.instance AND a.service = b.service AND a.ts = b.ts)"


def space(spark, sf_dir) -> DataFrame:
    return ops.ratio(series(spark, sf_dir, "avail"), series(spark, sf_dir, "size"), ONE)


for _name, _hold, _test in (("disk_space_low", 600, "value < 0.15"), ("disk_space_critical", 300, "value < 0.05")):
    rule(_name, _hold, ONE, lambda s, d, t=_test: over(space(s, d), t), f"SELECT *, coalesce({_test}, false) AS bad FROM {RATIO}")


# -- notifications -------------------------------------------------------------------
CHANGES = f"(SELECT service, instance, ts, state FROM (SELECT *, lag(state) OVER (PARTITION BY instance, service ORDER BY ts) AS was FROM ({state_sql(f'SELECT *, value = 0 AS bad FROM ' + series_sql('up'), ONE, 120)})) WHERE state = 'resolved' OR state = 'firing' AND coalesce(was, '') <> 'firing')"


@query(f"""WITH c AS {CHANGES}, f AS (SELECT *, epoch(ts)::bigint AS tm, min(epoch(ts)::bigint) OVER (PARTITION BY service) AS first_ FROM c), k AS (SELECT *, greatest(0, ceil((tm - first_ - 30) / 300.0))::bigint AS k FROM f)
SELECT service, make_timestamp((first_ + 30 + k * 300) * 1000000) AS flush, count(*) FILTER (state = 'firing') AS firing, count(*) FILTER (state = 'resolved') AS resolved FROM k GROUP BY ALL""")
def alert_notifications(spark, sf_dir):
    from pyspark.sql import Window

    t = QUERIES["alert_service_down"](spark, sf_dir)
    was = F.lag("state").over(Window.partitionBy("instance", "service").orderBy("ts"))
    changes = t.withColumn("was", was).filter("state = 'resolved' OR state = 'firing' AND coalesce(was, '') <> 'firing'")
    return ops.flushes(changes.select("service", "instance", F.col("ts").cast("timestamp").alias("ts"), "state"), ["service"]).withColumn("flush", F.col("flush").cast("timestamp_ntz"))


FLUSHED = f"""(WITH c AS {CHANGES}, f AS (SELECT *, epoch(ts)::bigint AS tm, min(epoch(ts)::bigint) OVER (PARTITION BY service) AS first_ FROM c), k AS (SELECT *, greatest(0, ceil((tm - first_ - 30) / 300.0))::bigint AS k FROM f)
SELECT service, first_ + 30 + k * 300 AS at_, count(*) FILTER (state = 'firing') AS firing, count(*) FILTER (state = 'resolved') AS resolved FROM k GROUP BY ALL)"""
END = "1767225600 + 40 * 60"  #: the end of the samples


@query(f"""WITH a AS (SELECT *, sum(firing - resolved) OVER w AS active, coalesce(lead(at_) OVER w - 1, {END}) AS end_ FROM {FLUSHED} WINDOW w AS (PARTITION BY service ORDER BY at_)),
x AS (SELECT *, unnest(range(at_, CASE WHEN active > 0 AND end_ >= at_ + 420 THEN end_ ELSE at_ END + 1, 420)) AS t FROM a)
SELECT service, make_timestamp(t * 1000000) AS flush, CASE WHEN t > at_ THEN 0 ELSE firing END AS firing, CASE WHEN t > at_ THEN 0 ELSE resolved END AS resolved, active::bigint AS active, t > at_ AS repeated FROM x""")
def alert_repeats(spark, sf_dir):
    t = ops.repeats(alert_notifications(spark, sf_dir), ["service"], F.expr(f"cast({END} as bigint)"), 420)
    return t.withColumn("flush", F.col("flush").cast("timestamp_ntz"))


# -- panels --------------------------------------------------------------------------
@query(f"SELECT ts, sum(value) AS up, count(*) AS targets FROM {series_sql('up')} GROUP BY ts")
def panel_up(spark, sf_dir):
    return series(spark, sf_dir, "up").groupBy("ts").agg(F.sum("value").alias("up"), F.count("*").alias("targets"))


@query(f"SELECT r.service, r.ts, round(r.value, 6) AS requests, round(e.value, 6) AS errors FROM {summed_sql('requests', 300)} r JOIN {summed_sql('errors_5xx', 300)} e ON r.service = e.service AND r.ts = e.ts")
def panel_rates(spark, sf_dir):
    a, b = (summed(n, 300)(spark, sf_dir).withColumnRenamed("value", c) for n, c in (("requests", "requests"), ("errors_5xx", "errors")))
    return a.join(b, ["service", "ts"]).select("service", "ts", F.round("requests", 6).alias("requests"), F.round("errors", 6).alias("errors"))


@query(f"SELECT a.service, a.ts, round(a.value, 6) AS p95, round(b.value, 6) AS p99 FROM {quantile_sql(0.95, ['service'])} a JOIN {quantile_sql(0.99, ['service'])} b ON a.service = b.service AND a.ts = b.ts")
def panel_latency(spark, sf_dir):
    a, b = quantile(spark, sf_dir, 0.95, ["service"]).withColumnRenamed("value", "a"), quantile(spark, sf_dir, 0.99, ["service"]).withColumnRenamed("value", "b")
    return a.join(b, ["service", "ts"]).select("service", "ts", F.round("a", 6).alias("p95"), F.round("b", 6).alias("p99"))


@query(f"SELECT ts, round(value, 6) AS p95 FROM {quantile_sql(0.95, [])}")
def panel_overall_p95(spark, sf_dir):
    return quantile(spark, sf_dir, 0.95, []).select("ts", F.round("value", 6).alias("p95"))


@query(f"SELECT service, round(value, 6) AS p95 FROM {quantile_sql(0.95, ['service'])} WHERE ts = {START} + to_minutes({MINUTES - 1}) ORDER BY value DESC, service LIMIT 15")
def panel_slowest(spark, sf_dir):
    last = quantile(spark, sf_dir, 0.95, ["service"]).filter(F.expr(f"ts = {START_HERE} + make_interval(0, 0, 0, 0, 0, {MINUTES - 1}, 0)"))
    return last.orderBy(F.desc("value"), "service").limit(15).select("service", F.round("value", 6).alias("p95"))


# -- readiness -----------------------------------------------------------------------
@query(f"SELECT ts, count(*) AS target_count, count(*) FILTER (value = 1) AS up_target_count, array_to_string(list_sort(list(service) FILTER (value = 1)), ',') AS up_services FROM {series_sql('up')} GROUP BY ts")
def observability_targets(spark, sf_dir):
    # names are listed once a target
    t = series(spark, sf_dir, "up")
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("value") == 1, F.col("service")))), ",")
    return t.groupBy("ts").agg(F.count("*").alias("target_count"), F.count_if(F.col("value") == 1).alias("up_target_count"), names.alias("up_services"))


#: A rule for each kind of event and part of the users; those that were ever marked are loaded.
RULES = "SELECT DISTINCT 'alert_' || event_type || '_' || cast(user_id % 200 as string) AS name FROM {events}"
LOADED = RULES + " WHERE event_id % 7 = 0"


@query(f"{plain_sql(RULES)} EXCEPT {plain_sql(LOADED)}")
def missing_alert_rules(spark, sf_dir):
    return run_sql(spark, sf_dir, RULES).join(run_sql(spark, sf_dir, LOADED), "name", "left_anti")


@query(f"SELECT ts, up >= 10 AND q > 0 AND d > 0 AS ready, up, q AS queue_series, d AS disk_series FROM (SELECT t.ts, coalesce((SELECT count(*) FROM {series_sql('up')} u WHERE u.ts = t.ts AND value = 1), 0) AS up, coalesce((SELECT count(*) FROM {series_sql('backlog')} u WHERE u.ts = t.ts), 0) AS q, coalesce((SELECT count(*) FROM {series_sql('avail')} u WHERE u.ts = t.ts), 0) AS d FROM {TICKS} t)")
def observability_ready(spark, sf_dir):
    n = lambda name, col, where="true": series(spark, sf_dir, name).filter(where).groupBy("ts").agg(F.count("*").alias(col))
    t = ticks(spark).join(n("up", "up", "value = 1"), "ts", "left").join(n("backlog", "queue_series"), "ts", "left").join(n("avail", "disk_series"), "ts", "left").fillna(0)
    return t.withColumn("ready", (F.col("up") >= 10) & (F.col("queue_series") > 0) & (F.col("disk_series") > 0))


@query("SELECT event_type AS service, date_trunc('hour', ts) AS ts, cast(sum(count(*)) OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS double) AS value FROM events GROUP BY 1, 2")
def request_counters(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("service"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return ops.running_counters(log, ["service"])


@query("SELECT event_type AS service, round(sum(value), 4) AS sum, count(value) AS count FROM events GROUP BY 1")
def histogram_totals(spark, sf_dir):
    t = ops.histogram_totals(table(spark, sf_dir, "events").select(F.col("event_type").alias("service"), "value"), "value", ["service"])
    return t.select("service", F.round("sum", 4).alias("sum"), "count")


EXPECTED = [("health", 200), ("missing_key", 401), ("wrong_tenant", 404), ("bad_type", 415), ("audit", 1)]


@query("WITH a AS (SELECT event_id % 7 AS probe, CASE event_id % 5 WHEN 0 THEN 'health' WHEN 1 THEN 'missing_key' WHEN 2 THEN 'wrong_tenant' WHEN 3 THEN 'bad_type' ELSE 'audit' END AS step, (CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 415 ELSE 1 END + CASE WHEN event_id % 13 = 0 THEN 99 ELSE 0 END)::int AS got FROM events) SELECT step, got, count(*) AS n FROM a JOIN (VALUES " + ", ".join(f"('{n}', {c})" for n, c in EXPECTED) + ") v(step, want) USING (step) WHERE got <> want GROUP BY ALL")
def drill_mismatches(spark, sf_dir):
    e = F.col("event_id")
    steps = spark.createDataFrame(EXPECTED, "step string, want int")
    names, codes = F.array(*(F.lit(n) for n, _ in EXPECTED)), F.array(*(F.lit(c) for _, c in EXPECTED))
    t = table(spark, sf_dir, "events").select(F.element_at(names, (e % 5 + 1).cast("int")).alias("step"), (F.element_at(codes, (e % 5 + 1).cast("int")) + F.when(e % 13 == 0, 99).otherwise(0)).alias("got"))
    # counted first: few rows meet the steps, and no task sorts those of a whole step
    return t.groupBy("step", "got").agg(F.count("*").alias("n")).join(F.broadcast(steps), "step").filter("got <> want").select("step", "got", "n")
