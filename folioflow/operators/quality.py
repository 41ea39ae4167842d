"""Evaluation: field scores, sample metrics, aggregates, gates and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions import text as X
from folioflow.operators.rank import percentiles


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def compare_fields(expected: Column, predicted: Column) -> Column:
    """Counts, precision, recall and F1 of two field maps. Values equal after normalising count as correct, two empty ones too."""
    comparable = F.map_filter(expected, lambda k, v: (k != "line_item_count") & (F.coalesce(v, F.lit("")) != ""))
    pairs = F.transform(F.map_entries(comparable), lambda e: F.struct(X.field_value(e["key"], F.try_element_at(predicted, e["key"])).alias("got"), X.field_value(e["key"], e["value"]).alias("want")))

    def counted(a: Column) -> Column:
        present, correct = F.size(F.filter(a, lambda x: x["got"] != "")), F.size(F.filter(a, lambda x: x["got"] == x["want"]))
        return F.struct(F.size(a).alias("expected_field_count"), present.alias("predicted_present_count"), correct.alias("correct_field_count"))

    return X.let(pairs, counted)


def scores(df: DataFrame) -> DataFrame:
    """Adds field_precision, field_recall and field_f1 from the counts of ``compare_fields`` in column c."""
    p, r = ratio(F.col("c.correct_field_count"), F.col("c.predicted_present_count")), ratio(F.col("c.correct_field_count"), F.col("c.expected_field_count"))
    t = df.withColumn("_p", p).withColumn("_r", r)
    f1 = ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    return t.select(*df.columns, F.round("_p", 6).alias("field_precision"), F.round("_r", 6).alias("field_recall"), F.round(f1, 6).alias("field_f1"))


def aggregate(metrics: DataFrame, elapsed: float) -> DataFrame:
    """One row: rates and means. Scores and confidences count missing as 0; error rates, latency and validation skip what is missing."""
    zero = lambda c: F.round(F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0)), 6)
    share = lambda c: F.round(F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    done = F.col("runtime_status") == "COMPLETED"
    latency = percentiles(metrics, "latency", {"_p50": 0.5, "_p95": 0.95}, [])
    rates = metrics.agg(
        F.count("*").cast("double").alias("sample_count"), share(done).alias("completion_rate"), share(F.col("contract_passed")).alias("pipeline_contract_pass_rate"), share(F.col("route_match")).alias("route_accuracy"),
        zero("field_f1").alias("field_f1_mean"), zero("extraction_confidence").alias("extraction_confidence_mean"), F.round(F.avg("ocr_cer"), 6).alias("ocr_cer_mean"), F.round(F.avg("ocr_wer"), 6).alias("ocr_wer_mean"),
        F.round(F.avg(F.col("validation_correct").cast("double")), 6).alias("validation_accuracy"), share(F.col("requires_review")).alias("human_review_rate"),
        F.round(F.count_if(done) * 60 / elapsed, 6).alias("throughput_documents_per_minute") if elapsed else F.lit(None).cast("double").alias("throughput_documents_per_minute"),
    )
    both = rates.withColumn("_one", F.lit(0)).join(latency.withColumn("_one", F.lit(0)), "_one")
    latencies = [F.round("_p50", 6).alias("latency_p50_seconds"), F.round("_p95", 6).alias("latency_p95_seconds")]
    return both.select(*rates.columns[:-1], *latencies, rates.columns[-1])


def gate(aggregates: DataFrame, gates=S.GATES) -> DataFrame:
    """One row per check, in order: a configured check without a value fails."""
    rows = F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(m).alias("metric"), F.lit(op).alias("operator"), F.lit(float(t)).alias("threshold"), F.col(m).cast("double").alias("actual")) for k, (m, op, t) in enumerate(gates)))
    t = aggregates.select(F.explode_outer(rows).alias("g")).select("g.*")
    met = F.when(F.col("operator") == ">=", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    return t.withColumn("passed", F.coalesce(met, F.lit(False)))


def gate_passed(checks: DataFrame, errors: int) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("_all")).select((F.col("_all") & F.lit(errors == 0)).alias("passed"))


def promotion_failures(checks: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy thresholds that the evidence's checks lack, state otherwise or do not pass. policy: metric, threshold."""
    t = policy.alias("p").join(checks.alias("c"), F.col("p.metric") == F.col("c.metric"), "left")
    reason = F.when(F.col("c.metric").isNull(), "missing").when(F.abs(F.col("c.threshold") - F.col("p.threshold")) > 1e-9, "threshold_mismatch").when(~F.col("c.passed"), "failed")
    return t.select(F.col("p.metric").alias("metric"), reason.alias("reason")).filter(F.col("reason").isNotNull())
