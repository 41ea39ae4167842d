"""Retention: three horizons over jobs and audit rows. A row goes only when strictly older than its horizon."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("preprocessed", "ocr", "layout", "classification", "extraction", "validation", "delivery", "evaluation")


@dataclass(frozen=True)
class Policy:
    raw_days: int = 30
    derived_days: int = 90
    audit_days: int = 365

    def __post_init__(self):
        if not 1 <= self.raw_days <= self.derived_days <= self.audit_days:
            raise ValueError("horizons must be at least 1 day and raw <= derived <= audit")


def older(at: Column, now: Column, days: int) -> Column:
    return at < now - F.expr(f"interval {days} days")


def candidates(jobs: DataFrame, now: Column, p: Policy) -> DataFrame:
    c = F.col("created_at")
    return jobs.agg(F.count_if(older(c, now, p.raw_days) & F.col("artifact_key").isNotNull()).alias("raw"), F.count_if(older(c, now, p.derived_days)).alias("derived"), F.count_if(older(c, now, p.audit_days)).alias("audit"))


def apply(jobs: DataFrame, now: Column, p: Policy) -> DataFrame:
    """Jobs that stay; those past the raw horizon lose their artifact."""
    stay = jobs.filter(~older(F.col("created_at"), now, p.derived_days))
    return stay.withColumn("artifact_key", F.when(~older(F.col("created_at"), now, p.raw_days), F.col("artifact_key")))


def prefixes(jobs: DataFrame, now: Column, p: Policy) -> DataFrame:
    """One row for each expired job and derived bucket: the prefix to delete."""
    gone = jobs.filter(older(F.col("created_at"), now, p.derived_days)).select("job_id")
    return gone.select("job_id", F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket")).withColumn("prefix", F.concat_ws("/", F.lit("jobs"), F.col("job_id").cast("string"), F.lit("")))
