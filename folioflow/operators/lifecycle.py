"""The life of a job as rows that are only ever added: events in, the job table as a view over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the two tables.
JOBS = """job_id string, tenant_id string, source string, status string, idempotency_key string, sha256 string, original_filename string, content_type string, size_bytes long,
 artifact_bucket string, artifact_key string, artifact_uri string, workflow_id string, workflow_run_id string, error_code string, error_message string, metadata map<string,string>, created_at timestamp, updated_at timestamp"""
AUDIT = "id long, job_id string, tenant_id string, actor_id string, event_type string, event_payload string, created_at timestamp"


def ensure_tables(spark: SparkSession, database: str, fmt: str = "parquet") -> None:
    """Create the two tables where they are missing."""
    for name, columns in (("ingestion_jobs", JOBS), ("ingestion_audit_events", AUDIT)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns.replace(chr(10), ' ')}) USING {fmt}")


def received(submissions: DataFrame, now: Column) -> DataFrame:
    """New job rows: status RECEIVED, nothing stored yet."""
    absent = [c.split()[0] for c in JOBS.split(",") if c.split()[0] not in submissions.columns and c.split()[0] not in ("status", "created_at", "updated_at", "metadata", "map<string")]
    t = submissions
    for c in absent:
        if c.isidentifier():
            t = t.withColumn(c, F.lit(None).cast("string"))
    if "metadata" not in t.columns:
        t = t.withColumn("metadata", F.create_map().cast("map<string,string>"))
    return t.withColumn("status", F.lit("RECEIVED")).withColumn("created_at", now).withColumn("updated_at", now)


def jobs(events: DataFrame) -> DataFrame:
    """The job table from its events, one pass. events: job_id, at, seq, kind (RECEIVED, STORED, QUEUED, FAILED) and the columns that a kind sets.

    The last event gives the status; what an earlier kind has set stays. A message keeps its first 500 characters.
    """
    order = F.struct("at", "seq")

    def last(column: str, kind: str) -> Column:
        return F.max_by(F.when(F.col("kind") == kind, F.col(column)), F.when(F.col("kind") == kind, order)).alias(column)

    return events.groupBy("job_id").agg(
        F.max_by("kind", order).alias("status"), last("artifact_bucket", "STORED"), last("artifact_key", "STORED"), last("workflow_id", "QUEUED"), last("error_code", "FAILED"),
        F.max_by(F.when(F.col("kind") == "FAILED", F.left("error_message", F.lit(500))), F.when(F.col("kind") == "FAILED", order)).alias("error_message"),
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
    )


def history(polls: DataFrame) -> DataFrame:
    """All states that a job was seen in, in order, repeated ones too. polls: job_id, at, seq, status."""
    return polls.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", "status"))), lambda x: x["status"]).alias("history"))


def audit_of(audit: DataFrame, tenant: str, job: Column | str, limit: int, most: int = 500) -> DataFrame:
    """A job's newest audit rows, for its tenant only; at least 1 and at most ``most``."""
    own = audit.filter((F.col("tenant_id") == tenant) & (F.col("job_id") == job))
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, most)))


def job_of(jobs_: DataFrame, tenant: str, job) -> DataFrame:
    return jobs_.filter((F.col("tenant_id") == tenant) & (F.col("job_id") == job)).limit(1)


def iso(at: Column) -> Column:
    """ISO-8601 text of a timestamp without a zone: microseconds only where there are some."""
    return F.when(F.date_format(at, "SSSSSS") == "000000", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
