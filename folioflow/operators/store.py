"""A job table that is only ever added to, with compaction; and its audit rows.

Events lie in folders by batch, so that a batch that is written twice replaces
itself; a snapshot lies in folders by bucket of the job. What is read is both
together: of a job only its first event and the last of each kind count, and
counting one of them twice changes nothing, so a compaction that breaks off
halfway loses and doubles nothing. A job that is deleted is an event too; the
next compaction leaves it out. Audit rows lie by day, and retention drops days.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.operators import lifecycle as LC
from folioflow.sources.files import keep

DYNAMIC = {"partitionOverwriteMode": "dynamic"}


def outline(events: DataFrame) -> DataFrame:
    """The events that the job table stands on: each job's first, and its last of every kind."""
    order, row = F.struct("at", "seq"), F.struct(*events.columns)
    ends = events.groupBy("job_id", "kind").agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
    return ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("e")).select("e.*")


class JobStore:
    """Jobs below ``root``. schema: the columns of the events (job_id, tenant_id, at, seq, kind and what kinds set)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.schema = StructType([f for f in schema.fields if f.name not in ("bucket", "batch")])
        for place in ("events/batch=-1", "snapshot/bucket=-1"):
            spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{root}/{place}")

    def append(self, events: DataFrame, batch: int) -> None:
        events.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/events/batch={batch}")

    def events(self, upto: int | None = None) -> DataFrame:
        t = self.spark.read.schema(StructType(list(self.schema.fields)).add("batch", "long")).parquet(f"{self.root}/events")
        return (t if upto is None else t.filter(F.col("batch") <= upto)).drop("batch")

    def snapshot(self) -> DataFrame:
        return self.spark.read.schema(StructType(list(self.schema.fields)).add("bucket", "long")).parquet(f"{self.root}/snapshot")

    def compact(self, upto: int) -> None:
        """Take the batches up to one into the snapshot. Only the buckets of their jobs are written anew; the batches are dropped last."""
        bucket = F.pmod(F.xxhash64("job_id"), F.lit(self.buckets))
        new = self.events(upto).withColumn("bucket", bucket)
        touched = new.select("bucket").distinct()
        before = self.snapshot().join(F.broadcast(touched), "bucket").select(*self.schema.names)  # buckets are few
        merged = keep(outline(before.unionByName(new.drop("bucket"))), "jobs-compacted")
        gone = merged.filter("kind = 'DELETED'").select("job_id")
        rest = merged.join(gone, "job_id", "left_anti").withColumn("bucket", bucket)
        # a bucket whose jobs are all gone keeps a folder with an empty file
        empty = touched.join(rest.select("bucket").distinct(), "bucket", "left_anti").collect()
        rest.write.mode("overwrite").options(**DYNAMIC).partitionBy("bucket").parquet(f"{self.root}/snapshot")
        for r in empty:
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.root}/snapshot/bucket={r['bucket']}")
        self._drop("events", "batch", lambda n: 0 <= n <= upto)

    def jobs(self) -> DataFrame:
        events = self.snapshot().select(*self.schema.names).unionByName(self.events())
        owner = events.groupBy("job_id").agg(F.max_by("tenant_id", F.struct("at", "seq")).alias("tenant_id"))
        return LC.jobs(events).filter("status <> 'DELETED'").join(owner, "job_id")

    def expire(self, horizon: datetime, batch: int) -> None:
        """Delete the jobs that were made before ``horizon``, as events."""
        old = self.jobs().filter(F.col("created_at") < F.lit(horizon)).select("job_id", "tenant_id", F.lit(horizon).cast(self.schema["at"].dataType).alias("at"))
        latest = F.greatest("at", F.col("updated_at"))
        old = old.join(self.jobs().select("job_id", "updated_at"), "job_id").select("job_id", "tenant_id", latest.alias("at"), F.lit(2**62).alias("seq"), F.lit("DELETED").alias("kind"))
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in old.columns]
        self.append(keep(old.select("*", *rest), "jobs-expired"), batch)

    def audit(self, rows: DataFrame, batch: int) -> None:
        """Add audit rows (with created_at)."""
        dated = rows.withColumn("day", F.to_date("created_at")).withColumn("batch", F.lit(batch))
        dated.write.mode("overwrite").options(**DYNAMIC).partitionBy("day", "batch").parquet(f"{self.root}/audit")

    def audits(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/audit")

    def expire_audit(self, horizon: datetime) -> None:
        """Drop audit rows from before ``horizon``: whole days by their folders, of its own day what is older."""
        day = horizon.date()
        own = keep(self.audits().filter((F.col("day") == F.lit(day)) & (F.col("created_at") >= F.lit(horizon))), "audit-kept")
        self._drop("audit", "day", lambda d: datetime.fromisoformat(d).date() <= day, text=True)
        own.write.mode("append").partitionBy("day", "batch").parquet(f"{self.root}/audit")

    def _drop(self, table: str, key: str, gone, text: bool = False) -> None:
        """Delete the folders ``key=value`` of a table whose value is ``gone``; there is one a batch or a day."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith(f"{key}=") and gone(name.split("=", 1)[1] if text else int(name.split("=", 1)[1])):
                fs.delete(status.getPath(), True)
