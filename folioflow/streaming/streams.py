"""Structured Streaming forms of intake, de-duplication, rates and alerts.

Each builder takes a streaming frame and returns one; ``drain`` runs a stream
over what its source holds now, into files, and gives the result as a table.
Late rows: windows wait ten minutes where a watermark is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.operators import ingest as I
from folioflow.sources.files import keep, scratch

LATENESS = "10 minutes"
#: State on the workers' disks and in the checkpoint, not in their memory.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A table as a stream of files; ``ts`` becomes a timestamp, because watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else s


def advance(stream: DataFrame, base: str, mode: str = "append") -> None:
    """Run a stream over what its source holds and has not given yet. Called again with the same ``base`` it goes on where it ended.

    Every batch is one folder of files below ``base``, so a batch that runs
    twice replaces itself; the state is in its checkpoint there.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        out = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], before)


def given(spark: SparkSession, schema: str | StructType, base: str) -> DataFrame:
    """The rows of all batches below ``base``, with column batch."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    spark.createDataFrame([], wanted).write.mode("overwrite").parquet(f"{base}/out/batch=-1")
    return spark.read.schema(wanted.add("batch", "long")).parquet(f"{base}/out")


def drain(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for all that its source holds now, as a table. With ``keys`` the stream updates rows: the last of each key counts."""
    base = f"{scratch(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    advance(stream, base, "append" if keys is None else "update")
    got = given(stream.sparkSession, stream.schema, base)
    if keys is None:
        return got.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rest)).select(*stream.columns)


def tumbling(events: DataFrame, keys: list[str], width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATENESS).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, keys: list[str], width: str, step: str) -> DataFrame:
    return events.withWatermark("ts", LATENESS).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"))


def first_by_key(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent intake: the first row of a key wins for ever, so the state is kept for ever."""
    return jobs.dropDuplicates(keys)


def dedupe(jobs: DataFrame, base: str, hours: int = 24) -> None:
    """As the batch rule, batch after batch: the last accepted job of a content is its anchor for the next batch.

    Anchors lie in folders by day and batch, so a batch reads those of its own
    window only and, when it runs twice, replaces its own.
    """
    spark = jobs.sparkSession
    anchors, names = f"{base}/anchors", ["tenant_id", "sha256", "job_id", "at", "failed"]
    kinds = StructType([*(jobs.schema[c] for c in names[:3])]).add("at", "long").add("failed", "boolean").add("day", "long").add("batch", "long")
    spark.createDataFrame([], kinds).drop("day", "batch").write.mode("append").parquet(f"{anchors}/day=-1/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        rows = keep(batch, "dedupe-batch")
        first = rows.agg(F.min(I.second(F.col("created_at")))).first()[0]
        recent = spark.read.schema(kinds).parquet(anchors).filter((F.col("batch") < number) & (F.col("day") >= ((first or 0) - hours * 3600) // 86400))
        last = recent.groupBy("tenant_id", "sha256").agg(F.max(F.struct("at", "job_id", "failed")).alias("r")).select("tenant_id", "sha256", "r.job_id", "r.at", "r.failed")
        found = keep(I.dedupe_anchored(rows, hours, last), "dedupe-found")
        found.select("job_id", "duplicate_of").write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        new = I.anchors_of(rows, found).withColumn("day", F.floor(F.col("at") / 86400)).withColumn("batch", F.lit(number))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(anchors)

    jobs.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def alerts(samples: DataFrame, base: str, hold_seconds: int, key: str, slot: int = 3600) -> None:
    """Alert states of a boolean condition ``bad`` per key: inactive, pending, firing after ``hold_seconds``; batch after batch below ``base``, as id and state.

    Rows of a key meet by slots of an hour, so no task holds a key. A slot tells the
    next ones whether it ends in a bad run and since when; what a batch ends in is
    the state for the next one, and a batch that runs twice replaces its own.
    """
    spark = samples.sparkSession
    kinds = StructType([samples.schema[key]]).add("since", "long")
    spark.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{base}/since/batch=-1")
    # by time, then id; rows without a time are a slot of their own
    row, before = Window.partitionBy(key, "slot").orderBy(F.col("at").asc_nulls_last(), "id"), Window.unboundedPreceding
    slots = Window.partitionBy(key).orderBy("slot")

    def runs(start: Column, bad: str, over: WindowSpec) -> Column:
        return F.when(F.col(bad), F.last(start, True).over(over.rowsBetween(before, 0)))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("at", F.unix_seconds("ts")).withColumn("slot", F.floor(F.col("at") / slot)).select(key, "slot", "at", "id", "bad")
        rows = rows.withColumn("starts", F.col("bad") & ~F.coalesce(F.lag("bad").over(row), F.lit(False))).withColumn("goods", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(row.rowsBetween(before, 0)))
        rows = keep(rows.withColumn("since", runs(F.when(F.col("starts"), F.col("at")), "bad", row)), "alert-rows")
        ends = rows.filter("slot IS NOT NULL").groupBy(key, "slot").agg(F.max(F.struct("at", "id", "bad", "since")).alias("end"), F.max("goods").alias("goods")).select(key, "slot", "end.bad", "end.since", "goods")
        kept = spark.read.schema(kinds).parquet(f"{base}/since/batch={number - 1}").select(key, F.lit(-(1 << 62)).alias("slot"), F.col("since").isNotNull().alias("bad"), "since", F.lit(1).cast("long").alias("goods"))
        ends = kept.union(ends)
        # a slot of bad rows only goes on with the run of the slot before
        begins = F.when((F.col("goods") > 0) | ~F.col("went_on"), F.col("since"))
        ends = ends.withColumn("went_on", F.coalesce(F.lag("bad").over(slots), F.lit(False))).withColumn("open", runs(begins, "bad", slots))
        ends = keep(ends.withColumn("carried", F.lag("open").over(slots)), "alert-slots")
        ends.groupBy(key).agg(F.max_by("open", "slot").alias("since")).write.mode("overwrite").parquet(f"{base}/since/batch={number}")
        carry = ends.filter("carried IS NOT NULL").select(F.col(key).alias("of"), F.col("slot").alias("in"), "carried")
        met = rows.join(carry, F.col(key).eqNullSafe(F.col("of")) & (F.col("slot") == F.col("in")), "left")
        since = F.when(F.col("goods") == 0, F.coalesce("carried", "since")).otherwise(F.col("since"))
        state = F.when(~F.col("bad"), "inactive").when(F.col("at") - since >= hold_seconds, "firing").otherwise("pending")
        met.select("id", state.alias("state")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    samples.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
