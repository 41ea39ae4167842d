"""Receipts of what was sent, each key once, in a first place or, where that fails, a second one.

Receipts lie in folders by bucket of the key and by batch (its stream and number).
A batch looks for receipts of its keys in the buckets that it has itself, and in
all batches but its own: when it runs again, after a crash in the middle, it finds
what it found before and replaces what it wrote.
"""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.sources.files import keep

PLACES = ("primary", "secondary")


class Receipts:
    """Receipts below ``root``. schema: their columns; key: the one that is unique; refused: rows that the first place does not take."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, refused: Column | None = None, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        self.schema, self.refused = StructType(list(schema.fields)), F.lit(False) if refused is None else F.coalesce(refused, F.lit(False))
        for place in PLACES:
            spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{root}/{place}/bucket=-1/batch=-1")

    def at(self, place: str) -> DataFrame:
        return self.spark.read.schema(StructType(list(self.schema.fields)).add("bucket", "long").add("batch", "string")).parquet(f"{self.root}/{place}")

    def all(self) -> DataFrame:
        """Every receipt and its place; a key in both counts in the first."""
        first, second = self.at(PLACES[0]), self.at(PLACES[1])
        second = second.join(first.select(self.key), self.key, "left_anti")
        return first.withColumn("place", F.lit(PLACES[0])).unionByName(second.withColumn("place", F.lit(PLACES[1])))

    def write(self, batch: DataFrame, number: int, run: str = "0") -> None:
        """Receipts of the keys that have none yet. run: a name of the stream, which numbers its batches."""
        own_batch = f"{run}-{number}"
        rows = batch.select(*self.schema.names).dropDuplicates([self.key]).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))
        rows = keep(rows.withColumn("batch", F.lit(own_batch)), "receipts-batch")
        own = [r[0] for r in rows.select("bucket").distinct().collect()]  # no more than there are buckets
        for place in PLACES:
            old = self.at(place).filter(F.col("bucket").isin(own) & (F.col("batch") != own_batch)).select(self.key)
            rows = rows.join(old, self.key, "left_anti")
        rows = keep(rows, "receipts-new")
        self.put(rows.filter(self.refused), PLACES[1])
        try:
            self.put(rows.filter(~self.refused), PLACES[0])
        except (Py4JJavaError, PySparkException):  # the place is gone: nothing of this batch is kept there
            self.put(rows, PLACES[1])

    def put(self, rows: DataFrame, place: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.root}/{place}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        stream.writeStream.foreachBatch(lambda batch, number: self.write(batch, number, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
