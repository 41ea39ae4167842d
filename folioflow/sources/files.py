"""File sources and sinks: manifests, key=value files, JSON documents, binary objects."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.preflight import PLACEHOLDER

MANIFEST = "sample_id string, dataset string, split string, image_path string, ground_truth struct<expected_route:string,route:string,expected_ocr_text:string,expected_validation_verdict:string,expected_fields:map<string,string>,fields:map<string,string>>"


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Raw objects with their content and sha256."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def object_uri(bucket, key):
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def manifest(spark: SparkSession, path: str, dataset: str = "manifest", split: str = "test", offset: int = 0, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """JSON lines without blank and # lines, defaults filled in, optionally shuffled by a seed and sliced. Rows without image_path have an error."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    t = lines.select("_n", F.from_json("value", MANIFEST).alias("m")).select("_n", "m.*")
    gt = F.col("ground_truth")
    t = t.withColumn("expected_route", F.coalesce(F.nullif(gt["expected_route"], F.lit("")), F.nullif(gt["route"], F.lit("")), F.lit("generic")))
    t = t.withColumn("expected_fields", F.coalesce(gt["expected_fields"], gt["fields"], F.create_map().cast("map<string,string>")))
    t = t.withColumn("sample_id", F.coalesce("sample_id", F.concat_ws("-", F.lit(split), F.col("_n").cast("string"))))
    t = t.withColumn("dataset", F.coalesce("dataset", F.lit(dataset))).withColumn("split", F.coalesce("split", F.lit(split)))
    t = t.withColumn("error", F.when(F.coalesce(F.trim("image_path"), F.lit("")) == "", "image_path is missing"))
    t = t.orderBy(F.col("_n") if seed is None else F.xxhash64(F.lit(seed), "sample_id"))
    t = t.offset(offset) if offset else t
    return (t.limit(max(1, limit)) if limit is not None else t).drop("_n")


def env(spark: SparkSession, path: str) -> DataFrame:
    """key, value, error of KEY=VALUE lines; comments and blanks dropped, quotes stripped."""
    t = spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parts = F.split("value", "=", 2)
    value = F.regexp_replace(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), "^(['\"])(.*)\\1$", "$2")
    return t.select(F.trim(F.get(parts, F.lit(0))).alias("key"), value.alias("value"), F.when(F.size(parts) < 2, "no = in line").alias("error"))


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """metric and threshold of a JSON object; what is no number is dropped."""
    t = spark.read.text(path, wholetext=True).select(F.explode_outer(F.from_json("value", "map<string,string>")).alias("metric", "raw"))
    return t.select("metric", F.col("raw").try_cast("double").alias("threshold")).filter("threshold IS NOT NULL")


def receipts_first(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Receipts of the primary place, else of the secondary."""
    rest = secondary.join(primary.select(key), key, "left_anti")
    return primary.unionByName(rest)


def scratch(spark: SparkSession) -> str:
    """The folder for files of our own: the one that the cluster shares, or a local one where Spark runs on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        place = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/") + "/folioflow"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the scratch folder and read it back: later plans start from the files, whatever executors are lost."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_json(docs: DataFrame, path: str) -> None:
    """Write JSON documents (key, body) as rows of one data set, partitioned by nothing: a key written twice in one write is an error of the caller."""
    docs.select("key", "body").write.mode("overwrite").option("compression", "zstd").parquet(path)


def get_json(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Documents of ``put_json``, parsed: key and value; of one key if it is given."""
    t = spark.read.parquet(path)
    t = t.filter(F.col("key") == key) if key is not None else t
    return t.select("key", F.from_json("body", schema).alias("value"))


def checksums(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose content is not what was recorded. found: path, sha256; expected: path, sha256."""
    t = expected.alias("e").join(found.alias("f"), F.col("e.path") == F.col("f.path"), "left")
    reason = F.when(F.col("f.path").isNull(), "missing").when(F.col("e.sha256") != F.col("f.sha256"), "changed")
    return t.select(F.col("e.path").alias("path"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def masked(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows with the named columns hidden."""
    return df.withColumns({n: F.lit("***") for n in names})


def preflight(settings: DataFrame, required: list[str], secrets: list[str]) -> DataFrame:
    """Failures of key/value settings: missing, or a secret that is short or a placeholder. ``operators.preflight`` has the whole list of rules."""
    spark = settings.sparkSession
    want = spark.createDataFrame([(k, k in secrets) for k in dict.fromkeys([*required, *secrets])], "key string, secret boolean")
    t = want.join(settings.select("key", "value"), "key", "left")
    reason = F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "missing").when(F.col("secret") & F.col("value").rlike(PLACEHOLDER), "placeholder").when(F.col("secret") & (F.length("value") < 24), "too_short")
    return t.select("key", reason.alias("reason")).filter(F.col("reason").isNotNull())
