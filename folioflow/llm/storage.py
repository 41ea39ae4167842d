"""Shared, durable places for intermediate tables and files.

Every table that cuts lineage is written below ``spark.checkpoint.dir``, the
folder that the cluster shares. Only where that setting is absent and Spark
runs on one machine (unit tests) a folder of our own is made and set; a cluster
without the setting is an error, because its machines would not see it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def on_workers(spark: SparkSession) -> None:
    """Ship this package to the Python workers of the session, once an application.

    Every operator calls this before it builds a plan with Python in it, because
    a function takes the list of shipped files along when it is made.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="folioflow-")
    path = os.path.join(folder, "folioflow-workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)  # Spark serves it to all executors, also to later ones
    _shipped.add(context.applicationId)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Send texts to the workers in batches of some megabytes: of ``rows`` rows, where the session has no number of its own. A batch counts rows only, and an executor holds several."""
    if spark.conf.get(BATCH) == "10000" and not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, rows)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; made only where it is unset and everything runs on this machine."""
    place = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{KEY} must name a folder that all machines of the cluster share")
        place = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set(KEY, place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/folioflow/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later plans start from the files, so a lost executor costs one re-read
    and not a recomputation.
    """
    on_workers(df.sparkSession)
    path = fresh_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete tables that ``settle`` wrote and nobody reads any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else [f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()[:1]]
    for p in paths:
        if "/folioflow/" in p:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Names for columns of our own beside ``columns``: the given ones, with underscores before them where they are taken."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as Spark reads it, dots and back-ticks and all."""
    return "`" + name.replace("`", "``") + "`"


def plainly(df: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(df)``, which keeps the columns of ``df``, with plain names in place of those that hold dots or back-ticks: Spark's Arrow functions do not find such columns."""
    names = df.columns
    plain: list[str] = []
    for c in names:
        plain += unused([*names, *plain], "column") if "." in c or "`" in c else [c]
    return run(df) if plain == names else run(df.toDF(*plain)).toDF(*names)
