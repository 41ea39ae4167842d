"""This package on the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def on_workers(spark: SparkSession) -> None:
    """Have Spark serve this package to the Python workers of the application, once. To be called before a function of it is made part of a plan."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="folioflow-"), "folioflow-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(PACKAGE):
            for full in (os.path.join(at, n) for n in names if n.endswith(".py")):
                z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
