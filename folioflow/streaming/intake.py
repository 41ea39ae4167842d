"""Uploads from files to queued jobs, in one stateful stream.

An upload is a row of a landing file: its bytes beside what the request says in
headers and form fields. A file holds many uploads, since a file and a folder
for each would be listed, opened and committed one by one. The stream reads the
bytes, checks them and takes their SHA-256; then only small rows travel to the state of their tenant, which
answers an idempotency key before it looks at the content, and a content before
it makes a job:

1.  a key that made a job is a replay of that job, for ever;
2.  content whose last job lies within the window and has not failed is a
    duplicate of that job, and its key is not kept;
3.  everything else is a job, recorded under its key and its content.

Rows of a tenant are taken in the order of their time, then number. State lies
in RocksDB on the workers and in the checkpoint, so a stream that is started
again goes on where it ended. Requests that are rejected change no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow import schemas as S
from folioflow.functions import text as X
from folioflow.operators import ingest as I

#: What a request says of its upload.
MARKS = ("tenant_id", "idempotency_key", "source", "declared", "at", "seq", "name")
#: Where submissions may come from.
SOURCES = ("api", "email", "batch", "connector")
RESULT = "seq long, tenant_id string, outcome string, http_status int, job_id long, status string, audit string"


def submit(requests: DataFrame, root: str) -> None:
    """Land text uploads: a row a request, many in one file. requests: the columns of ``MARKS`` and body; the content is the body's bytes and a line feed."""
    content = F.concat(F.coalesce("body", F.lit("")), F.lit("\n")).cast("binary").alias("content")
    kinds = {c: "long" if c in ("at", "seq") else "string" for c in MARKS}
    requests.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), content).write.mode("append").parquet(root)


def uploads(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """The landed uploads below ``root`` as a stream: ``MARKS``, content, size_bytes and sha256. Neither the listing nor the tasks grow with the number of uploads, only with their bytes."""
    landed = ", ".join(f"{c} {'long' if c in ('at', 'seq') else 'string'}" for c in MARKS) + ", content binary"
    rows = spark.readStream.schema(landed).option("maxFilesPerTrigger", files_per_batch).parquet(root)
    own = (F.col(c) if c in ("at", "seq") else F.nullif(F.col(c), F.lit("")).alias(c) for c in MARKS)
    return rows.select(*own, "content", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def known_source(source: Column, allowed: tuple[str, ...] = SOURCES) -> Column:
    return F.coalesce(F.lower(X.strip(source)).isin(*allowed), F.lit(False))


def judged(requests: DataFrame, failure: Column | None = None) -> DataFrame:
    """Small rows for the state: http_status of the checks (200: passed) and what went wrong afterwards, if anything did. failure: code of a failed step, or null."""
    check = I.check_upload(F.col("name"), F.col("declared"), F.col("content"))
    status = F.when(~known_source(F.coalesce("source", F.lit("api"))), 422).otherwise(check["http_status"])
    key = F.nullif(X.strip(F.col("idempotency_key")), F.lit(""))
    return requests.select("tenant_id", "seq", "at", key.alias("key"), "sha256", status.cast("int").alias("http_status"), (F.lit(None).cast("string") if failure is None else failure).alias("failure"))


def machine(hours: int) -> StatefulProcessor:
    """The state of a tenant. The class is made here so that it is sent whole: the process that sets up a stream's state does not have this package."""

    class Intake(StatefulProcessor):
        """Jobs by key, and the last job of each content."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.keys = handle.getMapState("keys", "key string", "job long, status string")
            self.contents = handle.getMapState("contents", "sha256 string", "job long, at long, status string")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            asked = [r for part in rows for r in zip(*(part[c] for c in ("at", "seq", "key", "sha256", "http_status", "failure")), strict=True)]
            out = [(int(seq), key[0], *self.answer(int(at), int(seq), k, sha, int(http), failure)) for at, seq, k, sha, http, failure in sorted(asked, key=lambda r: r[:2])]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"job_id": "Int64"})

        def answer(self, at: int, seq: int, key: str | None, sha: str, http: int, failure: str | None) -> tuple:
            if http != 200:
                return "rejected", http, None, None, ""
            if key and self.keys.containsKey((key,)):
                job, status = self.keys.getValue((key,))
                return "idempotent_replay", 202, job, status, "idempotency_replay"
            if self.contents.containsKey((sha,)):
                job, since, status = self.contents.getValue((sha,))
                if since >= at - hours * 3600 and status != "FAILED":
                    return "deduplicated", 202, job, status, "duplicate_detected"
            status = "FAILED" if failure else "QUEUED"
            if key:
                self.keys.updateValue((key,), (seq, status))
            self.contents.updateValue((sha,), (seq, at, status))
            steps = {None: "job_registered,artifact_persisted,workflow_queued", "ARTIFACT_UPLOAD_FAILED": "job_registered,artifact_upload_failed"}
            return ("failed" if failure else "accepted"), (503 if failure else 202), seq, status, steps.get(failure, "job_registered,artifact_persisted,queue_publish_failed")

        def close(self) -> None:
            pass

    return Intake()


def taken_in(requests: DataFrame, failure: Column | None = None, hours: int = S.SETTINGS.dedupe_window_hours) -> DataFrame:
    """What each request is answered (``RESULT``); requests: as ``uploads`` gives them. A request without a tenant is of the tenant ''."""
    rows = judged(requests, failure).withColumn("tenant_id", F.coalesce("tenant_id", F.lit("")))
    return rows.groupBy("tenant_id").transformWithStateInPandas(machine(hours), RESULT, "append", "none")
