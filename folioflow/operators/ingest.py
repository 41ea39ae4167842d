"""Intake: upload checks, tenants, idempotent replay, windowed content de-duplication, status history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions import text as X
from folioflow.sources.files import keep

EXTENSIONS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff"}
MIMES = tuple(dict.fromkeys(EXTENSIONS.values()))


def check_upload(name: Column, declared: Column, content: Column) -> Column:
    """Struct http_status (200 if accepted), reason and mime; the first failing check counts, cheapest first."""
    ext = F.lower(F.substring_index(X.file_name(name), ".", -1))
    sniffed, said = X.mime_of(content), X.content_type(declared)
    by_ext = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    mime = F.coalesce(sniffed, F.when((said != "") & (said != "application/octet-stream"), said), F.try_element_at(by_ext, ext))
    size = F.octet_length(content)
    declared_bad = (F.coalesce(said, F.lit("")) != "") & (said != "application/octet-stream") & ~said.isin(*MIMES)
    status = (
        F.when(size > S.SETTINGS.upload_max_bytes, 413)
        .when(F.coalesce(size, F.lit(0)) == 0, 400)
        .when(~ext.isin(*EXTENSIONS), 415)
        .when(declared_bad, 415)
        .when(sniffed.isNotNull() & ~sniffed.isin(*MIMES), 415)
        .when(F.coalesce(mime.isin(*MIMES), F.lit(False)), 200)
        .otherwise(415)
    )
    reason = (
        F.when(size > S.SETTINGS.upload_max_bytes, "too_large").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(~ext.isin(*EXTENSIONS), "extension")
        .when(declared_bad, "declared_mime").when(sniffed.isNotNull() & ~sniffed.isin(*MIMES), "signature").when(F.coalesce(mime.isin(*MIMES), F.lit(False)), "accepted").otherwise("mime")
    )
    return F.struct(status.alias("http_status"), reason.alias("reason"), mime.alias("mime"))


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """The only way in which tenant data is read."""
    return df.filter(F.col("tenant_id") == tenant)


def authenticate(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds outcome ok, missing_key, invalid_key or scope_violation. keys: api_key, key_tenant."""
    t = requests.join(keys, "api_key", "left")
    outcome = F.when(F.coalesce(F.col("api_key"), F.lit("")) == "", "missing_key").when(F.col("key_tenant").isNull(), "invalid_key").when(F.col("key_tenant") != F.col("tenant_id"), "scope_violation").otherwise("ok")
    return t.withColumn("outcome", outcome)


def idempotent(jobs: DataFrame) -> DataFrame:
    """Adds is_replay and accepted_job: the first job of a tenant's key wins for ever; jobs without a key are never replays."""
    w = Window.partitionBy("tenant_id", "idempotency_key").orderBy("created_at", "job_id")
    keyed = F.col("idempotency_key").isNotNull()
    return jobs.withColumn("accepted_job", F.when(keyed, F.first("job_id").over(w)).otherwise(F.col("job_id"))).withColumn("is_replay", F.col("accepted_job") != F.col("job_id"))


def second(at: Column) -> Column:
    """Seconds since 1970, the nearest whole one; of two the even one. Windows and orders of intake are of such seconds."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / F.lit(1e6)).cast("long")


def dedupe_anchored(jobs: DataFrame, hours: int = S.SETTINGS.dedupe_window_hours, anchors: DataFrame | None = None, slot: int = 3600) -> DataFrame:
    """One row per job (tenant_id, sha256, job_id, duplicate_of): the latest accepted job of the same tenant and content within the window, unless that one failed.

    A duplicate makes no row of its own, so the window hangs on the last accepted
    job. Which row would be accepted next after an accepted one depends on that
    row alone: the first beyond its window, or the very next one if it failed. So
    every row gets a pointer, and what is reached from a content's first row, by
    pointers that double their reach every round, is accepted. Rows of one
    content meet in slots of ``slot`` seconds and the slots by one row each, so
    no task holds a content.

    Jobs of equal times are ordered by their ids; jobs without a time are
    accepted and no one's original. anchors (tenant_id, sha256, job_id, at,
    failed): the last accepted job of contents that were seen before; jobs that
    are older than their anchor count as of its time.
    """
    span = hours * 3600
    content = F.struct("tenant_id", "sha256")
    rows = jobs.select(content.alias("g"), second(F.col("created_at")).alias("at"), "job_id", F.coalesce(F.col("status") == "FAILED", F.lit(False)).alias("failed"), F.lit(False).alias("old"))
    if anchors is not None:
        before = anchors.select(content.alias("g"), "at", "job_id", "failed", F.lit(True).alias("old"))
        since = before.select(F.col("g").alias("_g"), F.col("at").alias("_since"))
        rows = rows.join(since, rows["g"] == since["_g"], "left").withColumn("at", F.when(F.col("at").isNotNull(), F.greatest("at", "_since"))).drop("_g", "_since").unionByName(before)
    rows = keep(rows.withColumn("id", F.monotonically_increasing_id()), "dedupe-rows")
    own = F.struct("at", ~F.col("old"), "job_id", "id")
    timed = rows.filter("at IS NOT NULL").select("g", "id", "job_id", "at", "failed", own.alias("own"), F.floor(F.col("at") / slot).alias("s"))

    # a row asks at the end of its window, a failed one at itself: which row comes next there?
    ask = timed.filter("NOT failed").select("g", "id", (F.col("at") + span).alias("at"), F.floor((F.col("at") + span) / slot).alias("s"))
    met = timed.select("g", "s", "at", "id", "own", "failed").unionByName(ask.select("g", "s", "at", "id", F.lit(None).cast(timed.schema["own"].dataType).alias("own"), F.lit(True).alias("failed")))
    latest_first = Window.partitionBy("g", "s").orderBy(F.desc("at"), F.col("own").isNull().desc(), F.desc("own"))
    met = met.withColumn("next", F.last("own", True).over(latest_first.rowsBetween(Window.unboundedPreceding, -1)))
    slots = met.groupBy("g", "s").agg(F.min("own").alias("head"))
    slots = slots.withColumn("later", F.last("head", True).over(Window.partitionBy("g").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)))
    pointers = met.filter("failed").join(slots.select("g", "s", "later"), ["g", "s"]).select("id", F.coalesce("next", "later")["id"].alias("to")).filter("to IS NOT NULL")

    jump = keep(pointers, "dedupe-pointers")
    reached = keep(timed.groupBy("g").agg(F.min("own")["id"].alias("id")).select("id"), "dedupe-reached")
    while True:
        new = keep(reached.join(jump, "id").select(F.col("to").alias("id")), "dedupe-reached")
        if new.isEmpty():
            break
        reached = reached.union(new)
        jump = keep(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")), "dedupe-pointers")

    accepted = timed.join(reached.withColumn("ok", F.lit(True)), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    accepted = accepted.withColumn("last", F.last(F.when(F.col("ok"), F.struct("job_id")), True).over(Window.partitionBy("g", "s").orderBy("own")))
    ends = accepted.groupBy("g", "s").agg(F.max_by("last", "own").alias("end"))
    ends = ends.withColumn("earlier", F.last("end", True).over(Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)))
    found = accepted.join(ends.select("g", "s", "earlier"), ["g", "s"]).select("g", "id", "job_id", F.when(~F.col("ok"), F.coalesce("last", "earlier")["job_id"]).alias("duplicate_of"))
    if anchors is not None:
        found = found.join(rows.filter("old").select("id"), "id", "left_anti")
    untimed = rows.filter("at IS NULL").select("g", "job_id", F.lit(None).cast(rows.schema["job_id"].dataType).alias("duplicate_of"))
    return found.drop("id").unionByName(untimed).select("g.tenant_id", "g.sha256", "job_id", "duplicate_of")


def anchors_of(jobs: DataFrame, found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The last accepted job of each content: of ``jobs`` as ``dedupe_anchored`` judged them, else of before. ``job_id`` names a row of ``jobs``."""
    kept = jobs.join(found.filter("duplicate_of IS NULL").select("job_id"), "job_id", "left_semi")
    at = second(F.col("created_at"))
    rows = kept.filter("created_at IS NOT NULL").select("tenant_id", "sha256", "job_id", at.alias("at"), F.coalesce(F.col("status") == "FAILED", F.lit(False)).alias("failed"))
    rows = rows if before is None else rows.unionByName(before)
    last = rows.groupBy("tenant_id", "sha256").agg(F.max(F.struct("at", "job_id", "failed")).alias("r"))
    return last.select("tenant_id", "sha256", "r.job_id", "r.at", "r.failed")


def recent_by_hash(jobs: DataFrame, hours: int = S.SETTINGS.dedupe_window_hours, order: Column | None = None) -> DataFrame:
    """As-of self join: for each job the latest earlier job of the same tenant and content within the window. A window frame does it in one shuffle. order: what makes a job the latest, of its second ``_at`` and its columns; without it that second, then the id."""
    t = jobs.withColumn("_at", second(F.col("created_at")))
    w = Window.partitionBy("tenant_id", "sha256").orderBy("_at").rangeBetween(-hours * 3600, -1)
    latest = F.struct("_at", "job_id") if order is None else F.struct(order, "_at", "job_id")
    return t.withColumn("recent_job", F.max(latest).over(w)["job_id"]).drop("_at")


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per job by time, then event id."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.count("*").alias("n"))


def overlay(status: Column, workflow: Column) -> Column:
    return F.when(workflow.isNotNull() & (status != "FAILED"), workflow).otherwise(status)


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def newest(df: DataFrame, limit: int, most: int = 200) -> DataFrame:
    """Newest rows first, the limit clamped; one TakeOrdered, no full sort."""
    return df.orderBy(F.desc("created_at"), F.desc("job_id")).limit(clamp(limit, most))
