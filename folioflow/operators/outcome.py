"""Review, delivery, webhook and evaluation records with content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S


def content_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(length)))


def priority(confidence: Column, given: Column | None = None) -> Column:
    own = F.when(confidence < S.SETTINGS.review_high_priority, "high").when(confidence < S.SETTINGS.auto_approve, "medium").otherwise("normal")
    return own if given is None else F.coalesce(F.when(F.trim(given) != "", F.lower(F.trim(given))), own)


def approved(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*S.SETTINGS.approval_statuses)


def redact(fields: Column, names: list[str]) -> Column:
    """Values of the named keys, in any case, become ``[REDACTED]``."""
    low = [n.lower() for n in names]
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*low), "[REDACTED]").otherwise(v))


def redacted_names(fields: Column, names: list[str]) -> Column:
    low = [n.lower() for n in names]
    return F.array_sort(F.array_distinct(F.filter(F.map_keys(fields), lambda k: F.lower(k).isin(*low))))


def to_do(requests: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Requests without a successful receipt: replays drop out, failures are tried again."""
    return requests.join(receipts.filter("status = 'success'").select(key).distinct(), key, "left_anti")


def attempts(retry_max: Column, backoff: float) -> Column:
    """One struct an attempt with the pause after it."""
    return F.transform(F.sequence(F.lit(1), retry_max + 1), lambda n: F.struct(n.alias("attempt"), F.when(n <= retry_max, backoff * F.pow(F.lit(2.0), n - 1)).otherwise(0.0).alias("pause")))


def roll_up(statuses: Column) -> Column:
    good = lambda s: s == "success"
    return F.when(F.size(statuses) == 0, "failed").when(F.forall(statuses, good), "success").when(F.exists(statuses, good), "partial_success").otherwise("failed")


def webhook_reason(url: Column, allowed: list[str], enabled: bool = True) -> Column:
    """Why a per-request URL is refused; null if it may be called."""
    host, scheme = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(F.lit(not enabled), "disabled").when(host.isNull() | ~F.coalesce(scheme, F.lit("")).isin("http", "https"), "not_absolute").when(~host.isin(*allowed), "host_not_allowed")


def contract_errors(df: DataFrame) -> Column:
    """Errors of a pipeline result row: stages that are missing, an unknown final status, a delivered document without the invoice fields, a pending one without a review task."""
    stages = ("ocr", "layout", "classification", "extraction", "validation")
    bad = [F.when(F.col(f"{s}_key").isNull() | (F.trim(f"{s}_key") == ""), F.lit(f"missing_stage:{s}")) for s in stages]
    known = F.col("final_status").isin("delivered", "pending_human_review", "failed")
    need = [F.when((F.col("final_status") == "delivered") & (F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")) == ""), F.lit(f"delivered_without:{f}")) for f in S.RULESETS["invoice"][0]]
    return F.array_compact(F.array(*bad, F.when(~F.coalesce(known, F.lit(False)), "unknown_status"), *need, F.when((F.col("final_status") == "pending_human_review") & F.col("review_task_id").isNull(), "missing_review_task")))
