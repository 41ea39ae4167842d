"""Scalar text functions as column expressions; only the word error rate runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S

#: White space of any script, and the four separators that count as such.
SPACE = r"[\s\x1c-\x1f]"
EDGES = f"(?U)^{SPACE}+|{SPACE}+$"
#: What collapsing would change: anything but printable ASCII, two spaces, a space at an end.
UNEVEN = r"[^\x20-\x7e]|  |^ | $"


def sealed(df: DataFrame) -> DataFrame:
    """The same rows and columns behind a generator that Spark neither pushes filters through nor merges projections with.

    Only for a filter on an expensive computed column: without it the filter
    would repeat the column's whole expression below the projection. It also
    keeps Spark from leaving out columns, so the stages themselves do not use it.
    """
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def collapse(c: Column) -> Column:
    """Runs of white space of any script become one space; none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def collapsed_value(c: Column) -> Column:
    """As ``collapse``, for short values that are mostly even already; the argument should be a plain column or variable."""
    return F.when(c.rlike(UNEVEN), collapse(c)).otherwise(c)


def fold(c: Column) -> Column:
    return F.lower(collapse(c))


def route_name(c: Column) -> Column:
    """Slug of a route name; unknown and null give ``generic``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(slug.isin(*S.ROUTES), slug).otherwise(F.lit("generic"))


def number_or(c: Column, default: float = 0.0) -> Column:
    """Double of a text; null, unreadable, NaN and infinite give ``default``."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def first_text(*cols: Column) -> Column:
    """The first argument with anything but white space, else empty."""
    return F.coalesce(*(F.when(strip(c) != "", strip(c)) for c in cols), F.lit(""))


def csv_set(c: Column) -> Column:
    """Lower-cased, trimmed, distinct members of a comma list, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(strip(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def amount(c: Column) -> Column:
    """Canonical text of an amount with mixed separators: of two kinds the later is the decimal one; groups of three are thousands."""
    def even(t: Column) -> Column:
        comma, dot = F.locate(",", t) > 0, F.locate(".", t) > 0
        last_comma, last_dot = F.length(F.substring_index(t, ",", -1)), F.length(F.substring_index(t, ".", -1))
        return (
            F.when(comma & dot & (last_comma < last_dot), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(comma & (dot | (last_comma == 3)), F.replace(t, F.lit(","), F.lit("")))
            .when(comma, F.replace(t, F.lit(","), F.lit(".")))
            .when(dot & t.rlike(r"^[^.]*(\.[^.]{3})+$"), F.replace(t, F.lit("."), F.lit("")))
            .otherwise(t)
        )

    def shown(t: Column) -> Column:
        x = F.when(t.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))

        def text(v: Column) -> Column:
            whole = F.format_string("%.0f", v)
            part = F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
            return F.when(t == "", "").when(v.isNull(), t).when(v == F.floor(v), F.when(whole == "-0", "0").otherwise(whole)).otherwise(part)

        return let(x, text)

    digits = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9,.\-]", "")
    return let(digits, lambda t: let(even(t), shown))


def field_value(key: Column, value: Column) -> Column:
    money = key.isin(*S.AMOUNT_KEYS) | key.endswith("_amount") | key.endswith("_price")
    return F.when(money, amount(value)).otherwise(F.coalesce(fold(value), F.lit("")))


def file_name(c: Column) -> Column:
    """The last path part with unusual characters replaced; nothing left gives ``document.bin``."""
    base = F.element_at(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "document.bin").otherwise(clean)


def mime_of(content: Column) -> Column:
    """MIME type by magic bytes, null if unknown."""
    def starts(hexes: str) -> Column:
        return F.substring(content, 1, len(hexes) // 2) == F.unhex(F.lit(hexes))

    return (
        F.when(starts("255044462D"), "application/pdf")
        .when(starts("89504E470D0A1A0A"), "image/png")
        .when(starts("FFD8FF"), "image/jpeg")
        .when(starts("49492A00") | starts("4D4D002A"), "image/tiff")
        .when(starts("424D"), "image/bmp")
        .when(starts("52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250"))), "image/webp")
    )


def content_type(c: Column) -> Column:
    return F.lower(F.trim(F.substring_index(c, ";", 1)))


def error_code(detail: Column, status: Column) -> Column:
    """Slug of the detail, 80 characters at most, else a name for the HTTP status."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(detail, F.lit(""))), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    names = {400: "bad_request", 500: "internal_server_error", 401: "unauthorized", 403: "forbidden", 404: "not_found", 409: "conflict", 413: "payload_too_large", 415: "unsupported_media_type", 422: "validation_error", 429: "rate_limited", 503: "service_unavailable"}
    by = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.when(slug != "", F.left(slug, F.lit(80))).otherwise(F.coalesce(F.try_element_at(by, status), F.lit("request_failed")))


def odd_at_least(c: Column, least: int) -> Column:
    v = F.greatest(c, F.lit(least))
    return F.when(v % 2 == 0, v + 1).otherwise(v)


def folded_cer(e: Column, p: Column) -> Column:
    """Character error rate of folded texts; null without a reference. The arguments should be plain columns."""
    return F.when(e != "", F.round(F.levenshtein(e, p) / F.length(e), 6))


def cer(expected: Column, predicted: Column) -> Column:
    """Character error rate of texts as they are; ``error_rates`` is faster over a table."""
    pair = F.struct(F.coalesce(fold(expected), F.lit("")).alias("e"), F.coalesce(fold(predicted), F.lit("")).alias("p"))
    return let(pair, lambda x: folded_cer(x["e"], x["p"]))


def error_rates(df: DataFrame, expected: str, predicted: str, words: bool = True) -> DataFrame:
    """Adds cer and, with ``words``, wer. The texts are folded in a projection of their own, so that each is folded once."""
    t = df.withColumn("_e", F.coalesce(fold(F.col(expected)), F.lit(""))).withColumn("_p", F.coalesce(fold(F.col(predicted)), F.lit("")))
    t = t.withColumn("cer", folded_cer(F.col("_e"), F.col("_p")))
    return (t.withColumn("wer", folded_wer(F.col("_e"), F.col("_p"))) if words else t).drop("_e", "_p")


def folded_wer(e: Column, p: Column) -> Column:
    """Word error rate of folded texts, of any length; null without a reference.

    The edit distance of two word lists, by bit vectors (Myers, 1999): the words
    of one text are the bits of whole numbers and every word of the other is a
    step of a few operations on them. Arrow batches of texts go to Python for it.
    """

    @F.pandas_udf("double")
    def rate(e: pd.Series, p: pd.Series) -> pd.Series:
        def distance(a: list[str], b: list[str]) -> int:
            begin = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            a, b = a[begin:], b[begin:]
            end = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
            a, b = a[: len(a) - end], b[: len(b) - end]
            if not a or not b:
                return max(len(a), len(b))
            places: dict[str, list[int]] = {}
            for k, w in enumerate(a):
                places.setdefault(w, []).append(k)
            at = {w: sum(1 << k for k in places.get(w, [])) for w in set(b)}
            full = (1 << len(a)) - 1
            more, less, far, last = full, 0, len(a), 1 << len(a) - 1
            for w in b:
                same = at.get(w, 0)
                across = (((same & more) + more) ^ more) | same
                up, down = less | full & ~(across | more), more & across
                far += 1 if up & last else -1 if down & last else 0
                up, down = (up << 1 | 1) & full, down << 1 & full
                more, less = down | full & ~(same | less | up), up & (same | less)
            return far

        def one(x: str | None, y: str | None) -> float | None:
            a, b = ([w for w in (t or "").split(" ") if w] for t in (x, y))
            return distance(a, b) / len(a) if a else None

        return pd.Series([one(x, y) for x, y in zip(e, p, strict=True)], dtype="float64")

    return F.round(F.nanvl(rate(e, p), F.lit(None).cast("double")), 6)


def wer(expected: Column, predicted: Column) -> Column:
    """Word error rate of texts as they are."""
    return folded_wer(F.coalesce(fold(expected), F.lit("")), F.coalesce(fold(predicted), F.lit("")))
