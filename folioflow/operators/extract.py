"""Field extraction by the route's patterns; only the chosen route's branch is evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions.rounding import rounded_column
from folioflow.functions.text import collapse, route_name, strip

FLAGS = "(?im)"


def field(text: Column, rule) -> Column:
    if rule == "head":
        return collapse(F.left(text, F.lit(300)))
    if isinstance(rule, tuple):
        pattern, most = rule
        found = F.transform(F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(1)), collapse)
        return F.array_join(F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, most), "; ")
    return collapse(F.regexp_extract(text, FLAGS + rule, 1))


def fields_of(text: Column, route: str) -> Column:
    """Map of the route's fields; what is not found is empty."""
    return F.create_map(*(x for name in S.FIELDS[route] for x in (F.lit(name), field(text, S.PATTERNS[route][name]))))


#: Builders by route; a user may replace or add one.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {r: (lambda text, r=r: fields_of(text, r)) for r in S.ROUTES}


def extracted(text: Column, route: Column) -> Column:
    out = None
    for name, build in EXTRACTORS.items():
        if name != "generic":
            out = F.when(route == name, build(text)) if out is None else out.when(route == name, build(text))
    return out.otherwise(EXTRACTORS["generic"](text))


def chosen_text(ocr: Column, layout: Column) -> Column:
    """(text, layout_used): layout text if it is at least 20 characters and half as long as the OCR text."""
    layout, ocr = F.coalesce(layout, F.lit("")), F.coalesce(ocr, F.lit(""))
    used = (layout != "") & (F.length(layout) >= F.greatest(F.lit(20), F.floor(F.length(ocr) / 2)))
    return F.struct(F.when(used, layout).otherwise(ocr).alias("text"), used.alias("layout_used"))


def filled(fields: Column) -> Column:
    return F.size(F.map_filter(fields, lambda k, v: v != ""))


def fields_confidence(ocr: Column, fields: Column, layout_used: Column) -> Column:
    """Before it is rounded to four digits."""
    bonus = F.when(layout_used, 0.05).otherwise(0.0)
    share = filled(fields) / F.greatest(F.size(fields), F.lit(1))
    return F.least(F.lit(0.99), F.lit(0.60) * ocr + F.lit(0.35) * share + bonus)


def field_confidence(ocr: Column, layout_used: Column) -> Column:
    """That of a field with a value, before it is rounded to four digits."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ocr))
    bonus = F.when(layout_used, 0.05).otherwise(0.0)
    return F.least(F.lit(0.99), base * 0.75 + 0.20 + bonus)


def rounded_into(df: DataFrame, name: str, x: Column) -> DataFrame:
    """Adds or replaces a column by x with four digits. x is a column of its own first, so that it is computed once."""
    return df.withColumn("_x", x).withColumn(name, rounded_column(F.col("_x"), 4)).drop("_x")


def merge_model_fields(fields: Column, model: Column) -> Column:
    """Fills only the schema's empty fields from a model's answer."""
    return F.transform_values(fields, lambda k, v: F.when((v == "") & (F.coalesce(strip(F.try_element_at(model, k)), F.lit("")) != ""), collapse(F.try_element_at(model, k))).otherwise(v))


def missing(fields: Column) -> Column:
    return F.filter(F.map_keys(fields), lambda k: F.element_at(fields, k) == "")


def extract(df: DataFrame, layout_text: str | None = None, model_fields: str | None = None, model_confidence: str | None = None) -> DataFrame:
    """Adds fields, confidence, field_confidences, missing_fields, used_vlm_fallback, layout_text_used.

    df has text, route, ocr_confidence. ``model_fields`` names a map column with
    the answers of a model that ran beforehand; it is read only where confidence
    is low, the route generic or the text that of a failed reading.
    """
    s = S.SETTINGS
    picked = chosen_text(F.col("text"), F.col(layout_text)) if layout_text else F.struct(F.col("text"), F.lit(False).alias("layout_used"))
    t = df.withColumn("_picked", picked).withColumn("_route", route_name(F.col("route")))
    t = t.withColumn("fields", extracted(F.coalesce("_picked.text", F.lit("")), F.col("_route")))
    used = F.col("_picked.layout_used")
    t = rounded_into(t, "confidence", fields_confidence(F.col("ocr_confidence"), F.col("fields"), used))
    if model_fields:
        fallback = F.col("fallback_used") if "fallback_used" in df.columns else F.lit(False)
        ask = ((F.col("confidence") < s.vlm_fallback) | (F.col("_route") == "generic") | fallback) & (F.size(F.coalesce(F.col(model_fields), F.create_map().cast("map<string,string>"))) > 0)
        t = t.withColumn("used_vlm_fallback", ask)
        t = t.withColumn("fields", F.when(ask, merge_model_fields(F.col("fields"), F.col(model_fields))).otherwise(F.col("fields")))
        if model_confidence:
            t = rounded_into(t, "_raised", F.greatest("confidence", F.least(F.lit(1.0), F.col(model_confidence))))
            t = t.withColumn("confidence", F.when(F.col("used_vlm_fallback") & F.col(model_confidence).isNotNull(), F.col("_raised")).otherwise(F.col("confidence"))).drop("_raised")
    else:
        t = t.withColumn("used_vlm_fallback", F.lit(False))
    t = rounded_into(t, "_one", field_confidence(F.col("ocr_confidence"), used))
    t = t.withColumn("field_confidences", F.transform_values("fields", lambda k, v: F.when(v != "", F.col("_one")).otherwise(0.0)))
    t = t.withColumn("missing_fields", missing(F.col("fields")))
    if model_fields:  # without them nothing has changed since
        t = rounded_into(t, "_again", F.least("confidence", fields_confidence(F.col("ocr_confidence"), F.col("fields"), used)))
        t = t.withColumn("confidence", F.when(F.size("missing_fields") > 0, F.col("_again")).otherwise(F.col("confidence"))).drop("_again")
    t = t.drop("_one")
    return t.withColumn("layout_text_used", used).drop("_picked", "_route")
