"""Rule validation of extracted fields: seven rules in a fixed order, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions.rounding import fixed_column
from folioflow.functions.text import collapsed_value, route_name


def infer_route(fields: Column, explicit: Column) -> Column:
    """The explicit route if it is known and not generic, else the first route one of whose tell-tale fields is filled."""
    named = route_name(explicit)
    filled = F.map_keys(F.map_filter(fields, lambda k, v: F.coalesce(v, F.lit("")) != ""))
    guess = F.coalesce(*(F.when(F.arrays_overlap(filled, F.array(*map(F.lit, hints))), F.lit(r)) for r, hints in S.HINTS.items()), F.lit("generic"))
    return F.when(named != "generic", named).otherwise(guess)


def _list(route: Column, part: int) -> Column:
    """The rule set's list for the route, as a literal array chosen by ``when``."""
    out = None
    for r, rules in S.RULESETS.items():
        names = F.array(*map(F.lit, rules[part])) if rules[part] else F.array().cast("array<string>")
        out = F.when(route == r, names) if out is None else out.when(route == r, names)
    return out


def _value(fields: Column, name: Column) -> Column:
    """A field of the cleaned map; empty if absent."""
    return F.coalesce(F.try_element_at(fields, name), F.lit(""))


def validate(df: DataFrame) -> DataFrame:
    """Adds verdict, requires_human_review, reasons, warnings, resolved_route and rule_results.

    df has fields, confidence, field_confidences, used_vlm_fallback, route.
    """
    s = S.SETTINGS
    t = df.withColumn("_f", F.transform_values("fields", lambda k, v: F.coalesce(collapsed_value(v), F.lit(""))))
    t = t.withColumn("resolved_route", infer_route(F.col("_f"), F.col("route")))
    route, f, conf = F.col("resolved_route"), F.col("_f"), F.col("confidence")
    t = t.withColumn("_required", _list(route, 0)).withColumn("_wanted", _list(route, 1)).withColumn("_dates", _list(route, 2)).withColumn("_money", _list(route, 3))
    t = t.withColumn("_no_req", F.filter("_required", lambda x: _value(f, x) == ""))
    t = t.withColumn("_no_rec", F.filter("_wanted", lambda x: _value(f, x) == ""))
    t = t.withColumn("_bad_date", F.filter("_dates", lambda x: (_value(f, x) != "") & ~_value(f, x).rlike(S.DATE_SHAPE)))
    t = t.withColumn("_bad_money", F.filter("_money", lambda x: (_value(f, x) != "") & ~_value(f, x).rlike(S.MONEY_SHAPE)))

    def confidence_of(name: Column) -> Column:
        return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_element_at("field_confidences", name))), conf)

    t = t.withColumn("_low", F.filter("_required", lambda x: (_value(f, x) != "") & (confidence_of(x) < s.min_field_confidence)))
    policy = F.col("used_vlm_fallback") & (route != "generic")
    empty = F.size(F.map_filter(f, lambda k, v: v != "")) == 0
    reject = empty | ((conf < s.auto_reject) & (F.size("_no_req") > 0))

    def named(label: str, names: str) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(label + ":"), F.array_join(names, ",")))

    t = t.withColumn("_reject", reject)
    t = t.withColumn("reasons", F.array_compact(F.array(
        named("missing_required_fields", "_no_req"), named("invalid_date_format", "_bad_date"), named("invalid_money_format", "_bad_money"), named("low_field_confidence", "_low"),
        F.when(conf < s.auto_approve, F.concat(F.lit("low_confidence:"), fixed_column(conf, 3))),
        F.when(policy, "llm_fallback_requires_review"), F.when(F.col("_reject"), "reject_unusable_extraction"))))
    t = t.withColumn("warnings", F.array_compact(F.array(named("missing_recommended_fields", "_no_rec"))))

    def result(rule: str, failed: Column, word: str = "failed", names: str | None = None) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.when(failed, word).otherwise("passed").alias("status"), (F.col(names) if names else F.array().cast("array<string>")).alias("failed_fields"))

    t = t.withColumn("rule_results", F.array(
        result("required_fields_present", F.size("_no_req") > 0, names="_no_req"), result("recommended_fields_present", F.size("_no_rec") > 0, "warning", "_no_rec"),
        result("date_format", F.size("_bad_date") > 0, names="_bad_date"), result("money_format", F.size("_bad_money") > 0, names="_bad_money"),
        result("required_field_confidence", F.size("_low") > 0, names="_low"), result("document_confidence", conf < s.auto_approve), result("llm_fallback_policy", policy)))
    t = t.withColumn("requires_human_review", F.size("reasons") > 0)
    t = t.withColumn("verdict", F.when(F.col("_reject"), "rejected").when(F.col("requires_human_review"), "needs_review").otherwise("auto_approved"))
    return t.drop("_f", "_required", "_wanted", "_dates", "_money", "_no_req", "_no_rec", "_bad_date", "_bad_money", "_low", "_reject")
