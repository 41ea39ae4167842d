"""Route classification: weighted patterns over folded text, all in one projection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions.rounding import rounded_column
from folioflow.functions.text import fold, let


PATTERNS = [p for *_, patterns in S.ROUTE_RULES for p, _ in patterns]


def core(pattern: str) -> str:
    """The longest run of letters that any match of the pattern holds."""
    bare = re.sub(r"\(\?:[^)]*\)|\\[a-z][*+?]?|[a-z]\?", " ", pattern)
    return max(re.findall(r"[a-z]+", bare), key=len)


def words_of(text: Column) -> Column:
    """The words of folded text with one space around each."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def signals_of(text: Column, words: Column) -> Column:
    """One bit for each pattern of ``PATTERNS`` that the text matches. words: as ``words_of`` gives them.

    A pattern that is one whole word is looked up among the words; any other is
    tried as an expression where its core occurs.
    """

    def matched(pattern: str) -> Column:
        if re.fullmatch(r"\\b[a-z]+\\b", pattern):
            return F.contains(words, F.lit(f" {core(pattern)} "))
        return F.contains(text, F.lit(core(pattern))) & text.rlike(pattern)

    bits = (F.when(matched(p), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, p in enumerate(PATTERNS))
    return reduce(lambda a, b: a + b, bits)


def signals(text: Column) -> Column:
    """As ``signals_of``, of folded text alone. In a lambda, as all patterns in one method are too long for the JVM to compile."""
    return let(words_of(text), lambda words: signals_of(text, words))


def shares(patterns) -> list[float]:
    """What the matches of a route's patterns give, by their bits: 0.20 and the sum of the weights, 0.85 of it at most, added in order."""
    out = []
    for bits in range(1 << len(patterns)):
        score = 0.0
        for j, (_, w) in enumerate(patterns):
            score += w if bits >> j & 1 else 0.0
        out.append(0.20 + min(score, 0.85))
    return out


def scored(df: DataFrame, marks: str, ocr_confidence: str) -> DataFrame:
    """Adds column _c, an array of one struct a route: confidence, signals, order, names and threshold; null where the marks are. marks: a column as ``signals_of`` gives it.

    Sums of weights are looked up. The confidences are rounded in a lambda: all five
    of them written out are a method that is too long for the JVM to compile.
    """
    base = F.least(F.col(ocr_confidence), F.lit(1.0)) * 0.12
    raw, rest, first = [], [], 0
    for k, (route, profile, mode, threshold, patterns) in enumerate(S.ROUTE_RULES):
        own = F.shiftright(F.col(marks), first).bitwiseAND(F.lit((1 << len(patterns)) - 1)).cast("int")
        raw.append(F.least(F.lit(0.99), F.get(F.array(*map(F.lit, shares(patterns))), own) + base))
        rest.append((F.bit_count(own).cast("int").alias("signals"), F.lit(-k).alias("turn"), F.lit(route).alias("route"), F.lit(profile).alias("profile"), F.lit(mode).alias("mode"), F.lit(threshold).alias("threshold")))
        first += len(patterns)
    t = df.withColumn("_r", F.transform(F.array(*raw), lambda x: rounded_column(x, 4)))
    made = F.array(*(F.struct(F.get("_r", F.lit(k)).alias("confidence"), *more) for k, more in enumerate(rest)))
    return t.withColumn("_c", F.when(F.col(marks).isNotNull(), made)).drop("_r")


def scores(df: DataFrame) -> DataFrame:
    """One row per document and route. df: job_id, text, ocr_confidence."""
    folded = df.select("job_id", fold(F.col("text")).alias("_t"), "ocr_confidence")
    marked = folded.select("job_id", signals(F.col("_t")).alias("_s"), "ocr_confidence")
    # no text has null marks; the outer form keeps Spark from deriving a filter that would repeat the whole expression below
    c = scored(marked, "_s", "ocr_confidence").select("job_id", F.explode_outer("_c").alias("c"))
    return c.select("job_id", "c.route", "c.confidence", "c.signals", "c.threshold")


def classify(df: DataFrame) -> DataFrame:
    """Adds route, strategy_profile, extraction_mode, classification_confidence, matched_signal_count, confidence_band, auto_route, requires_review and reason.

    df has text, ocr_confidence and fallback_used. Too little text, or text of a
    failed reading, is generic without any pattern being tried; a best route
    below its threshold is generic with 0.50. Ties go to more signals, then to
    the earlier route.
    """
    s = S.SETTINGS
    t = df.withColumn("_t", F.coalesce(fold(F.col("text")), F.lit("")))
    guarded = (F.length("_t") < s.min_text_chars) | F.coalesce("fallback_used", F.lit(False))
    t = t.withColumn("_s", F.when(~guarded, signals(F.col("_t"))))
    t = scored(t, "_s", "ocr_confidence").withColumn("_best", F.array_max("_c"))
    good = F.col("_best").isNotNull() & (F.col("_best.confidence") >= F.col("_best.threshold"))
    confidence = F.when(F.col("fallback_used"), 0.35).when(F.col("_best").isNull(), 0.45).when(good, F.col("_best.confidence")).otherwise(0.50)
    route, profile, mode = S.GENERIC
    t = t.select(
        *df.columns,
        F.when(good, F.col("_best.route")).otherwise(route).alias("route"),
        F.when(good, F.col("_best.profile")).otherwise(profile).alias("strategy_profile"),
        F.when(good, F.col("_best.mode")).otherwise(mode).alias("extraction_mode"),
        confidence.alias("classification_confidence"),
        F.when(good, F.col("_best.signals")).otherwise(0).alias("matched_signal_count"),
        F.when(F.col("fallback_used"), "ocr_fallback").when(F.col("_best").isNull(), "insufficient_text").when(good, "matched_rules").otherwise("no_route_threshold_met").alias("reason"),
    )
    c = F.col("classification_confidence")
    t = t.withColumn("confidence_band", F.when(c >= 0.85, "high").when(c >= s.auto_route, "medium").otherwise("low"))
    t = t.withColumn("auto_route", (c >= s.auto_route) & (F.col("route") != "generic"))
    return t.withColumn("requires_review", ~F.col("auto_route"))
