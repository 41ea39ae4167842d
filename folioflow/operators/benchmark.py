"""Benchmark samples and their scores: ground truth of two dataset shapes, sample metrics, thresholds, run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import contracts as C
from folioflow.operators import quality as Q


# -- receipts with line-by-line truth ---------------------------------------------------
def first_price(truth: Column, *paths: str) -> Column:
    """The first of several fields that says anything; null if none does."""
    return F.nullif(X.first_text(*(F.try_variant_get(truth, f"$.{p}", "string") for p in paths)), F.lit(""))


def receipt_fields(truth: Column) -> Column:
    """Expected fields of a parsed receipt as a map; absent ones are left out, and a count of no items too."""
    menu = F.try_variant_get(truth, "$.menu", "array<variant>")
    one = F.when(C.kind(C.part(truth, "menu")) == "object", 1).otherwise(0)
    items = F.coalesce(F.size(F.filter(menu, lambda m: C.kind(m) == "object")), one)
    named = {
        "total_amount": first_price(truth, "total.total_price", "total.total", "total_price"), "tax_amount": first_price(truth, "sub_total.tax_price", "sub_total.tax"),
        "subtotal_amount": first_price(truth, "sub_total.subtotal_price", "sub_total.subtotal"), "cash_amount": first_price(truth, "total.cashprice", "total.cash_price"),
        "change_amount": first_price(truth, "total.changeprice", "total.change_price"), "line_item_count": F.when(items > 0, items.cast("string")),
    }
    return F.map_filter(F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())


def receipt_text(truth: Column) -> Column:
    """The words of all lines, a line a row; lines without words are left out."""
    lines = F.try_variant_get(truth, "$.valid_line", "array<struct<words:array<struct<text:string>>>>")
    joined = F.transform(lines, lambda line: F.array_join(F.filter(F.transform(line["words"], lambda w: X.strip(F.coalesce(w["text"], F.lit("")))), lambda t: t != ""), " "))
    return F.coalesce(F.array_join(F.filter(joined, lambda t: t != ""), "\n"), F.lit(""))


def receipts(rows: DataFrame, split: str = "validation", offset: int = 0, limit: int = 10, seed: int | None = None) -> DataFrame:
    """Samples of a receipt data set. rows: position, id, ground_truth (JSON). A row without an id is named by its place."""
    order = F.col("position") if seed is None else F.xxhash64(F.lit(seed), "position")
    some = rows.orderBy(order).offset(max(0, offset)).limit(max(1, limit))
    # at most ``limit`` rows are numbered
    t = some.withColumn("_k", F.row_number().over(Window.orderBy(order)) - 1).withColumn("_t", F.try_parse_json("ground_truth"))
    parse = C.part(F.col("_t"), "gt_parse")
    name = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit(f"{split}-"), (F.col("_k") + offset).cast("string")))
    error = F.when(C.kind(parse) != "object", F.lit("ground_truth is missing gt_parse object"))
    return t.select(name.alias("sample_id"), F.lit("receipt").alias("expected_route"), receipt_fields(parse).alias("expected_fields"), receipt_text(F.col("_t")).alias("expected_text"), error.alias("error"))


# -- sample metrics -----------------------------------------------------------------------
def sample_metrics(df: DataFrame) -> DataFrame:
    """One row of scores a sample. df: expected_route, expected_fields, expected_text, expected_verdict, answer (a variant, the result response), runtime_status, latency, errors (a list)."""
    # an answer is looked into once a row, in one struct
    t = df.withColumn("_g", X.let(C.part(F.col("answer"), "result"), _answered))
    t = t.withColumn("c", Q.compare_fields(F.col("expected_fields"), F.coalesce("_g.fields", F.create_map().cast("map<string,string>"))))
    t = Q.scores(t)
    t = X.error_rates(t.withColumn("_read", F.col("_g.read")), "expected_text", "_read")
    verdict, review, route = F.col("_g.verdict"), F.col("_g.review"), F.col("_g.route")
    expected = X.strip(F.coalesce("expected_verdict", F.lit("")))
    right = F.when(expected != "", verdict == expected).otherwise(review == (F.col("field_f1") < 1.0))
    return t.select(
        *df.columns, "c", "field_precision", "field_recall", "field_f1", F.coalesce("_g.status", "runtime_status").alias("final_status"),
        route.alias("predicted_route"), (route == F.col("expected_route")).alias("route_match"), F.coalesce("_g.ocr", F.lit(0.0)).alias("ocr_confidence"),
        F.coalesce("_g.extraction", F.lit(0.0)).alias("extraction_confidence"), F.col("cer").alias("ocr_cer"), F.col("wer").alias("ocr_wer"),
        review.alias("requires_review"), F.when(expected != "", "explicit_verdict").otherwise("field_correctness").alias("expectation"), right.alias("validation_correct"), (F.size("errors") == 0).alias("contract_passed"),
    )


def _answered(result: Column) -> Column:
    """What the scores read of a result: status, route, fields, read, verdict, review and the two confidences."""

    def of(got: Column) -> Column:
        route = F.coalesce(*(F.nullif(C.text(got[s], "route"), F.lit("")) for s in ("extraction", "validation", "classification")), F.lit("unknown"))
        fields = X.let(C.part(got["extraction"], "fields"), lambda v: F.when(C.kind(v) == "object", F.try_variant_get(v, "$", "map<string,string>")))
        return F.struct(
            F.nullif(got["status"], F.lit("")).alias("status"), route.alias("route"), fields.alias("fields"), F.coalesce(C.text(got["ocr"], "full_text"), F.lit("")).alias("read"),
            F.coalesce(F.nullif(C.text(got["validation"], "verdict"), F.lit("")), F.lit("unknown")).alias("verdict"), truthy(C.part(got["validation"], "requires_human_review")).alias("review"),
            C.number(got["ocr"], "mean_confidence").alias("ocr"), C.number(got["extraction"], "confidence").alias("extraction"),
        )

    return X.let(F.struct(C.text(result, "status").alias("status"), *(C.part(result, s).alias(s) for s in ("extraction", "validation", "classification", "ocr"))), of)


def truthy(v: Column) -> Column:
    """What counts as yes: true, a number that is not 0, any text or list that is not empty."""

    def of(x: Column) -> Column:
        k, t = x["k"], x["t"]
        return F.coalesce(F.when(k == "boolean", t == "true").when(k == "number", F.try_variant_get(x["v"], "$", "double") != 0).when(k == "string", t != "").when(k.isin("object", "array"), ~t.isin("{}", "[]")), F.lit(False))

    return X.let(v, lambda v: X.let(F.struct(v.alias("v"), C.kind(v).alias("k"), F.try_variant_get(v, "$", "string").alias("t")), of))


# -- thresholds ---------------------------------------------------------------------------
def thresholds(rows: DataFrame) -> DataFrame:
    """What holds for each threshold: the given value before the file's. rows: name, given, from_file (texts); further columns are kept. Rates lie in 0..1, other limits are not negative, the number of samples is whole and at least 1; 0 samples count as none asked for."""
    t = rows.withColumn("value", F.coalesce(F.col("given").try_cast("double"), F.col("from_file").try_cast("double")))
    rate = F.col("name").rlike("rate|accuracy|f1")
    error = (
        F.when(F.col("from_file").isNotNull() & F.col("from_file").try_cast("double").isNull(), F.concat(F.lit("threshold "), "name", F.lit(" must be numeric")))
        .when(rate & ~F.col("value").between(0, 1), F.concat("name", F.lit(" must be between 0 and 1"))).when(F.col("value") < 0, F.concat("name", F.lit(" must be zero or greater")))
    )
    whole = F.when(F.col("name") == "min_sample_count", F.greatest(F.lit(1.0), F.floor("value").cast("double"))).otherwise(F.col("value"))
    kept = [c for c in rows.columns if c not in ("given", "from_file")]
    return t.select(*kept, F.when(error.isNull(), whole).alias("value"), error.alias("error"))


def custom_metrics(aggregates: DataFrame, without: tuple[str, ...] = ("sample_count", "completed_count")) -> DataFrame:
    """The numbers of an aggregate row as (metric, value), for an evaluation record; what is missing is left out."""
    names = [f.name for f in aggregates.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name not in without]
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return aggregates.select(F.inline(rows)).filter("value IS NOT NULL")


def outcomes(samples: DataFrame, dry_run: bool = False) -> DataFrame:
    """Samples in order as metrics or as errors. samples: index, error, status, latency; a dry run submits nothing, so nothing is known."""
    known = lambda c: F.lit(None).cast(samples.schema[c].dataType) if dry_run else F.col(c)
    return samples.select("index", F.when(F.col("error").isNotNull(), "error").otherwise("metrics").alias("kind"), F.left("error", F.lit(500)).alias("error"), (F.lit("DRY_RUN") if dry_run else F.col("status")).alias("status"), known("latency").alias("latency"))
