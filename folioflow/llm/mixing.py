"""Mixing sources to target weights by soft domain membership.

A softmax classifier, fitted on a bounded sample of labelled rows, gives every
document a posterior over domains. Document rates r >= 0 are then fitted by
projected gradient on the least squares of (expected domain token totals -
targets): a document of t tokens and posterior p adds r*t*p to the totals.
Steps are taken in the norm that weighs documents by their tokens, so rates do
not depend on a document's length, and each domain's step is scaled by its own
curvature. Posteriors are whole multiples of 1/1024 that add up to 1; documents of
one posterior have one rate, so their tokens are summed up once and every step is
an aggregation of that much shorter table. Only one number a domain returns to
the driver, and a rate is recomputed from the list of steps, so no state is
carried between iterations. Steps end when the totals are met or come no nearer;
a miss that stays (a target out of reach) is warned of and in ``fit_rates``'s result.

Defined cases: null and empty texts have no tokens and the rate that their
posterior gives; repeated rows each get their rate; a domain without tokens
cannot be reached and keeps its residual; an empty table gives an empty result;
further columns are kept by ``resample`` and ignored by ``rates``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from folioflow.llm import features, storage
from folioflow.llm import tokens as T

FIT_ROWS = 8_000
#: Shares of the token totals wanted of each domain.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def fit_softmax(row: np.ndarray, slot: np.ndarray, val: np.ndarray, label: np.ndarray, classes: int, steps: int = 60, rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Slot weights (slots, classes) and one bias a class."""
    out = np.zeros((features.SLOTS, classes), np.float32)
    if not len(label):
        return out, np.zeros(classes)
    n = len(label)
    used, col = np.unique(slot, return_inverse=True)
    goal = np.eye(classes)[label]

    def gradient(params: list[np.ndarray]) -> list[np.ndarray]:
        w, b = params
        z = np.stack([np.bincount(row, val * w[col, k], n) for k in range(classes)], 1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - goal) / n
        return [np.stack([np.bincount(col, val * d[row, k], len(used)) for k in range(classes)], 1) + ridge * w, d.sum(0)]

    params = [np.zeros((len(used), classes)), np.log(np.bincount(label, minlength=classes) / n + 1e-6)]
    features.adam(params, gradient, steps, rate)
    out[used] = params[0]
    return out, params[1]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS, tokenizer: str | None = None, unit: str = "ids", with_columns: bool = False) -> DataFrame:
    """docs: doc_id, text; labelled: doc_id, text, domain. Per row: doc_id (all columns of ``docs`` if ``with_columns``), then the columns that ``own_names`` names: the tokens and the posteriors in the order of ``domains``.

    unit: "words" (separated by white space) or "ids" (of the tokenizer).
    """
    storage.on_workers(docs.sparkSession)
    path = tokenizer or T.default_path()
    number = F.create_map(*(x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k))))
    known = labelled.filter("text IS NOT NULL").select("doc_id", "text", F.try_element_at(number, F.col("domain")).alias("label")).filter("label IS NOT NULL")
    model = fit_softmax(*features.training_rows(features.bounded_sample(known, "doc_id", fit_rows), "label", path), len(domains))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one weight a slot and domain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or features.LinearScores(sent.value[0], path)
            for part in T.slices(batch):
                z, n = scorer(part.column("text"), unit == "ids")
                z = z + sent.value[1]
                p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
                p = on_grid(p / p.sum(1, keepdims=True))
                cols = [pa.array(n), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))]
                yield pa.record_batch([*(part.column(c) for c in kept), *cols], [*kept, *made])

    kept = docs.columns if with_columns else ["doc_id"]
    made = own_names(kept, len(domains))
    src = docs if with_columns else docs.select("doc_id", "text")
    schema = StructType([*src.select(*map(storage.quoted, kept)).schema.fields, StructField(made[0], LongType()), *(StructField(c, DoubleType()) for c in made[1:])])
    return src.mapInArrow(run, schema)


def own_names(columns: list[str], domains: int) -> list[str]:
    """Names beside ``columns`` for the tokens and one posterior a domain."""
    return storage.unused(columns, "_tokens", *(f"_p_{k}" for k in range(domains)))


GRID = 1024


def on_grid(p: np.ndarray) -> np.ndarray:
    """Rows of probabilities as multiples of 1/GRID that add up to 1: rounded down, the rest to the largest remainders."""
    low = np.floor(p * GRID)
    rest = np.rint(GRID - low.sum(1)).astype(np.int64)
    rank = np.argsort(np.argsort(low - p * GRID, 1, kind="stable"), 1)
    return (low + (rank < rest[:, None])) / GRID


def rate_column(steps: list[np.ndarray], names: list[str]) -> Column:
    """The rate after the given steps, each a number for every domain, from rate 1; names: the posteriors' columns."""
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(F.lit(0.0), r - sum(F.lit(float(x)) * F.col(c) for c, x in zip(names, g, strict=True)))
    return r


def fit_rates(table: DataFrame, names: list[str], targets: list[float], most_steps: int = 100, close: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps, the totals that they give and the wanted totals. names: as ``own_names`` gives them. The total of all tokens is kept."""
    tokens, *p = names
    cells = storage.settle(table.groupBy(*p).agg(F.sum(tokens).alias(tokens)), "mixing-cells")
    k = range(len(targets))
    first = cells.agg(*(F.sum(F.col(tokens) * F.col(p[i])) for i in k), *(F.sum(F.col(tokens) * F.col(p[i]) * F.col(p[j])) for i in k for j in k)).first()
    totals = np.array([x or 0.0 for x in first[: len(targets)]])
    curve = np.array([x or 0.0 for x in first[len(targets) :]]).reshape(len(targets), -1)
    goal = np.array(targets) / max(sum(targets), 1e-300) * totals.sum()
    # a step of 1/(row sum) in each domain never overshoots
    scale = np.maximum(curve.sum(1), 1e-12)
    whole = max(goal.sum(), 1e-12)
    steps: list[np.ndarray] = []
    misses = [np.abs(totals - goal).max(initial=0) / whole]
    while misses[-1] > close and len(steps) < most_steps and not (len(misses) > 10 and misses[-1] > 0.99 * misses[-11]):
        steps.append(np.where(scale > 1e-9, (totals - goal) / scale, 0.0))
        r = rate_column(steps, p)
        totals = np.array([x or 0.0 for x in cells.agg(*(F.sum(F.col(tokens) * r * F.col(p[i])) for i in k)).first()])
        misses.append(np.abs(totals - goal).max(initial=0) / whole)
    if misses[-1] > max(close, 1e-3):
        warnings.warn(f"the mixture misses a target by {misses[-1]:.2%} of all tokens after {len(steps)} steps", stacklevel=2)
    storage.discard(table.sparkSession, cells)
    return steps, totals, goal


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """Per row: doc_id, tokens, the posterior of each domain (p_<domain>) and rate."""
    domains = list(targets)
    tokens, *p = names = own_names(["doc_id"], len(domains))
    table = storage.settle(posteriors(docs, labelled, domains, **options), "posteriors")
    steps, _, _ = fit_rates(table, names, list(targets.values()))
    return table.select("doc_id", F.col(tokens).alias("tokens"), *(F.col(c).alias(f"p_{d}") for c, d in zip(p, domains, strict=True)), rate_column(steps, p).alias("rate"))


def copies(rate: Column, *keys: Column, seed: int = 0) -> Column:
    """A whole number of copies whose mean over keys is the rate."""
    unit = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, by a draw of its id and text; rows that repeat both, with or without an id, have draws of their own. The texts are written once beside their posteriors and not shuffled, unless rows repeat."""
    return storage.plainly(docs, lambda plain: _drawn(plain, labelled, targets, options))


def _drawn(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], options: dict) -> DataFrame:
    names = own_names(docs.columns, len(targets))
    n, copy, row, of, text = storage.unused([*docs.columns, *names], "_n", "_copy", "_row", "_of", "_text")
    marked = posteriors(docs, labelled, list(targets), with_columns=True, **options).withColumn(row, F.monotonically_increasing_id())
    table = storage.settle(marked, "mixing")
    steps, _, _ = fit_rates(table, names, list(targets.values()))
    h = F.xxhash64("text")
    again = storage.settle(table.groupBy(F.col("doc_id").alias(of), h.alias(text)).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(of, text), "mixing-repeats")
    own = F.lit(0).cast("long")
    if not again.isEmpty():
        table = table.join(again, F.col("doc_id").eqNullSafe(F.col(of)) & (h == F.col(text)), "left")
        own = F.when(F.col(text).isNotNull(), F.col(row)).otherwise(own)
    drawn = table.withColumn(n, copies(rate_column(steps, names[1:]), F.col("doc_id"), h, own)).filter(F.col(n) > 0)
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*map(storage.quoted, docs.columns))


def labelled_by_lang(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the labels table lists, with their language as domain."""
    return docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", F.col("lang").alias("domain"))
