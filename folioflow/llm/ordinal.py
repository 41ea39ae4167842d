"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), with one weight for each hashed
text slot shared by all grades and ordered thresholds. Weights are at most 0:
text can only speak against a document, so one of unknown or few words scores
0 and counts as good. The model is fitted on a
bounded sample of rated rows (``fit_rows``, a parameter); all rows are scored.

Grades: 0 toxic, 1 poor, 2 good.

Defined cases: null and empty texts have score 0 and are scored like any
other; rated rows without a matching text, or with a null rating, are left out
of the fit; an id that is rated or listed several times counts once, with its
worst grade and its smallest text; repeated rows are all scored; with no rated rows at all every grade
is as likely as any other and nothing is rejected; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import features, storage
from folioflow.llm import tokens as T

GRADES = 3
FIT_ROWS = 10_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each threshold k, (rows, thresholds)."""
        return sigmoid(self.thresholds[None, :] - score[:, None])

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        low = self.below(score)
        return np.diff(np.concatenate([np.zeros((len(score), 1)), low, np.ones((len(score), 1))], 1))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return (1 - self.below(score)).sum(1)


def fit_rows(row: np.ndarray, slot: np.ndarray, val: np.ndarray, grade: np.ndarray, grades: int = GRADES, steps: int = 400, rate: float = 0.1, ridge: float = 2e-5, lasso: float = 6.0) -> OrdinalModel:
    """Maximum likelihood with a ridge; thresholds stay ordered because their gaps are exponentials.

    ``lasso`` is the weight of evidence, in rows, that a slot must bring; slots
    that no more rows below the best grade hold are left out.
    """
    if not len(grade):
        return OrdinalModel(np.zeros(features.SLOTS, np.float32), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    n = len(grade)
    against = np.bincount(slot[grade[row] < grades - 1], minlength=features.SLOTS)
    use = against[slot] > lasso
    row, slot, val = row[use], slot[use], val[use]
    used, col = np.unique(slot, return_inverse=True)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades)) / n, 1e-3, 1 - 1e-3)[:-1]
    cut = np.log(share / (1 - share))
    gaps = np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 0.05))])
    w = np.zeros(len(used))

    def thresholds(g: np.ndarray) -> np.ndarray:
        return np.concatenate([[g[0]], g[0] + np.cumsum(np.exp(g[1:]))])

    def gradient(params: list[np.ndarray]) -> list[np.ndarray]:
        w, g = params
        theta = thresholds(g)
        score = np.bincount(row, val * w[col], n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(edge[grade + 1] - score), sigmoid(edge[grade] - score)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dscore = (dhi - dlo) / p / n  # of the negative log-likelihood
        dw = np.bincount(col, val * dscore[row], len(used)) + ridge * w - lasso / n
        dtheta = np.zeros(grades - 1)
        for k in range(grades - 1):
            dtheta[k] = (-(dhi / p)[grade == k].sum() + (dlo / p)[grade == k + 1].sum()) / n
        tail = np.cumsum(dtheta[::-1])[::-1]
        return [dw, np.concatenate([[tail[0]], tail[1:] * np.exp(g[1:])])]

    params = [w, gaps]
    features.adam(params, gradient, steps, rate, lambda p: np.minimum(p[0], 0, out=p[0]))
    out = np.zeros(features.SLOTS, np.float32)
    out[used] = params[0]
    return OrdinalModel(out, thresholds(params[1]))


def grade_of(quality, toxic):
    """Grade column of the ratings ``quality`` and ``toxic``; null where quality is."""
    return F.when(F.coalesce(toxic, F.lit(0)) > 0, 0).when(quality.isNull(), None).when(quality > 0, 2).otherwise(1)


def fit(docs: DataFrame, labels: DataFrame, fit_rows_bound: int = FIT_ROWS, tokenizer: str | None = None) -> OrdinalModel:
    """docs: doc_id, text; labels: doc_id, quality, toxic."""
    rated = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade IS NOT NULL")
    chosen = features.bounded_sample(rated, "doc_id", fit_rows_bound)
    # an id that several texts share counts once, with the smallest of them
    sample = docs.select("doc_id", "text").filter("text IS NOT NULL").join(chosen, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    return fit_rows(*features.training_rows(sample, "grade", tokenizer or T.default_path()))


def score(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, expected_grade, tail_prob = P(the best grade), and kept: tail_prob >= ``least_tail``."""
    path = tokenizer or T.default_path()
    storage.on_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one weight a slot
    src = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or features.LinearScores(sent.value.weights, path)
            for part in T.slices(batch):
                s = scorer(part.column("text"))[0][:, 0]
                tail = 1 - sent.value.below(s)[:, -1]
                yield pa.record_batch([part.column("doc_id"), pa.array(sent.value.expected(s)), pa.array(tail), pa.array(tail >= least_tail)], ["doc_id", "expected_grade", "tail_prob", "kept"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_prob double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels), **options)


def keep_good(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5, tokenizer: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns, in one pass without a join."""
    path = tokenizer or T.default_path()
    return storage.plainly(docs, lambda plain: _kept(plain, fit(docs, labels, tokenizer=path), least_tail, path))


def _kept(docs: DataFrame, model: OrdinalModel, least_tail: float, path: str) -> DataFrame:
    storage.on_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or features.LinearScores(sent.value.weights, path)
            for part in T.slices(batch):
                s = scorer(part.column("text"))[0][:, 0]
                yield part.filter(pa.array(1 - sent.value.below(s)[:, -1] >= least_tail))

    return docs.mapInArrow(run, docs.schema)


def load_labels(spark, sf_dir: str) -> DataFrame:
    return storage.read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
