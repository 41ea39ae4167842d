"""Compression of vectors to short codes, by partial-distance search in integers.

Every component x becomes the integer floor(256 * x); a vector is cut into equal
parts, and every part is replaced by the number of the nearest entry of its
position's codebook. The codebooks start as the parts of the vectors of the
smallest ids and are moved to the floored means of what is assigned to them,
round after round.

Partial-distance search: the dimensions of a part are added up in order of
descending variance of the codebook. After each, the entry that leads is taken
to its complete distance, and a mask drops every entry whose distance so far
strictly exceeds the best complete one. So ties stay, and the lowest number
among equal distances wins.

A round is one pass over the vectors. A task sends its sums per entry, of which
there are no more than codebooks hold; only codebooks (``entries`` vectors)
ever reach the driver.

Defined cases: rows whose vector is null or holds null or non-finite numbers
are dropped. Shorter vectors count as if zeros followed up to the longest, whose
length is raised to a multiple of ``parts``; an empty vector is all zeros.
Integers are clamped so that no distance passes a long (``limit``: 2^27 for 64
dimensions). Rows without an id come after all others when codebooks start;
repeated rows and ids are rows of their own; fewer rows than ``entries`` make
smaller codebooks; a sum of errors beyond a long is null; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage

SCALE = 256.0
FAR = np.iinfo(np.int64).max
ROWS = 4096  #: vectors compared with a codebook at a time


def limit(dims: int) -> int:
    """The largest component: the squared distance of two vectors of such stays below 2^62."""
    return 1 << ((62 - max(dims - 1, 0).bit_length()) // 2 - 1)


@dataclass(frozen=True)
class Codebooks:
    """``books`` is (parts, entries, width) of integers."""

    books: np.ndarray

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def split(self, flat: np.ndarray) -> np.ndarray:
        """(n, dims) as (n, parts, width)."""
        return flat.reshape(-1, self.books.shape[0], self.books.shape[2])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x the number of the nearest entry, the lowest of equally near ones, and its squared distance."""
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    rows = np.arange(len(x))
    total = np.zeros((len(x), len(book)), np.int64)
    alive = np.ones(total.shape, bool)
    best = np.full(len(x), FAR)
    for k, d in enumerate(order.tolist()):
        if k:
            r, c = np.nonzero(alive)
            total[r, c] += (x[r, d] - book[c, d]) ** 2
        else:
            total += (x[:, d, None] - book[:, d]) ** 2
        lead = np.where(alive, total, FAR).argmin(1)
        best = np.minimum(best, ((x - book[lead]) ** 2).sum(1))
        alive &= total <= best[:, None]
    code = np.where(alive, total, FAR).argmin(1)
    return code, total[rows, code]


def dense(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` clamped integers, zeros behind shorter ones."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    most = limit(dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = np.clip(flat, -most, most)
    return out


def assigned(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, parts, codes, distances) for slices of a batch; the last three per row and part."""
    for lo in range(0, batch.num_rows, ROWS):
        x = books.split(dense(batch.column("v").slice(lo, ROWS), books.dims))
        got = [nearest(x[:, p], book) for p, book in enumerate(books.books)]
        yield lo, x, np.stack([c for c, _ in got], 1), np.stack([e for _, e in got], 1)


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows that can be coded, with integer components."""
    col = lambda c: F.col(storage.quoted(c))
    t = df.select(col(id_col).cast("long").alias("vec_id"), col(label_col).alias("label"), col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = F.lit(float(1 << 40))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, most), -most)).cast("long"))
    return t.filter(F.coalesce(sound, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def start(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors of the smallest ids; None where there is no row."""
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return None
    width = max(-(-dims // parts), 1)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    return Codebooks(np.ascontiguousarray(dense(first, parts * width).reshape(-1, parts, width).transpose(1, 0, 2)))


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floored mean of the parts assigned to it; entries without one stay."""
    parts, entries, width = books.books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, x, codes, _ in assigned(batch, books):
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], x[:, p])
        p, e = np.nonzero(n)
        at = np.repeat(p * entries + e, width)
        yield pa.record_batch([at, np.tile(np.arange(width), len(p)), np.repeat(n[p, e], width), total[p, e].ravel()], ["at", "pos", "n", "total"])

    got = rows.select("v").mapInArrow(sums, "at long, pos long, n long, total long").groupBy("at", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    at, pos, n, total = (got[c].to_numpy() for c in ("at", "pos", "n", "total"))
    new = books.books.copy()
    new[at // entries, at % entries, pos] = total // n
    return Codebooks(new)


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks over all of ``rows`` (as ``integers`` gives them)."""
    storage.on_workers(rows.sparkSession)
    books = start(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the entries' numbers, two hexadecimal digits a part (more where a codebook needs them), and the squared distance to what they stand for."""
    digits = max(2, len(f"{books.books.shape[1] - 1:x}"))
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{k:0{digits}x}" for k in range(books.books.shape[1])])
        for batch in batches:
            for lo, x, codes, error in assigned(batch, books):
                code = ["".join(r) for r in names[codes].tolist()]
                part = batch.slice(lo, len(x))
                yield pa.record_batch([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(codes: list[str], books: Codebooks) -> np.ndarray:
    """The vectors that codes stand for, as numbers of the scale of the source."""
    digits = max(2, len(f"{books.books.shape[1] - 1:x}"))
    at = np.array([[int(c[k : k + digits], 16) for k in range(0, len(c), digits)] for c in codes]).reshape(-1, books.books.shape[0])
    return books.books[np.arange(books.books.shape[0]), at].reshape(len(at), -1) / SCALE


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row that can be coded: vec_id, code, error, label_error (over the rows of its label, those without one together) and codebooks_sha256."""
    spark = df.sparkSession
    storage.on_workers(spark)
    rows = storage.settle(integers(df, id_col, vector_col, label_col), "vector-integers")
    books = fit(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = storage.settle(encode(rows, books), "vector-codes")
    storage.discard(spark, rows)
    of = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    met = coded.join(of, coded["label"].eqNullSafe(of["of_label"]))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
