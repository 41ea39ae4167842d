"""Sum-of-squares online packing of token runs into fixed windows.

A document's ids are cut into whole windows and a rest. Each rest goes, as it
comes, to the fill level whose choice makes the sum of squared counts of
partly filled windows smallest: with N(h) windows filled to h, moving one from
h to h+r changes the sum by 2N(h+r) - 2N(h) + 2, opening one by 2N(r) + 1 and
closing one by 1 - 2N(h). The counts live in one level array, the windows of a
level in a stack. What is still partly filled at the end, and whenever more
than ``max_open`` windows are open, is made whole by cutting: pieces of the
emptiest windows fill the gaps of the fullest. So a task leaves one window at
most that is not full, and holds ``max_open`` windows at most.

Each task packs its own scan partition; nothing is shuffled. Window numbers
are the partition's number times 2^33 plus a counter.

Defined cases: null and empty text hold the end id alone; repeated rows are
packed each on its own; further columns are ignored; an empty table gives no
piece. A document longer than a window is cut at whole windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage
from folioflow.llm import tokens as T

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
NEVER = np.int64(2**62)


class Packer:
    """Packs runs of ids; finished windows gather in ``rows`` as tuples (doc, start, ids, doc_tokens, window, offset)."""

    def __init__(self, window: int = 2048, first_id: int = 0, max_open: int = 8192):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.level: list[list[list]] = [[] for _ in range(window)]
        self.open = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for at in range(0, n - w + 1, w):
            self._emit([(doc, at, ids[at : at + w], n)])
        if n % w:
            self._place((doc, n - n % w, ids[n - n % w :].copy(), n))

    def _place(self, piece: tuple) -> None:
        size, w = len(piece[2]), self.window
        if not size:
            return
        cost = np.full(w - size + 1, NEVER)
        here = self.count[1 : w - size + 1]
        can = here > 0
        cost[1:][can] = (2 * self.count[1 + size : w + 1] - 2 * here + 2)[can]
        cost[0] = 2 * self.count[size] + 1
        if self.count[w - size]:
            cost[w - size] = 1 - 2 * self.count[w - size]
        h = w - size - int(cost[::-1].argmin())  # among equals the fullest
        held = self.level[h].pop() if h else []
        if h:
            self.count[h] -= 1
            self.open -= 1
        held.append(piece)
        if h + size == w:
            self._emit(held)
            return
        self.level[h + size].append(held)
        self.count[h + size] += 1
        self.open += 1
        if self.open > self.max_open:
            self.settle()

    def settle(self) -> None:
        """Fill the fullest windows with pieces, cut where needed, of the emptiest."""
        held = [(h, x) for h in range(self.window - 1, 0, -1) for x in self.level[h]]
        self.level = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.open = 0
        i, j = 0, len(held) - 1
        fill, goal = held[0] if held else (0, [])
        while i < j:
            piece = held[j][1].pop()
            gap = self.window - fill
            if len(piece[2]) <= gap:
                goal.append(piece)
                fill += len(piece[2])
            else:
                goal.append((piece[0], piece[1], piece[2][:gap], piece[3]))
                held[j][1].append((piece[0], piece[1] + gap, piece[2][gap:], piece[3]))
                fill = self.window
            if not held[j][1]:
                j -= 1
            if fill == self.window:
                self._emit(goal)
                i += 1
                if i > j:
                    return
                goal = held[i][1]
                fill = sum(len(p[2]) for p in goal)
        if i == j and goal:
            fill = sum(len(p[2]) for p in goal)
            self.level[fill].append(goal)
            self.count[fill] += 1
            self.open = 1

    def finish(self) -> None:
        self.settle()
        for stack in self.level:
            while stack:
                self._emit(stack.pop())
        self.count[:] = 0
        self.open = 0

    def _emit(self, held: list) -> None:
        at = 0
        for doc, start, ids, n in held:
            self.rows.append((doc, start, ids, n, self.next_id, at))
            at += len(ids)
        self.next_id += 1


def pack(df: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False, max_open: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids."""
    storage.on_workers(df.sparkSession)
    path = tokenizer or T.default_path()
    src = df.select(F.col(storage.quoted(id_col)).alias("doc_id"), F.col(storage.quoted(text_col)).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = T.load(path)
        packer = Packer(window, TaskContext.get().partitionId() << 33, max_open)
        doc_type = None

        def take() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            doc, start, ids, n, seq, at = zip(*rows, strict=True) if rows else [()] * 6
            longs = [np.array(x, np.int64) for x in (start, [len(i) for i in ids], [zlib.crc32(i.tobytes()) for i in ids], n, seq, at)]
            cols = [pa.array(doc, doc_type), *map(pa.array, longs)]
            return pa.record_batch(cols + [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))] * with_ids, NAMES + ["ids"] * with_ids)

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for part in T.slices(batch):
                flat, counts = bpe.encode_texts(part.column("text"))
                ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                edge = np.concatenate([[0], np.cumsum(counts + 1)]).tolist()
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc, ids[edge[k] : edge[k + 1]])
                del flat
                yield take()
        packer.finish()
        if packer.rows:
            yield take()

    return src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:]) + ", ids array<int>" * with_ids)
