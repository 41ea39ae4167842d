"""Token ids in plane-shuffled files.

File format, little endian: ``FFPLANE1``; then for each block of at most
``block`` ids its planes, each one zstandard frame; then the index, one
zstandard frame of int64 columns; then the index's length (8 bytes) and
``FFPLANE1`` again. In a block the ids are transposed, either byte by byte
(plane k holds byte k of every id) or bit by bit (plane k holds bit k of every
id, eight to a byte); planes above the block's largest id are left out. The
index holds each block's place, ids and plane lengths and each document's id
and number of ids, so that any document is read from its blocks alone.

A data set is a folder of such files, one a task, over ascending ranges of
document ids, and the manifest that the write returns: only files named there
belong to it, so a task that runs twice leaves nothing but an unread file.

Defined cases: null and empty text hold the end id alone; equal document ids
stand in the order of their texts' hashes; repeated rows are all kept; null
document ids come first; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage
from folioflow.llm import tokens as T

MAGIC = b"FFPLANE1"


def to_planes(ids: np.ndarray, kind: str) -> list[np.ndarray]:
    """Transpose ids into byte or bit planes, lowest first."""
    top = int(ids.max()) if len(ids) else 0
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, k]) for k in range(max(1, (top.bit_length() + 7) // 8))]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little") for k in range(max(1, top.bit_length()))]


def from_planes(planes: list[np.ndarray], n: int, kind: str) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            octets[:, k] = p
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(p, count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


class Writer:
    """Streams ids into one file; holds one block and the index."""

    def __init__(self, out, kind: str = "byte", block: int = 1 << 18, level: int = 1):
        self.out, self.kind, self.block = out, kind, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.place = out.write(MAGIC) or len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.blocks: list[int] = []  # place, ids, planes, then the planes' lengths
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.no_id: list[np.ndarray] = []  # which documents have none

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, no_id: np.ndarray | None = None) -> None:
        self.docs.append(np.asarray(doc_ids, "<i8"))
        self.no_id.append(np.zeros(len(doc_ids), bool) if no_id is None else no_id)
        self.sizes.append(np.asarray(sizes, "<i8"))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            for at in range(0, len(flat) - self.block + 1, self.block):
                self._flush(flat[at : at + self.block])
            self.waiting = [flat[len(flat) // self.block * self.block :].copy()]
            self.held = len(self.waiting[0])

    def _flush(self, ids: np.ndarray) -> None:
        frames = [self.press.compress(p.tobytes()) for p in to_planes(ids, self.kind)]
        self.blocks += [self.place, len(ids), len(frames), *map(len, frames)]
        for f in frames:
            self.out.write(f)
            self.place += len(f)

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, "<i8")
        blocks = np.array(self.blocks, "<i8")
        none = np.flatnonzero(np.concatenate(self.no_id) if self.no_id else np.zeros(0, bool)).astype("<i8")
        head = np.array([self.kind == "bit", self.block, len(blocks), len(docs)], "<i8")
        index = self.press.compress(b"".join(x.tobytes() for x in (head, blocks, docs, sizes, none)))
        self.out.write(index + struct.pack("<q", len(index)) + MAGIC)


class Reader:
    """Random access to a file written by ``Writer``."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 16)
        length, magic = struct.unpack("<q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(size - 16 - length)
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(length)), "<i8")
        self.kind = "bit" if flat[0] else "byte"
        self.block = int(flat[1])
        blocks, n_docs = flat[4 : 4 + flat[2]], int(flat[3])
        self.docs = flat[4 + flat[2] : 4 + flat[2] + n_docs]
        self.sizes = flat[4 + flat[2] + n_docs : 4 + flat[2] + 2 * n_docs]
        self.no_id = np.zeros(n_docs, bool)
        self.no_id[flat[4 + flat[2] + 2 * n_docs :]] = True
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blocks, at = [], 0
        while at < len(blocks):
            n = int(blocks[at + 2])
            self.blocks.append((int(blocks[at]), int(blocks[at + 1]), blocks[at + 3 : at + 3 + n].tolist()))
            at += 3 + n

    def read_block(self, k: int) -> np.ndarray:
        place, n, lengths = self.blocks[k]
        self.source.seek(place)
        data = self.source.read(sum(lengths))
        planes, at, undo = [], 0, zstandard.ZstdDecompressor()
        for size in lengths:
            planes.append(np.frombuffer(undo.decompress(data[at : at + size]), np.uint8))
            at += size
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the file."""
        if not n:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        flat = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return flat[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every document's place in the file and its ids, block after block."""
        rest, k = np.zeros(0, "<u4"), 0
        for d, n in enumerate(self.sizes.tolist()):
            parts = [rest]
            held = len(rest)
            while held < n:
                parts.append(self.read_block(k))
                held += len(parts[-1])
                k += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield d, flat[:n]
            rest = flat[n:]


def open_fs(path: str):
    """The file system and the inner path of a URI or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(df: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, kind: str = "byte", block: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id`` and write plane files over ascending ids; returns the manifest (shard, path, n_docs, n_ids) as a settled table.

    The texts are dealt out by ranges of the id (and of a hash, so that many
    rows of one id do not meet in one task) and encoded where they are written.
    """
    storage.on_workers(df.sparkSession)
    path = tokenizer or T.default_path()
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = src.withColumn("_h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        bpe, writer, n_docs, n_ids = T.load(path), None, 0, 0
        fs, inner = open_fs(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            for part in T.slices(batch):
                if writer is None:
                    fs.create_dir(inner, recursive=True)
                    out = fs.open_output_stream(f"{inner}/{name}")
                    writer = Writer(out, kind, block)
                flat, counts = bpe.encode_texts(part.column("text"))
                ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                docs = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                writer.add(docs, counts + 1, ids, part.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                n_docs, n_ids = n_docs + part.num_rows, n_ids + len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch([[shard], [f"{folder}/{name}"], [n_docs], [n_ids]], ["shard", "path", "n_docs", "n_ids"])

    return storage.settle(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "planes-manifest")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents from the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids."""
    from pyspark.sql import Window

    # one row a file; the window below is over that short list
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.fillna(0, ["base"]).repartition("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = open_fs(row["path"])
                with fs.open_input_file(inner) as f:
                    r = Reader(f)
                    crc, ids, at = [], [], 0
                    for d, got in r.documents():
                        crc.append(zlib.crc32(got.tobytes()))
                        ids.append(got)
                        if len(crc) == 2000 or d == len(r.sizes) - 1:
                            to = at + len(crc)
                            cols = [pa.array(r.docs[at:to], mask=r.no_id[at:to]), row["base"] + r.starts[at:to], r.sizes[at:to], np.array(crc, np.int64)]
                            cols = [pa.array(c) for c in cols] + ([pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))] if with_ids else [])
                            yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                            crc, ids, at = [], [], to

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
