"""URL rules as a sort-merge range join.

A host's canonical key is its labels in reverse, each closed by U+0001, so a
rule's host and all its subdomains are one interval of the sorted keys. URLs
and rules are rows of one table that is cut into ranges of (key, path, a random
number) and sorted; the cuts are quantiles of a small sample of the URLs. A rule
goes to every range that its interval touches, so only rules of few labels go to
many. In each range a sweep reads both kinds of row in order and keeps the stack
of the rules whose interval holds the present key; the stack's rules are nested,
outermost first. Of the rules on the stack whose path starts the URL's path the
longest (host and path together) wins, of equally long ones that with the
longer host, of equal ones that which blocks.

No task holds more rules than lie around its own URLs, and a host with a third
of all URLs is dealt over many ranges.

Defined cases: a URL that is null or has no ``://`` has an empty host and path
and no rule; a rule without a host fits nothing, one without a path fits all
paths; equal rules give one answer; repeated rows stay, with or without an id;
further columns are ignored; without rules all get the default; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage

CLOSE = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(labels), CLOSE), F.lit(CLOSE)))


class Sweep:
    """Takes rules and URLs in ascending order of their keys and keeps the stack of the rules that hold the present key."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, name: str, verdict: str) -> None:
        self._leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths:
            lengths[:] = sorted({*lengths, len(path)}, reverse=True)
        elif (paths[path][1] == "block", paths[path][1]) >= (verdict == "block", verdict):
            return
        paths[path] = (name, verdict)

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        self._leave(key)
        win = None
        for _, paths, lengths in reversed(self.stack):
            for n in lengths:
                got = paths.get(path[:n]) if n <= len(path) else None
                if got is not None:
                    win = got if win is None or len(got[0]) > len(win[0]) else win
                    break
        return win


def cuts_of(src: DataFrame, parts: int | None, each: int = 250_000, sample: int = 64) -> list[tuple[bytes, bytes, float]]:
    """Sorted tuples (key, path, number) that cut the URLs into ranges of about equal size: some hundred bytes a range."""
    n = src.count()
    parts = parts or max(min(src.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)), -(-n // each))
    if parts < 2:
        return []
    some = src.select("key", "path", "spread").sample(min(1.0, 2.0 * sample * parts / n), 7).collect()
    some = sorted((r.key.encode(), r.path.encode(), r.spread) for r in some)
    return sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []


NAMES = ["part", "kind", "key", "path", "host", "rule", "verdict", "page_id"]
TABLE = "part int, kind int, key string, path string, host string, rule string, verdict string, page_id "


def judge(df: DataFrame, rules: DataFrame | list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", parts: int | None = None) -> DataFrame:
    """rules: (host, path, verdict), a list or a table with these columns. Per row: id, host, path, rule (null if none) and verdict."""
    spark = df.sparkSession
    storage.on_workers(spark)
    col = lambda c: F.col(storage.quoted(c))
    src = df.select(col(id_col).alias("page_id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    src = src.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    src = src.withColumn("key", key_of(F.col("host"))).withColumn("spread", F.rand(7))
    cuts = cuts_of(src, parts)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    host = F.translate("host", UPPER, LOWER)
    rules = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''").distinct()
    rules = rules.withColumn("key", key_of(F.col("host"))).withColumn("rule", F.concat("host", "path"))
    kind = src.schema["page_id"].dataType
    schema = TABLE + kind.simpleString()

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), batch.column("spread").to_pylist(), strict=True)
            part = pa.array([bisect_right(cuts, (k.encode(), p.encode(), x)) for k, p, x in at], pa.int32())
            none = pa.nulls(len(part), pa.string())
            yield pa.record_batch([part, pa.array([1] * len(part), pa.int32()), batch.column("key"), batch.column("path"), batch.column("host"), none, none, batch.column("page_id")], NAMES)

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row = [], []
            for k, key in enumerate(batch.column("key").to_pylist()):
                first, last = bisect_right(cuts, (key.encode(), b"", -1.0)), bisect_right(cuts, (key.encode() + b"\xff",))
                part += range(first, last + 1)
                row += [k] * (last + 1 - first)
            take = pa.array(row, pa.int64())
            cols = [batch.column(c).take(take) for c in ("key", "path", "host", "rule", "verdict")]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array([0] * len(part), pa.int32()), *cols], NAMES[:-1])

    urls = src.mapInArrow(place_urls, schema)
    placed = rules.mapInArrow(place_rules, TABLE.rsplit(",", 1)[0]).withColumn("page_id", F.lit(None).cast(kind))
    met = urls.unionByName(placed).repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "key", "kind", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now, before, win = Sweep(), None, None, None
        for batch in batches:
            names, verdicts, urls = [], [], []
            for k, (part, what, key, path, rule, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "key", "path", "rule", "verdict")), strict=True)):
                if part != now:
                    sweep, now, before = Sweep(), part, None
                if what == 0:
                    sweep.open(key, path, rule, verdict)
                    continue
                if (key, path) != before:
                    win = sweep.best(key, path) or (None, default)
                    before = (key, path)
                urls.append(k)
                names.append(win[0])
                verdicts.append(win[1])
            own = batch.take(pa.array(urls, pa.int64()))
            yield pa.record_batch([own.column("page_id"), own.column("host"), own.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return met.mapInArrow(run, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string")
