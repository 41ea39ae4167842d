"""The tree of all prefixes of conversations.

A conversation is a sequence of turns; a node of the tree is a distinct sequence
of first turns, and everything that starts with it is below it. What is needed
of a turn is its 128-bit digest (role and text) and the words of its text, so
texts are not shuffled. Equal conversations are one path that carries their
number, before any tree is built.

Conversations are dealt by the digest of their first turn, several subtrees a
group, and ``applyInPandas`` builds their trees: every node is a number, with a
dictionary from turn to child; sums come from an iterative walk in postorder. A
subtree of one first turn that holds over ``held`` turns is not built but cut:
the turns that all of it shares become nodes of their own, and what follows is
dealt again by the next turn, as often as needed. Sums of such stems are added
up from below, one step a cut.

Defined cases: turns without a number come first; turns of equal number are
ordered by their digests; null roles and texts are empty; rows without a conv_id
are part of no conversation; repeated rows are turns of their own; a rebuilt
conversation without a turn belongs to the root; two turns are the same if their
digests are; an empty table has no node. One conversation, however long, is held
by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import storage

WORD = r"[^\x20\x09-\x0D]+"
TURN = 16  #: bytes of a turn's digest in a path
NOBODY = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, as (digest, words)."""
    col = lambda c: F.col(storage.quoted(c))
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = col(turn_col).cast("long")
    row = F.struct(turn.isNotNull().alias("numbered"), F.coalesce(turn, F.lit(0)).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = df.filter(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("conv_id"), row.alias("row"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return listed.select("conv_id", F.transform("rows", lambda r: F.struct(r["digest"].alias("digest"), r["words"].alias("words"))).alias("turns"))


def shared_heads(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt so that heads are shared: the first h turns are those of conversation c - c % family, h = crc32(c) % most; their own follow after the first h."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    heads = own.select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    keyed = own.select("conv_id", "turns", h.alias("h"), (c - c % family).alias("base"))
    after = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return keyed.join(heads, "base", "left").select("conv_id", F.concat(head, after).alias("turns"))


def packed(turns: Column) -> list[Column]:
    """path (the digests in a row) and words of a list of turns."""
    path = F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), ""))
    return [path.alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def stem_name(path: str, turns: Column) -> Column:
    return F.md5(F.substring(path, F.lit(1), (turns * TURN).cast("int")))


def end_hashes(members: DataFrame, chunk: int = 8192) -> DataFrame:
    """(whole, ends): SHA-256 of the ids of each group, in order and joined by commas. members: whole, conv_id.

    Rows are sorted over all tasks by group and id and joined to pieces of
    ``chunk`` ids; a group's pieces, in order, are then hashed one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []
        for batch in batches:
            for w, c in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (w != now or len(ids) >= chunk):
                    out.append((now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = w
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["whole", "first", "part"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, ids[0], ",".join(map(str, ids)))], ["whole", "first", "part"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for w, part in zip(batch.column("whole").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if w == now:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = w, hashlib.sha256()
                state.update(part.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["whole", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["whole", "ends"])

    sorted_ = members.select("whole", "conv_id").repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id")
    parts = sorted_.mapInArrow(pieces, "whole string, first long, part string")
    return parts.repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(hashes, "whole string, ends string")


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, words, n, least, ends): each distinct conversation with its number of members, the smallest and the hash of all."""
    named = convs.withColumn("whole", F.md5("path"))
    found = named.groupBy("whole").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("path").alias("path"), F.first("words").alias("words"))
    found = storage.settle(found, "trie-distinct")
    several = found.filter("n > 1").select("whole")
    hashed = end_hashes(named.select("whole", "conv_id").join(several, "whole", "left_semi"))
    alone = F.sha2(F.col("least").cast("string").cast("binary"), 256)
    out = storage.settle(found.join(hashed, "whole", "left").select("path", "words", "n", "least", F.coalesce("ends", alone).alias("ends")), "trie-paths")
    storage.discard(convs.sparkSession, found)
    return out


class Trie:
    """Nodes by number, below a stem of ``depth`` turns that is node 0."""

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.parent = [depth], [words], [-1]
        self.n, self.least, self.ends = [0], [None], [NOBODY]
        self.children: list[dict[bytes, int]] = [{}]

    def add(self, path: bytes, words: list[int], n: int, least: int, ends: str) -> None:
        at, top = 0, self.depth[0]
        self.count(0, n, least)
        for d in range(top, len(path) // TURN):
            turn = path[d * TURN : (d + 1) * TURN]
            child = self.children[at].get(turn)
            if child is None:
                child = self.children[at][turn] = len(self.n)
                for own, value in ((self.depth, d + 1), (self.words, words[d]), (self.parent, at), (self.n, 0), (self.least, None), (self.ends, NOBODY), (self.children, {})):
                    own.append(value)
            at = child
            self.count(at, n, least)
        self.ends[at] = ends

    def count(self, at: int, n: int, least: int) -> None:
        self.n[at] += n
        if self.least[at] is None or least < self.least[at]:
            self.least[at] = least

    def postorder(self) -> list[int]:
        """All nodes, children before parents."""
        order, stack = [], [0]
        while stack:
            at = stack.pop()
            order.append(at)
            stack.extend(self.children[at].values())
        return order[::-1]

    def rows(self, up: int) -> list[tuple]:
        """A row a node; ``up`` is the smallest member above node 0."""
        leaves = [0] * len(self.n)
        saved = [(n - 1) * w for n, w in zip(self.n, self.words, strict=True)]
        for at in self.postorder():
            leaves[at] = leaves[at] or 1
            if self.parent[at] >= 0:
                leaves[self.parent[at]] += leaves[at]
                saved[self.parent[at]] += saved[at]
        return [(self.least[k], self.depth[k], self.least[self.parent[k]] if k else up, self.n[k], len(self.children[k]), leaves[k], saved[k], self.ends[k]) for k in range(len(self.n))]


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The trees of one group: a tree for each stem; the row of a stem names what it hangs on."""
    tries: dict[bytes, tuple[Trie, int, str]] = {}
    columns = (pdf[c] for c in ("path", "words", "n", "least", "ends", "k", "up", "seg"))
    for path, words, n, least, ends, k, up, seg in zip(*columns, strict=True):
        stem = path[: k * TURN]
        if stem not in tries:
            tries[stem] = (Trie(k, int(words[k - 1])), up, seg)
        tries[stem][0].add(path, words.tolist(), n, least, ends)
    rows = [(*r, seg if not i else None) for trie, up, seg in tries.values() for i, r in enumerate(trie.rows(up))]
    return pd.DataFrame(rows, columns=[*(c.split()[0] for c in NODES.split(", ")), "seg"])


def nodes(convs: DataFrame, held: int = 1024, together: int = 4096) -> DataFrame:
    """All nodes of the tree of ``convs`` (conv_id, turns). A subtree of one stem is cut from over ``held`` turns on; groups hold about ``together`` turns."""
    spark = convs.sparkSession
    storage.on_workers(spark)
    convs = storage.settle(convs.select("conv_id", *packed(F.col("turns"))), "trie-convs")
    paths = distinct_paths(convs)
    length = F.size("words")
    n, least, turns = paths.agg(F.sum("n"), F.min("least"), F.sum(length.cast("long"))).first()
    root = "root"
    open_ = paths.filter(length > 0).select("*", F.lit(1).alias("k"), F.lit(least).cast("long").alias("up"), F.lit(root).alias("seg"))
    ended = paths.filter(length == 0).select(F.lit(root).alias("seg"), "ends")
    closed: DataFrame | None = None
    stems: list[DataFrame] = []
    done = [convs, paths]
    while True:
        named = open_.withColumn("name", stem_name("path", F.col("k")))
        big = named.groupBy("name").agg(F.count("*").alias("c"), F.sum(length.cast("long")).alias("turns")).filter((F.col("turns") > held) & (F.col("c") > 1)).select("name")
        big = storage.settle(big, "trie-big")
        done.append(big)
        if big.isEmpty():
            closed = open_ if closed is None else closed.unionByName(open_)
            break
        whole = named.join(big, "name", "left_anti").drop("name")
        closed = whole if closed is None else closed.unionByName(whole)
        cut = named.join(big, "name", "left_semi")
        found = cut.groupBy("name").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.min_by("words", "path").alias("words"), F.sum("n").alias("n"), F.min("least").alias("least"), F.first("k").alias("k"), F.first("up").alias("up"), F.first("seg").alias("seg"))
        stem = storage.settle(found.mapInPandas(shared_turns, "name string, n long, least long, k int, up long, seg string, to int, words array<long>"), "trie-stems")
        stems.append(stem)
        below = cut.select("path", "words", "n", "least", "ends", "name").join(stem.select("name", "to", F.col("least").alias("up")), "name")
        ended = ended.unionByName(below.filter(length == F.col("to")).select(F.col("name").alias("seg"), "ends"))
        open_ = below.filter(length > F.col("to")).select("path", "words", "n", "least", "ends", (F.col("to") + 1).alias("k"), "up", F.col("name").alias("seg"))
        open_ = storage.settle(open_, "trie-open")
        done.append(open_)
    groups = max(1, -(-(turns or 0) // together))
    bucket = F.pmod(F.xxhash64(stem_name("path", F.col("k"))), F.lit(groups))
    built = storage.settle(closed.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(build, f"{NODES}, seg string"), "trie-nodes")
    ended = storage.settle(ended, "trie-ends")
    for x in done:
        storage.discard(spark, x)
    out = built.drop("seg")
    hung = ["seg", "n_children", "n_leaves", "saved_tokens"]
    tops = built.filter("seg IS NOT NULL").groupBy("seg").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    tops = storage.settle(tops, "trie-tops")
    stems.insert(0, spark.createDataFrame([(root, n, least, 0, None, None, 0, [])], "name string, n long, least long, k int, up long, seg string, to int, words array<long>").filter("n > 0"))
    for stem in reversed(stems):
        sums = tops.select(F.col("seg").alias("name"), *hung[1:])
        last = ended.groupBy(F.col("seg").alias("name")).agg(F.max("ends").alias("ends"))
        full = stem.join(sums, "name", "left").join(last, "name", "left").na.fill(0, ["n_children", "saved_tokens"])
        own = F.transform("words", lambda w: (F.col("n") - 1) * w)
        full = full.withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1).cast("long"))).withColumn("own", own)
        full = storage.settle(full.select("*", F.explode(F.sequence("k", "to")).alias("depth")), "trie-stem-nodes")
        lower = F.aggregate(F.slice("own", F.greatest(F.col("depth") - F.col("k") + 1, F.lit(1)), F.col("to") - F.col("depth") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        end, begin = F.col("depth") == F.col("to"), F.col("depth") == F.col("k")
        here = full.select(
            F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(begin, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved_tokens") + lower).alias("saved_tokens"),
            F.when(end, F.coalesce("ends", F.lit(NOBODY))).otherwise(F.lit(NOBODY)).alias("ends_sha256"), "seg", begin.alias("begin"),
        )
        out = out.unionByName(here.drop("seg", "begin"))
        more = here.filter("begin").groupBy("seg").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        tops = tops.unionByName(more).groupBy("seg").agg(*(F.sum(c).alias(c) for c in hung[1:]))
        if stem is not stems[0]:
            tops = storage.settle(tops, "trie-tops")
    return out


def shared_turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many turns all paths between two share, and the words of the turns from k to there: the least and the greatest path share what all share."""
    for pdf in frames:
        to, words = [], []
        for low, high, w, k in zip(pdf["low"], pdf["high"], pdf["words"], pdf["k"], strict=True):
            most = min(len(low), len(high)) // TURN
            same = next((d for d in range(k, most) if low[d * TURN : (d + 1) * TURN] != high[d * TURN : (d + 1) * TURN]), most)
            to.append(same)
            words.append(w[k - 1 : same])
        yield pdf[["name", "n", "least", "k", "up", "seg"]].assign(to=to, words=words)


def tree(df: DataFrame, held: int = 1024, together: int = 4096, **columns: str) -> DataFrame:
    """All nodes of the tree of the rebuilt conversations of ``df`` (see ``shared_heads``)."""
    storage.on_workers(df.sparkSession)
    return nodes(shared_heads(storage.settle(ordered(df, **columns), "trie-turns")), held, together)
