"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are compared only inside their label. Equal vectors are merged first
and keep their number. Each label is cut into shards by k-means on a bounded
sample, again and again until a shard holds at most ``most`` vectors; every
vector goes to its nearest centres, so shards overlap. The first of its shards
is a vector's seat. A shard builds a robust-pruned neighbour graph of its
vectors; the adjacency lists that a vector gets in its shards are united.

Every vector is then a query. In each of its shards a greedy search starts from
the medoids and goes on from every vector found within range until none is
left. A found vector may live in further shards: the query travels there, with
the found vector to start from, and the search goes on, round after round, until
no query has anywhere left to go. So the search runs over the united graph
while a task holds one shard and at most ``visitors`` queries. Only pairs with
cosine >= ``least`` in double precision are links, and a link is taken where the
found vector has its seat, so each is counted once.

A shard that k-means cannot cut (vectors of nearly one direction) is a crowd: it
is cut into blocks by number, and every query that meets one of its blocks visits
all of them and is compared with all their vectors. With ``exact`` every label
is treated so. Each call audits itself: the links of about ``audit_queries``
vectors are compared with brute force over all; a recall below ``least_recall``
makes it start again in the exact way.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
numbers, or whose label is null, has no link and is its own component; vectors
of different length are not compared; repeated rows and ids count as vectors
of their own; rows without an id are compared like any other, and have a
component without an id where no other row of it has one; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import graph, storage

SAMPLE = 4096  #: vectors a shard that k-means is fitted on
BLOCK = 8192  #: vectors that one task compares with a shard's centres
COUNT, EDGE, TRAVEL = range(3)
FOUND = "kind int, a long, b long, n long, shard string"


def unit(column: pd.Series) -> np.ndarray:
    """Unit rows in double precision; all lists have one length."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means; centres of empty clusters stay where they are."""
    pick = np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)
    c = x[np.sort(pick)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, degree: int, pool: int, alpha: float) -> np.ndarray:
    """Neighbour lists (rows, degree), -1 where there are fewer: a candidate is left out if a nearer neighbour is, by a factor alpha, closer to it than the vector is."""
    n = len(x)
    degree, pool = min(degree, max(n - 1, 0)), min(pool, max(n - 1, 0))
    out = np.full((n, degree), -1, np.int32)
    if not degree:
        return out
    sim = x @ x.T
    far = np.sqrt(np.maximum(2 - 2 * sim, 0))
    np.fill_diagonal(sim, -2)
    cand = np.argpartition(-sim, pool - 1, 1)[:, :pool]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sim, cand, 1), 1, kind="stable"), 1)
    own = np.take_along_axis(far, cand, 1)
    alive = np.ones(cand.shape, bool)
    filled = np.zeros(n, np.int64)
    for j in range(pool):
        take = np.flatnonzero(alive[:, j] & (filled < degree))
        if not len(take):
            continue
        out[take, filled[take]] = cand[take, j]
        filled[take] += 1
        between = far[cand[take], cand[take, j][:, None]]
        alive[take] &= ~(alpha * between <= own[take]) | (np.arange(pool) <= j)
    return out


def dots(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows a of x with the rows b of y, a part at a time."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 1 << 15):
        hi = lo + (1 << 15)
        out[lo:hi] = np.einsum("id,id->i", x[a[lo:hi]], y[b[lo:hi]])
    return out


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, medoids: np.ndarray, starts: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Which vectors of x each query finds within range, (queries, vectors).

    A search starts from the medoids and from the query's own start (-1: none).
    Each turn every query expands, of the vectors it has seen, those that are in
    range or among its ``beam`` best.
    """
    q, n = len(queries), len(x)
    sim = np.full((q, n), -3.0, np.float32)  # -3: not seen
    done = np.zeros((q, n), bool)
    sim[:, medoids] = (queries @ x[medoids].T).astype(np.float32)
    own = np.flatnonzero(starts >= 0)
    sim[own, starts[own]] = dots(queries, x, own, starts[own])
    slack, width = np.float32(least - 1e-5), min(beam, n)
    while True:
        bar = np.partition(sim, n - width, 1)[:, n - width, None]
        row, col = np.nonzero((sim > -3) & ~done & ((sim >= bar) | (sim >= slack)))
        if not len(row):
            break
        done[row, col] = True
        new = np.zeros((q, n), bool)
        for lo in range(0, len(row), 1 << 13):
            near = lists[col[lo : lo + (1 << 13)]]
            r, c = np.nonzero(near >= 0)
            new[row[lo : lo + (1 << 13)][r], near[r, c]] = True
        a, b = np.nonzero(new & (sim == -3))
        sim[a, b] = dots(queries, x, a, b)
    a, b = np.nonzero(sim >= slack)
    hit = np.zeros((q, n), bool)
    hit[a, b] = dots(queries, x, a, b) >= least
    return hit


def all_hits(x: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """The same by comparing every query with every vector."""
    hit = queries @ x.T >= least - 1e-9
    a, b = np.nonzero(hit)
    hit[a, b] = dots(queries, x, a, b) >= least
    return hit


def medoids_of(x: np.ndarray, k: int = 8) -> np.ndarray:
    c = kmeans(x, min(k, len(x)), 6)
    return np.unique((x @ c.T).argmax(0))


def sound(v: str):
    """Whether a vector can be compared: it has a number that is not 0 and none that is missing or not finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    col = lambda c: F.col(storage.quoted(c))
    t = df.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"), col(label_col).cast("string").alias("label"))
    return t.withColumn("ok", F.col("label").isNotNull() & F.col("v").isNotNull() & sound("v"))


def blocked(df: DataFrame, by: str, size: int) -> DataFrame:
    """Adds ``block``: rows of one ``by`` are dealt over as many blocks as hold about ``size`` rows each."""
    sizes = df.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias("_k"))
    return df.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))


def per_block(rows: DataFrame, whole: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows of a block, the rows of ``whole`` of the same shard)``; the latter are sent to each of the shard's blocks."""
    places = rows.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block")).distinct()
    sent = whole.join(places, F.col("shard") == F.col("to_shard"))
    sent = sent.select(*(F.col(c).alias(c) for c in sent.columns))  # both sides may come from one table
    return rows.groupBy("shard", "block").cogroup(sent.groupBy("to_shard", "to_block")).applyInPandas(run, schema)


def shards(distinct: DataFrame, most: int, overlap: int, exact: bool, levels: int = 16) -> DataFrame:
    """(node, m, v, shard, blocks, seat): every vector in each of its shards; ``blocks`` is 0, or the number of blocks of a crowd, whose names are shard#0, shard#1 and so on."""
    # the label in hexadecimal, so that / and # in names are always ours
    now = distinct.select("node", "m", "v", F.concat_ws("/", F.hex("label"), F.size("v").cast("string")).alias("shard"), F.lit(2**62).alias("whole"), F.lit(True).alias("seat"))
    done: list[DataFrame] = []
    for level in range(levels + 1):
        sizes = now.groupBy("shard").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).filter(F.col("n") > most)
        big = storage.settle(sizes, "shard-sizes")
        rest = now.join(big.select("shard"), "shard", "left_anti")
        done.append(rest.select("node", "m", "v", "shard", F.lit(0).alias("blocks"), "seat"))
        if big.isEmpty():
            break
        # what hardly shrank has no parts that k-means could tell apart
        crowd = F.lit(exact or level == levels) | (F.col("n") >= 0.7 * F.col("whole"))
        cut = now.drop("whole").join(big.filter(crowd).select("shard", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "shard")
        named = F.concat_ws("#", "shard", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("string"))
        done.append(cut.select("node", "m", "v", named.alias("shard"), "blocks", "seat"))
        keep = overlap if level == 0 else 2
        fan = F.least(F.lit(64), F.ceil(2.0 * keep * F.col("n") / most)).cast("int")
        parted = now.drop("whole").join(big.filter(~crowd).select("shard", "n", fan.alias("fan")), "shard")
        chance = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(1_000_003)) < 1_000_003.0 * SAMPLE / F.col("n")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.unique(unit(pdf["v"]), axis=0)
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "centres": [kmeans(x, int(pdf["fan"].iloc[0])).ravel()]})

        centres = storage.settle(parted.filter(chance).select("shard", "fan", "v").groupBy("shard").applyInPandas(fit, "shard string, centres array<double>"), "centres")
        if centres.isEmpty():
            break

        def assign(rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
            x = unit(rows["v"])
            c = np.asarray(centre["centres"].iloc[0]).reshape(-1, x.shape[1])
            near = np.argsort(-(x @ c.T), 1, kind="stable")[:, :keep]
            at = np.repeat(np.arange(len(x)), near.shape[1])
            out = rows.iloc[at][["node", "m", "v"]].reset_index(drop=True)
            out["shard"] = rows["shard"].iloc[0] + "/" + pd.Series(near.ravel().astype(str))
            out["whole"] = rows["n"].iloc[0]
            out["seat"] = rows["seat"].to_numpy()[at] & (np.tile(np.arange(near.shape[1]), len(x)) == 0)
            return out

        now = storage.settle(per_block(blocked(parted, "shard", BLOCK), centres, assign, "node long, m long, v array<double>, shard string, whole long, seat boolean"), "shards")
    out = done[0]
    for s in done[1:]:
        out = out.unionByName(s)
    return out


def build(pdf: pd.DataFrame, degree: int, pool: int, alpha: float) -> pd.DataFrame:
    """The neighbours of one shard's vectors; a crowd's block has none, it is compared whole."""
    pdf = pdf.sort_values("node", ignore_index=True)
    node = pdf["node"].to_numpy()
    if pdf["blocks"].iloc[0]:
        lists = np.zeros((len(node), 0), np.int32)
    else:
        lists = robust_prune(unit(pdf["v"]), degree, pool, alpha)
    home = pdf["shard"] + "|" + pdf["blocks"].astype(str)
    return pd.DataFrame({"node": node, "home": home, "near": [node[r[r >= 0]] for r in lists]})


def elsewhere(home: str, own: str) -> list[str]:
    """The shards to visit for a vector found in ``own`` that also lives in ``home`` (shard|blocks)."""
    name, blocks = home.rsplit("|", 1)
    if blocks == "0":
        return [] if name == own else [name]
    base = name.rsplit("#", 1)[0]
    return [s for k in range(int(blocks)) if (s := f"{base}#{k}") != own]


def visit(asked: pd.DataFrame, nodes: pd.DataFrame, least: float, beam: int) -> pd.DataFrame:
    """One block of queries in one shard: links per query, a forest of the links, and where the queries go next."""
    own = asked["shard"].iloc[0]
    nodes = nodes.sort_values("node", ignore_index=True)
    x, node, m, seat = unit(nodes["v"]), nodes["node"].to_numpy(), nodes["m"].to_numpy(), nodes["seat"].to_numpy(bool)
    query, who = unit(asked["v"]), asked["node"].to_numpy()
    if nodes["blocks"].iloc[0]:
        hit = all_hits(x, query, least)
    else:
        size = nodes["near"].map(len).to_numpy()
        flat = np.concatenate([np.asarray(a, np.int64) for a in nodes["near"]] or [np.zeros(0, np.int64)])
        at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        row, col = np.repeat(np.arange(len(node)), size), np.concatenate([np.arange(k) for k in size])
        here = node[at] == flat  # the rest of a list belongs to the vector's other shards
        lists = np.full((len(node), int(size.max(initial=0)) or 1), -1, np.int32)
        lists[row[here], col[here]] = at[here]
        start = asked["start"].to_numpy()
        at = np.minimum(np.searchsorted(node, start), len(node) - 1)
        hit = range_search(x, lists, query, medoids_of(x), np.where(node[at] == start, at, -1), least, beam)
    at = np.minimum(np.searchsorted(node, who), len(node) - 1)
    mine = np.flatnonzero(node[at] == who)  # queries that live here
    both = np.ix_(mine, at[mine])
    hit[both] |= hit[both].T  # a link that either end found
    hit[mine, at[mine]] = False
    n = (hit[:, seat] * m[seat]).sum(1)
    r, c = np.nonzero(hit & seat)
    u, v = graph.forest(who[r], node[c])
    parts = [pd.DataFrame({"kind": COUNT, "a": who, "b": who, "n": n, "shard": ""}), pd.DataFrame({"kind": EDGE, "a": u, "b": v, "n": 0, "shard": ""})]
    wanted: dict[str, np.ndarray] = {}
    for k in np.flatnonzero(hit.any(0)).tolist():
        for home in nodes["homes"].iloc[k]:
            for s in elsewhere(home, own):
                first = wanted.setdefault(s, np.full(len(who), -1, np.int64))
                first[hit[:, k] & (first < 0)] = node[k]
    known = [{s for h in homes for s in (h.rsplit("|", 1)[0], *elsewhere(h, ""))} for homes in asked["homes"]] if wanted else []
    for s, first in wanted.items():
        go = np.flatnonzero(first >= 0)
        go = go[[s not in known[k] for k in go.tolist()]]
        parts.append(pd.DataFrame({"kind": TRAVEL, "a": who[go], "b": first[go], "n": 0, "shard": s}))
    return pd.concat(parts, ignore_index=True)


def search(placed: DataFrame, united: DataFrame, least: float, beam: int, visitors: int) -> DataFrame:
    """All rounds of the search, as rows (kind, a, b, n, shard)."""
    net = storage.settle(placed.join(united, "node"), "graph")
    every = F.when(F.col("blocks") == 0, F.array("shard")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1), lambda k: F.concat_ws("#", F.element_at(F.split("shard", "#"), 1), k.cast("string"))))
    asked = net.select("node", "v", "homes", F.explode(every).alias("shard"), F.lit(-1).cast("long").alias("start")).dropDuplicates(["node", "shard"])
    own = net.filter("seat").select("node", "v", "homes")
    been: DataFrame | None = None
    out: list[DataFrame] = []
    while True:
        got = storage.settle(per_block(blocked(asked, "shard", visitors), net, lambda a, b: visit(a, b, least, beam), FOUND), "found")
        out.append(got)
        next_ = got.filter(F.col("kind") == TRAVEL).groupBy(F.col("a").alias("node"), "shard").agg(F.min("b").alias("start"))
        if been is not None:
            next_ = next_.join(been, ["node", "shard"], "left_anti")
        next_ = storage.settle(next_, "travels")
        if next_.isEmpty():
            break
        gone = next_.select("node", "shard")
        been = gone if been is None else been.union(gone)
        asked = next_.join(own, "node")
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


def link(df: DataFrame, least: float = 0.93, most: int = 512, overlap: int = 3, degree: int = 24, pool: int = 64, alpha: float = 1.2, beam: int = 12, visitors: int = 1024, exact: bool = False, audit_queries: int = 200, least_recall: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. ``audit_queries=0`` leaves the audit out."""
    storage.on_workers(df.sparkSession)
    rows = vectors(df, id_col, vector_col, label_col)
    distinct = rows.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    distinct = storage.settle(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    placed = storage.settle(shards(distinct, most, overlap, exact), "placed")
    built = placed.groupBy("shard").applyInPandas(lambda pdf: build(pdf, degree, pool, alpha), "node long, home string, near array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("home").alias("homes"))
    found = search(placed, united, least, beam, visitors)
    counts = found.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    counts = storage.settle(counts, "link-counts")
    if audit_queries and not exact and audit(distinct, counts, least, audit_queries) < least_recall:
        return link(df, least, most, overlap, degree, pool, alpha, beam, visitors, True, 0, least_recall, id_col, vector_col, label_col)
    parts = graph.components(found.filter(F.col("kind") == EDGE).select("a", "b"))
    named = distinct.join(counts, "node", "left").join(parts, "node", "left")
    named = named.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least", F.coalesce("component", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "root").select("label", "v", "n_links", "component_id")
    linked = rows.filter("ok").join(of, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(distinct: DataFrame, counts: DataFrame, least: float, queries: int) -> float:
    """Links found over links there are, for about ``queries`` distinct vectors compared with all others by brute force.

    distinct: node, label, v, m; counts: node, n (links found).
    """
    total = max(distinct.count(), 1)
    share = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1_000_003)) < int(1_000_003 * queries / total) + 1
    some = distinct.filter(share).select("node", "label", "v").toPandas()  # some hundred rows: nodes are numbers of their own
    if some.empty:
        return 1.0
    groups = {key: (unit(g["v"]), g["node"].to_numpy()) for key, g in some.groupby(["label", some["v"].map(len)])}

    def count(batches):
        for pdf in batches:
            for key, g in pdf.groupby(["label", pdf["v"].map(len)]):
                if key in groups:
                    q, node = groups[key]
                    there = (all_hits(unit(g["v"]), q, least) & (node[:, None] != g["node"].to_numpy())) @ g["m"].to_numpy()
                    yield pd.DataFrame({"node": node, "n": there})

    there = distinct.select("node", "label", "v", "m").mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("there"))
    got = there.join(counts, "node", "left").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), F.col("there"))), F.sum("there")).first()
    return (got[0] or 0) / got[1] if got[1] else 1.0
