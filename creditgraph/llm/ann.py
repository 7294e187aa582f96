"""Approximate nearest neighbours (Euclidean): a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Nodes start with the nearest others in the same leaves of a few random-projection trees,
fitted on a bounded sample; leaves that come out overfull are cut further, at medians over all their nodes. Each round of NN-descent then joins, for
every node, its neighbours and those that have it as a neighbour; all pairs of that bounded list are neighbours of neighbours, and each takes those
nearer than its worst neighbour. Rounds end when few neighbours change. What goes around by node are ids and distances: nodes are dealt out in blocks, the
leaves of the first tree, and a vector is sent once to each block that asks for it. A search keeps, for each query, a beam of the nearest nodes
found; each round joins the best nodes not yet expanded with their neighbours, until every beam is expanded. All queries go together.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no
part. Ties go to the smaller id. With fewer candidates than k all are returned. Rows that repeat an id
are one: of several vectors the least counts. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, staged

SAMPLE = 20_000  # vectors that the driver fits trees on, at most
PIVOTS = 512  # nodes that every search may begin at
TREES, LEAF, DEGREE, ROUNDS = 16, 1024, 24, 4
CHANGED = 0.01  # rounds end when less than this share of all neighbours is new
OVERFULL = 4  # times LEAF: leaves of more nodes are cut further
CUTS = 30  # further levels at most; only leaves of equal projections are overfull then
BEAM, EXPAND, STARTS = 256, 32, 8
GRAPH = "id long, nbrs array<long>, dists array<float>"


def clean(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def matrix(vectors: DataFrame) -> np.ndarray:
    """The vectors of a bounded number of rows (v, all of one length), on the driver. They come as an Arrow column: as rows of objects they would take several times as much."""
    got = vectors.select("v").toArrow()["v"].combine_chunks()
    return got.flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)).astype(np.float32)


@dataclass
class Tree:
    """Hyperplanes of a complete binary tree, level by level, and of further bits that all leaves share.

    Below, each level of more has a plane, the leaves that it cuts (sorted) and where it cuts each; other leaves get a 0 there.
    """

    planes: list[np.ndarray]
    cuts: list[np.ndarray]
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for p, c in zip(self.planes, self.cuts, strict=True):
            k = at % len(p)
            at = 2 * at + ((x * p[k]).sum(1) > c[k])
        for p, keys, c in self.more:
            k = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
            at = 2 * at + ((keys[k] == at) & (x @ p > c[k]))
        return at


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    """Each node is cut at the median of its part of the sample; below parts of 32, at the sample's median."""
    rng, planes, cuts = np.random.default_rng(seed), [], []
    at = np.zeros(len(sample), dtype=np.int64)
    for level in range(depth):
        n = 1 << level if len(sample) >> level >= 32 else 1
        p = rng.normal(size=(n, sample.shape[1]))
        c = np.zeros(n)
        for k in range(n):
            part = sample[at == k] if n > 1 else sample
            if len(part):
                c[k] = np.median(part @ p[k])
        planes.append(p)
        cuts.append(c)
        at = 2 * at + ((sample * p[at % n]).sum(1) > c[at % n])
    return Tree(planes, cuts)


def merge(ids: np.ndarray, nbrs: np.ndarray, dists: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest neighbours of each id, each once, out of (id, neighbour, distance) triples."""
    o = np.lexsort((nbrs, dists, ids))
    ids, nbrs, dists = ids[o], nbrs[o], dists[o]
    _, first = np.unique(np.stack([ids, nbrs]), axis=1, return_index=True)
    first.sort()
    ids, nbrs, dists = ids[first], nbrs[first], dists[first]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    rank = np.arange(len(ids)) - np.repeat(start, np.diff([*start, len(ids)]))
    ids, nbrs, dists = ids[rank < k], nbrs[rank < k], dists[rank < k]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else start
    lists = (np.split(nbrs, start[1:]), np.split(dists, start[1:])) if len(ids) else ([], [])
    return pd.DataFrame({"id": pd.Series(ids[start], dtype="int64"), **{c: pd.Series(x, dtype=object) for c, x in zip(("nbrs", "dists"), lists, strict=True)}})


def nearest(ids: np.ndarray, x: np.ndarray, k: int, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples: for each of ids its k nearest among the others, those not nearer than its worst left out."""
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    if worst is not None:
        d[d >= worst[:, None]] = np.inf
    near = np.argpartition(d, min(k, len(ids) - 1) - 1, axis=1)[:, :k] if len(ids) > 1 else np.zeros((len(ids), 0), int)
    got = np.take_along_axis(d, near, axis=1)
    r, c = np.nonzero(np.isfinite(got))
    return ids[r], ids[near[r, c]], got[r, c]


def regrouped(parts: DataFrame, k: int) -> DataFrame:
    """One row for each id, with its k nearest, out of many with some neighbours each, and how many of them are fresh: not in its row that is marked as held."""
    n = 4 * partitions(parts.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        size = g["nbrs"].map(len).to_numpy()
        out = merge(np.repeat(g["id"].to_numpy(), size), np.concatenate([*g["nbrs"]]), np.concatenate([*g["dists"]]).astype(np.float32), k)
        had = dict(zip(g["id"][g["held"]], g["nbrs"][g["held"]], strict=True))
        out["fresh"] = [len(x) - len(np.intersect1d(x, had[i])) if i in had else len(x) for i, x in zip(out["id"], out["nbrs"], strict=True)]
        return out

    return parts.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("part")).applyInPandas(run, f"{GRAPH}, fresh int")


def cut_overfull(nodes: DataFrame, forest: list[Tree], most: int) -> None:
    """Cuts leaves of more than most nodes, level by level, each at the median of its own nodes' projections on a plane of its tree."""
    context = nodes.sparkSession.sparkContext
    full = None
    for level in range(CUTS):
        shared = context.broadcast((forest, full))

        def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees, among = shared.value  # noqa: B023
            for b in batches:
                if len(b):
                    v = np.stack([*b["v"]])
                    for t, tree in enumerate(trees):
                        if among is None or t in among:
                            leaf, n = np.unique(tree.leaves(v), return_counts=True)
                            yield pd.DataFrame({"tree": t, "leaf": leaf, "n": n})

        counted = nodes.select("v").mapInPandas(sizes, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
        over = counted.where(F.col("n") > most).select("tree", "leaf").toPandas()
        if not len(over):
            return
        full = {int(t): np.sort(g["leaf"].to_numpy()) for t, g in over.groupby("tree")}
        planes = {t: np.random.default_rng([t, level]).normal(size=forest[t].planes[0].shape[1]) for t in full}
        shared = context.broadcast((forest, full, planes))

        def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees, among, normal = shared.value  # noqa: B023
            for b in batches:
                if len(b):
                    v = np.stack([*b["v"]])
                    for t, keys in among.items():
                        leaf = trees[t].leaves(v)
                        own = np.isin(leaf, keys)
                        yield pd.DataFrame({"tree": t, "leaf": leaf[own], "p": v[own] @ normal[t]})

        found = nodes.select("v").mapInPandas(projected, "tree int, leaf long, p double").groupBy("tree", "leaf").agg(F.percentile_approx("p", 0.5).alias("p")).toPandas()
        for t, g in found.sort_values("leaf").groupby("tree"):
            forest[int(t)].more.append((planes[int(t)], g["leaf"].to_numpy(), g["p"].to_numpy()))


def plant(nodes: DataFrame, n: int, trees: int, leaf: int) -> list[Tree]:
    """Trees fitted on a sample of nodes, and cut further where leaves come out overfull."""
    share = min(1.0, SAMPLE / max(n, 1))
    x = matrix(nodes.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))))
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    grown = [grow(x, depth, s) for s in range(trees if depth else 1)]
    if depth:
        cut_overfull(nodes, grown, OVERFULL * leaf)
    return grown


def first_graph(nodes: DataFrame, trees: list[Tree], leaf: int, k: int) -> DataFrame:
    """The nearest in the same leaves."""
    shared = nodes.sparkSession.sparkContext.broadcast(trees)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack([*b["v"]])
                for t, tree in enumerate(shared.value):
                    yield pd.DataFrame({"tree": t, "leaf": tree.leaves(v), "id": b["id"], "v": [*v.astype(np.float32)]})

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (tree, _), one in g.groupby(["tree", "leaf"]):
            ids = one["id"].to_numpy()
            v = np.stack([*one["v"]]).astype(float)
            o = np.argsort(ids)
            if len(o) > OVERFULL * leaf:  # no plane cut it: taken in pieces along one of this tree's own
                o = np.argsort(v @ np.random.default_rng([tree, CUTS]).normal(size=v.shape[1]), kind="stable")
            for i in range(0, len(o), OVERFULL * leaf):
                found.append(nearest(ids[o[i : i + OVERFULL * leaf]], v[o[i : i + OVERFULL * leaf]], k))
        return merge(*(np.concatenate(x) for x in zip(*found, strict=True)), k)

    placed = nodes.mapInPandas(place, "tree int, leaf long, id long, v array<float>")
    groups = 4 * partitions(nodes.sparkSession)
    return regrouped(placed.groupBy(F.pmod(F.xxhash64("tree", "leaf"), F.lit(groups)).alias("part")).applyInPandas(inside, GRAPH).withColumn("held", F.lit(False)), k)


def in_blocks(nodes: DataFrame, tree: Tree, leaf: int) -> DataFrame:
    """nodes (id, v as floats) with block: a leaf of tree, or a part by hash of one that no plane could cut."""
    shared = nodes.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("long")
    def at(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaves(np.stack([*v])) if len(v) else np.zeros(0, np.int64))

    placed = nodes.select("id", F.col("v").cast("array<float>").alias("v"), at("v").alias("leaf"))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (OVERFULL * leaf)).alias("parts"))
    return placed.join(sizes, "leaf").select("id", "v", F.xxhash64("leaf", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))


def descend(graph: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """A round of NN-descent over nodes (id, v, block). Of the nodes that have one as a neighbour, it meets k, by hash."""
    out = graph.select("id", F.explode("nbrs").alias("nbr"))
    back = out.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("nbr", F.lit(seed))))).where(F.col("r") <= k).drop("r")
    met = back.groupBy("id").agg(F.collect_list("nbr").alias("more"))  # k at most
    hubs = graph.join(met, "id", "left").join(nodes.select("id", "block"), "id").select("block", "id", F.array_distinct(F.concat("nbrs", F.coalesce("more", F.array().cast("array<long>")))).alias("met"))
    worst = graph.select("id", F.when(F.size("nbrs") < k, float("inf")).otherwise(F.array_max("dists")).cast("float").alias("worst"))
    asked = hubs.select(F.col("block").alias("by"), F.explode("met").alias("id")).distinct()
    sent = asked.join(nodes.select("id", "v").join(worst, "id"), "id")

    def local(hubs: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if not len(hubs) or not len(sent):
            return merge(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        sent = sent.sort_values("id", ignore_index=True)
        ids, w, v = sent["id"].to_numpy(), sent["worst"].to_numpy(), np.stack([*sent["v"]]).astype(float)
        for met in hubs["met"]:
            at = np.searchsorted(ids, np.sort(met))
            found.append(nearest(ids[at], v[at], k, w[at]))
        return merge(*(np.concatenate(x) for x in zip(*found, strict=True)), k)

    more = hubs.groupBy("block").cogroup(sent.groupBy("by")).applyInPandas(local, GRAPH)
    return regrouped(graph.drop("fresh").withColumn("held", F.lit(True)).unionByName(more.withColumn("held", F.lit(False))), k)


def changed(graph: DataFrame) -> float:
    """The share of the neighbours of a round's graph that the one before lacks."""
    n, fresh = graph.agg(F.sum(F.size("nbrs")), F.sum("fresh")).first()
    return (fresh or 0) / max(n or 0, 1)


class Index:
    """nodes(id, v, nbrs): a vector, its nearest neighbours and nodes that it is near to; members(id, vec_id): rows of each node."""

    def __init__(self, rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, rounds: int = ROUNDS, trees: int = TREES, leaf: int = LEAF):
        spark = rows.sparkSession
        self.rows = staged(clean(rows, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
        with Scratch(spark) as s:
            same = s.staged(self.rows.groupBy("v").agg(F.min("vec_id").alias("id")), "nodes")
            n = same.count()
            grown = plant(same, n, trees, leaf)
            blocks = s.staged(in_blocks(same, grown[0], leaf), "blocks")
            graph = s.staged(first_graph(same, grown, leaf, degree), "graph")
            self.rounds = 0
            for seed in range(rounds if n > 1 else 0):
                graph = s.staged(descend(graph, blocks, degree, seed), "graph")
                self.rounds += 1
                if changed(graph) < CHANGED:
                    break
            out = graph.select("id", F.explode("nbrs").alias("nbr"))
            back = out.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("nbr")))).where(F.col("r") <= degree).drop("r")
            links = out.unionByName(back).groupBy("id").agg(F.collect_set("nbr").alias("nbrs"))  # 2 * degree at most
            self.nodes = staged(same.join(links, "id", "left"), "nodes")
            self.members = staged(self.rows.join(same, "v").select("id", "vec_id"), "members")

    def search(self, queries: DataFrame, k: int = 10, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
        """(query_id, rank, vec_id, score) for queries(query_id, v, node); node: where the query is itself in the index, or null.

        A query's own row is no candidate.
        """
        spark = queries.sparkSession
        n = self.nodes.count()
        pivots = self.nodes.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < int(min(1.0, PIVOTS / max(n, 1)) * (1 << 30))).select("id", "v").toArrow()
        at = pivots["v"].combine_chunks()
        shared = spark.sparkContext.broadcast((pivots["id"].to_numpy(), at.flatten().to_numpy().reshape(len(at), -1) if len(at) else np.zeros((0, 1))))
        state_of = "query_id long, v array<double>, ids array<long>, dists array<double>, done array<boolean>, next array<long>"

        def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, x = shared.value
            for b in batches:
                for q, v, node in zip(b["query_id"], b["v"], b["node"], strict=True):
                    own = [] if pd.isna(node) else [int(node)]
                    near = np.argsort(distances(v[None], x)[0])[:STARTS] if len(ids) else []
                    yield pd.DataFrame({"query_id": [q], "v": [v], "ids": [[]], "dists": [[]], "done": [[]], "next": [sorted({*own, *(int(ids[i]) for i in near)})]})

        def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for q, v, ids, dists, done, got in zip(b["query_id"], b["v"], b["ids"], b["dists"], b["done"], b["got"], strict=True):
                    fresh = {g["id"]: g["v"] for g in (got if got is not None else [])}
                    for i in ids:
                        fresh.pop(i, None)
                    new = np.array(sorted(fresh), dtype=np.int64)
                    d = np.sqrt(((np.stack([fresh[i] for i in new]) - v) ** 2).sum(1)) if len(new) else np.zeros(0)
                    ids, dists, done = np.concatenate([ids, new]).astype(np.int64), np.concatenate([dists, d]), np.concatenate([done, np.zeros(len(new), bool)]).astype(bool)
                    o = np.lexsort((ids, dists))[:beam]
                    ids, dists, done = ids[o], dists[o], done[o]
                    now = np.flatnonzero(~done)[:expand]
                    done[now] = True
                    rows.append((q, v, ids, dists, done, ids[now]))
                yield pd.DataFrame(rows, columns=["query_id", "v", "ids", "dists", "done", "next"])

        s = Scratch(spark)
        state = s.staged(queries.select("query_id", "v", F.col("node").cast("double").alias("node")).mapInPandas(begin, state_of), "beam")
        first = True
        while True:
            asked = state.select("query_id", F.explode("next").alias("id"))
            if not first:
                asked = asked.join(self.nodes.select("id", "nbrs"), "id").select("query_id", F.explode("nbrs").alias("id")).distinct()
            got = asked.join(self.nodes.select("id", "v"), "id").groupBy("query_id").agg(F.collect_list(F.struct("id", "v")).alias("got"))
            state = s.staged(state.drop("next").join(got, "query_id", "left").mapInPandas(advance, state_of), "beam")
            first = False
            if state.where(F.size("next") > 0).isEmpty():
                break
        found = state.select("query_id", F.explode(F.arrays_zip("ids", "dists")).alias("e")).select("query_id", F.col("e.ids").alias("id"), F.col("e.dists").alias("score"))
        best = Window.partitionBy("query_id").orderBy("score", "id")
        found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")  # the query's own node may be one
        few = self.members.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
        out = found.join(few, "id").where("vec_id != query_id")
        ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
        with s:
            return staged(out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")

    def own_queries(self, condition) -> DataFrame:
        """The index's own rows that meet condition, as queries."""
        return self.rows.where(condition).join(self.members, "vec_id").select(F.col("vec_id").alias("query_id"), "v", F.col("id").alias("node"))
