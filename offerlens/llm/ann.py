"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node, so copies neither crowd a graph nor cut it into
islands. Nodes are dealt to shards of about ``SHARD_SIZE`` by their length and
hash; a shard's graph is built by one task and stored as flat neighbour
arrays, a row per shard. Inner products are searched as distances: within a
shard, each vector gets one more component that lifts all to the same length
(0 for queries), which changes no inner product with a query. Lengths within a
shard differ by a factor of at most ``LENGTHS``, so that the extra component
stays small and near means near in direction.

When a shard is built, its recall is measured: ``PROBES`` of its own vectors
ask the graph and, by brute force, all of the shard. The breadth of the search
is doubled until ``RECALL`` is reached, and kept with the graph; where that
takes a breadth of half the shard, the shard is searched exactly.

Queries meet every shard in blocks of ``QUERY_BLOCK``; the shards' results are
merged, nodes are opened into their smallest ids, and the nearest are ranked
by the double-precision inner product of the original vectors.

Cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, as query or candidate; vectors are only compared with
vectors of their own dimension; rows that repeat an id and vector count once;
an id that stands on several vectors asks with the smallest of them (component by component) and may be found by
each; equal scores are ranked by the smaller id; with fewer candidates than asked
for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import mix64, stage

SHARD_SIZE, QUERY_BLOCK = 8192, 2048
#: Neighbours on the upper levels (twice as many on the lowest), breadth of the search while building and searching.
LINKS, BREADTH_BUILD, BREADTH = 16, 80, 128
#: Ratio of lengths within a shard; vectors that a new graph is tried with, neighbours asked for, and the part that has to be found.
LENGTHS, PROBES, PROBED, RECALL = 1.1, 48, 21, 0.95


def usable(vec: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class Graph:
    """One shard's graph over unit-free vectors: rows of ``vectors``, flat neighbour arrays per level."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors, self.levels = vectors, levels
        n, top = len(vectors), int(levels.max(initial=0))
        self.width = [2 * LINKS] + [LINKS] * top
        self.place = [np.arange(n)]  # row of a node in a level's array
        for k in range(1, top + 1):
            p = np.full(n, -1)
            on = np.flatnonzero(levels >= k)
            p[on] = np.arange(len(on))
            self.place.append(p)
        self.links = [np.full((int((levels >= k).sum()), self.width[k]), -1, np.int32) for k in range(top + 1)]
        self.degree = [np.zeros(len(x), np.int32) for x in self.links]
        self.seen = np.zeros(n, np.int64)
        self.round = 0
        self.entry = -1

    def neighbours(self, node: int, level: int) -> np.ndarray:
        row = self.place[level][node]
        return self.links[level][row, :self.degree[level][row]]

    def nearest(self, q: np.ndarray, start: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """Best-first search on a level: (similarity, node), best first."""
        self.round += 1
        stamp, seen, vectors = self.round, self.seen, self.vectors
        for _, i in start:
            seen[i] = stamp
        todo = [(-s, i) for s, i in start]
        best = list(start)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= breadth:
                break
            near = self.neighbours(i, level)
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            sims = vectors[near] @ q
            if len(best) >= breadth:
                ok = sims > best[0][0]
                near, sims = near[ok], sims[ok]
            for s, i in zip(sims.tolist(), near.tolist()):
                if len(best) < breadth:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(todo, (-s, i))
        return sorted(best, reverse=True)

    def spread(self, sims: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of ``nodes`` (best first) that are nearer to the centre than to each other; filled up with the best."""
        v = self.vectors[nodes]
        between = v @ v.T
        open_, kept = np.ones(len(nodes), bool), []
        for i in range(len(nodes)):
            if open_[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                open_ &= between[i] <= sims
        if len(kept) < most:
            chosen = set(kept)
            kept += [i for i in range(len(nodes)) if i not in chosen][:most - len(kept)]
        return nodes[kept]

    def connect(self, node: int, level: int, found: list[tuple[float, int]]) -> None:
        sims, nodes = np.array([s for s, _ in found]), np.array([i for _, i in found])
        chosen = self.spread(sims, nodes, LINKS)
        place, links, degree, width = self.place[level], self.links[level], self.degree[level], self.width[level]
        row = place[node]
        links[row, :len(chosen)] = chosen
        degree[row] = len(chosen)
        for j in chosen.tolist():
            r = place[j]
            d = degree[r]
            if d < width:
                links[r, d] = node
                degree[r] = d + 1
                continue
            near = np.append(links[r, :d], node)
            sims = self.vectors[near] @ self.vectors[j]
            order = np.argsort(-sims, kind="stable")
            keep = self.spread(sims[order], near[order], width)
            links[r, :len(keep)] = keep
            degree[r] = len(keep)

    def insert(self, node: int) -> None:
        level = int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        q, top = self.vectors[node], int(self.levels[self.entry])
        at = [(float(self.vectors[self.entry] @ q), self.entry)]
        for k in range(top, level, -1):
            at = self.nearest(q, at, 1, k)[:1]
        for k in range(min(level, top), -1, -1):
            at = self.nearest(q, at, BREADTH_BUILD, k)
            self.connect(node, k, at)
        if level > top:
            self.entry = node

    def search(self, q: np.ndarray, breadth: int) -> list[tuple[float, int]]:
        at = [(float(self.vectors[self.entry] @ q), self.entry)]
        for k in range(int(self.levels[self.entry]), 0, -1):
            at = self.nearest(q, at, 1, k)[:1]
        return self.nearest(q, at, breadth, 0)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component that gives all the same length."""
    square = (vectors * vectors).sum(1)
    return np.hstack([vectors, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]])


def build(nodes: np.ndarray, vectors: np.ndarray) -> Graph:
    """The graph of a shard; levels follow from the node ids, so a rebuilt shard is the same."""
    with np.errstate(over="ignore"):
        u = (mix64(nodes.astype(np.uint64) + np.uint64(11)) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
    levels = np.minimum(6, (-np.log(np.maximum(u, 1e-300)) / math.log(LINKS)).astype(np.int64))
    graph = Graph(lifted(vectors), levels)
    for i in range(len(nodes)):
        graph.insert(i)
    return graph


def breadth_needed(graph: Graph, vectors: np.ndarray, probes: int = PROBES, k: int = PROBED, recall: float = RECALL) -> int:
    """The least breadth, a power of two times ``BREADTH``, at which sampled vectors find ``recall`` of their exact neighbours.

    At least the size of the shard if only the exact search does."""
    n = len(vectors)
    some = np.unique(np.linspace(0, n - 1, min(n, probes)).astype(int))
    k = min(k, n)
    exact = vectors[some] @ vectors.T
    least = np.partition(exact, n - k, 1)[:, n - k]  # ties at the end count as found
    breadth = BREADTH
    while 2 * breadth < n:
        hits = 0
        for row, i in enumerate(some.tolist()):
            at = [j for _, j in graph.search(np.append(vectors[i], 0.0), breadth)]
            hits += min(k, int((exact[row, at] >= least[row]).sum()))
        if hits >= recall * k * len(some):
            return breadth
        breadth *= 2
    return max(n, breadth)


INDEX = "dim int, shard int, entry int, breadth int, nodes binary, vectors binary, levels binary, links array<binary>, degrees array<binary>"


def build_index(nodes: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row per shard of ``nodes`` (node, dim, vec): its vectors and flat neighbour arrays. Staged."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    band = F.floor(F.log(F.least(F.greatest(length, F.lit(1e-300)), F.lit(1e300))) / math.log(LENGTHS)).cast("int")
    nodes = nodes.withColumn("band", band)
    # a band has shards of its own, numbered on from those of the bands before; one row for each dimension and band that occurs
    before = Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = nodes.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard_size).cast("int").alias("shards"))
    bands = bands.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int"))
    dealt = (nodes.join(F.broadcast(bands), ["dim", "band"])
             .withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("shards"))).cast("int")))

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy(np.int64)
        vectors = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        g = build(ids, vectors)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "entry": g.entry, "breadth": breadth_needed(g, vectors), "nodes": ids.tobytes(), "vectors": vectors.tobytes(),
                              "levels": g.levels.astype(np.int8).tobytes(), "links": [x.tobytes() for x in g.links],
                              "degrees": [x.tobytes() for x in g.degree]}])

    return stage(dealt.select("dim", "shard", "node", "vec").groupBy("dim", "shard").applyInPandas(run, INDEX), "ann-index")


def load_graph(row) -> tuple[np.ndarray, np.ndarray, Graph]:
    """(node ids, original vectors, graph) of an index row."""
    nodes = np.frombuffer(row["nodes"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(nodes), -1)
    g = Graph.__new__(Graph)
    g.vectors, g.levels = lifted(vectors), np.frombuffer(row["levels"], np.int8)
    g.links, g.degree, g.place, g.width = [], [], [], []
    for k, (links, degree) in enumerate(zip(row["links"], row["degrees"])):
        d = np.frombuffer(degree, np.int32)
        g.degree.append(d)
        g.links.append(np.frombuffer(links, np.int32).reshape(len(d), -1))
        place = np.full(len(nodes), -1)
        on = np.flatnonzero(g.levels >= k)
        place[on] = np.arange(len(on))
        g.place.append(place)
        g.width.append(g.links[-1].shape[1] if len(d) else 0)
    g.seen, g.round, g.entry = np.zeros(len(nodes), np.int64), 0, int(row["entry"])
    return nodes, vectors, g


def search_index(index: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH) -> DataFrame:
    """(query_id, node, score): each shard's ``k`` nearest nodes for every query (query_id, dim, vec)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = index.select(F.col("dim").alias("d"), F.col("shard"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = (queries.join(F.broadcast(shards.groupBy("d").agg(F.count(F.lit(1)).cast("int").alias("shards"))), F.col("dim") == F.col("d"))
             .select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block.alias("block"), "query_id", "vec"))
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key, shard, asked):
        import pandas as pd

        out = []
        if len(shard) and len(asked):
            nodes, vectors, g = load_graph(shard.iloc[0])
            for query, vec in zip(asked["query_id"].tolist(), asked["vec"]):
                q = np.asarray(vec, np.float64)
                wide = max(breadth, k, int(shard.iloc[0]["breadth"]))
                at = np.arange(len(nodes)) if wide >= len(nodes) else np.array([i for _, i in g.search(np.append(q, 0.0), wide)])
                scores = vectors[at] @ q
                order = np.lexsort((nodes[at], -scores))[:k]
                out += zip([query] * len(order), nodes[at[order]].tolist(), scores[order].tolist())
        return pd.DataFrame(out, columns=["query_id", "node", "score"])

    keys = ["dim", "shard", "block"]
    return (offered.groupBy(*keys).cogroup(asked.groupBy(*keys))
            .applyInPandas(run, "query_id long, node long, score double"))


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_size: int = SHARD_SIZE, breadth: int = BREADTH) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows with the largest inner product found for each query row, without itself."""
    rows = (table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
            .where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec")))
    nodes = stage(rows.groupBy("vec").agg(F.min("id").alias("node")).select("node", F.size("vec").alias("dim"), "vec"), "ann-nodes")
    if nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # ids that stand on several vectors: all but the smallest vector get numbers of their own, beyond the ids
        nth = F.row_number().over(Window.partitionBy("node").orderBy("vec"))
        beyond = F.xxhash64("node", "nth").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        nodes = stage(nodes.withColumn("nth", nth).withColumn("node", F.when(F.col("nth") == 1, F.col("node")).otherwise(beyond)).drop("nth"), "ann-numbered")
    first = Window.partitionBy("node").orderBy("id")
    # of equal vectors, no query needs more than the k + 1 smallest ids
    ids = stage(rows.select("id", "vec").distinct().join(nodes, "vec").select("node", "id")
                .withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("node", "id"), "ann-ids")
    queries = stage(rows.where("asks").groupBy(F.col("id").alias("query_id")).agg(F.min("vec").alias("vec"))
                    .select("query_id", F.size("vec").alias("dim"), "vec"), "ann-queries")
    found = search_index(build_index(nodes, shard_size), queries, k + 1, breadth)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    merged = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (merged.join(ids, "node").where(F.col("id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
