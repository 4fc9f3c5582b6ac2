"""Centroid clustering over zone maps along a space-filling curve.

1. Vectors become integers and are numbered along a Hilbert curve over the
   ``CURVE_DIMS`` components that vary most. Range-partitioned and sorted by
   that number, neighbours lie together; every ``BLOCK`` of them is one row of
   a written table, with the least and the largest value of each component
   (its box).
2. In a round, the squared distances from a centroid to the nearest and to the
   farthest point of a block's box bound all its distances. A centroid whose
   nearest point lies beyond the farthest point of another one cannot win in
   that block. The vectors of the block are compared exactly, in integers, with
   the centroids that are left.
3. A task adds up its vectors by centroid. Spark adds up the tasks' sums, and
   the driver receives K x (components + 1) numbers a round, whatever the size
   of the table.

Nothing is shuffled after the blocks are written. A vector that makes up a
third of all rows spreads over the partitions, which are cut by (curve number,
id). Bounds, distances, sums and divisions are exact in integers.

Cases: vectors that are null, of another length, or hold null or non-finite
components take no part and have no row; integer components beyond 2^27 are
held there; rows of a null id are clustered and are the last to become first
centroids; rows that repeat an id are vectors of their own; with fewer vectors
than centroids there are as many centroids as vectors; sums beyond a long are
held there; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import added_up, as_long, floor_components, int_rows, shuffle_partitions, stage, whole_vector

DIMS, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Components and bits of each that number the curve (at most 62 bits in all); vectors in a block.
CURVE_DIMS, CURVE_BITS, BLOCK = 15, 4, 256
#: Up to this size of components, 64-bit floats hold every product and sum exactly.
EXACT_FLOATS = 1 << 22


def hilbert_numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (values below 2^bits).

    From the highest bit down, each component's bit decides how the lower bits
    are turned: inverted in the first component, or exchanged with it. A Gray
    code over the components then orders the corners of every cube."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    zero = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, zero, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(up, zero + low, swap) if i else np.where(up, x[0] ^ low, x[0])
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = zero
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1 == 1, turn ^ ((1 << b) - 1), turn)
    out = zero
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ turn) >> b) & 1)
    return out


def integers(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x): the usable vectors as int arrays."""
    return (vectors.where(whole_vector(F.col(vec_col), dims))
            .select(F.col(id_col).cast("long").alias("id"), floor_components(F.col(vec_col), scale).alias("x")))


def spread(points: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every component (they only shape the blocks)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = int_rows(batch.column(0), dims).astype(float)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, float(n))), pa.array(s), pa.array(q)],
                                             names=["place", "n", "s", "q"])

    rows = (points.select("x").mapInArrow(run, "place long, n double, s double, q double")
            .groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect())
    mean, deviation = np.zeros(dims), np.zeros(dims)
    for r in rows:
        mean[r.place] = r.s / r.n
        deviation[r.place] = max(0.0, r.q / r.n - mean[r.place] ** 2) ** 0.5
    return mean, deviation


def blocks(points: DataFrame, dims: int) -> DataFrame:
    """(ids, x, low, high): vectors along the curve in blocks with their boxes; staged."""
    mean, deviation = spread(points, dims)
    chosen = np.argsort(-deviation, kind="stable")[:CURVE_DIMS]
    base, step = mean[chosen] - 2 * deviation[chosen], np.maximum(4 * deviation[chosen] / (1 << CURVE_BITS), 1e-9)

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cells = np.clip((int_rows(batch.column(1), dims)[:, chosen] - base) / step, 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_numbers(cells, CURVE_BITS))], names=["id", "x", "place"])

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def block(ids, x):
            x = np.ascontiguousarray(x, np.int32)
            return pa.RecordBatch.from_pylist([{"ids": ids, "x": x.tobytes(), "low": x.min(0).tolist(), "high": x.max(0).tolist()}], schema=schema)

        schema = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])
        ids, rows = [], np.zeros((0, dims), np.int32)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows = np.concatenate([rows, int_rows(batch.column(1), dims)])
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], rows[:BLOCK])
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if ids:
            yield block(ids, rows)

    dealt = (points.mapInArrow(number, "id long, x array<int>, place long")
             .repartitionByRange(shuffle_partitions(points.sparkSession), "place", "id").sortWithinPartitions("place", "id"))
    return stage(dealt.select("id", "x").mapInArrow(pack, "ids array<long>, x binary, low array<int>, high array<int>"), "zone-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box."""
    below, above = low - centroids, centroids - high
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(high - centroids, centroids - low)
    return np.flatnonzero((gap * gap).sum(1) <= (reach * reach).sum(1).min())


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number of the nearest centroid (the first of equals) and the squared distance of each vector, exactly."""
    if max(np.abs(x).max(), np.abs(centroids).max()) <= EXACT_FLOATS:
        a, b = x.astype(float), centroids.astype(float)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def _assigned(batch, dims: int, centroids: np.ndarray) -> Iterator:
    """(ids, vectors, clusters, distances) of each block."""
    low, high = (int_rows(batch.column(i), dims).astype(np.int64) for i in (2, 3))
    for i in range(batch.num_rows):
        x = np.frombuffer(batch.column(1)[i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
        some = candidates(low[i], high[i], centroids)
        best, distance = nearest(x, centroids[some])
        yield batch.column(0)[i].values, x, some[best], distance


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means; empty ones stay."""
    k, dims = centroids.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for _, x, cluster, _ in _assigned(batch, dims, centroids):
                total[:, dims] += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster).tolist():
                    total[c, :dims] += x[cluster == c].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims + 1)), pa.array(np.tile(np.arange(dims + 1), k)),
                                          pa.array(total.ravel())], names=["cluster", "place", "total"])

    total = added_up(table.mapInArrow(run, "cluster long, place long, total long"), "cluster", "place")
    return np.array([[total[c, j] // total[c, dims] for j in range(dims)] if total.get((c, dims)) else centroids[c].tolist()
                     for c in range(k)], np.int64).reshape(k, dims)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE,
            k: int = K, rounds: int = ROUNDS, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, staged, and the final centroids.

    The first centroids are the vectors whose ids have the smallest SHA-256 after ``salt``."""
    points = integers(vectors, id_col, vec_col, dims, scale)
    mark = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = points.orderBy(mark.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    if not first:
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    table = blocks(points, dims)
    for _ in range(rounds):
        centroids = moved(table, centroids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, _, number, distance in _assigned(batch, dims, centroids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)],
                                                 names=["id", "cluster", "distance"])

    return stage(table.mapInArrow(run, "id long, cluster int, distance long"), "zone-clusters"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256; the table of clusters has a row for each centroid."""
    spark = assigned.sparkSession
    total = added_up(assigned.select("cluster", F.col("distance").alias("total")), "cluster")
    rows = [(c, as_long(total.get((c,), 0)), as_long(sum(total.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
            for c, x in enumerate(centroids.tolist())]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
