"""Vector codes by Orchard's search for the nearest codebook entry.

Vectors become integers and are cut into ``PARTS`` equal parts; each part has
a codebook of its own, and a vector's code is the numbers of its parts'
nearest entries. The nearest entry is found without comparing all: every entry
has the list of the others, sorted by their distance from it. From a first
guess, the search walks down the current entry's list. An entry that is nearer
to the part takes over, and the walk goes on in its list; entries compared
before are marked and skipped. Once a listed entry lies more than twice as far
from the current one as the part does, no entry beyond it can be nearer or as
near, and the search ends. All parts of a batch walk side by side.

The lists are made on the driver from the codebooks, PARTS x ENTRIES entries
whatever the size of the table, and go to the tasks with the function. A round
brings back their sums only. The vectors are written once as integers and read
in every round; nothing is shuffled but those sums.

Cases: vectors that are null, of another length than ``DIMS``, or hold null or
non-finite components take no part and have no row; integer components beyond
2^27 are held there; rows of a null id are encoded and are the last to become
entries; rows that repeat an id are vectors of their own; with fewer vectors
than entries there are as many entries as vectors; equal entries go by the
lower number; null labels are one label; sums beyond a long are held there; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import (BROADCAST_ROWS, added_up, floor_components, int_rows, stage, whole_vector)

DIMS, SCALE, PARTS, ENTRIES, ROUNDS = 64, 256, 16, 64, 2
#: Parts that walk side by side.
WALKERS = 32_768


class Codebooks:
    """Entries of all parts (parts x entries x width) with, for every entry, the other entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, n, width = entries.shape
        gap = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3)
        own = np.eye(n, dtype=bool)[None].repeat(parts, 0)
        order = np.argsort(np.where(own, -1, gap), 2, kind="stable")[:, :, 1:]
        #: numbers count through all parts, so that the walks of all parts share their steps
        base = (np.arange(parts) * n)[:, None, None]
        self.flat = entries.reshape(parts * n, width)
        self.lists = (order + base).reshape(parts * n, n - 1)
        self.gaps = np.take_along_axis(gap, order, 2).reshape(parts * n, n - 1)
        self.by_first = np.argsort(entries[:, :, 0], 1, kind="stable")

    def guess(self, x: np.ndarray) -> np.ndarray:
        """For each part (vectors x parts x width) an entry whose first component is close."""
        n, out = self.entries.shape[1], np.empty(x.shape[:2], np.int64)
        for p in range(x.shape[1]):
            by = self.by_first[p]
            out[:, p] = p * n + by[np.minimum(np.searchsorted(self.entries[p, by, 0], x[:, p, 0]), n - 1)]
        return out

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each part (vectors x parts x width)."""
        n = self.entries.shape[1]
        current = self.guess(x).ravel()
        points = x.reshape(-1, x.shape[2])
        best = ((points - self.flat[current]) ** 2).sum(1)
        marked = np.zeros((len(points), n), bool)
        marked[np.arange(len(points)), current % n] = True
        at, walking = np.zeros(len(points), np.int64), np.arange(len(points))
        while n > 1 and len(walking):
            c, k = current[walking], at[walking]
            on = (k < n - 1) & (self.gaps[c, np.minimum(k, n - 2)] <= 4 * best[walking])  # squared: twice as far
            walking, c, k = walking[on], c[on], k[on]
            e = self.lists[c, k]
            at[walking] = k + 1
            new = ~marked[walking, e % n]
            w, e = walking[new], e[new]
            marked[w, e % n] = True
            d = ((points[w] - self.flat[e]) ** 2).sum(1)
            nearer = (d < best[w]) | ((d == best[w]) & (e < current[w]))
            w, e, d = w[nearer], e[nearer], d[nearer]
            current[w], best[w], at[w] = e, d, 0
        return (current % n).reshape(x.shape[:2]), best.reshape(x.shape[:2])


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None, dims: int, scale: int) -> DataFrame:
    """(id, label, x): the usable vectors as int arrays; staged."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return stage(vectors.where(whole_vector(F.col(vec_col), dims)).select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), floor_components(F.col(vec_col), scale).alias("x")), "code-integers")


def _searched(column, books: Codebooks) -> Iterator:
    """(first row, parts, entries, distances) of slices of a batch's vectors."""
    parts, _, width = books.entries.shape
    x = int_rows(column, parts * width).astype(np.int64).reshape(-1, parts, width)
    step = max(1, WALKERS // parts)
    for a in range(0, len(x), step):
        yield a, x[a:a + step], *books.search(x[a:a + step])


def moved(points: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after one round: floors of their parts' means; unused ones stay."""
    parts, n, width = entries.shape
    books = Codebooks(entries)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((parts * n, width + 1), np.int64)
        for batch in batches:
            for _, x, codes, _ in _searched(batch.column(0), books):
                flat = (codes + np.arange(parts) * n).ravel()
                total[:, width] += np.bincount(flat, minlength=parts * n)
                for j in range(width):
                    np.add.at(total[:, j], flat, x[:, :, j].ravel())
        used = np.flatnonzero(total[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used))),
                                          pa.array(total[used].ravel())], names=["entry", "place", "total"])

    total = added_up(points.select("x").mapInArrow(run, "entry long, place long, total long"), "entry", "place")
    out = entries.reshape(parts * n, width).copy()
    for e in {e for e, _ in total}:
        out[e] = [total[e, j] // total[e, width] for j in range(width)]
    return out.reshape(parts, n, width)


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None,
           dims: int = DIMS, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every usable vector, staged, and the final codebooks (parts x entries x width).

    ``code`` is binary, one byte a part (so at most 256 entries). The first
    entries are the parts of the vectors with the smallest ids."""
    if dims % parts or not 1 <= entries <= 256:
        raise ValueError("parts must divide dims, and a code's byte holds at most 256 entries")
    points = integers(vectors, id_col, vec_col, label_col, dims, scale)
    first = points.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    book = np.array([r.x for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    if not first:
        return points.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), book
    for _ in range(rounds):
        book = moved(points, book)
    books = Codebooks(book)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, x, codes, distance in _searched(batch.column(2), books):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(x)), batch.column(1).slice(a, len(x)),
                     pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(distance.sum(1))],
                    names=["id", "label", "code", "error"])

    schema = f"id long, label {points.schema['label'].dataType.simpleString()}, code binary, error long"
    return stage(points.select("id", "label", "x").mapInArrow(run, schema), "codes"), book


def decode(codes: DataFrame, book: np.ndarray, code_col: str = "code", out: str = "x") -> DataFrame:
    """``codes`` with the integer vector that each code stands for."""
    parts, n, width = book.shape
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in p]) for p in book.tolist()])
    places = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: table[p][F.conv(F.hex(F.substring(F.col(code_col), p + 1, F.lit(1))), 16, 10).cast("int")])
    return codes.withColumn(out, F.flatten(places))


def report(encoded: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), the code in hexadecimal."""
    limit = (1 << 63) - 1
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(limit).cast("decimal(38,0)")).cast("long")
    labels = stage(encoded.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return (encoded.join(labels, F.col("label").eqNullSafe(F.col("of")))
            .select("id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
