"""Helpers shared by the operators: stage tables, size-checked joins, texts as numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import stage_path

#: A side of a join is broadcast up to this many narrow rows (ids, thresholds); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

#: Word separators of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder of ``spark.checkpoint.dir`` and read it back.

    The written table cuts the lineage: a lost executor costs a reread of the
    table, not a rerun of the job, and later branches cannot disagree."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str,
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``small`` (a staged, narrow table): broadcast when its counted
    rows are at most ``max_rows``; otherwise a shuffled join, whose skewed
    partitions AQE splits."""
    return big.join(F.broadcast(small) if small.count() <= max_rows else small, on, how)


def free(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (column names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ texts as arrays
def utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null is an empty text."""
    import pyarrow as pa

    arr = column.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(off: np.ndarray, limit: int):
    """Row ranges (a, b) whose bytes are at most ``limit``; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the spans ``values[start:end]``, which must not overlap; values lie below 2^21.

    Every value is scrambled together with its place in the span before the
    terms are added up. Equal spans hash alike anywhere, and no algebra ties
    the terms together, as it does in a polynomial modulo 2^64 (where the
    Thue-Morse words collide for every base)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = (ends - starts).astype(np.int64)
    before = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(before, lens)
    with np.errstate(over="ignore"):
        terms = values[np.repeat(starts, lens) + place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))
        terms = mix64((terms + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        sums = np.zeros(len(starts), np.uint64)
        full = np.flatnonzero(lens)
        if len(full):
            sums[full] = np.add.reduceat(terms, before[full])
        return mix64(sums + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def word_spans(inside: np.ndarray, off: np.ndarray):
    """Starts, ends and row numbers of the maximal runs where ``inside`` holds, row by row."""
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = off[:-1][off[:-1] < off[1:]]
    begin[cuts] = inside[cuts]
    tail = cuts[cuts > 0] - 1
    last[tail] = inside[tail]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def byte_table(values, size: int = 256) -> np.ndarray:
    t = np.zeros(size, bool)
    t[list(values)] = True
    return t


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


# ------------------------------------------------------------------ vectors as integers
#: Integer components are held within this bound, so that squared distances of 64 components fit a long.
COMPONENT_LIMIT = 1 << 27


def whole_vector(vector, dims: int):
    """Condition: the vector has ``dims`` components, none of them null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def floor_components(vector, scale: int):
    """``floor(scale * x)`` of every component as an int, held within ``COMPONENT_LIMIT``."""
    limit = float(COMPONENT_LIMIT)
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * float(scale), F.lit(-limit)), F.lit(limit))).cast("int"))


def int_rows(column, dims: int) -> np.ndarray:
    """The Arrow column of int lists, all of length ``dims``, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def added_up(parts: DataFrame, *keys: str) -> dict[tuple, int]:
    """Exact sums of ``total`` by ``keys`` (few: their number is a parameter's, not the data's), on the driver."""
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    return {tuple(r[k] for k in keys): int(r["total"]) for r in parts.groupBy(*keys).agg(total).collect()}


def as_long(x: int) -> int:
    """``x``, held within a long."""
    return max(-(1 << 63), min((1 << 63) - 1, x))
