"""Word vectors trained in tasks: a skip-gram model whose tables stay with the executors.

Spark ML's ``Word2Vec`` keeps all vectors on the driver, in every round. Here
the model is a table with a row for each word. The texts are dealt to a fixed
number of parts; each part gets the rows of the words it holds, goes through
its texts one after the other, and the rows of a word are averaged over the
parts that hold it. That is a round. The driver sees one number, the total of
the words.

The model is skip-gram with negative samples (window and rate as in
``Word2Vec``): blocks of neighbouring words are multiplied at once, and the
words of a block share their negative samples.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.session import stage_path

c = F.col
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

# FIXED VALUES: words on each side at most, negative samples for a pair, first learning rate, words in a block and its samples.
WINDOW, NEGATIVES, RATE, BLOCK, SAMPLES = 5, 5, 0.025, 64, 32
#: Groups of words that are averaged at once; results do not depend on it.
BUCKETS = 64
_BATCH = 10_000


def _dealt(model_rows: DataFrame, text_rows: DataFrame, parts: int) -> DataFrame:
    """Each part in a partition of its own: first its rows of the model, by word, then its texts, in order."""
    both = model_rows.unionByName(text_rows, allowMissingColumns=True)
    return both.repartitionById(parts, c("part")).sortWithinPartitions("part", "kind", "id", "word")


def _runs(batches):
    """(part, kind, rows) for the runs of rows with one part and one kind."""
    for batch in batches:
        key = batch["part"].to_numpy().astype(np.int64) * 2 + batch["kind"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(key[a]) // 2, int(key[a]) % 2, batch.slice(a, b - a)


def _known(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) numbers of the tokens that are among ``words``, in order."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    word = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy()
    text = np.repeat(np.arange(len(lengths)), lengths)
    return text[word >= 0], word[word >= 0]


def _add(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] += rows``, where ``at`` may name a row several times."""
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    table[sorted_[starts]] += np.add.reduceat(rows[order], starts)


def _first_vectors(seeds: np.ndarray, dim: int) -> np.ndarray:
    """A vector for each word made of its hash alone, so that all parts start with the same."""
    out = np.empty((len(seeds), dim), np.float32)
    for d in range(dim):
        z = seeds.view(np.uint64) + np.uint64((d + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, d] = (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 - 0.5) / dim
    return out


class _Part:
    """The rows of the model that one part trains."""

    def __init__(self, part: int, dim: int, turn: int, progress) -> None:
        self.part, self.dim, self.turn, self.progress, self.rows, self.done = part, dim, turn, progress, [], 0
        self.words = None
        self.rng = np.random.default_rng([11, part, turn])

    def ready(self) -> None:
        t = pa.Table.from_batches(self.rows).combine_chunks()
        column = lambda x: t[x].chunk(0) if t[x].num_chunks else pa.array([], t[x].type)
        self.words, self.n, self.seed, self.rows = column("word"), column("n"), column("seed"), []
        if self.turn:
            both = np.frombuffer(b"".join(column("vec").to_pylist()), np.float32).reshape(len(self.words), 2 * self.dim)
            self.inner, self.outer = both[:, :self.dim].copy(), both[:, self.dim:].copy()
        else:
            self.inner = _first_vectors(self.seed.to_numpy(), self.dim)
            self.outer = np.zeros_like(self.inner)
        self.chance = np.cumsum(self.n.to_numpy() ** 0.75)

    def learn(self, tokens: pa.Array) -> None:
        text, word = _known(tokens, self.words)
        inner, outer, rng = self.inner, self.outer, self.rng
        radius = rng.integers(1, WINDOW + 1, len(word))
        for a in range(0, len(word), BLOCK):
            b, lo, hi = min(a + BLOCK, len(word)), max(a - WINDOW, 0), min(a + BLOCK + WINDOW, len(word))
            rate = np.float32(max(RATE * 1e-4, RATE * (1 - self.progress(self.done + a))))
            far = np.abs(np.arange(a, b)[:, None] - np.arange(lo, hi))
            pairs = ((far <= radius[a:b, None]) & (far > 0) & (text[a:b, None] == text[lo:hi])).astype(np.float32)
            centre, near = word[a:b], word[lo:hi]
            drawn, times = np.unique(np.searchsorted(self.chance, rng.random(SAMPLES) * self.chance[-1], "right"), return_counts=True)
            drawn = np.minimum(drawn, len(self.words) - 1)
            x, y, z = inner[near], outer[centre], outer[drawn]
            up = pairs * (rate / (1 + np.exp(np.clip(y @ x.T, -30, 30))))
            share = np.outer(pairs.sum(0) * (rate * NEGATIVES / SAMPLES), times).astype(np.float32)
            down = share / (1 + np.exp(np.clip(-(x @ z.T), -30, 30)))
            _add(inner, near, up.T @ y - down @ z)
            _add(outer, centre, up @ x)
            _add(outer, drawn, -(down.T @ x))
        self.done += len(word)

    def result(self, last: bool):
        """The rows as batches; of the last round only what words are embedded with."""
        table = np.ascontiguousarray(self.inner if last else np.concatenate([self.inner, self.outer], 1))
        for a in range(0, len(self.words), _BATCH):
            m = table[a:a + _BATCH]
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * m.shape[1]), len(m), [None, pa.py_buffer(m.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.part] * len(m), pa.int32()), self.words.slice(a, len(m)), self.n.slice(a, len(m)), self.seed.slice(a, len(m)), vec],
                ["part", "word", "n", "seed", "vec"])


def _round(dim: int, turn: int, rounds: int, parts: int, total: int):
    """The function that trains the parts of a partition for one round."""
    def progress(done):
        return (turn + parts * done / total) / rounds

    def train(batches):
        at = None
        for part, kind, rows in _runs(batches):
            if at is None or at.part != part:
                if at is not None and at.words is not None:
                    yield from at.result(turn == rounds - 1)
                at = _Part(part, dim, turn, progress)
            if kind == 0:
                at.rows.append(rows.select(["word", "n", "seed", "vec"]))
            elif at.rows or at.words is not None:  # else no word of the part occurs twice
                if at.words is None:
                    at.ready()
                at.learn(rows["tokens"])
        if at is not None and at.words is not None:
            yield from at.result(turn == rounds - 1)
    return train


def _averaged(last: bool):
    """The function that makes one row of the rows that the parts have of a word."""
    def average(table: pa.Table) -> pa.Table:
        t = table.sort_by([("word", "ascending"), ("part", "ascending")]).combine_chunks()
        words = t["word"].chunk(0)
        same = pc.equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        ends = np.append(starts, len(words))
        m = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float32).reshape(len(words), -1)
        mean = (np.add.reduceat(m, starts, dtype=np.float64) / np.diff(ends)[:, None]).astype(np.float32)
        if last:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(mean) + 1) * mean.shape[1], pa.int32()), pa.array(mean.ravel()))
            return pa.table([words.take(pa.array(starts)), flat], ["word", "vector"])
        one = t.take(pa.array(starts))
        vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * mean.shape[1]), len(mean), [None, pa.py_buffer(mean.tobytes())]).cast(pa.binary())
        return pa.table([one["word"], one["n"], one["seed"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), t["part"].chunk(0)), vec],
                        ["word", "n", "seed", "parts", "vec"])
    return average


def _drop_shuffles(spark) -> None:
    """Shuffles of jobs that have ended leave the disks when the driver's JVM collects its garbage; not before, so ask for it."""
    spark.sparkContext._jvm.System.gc()


class WordVectors(Estimator):
    """Vectors for the words that occur twice in ``tokens`` (array<string>), all of them, from all texts."""

    def __init__(self, tokens: str, out: str, dim: int, rounds: int, parts: int) -> None:
        super().__init__()
        self.tokens, self.out, self.dim, self.rounds, self.parts = tokens, out, dim, rounds, parts

    def _fit(self, dataset: DataFrame) -> WordTable:
        spark = dataset.sparkSession
        path = stage_path(spark, "word-vectors")
        dataset.select(F.monotonically_increasing_id().alias("id"), c(self.tokens).alias("tokens")).write.parquet(f"{path}/texts")
        texts = spark.read.schema("id long, tokens array<string>").parquet(f"{path}/texts").withColumn("part", F.pmod("id", F.lit(self.parts)).cast("int"))
        held = texts.select("part", F.explode("tokens").alias("word")).groupBy("word", "part").count()
        words = held.groupBy("word").agg(F.sum("count").alias("n"), F.sort_array(F.collect_list("part")).alias("parts")).where("n > 1")
        words.select("word", "n", F.xxhash64("word").alias("seed"), "parts", F.lit(None).cast("binary").alias("vec")).write.parquet(f"{path}/round-0")
        state = "word string, n long, seed long, parts array<int>, vec binary"
        total = spark.read.schema(state).parquet(f"{path}/round-0").agg(F.sum("n")).first()[0]
        vectors = "word string, vector array<float>"
        text_rows = texts.select("part", F.lit(1).alias("kind"), "id", "tokens")
        for turn in range(self.rounds if total else 0):
            last = turn == self.rounds - 1
            model_rows = spark.read.schema(state).parquet(f"{path}/round-{turn}").select(
                F.explode("parts").alias("part"), F.lit(0).alias("kind"), "word", "n", "seed", "vec")
            trained = _dealt(model_rows, text_rows, self.parts).mapInArrow(
                _round(self.dim, turn, self.rounds, self.parts, total), "part int, word string, n long, seed long, vec binary")
            trained.groupBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS))).applyInArrow(_averaged(last), vectors if last else state).write.parquet(
                f"{path}/{'vectors' if last else f'round-{turn + 1}'}")
            _drop_shuffles(spark)
        if not total:
            spark.createDataFrame([], vectors).write.parquet(f"{path}/vectors")
        return WordTable(self.tokens, self.out, self.dim, self.parts, spark.read.schema(vectors).parquet(f"{path}/vectors"))


class WordTable(Model):
    """Adds the mean of the vectors of a text's words; the texts meet the words they hold in tasks.

    The tokens themselves are left out of the result."""

    def __init__(self, tokens: str, out: str, dim: int, parts: int, vectors: DataFrame) -> None:
        super().__init__()
        self.tokens, self.out, self.dim, self.parts, self.vectors = tokens, out, dim, parts, vectors

    def getVectors(self) -> DataFrame:  # noqa: N802 (as in Word2VecModel)
        return self.vectors

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, dim = dataset.sparkSession, self.dim
        kept = dataset.select(*[x for x in dataset.columns if x not in ("__tok", self.tokens)])
        rows = dataset.select(F.monotonically_increasing_id().alias("id"), c(self.tokens).alias("tokens"), F.struct(*kept.columns).alias("row"))
        path = stage_path(spark, "word-rows")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path).withColumn("part", F.pmod("id", F.lit(self.parts)).cast("int"))
        held = rows.select("part", F.explode("tokens").alias("word")).distinct()
        model_rows = held.join(self.vectors, "word").select("part", F.lit(0).alias("kind"), "word", "vector")
        text_rows = rows.select("part", F.lit(1).alias("kind"), "id", "tokens", "row")

        def mean(batches):
            at, found, words, table = None, [], None, None
            for part, kind, run in _runs(batches):
                if part != at:
                    at, found, words, table = part, [], None, None
                if kind == 0:
                    found.append(run.select(["word", "vector"]))
                    continue
                if table is None:
                    t = pa.Table.from_batches(found).combine_chunks() if found else None
                    words = t["word"].chunk(0) if found else pa.array([], pa.string())
                    table = t["vector"].chunk(0).flatten().to_numpy().reshape(-1, dim) if found else np.zeros((0, dim), np.float32)
                    found = []
                text, word = _known(run["tokens"], words)
                sums = np.zeros((len(run), dim))
                for a in range(0, len(word), 50_000):
                    some = text[a:a + 50_000]
                    starts = np.flatnonzero(np.diff(some, prepend=-1))
                    sums[some[starts]] += np.add.reduceat(table[word[a:a + 50_000]], starts, dtype=np.float64)
                lengths = pc.fill_null(pc.list_value_length(run["tokens"]), 0).to_numpy()
                sums /= np.maximum(lengths, 1)[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * dim, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*run["row"].flatten(), flat], [*names, added])

        names, added = kept.columns, self.out
        schema = T.StructType([*kept.schema.fields, T.StructField(added, T.ArrayType(T.DoubleType()))])
        out = _dealt(model_rows, text_rows, self.parts).mapInArrow(mean, schema)
        return out.select(*names, array_to_vector(added).alias(added))
