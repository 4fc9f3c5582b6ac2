"""Toxicity by a convolutional text classifier, trained in numpy.

Words (lower-cased runs of letters) are embedded by hashing twice: the word
and its first ``PREFIX`` letters each pick a row of a table, and the two rows
are added. Filters of several widths slide over the word vectors; rectified
and max-pooled over the whole text they feed a logistic output. Embeddings
start from each row's smoothed log-odds in the training texts and all weights
are then trained by Adagrad, back through the words that won the pooling.

All labelled documents are learned from, whole and in tasks: their hashed words
are written once and dealt into ``VALIDATION`` parts by a hash of the id. Parts
other than 0 are the batches of the fit. A task adds up its documents'
gradients, Spark adds them up by table row, and the driver, which holds nothing
but the model (of fixed size), takes the step. Gradients are added as integers,
so the sums do not depend on how rows lie in tasks.

Thresholds are calibrated by language on part 0, from counts of the outputs in
steps of 1 / ``BINS``: each language (identified from the text, see ``langid``)
gets the threshold with the fewest errors, and scores are shifted so that it
lies at 0.5. Languages with too few examples use the common threshold.

Cases: null and empty texts, and texts without letters, get the score of a
text without words; labels other than 0 and 1 are not learned from, nor are
null texts; an id with several labels counts as toxic if one of them is 1, one
with several texts gives the least of them; without any labels of both kinds
every score is 0; repeated rows get equal scores; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm import langid
from offerlens.llm.common import pieces, span_hashes, utf8_buffers, word_spans
from offerlens.session import stage_path

ROWS, DIM, FILTERS, WIDTHS, PREFIX = 1 << 17, 4, 4, (1, 2, 3), 5
EPOCHS, RATE, VALIDATION = 3, 0.05, 5
BATCH_BYTES = 1_000_000
#: Gradients are added up in units of 1 / UNIT, outputs counted in steps of 1 / BINS within OUTPUT.
UNIT, BINS, OUTPUT = 1 << 24, 1024, 60


def hashed_words(raw: np.ndarray, off: np.ndarray):
    """(word row, prefix row, text number) of every word of some rows' bytes."""
    lower, letter = langid._folded()
    data = raw[off[0]:off[-1]]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    starts, ends, row = word_spans(letter[cp], lead[off - off[0]])
    values = lower[cp].astype(np.uint64) + np.uint64(1)
    word = span_hashes(values, starts, ends, 21) % np.uint64(ROWS)
    prefix = span_hashes(values, starts, np.minimum(ends, starts + PREFIX), 22) % np.uint64(ROWS)
    return word.astype(np.int64), prefix.astype(np.int64), row


@dataclass
class Model:
    """Embedding tables, filters (width -> width*DIM x FILTERS) and the output; thresholds by language."""
    words: np.ndarray
    prefixes: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0

    def logits(self, word: np.ndarray, prefix: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Outputs of ``n`` texts, whose words come in order."""
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        if len(word):
            x = self.words[word] + self.prefixes[prefix]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            for k, w in enumerate(WIDTHS):
                y = np.tile(self.biases[w], (len(x), 1))
                for j in range(min(w, len(x))):
                    part = x @ self.filters[w][j * DIM:(j + 1) * DIM]
                    y[:len(x) - j] += np.where((row[j:] == row[:len(x) - j])[:, None], part[j:], 0)
                pooled[row[first], k * FILTERS:(k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, first), 0)
        return pooled @ self.out + self.out_bias


def rows_of(binary) -> tuple[np.ndarray, np.ndarray]:
    """The packed numbers of an Arrow binary column, one after another, and the offsets of its rows."""
    cells = [np.frombuffer(x, np.int32) for x in binary.to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(x) for x in cells], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(cells) if cells else np.zeros(0, np.int32)).astype(np.int64), off


def initial(counts: np.ndarray, totals: np.ndarray, seed: int = 3) -> Model:
    """Embeddings from smoothed log-odds, small random weights elsewhere; rows never seen are zero.

    ``counts`` has the texts of each label with a row of either table (label x 2 * ROWS), ``totals`` those of each label."""
    rng = np.random.default_rng(seed)
    tables = []
    for which in (0, 1):
        mine = counts[:, which * ROWS:(which + 1) * ROWS]
        odds = np.log((mine[1] + 0.5) / (totals[1] + 1)) - np.log((mine[0] + 0.5) / (totals[0] + 1))
        seen = mine.sum(0)
        table = rng.normal(0, 0.02, (ROWS, DIM)) * (seen > 0)[:, None]
        table[:, 0] = odds * seen / (seen + 8) / 4
        tables.append(table)
    filters, biases = {}, {}
    for w in WIDTHS:
        f = rng.normal(0, 0.2, (w * DIM, FILTERS))
        f[0::DIM] += 0.7 / w
        filters[w], biases[w] = f, np.full(FILTERS, -0.1)
    return Model(*tables, filters, biases, np.full(len(WIDTHS) * FILTERS, 0.5), -2.0)


def flat(m: Model) -> np.ndarray:
    """All weights in rows of DIM: words, prefixes, then filters, biases and output."""
    rest = np.concatenate([*[m.filters[w].ravel() for w in WIDTHS], *[m.biases[w] for w in WIDTHS], m.out, [m.out_bias]])
    return np.concatenate([m.words, m.prefixes, np.append(rest, np.zeros(-len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float64)


def unflat(weights: np.ndarray, kind=np.float64) -> Model:
    """The model of weights as ``flat`` lays them out."""
    weights = weights.astype(kind)
    rest, at, filters, biases = weights[2 * ROWS:].ravel(), 0, {}, {}
    for w in WIDTHS:
        filters[w] = rest[at:at + w * DIM * FILTERS].reshape(w * DIM, FILTERS)
        at += w * DIM * FILTERS
    for w in WIDTHS:
        biases[w] = rest[at:at + FILTERS]
        at += FILTERS
    n = len(WIDTHS) * FILTERS
    return Model(weights[:ROWS], weights[ROWS:2 * ROWS], filters, biases, rest[at:at + n], float(rest[at + n]))


def add_gradients(m: Model, word: np.ndarray, prefix: np.ndarray, off: np.ndarray, labels: np.ndarray, total: np.ndarray) -> None:
    """Add the log-loss gradients of some texts to ``total`` (laid out as by ``flat``), in whole units."""
    n, units = len(labels), lambda g: np.rint(g * UNIT).astype(np.int64)
    pooled, at = np.zeros((n, len(WIDTHS) * FILTERS)), np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
    row = np.repeat(np.arange(n), np.diff(off))
    full = np.flatnonzero(np.diff(off))
    x = m.words[word] + m.prefixes[prefix]
    for k, w in enumerate(WIDTHS):
        if not len(x):
            break
        y = np.tile(m.biases[w], (len(x), 1))
        for j in range(min(w, len(x))):
            part = x @ m.filters[w][j * DIM:(j + 1) * DIM]
            y[:len(x) - j] += np.where((row[j:] == row[:len(x) - j])[:, None], part[j:], 0)
        most = np.zeros((n, FILTERS))
        most[full] = np.maximum.reduceat(y, off[full])
        for f in range(FILTERS):
            hit = np.flatnonzero(y[:, f] == most[row, f])
            first = hit[np.append(True, row[hit[1:]] != row[hit[:-1]])]  # the first word that wins in each text
            pooled[full, k * FILTERS + f], at[full, k * FILTERS + f] = np.maximum(most[full, f], 0), first
    z = (pooled * m.out).sum(1) + m.out_bias
    d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
    back = d[:, None] * m.out * (pooled > 0)
    rest, down = [], []
    for k, w in enumerate(WIDTHS):
        g_filter = np.zeros((w * DIM, FILTERS), np.int64)
        for f in range(FILTERS):
            won = np.flatnonzero(back[:, k * FILTERS + f])
            g = back[won, k * FILTERS + f]
            for j in range(w):
                place = at[won, k * FILTERS + f] + j
                inside = place < off[won + 1]
                place, gj = place[inside], g[inside, None]
                weights = slice(j * DIM, (j + 1) * DIM)
                g_filter[weights, f] = units(gj * x[place]).sum(0)
                change = units(gj * m.filters[w][weights, f])
                np.add.at(total, word[place], change)
                np.add.at(total, ROWS + prefix[place], change)
        rest.append(g_filter.ravel())
        down.append(units(back[:, k * FILTERS:(k + 1) * FILTERS]).sum(0))
    values = np.concatenate([*rest, *down, units(d[:, None] * pooled).sum(0), [units(d).sum()]])
    total[2 * ROWS:] += np.append(values, np.zeros(-len(values) % DIM, np.int64)).reshape(-1, DIM)


def best_threshold(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap between outputs at which the fewest labels are wrong.

    ``bins`` (whole steps of 1 / BINS, each once) hold ``clean`` and ``toxic`` texts."""
    order = np.argsort(bins)
    bins, clean, toxic = bins[order], clean[order], toxic[order]
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    edges = np.concatenate([[bins[0] - BINS], (bins[1:] + bins[:-1] + 1) / 2, [bins[-1] + 1 + BINS]])
    gaps = np.concatenate([[2 * BINS], np.diff(bins) - 1, [2 * BINS]])
    best = np.flatnonzero(wrong == wrong.min())
    return float(edges[best[np.argmax(gaps[best])]] / BINS)


def summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums) of rows (slot, several longs), added up by slot: no more rows than the model has."""
    names = parts.columns[1:]
    got = parts.groupBy("slot").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    return got["slot"].to_numpy(), np.stack([got[x].to_numpy() for x in names], 1)


def _slots(total: np.ndarray, names: list[str]):
    """The rows of ``total`` that are not zero, as a batch (slot, longs)."""
    import pyarrow as pa

    slot = np.flatnonzero(total.any(1))
    return pa.RecordBatch.from_arrays([pa.array(slot), *[pa.array(total[slot, i]) for i in range(total.shape[1])]], names=["slot", *names])


def text_counts(rows: DataFrame) -> DataFrame:
    """(slot, clean, toxic): texts of each label with a table row, added up by task."""
    def run(batches: Iterator) -> Iterator:
        total = np.zeros((2 * ROWS, 2), np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for column, shift in ((1, 0), (2, ROWS)):
                slot, off = rows_of(batch.column(column))
                one = np.unique(np.repeat(np.arange(len(y)), np.diff(off)) * ROWS + slot)  # a text counts once
                np.add.at(total, (shift + one % ROWS, y[one // ROWS]), 1)
        yield _slots(total, ["clean", "toxic"])

    return rows.select("y", "words", "prefixes").mapInArrow(run, "slot long, clean long, toxic long")


def gradients(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, gradients) of the summed log-loss over ``rows``."""
    names = [f"g{i}" for i in range(DIM)]
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator) -> Iterator:
        model, total = unflat(shared.value), np.zeros(shared.value.shape, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            (word, off), (prefix, _) = rows_of(batch.column(1)), rows_of(batch.column(2))
            for a, b in pieces(off, BATCH_BYTES // 8):
                add_gradients(model, word[off[a]:off[b]], prefix[off[a]:off[b]], off[a:b + 1] - off[a], y[a:b], total)
        yield _slots(total, names)

    try:
        slot, total = summed(rows.select("y", "words", "prefixes").mapInArrow(run, "slot long, " + ", ".join(f"{x} long" for x in names)))
    finally:
        shared.destroy()
    return slot, total / UNIT


def fit(batches: list[DataFrame], totals: np.ndarray) -> Model:
    """Train on tables (y, words, prefixes), one Adagrad step for each table and round."""
    slot, counted = summed(text_counts(reduce(DataFrame.unionAll, batches)))
    counts = np.zeros((2, 2 * ROWS))
    counts[:, slot] = counted.T
    weights = flat(initial(counts, totals))
    squares = np.ones(weights.shape)
    for _ in range(EPOCHS):
        for rows in batches:
            slot, g = gradients(rows, weights)
            squares[slot] += g * g
            weights[slot] -= RATE * g / np.sqrt(squares[slot])
    return unflat(weights, np.float32)


def output_counts(rows: DataFrame, model: Model) -> list:
    """Rows (lang, bin, clean, toxic): texts by identified language and output."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            (word, off), (prefix, _) = rows_of(batch.column(2)), rows_of(batch.column(3))
            z = [np.zeros(0)]
            for a, b in pieces(off, BATCH_BYTES // 8):
                row = np.repeat(np.arange(b - a), np.diff(off[a:b + 1]))
                z.append(shared.value.logits(word[off[a]:off[b]], prefix[off[a]:off[b]], row, b - a))
            bins = np.floor(np.clip(np.concatenate(z), -OUTPUT, OUTPUT) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bins), batch.column(0)], names=["lang", "bin", "y"])

    found = rows.select("y", "lang", "words", "prefixes").mapInArrow(run, "lang string, bin long, y int")
    return found.groupBy("lang", "bin").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic")).collect()


def train(table: DataFrame, least: int = 30) -> Model | None:
    """Fit on the rows (part, y, lang, words, prefixes) of other parts than 0 and calibrate thresholds by language on part 0."""
    sizes = np.zeros((VALIDATION, 2), np.int64)
    for r in table.groupBy("part", "y").count().collect():
        sizes[r["part"], r["y"]] = r["count"]
    if not sizes.sum(0).all():
        return None
    alone = not sizes[1:].sum(0).all()  # too few texts to keep some from the fit
    used = [p for p in range(0 if alone else 1, VALIDATION) if sizes[p].any()]
    model = fit([table.where(F.col("part") == p) for p in used], sizes[used].sum(0))
    if not alone and sizes[0].any():
        rows = output_counts(table.where("part = 0"), model)
        lang, bins = np.array([r["lang"] for r in rows]), np.array([r["bin"] for r in rows])
        count = np.array([(r["clean"], r["toxic"]) for r in rows])
        if sizes[0].all():
            each, of = np.unique(bins, return_inverse=True)
            both = np.zeros((len(each), 2), np.int64)
            np.add.at(both, of, count)
            model.threshold = best_threshold(each, both[:, 0], both[:, 1])
        for name in sorted(set(lang.tolist())):
            mine = lang == name
            if count[mine].sum(0).min() >= least:
                model.thresholds[name] = best_threshold(bins[mine], count[mine, 0], count[mine, 1])
    return model


_PREPARED = "y int, lang string, words binary, prefixes binary, part int"


def prepared(texts: DataFrame, samples: langid.Samples) -> DataFrame:
    """(y, lang, words, prefixes, part) of (text, y, part): hashed words as packed numbers, and for part 0 the identified language."""
    names = [k for k, _ in samples.langs] + [langid.UNKNOWN]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        built = langid.parser(samples) if samples.langs else None
        for batch in batches:
            raw, off = utf8_buffers(batch.column(0))
            held = batch.column(2).to_numpy() == 0
            for a, b in pieces(off, BATCH_BYTES):
                word, prefix, row = hashed_words(raw, off[a:b + 1])
                cut = np.searchsorted(row, np.arange(b - a + 1))
                lang = np.full(b - a, langid.UNKNOWN, object)
                if samples.langs and held[a:b].any():
                    mine = utf8_buffers(batch.column(0).slice(a, b - a).filter(pa.array(held[a:b])))
                    lang[held[a:b]] = [names[i] for i in langid.identify(built, *mine)[0].tolist()]
                packed = [pa.array([x[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in (word, prefix)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(lang, pa.string()), *packed, batch.column(2).slice(a, b - a)],
                                                 names=["y", "lang", "words", "prefixes", "part"])

    return texts.mapInArrow(run, _PREPARED)


def learn(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", lang_col: str = "lang") -> tuple[Model | None, langid.Samples]:
    """The model and the language samples, from all rows where ``usable(id column)`` holds."""
    spark = docs.sparkSession
    known = (labels.where(usable(F.col(id_col)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    samples = langid.learn(docs, usable(F.col(id_col)), id_col, text_col, lang_col)
    # one text for each id, however many rows it has: joined and grouped by one shuffle of the usable texts
    texts = (docs.where(usable(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known.hint("merge"), "id")
             .groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    part = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(VALIDATION)).cast("int")
    path = stage_path(spark, "toxicity-words")
    prepared(texts.select("text", "y", part.alias("part")), samples).write.option("compression", "zstd").partitionBy("part").parquet(path)
    return train(spark.read.schema(_PREPARED).parquet(path)), samples


def score(docs: DataFrame, model: Model | None, samples: langid.Samples, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= 0.5)."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    at = keep.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, samples))  # of fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, samples = shared.value
        names = [k for k, _ in samples.langs] + [langid.UNKNOWN]
        built = langid.parser(samples) if samples.langs else None
        for batch in batches:
            raw, off = utf8_buffers(batch.column(at))
            out = []
            for a, b in pieces(off, BATCH_BYTES):
                if model is None:
                    out.append(np.zeros(b - a))
                    continue
                z = model.logits(*hashed_words(raw, off[a:b + 1]), b - a).astype(np.float64)
                lang = langid.identify(built, raw, off[a:b + 1])[0] if samples.langs else np.full(b - a, -1)
                shift = np.array([model.thresholds.get(k, model.threshold) for k in names])
                out.append(1 / (1 + np.exp(-np.clip(z - shift[lang], -60, 60))))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)
