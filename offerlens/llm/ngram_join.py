"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 4-word shingles (64-bit hashes; with fewer
words, its one whole sequence). All sets are put into one order, rarest
shingles first. Two sets of n and m shingles that reach the threshold share at
least ceil(t x n) shingles, so their first n - ceil(t x n) + l shingles in that
order share at least l, for every l >= 1 (and l <= ceil(t x n)).

1. One pass counts shingles in ``COUNTERS`` counters. A shingle's frequency
   among all documents is estimated by its counter, less what the rest of the
   corpus puts into an average one. The counters have the same size for every
   corpus; they only decide the order and the cost, never the result.
2. Each document chooses its own l (up to ``MOST``). Let S(l) be the number of
   other documents that its shingles meet at the places that count (3.), by
   their frequencies. At most S(l) / l documents can share l of them, so the
   cost is S(l) lookups and S(l) / l verifications of n steps. The prefix is
   lengthened where that is cheaper; a document whose rare shingles meet
   nobody stays at l = 1.
3. The prefixes become postings (shingle, place, node). Two nodes of n and m
   shingles that are linked share at least a = ceil(t / (1 + t) x (n + m)), so
   with j = min(l, k) of their own l and k they share j shingles at places
   below n - a + j in the one and below m - a + j in the other. Among sets of
   one size these places are about half of the prefix; near misses, whose own
   shingles fill them, never meet.
4. Groups of similar documents are joined first, without listing their pairs:
   in the postings of a shingle the leader is the node whose shingles are the
   most frequent on average (the original that a group was copied from), in
   later rounds one by hash. Nodes are verified against the ``TRIES`` leaders
   they share most shingles with. Verified links join components, and only
   postings that still hold several components are looked at again.
5. What is left are nodes outside the largest component of a shingle's
   postings. They meet the nodes of the other components there; shared
   shingles are counted, pairs that have enough of them are verified on full
   sets.

Documents with equal sets are one node from the start. Prefixes lose no pair,
so components are those of all links. Joins on frequent shingles have plain
exchanges on both sides, which AQE can split; aggregates combine in the map
tasks.

Cases: null text, and text without words, has an empty set, is linked with
nothing and is its own component; rows with a null id take no part and have a
null component; rows that repeat an id are one document with all their links;
repeated rows are alike; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import join_checked, mix64, pieces, shuffle_partitions, stage, utf8_buffers
from offerlens.llm.minhash_dedup import components, merged, shingle_sets

WORDS, PERCENT = 4, 85
#: Counters of shingles (a power of two), sent by slices of SLICE counters.
COUNTERS, SLICE = 1 << 23, 1 << 16
#: Largest l, and the steps that one lookup of a posting costs where a verification costs one for each shingle.
MOST, LOOKUP = 8, 32.0
#: Most rounds of leaders, and leaders that a node is compared with in each (other pairs are left to the last step). Rounds go on while they at least halve the pairs that are left.
ROUNDS, TRIES = 4, 1
BATCH_BYTES = 500_000


def sets_of(column, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end, sets) of slices of an Arrow text column."""
    raw, off = utf8_buffers(column)
    for a, b in pieces(off, BATCH_BYTES):
        yield a, b, shingle_sets(raw, off[a:b + 1], words)


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (mix64(shingles + np.uint64(0x7F4A7C15)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def counted(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, h1, h2, slice, counts): a row for each document, and rows of the tasks' counters; staged."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for a, b, sets in sets_of(batch.column(1), words):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    flat, at = np.concatenate(sets), np.cumsum(size[full]) - size[full]
                    with np.errstate(over="ignore"):
                        h1[full], h2[full] = np.add.reduceat(flat, at), np.add.reduceat(mix64(flat), at)
                    np.add.at(total, counter_of(flat), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names=names)
        used = [k for k in range(COUNTERS // SLICE) if total[k * SLICE:(k + 1) * SLICE].any()]
        for k in used:
            payload = pa.compress(total[k * SLICE:(k + 1) * SLICE].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([k], pa.int32()), pa.array([payload], pa.binary())], names=names)

    names = ["id", "n", "h1", "h2", "slice", "counts"]
    return stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col))
                 .mapInArrow(run, "id long, n long, h1 long, h2 long, slice int, counts binary"), "join-counted")


def frequencies(rows: DataFrame) -> bytes:
    """Estimated frequency of each counter's shingles, as logarithms in one byte each (COUNTERS bytes, compressed)."""
    import pyarrow as pa

    def add(batches: Iterator) -> Iterator:
        number, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != number:
                    if number is not None:
                        yield done()
                    number, total = k, np.zeros(SLICE, np.int64)
                total += np.frombuffer(pa.decompress(payload, decompressed_size=4 * SLICE, codec="zstd", asbytes=True), np.int32)
        if number is not None:
            yield done()

    slices = rows.where(F.col("slice").isNotNull()).select("slice", "counts")
    summed = slices.repartition(min(COUNTERS // SLICE, shuffle_partitions(rows.sparkSession)), "slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, counts binary")

    def logs(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for payload in batch.column(1).to_pylist():
                n = np.frombuffer(payload, np.int64)
                out.append(np.clip(np.rint(np.log2(np.maximum(n - average, 1)) * 5), 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["slice", "logs"])

    size = rows.agg(F.sum("n")).first()[0] or 0
    average = size / COUNTERS
    table = np.zeros(COUNTERS, np.uint8)
    for r in summed.mapInArrow(logs, "slice int, logs binary").collect():
        table[r.slice * SLICE:(r.slice + 1) * SLICE] = np.frombuffer(r.logs, np.uint8)
    return pa.compress(table.tobytes(), codec="zstd", asbytes=True)


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set it is linked with."""
    return -(-percent * n // 100)


def least_common(n: int, m: int, percent: int) -> int:
    """Shingles that linked sets of ``n`` and ``m`` share at least."""
    return -(-percent * (n + m) // (100 + percent))


def chosen_length(frequency: np.ndarray, n: int, base: int, most: int) -> int:
    """The l of least cost for a set of ``n`` shingles whose ordered frequencies are given; of equals the smallest.

    ``base`` + l places count between sets of this size."""
    upto = np.cumsum(np.maximum(frequency[:base + most] - 1, 0))[base:base + most]
    k = np.arange(1, len(upto) + 1)
    return int(np.argmin(upto * (LOOKUP + n / k))) + 1 if len(upto) else 1


def prefixes(docs: DataFrame, nodes: DataFrame, table: bytes, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(node, n, l, weight, shingles): each node's set size, chosen l, average frequency (on the scale of the logarithms)
    and its first n - ceil(t x n) + l shingles in order; staged."""
    spark = docs.sparkSession
    logs = spark.sparkContext.broadcast(table)
    texts = join_checked(docs.select(F.col(id_col).cast("long").alias("node"), text_col), nodes.select("node").distinct(), ["node"], "left_semi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        log = np.frombuffer(pa.decompress(logs.value, decompressed_size=COUNTERS, codec="zstd", asbytes=True), np.uint8)
        for batch in batches:
            for a, b, sets in sets_of(batch.column(1), words):
                n, l, weight, parts = [], [], [], []
                for s in sets:
                    level = log[counter_of(s)]
                    order = np.lexsort((s, level))
                    least = least_shared(len(s), percent)
                    base = len(s) - least
                    alike = len(s) - least_common(len(s), len(s), percent)
                    k = chosen_length(np.exp2(level[order] / 5.0), len(s), alike, min(MOST, least)) if len(s) else 1
                    n.append(len(s))
                    l.append(k)
                    weight.append(int(level.mean()) if len(s) else 0)
                    parts.append(s[order[:base + k]])
                upto = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(l, pa.int32()), pa.array(weight, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(parts).view(np.int64)))],
                    names=["node", "n", "l", "weight", "shingles"])

    return stage(texts.mapInArrow(run, "node long, n int, l int, weight int, shingles array<long>"), "join-prefixes")


def postings(prefix: DataFrame) -> DataFrame:
    """(shingle, place, node, n, l, weight) of the shingles that stand in several prefixes; staged."""
    one = prefix.select(F.explode("shingles").alias("shingle"))
    # staged, so that the join has plain exchanges on both sides, which AQE can split where a shingle is frequent
    shared = stage(one.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("shingle"), "join-shared")
    rows = prefix.select("node", "n", "l", "weight", F.posexplode("shingles").alias("place", "shingle"))
    return stage(rows.join(shared, "shingle"), "join-postings")


def may_link(n, m, place_n, place_m, need, percent: int):
    """Condition: sets of ``n`` and ``m`` shingles may be linked, and a shingle they share at these places counts towards ``need``."""
    total = n.cast("long") + m
    shared = F.floor((total * percent + 99 + percent) / (100 + percent))  # ceil(t / (1 + t) x total)
    return sizes_fit(n, m, percent) & (place_n < n - shared + need) & (place_m < m - shared + need)


def verified(pairs: DataFrame, docs: DataFrame, name: str, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked; staged. Only texts of nodes in ``pairs`` are read into sets."""
    wanted = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{name}-wanted")
    texts = join_checked(docs.select(F.col(id_col).cast("long").alias("node"), text_col), wanted, ["node"], "left_semi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, sets in sets_of(batch.column(1), words):
                upto = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["node", "set"])

    sets = stage(texts.mapInArrow(run, "node long, set array<long>"), f"{name}-sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    linked = both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent
    # with few pairs, the sets of one side stay where they are
    return stage(join_checked(x, pairs.select("a", "b"), ["a"], "inner").join(y, "b").where(linked).select("a", "b"), f"{name}-links")


def sizes_fit(n, m, percent: int):
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def leader_pairs(placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of round ``k``: for each node the leaders, of other components, that it shares most shingles with; staged."""
    order = F.struct("weight", "node") if k == 1 else F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")
    leaders = stage(placed.groupBy("shingle").agg(F.max(F.struct(order.alias("o"), "node", "label", "n", "l", "place")).alias("x"))
                    .select("shingle", F.col("x.node").alias("leader"), F.col("x.label").alias("of"), F.col("x.n").alias("m"),
                            F.col("x.l").alias("k"), F.col("x.place").alias("at")), f"join-leaders-{k}")
    fits = may_link(F.col("n"), F.col("m"), F.col("place"), F.col("at"), F.least("l", "k"), percent)
    votes = (placed.join(leaders, "shingle").where((F.col("label") != F.col("of")) & fits)
             .groupBy("node", "leader").agg(F.count(F.lit(1)).alias("votes")))
    most = Window.partitionBy("node").orderBy(F.desc("votes"), "leader")
    return stage(votes.withColumn("r", F.row_number().over(most)).where(F.col("r") <= TRIES)
                 .select(F.col("node").alias("a"), F.col("leader").alias("b")), f"join-pairs-{k}")


def still_mixed(placed: DataFrame, label: DataFrame, k: int) -> DataFrame:
    """The postings, with labels, of the shingles that several components hold; staged. ``main``: of the largest of them."""
    now = placed.drop("label", "main", "size").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = now.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = stage(per.groupBy("shingle").agg(F.max(F.struct("k", "label")).alias("x"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("parts"))
                  .where("parts > 1").select("shingle", F.col("x.label").alias("largest"), "size"), f"join-mixed-{k}")
    return stage(now.join(mixed, "shingle").withColumn("main", F.col("label") == F.col("largest")).drop("largest"), f"join-placed-{k}")


def pairs_left(placed: DataFrame) -> int:
    """How many pairs the last step would meet: for each shingle, nodes outside its largest component times all nodes."""
    return placed.where(~F.col("main")).agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("p")).first()["p"] or 0


def cross_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different components that share enough shingles of their prefixes; staged."""
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("place", "node", "n", "l", "label", "main")]
    x = placed.where(~F.col("main")).select("shingle", *side("a"))
    y = placed.select("shingle", *side("b"))
    need = F.least("l_a", "l_b")
    met = (x.join(y, "shingle").where((F.col("label_a") != F.col("label_b")) & (F.col("main_b") | (F.col("node_a") < F.col("node_b")))
                                      & may_link(F.col("n_a"), F.col("n_b"), F.col("place_a"), F.col("place_b"), need, percent))
           .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), need.alias("need")))
    return stage(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"))
                 .where(F.col("shared") >= F.col("need")).select("a", "b"), "join-cross")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n, component): set size and smallest id reachable by links, one row per input row."""
    rows = counted(docs, id_col, text_col, words)
    sigs = rows.where(F.col("slice").isNull()).select("id", "n", "h1", "h2")
    usable = sigs.where(F.col("id").isNotNull() & (F.col("n") > 0))
    # rows of one set are one node, named by the smallest id; an id that stands on several sets names only one of them
    classes = stage(usable.groupBy("h1", "h2", "n").agg(F.min("id").alias("node")), "join-classes")
    members = stage(usable.join(classes, ["h1", "h2", "n"]).select("id", "n", "node").distinct(), "join-members")
    prefix = prefixes(docs, classes, frequencies(rows), id_col, text_col, words, percent)
    if usable.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        prefix = prefix.dropDuplicates(["node", "shingles"])  # an id's repeated texts

    placed = postings(prefix).withColumn("label", F.col("node"))
    label, left = None, None
    for k in range(1, ROUNDS + 1):
        links = verified(leader_pairs(placed, k, percent), docs, f"join-round-{k}", id_col, text_col, words, percent)
        label = merged(label, links, f"join-labels-{k}")
        placed = still_mixed(placed, label, k)
        before, left = left, pairs_left(placed)
        if not left or (before is not None and left * 2 > before):
            break
    links = verified(cross_pairs(placed, percent), docs, "join-last", id_col, text_col, words, percent)

    # rows that repeat an id tie their nodes together
    several = stage(members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(F.col("a") != F.col("b")).select("id", "a"), "join-repeated")
    ties = several.join(members, "id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    label = merged(label, links.unionByName(ties), "join-labels")
    final = members.join(label, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("component"))
    return sigs.select("id", "n").join(final, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
