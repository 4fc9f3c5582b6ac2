"""MinHash near-dedup with tensored banding.

A document's set holds its distinct 5-word shingles (64-bit hashes; with
fewer words, its one whole sequence). Two collections of ``GROUPS`` half keys
are made, each half key from ``WIDTH`` minhashes; table (i, j) is keyed by the
pair of left half key i and right half key j. GROUPS^2 tables thus cost
2 x GROUPS x WIDTH minhashes instead of GROUPS^2 x 2 x WIDTH. Two sets of
similarity s share a table with probability (1 - (1 - s^WIDTH)^GROUPS)^2,
99.95 % at 0.75 with the defaults and more above.

Documents with equal sets are one node from the start. Candidates are checked
in rounds, without ever listing the pairs of a group:

1. In every bucket a leader is chosen, first the node that shares most buckets
   with others (the original that a group was copied from), in later rounds
   one by hash. Each node outside the leader's component is compared with the
   ``TRIES`` leaders with which it shares most tables. Confirmed links join
   components, and only buckets that still hold several are looked at again.
2. What is left are pairs from different components in one bucket. In buckets
   of up to ``SLICE`` nodes, those outside the largest component meet all
   others. A pair is taken up in the first table it shares, and only if its
   sketches (one permutation, ``BINS`` bins) estimate a similarity of at least
   ``LEAST_ESTIMATE``, more than 7 standard errors below 0.75.
3. In larger buckets that would be a number of pairs that grows with the square
   of the group, nearly all of them near misses (copies with too many changes).
   Their nodes meet where they share enough of their rarest shingles, by the
   multi-match prefixes of ``ngram_join``: near misses, whose own shingles
   fill the places that count, never meet.

Every link is confirmed on full sets. A group of copies that makes up a third
of all rows is one node; a group of near copies is soon one component. Joins
on hot keys are split by AQE, aggregates combine in the map tasks.

Cases: null text, and text without words, has an empty set, is linked with
nothing and is its own component; rows with a null id take no part and have a
null component; rows that repeat an id are one node with all their links;
repeated rows are alike; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import (SPACE_BYTES, byte_table, join_checked, lower_ascii, mix64, pieces, seeded,
                                  span_hashes, stage, utf8_buffers, word_spans)

WORDS, GROUPS, WIDTH = 5, 10, 2
#: Links hold where 100 x intersection >= PERCENT x union.
PERCENT = 75
#: Bins of a node's sketch, the least similarity estimated from two sketches, and the set size from which they are asked.
BINS, LEAST_ESTIMATE, LEAST_SIZE = 512, 0.60, 24
#: Rounds of leaders, and leaders that a node is compared with in each.
ROUNDS, TRIES = 2, 2
#: Nodes of a bucket up to which the last step compares their sketches pair by pair.
SLICE = 64
BATCH_BYTES = 1_000_000


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles of ``size`` words."""
    data = lower_ascii()[raw[off[0]:off[-1]]]
    rows = off - off[0]
    starts, ends, row = word_spans(~byte_table(SPACE_BYTES)[data], rows)
    first = np.searchsorted(row, np.arange(len(off)))
    with np.errstate(over="ignore"):
        words = span_hashes(data, starts, ends)
        salts = seeded(size, 99)
        n = max(0, len(words) - size + 1)
        windows = np.zeros(n, np.uint64)
        for k in range(size):
            windows += mix64(words[k:k + n] + salts[k]) if n else np.uint64(0)
        windows = mix64(windows)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(windows[a:b - size + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for k in range(b - a):
                    short = short + mix64(words[a + k:a + k + 1] + salts[k])
                out.append(mix64(short + np.uint64(0x5151)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sets(column) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    raw, off = utf8_buffers(column)
    for a, b in pieces(off, BATCH_BYTES):
        yield a, b, shingle_sets(raw, off[a:b + 1])


SIGNATURE = "id long, n long, h1 long, h2 long, left array<long>, right array<long>, sketch binary"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, left, right, sketch): set size and 128-bit hash, half keys, one-permutation sketch.

    The last three are null for an empty set."""
    m = 2 * GROUPS * WIDTH
    seeds, odd = seeded(m, 7), seeded(m, 8) | np.uint64(1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, sets in _sets(batch.column(1)):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                flat = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
                at = np.cumsum(size[full]) - size[full]
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                mins = np.zeros((len(full), m), np.uint64)
                with np.errstate(over="ignore"):
                    if len(full):
                        h1[full] = np.add.reduceat(flat, at)
                        h2[full] = np.add.reduceat(mix64(flat), at)
                        for k in range(m):
                            mins[:, k] = np.minimum.reduceat((flat ^ seeds[k]) * odd[k], at)
                    mins = mix64(mins)
                    halves = mins[:, 0:m:WIDTH].copy()
                    for k in range(1, WIDTH):
                        halves = mix64(halves + mins[:, k:m:WIDTH] * np.uint64(2 * k + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     _lists(size > 0, halves[:, :GROUPS].view(np.int64)), _lists(size > 0, halves[:, GROUPS:].view(np.int64)),
                     _sketches(size, flat)], names=["id", "n", "h1", "h2", "left", "right", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, SIGNATURE)


def _sketches(size: np.ndarray, flat: np.ndarray):
    """For each non-empty set, of its smallest hash in every bin one byte that is not 0; null for empty sets."""
    import pyarrow as pa

    full = np.flatnonzero(size)
    out = np.zeros((len(full), BINS), np.uint8)
    if len(full):
        row = np.repeat(np.arange(len(full)), size[full])
        place = row * BINS + (flat >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)  # sets are sorted, so a bin's first is its smallest
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        out.ravel()[place[first]] = 1 + (flat[first] >> np.uint64(24)) % np.uint64(255)
    upto = np.concatenate([[0], np.cumsum((size > 0) * BINS)]).astype(np.int32)
    valid = pa.array(size > 0)
    return pa.Array.from_buffers(pa.binary(), len(size), [valid.buffers()[1], pa.py_buffer(upto.tobytes()), pa.py_buffer(out.tobytes())])


def _lists(present: np.ndarray, values: np.ndarray):
    """A row of ``values`` for each present row, null for the others."""
    import pyarrow as pa

    upto = np.concatenate([[0], np.cumsum(present * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.ascontiguousarray(values).ravel()),
                                    mask=pa.array(~present))


def table_keys(nodes: DataFrame) -> DataFrame:
    """(node, table, key) of all GROUPS^2 tables."""
    keys = F.flatten(F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(x, y, i * GROUPS + j))))
    return nodes.select("node", F.posexplode(keys).alias("table", "key"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b), label the smallest node reachable; staged.

    Each round takes the smallest label among the neighbours and then the
    label's own label, so chains shorten geometrically."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-0")
    for k in range(1, 200):
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = stage(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("new"), "label"), f"{name}-{k}")
        changed = after.where(F.col("new") != F.col("label")).limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def confirmed(pairs: DataFrame, docs: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets are linked; staged. Only texts of nodes in ``pairs`` are read into sets."""
    wanted = stage(pairs.select(F.col("a").alias(id_col)).union(pairs.select(F.col("b").alias(id_col))).distinct(),
                   f"{name}-wanted")
    texts = join_checked(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), wanted, [id_col], "left_semi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, sets in _sets(batch.column(1)):
                upto = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "set"])

    sets = stage(texts.mapInArrow(run, "node long, set array<long>"), f"{name}-sets")
    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    linked = shared * 100 >= (F.size("x") + F.size("y") - shared) * PERCENT
    return stage(pairs.select("a", "b").join(x, "a").join(y, "b").where(linked).select("a", "b"), f"{name}-links")


def leader_pairs(placed: DataFrame, k: int) -> DataFrame:
    """Pairs (node, leader) of round ``k`` from (key, node, label, weight): for each node the leaders,
    from other components, with which it shares most buckets. Staged."""
    order = F.struct("weight", "node") if k == 1 else F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")
    leaders = stage(placed.groupBy("key").agg(F.max(F.struct(order.alias("o"), "node", "label")).alias("x"))
                    .select("key", F.col("x.node").alias("leader"), F.col("x.label").alias("of")), f"leaders-{k}")
    votes = (placed.join(leaders, "key").where(F.col("label") != F.col("of"))
             .groupBy("node", "leader").agg(F.count(F.lit(1)).alias("votes")))
    most = Window.partitionBy("node").orderBy(F.desc("votes"), "leader")
    return stage(votes.withColumn("r", F.row_number().over(most)).where(F.col("r") <= TRIES)
                 .select(F.col("node").alias("a"), F.col("leader").alias("b")), f"pairs-{k}")


def merged(label: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """(node, label) after joining the components of ``links``; nodes without a link are their own label."""
    if label is None:
        return components(links, name)
    x, y = (label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
    outer = (links.join(x, "a", "left").join(y, "b", "left")
             .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where(F.col("a") != F.col("b")))
    found = components(outer, name).select(F.col("node").alias("l"), F.col("label").alias("to"))
    old = label.join(found, F.col("label") == F.col("l"), "left").select("node", F.coalesce("to", "label").alias("label"))
    new = found.select(F.col("l").alias("node"), F.col("to").alias("label")).join(label.select("node"), "node", "left_anti")
    return stage(old.unionByName(new), f"{name}-all")


def still_mixed(buckets: DataFrame, label: DataFrame, k: int) -> DataFrame:
    """The rows, with labels, of the buckets that hold several components. Staged."""
    now = buckets.join(label, "node", "left").select("key", "table", "node", "weight", F.coalesce("label", "node").alias("label"))
    mixed = stage(now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
                  .where(F.col("x") != F.col("y")).select("key"), f"mixed-{k}")
    return stage(now.join(mixed, "key", "left_semi"), f"placed-{k}")


def bucket_sizes(placed: DataFrame) -> DataFrame:
    """(key, largest, size): the largest component and the nodes of every mixed bucket. Staged."""
    per = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    return stage(per.groupBy("key").agg(F.max(F.struct("k", "label"))["label"].alias("largest"), F.sum("k").alias("size")), "largest")


def cross_pairs(placed: DataFrame, sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: in buckets of up to SLICE nodes, the pairs from different components whose sketches are alike, each in the first table it shares."""
    small = sizes.where(F.col("size") <= SLICE).select("key", "largest")
    rows = (placed.select("key", "table", "node", "label").join(small, "key").join(nodes, "node")
            .withColumn("main", F.col("label") == F.col("largest")))
    columns = ["key", "main", "table", "node", "label", "n", "left", "right", "sketch"]
    dealt = rows.select(*columns).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare_slices, "a long, b long").distinct()


def shingle_pairs(placed: DataFrame, sizes: DataFrame, label: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(a, b), a < b: the pairs from different components, among the nodes of buckets of more than SLICE, that share
    enough of their rarest shingles (the prefixes of ``ngram_join``, which lose no link). None without such buckets."""
    from offerlens.llm import ngram_join

    large = stage(placed.join(sizes.where(F.col("size") > SLICE).select("key"), "key", "left_semi").select("node").distinct(), "large")
    if not large.limit(1).count():
        return None
    texts = join_checked(docs.select(F.col(id_col).cast("long").alias("node"), text_col), large, ["node"], "left_semi")
    frequencies = ngram_join.frequencies(ngram_join.counted(texts, "node", text_col, WORDS))
    prefix = ngram_join.prefixes(docs, large, frequencies, id_col, text_col, WORDS, PERCENT).dropDuplicates(["node", "shingles"])
    mixed = ngram_join.still_mixed(ngram_join.postings(prefix), label, "last")
    return ngram_join.cross_pairs(mixed, PERCENT)


def _compare_slices(batches: Iterator) -> Iterator:
    """Streams the buckets; holds those of one batch at a time."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        cuts = _slice_cuts(table)
        if len(cuts) > 2:
            yield _compared(table, cuts[:-1])
        rest = table.slice(int(cuts[-2])) if len(cuts) > 1 else None
    if rest is not None and rest.num_rows:
        rest = rest.combine_chunks()
        yield _compared(rest, _slice_cuts(rest))


def _slice_cuts(table) -> np.ndarray:
    """Where buckets begin, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    v = table.column("key").to_numpy()
    new[1:] = v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _compared(table, cuts: np.ndarray):
    """The pairs of all buckets between ``cuts`` as a record batch."""
    import pyarrow as pa

    stop = int(cuts[-1])
    col = {c: table.column(c).to_numpy()[:stop] for c in ("main", "table", "node", "label", "n")}

    def matrix(name, width, kind):
        data = table.column(name).chunk(0).slice(0, stop) if stop else None
        if data is None:
            return np.zeros((0, width), kind)
        if name == "sketch":
            off = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + stop + 1]
            return np.frombuffer(data.buffers()[2], np.uint8)[off[0]:off[-1]].reshape(stop, width)
        return data.flatten().to_numpy(zero_copy_only=False).reshape(stop, width)

    left, right, sketch = matrix("left", GROUPS, np.int64), matrix("right", GROUPS, np.int64), matrix("sketch", BINS, np.uint8)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        x, y = np.arange(a, b), a + np.flatnonzero(~col["main"][a:b])
        step = max(1, 32_000_000 // (BINS * max(1, len(x))))
        for k in range(0, len(y), step):
            out.append(_alike(x, y[k:k + step], col, left, right, sketch))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(1, initial=np.iinfo(np.int64).max)), pa.array(pairs.max(1, initial=np.iinfo(np.int64).min))],
                                      names=["a", "b"])


def _alike(x: np.ndarray, y: np.ndarray, col: dict, left: np.ndarray, right: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Node pairs (rows x columns 2) of rows ``x`` and ``y`` that are worth comparing in full."""
    n, node, label = col["n"], col["node"], col["label"]
    small, large = np.minimum(n[x][:, None], n[y][None]), np.maximum(n[x][:, None], n[y][None])
    ok = (label[x][:, None] != label[y][None]) & (col["main"][x][:, None] | (node[x][:, None] < node[y][None]))
    ok &= small * 100 >= large * PERCENT
    if not ok.any():
        return np.zeros((0, 2), np.int64)
    sx, sy = sketch[x], sketch[y]
    same = np.count_nonzero((sx[:, None, :] == sy[None]) & (sx != 0)[:, None, :], 2)
    fx, fy = (sx != 0).astype(np.float32), (sy != 0).astype(np.float32)
    either = fx.sum(1)[:, None] + fy.sum(1)[None] - fx @ fy.T
    ok &= (same >= LEAST_ESTIMATE * either) | (small < LEAST_SIZE)
    i, j = np.nonzero(ok)
    i, j = x[i], y[j]
    first = (left[i] == left[j]).argmax(1) * GROUPS + (right[i] == right[j]).argmax(1)
    kept = first == col["table"][i]
    return np.stack([node[i[kept]], node[j[kept]]], 1)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component): set size and smallest id of the near-duplicate group, one row per input row."""
    sigs = stage(signatures(docs, id_col, text_col), "signatures")
    usable = sigs.where(F.col("id").isNotNull() & (F.col("n") > 0))
    # rows of one set, and rows of one id, are one node: the smallest id
    classes = stage(usable.groupBy("h1", "h2", "n").agg(F.min("id").alias("node")), "classes")
    members = stage(usable.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"]).select("id", "n", "node").distinct(), "members")
    nodes = stage(usable.join(members.select("node").distinct(), F.col("id") == F.col("node"), "left_semi")
                  .select(F.col("id").alias("node"), "n", "left", "right", "sketch").distinct(), "nodes")

    keys = table_keys(nodes)
    # staged, so that the joins on keys have plain exchanges on both sides, which AQE can split where a key is hot
    shared = stage(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("size"))
                   .where(F.col("least") != F.col("most")).select("key", "size"), "shared-keys")
    buckets = stage(keys.join(shared, "key"), "buckets")  # of several nodes each
    weight = stage(buckets.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    placed = stage(buckets.join(weight, "node").select("key", "table", "node", F.col("node").alias("label"), "weight"), "placed-0")
    label = None
    for k in range(1, ROUNDS + 1):
        links = confirmed(leader_pairs(placed, k), docs, f"round-{k}", id_col, text_col)
        label = merged(label, links, f"labels-{k}")
        placed = still_mixed(placed.drop("label"), label, k)

    sizes = bucket_sizes(placed)
    pairs, more = cross_pairs(placed, sizes, nodes), shingle_pairs(placed, sizes, label, docs, id_col, text_col)
    pairs = stage(pairs if more is None else pairs.union(more).distinct(), "pairs")
    links = confirmed(pairs, docs, "last", id_col, text_col)

    # rows that repeat an id tie their nodes together
    several = stage(members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
                    .where(F.col("a") != F.col("b")).select("id", "a"), "repeated-ids")
    ties = several.join(members, "id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    label = merged(label, links.unionByName(ties), "labels")
    final = members.join(label, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("component"))
    return (sigs.select("id", "n").join(final, "id", "left")
            .select("id", "n", F.coalesce("component", "id").alias("component")))
