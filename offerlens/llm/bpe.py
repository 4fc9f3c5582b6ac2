"""BPE encoding and decoding through a table of distinct words.

1. Tasks split texts into words (the tokenizer's own pre-tokenisation, done on
   arrays of code points) and number the distinct words of a block of
   documents. A block sends each distinct word once, packed with others of the
   same hash bucket.
2. Dealt by bucket, all blocks' copies of a word meet in one task, which
   encodes each distinct word once. A word has one row from each block however
   often it occurs, so frequent words make no hot key.
3. Dealt by block, the ids meet the block's documents, which are sent as
   sequences of word numbers, and are joined back by position.

Decoding joins ids with the id-to-piece table, which has one row per id of the
vocabulary and is therefore the same size for any input, and strings the
pieces' bytes together.

A word never spans a special token; a special token's text is encoded as that
token, as the tokenizer does. Blocks are numbered by partition and position,
so the documents should come from a table (or a checkpoint), not straight
from a shuffle.

Cases: null and empty texts have no ids and decode to the empty text; very
long texts are blocks of their own; rows of null or repeated id are encoded
each by itself; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import pieces, shuffle_partitions, span_hashes, utf8_buffers

#: Tokens in a block; bytes split at once, whose word numbers make one packed row (splitting needs some 50 bytes for each).
BLOCK_TOKENS, SPLIT_BYTES = 1_500_000, 250_000
#: Ids decoded at once.
DECODE_IDS = 300_000

#: FIXED VALUES: white space of the tokenizer's pattern.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: FIXED VALUES: letters (L) and numbers (N) of Unicode 16 that Python's tables lack.
LATER = (
    ("L", 0x1C89, 0x1C8A), ("L", 0xA7CB, 0xA7CD), ("L", 0xA7DA, 0xA7DC), ("L", 0x105C0, 0x105F3), ("N", 0x10D40, 0x10D49),
    ("L", 0x10D4A, 0x10D65), ("L", 0x10D6F, 0x10D85), ("L", 0x10EC2, 0x10EC4), ("L", 0x11380, 0x11389),
    ("L", 0x1138B, 0x1138B), ("L", 0x1138E, 0x1138E), ("L", 0x11390, 0x113B5), ("L", 0x113B7, 0x113B7),
    ("L", 0x113D1, 0x113D1), ("L", 0x113D3, 0x113D3), ("N", 0x116D0, 0x116E3), ("L", 0x11BC0, 0x11BE0),
    ("N", 0x11BF0, 0x11BF9), ("L", 0x13460, 0x143FA), ("L", 0x16100, 0x1611D), ("N", 0x16130, 0x16139),
    ("L", 0x16D40, 0x16D6C), ("N", 0x16D70, 0x16D79), ("L", 0x18CFF, 0x18CFF), ("N", 0x1CCF0, 0x1CCF9),
    ("L", 0x1E5D0, 0x1E5ED), ("L", 0x1E5F0, 0x1E5F0), ("N", 0x1E5F1, 0x1E5FA),
)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def classes() -> np.ndarray:
    """Class of every code point in the split pattern."""
    t = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            t[i] = LETTER
        elif major == "N":
            t[i] = NUMBER
    for kind, a, b in LATER:
        t[a:b + 1] = LETTER if kind == "L" else NUMBER
    t[list(SPACES)] = SPACE
    return t


def split_points(cp: np.ndarray, rows: np.ndarray, specials: list[tuple[int, int]] = ()) -> np.ndarray:
    """Starts of the words in code points ``cp``; ``rows`` are the starts of texts.

    The pattern: contractions | optional blank + letters | optional blank +
    numbers | optional blank + others | white space not followed by a word |
    white space."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[cp]
    first = np.zeros(n, bool)
    first[rows[rows < n]] = True
    for a, b in specials:
        first[a] = True
        if b < n:
            first[b] = True
    change = first.copy()
    change[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    start = change & space
    begin = np.flatnonzero(change & ~space)
    after_space = np.zeros(len(begin), bool)
    inner = begin > 0
    after_space[inner] = space[begin[inner] - 1]
    after_space &= ~first[begin]
    start[begin[after_space] - 1] = True
    own = ~after_space
    own[after_space] = cp[begin[after_space] - 1] != 0x20
    start[begin[own]] = True
    quotes = np.flatnonzero(start[:-1] & (cp[:-1] == 0x27) & change[:-1] & (cls[1:] == LETTER) & ~first[1:])
    if len(quotes):
        a = cp[quotes + 1]
        two = np.where(quotes + 2 < n, cp[np.minimum(quotes + 2, n - 1)], 0)
        two[(quotes + 2 < n) & first[np.minimum(quotes + 2, n - 1)]] = 0
        length = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, 0)
        for x, y in ("re", "ve", "ll"):
            length[(a == ord(x)) & (two == ord(y))] = 3
        quotes, length = quotes[length > 0], length[length > 0]
        start[quotes + 1] = False
        ends = quotes + length
        start[ends[ends < n]] = True
    for a, b in specials:
        start[a + 1:b] = False
    return np.flatnonzero(start)


def _split(raw: np.ndarray, off: np.ndarray, special: list[str]):
    """(text, word starts, word ends, words per row) of some rows' bytes."""
    data = raw[off[0]:off[-1]]
    text = data.tobytes().decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    rows = lead[off - off[0]]
    marks = []
    for s in special:
        at = text.find(s)
        while at >= 0:
            if np.searchsorted(rows, at, "right") == np.searchsorted(rows, at + len(s) - 1, "right"):
                marks.append((at, at + len(s)))
                at = text.find(s, at + len(s))
            else:
                at = text.find(s, at + 1)
    starts = split_points(cp, rows[:-1], marks)
    ends = np.append(starts[1:], len(cp)) if len(starts) else starts
    per_row = np.diff(np.searchsorted(starts, rows))
    return text, cp, starts, ends, per_row


def _pack(*arrays) -> bytes:
    """Arrays as one compressed value; unsigned 32-bit numbers are stored by byte plane."""
    import pyarrow as pa

    head, body = [], []
    for a in arrays:
        if isinstance(a, bytes):
            head.append(["b", len(a)])
            body.append(a)
        elif a.dtype == np.uint32:
            head.append(["u", len(a)])
            body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes())
        else:
            head.append([a.dtype.str, a.nbytes])
            body.append(a.tobytes())
    raw = json.dumps(head).encode() + b"\n" + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(value: bytes) -> list:
    import pyarrow as pa

    raw = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    cut = raw.index(b"\n")
    out, at = [], cut + 1
    for kind, n in json.loads(raw[:cut]):
        if kind == "u":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel())
            at += 4 * n
            continue
        part = raw[at:at + n]
        out.append(part if kind == "b" else np.frombuffer(part, kind))
        at += n
    return out


SCHEMA = "part int, block long, kind int, seq int, payload binary"


def _rows(rows: list[tuple]):
    import pyarrow as pa

    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["part", "block", "kind", "seq", "payload"])


def unlike(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers of the words whose code points are not those of word ``other``; the words lie end to end."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lens = ends - starts
    same = lens == lens[other]
    at = np.repeat(starts[other] - starts, lens) + np.arange(starts[0], ends[-1])
    equal = cp[np.minimum(at, len(cp) - 1)] == cp[starts[0]:ends[-1]]
    same &= np.logical_and.reduceat(equal, starts - starts[0])
    return np.flatnonzero(~same)


class _Block:
    """The distinct words and the documents of one block; of the texts only word numbers are kept."""

    def __init__(self):
        self.number, self.words, self.hashes, self.docs, self.tokens = {}, [], [], [], 0

    def numbered(self, word: str, h: int) -> int:
        """The word's number in the block; words are told apart by their text, ``h`` only deals them to buckets."""
        k = self.number.get(word)
        if k is None:
            k = self.number[word] = len(self.words)
            self.words.append(word.encode())
            self.hashes.append(h)
        return k

    def add(self, ids, valid, split) -> None:
        text, cp, starts, ends, per_row = split
        hashes = span_hashes(cp, starts, ends)
        distinct, seen, codes = np.unique(hashes, return_index=True, return_inverse=True)
        mine = np.empty(len(distinct), np.uint32)
        for j, (h, a, b) in enumerate(zip(distinct.tolist(), starts[seen].tolist(), ends[seen].tolist())):
            mine[j] = self.numbered(text[a:b], h)
        numbers = mine[codes]
        for i in unlike(cp, starts, ends, seen[codes]).tolist():  # a word that only shares another's hash
            numbers[i] = self.numbered(text[int(starts[i]):int(ends[i])], int(hashes[i]))
        self.docs.append((ids, valid, per_row, numbers))
        self.tokens += len(starts)

    def rows(self, block: int, buckets: int, kind: int) -> Iterator[tuple]:
        """Rows of the distinct words (kind 0) or of the documents (kind 1); words are renumbered by falling frequency."""
        n = len(self.words)
        counts = np.zeros(n, np.int64)
        for _, _, _, codes in self.docs:
            counts += np.bincount(codes, minlength=n)
        rank = np.empty(n, np.uint32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(n, dtype=np.uint32)
        if kind == 0:
            part = (np.fromiter(self.hashes, np.uint64, n) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((rank, part))
            cuts = np.flatnonzero(np.append(True, np.diff(part[by]) != 0)) if n else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], n).tolist()):
                mine = by[a:b]
                data = [self.words[j] for j in mine.tolist()]
                yield (int(part[mine[0]]), block, 0, 0,
                       _pack(rank[mine], np.fromiter(map(len, data), np.uint32, len(data)), b"".join(data)))
            return
        for seq, (ids, valid, per_row, codes) in enumerate(self.docs):
            yield 0, block, 1, seq, _pack(ids, valid, per_row.astype(np.uint32), rank[codes])


def split_words(docs: DataFrame, special: list[str], buckets: int, kind: int, id_col: str, text_col: str) -> DataFrame:
    """Packed rows: each block's distinct words by bucket (kind 0) or its documents as word numbers (kind 1).

    The texts are split once for either kind: sending the sequences along with
    the words would shuffle them, the largest part, twice."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        number, block = None, _Block()

        def flush(block):
            out, size = [], 0
            for r in block.rows(number, buckets, kind):
                out.append(r)
                size += len(r[4])
                if size > 4_000_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(2)[0].as_py() << 33
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            valid = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.uint8)
            raw, off = utf8_buffers(batch.column(1))
            for a, b in pieces(off, SPLIT_BYTES):
                block.add(ids[a:b], valid[a:b], _split(raw, off[a:b + 1], special))
                if block.tokens >= BLOCK_TOKENS:
                    yield from flush(block)
                    number, block = number + 1, _Block()
        if block.docs:
            yield from flush(block)

    # the scan's own partition number, which is the same below a union
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.spark_partition_id().alias("scan")).mapInArrow(run, SCHEMA)


def encode_words(packed: DataFrame, tokenizer_file: str) -> DataFrame:
    """Word rows with their ids in place of the words; each distinct word of a bucket is encoded once."""
    def run(batches: Iterator) -> Iterator:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only cost memory
        from tokenizers import Tokenizer

        tok, part, known = Tokenizer.from_file(tokenizer_file), None, {}
        tok.no_padding()
        tok.no_truncation()
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_pylist() for c in batch.columns]
            out, opened = [], []
            if cols[0][0] != part:
                known = {}
            for p, block, payload in zip(cols[0], cols[1], cols[4]):
                lids, lens, data = _unpack(payload)
                ends = np.cumsum(lens).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends)]
                opened.append((p, block, lids, words))
            fresh = list(dict.fromkeys(w for _, _, _, words in opened for w in words if w not in known))
            for a in range(0, len(fresh), 1000):
                some = fresh[a:a + 1000]
                for w, e in zip(some, tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                    known[w] = e.ids
            for p, block, lids, words in opened:
                ids = [known[w] for w in words]
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                out.append((p, block, 0, 0, _pack(lids, np.fromiter(map(len, ids), np.uint32, len(ids)), flat)))
            if cols[0][-1] != cols[0][0]:  # only the last bucket goes on in the next batch
                last = cols[0][-1]
                known = {w: known[w] for p, _, _, words in opened if p == last for w in words}
            part = cols[0][-1]
            yield _rows(out)

    return packed.mapInArrow(run, SCHEMA)


def _ragged(flat: np.ndarray, first: np.ndarray, lens: np.ndarray, pick: np.ndarray):
    """The concatenation of ``flat[first[p]:first[p] + lens[p]]`` for p in ``pick``, and the lengths."""
    n = lens[pick].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(first[pick] - (ends - n), n) + np.arange(total)
    return flat[at], n


def join_back(packed: DataFrame, table_file: str | None = None) -> DataFrame:
    """(id, ids) of every document from rows that are dealt and sorted by block, words first.

    With the file of an id-to-piece table, the ids are decoded at once (a
    column ``decoded``): the same worker does both, where a ``decode`` behind
    it would keep a second one busy for every task."""
    pieces_ = piece_table(table_file) if table_file else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, words, table = None, [], None
        for batch in batches:
            for b, kind, payload in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4))):
                if b != block:
                    block, words, table = b, [], None
                if not kind:
                    words.append(_unpack(payload))
                    continue
                if table is None:
                    n = sum(len(w[0]) for w in words)
                    lens, first, base = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
                    for lids, k, ids in words:
                        lens[lids] = k
                        first[lids] = base + np.cumsum(k, dtype=np.int64) - k
                        base += len(ids)
                    table = (np.concatenate([w[2] for w in words]) if words else np.zeros(0, np.uint32), first, lens)
                    words = []
                ids, valid, per_row, codes = _unpack(payload)
                flat, n = _ragged(*table, codes)
                upto = np.concatenate([[0], np.cumsum(n)])
                off = upto[np.concatenate([[0], np.cumsum(per_row.astype(np.int64))])]
                out = {"id": pa.array(ids, pa.int64(), mask=valid == 0),
                       "ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.astype(np.int32)))}
                if pieces_:
                    out["decoded"] = pa.array(decoded_texts(flat, off, *pieces_), pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return packed.mapInArrow(run, "id long, ids array<int>" + (", decoded string" if pieces_ else ""))


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """(id, ids): one row per row of ``docs``; with ``decoded`` also the text the ids decode to."""
    with open(tokenizer_file, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    n = shuffle_partitions(docs.sparkSession)
    words = split_words(docs, special, 4 * n, 0, id_col, text_col).repartition(n, "part").sortWithinPartitions("part")
    both = encode_words(words, tokenizer_file).unionByName(split_words(docs, special, 4 * n, 1, id_col, text_col))
    return join_back(both.repartition(n, "block").sortWithinPartitions("block", "kind", "seq"), tokenizer_file if decoded else None)


def piece_table(tokenizer_file: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes in a row, and where each id's piece starts."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def decoded_texts(ids: np.ndarray, rows: np.ndarray, flat: np.ndarray, upto: np.ndarray) -> list[str]:
    """The texts of ``ids[rows[i]:rows[i + 1]]``; bytes that are no UTF-8 become U+FFFD."""
    first, lens, out = upto[:-1], np.diff(upto), []
    for a, b in pieces(rows, DECODE_IDS):  # the gather needs some 30 bytes for each byte of text
        data, n = _ragged(flat, first, lens, ids[rows[a]:rows[b]])
        ends = np.concatenate([[0], np.cumsum(n)])[rows[a:b + 1] - rows[a]]
        out += [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


def decode(encoded: DataFrame, tokenizer_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; bytes that are no UTF-8 become U+FFFD. Null ids: empty text."""
    from pyspark.sql import types as T

    flat, upto = piece_table(tokenizer_file)
    keep = [c for c in encoded.columns if c != out]
    schema = T.StructType([*encoded.select(*keep).schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids = batch.column(keep.index(ids_col))
            rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            texts = decoded_texts(ids.flatten().to_numpy(zero_copy_only=False), rows, flat, upto)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, out])

    return encoded.select(*keep).mapInArrow(run, schema)
