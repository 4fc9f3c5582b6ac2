"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds every substring of a sample of its
labelled text. A text is cut greedily into phrases, each the longest match in
the automaton from where the last one ended; the language that needs the
fewest phrases, times log2 of its sample's length (what naming a place in it
costs), per letter, wins. Texts are reduced to lower-case letters and single
blanks. They are parsed in stretches of ``STRETCH`` symbols side by side, so
every step advances all stretches of all languages by one symbol; a phrase
ends where a stretch does, for each language alike.

The samples are bounded by ``CHARS_PER_LANG`` normalised characters from the
documents with the smallest hashes, of at most ``MAX_LANGS`` languages (the
ones with most documents). Prediction reads whole texts.

Cases: a null text or one without letters gets ``und`` with score 0; equal
phrase counts go to the language with more labelled documents, then to the
smaller name; repeated rows are judged alike; if nothing can be learned, every
text is ``und``; an empty table gives an empty result; other columns pass
through, apart from those named like an output.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm.common import pieces, utf8_buffers

CHARS_PER_LANG, DOCS_PER_LANG, MAX_LANGS = 20_000, 100, 256
#: Symbols: 0 is the blank, the commonest letters get their own, the others share what is left.
SYMBOLS, OWN = 64, 56
STRETCH, BATCH_BYTES = 1024, 1_000_000
UNKNOWN = "und"


@cache
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point, where it is one code point, and whether it is a letter."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return lower, letter


def normalise(text: str) -> str:
    """Lower-case letters, with one blank for every stretch of anything else."""
    lower, letter = _folded()
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(letter[cp], lower[cp], 32).astype(np.uint32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep].tobytes().decode("utf-32-le").strip()


@dataclass(frozen=True)
class Samples:
    """What is learned: (language, sample text) by falling number of labelled documents, and the letters with own symbols."""
    langs: tuple[tuple[str, str], ...]
    letters: str


def suffix_automaton(symbols: np.ndarray) -> np.ndarray:
    """Transitions (states x SYMBOLS, -1 where there is none) of the automaton of all substrings."""
    n = len(symbols)
    nxt = np.full((2 * n + 2, SYMBOLS), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and nxt[p, c] < 0:
            nxt[p, c] = cur
            p = link[p]
        if p != -1:
            q = int(nxt[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                nxt[clone] = nxt[q]
                while p != -1 and nxt[p, c] == q:
                    nxt[p, c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt[:len(length)]


def parser_table(symbols: np.ndarray, base: int) -> np.ndarray:
    """The automaton made complete: entry = 2 * place of the next state's row + 1 if a new phrase begins there."""
    nxt = suffix_automaton(symbols)
    nxt = np.vstack([nxt, np.full((1, SYMBOLS), -1, np.int32)])  # last: where a symbol that never occurs leads
    nothing = len(nxt) - 1
    row = ((np.arange(len(nxt), dtype=np.int32) * np.int32(SYMBOLS) + np.int32(base)) << 1).astype(np.int32)
    fresh = row[np.where(nxt[0] >= 0, nxt[0], nothing)] | 1
    return np.where(nxt >= 0, row[np.maximum(nxt, 0)], fresh[None, :]).ravel()


def parser(samples: Samples):
    """(table, root place per language, bits per phrase, symbol of each code point).

    Built by each task and dropped with it: workers are reused, and a table of
    10 MB a language is better not kept by all of them."""
    lower, letter = _folded()
    own = np.zeros(0x110000, np.uint8)
    shared = OWN + np.arange(0x110000) % (SYMBOLS - OWN)
    own[:] = np.where(letter, shared, 0)
    for i, c in enumerate(samples.letters[:OWN - 1]):
        own[ord(c)] = i + 1
    symbol = own[lower]
    symbol[~letter] = 0
    tables, roots, bits, base = [], [], [], 0
    for _, text in samples.langs:
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        tables.append(parser_table(symbol[cp], base))
        roots.append(base << 1)
        bits.append(math.log2(max(2, len(cp))))
        base += len(tables[-1])
    return np.concatenate(tables), np.array(roots, np.int32), np.array(bits), symbol


def phrase_counts(table: np.ndarray, roots: np.ndarray, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Phrases (languages x stretches) of the stretches ``symbols[start:start + length]``."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    state = np.repeat(roots[:, None], len(start), 1)
    count = np.ones((len(roots), len(start)), np.int32)
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    for i, k in enumerate(active.tolist()):
        now = table[(state[:, :k] >> 1) + symbols[start[:k] + i]]
        state[:, :k] = now
        if i:
            count[:, :k] += now & 1
    out = np.empty_like(count)
    out[:, order] = count
    return out


def identify(built: tuple, raw: np.ndarray, off: np.ndarray):
    """(index of the language or -1, score, bits per letter) of some rows' bytes; ``built`` is a ``parser``."""
    table, roots, bits, symbol = built
    n = len(off) - 1
    data = raw[off[0]:off[-1]]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    rows = lead[off - off[0]]
    sym = symbol[cp]
    first = np.zeros(len(sym) + 1, bool)
    first[rows] = True
    keep = sym != 0
    keep[1:] |= (sym[:-1] != 0) & ~first[1:-1]  # a blank follows a letter of the same text
    kept = np.concatenate([[0], np.cumsum(keep)])[rows]
    letters = np.diff(np.concatenate([[0], np.cumsum(sym != 0)])[rows])
    sym = sym[keep].astype(np.int32)
    size = np.diff(kept)
    parts = -(-size // STRETCH)
    row = np.repeat(np.arange(n), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = kept[row] + nth * STRETCH
    length = np.minimum(STRETCH, kept[row + 1] - start)
    counts = phrase_counts(table, roots, sym, start, length)
    total = np.stack([np.bincount(row, c, n) for c in counts])
    cost = total * bits[:, None] / np.maximum(size, 1)
    best = np.argmin(cost, 0)
    low = cost[best, np.arange(n)]
    score = 1 / np.exp(-4 * (cost - low)).sum(0)
    none = letters == 0
    return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, low)


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          chars_per_lang: int = CHARS_PER_LANG, docs_per_lang: int = DOCS_PER_LANG, max_langs: int = MAX_LANGS) -> Samples:
    """Samples from the rows where ``usable`` holds and the language is known.

    The ids are chosen from the narrow columns; of the texts, only those of
    the chosen ids (at most docs_per_lang x max_langs) reach the driver."""
    from pyspark.sql import Window

    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(max_langs).collect()
    names = [r[0] for r in sizes]
    if not names:
        return Samples((), "")
    by = Window.partitionBy("lang").orderBy("h", "id")
    picked = (known.where(F.col(lang_col).isin(names))
              .select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
              .withColumn("r", F.row_number().over(by)).where(F.col("r") <= docs_per_lang)
              .select("id", "lang", "r").collect())
    ids = {r["id"]: (r["lang"], r["r"]) for r in picked}
    most = 4 * chars_per_lang  # a longer text gives its middle
    text = F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor((F.char_length(text_col) - most) / 2)).cast("int"), F.lit(most))
    # one text for each chosen id reaches the driver, however many rows an id has
    rows = (known.where(F.col(id_col).isin(list(ids))).select(F.col(id_col).alias("id"), text.alias("text"))
            .groupBy("id").agg(F.min("text").alias("text")).collect())
    samples = dict.fromkeys(names, "")
    for _, lang, content in sorted((ids[r["id"]][1], ids[r["id"]][0], r["text"] or "") for r in rows):
        if len(samples[lang]) < chars_per_lang:
            samples[lang] = (samples[lang] + " " + normalise(content)).strip()[:chars_per_lang]
    langs = tuple((k, samples[k]) for k in names if samples[k])
    common = Counter(c for _, s in langs for c in s if c != " ")
    return Samples(langs, "".join(c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))))


def predict(docs: DataFrame, samples: Samples, text_col: str = "text",
            out: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """``docs`` with the language, its score and bits per letter, in the columns ``out``."""
    keep = [c for c in docs.columns if c not in out]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out[0], T.StringType()),
                           T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.DoubleType())])
    names = [k for k, _ in samples.langs] + [UNKNOWN]
    at = keep.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        built = parser(samples) if samples.langs else None
        for batch in batches:
            raw, off = utf8_buffers(batch.column(at))
            found = [identify(built, raw, off[a:b + 1]) if samples.langs else (np.full(b - a, -1), np.zeros(b - a), np.zeros(b - a))
                     for a, b in pieces(off, BATCH_BYTES)]
            best, score, bits = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), *[np.zeros(0)] * 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score), pa.array(bits)],
                names=[*keep, *out])

    return docs.select(*keep).mapInArrow(run, schema)


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % by, F.lit(0))
