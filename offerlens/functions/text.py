"""Text Column helpers: redaction, number extraction, truncation, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.constants import NO_CONTACT, REDACTED

__all__ = [
    "REDACT_PATTERN", "NUMBER_PATTERN", "redact", "extract_numbers", "strip_zeros",
    "strip", "truncate", "is_blank_or_sentinel", "nice_offer_name", "tokens", "token_overlap",
    "arabic_digits_to_ascii",
]

# FIXED VALUES: whole-word digit runs. (?U) makes \d and \b Unicode-aware, as
# in Python 3's ``re`` on str.
REDACT_PATTERN = r"(?U)\b\d{6,}\b"
NUMBER_PATTERN = r"(?U)\b\d{1,5}\b"

# FIXED VALUES: what Python's str.strip() and str.split() take for white space.
SPACE_CLASS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES_PATTERN = SPACE_CLASS + "+"
SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# FIXED VALUES: Arabic-Indic and Eastern Arabic-Indic digits, mapped to 0-9.
_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
_ASCII_DIGITS = "0123456789" * 2


def redact(c: Column) -> Column:
    """Digit runs of 6+ as whole words -> [REDACTED]."""
    return F.regexp_replace(c, REDACT_PATTERN, REDACTED)


def extract_numbers(c: Column) -> Column:
    """All whole-word runs of 1-5 digits (array<string>); NULL text -> empty array."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER_PATTERN), 0)


def arabic_digits_to_ascii(c: Column) -> Column:
    return F.translate(c, _ARABIC_DIGITS, _ASCII_DIGITS)


def strip_zeros(c: Column) -> Column:
    """``s.lstrip('0') or '0'``."""
    s = F.regexp_replace(c, r"^0+", "")
    return F.when(s == "", F.lit("0")).otherwise(s)


def strip(c: Column) -> Column:
    """Python ``str.strip()``: white space of any kind off both ends (``trim`` takes blanks only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def truncate(c: Column, limit: Column | int) -> Column:
    """First ``limit`` code points."""
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    return c.substr(F.lit(1), lim)


def is_blank_or_sentinel(c: Column) -> Column:
    """True when the text is empty after trim or equals the no-contact sentinel (any case)."""
    t = strip(F.coalesce(c, F.lit("")))
    return (t == "") | (F.lower(t) == F.lit(NO_CONTACT))


def nice_offer_name(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def tokens(c: Column) -> Column:
    """Lower-cased whitespace tokens (Python ``str.split()``: no empty tokens)."""
    return F.filter(F.split(F.lower(c), SPACES_PATTERN), lambda s: s != "")


def token_overlap(query: Column, text: Column, stopwords: list[str]) -> Column:
    """Sorted words shared by query and text, minus stopwords.

    Commas and full stops are removed from the text side only.
    """
    q = F.array_distinct(tokens(query))
    t = F.array_distinct(tokens(F.regexp_replace(text, r"[,.]", "")))
    stop = F.array(*[F.lit(s) for s in stopwords])
    return F.array_sort(F.array_except(F.array_intersect(q, t), stop))


def chunk_words(text: Column, size: int, step: int) -> Column:
    """ext_chunk_text: overlapping chunks of ``size`` words every ``step`` words,
    covering the whole text (the last chunk may be shorter)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES_PATTERN), lambda s: s != "")

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
        chunks = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))
        # drop chunks fully contained in the previous one (text shorter than a window)
        return F.filter(chunks, lambda ch, i: (i == 0) | (i * step + size - step < n))

    # as a lambda's variable the words are split once for a text; as an expression, once for each of its chunks
    return F.flatten(F.transform(F.array(words), cut))
