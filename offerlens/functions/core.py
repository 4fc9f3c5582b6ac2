"""Numeric and formatting Column helpers (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "round_half_up", "round_half_even", "clip", "pick",
    "fmt_percent", "fmt_money", "fmt_fixed0", "safe_ratio",
    "zero_pad", "map_lookup",
]


def round_half_up(c: Column | str, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d.

    Written with plain IEEE operations so that any engine computing the same
    expression (the DuckDB oracle included) gets the identical double.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    """Python-style ``round`` / ``:.0f`` display rounding (80.5 -> 80)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c, digits)


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return out


def pick(values: list, index: Column) -> Column:
    """values[index] for a literal list (a fixed domain indexed by a key rule)."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def fmt_percent(c: Column, decimals: int = 1) -> Column:
    """Python ``{:.Nf%}``: x*100 with N decimals, half-even, no grouping."""
    return F.concat(F.regexp_replace(F.format_number(c * F.lit(100.0), decimals), ",", ""), F.lit("%"))


def fmt_money(c: Column) -> Column:
    """Python ``{:,.0f}``: grouped thousands, 0 decimals, half-even."""
    return F.format_number(c, 0)


def fmt_fixed0(c: Column) -> Column:
    """Python ``{:.0f}``: 0 decimals, half-even, no grouping."""
    return F.regexp_replace(F.format_number(c, 0), ",", "")


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, NULL when den is 0 (ANSI mode would raise)."""
    return F.try_divide(num, den)


def zero_pad(c: Column, width: int = 2) -> Column:
    """At least ``width`` digits; longer numbers are never cut (``lpad`` alone would)."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def map_lookup(mapping: dict, key: Column) -> Column:
    """Dictionary lookup through a literal map; unknown key -> NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)
