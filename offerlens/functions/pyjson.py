"""Columns as indented JSON, spaced and numbered as Python's ``json.dumps(x, indent=2)`` does it.

The writer follows the column's type: structs become objects with their fields
in order, arrays lists, maps objects with their keys as text. Strings are
escaped to ASCII (``\\uXXXX`` for every UTF-16 unit outside the blank to the
tilde), doubles print as Python's ``repr`` (scientific from 1e16 on and below
1e-4), booleans in lower case, nulls as ``null``; dates, timestamps, decimals
and binaries as strings of their text. Only built-in functions are used: the
fields of a record are one array, and one lambda writes them all, so generated
code does not grow with the record.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["json_text", "json_string", "python_float"]

# FIXED VALUES: characters that JSON text keeps, and the short escapes.
_PLAIN = r"[ !#-\[\]-~]+"
_OTHER = r"[^ !#-\[\]-~]+"
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

_RAW, _STRING, _FLOAT = 0, 1, 2
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _escaped(run: Column) -> Column:
    """A run of characters that need escapes."""
    units = F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(....)", r"\\u$1")
    for ch, short in _SHORT.items():
        units = F.replace(units, F.lit(f"\\u{ord(ch):04x}"), F.lit(short))
    return units


def json_string(text: Column) -> Column:
    """``text`` as a JSON string in quotes."""
    runs = F.regexp_extract_all(text, F.lit(f"{_PLAIN}|{_OTHER}"), 0)
    mixed = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(rf"\A{_PLAIN}\z"), r).otherwise(_escaped(r))), "")
    return F.concat(F.lit('"'), F.when(text.rlike(rf"\A(?:{_PLAIN})?\z"), text).otherwise(mixed), F.lit('"'))


def python_float(text: Column) -> Column:
    """A double's text (``cast`` to string) as Python's ``repr`` writes it."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    size = F.ltrim(text, F.lit("-"))
    mantissa = F.regexp_replace(F.split_part(size, F.lit("E"), F.lit(1)), r"\.0\z", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    power = F.split_part(size, F.lit("E"), F.lit(2)).try_cast("int")
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    whole = F.concat(F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0"))
    plain = (F.when(power < 0, F.concat(F.lit("0."), zeros(-power - 1), digits))
             .when(F.length(digits) <= power + 1, F.concat(whole, F.lit(".0")))
             .otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))))
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    return (F.when(~text.contains("E"), text)
            .when(power.between(-4, 15), F.concat(sign, plain))
            .otherwise(F.concat(sign, exponent)))


def _scalar(col: Column, kind: T.DataType) -> tuple[int, Column]:
    """How the value is written, and its text."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _FLOAT, col.cast("string")
    if isinstance(kind, (*_INTEGERS, T.BooleanType)):
        return _RAW, col.cast("string")
    return _STRING, col.cast("string")


def _written(kind: Column, text: Column) -> Column:
    return (F.when(text.isNull(), F.lit("null")).when(kind == _STRING, json_string(text))
            .when(kind == _FLOAT, python_float(text)).otherwise(text))


def json_text(col: Column, kind: T.DataType, indent: int = 2, level: int = 0) -> Column:
    """The column, of type ``kind``, as JSON text."""
    inner, outer = "\n" + " " * (indent * (level + 1)), "\n" + " " * (indent * level)

    def block(items: Column, left: str, right: str) -> Column:
        return F.concat(F.lit(left + inner), F.array_join(items, "," + inner), F.lit(outer + right))

    if isinstance(kind, T.StructType):
        if not kind.fields:
            return F.when(col.isNull(), F.lit("null")).otherwise(F.lit("{}"))
        parts = []
        for f in kind.fields:
            nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
            how, text = (_RAW, json_text(col[f.name], f.dataType, indent, level + 1)) if nested else _scalar(col[f.name], f.dataType)
            parts.append(F.struct(F.lit(json.dumps(f.name) + ": ").alias("name"), F.lit(how).alias("how"), text.alias("text")))
        items = F.transform(F.array(*parts), lambda e: F.concat(e["name"], _written(e["how"], e["text"])))
        return F.when(col.isNull(), F.lit("null")).otherwise(block(items, "{", "}"))

    def value(x: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            return json_text(x, t, indent, level + 1)
        how, text = _scalar(x, t)
        return _written(F.lit(how), text)

    if isinstance(kind, T.ArrayType):
        items = F.transform(col, lambda x: value(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        items = F.transform(F.map_entries(col), lambda e: F.concat(json_string(e["key"].cast("string")), F.lit(": "), value(e["value"], kind.valueType)))
    else:
        return value(col, kind)
    left, right = ("[", "]") if isinstance(kind, T.ArrayType) else ("{", "}")
    return (F.when(col.isNull(), F.lit("null")).when(F.size(col) == 0, F.lit(left + right))
            .otherwise(block(items, left, right)))
