"""Indented JSON and the exact prompts, against ``json.dumps`` and written-out expectations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions.pyjson import json_string, json_text, python_float
from offerlens.operators import rules
from offerlens.plans import decision as D


def test_records_equal_json_dumps(spark):
    schema = ("a string, b int, c double, d boolean, e struct<x:string,y:array<double>>, f array<struct<t:string,n:bigint>>, "
              "g array<string>, h map<string,int>, `odd \"name\"` double")
    odd = 'quote " back \\ slash / tab\t line\n feed\f ret\r bell\x07 del\x7f é — 日本 😀 end'
    rows = [("x", 1, 0.5, True, ("y", [1.0, -2.5, 1e16]), [("t", 3), (odd, None)], ["p", None], {"k": 1}, 120.0),
            (odd, None, None, None, None, None, [], {}, 1e-7), ("", -5, -0.0, False, (None, []), [], None, None, 123456789.125)]
    df = spark.createDataFrame(rows, schema)
    names = ["a", "b", "c", "d", "e", "f", "g", "h", 'odd "name"']

    def plain(v, i):
        if i == 4 and v is not None:
            return dict(zip("xy", v))
        if i == 5 and v is not None:
            return [dict(zip("tn", x)) for x in v]
        return v

    record = F.struct(*[F.col(f"`{n}`") for n in names])
    got = df.select(json_text(record, df.schema).alias("j"), F.monotonically_increasing_id().alias("i")).collect()
    want = [json.dumps({n: plain(v, i) for i, (n, v) in enumerate(zip(names, r))}, indent=2, default=str) for r in rows]
    assert sorted(r.j for r in got) == sorted(want)


def test_numbers_print_as_in_python(spark):
    random.seed(3)
    values = [0.0, -0.0, 1.0, 120.0, 0.1, 1e7, 1.25e7, 123456789.0, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e22, 1e100, 1e-3, 1e-4, 1.5e-4,
              9.9e-5, 1e-5, 1.25e-10, -3.75, -1e-5, -1e20, 5e-324, 1.7976931348623157e308]
    values += [round(random.uniform(-1000, 1000), random.randrange(0, 5)) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r.v, r.t) for r in df.select("v", python_float(F.col("v").cast("string")).alias("t")).collect()]
    assert [t for v, t in got if v != 5e-324] == [repr(v) for v, _ in got if v != 5e-324]  # Java writes 4.9e-324


def test_strings_are_escaped_as_in_python(spark):
    texts = ["", "plain", '"', "\\", "a\\u0041", "ü", "\x00\x1f", "   ", "😀😀x", "mixed é \"q\" \n end", "~\x7f"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j")).collect()
    assert all(r.j == json.dumps(r.t) for r in got) and len(got) == len(texts)


@pytest.fixture(scope="module")
def decided(spark, sf_small):
    from offerlens.plans.catalog import _decided
    return {v: _decided(spark, sf_small, v).limit(40) for v in "AB"}


@pytest.mark.parametrize("variant", ["A", "B"])
def test_prompts_have_the_exact_layout(spark, decided, variant):
    df = decided[variant]
    record = D.context_struct(variant)
    rows = df.select(record.alias("r"), "value_qar", "channel", "nbo_reason", "action", "action_type",
                     rules.prompt(D.context_json(df, variant), variant).alias("prompt")).collect()
    assert rows
    for r in rows:
        ctx = {k: int(v) if k == "value_qar" else v for k, v in r.r.asDict().items()}
        assert all(isinstance(v, (int, float, str)) for v in ctx.values())
        head = (f"SELECTED CAMPAIGN (do not change): {r.action} | type={r.action_type} | value={int(r.value_qar)} QAR\n" if variant == "A"
                else f"SELECTED ACTION (do not change): {r.action} | type {r.action_type} | value_qar {int(r.value_qar)}\n")
        line = "SUBSCRIBER" if variant == "A" else "CUSTOMER"
        assert r.prompt == (f"{head}CHANNEL: {r.channel}\nNBO_REASON: {r.nbo_reason}\n\n{line} CONTEXT (only use these facts):\n"
                            + json.dumps(ctx, indent=2, default=str))
    first = rows[0].prompt.split("\n")
    assert first[5] == "{" and first[6].startswith('  "action": "') and first[-1] == "}"
    assert ("network_capability" in rows[0].prompt) == (variant == "B") and ('"dunning"' in rows[0].prompt) == (variant == "A")


def test_variant_b_tags_accepted_and_rejected_answers(spark, sf_small):
    from offerlens.plans.catalog import QUERIES
    tags = {r.gen_source for r in QUERIES["rule_response_adjudicate_b"](spark, sf_small).select("gen_source").distinct().collect()}
    assert tags <= {"llm", "llm->fallback"} and "llm->fallback" in tags
