"""The pipeline's stages on empty tables, clashing column names and odd rows."""

import pytest

import corpus_pipeline as C
from offerlens.llm.common import free, stage

CLASH = ["__row", "__digest", "__n", "__source", "__limit", "__hash", "__copy", "__lang", "__score", "__bits"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def docs(spark, rows):
    return stage(spark.createDataFrame([(*r, None, *[f"{c} of {r[1]}" for c in CLASH]) for r in rows], SCHEMA), "cases")


def test_columns_of_any_name_pass_through(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (2, text.upper(), "en", "a"), (3, text + " more", "en", "b"), (3, "another text of its own", "en", "b"),
            (None, "no id here at all", "en", None), (4, None, None, "a"), (5, "", "en", "a")]
    table = docs(spark, rows)
    left = {}
    for name, function in C.STAGES[:-1]:
        out = function(spark, table, "")
        assert out.columns == table.columns
        got = out.collect()
        assert all(r[c] == f"{c} of {r.text}" for r in got for c in CLASH)
        left[name] = sorted((r.doc_id or 0, r.text or "") for r in got)
        table = stage(out, "case")
    assert [i for i, _ in left["language ID"]] == [0, 1, 2, 3, 3]
    assert [i for i, _ in left["exact dedup"]] == [0, 2, 3, 3]
    assert [i for i, _ in left["near dedup"]] == [0, 2, 3] and ("another text of its own" in {t for _, t in left["near dedup"]})
    assert C.encode(spark, table, "").count() == table.count()


def test_an_empty_table_runs_through_all_stages(spark):
    table = docs(spark, [])
    for name, function in C.STAGES:
        out = stage(function(spark, table, ""), "none")
        assert out.count() == 0
        if name != C.STAGES[-1][0]:
            assert out.columns == table.columns
            table = out


@pytest.mark.parametrize("columns", [[], ["a"], ["a", "a_"], ["A", "b"]])
def test_free_names(columns):
    name = free("a", columns)
    assert name.startswith("a") and name not in {c.lower() for c in columns}
