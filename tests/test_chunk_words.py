"""Chunks of long texts: the same as by slices of a list, with the words split once for a text."""

from pyspark.sql import functions as F

from offerlens.functions.text import chunk_words


def test_a_text_is_split_once_for_all_its_chunks(spark):
    assert str(chunk_words(F.col("text"), 200, 160)).count("split(") == 1


def test_chunks_equal_slices(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate((0, 1, 4, 5, 6, 7, 8, 9, 23, 300))] + [(10, None), (11, " \n "), (12, "  a\tb  c ")]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, text string").select("i", chunk_words(F.col("text"), 5, 3).alias("c")).collect()}
    for i, text in rows:
        words = (text or "").split()
        want = [" ".join(words[s:s + 5]) for k, s in enumerate(range(0, max(len(words), 1), 3)) if k == 0 or s + 2 < len(words)]
        assert got[i] == want
