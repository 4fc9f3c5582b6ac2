"""Stages that are computed once and found again while nothing they depend on has changed.

A stage is a folder with one ``manifest.json`` and one folder for each time
its data were written. The manifest names the data folder and holds a key made
from

* every input file's path, length and modification time, as Spark's own file
  listing has them (no further request to the store),
* the plan, in its canonical form, and
* a version, which the caller raises when code changes that is not in the plan
  (a fitted model, a Python function).

The data are written first, into a folder of their own. Then the manifest is
written beside the old one and takes its place by one rename. So a reader
meets the old stage or the new one, and never a half-written one; two writers
at once leave one of two complete stages. A manifest that cannot be read
counts as none. Inputs that are neither files nor literal rows have no key, so
their stage is computed every time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

__all__ = ["input_files", "stage_key", "read_manifest", "publish", "resume", "resume_or_compute", "forget_old", "delete_folder"]

MANIFEST = "manifest.json"
_STATUS = re.compile(r"path=(.*?); isDirectory=\w+; length=(\d+);.*?modification_time=(\d+);")


def _plans(df: DataFrame) -> list:
    """The analysed plan and the plans of its subqueries."""
    plan = df._jdf.queryExecution().analyzed()
    inner = plan.subqueriesAll()
    return [plan, *(inner.apply(i) for i in range(inner.size()))]


def input_files(df: DataFrame) -> list[str] | None:
    """``path length modification-time`` of every file that the plan reads, sorted; literal rows as they are.

    None if an input is of another kind."""
    found = set()
    for plan in _plans(df):
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            kind = leaf.getClass().getSimpleName()
            if kind == "LogicalRelation" and hasattr(leaf.relation(), "location"):
                listed = leaf.relation().location().allFiles().mkString("\n")
                found.update(" ".join(m) for m in _STATUS.findall(listed))
            elif kind == "LocalRelation":
                found.add(leaf.data().mkString("\n"))
            elif kind not in ("OneRowRelation", "Range"):
                return None
    return sorted(found)


def _canonical(df: DataFrame) -> str:
    """The plan's text without the numbers that differ between two builds of one plan."""
    text = df._jdf.queryExecution().analyzed().canonicalized().treeString(True, False, 1_000_000, False, False)
    return re.sub(r"#\d+L?|(?<=[a-z])_\d+\b", "", text)


def stage_key(df: DataFrame, version: str = "") -> str | None:
    """What a stage of ``df`` depends on, as one short value; None if that cannot be told."""
    files = input_files(df)
    if files is None:
        return None
    return hashlib.sha256("\0".join([version, df.schema.json(), _canonical(df), *files]).encode()).hexdigest()


# ------------------------------------------------------------------ folders and manifests
def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The stage's manifest, or None if there is none that is whole."""
    where, fs = _file_system(spark, os.path.join(path, MANIFEST))
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and {"key", "data"} <= set(found) else None


def publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Put ``manifest`` in the place of the stage's manifest by one rename."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    draft, fs = _file_system(spark, os.path.join(path, f".{MANIFEST}-{uuid.uuid4().hex}"))
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    final = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(os.path.join(path, MANIFEST)))
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), final, options)


def resume(spark: SparkSession, path: str, key: str | None, write: Callable[[str], None]) -> str:
    """The data folder of the stage ``path`` under ``key``; ``write(folder)`` fills a new one where there is none."""
    known = read_manifest(spark, path)
    if known and key is not None and known["key"] == key:
        return os.path.join(path, known["data"])
    name = f"data-{uuid.uuid4().hex[:12]}"
    write(os.path.join(path, name))
    publish(spark, path, {"key": key, "data": name})
    return os.path.join(path, name)


def resume_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """src_stage_resume: the stage's table if inputs, plan and ``version`` are those it was written from;
    else it is computed, written and read back. The written table also cuts the lineage."""
    df = compute()
    folder = resume(spark, path, stage_key(df, version), lambda f: df.write.parquet(f))
    return spark.read.schema(df.schema).parquet(folder)


def forget_old(spark: SparkSession, path: str) -> int:
    """Delete the data folders that the manifest does not name (older versions, broken writes); returns how many.

    Only when no job reads or writes the stage any more."""
    known = read_manifest(spark, path)
    where, fs = _file_system(spark, path)
    old = [s.getPath() for s in fs.listStatus(where) if s.isDirectory() and not (known and s.getPath().getName() == known["data"])]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote and no job reads any more."""
    where, fs = _file_system(spark, path)
    fs.delete(where, True)
