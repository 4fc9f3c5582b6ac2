"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed (SHA-256 of its text). The
ledger holds the (blob, rule, rule version) triples that were scanned; a scan
runs each rule over the blobs that lack its triple, once per distinct blob.
Beside the ledger stands the table of findings, by blob as well, and both grow
by one folder a batch. What is asked of a path is the join of its blob with
all findings so far, whichever batch brought the blob first, so a later batch
scans only what is new and loses nothing.

A batch writes its findings first and its triples second. A batch that broke
off has no triples and therefore does not count; it is written again under
the same number.

Copies are combined before the texts are shuffled, so a blob that makes up a
third of all versions costs one scan and sends one row from each map task.

Matches are leftmost and non-overlapping per rule. Their places follow from
the text between matches: the running sum of the lengths of gaps and matches,
in code points. A match whose value is too short is dropped but still
consumes its text.

Cases: null text is the empty blob; null and repeated ids are paths like any
other; a text without matches has no findings; an empty table gives none;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.llm.common import stage


@dataclass(frozen=True)
class Rule:
    """``group`` is the part whose length must reach ``least``; ``hint`` must match for a text to be searched."""
    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


#: FIXED VALUES: the three base rules, in their listed order.
BASE_RULES = (
    Rule("assign", "((?i)password|passwd|secret|token|api_?key)(?-i)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         2, 6, "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"),
    # runs are matched whole, so asking for their length in the pattern drops the short ones before they become rows
    Rule("access", "AKIA[A-Z0-9]{16,}+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]{24,}+", 0, 24, "[0-9a-f]{24}"),
)
#: Further kinds the ledger scans for.
MORE_RULES = (Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),)
RULES = BASE_RULES + MORE_RULES


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob): the content address of every version. Staged."""
    return stage(docs.select(F.col(id_col).alias("path"), _address(F.col(text_col)).alias("blob")), "versions")


def _address(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def pending(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kinds): the rules each distinct blob has not been scanned with."""
    triples = (blobs.select("blob").distinct()
               .select("blob", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
                                                   for r in rules])).alias("r")).select("blob", "r.*"))
    if ledger is not None:
        triples = triples.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    return triples.groupBy("blob").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
         text_col: str = "text", todo: DataFrame | None = None) -> DataFrame:
    """(blob, kind, version, start, end) of every match in the blobs that the ledger lacks (``todo``: as ``pending`` names them)."""
    texts = (docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .select(_address(F.col("text")).alias("blob"), "text"))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))  # combined in the map tasks, dealt by blob as the join asks
    if ledger is not None:
        blobs = blobs.join(pending(texts, ledger, rules) if todo is None else todo, "blob")
    else:
        blobs = blobs.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    searched = blobs.select("blob", F.explode(F.filter(F.array(*[
        F.when(F.array_contains("kinds", r.kind) & F.regexp_like("text", F.lit(r.hint)),
               F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                        F.arrays_zip(F.split("text", r.pattern, -1).alias("gap"),
                                     F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("match"),
                                     F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("value"))
                        .alias("parts"))) for r in rules]), lambda x: x.isNotNull())).alias("hit"))
    parts = (searched.select("blob", "hit.kind", "hit.version", "hit.least", F.posexplode("hit.parts").alias("pos", "p"))
             .where(F.col("p.match").isNotNull())
             .select("blob", "kind", "version", "pos", (F.char_length("p.value") >= F.col("least")).alias("long"),
                     F.char_length("p.match").alias("n"), F.char_length("p.gap").alias("gap")))
    upto = Window.partitionBy("blob", "kind").orderBy("pos")
    return (parts.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).where("long")
            .select("blob", "kind", "version", (F.col("end") - F.col("n")).alias("start"), "end"))


def extend_ledger(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after a scan: its triples and those of the blobs just scanned."""
    done = (pending(blobs, ledger, rules).select("blob", F.explode("kinds").alias("kind"))
            .join(F.broadcast(blobs.sparkSession.createDataFrame([(r.kind, r.version) for r in rules],
                                                                 "kind string, version int")), "kind")
            .select("blob", "kind", "version"))
    return done if ledger is None else ledger.select("blob", "kind", "version").unionByName(done)


# ------------------------------------------------------------------ the stored ledger
TRIPLES = "blob binary, kind string, version int, batch int"
FINDINGS = "blob binary, kind string, version int, start long, end long, batch int"


def stored(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame, int]:
    """(ledger, findings, number of the next batch) of the folder ``store``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/ledger")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        nothing = [spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in columns.split(", "))])
                   for columns in (TRIPLES, FINDINGS)]
        return *nothing, 0
    ledger = spark.read.schema(TRIPLES).parquet(f"{store}/ledger")
    done = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)
                  if s.isDirectory() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    batches = F.col("batch").isin(done)
    return ledger.where(batches), spark.read.schema(FINDINGS).parquet(f"{store}/findings").where(batches), 1 + max(done, default=-1)


def ingest(docs: DataFrame, store: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> int:
    """Scan what the stored ledger lacks of ``docs``, and append findings and triples as one batch; returns its number."""
    spark = docs.sparkSession
    ledger, _, batch = stored(spark, store)
    blobs = docs.select(_address(F.col(text_col)).alias("blob"))
    todo = stage(pending(blobs, ledger, rules), "pending")
    scan(docs, rules, ledger, text_col, todo).write.mode("overwrite").parquet(f"{store}/findings/batch={batch}")
    number = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)]), F.col("kind"))
    (todo.select("blob", F.explode("kinds").alias("kind")).select("blob", "kind", number.alias("version"))
     .write.mode("overwrite").parquet(f"{store}/ledger/batch={batch}"))
    return batch


def findings(spark: SparkSession, store: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All findings so far of the rules' present versions."""
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return stored(spark, store)[1].where(now).drop("batch")


def per_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): the findings of each path's blob, by start, then kind as listed."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    # staged, so that the join has plain exchanges, whose hot blobs AQE can split
    spans = stage(findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("ord"), "end", "kind"))).alias("spans")), "spans")
    return paths.join(spans, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
