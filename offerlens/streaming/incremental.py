"""Incremental corpus build with Structured Streaming (ext_stream_embed).

Arriving interactions are de-duplicated by Spark's keyed state
(``dropDuplicatesWithinWatermark``), which forgets an id once the watermark has
passed its event time by the allowed delay. So state and work of a micro-batch
depend on the rows of the last ``delay`` and of the batch, and never on what
was written before.

Such an operator drops rows that come later than the delay. None of them is
lost here: beside the de-duplicated rows, each micro-batch hands all its rows
to the sink, and those whose id did not come out of the state go to a side
table (repeats, and late rows). ``settle``, a batch job run every now and then,
takes from there the first row of every id that the corpus lacks.

Layout below the output folder::

    fresh/epoch=N      rows of micro-batch N, embedded
    late/epoch=N       rows of micro-batch N that the state did not let through
    settled/epoch=N    late rows that settling from epoch N on has added
    manifest.json      the first epoch that is not settled yet

Every epoch writes its own folders with overwrite, and a settling that broke
off writes the same folder again, so retries replace their own output.
``availableNow`` drains what is there and stops; the same code runs
continuously with a processing-time trigger. Embedding uses pure transformers
(no fitted state), so every batch embeds alike. Rows without an event time or
an id go the way of late rows; those without an id have no identity and are
all kept. A row repeats with its event time.
"""

from __future__ import annotations

import os

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.sources.stages import delete_folder, publish, read_manifest

c = F.col


def embed_stateless(df: DataFrame, text_col: str, dim: int = 64) -> DataFrame:
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"\W+", toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim)
    nz = Normalizer(inputCol="__tf", outputCol="__vec", p=2.0)
    out = nz.transform(tf.transform(tok.transform(df)))
    return out.withColumn("embedding", vector_to_array(c("__vec"), "float32")).drop("__tok", "__tf", "__vec")


def events_stream(spark: SparkSession, source_dir: str, file_glob: str = "events*.parquet",
                  max_files: int | None = None) -> DataFrame:
    """Stream the event files of ``source_dir`` matching ``file_glob``; ``max_files`` bounds a micro-batch."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(source_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source_dir)


def with_times(events: DataFrame) -> DataFrame:
    """``events`` with ``ts`` as a timestamp, the type that watermarks take."""
    return events.withColumn("ts", c("ts").cast("timestamp"))


def run_incremental(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str,
                    file_glob: str = "events*.parquet", max_files: int | None = None,
                    timeout_s: float | None = None, delay: str = "1 hour") -> str:
    """Drain the source once (availableNow) into ``out_path``; returns the path.

    ``delay`` is how far rows may lag behind the newest event time and still be
    told apart by the state."""
    raw = with_times(events_stream(spark, source_dir, file_glob, max_files))
    fresh = (raw.where(c("event_id").isNotNull() & c("ts").isNotNull())
             .withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]))
    both = fresh.withColumn("kind", F.lit("fresh")).unionByName(raw.withColumn("kind", F.lit("arrived")))

    def sink(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        work = os.path.join(out_path, "work", f"epoch={epoch}")
        batch.write.mode("overwrite").parquet(work)  # once: the state must not be asked a second time
        rows = session.read.schema(batch.schema).parquet(work)
        let_through = rows.where(c("kind") == "fresh").drop("kind")
        _embedded(let_through).write.mode("overwrite").parquet(os.path.join(out_path, "fresh", f"epoch={epoch}"))
        (rows.where(c("kind") == "arrived").drop("kind").join(let_through.select("event_id"), "event_id", "left_anti")
         .write.mode("overwrite").parquet(os.path.join(out_path, "late", f"epoch={epoch}")))
        delete_folder(session, work)

    q = (both.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    return out_path


def _embedded(events: DataFrame) -> DataFrame:
    text = events.withColumn("text", F.concat_ws(" ", c("event_type"), c("props")))
    return embed_stateless(text, "text").select("event_id", "user_id", "ts", "event_type", "embedding")


CORPUS = "event_id bigint, user_id bigint, ts timestamp, event_type string, embedding array<float>, epoch bigint"


def corpus(spark: SparkSession, out_path: str) -> DataFrame:
    """All rows so far: let through, and settled up to the last settling that was completed."""
    out = spark.read.schema(CORPUS).parquet(os.path.join(out_path, "fresh"))
    upto = _settled(spark, out_path)
    if upto:
        late = spark.read.schema(CORPUS).parquet(os.path.join(out_path, "settled")).where(c("epoch") < upto)
        out = out.unionByName(late)
    return out.drop("epoch")


def _settled(spark: SparkSession, out_path: str) -> int:
    known = read_manifest(spark, out_path)
    return int(known["data"]) if known else 0


def settle(spark: SparkSession, out_path: str) -> int:
    """Add the late rows of all epochs not settled yet that the corpus lacks; returns the first epoch left to settle."""
    start = _settled(spark, out_path)
    late = spark.read.parquet(os.path.join(out_path, "late")).where(c("epoch") >= start)
    newest = late.agg(F.max("epoch")).first()[0]
    if newest is None:
        return start
    late = late.where(c("epoch") <= newest).drop("epoch")
    known = c("event_id").isNotNull()
    rest = [x for x in late.columns if x != "event_id"]
    first = (late.where(known).groupBy("event_id").agg(F.min(F.struct(*rest)).alias("f"))
             .select("event_id", *[c(f"f.{x}").alias(x) for x in rest]))
    new = first.join(corpus(spark, out_path).select("event_id"), "event_id", "left_anti")
    _embedded(new.unionByName(late.where(~known).select(*new.columns))).write.mode("overwrite").parquet(
        os.path.join(out_path, "settled", f"epoch={start}"))
    publish(spark, out_path, {"key": "settled", "data": str(newest + 1)})
    return newest + 1
