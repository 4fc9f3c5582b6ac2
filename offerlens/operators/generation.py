"""Completing prompts with an external model: each distinct prompt once, within limits.

Responses are kept in a table addressed by the prompt's content (SHA-256), so
a prompt that was answered before is never sent again, neither for another row
nor in another run. Only prompts without an answer go out. A worker keeps

* a deadline for every call: a call that hangs is abandoned and its prompts
  count as failed, the others go on;
* a bounded number of further tries for calls that raise or answer badly;
* a rate, so that the sum over the workers stays below the service's limit.

If a call for several prompts fails, its prompts are tried one by one, so that
one bad prompt does not cost the others their answers. Failed prompts have a
null response and are tried again in a later run, up to ``attempts`` runs.
No client ships with the library: ``load_fn()`` returns a function
``list[str] -> list[str | None]``, loaded once per worker.
"""

from __future__ import annotations

import os
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.operators.workers import load_once

__all__ = ["Limits", "generate_with", "responses", "complete"]

c = F.col

RESPONSES = "prompt_key string, response string, error string"


class Limits:
    """What a worker may do: prompts in a call, seconds for a call, further tries, calls a second (None: any)."""

    def __init__(self, batch: int = 16, deadline_s: float = 30.0, retries: int = 2, calls_per_s: float | None = None):
        if batch < 1 or deadline_s <= 0 or retries < 0 or (calls_per_s is not None and calls_per_s <= 0):
            raise ValueError("limits must be positive")
        self.batch, self.deadline_s, self.retries, self.calls_per_s = batch, deadline_s, retries, calls_per_s


class _Caller:
    """Calls of one task under ``limits``."""

    def __init__(self, model: Callable, limits: Limits):
        self.model, self.limits, self.free_at = model, limits, 0.0

    def once(self, prompts: list[str]) -> list:
        """One call; raises what the model raises, ``TimeoutError`` after the deadline, ``ValueError`` for a wrong number of answers."""
        if self.limits.calls_per_s:
            now = time.monotonic()
            time.sleep(max(0.0, self.free_at - now))
            self.free_at = max(now, self.free_at) + 1.0 / self.limits.calls_per_s
        box: queue.Queue = queue.Queue()

        def run() -> None:
            try:
                box.put((list(self.model(prompts)), None))
            except BaseException as e:  # noqa: BLE001 - handed to the caller below
                box.put((None, e))

        threading.Thread(target=run, daemon=True).start()  # a hung one ends with the worker
        try:
            answers, error = box.get(timeout=self.limits.deadline_s)
        except queue.Empty:
            raise TimeoutError(f"no answer within {self.limits.deadline_s} s") from None
        if error is not None:
            raise error
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        return answers

    def tried(self, prompts: list[str]) -> list[tuple]:
        """(response, error) of each prompt."""
        error = ""
        for _ in range(1 + self.limits.retries):
            try:
                return [(a, None if a is not None else "no answer") for a in self.once(prompts)]
            except TimeoutError as e:  # a hung call is not repeated as it is
                error = str(e)
                break
            except Exception as e:  # noqa: BLE001 - whatever the model raises concerns its own prompts only
                error = f"{type(e).__name__}: {e}"[:500]
        if len(prompts) == 1:
            return [(None, error)]
        return [x for p in prompts for x in self.tried([p])]


def generate_with(df: DataFrame, prompt_col: str, load_fn, out: str = "response", limits: Limits | None = None,
                  error_col: str | None = None) -> DataFrame:
    """gen_batch_complete, without a table: every row's prompt is answered under ``limits``; what fails stays null."""
    limits = limits or Limits()
    fields = [*df.schema.fields, T.StructField(out, T.StringType())]
    if error_col:
        fields.append(T.StructField(error_col, T.StringType()))
    key = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        caller = _Caller(load_once(key, load_fn), limits)
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").astype(str).tolist()
            found = [x for a in range(0, len(prompts), limits.batch) for x in caller.tried(prompts[a:a + limits.batch])]
            pdf[out] = [r for r, _ in found]
            if error_col:
                pdf[error_col] = [e for _, e in found]
            yield pdf

    return df.mapInPandas(run, T.StructType(fields))


def responses(spark: SparkSession, store: str) -> DataFrame | None:
    """The response table, a row for each prompt and run; None if nothing was written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(RESPONSES + ", run string").parquet(store) if fs.exists(where) else None


def complete(df: DataFrame, prompt_col: str, load_fn, store: str, out: str = "response", limits: Limits | None = None,
             workers: int | None = None, attempts: int = 3) -> DataFrame:
    """gen_batch_complete: ``df`` with each prompt's response from the table ``store``, where missing ones are added first.

    ``workers`` is the number of tasks that call, so the service sees at most
    ``workers`` times the rate of ``limits``. Null prompts have no response."""
    spark = df.sparkSession
    keyed = df.withColumn("prompt_key", F.sha2(prompt_col, 256))
    wanted = keyed.where(c("prompt_key").isNotNull()).select("prompt_key", prompt_col).dropDuplicates(["prompt_key"])
    known = responses(spark, store)
    if known is not None:
        settled = (known.groupBy("prompt_key").agg(F.count("response").alias("answers"), F.count(F.lit(1)).alias("runs"))
                   .where((c("answers") > 0) | (c("runs") >= attempts)).select("prompt_key"))
        wanted = wanted.join(settled, "prompt_key", "left_anti")
    n = workers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    answered = generate_with(wanted.repartition(n, "prompt_key"), prompt_col, load_fn, "response", limits, "error")
    answered.select("prompt_key", "response", "error").write.parquet(os.path.join(store, f"run={uuid.uuid4().hex}"))
    best = responses(spark, store).groupBy("prompt_key").agg(F.max("response").alias(out))
    return keyed.join(best, "prompt_key", "left").drop("prompt_key")
