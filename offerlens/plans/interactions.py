"""Interaction histories from ``conversations`` (conv_id = customer, turn = order).

These are flat DataFrames keyed by customer; histories are never collected
into one row per customer (a customer may hold a large share of all rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.constants import INTERACTION_CHANNELS
from offerlens.functions.core import pick, zero_pad
from offerlens.functions.text import is_blank_or_sentinel, strip
from offerlens.operators.ranking import seq_within_group

c = F.col
REFERENCE_DATE = "2024-01-31"
SAMPLE_SALT = "history"
# FIXED VALUES: sizes of a customer's sample, and how many of them are relevant (3 from 6 on, else 2).
SAMPLE_FROM, SAMPLE_TO, SAMPLE_LEAST = 5, 10, 3
SAMPLE_MANY, RELEVANT_MANY, RELEVANT_FEW = 6, 3, 2


def sequenced(conversations: DataFrame) -> DataFrame:
    """win_seq_number: position within the history, zero-padded into the id."""
    return (seq_within_group(conversations, "conv_id", ["turn"], "seq")
            .withColumn("interaction_id", F.concat(c("conv_id").cast("string"), F.lit("-"), zero_pad(c("seq"), 2))))


def histories(conversations: DataFrame) -> DataFrame:
    """Conversation turns as interactions (one row each)."""
    s = sequenced(conversations)
    return s.select(
        "interaction_id", c("conv_id").alias("customer_id"),
        F.date_format(F.date_sub(F.to_date(F.lit(REFERENCE_DATE)), (c("seq") * 7).cast("int")), "yyyy-MM-dd")
        .alias("date"),
        F.lit(False).alias("is_current"),
        pick(INTERACTION_CHANNELS, c("turn") % 4).alias("channel"),
        "text", c("role").alias("topic"),
        (c("role") == "user").alias("is_relevant"))


def injected_transcripts(subs: DataFrame) -> DataFrame:
    """The subscriber's own care transcript as one extra record; blank texts
    and the no-contact sentinel are skipped (flt_blank_sentinel)."""
    t = subs.where(~is_blank_or_sentinel(c("transcript")))
    return t.select(
        F.concat(c("customer_id").cast("string"), F.lit("-transcript")).alias("interaction_id"),
        "customer_id", F.lit(None).cast("string").alias("date"), F.lit(True).alias("is_current"),
        F.lit("call").alias("channel"), strip(c("transcript")).alias("text"),
        F.lit("existing_transcript").alias("topic"), F.lit(True).alias("is_relevant"))


def union_corpora(conversations: DataFrame, subs: DataFrame) -> DataFrame:
    """set_union_corpora: histories + injected transcripts (unionByName)."""
    return histories(conversations).unionByName(injected_transcripts(subs))


def hex_number(digits: Column, n: int) -> Column:
    """The number that the first ``n`` hexadecimal digits stand for."""
    return F.conv(F.substring(digits, 1, n), 16, 10).cast("int")


def sample_sizes(key: Column, salt: str = SAMPLE_SALT) -> tuple[Column, Column]:
    """Interactions and relevant interactions that a key's sample asks for.

    Between SAMPLE_FROM and SAMPLE_TO of them (at least SAMPLE_LEAST), the number
    following from the key; relevant ones are RELEVANT_MANY of SAMPLE_MANY or
    more, else RELEVANT_FEW."""
    spread = F.md5(F.concat_ws("|", key.cast("string"), F.lit(f"{salt}-count")))
    n = F.greatest(F.lit(SAMPLE_FROM) + hex_number(spread, 4) % (SAMPLE_TO - SAMPLE_FROM + 1), F.lit(SAMPLE_LEAST))
    return n, F.when(n >= SAMPLE_MANY, RELEVANT_MANY).otherwise(RELEVANT_FEW)


def stable_sample(conversations: DataFrame, salt: str = SAMPLE_SALT) -> DataFrame:
    """win_stable_sample: a deterministic stratified sample per customer, without replacement.

    Relevant turns and the others are two strata with a quota each; a stratum
    with fewer rows than its quota gives all of them. Items are ordered by
    md5(customer|salt|item), the same in every run and engine."""
    h = F.md5(F.concat_ws("|", c("conv_id").cast("string"), F.lit(salt), c("turn").cast("string")))
    relevant = F.coalesce(c("role") == "user", F.lit(False))
    w = Window.partitionBy("conv_id", "is_relevant").orderBy(h, c("turn"))
    n, n_relevant = sample_sizes(c("conv_id"), salt)
    quota = F.when(c("is_relevant"), n_relevant).otherwise(n - n_relevant)
    # the largest quota as a literal lets Spark cut each stratum to that many rows per
    # map partition (partial WindowGroupLimit) before the shuffle
    most = max(RELEVANT_MANY, SAMPLE_TO - RELEVANT_FEW)
    return (conversations.withColumn("is_relevant", relevant).withColumn("pick", F.row_number().over(w))
            .where((c("pick") <= most) & (c("pick") <= quota))
            .select("conv_id", "turn", "is_relevant", "pick", n.alias("n_wanted")))
