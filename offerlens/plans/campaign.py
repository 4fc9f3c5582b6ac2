"""One campaign run: every stage is written once and the later stages read what was written.

subscribers (with retrieved interactions) -> recommendation by rules or model
-> context records -> texts and guard -> evaluation detail -> summary.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.operators import ml as ML
from offerlens.operators import retrieval as R
from offerlens.plans import decision as D
from offerlens.sources import files as FS

c = F.col

#: What a run leaves in its folder.
OUTPUTS = ("campaign_triggers", "contexts", "experience", "evaluation_detail", "summary")


def with_retrieval(subs: DataFrame, hits: DataFrame | None) -> DataFrame:
    """``subs`` with retrieval_mode, retrieved_interactions and the transcript they imply."""
    if hits is not None:
        return R.retrieval_context(subs, hits)
    none = F.array().cast("array<struct<text:string,date:string,channel:string,similarity:double>>")
    return subs.withColumn("retrieval_mode", F.lit("full_dump")).withColumn("retrieved_interactions", none)


def run_campaign(subs: DataFrame, out: str, variant: str = "A", model=None, hits: DataFrame | None = None,
                 response=None) -> dict[str, str]:
    """Run all stages into the folder ``out``; returns the paths by output.

    ``model`` is a fitted propensity pipeline (None: the rule score), ``hits``
    are retrieved interactions with their texts, ``response`` maps the decided
    table to one with a ``response`` column of raw model texts (None: rules)."""
    spark = subs.sparkSession
    paths = {name: os.path.join(out, name) for name in OUTPUTS}
    ready = with_retrieval(subs, hits)
    rec = ML.recommend_model(model, ready) if model is not None else None
    FS.write_stage(D.decide(ready, variant, rec), os.path.join(out, "decided"))
    decided = FS.read_stage(spark, os.path.join(out, "decided"))

    FS.write_csv(FS.escape_breaks(decided.select(*D.REC_COLUMNS)), paths["campaign_triggers"])
    FS.write_stage(decided.select("customer_id", F.to_json(D.context_struct(variant, retrieval=True), {"ignoreNullFields": "false"})
                                  .alias("context")), paths["contexts"])
    told = response(decided) if response else decided
    texts = D.experience(told, variant, response=c("response") if response else None)
    FS.write_csv(FS.escape_breaks(texts), paths["experience"])
    FS.write_stage(D.evaluation_detail(decided), paths["evaluation_detail"])
    detail = FS.read_stage(spark, paths["evaluation_detail"])
    FS.write_csv(D.summary_long(D.summary_wide(detail), variant), paths["summary"])
    return paths
