"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's plan is executed completely with the ``noop`` sink (no collect
to the driver). One warm-up run is discarded; the reported time is the
median of the next runs ($BENCH_REPEATS, default 3). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "q_pipeline_summary": "pipe_run",          # features -> best offer -> guard -> lift -> summary
    "q_recommend": "agg_argmax_offer",         # in-row argmax over the catalogue
    "q_offer_ranking": "topk_offers_ranking",  # all offers ranked per subscriber
    "q_experience": "proj_rename",             # context -> rationale + message + guard
    "q_grounding": "rule_response_adjudicate",  # canned responses grounded and adjudicated
    "q_retrieval_topk": "ret_exact_topk",      # customer-scoped cosine top-k
    "q_retrieval_eval": "ret_evaluate",        # precision/recall, misses, payload
    "q_bulk_context": "ret_bulk_context",      # embed histories -> retrieve -> context
    "q_redact": "fn_redact",                   # whole-text redaction of all documents
}

# The costly ones, timed beside the nine above; "value" stays the sum of the nine, for comparison.
COSTLY = {
    "q_model_fit": "ml_gbt_fit",               # staged features -> boosted trees (refitted in every run)
    "q_model_score": "ml_recommend",           # model scores of all pairs -> best offer
    "q_embed": "emb_embed_batch",              # histories -> hashed term vectors
    "q_ann": "ret_ann_topk",                   # bucketed candidates -> top-k
    "q_stream": "ext_stream_embed",            # events stream -> written vectors
    "q_vector_write": "emb_batch_write",       # vectors clustered by customer
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from offerlens.session import get_session
    from offerlens.plans.catalog import QUERIES
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    from offerlens.plans import catalog
    times = {}
    for label, name in {**HEADLINE, **COSTLY}.items():
        runs = []
        for i in range(repeats + 1):
            if name == "ml_gbt_fit":
                catalog._MODELS.clear()
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        times[label] = round(statistics.median(runs), 3)
    total = round(sum(times[k] for k in HEADLINE), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "value_with_costly": round(sum(times.values()), 3), "sf": sf, "cpus": cpus, "repeats": repeats}))


if __name__ == "__main__":
    main()
