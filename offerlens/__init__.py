"""offerlens: next-best-offer decisioning and evaluation as lazy Spark DataFrame jobs.

Layout
------
sources/    table loading, literal dimensions, CSV/Parquet sinks, stage resume
functions/  Column-level helpers (rounding, text, formatting, vectors)
operators/  DataFrame -> DataFrame operators (rules, ranking, retrieval, ML)
plans/      end-to-end plans (subscriber features, recommendation, context,
            experience, evaluation, retrieval evaluation)
streaming/  Structured Streaming variant of the incremental corpus build
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
