"""Retrieval quality: recall at k, mean reciprocal rank, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(query_id, recall_at_k..., rr) for each query with a relevant id. hits: (query_id, rank, id); relevant: (query_id, id)."""
    r = relevant.distinct()
    found = r.join(hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), ["query_id", "id"], "left")
    return found.groupBy("query_id").agg(*[F.round(F.count_if(F.col("rank") <= k) / F.count(F.lit(1)), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr"))


def means(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias("mrr" if c == "rr" else c) for c in scores.columns if c != "query_id"])


def gate(before: DataFrame, after: DataFrame, metric: str) -> bool:
    """A corpus change passes if the metric does not drop."""
    return after.first()[metric] >= before.first()[metric]


def lift(results: DataFrame) -> DataFrame:
    """(on, off, lift) from (arm, success)."""
    m = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("success").cast("int")))
    return results.agg(m("on").alias("on"), m("off").alias("off")).withColumn("lift", F.col("on") - F.col("off"))
