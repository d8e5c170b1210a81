"""The graph of relationships: edges, breadth-first traversal, new links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..schema import DEPTH_MAX, RELATIONSHIPS_MAX, EngineError


def exploded(records: DataFrame) -> DataFrame:
    return records.select(F.explode("relationships").alias("e")).select("e.*")


def traverse(records: DataFrame, edges: DataFrame, start: int, depth: int = 1, namespace: str | None = None) -> DataFrame:
    """(id, level) of the visible records within depth steps of start, which is level 0.

    records: visible images; a record that is not among them is skipped with its edges. A frontier at a time: the
    next one is the frontier's targets less what is known, cut by a checkpoint; it ends early when none are left."""
    depth = 1 if depth < 0 else min(depth, DEPTH_MAX)
    live = records.select("id") if namespace is None else records.where(F.col("agent_id") == namespace).select("id")
    known = live.where(F.col("id") == start).withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        front = known.where(F.col("level") == level - 1).select(F.col("id").alias("from_id"))
        step = edges.join(front, "from_id").select(F.col("to_id").alias("id")).distinct().join(live, "id", "left_semi").join(known, "id", "left_anti")
        step = cut(step.withColumn("level", F.lit(level)))
        if step.isEmpty():
            break
        known = known.unionAll(step)
    return known


def relate(records: DataFrame, links: DataFrame, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with new relationships, refused links with a reason). links: (from_id, to_id, kind), different ones.

    Both ends must be there (and in the namespace); the same target and kind twice is no change."""
    live = records if namespace is None else records.where(F.col("agent_id") == namespace)
    ids = live.select("id")
    marked = links.distinct().join(ids.select(F.col("id").alias("from_id"), F.lit(1).alias("a")), "from_id", "left").join(ids.select(F.col("id").alias("to_id"), F.lit(1).alias("b")), "to_id", "left")
    marked = marked.withColumn("reason", F.when(F.col("from_id") == F.col("to_id"), "INVALID_REQUEST").when(F.col("a").isNull() | F.col("b").isNull(), "NOT_FOUND"))
    new = marked.where("reason is null").groupBy("from_id").agg(F.array_sort(F.collect_set(F.struct("from_id", "to_id", "kind"))).alias("new"))
    old = F.coalesce("relationships", F.expr("cast(array() as array<struct<from_id:bigint,to_id:bigint,kind:string>>)"))
    joined = F.array_union(old, "new")
    out = records.join(new.withColumnRenamed("from_id", "id"), "id").withColumn("relationships", joined).drop("new")
    full = out.where(F.size("relationships") > RELATIONSHIPS_MAX).select(F.col("id").alias("from_id"), F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("string").alias("kind"), F.lit("QUOTA_EXCEEDED").alias("reason"))
    return out.where(F.size("relationships") <= RELATIONSHIPS_MAX), marked.where("reason is not null").select("from_id", "to_id", "kind", "reason").unionAll(full)


def checked_depth(depth: int | None) -> int:
    if depth is not None and not isinstance(depth, int):
        raise EngineError("INVALID_REQUEST", "depth")
    return 1 if depth is None or depth < 0 else min(depth, DEPTH_MAX)
