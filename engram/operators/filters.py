"""Predicates of search, count and delete, as one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tags_match(tags: tuple[str, ...], match: str = "all") -> Column:
    """Any match but "any" means all; no tags match everything."""
    if match == "any":
        return F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return reduce(lambda a, b: a & b, [F.array_contains("tags", t) for t in tags])


def record_filter(type: str | None = None, tags: tuple[str, ...] = (), match: str = "all", start: int | None = None, end: int | None = None, max_importance: float | None = None, namespace: str | None = None, now: int | None = None) -> Column:
    """The conjunction of what is given. The time range counts only if both ends are; a null agent_id is in no namespace."""
    parts = [~F.col("deleted")]
    if type is not None:
        parts.append(F.col("type") == type)
    if max_importance is not None:
        parts.append(F.col("importance").cast("float") <= F.lit(max_importance).cast("float"))
    if namespace is not None:
        parts.append(F.col("agent_id") == namespace)
    if start is not None and end is not None:
        parts.append(F.col("created").between(start, end))
    if tags:
        parts.append(tags_match(tuple(tags), match))
    if now is not None:
        parts.append((F.col("expires_at") == 0) | (F.col("expires_at") > now))
    return reduce(lambda a, b: a & b, parts)


def capped(records: DataFrame, cap: int, oldest: bool = False) -> DataFrame:
    """The newest (or oldest) cap rows by created, id: what a read without tags sees before other predicates."""
    order = [F.col("created"), F.col("id")] if oldest else [F.col("created").desc(), F.col("id").desc()]
    return records.orderBy(*order).limit(cap)


def page(df: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def export_page(current: DataFrame, namespace: str, after: int, limit: int) -> DataFrame:
    """A page in order of ids, with has_more and the cursor on each row: limit + 1 rows are read, no count."""
    rows = current.where((F.col("agent_id") == namespace) & (F.col("id") > after)).orderBy("id").limit(limit + 1)
    numbered = rows.withColumn("__n", F.expr("row_number() over (order by id)"))
    more = F.expr("max(__n) over (rows between unbounded preceding and unbounded following)") > limit
    out = numbered.withColumn("has_more", more).where(F.col("__n") <= limit)
    return out.withColumn("cursor", F.expr("max(id) over (rows between unbounded preceding and unbounded following)")).drop("__n")
