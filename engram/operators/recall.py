"""Recall: the client's score, suppression of near duplicates, a context within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import truncated


def blend(sim: Column) -> Column:
    """Similarity, modulated by importance (0.5 if null) and confidence (1 if null), to four places."""
    return F.round(sim * (0.5 + 0.5 * F.coalesce("importance", F.lit(0.5))) * F.coalesce("confidence", F.lit(1.0)), 4)


def memory_shape(records: DataFrame) -> DataFrame:
    return records.select("id", F.col("data").alias("text"), F.col("type").alias("kind"), "tags", "importance", "confidence", "created", "updated")


def suppressed(hits: DataFrame, threshold: float, group: str = "query_id") -> DataFrame:
    """Hits (query_id, rank, id, vec) without those close to a better one that is kept; a page of hits goes to one task.

    A threshold outside (0, 1) changes nothing; rows without a vector are kept."""
    if not 0 < threshold < 1:
        return hits
    row, cols = F.struct("rank", "id", *[c for c in hits.columns if c not in ("rank", "id", group)]), hits.columns
    page = hits.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("page"))
    none = F.filter("page", lambda _: F.lit(False))
    close = lambda x: lambda k: (F.size(k["vec"]) > 0) & (V.cosine(k["vec"], x["vec"]) >= threshold)
    add = lambda kept, x: F.when((F.coalesce(F.size(x["vec"]), F.lit(0)) > 0) & F.exists(kept, close(x)), kept).otherwise(F.concat(kept, F.array(x)))
    return page.select(group, F.inline(F.aggregate("page", none, add))).select(*cols)


def context(hits: DataFrame, group: str = "query_id", per_memory: int = 500, budget: int = 2000) -> DataFrame:
    """(group, context, included): lines by rank until the first that would pass the budget; the first line always stays.

    hits: (group, rank, id, data, tags), a page for each group."""
    cap = min(per_memory, budget) if per_memory and budget else per_memory or budget
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" (tags: "), F.concat_ws(", ", "tags"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- [#"), F.col("id").cast("string"), F.lit("] "), truncated(F.regexp_replace(F.trim("data"), "\n", " "), cap), tags)
    w = Window.partitionBy(group).orderBy("rank")
    x = hits.select(group, "rank", line.alias("line")).withColumns({"used": F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w)})
    over = (F.col("n") > 1) & (F.col("used") > (budget or 2**31 - 1))
    x = x.withColumn("out", F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    g = x.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.when(~F.col("out"), F.struct("rank", "line")))), lambda s: s["line"]).alias("lines"), F.count_if("out").alias("omitted"))
    y = F.when(F.col("omitted") == 1, "y").otherwise("ies")
    trailer = F.when(F.col("omitted") > 0, F.concat(F.lit("- (+"), F.col("omitted").cast("string"), F.lit(" more relevant memor"), y, F.lit(" omitted to fit the recall budget; call memory_search to see the rest)")))
    text = F.concat_ws("\n", F.lit("Relevant memories from past sessions:"), F.concat_ws("\n", "lines"), trailer)
    return g.select(group, text.alias("context"), F.size("lines").alias("included"))
