"""Statistics: counts, latency histogram with interpolated percentiles, tenants, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import latest

#: Upper bounds of the histogram, microseconds; what is above is the overflow.
BOUNDS = (100, 250, 500, 1000, 2500, 5000, 10_000, 25_000, 50_000, 100_000, 250_000)


def live_and_tombstones(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("tombstones"))


def histogram(df: DataFrame, micros: str) -> DataFrame:
    """(bound, n, cumulative) for each bound; the overflow has bound null and stands last."""
    spark = df.sparkSession
    slot = F.coalesce(*[F.when(F.col(micros) <= b, i) for i, b in enumerate(BOUNDS)], F.lit(len(BOUNDS)))
    counts = df.where(F.col(micros).isNotNull()).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = spark.createDataFrame([(i, b) for i, b in enumerate([*BOUNDS, None])], "slot int, bound long")
    full = slots.join(counts, "slot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("cumulative", F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))  # a dozen rows


def percentiles(hist: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """One row: linear within a bucket; the overflow gives the last bound; 0 without observations."""
    w = Window.orderBy("slot")
    h = hist.withColumns({"before": F.col("cumulative") - F.col("n"), "low": F.coalesce(F.lag("bound").over(w), F.lit(0)), "total": F.max("cumulative").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    aggs = []
    for name, q in quantiles.items():
        rank = F.lit(q) * F.col("total")
        inside = F.col("low") + (F.col("bound") - F.col("low")) * (rank - F.col("before")) / F.nullif(F.col("n"), F.lit(0))
        at = (F.col("cumulative") >= rank) & (F.col("n") > 0)
        aggs.append(F.coalesce(F.min_by(F.coalesce(inside, F.lit(float(BOUNDS[-1]))), F.when(at, F.col("slot"))), F.lit(0.0)).alias(name))
    return h.agg(*aggs)


def tenants(current: DataFrame, size: str = "data") -> DataFrame:
    """(agent_id, records, bytes) of live records."""
    return current.where("agent_id is not null").groupBy("agent_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(size)).cast("long").alias("bytes"))


def over_quota(usage: DataFrame, growth: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """Tenants whose use with the growth (agent_id, add_records, add_bytes) is above a limit; 0 is no limit."""
    x = growth.join(usage, "agent_id", "left").withColumns({"records": F.coalesce("records", F.lit(0)) + F.col("add_records"), "bytes": F.coalesce("bytes", F.lit(0)) + F.col("add_bytes")})
    above = F.lit(False)
    if max_records:
        above = above | (F.col("records") > max_records)
    if max_bytes:
        above = above | (F.col("bytes") > max_bytes)
    return x.where(above).select("agent_id", "records", "bytes")


def rollup(versions: DataFrame, usage: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: records, tombstones, log_bytes, tenants, usage_tracked, operations, requests and the request latencies'
    p50, p95 and p99. versions: the log; usage: a row for each record that was recalled; requests: (op, us)."""
    last = latest(versions)
    store = last.agg(F.count_if(~F.col("deleted")).alias("records"), F.count_if("deleted").alias("tombstones"), F.countDistinct(F.when(~F.col("deleted"), F.col("agent_id"))).alias("tenants"))
    parts = [versions.agg(F.sum(F.octet_length("data")).cast("long").alias("log_bytes")), usage.agg(F.count(F.lit(1)).alias("usage_tracked")), requests.agg(F.countDistinct("op").alias("operations"), F.count(F.lit(1)).alias("requests")), percentiles(histogram(requests, "us"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})]
    for p in parts:
        store = store.join(F.broadcast(p))  # one row each
    return store


def families(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """The statistics as samples of metric families, for lines.exposition: (name, kind, help, suffix, labels, value, pos)."""
    live = latest(versions)
    none, label = F.expr("cast(map() as map<string,string>)"), lambda k, c: F.create_map(F.lit(k), F.col(c))

    def family(rows: DataFrame, name: str, kind: str, help_: str, labels) -> DataFrame:
        return rows.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(help_).alias("help"), F.lit(None).cast("string").alias("suffix"), labels.alias("labels"), F.col("value").cast("double").alias("value"), F.row_number().over(Window.orderBy("value")).alias("pos"))

    out = family(live.agg(F.count_if(~F.col("deleted")).alias("value")), "memory_records", "gauge", "live records", none)
    out = out.unionAll(family(live.agg(F.count_if("deleted").alias("value")), "memory_tombstones", "gauge", "tombstones", none))
    out = out.unionAll(family(requests.groupBy("op").agg(F.count(F.lit(1)).alias("value")), "memory_requests_total", "counter", "requests by operation", label("op", "op")))
    return out.unionAll(family(live.where(~F.col("deleted")).groupBy("agent_id").agg(F.count(F.lit(1)).alias("value")), "memory_tenant_records", "gauge", "live records by namespace", label("namespace", "agent_id")))
