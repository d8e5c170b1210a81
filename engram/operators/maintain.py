"""Maintenance: forgetting, consolidation, purge, sweep, compaction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import vector as V
from ..functions.project import sign_keys
from ..schema import TAGS_MAX
from .temporal import LN2, latest

WEEK = 604_800_000
BLOCK, MISS = 64, 1e-4


def retention(now: int, half_life: int, usage_weight: float) -> Column:
    """importance * 2^(-age / half-life) * boost; age from the later of updated and last_recalled."""
    age = F.greatest(F.lit(now) - F.greatest("updated", F.coalesce("last_recalled", F.lit(0))), F.lit(0))
    boost = 1 + F.lit(float(usage_weight)) * (1 - 1 / (1 + F.coalesce("recall_count", F.lit(0))))
    return F.col("importance") * F.exp(F.lit(-LN2) * age / F.lit(float(max(half_life, 1000)))) * boost


def forget(records: DataFrame, usage: DataFrame, now: int, type: str = "episodic", half_life: int = WEEK, min_retention: float = 0.05, usage_weight: float = 1.0, max_forget: int = 0, namespace: str | None = None) -> DataFrame:
    """Live records whose retention is below the floor, with it. max_forget takes the smallest ids."""
    r = records.where(~F.col("deleted") & (F.col("type") == type))
    if namespace is not None:
        r = r.where(F.col("agent_id") == namespace)
    out = r.join(usage, "id", "left").withColumn("retention", F.round(retention(now, half_life, usage_weight), 9)).where(F.col("retention") < min_retention)
    return out.orderBy("id").limit(max_forget) if max_forget else out


def members_of(vectors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, rep, by): the smallest id with an equal vector within a group. Members are never gathered."""
    classes = vectors.groupBy("vec", *by).agg(F.min("id").alias("rep")).withColumn("h", F.xxhash64("vec", *by))
    on = [F.col("v.h") == F.col("c.h"), F.col("v.vec") == F.col("c.vec"), *[F.col(f"v.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]]
    return vectors.withColumn("h", F.xxhash64("vec", *by)).alias("v").join(classes.alias("c"), on).select("v.id", "c.rep", *[f"v.{c}" for c in by])


def near_pairs(reps: DataFrame, similarity: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, sim) of different vectors (id, vec, by) with a < b and cosine >= similarity, within groups.

    Vectors are blocked by the signs of projections. A block has BLOCK of them on average, however many there are: the
    number of signs grows with the logarithm of theirs, and that of the tables so that a pair at the threshold shares a
    block in none of them with a chance below MISS."""
    first, n = reps.select("vec").first(), reps.count()
    if first is None:
        return reps.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim")).limit(0)
    bits = max(4, math.ceil(math.log2(max(2, n) / BLOCK)))
    same = (1 - math.acos(min(1.0, similarity)) / math.pi) ** bits
    tables = 1 if same >= 1 else math.ceil(math.log(MISS) / math.log(1 - same))
    blocked = reps.select("id", "vec", *by, F.explode(sign_keys(tables, bits, len(first.vec), 7)("vec")).alias("block"))
    x, y = blocked.alias("x"), blocked.alias("y")
    on = [F.col("x.block") == F.col("y.block"), F.col("x.id") < F.col("y.id"), *[F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]]
    near = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(V.cosine(F.col("x.vec"), F.col("y.vec")), 9).alias("sim"))
    return near.where(F.col("sim") >= similarity).distinct()


def _classes(vectors: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Members, and the vectors of representatives."""
    members = cut(members_of(vectors.select("id", "vec", *by), by))
    return members, cut(vectors.select("id", "vec", *by).join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))


def similar_pairs(vectors: DataFrame, similarity: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, sim): each copy with the representative of its class (the smallest id with an equal vector), and similar
    pairs of representatives. Other pairs follow from these."""
    members, reps = _classes(vectors, by)
    same = members.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    return same.unionAll(near_pairs(reps, similarity, by))


def clusters(vectors: DataFrame, similarity: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, seed) of every vector: copies go where their representative goes."""
    members, reps = _classes(vectors, by)
    pairs = cut(near_pairs(reps, similarity, by))
    seeds = stars(pairs, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")))
    return members.join(seeds.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("seed", "rep").alias("seed"))


def stars(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, seed): clusters around seeds taken in order of ids; a record of an earlier cluster seeds none. Not transitive.

    A round makes seeds of all ids without a smaller open neighbour; ids next to a new seed go to the smallest. It goes on
    until no id is open: each round settles the smallest open id at least."""
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    open_ = cut(ids.select("id").distinct())
    done = open_.select("id", F.col("id").alias("seed")).limit(0)
    while not open_.isEmpty():
        edges = both.join(open_.withColumnRenamed("id", "u"), "u", "left_semi").join(open_.withColumnRenamed("id", "v"), "v", "left_semi")
        least = open_.join(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "id"), "id", "left")
        seeds = least.where(F.col("m").isNull() | (F.col("m") > F.col("id"))).select("id")
        near = edges.join(seeds.withColumnRenamed("id", "v"), "v", "left_semi").groupBy("u").agg(F.min("v").alias("seed")).withColumnRenamed("u", "id")
        got = cut(seeds.select("id", F.col("id").alias("seed")).unionAll(near.join(seeds, "id", "left_anti").select("id", "seed")))
        done = cut(done.unionAll(got))
        open_ = cut(open_.join(got, "id", "left_anti"))
        both = cut(edges.join(open_.withColumnRenamed("id", "u"), "u", "left_semi"))
    return done


def merged(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """A survivor for each cluster of two or more: the newest (largest id of equals) with the union of tags (the first
    TAGS_MAX in order), the largest importance and confidence, and the ids that it supersedes."""
    m = records.join(clusters, "id")
    best = F.max_by("id", F.struct("updated", "id"))
    out = m.groupBy("seed").agg(best.alias("survivor"), F.count(F.lit(1)).alias("members"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), 1, TAGS_MAX).alias("tags"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("id")).alias("ids"))
    return out.where("members > 1").withColumn("supersedes", F.filter("ids", lambda i: i != F.col("survivor"))).drop("ids")


def purge(versions: DataFrame, namespace: str) -> DataFrame:
    """The log without a namespace."""
    return versions.where(F.col("agent_id").isNull() | (F.col("agent_id") != namespace))


def compacted(versions: DataFrame) -> DataFrame:
    """Only the latest live image of each id."""
    return latest(versions).where(~F.col("deleted"))


def compaction_worthwhile(versions: DataFrame) -> DataFrame:
    """(live, dead, worthwhile): dead images are a fourth of all or more."""
    total = versions.agg(F.count(F.lit(1)).alias("total"))
    live = latest(versions).agg(F.count_if(~F.col("deleted")).alias("live"))
    x = live.join(F.broadcast(total)).select("live", (F.col("total") - F.col("live")).alias("dead"))
    return x.withColumn("worthwhile", (F.col("dead") > 0) & (F.col("dead") * 4 >= F.col("live") + F.col("dead")))
