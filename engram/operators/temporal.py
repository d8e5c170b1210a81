"""Reads of the version log: latest, history, as of, validity, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def latest(versions: DataFrame) -> DataFrame:
    """The last appended image of each id: one aggregate, so that only one row an id leaves a map task."""
    cols = [c for c in versions.columns if c not in ("id", "seq")]
    return versions.groupBy("id").agg(F.max_by(F.struct("seq", *cols), "seq").alias("v")).select("id", "v.*")


def current(versions: DataFrame) -> DataFrame:
    return latest(versions).where(~F.col("deleted"))


def visible(versions: DataFrame, now: int, namespace: str | None = None) -> DataFrame:
    v = current(versions).where((F.col("expires_at") == 0) | (F.col("expires_at") > now))
    return v if namespace is None else v.where(F.col("agent_id") == namespace)


def history(versions: DataFrame) -> DataFrame:
    """All versions in order of appends with valid_from and valid_to (0 for the last)."""
    return versions.withColumns({"valid_from": F.col("updated"), "valid_to": F.coalesce(F.lead("updated").over(Window.partitionBy("id").orderBy("seq")), F.lit(0))})


def as_of(versions: DataFrame, at: int) -> DataFrame:
    """Each id's last appended version with updated <= at, without tombstones; expiry is not looked at."""
    return latest(versions.where(F.col("updated") <= at)).where(~F.col("deleted"))


def valid_at(versions: DataFrame, times: DataFrame) -> DataFrame:
    """For each (id, at) the version whose interval holds it: an equi-join on id, then the interval."""
    h = history(versions).withColumn("valid_to", F.when(F.col("valid_to") == 0, F.lit(2**63 - 1)).otherwise(F.col("valid_to")))
    return times.join(h, "id").where((F.col("valid_from") <= F.col("at")) & (F.col("at") < F.col("valid_to")))


def decay(updated: Column, now: int, half_life: int) -> Column:
    """2 to the minus age over half-life; the future has age 0."""
    return F.exp(F.lit(-LN2) * F.greatest(F.lit(now) - updated, F.lit(0)) / F.lit(float(max(half_life, 1000))))


def expired(records: DataFrame, now: int) -> DataFrame:
    """What a sweep tombstones."""
    return records.where(~F.col("deleted") & (F.col("expires_at") != 0) & (F.col("expires_at") <= now))
