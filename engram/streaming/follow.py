"""Streams over the version log and over recall events: usage counters, a follower, archive by expiry, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def usage_stream(recalls: DataFrame) -> DataFrame:
    """recall_count and last_recalled of each id from a stream of (id, ts_ms): counted on hits only."""
    return recalls.groupBy("id").agg(F.count(F.lit(1)).alias("recall_count"), F.max("ts_ms").alias("last_recalled"))


def changes(have: DataFrame, images: DataFrame) -> DataFrame:
    """images (latest of each id) with op against what a replica has: insert, update, delete, or same."""
    old = have.select("id", F.struct("data", "updated").alias("old"))
    same = (F.col("old.data").eqNullSafe(F.col("data"))) & (F.col("old.updated") == F.col("updated"))
    op = F.when(F.col("deleted"), "delete").when(F.col("old").isNull(), "insert").when(same, "same").otherwise("update")
    return images.join(old, "id", "left").withColumn("op", op).drop("old")


def follow(spark: SparkSession, path: str, target: str, checkpoint: str, schema, generation: int = 0) -> StreamingQuery:
    """Copies new versions of a log folder to target, once each; the checkpoint is the cursor. A batch is written to a folder
    of its own number, which a replay overwrites, so that nothing is read back.

    generation is that of the source's log: another one than the target holds is a reset, by which the target starts
    anew with its own cursor."""
    base = f"{target}/generation={generation}"

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["id", "seq"]).write.mode("overwrite").parquet(f"{base}/batch={epoch}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/generation-{generation}").trigger(availableNow=True).start()


def followed(spark: SparkSession, target: str, schema, generation: int = 0) -> DataFrame:
    """What a follower has copied of a generation."""
    return spark.read.schema(schema).parquet(f"{target}/generation={generation}/batch=*")


def archive(stream: DataFrame, now: int) -> DataFrame:
    """Tombstones for rows of a stream of current images that are past their expiry."""
    gone = (F.col("expires_at") != 0) & (F.col("expires_at") <= now) & ~F.col("deleted")
    return stream.where(gone).withColumns({"deleted": F.lit(True), "updated": F.lit(now).cast("long")})


def windows(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums by event type in event-time windows with a watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Extension: the first row of each event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
