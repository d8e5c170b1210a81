"""Session working memory and rate limits: batch forms, and stateful streams with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import RING, RING_TTL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_n(sessions: DataFrame, capacity: int = RING) -> DataFrame:
    """What a ring of each session holds: its last rows by local_id."""
    w = Window.partitionBy("session_id").orderBy(F.col("local_id").desc())
    return sessions.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= capacity).drop("__n")


def live_at(sessions: DataFrame, now: int, capacity: int = RING, ttl: int = RING_TTL) -> DataFrame:
    """The ring's content at a time: rows that were added by then and are not older than ttl."""
    return last_n(sessions.where(F.col("created") <= now), capacity).where(F.col("created") + ttl > now)


def promoted(sessions: DataFrame, picks: DataFrame, now: int, capacity: int = RING, ttl: int = RING_TTL, to_type: str = "episodic") -> tuple[DataFrame, DataFrame]:
    """(images to insert, what the rings hold after): picks (session_id, local_id) that are live are taken out of their ring
    and become records that do not expire; others are not found and change nothing."""
    live, key = live_at(sessions, now, capacity, ttl), ["session_id", "local_id"]
    taken = live.join(picks.select(*key).distinct(), key, "left_semi")
    images = taken.withColumns({"type": F.lit(to_type), "created": F.lit(now).cast("long"), "updated": F.lit(now).cast("long"), "expires_at": F.lit(0).cast("long")})
    return images, live.join(picks.select(*key).distinct(), key, "left_anti")


class Bucket:
    """A token bucket: full at first sight, refilled by qps a second up to burst (1 at least)."""

    def __init__(self, qps: float, burst: float, tokens: float | None = None, last: int = 0):
        self.qps, self.burst = qps, max(1.0, burst)
        self.tokens, self.last = tokens, last

    def allow(self, at_us: int) -> bool:
        if self.qps <= 0:
            return True
        if self.tokens is None:
            self.tokens, self.last = self.burst, at_us
        elif at_us > self.last:
            self.tokens = min(self.burst, self.tokens + (at_us - self.last) / 1e6 * self.qps)
            self.last = at_us
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


def bucket_batch(requests: DataFrame, qps: float, burst: float) -> DataFrame:
    """requests (agent_id, at_us, seq) with allowed. A namespace is an ordered fold; its rows stream through a task
    in order, so that memory does not grow with them."""
    schema = "agent_id string, at_us long, seq long, allowed boolean"
    ordered = requests.select("agent_id", "at_us", "seq").repartition("agent_id").sortWithinPartitions("agent_id", "at_us", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = None, None
        for pdf in batches:
            allowed = []
            for a, t in zip(pdf.agent_id, pdf.at_us, strict=True):
                if bucket is None or a != key:
                    key, bucket = a, Bucket(qps, burst)
                allowed.append(bucket.allow(int(t)))
            yield pdf.assign(allowed=allowed)

    return ordered.mapInPandas(run, schema)


class RingProcessor(StatefulProcessor):
    """Keeps the last rows of a session in state and emits what the ring holds after each batch."""

    def __init__(self, capacity: int = RING, ttl: int = RING_TTL):
        self.capacity, self.ttl = capacity, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "local_id long, data string, created long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for pdf in rows:
            held += list(zip(pdf.local_id.tolist(), pdf.data.tolist(), pdf.created.tolist(), strict=True))
        held.sort(key=lambda r: r[0])
        held = held[-self.capacity :]
        now = max(r[2] for r in held)
        held = [r for r in held if r[2] + self.ttl > now]
        self.rows.put(held)
        yield pd.DataFrame({"session_id": [key[0]] * len(held), "local_id": [r[0] for r in held], "data": [r[1] for r in held], "created": [r[2] for r in held]})

    def close(self) -> None:
        pass


def ring_stream(stream: DataFrame, capacity: int = RING, ttl: int = RING_TTL) -> DataFrame:
    """The rings of a stream of (session_id, local_id, data, created); the state store must be RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy("session_id").transformWithStateInPandas(RingProcessor(capacity, ttl), "session_id string, local_id long, data string, created long", "Update", "None")


def bucket_stream(stream: DataFrame, qps: float, burst: float) -> DataFrame:
    """A stream of (agent_id, at_us, seq) with allowed; tokens and the last refill are the state of a namespace."""

    def run(key, frames, state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (None, 0)
        bucket = Bucket(qps, burst, tokens, last)
        pdf = pd.concat(list(frames)).sort_values(["at_us", "seq"])
        out = pdf.assign(allowed=[bucket.allow(int(t)) for t in pdf.at_us])
        state.update((bucket.tokens, bucket.last))
        yield out[["agent_id", "at_us", "seq", "allowed"]]

    return stream.groupBy("agent_id").applyInPandasWithState(run, "agent_id string, at_us long, seq long, allowed boolean", "tokens double, last long", "append", "NoTimeout")
