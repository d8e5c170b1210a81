"""The record, its limits and the error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATIONSHIP = T.StructType([T.StructField("from_id", T.LongType()), T.StructField("to_id", T.LongType()), T.StructField("kind", T.StringType())])
RECORD = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("created", T.LongType()),
        T.StructField("updated", T.LongType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("relationships", T.ArrayType(RELATIONSHIP)),
        T.StructField("data", T.StringType()),
        T.StructField("expires_at", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)
#: The log of versions: a record image with its place in the order of appends.
VERSIONS = T.StructType([T.StructField("seq", T.LongType(), False), *RECORD.fields])

TYPES = ("working", "episodic", "semantic")
#: Limits of requests and records.
TAGS_MAX, TAG_CHARS, RELATIONSHIPS_MAX, VECTORS_MAX, AGENT_BYTES, DATA_BYTES = 32, 64, 4096, 64, 128, 1 << 20
TOP_K, TOP_K_MAX, FETCH_MAX, OFFSET_MAX = 10, 1000, 8192, 100_000
DEPTH, DEPTH_MAX, HALF_LIFE_MIN, RRF_K, BATCH_MAX, PAGE, PAGE_MAX = 1, 64, 1000, 60, 1000, 100, 1000
TERM_BYTES, QUERY_TERMS, SCAN_CAP, RING, RING_TTL, DIM = 64, 32, 100_000, 256, 3_600_000, 384

#: Error codes.
ERRORS = ("INVALID_REQUEST", "NOT_FOUND", "PAYLOAD_TOO_LARGE", "IMMUTABLE", "NOT_READY", "UNAUTHORIZED", "FORBIDDEN", "QUOTA_EXCEEDED", "RATE_LIMITED", "READ_ONLY", "MEMORY_LIMIT", "INTERNAL")


class EngineError(Exception):
    """An operation that is refused; code is one of ERRORS."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def rejection() -> Column:
    """The reason why a record can't be stored, or null: ranges, tags, namespace, size, vectors."""
    finite = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1), F.lit(True))
    tag = rf"^[A-Za-z0-9_-]{{1,{TAG_CHARS}}}$"
    vectors = F.coalesce(F.col("embedding"), F.array().cast("array<array<float>>"))
    size = F.octet_length("data")
    return (
        F.when(F.col("data").isNull() | (size == 0), "INVALID_REQUEST")
        .when(size > DATA_BYTES, "PAYLOAD_TOO_LARGE")
        .when(~finite("importance") | ~finite("confidence"), "INVALID_REQUEST")
        .when(~F.col("type").isin(*TYPES), "INVALID_REQUEST")
        .when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > TAGS_MAX, "INVALID_REQUEST")
        .when(~F.forall(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.rlike(tag)), "INVALID_REQUEST")
        .when(F.col("agent_id").isNotNull() & (~F.octet_length("agent_id").between(1, AGENT_BYTES) | F.col("agent_id").rlike(r"[\x00-\x1F\x7F]")), "INVALID_REQUEST")
        .when(F.size(vectors) > VECTORS_MAX, "INVALID_REQUEST")
        .when(F.size(F.array_distinct(F.transform(vectors, F.size))) > 1, "INVALID_REQUEST")
        .when(F.size(F.coalesce("relationships", F.array().cast(T.ArrayType(RELATIONSHIP)))) > RELATIONSHIPS_MAX, "QUOTA_EXCEEDED")
    )
