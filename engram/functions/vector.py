"""Vectors: dot products in a fixed order (results do not depend on the plan), cosine, 8-bit quantization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 256  # longer query vectors use a lambda instead of generated code


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def whole_dot(a: Column, b: Column) -> Column:
    """The inner product of whole numbers as a long."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def dot_query(v: Column, q: list[float]) -> Column:
    """v . q for a literal q: straight-line generated code."""
    if len(q) > UNROLL:
        return dot(v, F.array(*[F.lit(float(x)) for x in q]))
    return reduce(lambda s, t: s + t, [v[i].cast("double") * F.lit(float(x)) for i, x in enumerate(q)], F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a norm is 0."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def cosine_query(v: Column, q: list[float]) -> Column:
    size = sum((float(x) * float(x) for x in q), 0.0) ** 0.5
    n = norm(v) * F.lit(size)
    return F.when(n == 0, 0.0).otherwise(dot_query(v, q) / F.nullif(n, F.lit(0.0)))


def quantized(v: Column) -> Column:
    """struct(q array<tinyint>, scale): scale is the largest component / 127, components are rounded half away from 0."""
    scale = F.array_max(F.transform(doubles(v), F.abs)) / 127.0
    q = F.transform(doubles(v), lambda x: F.when(scale == 0, 0.0).otherwise(F.round(x / F.nullif(scale, F.lit(0.0)))).cast("tinyint"))
    return F.struct(q.alias("q"), scale.alias("scale"))
