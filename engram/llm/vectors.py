"""Arrow helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, quoted


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None where it is null or empty or holds null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    ok = ~flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
    ok &= np.isfinite(values)
    out, at = [], 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        out.append(values[at : at + n] if n and ok[at : at + n].all() else None)
        at += n
    return out


def doubles(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(id, label, v): v is the vector as packed doubles, null if it takes no part; label is null without label_col."""
    label = F.col(quoted(label_col)).cast("string") if label_col else F.lit(None).cast("string")
    x = df.select(F.col(quoted(id_col)).cast("long").alias("id"), label.alias("label"), F.col(quoted(vec_col)).alias("v"))

    def pack(b: pa.RecordBatch) -> dict:
        return {"id": b.column(0), "label": b.column(1), "v": pa.array([None if r is None else r.tobytes() for r in rows_of(b.column(2))], pa.binary())}

    return arrow_map(x, pack, "id long, label string, v binary")


def matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
