"""Projections of vectors onto fixed planes and centres: one matrix product for each Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.zeros(dim) if x is None or len(x) != dim else np.asarray(x, float) for x in v]).reshape(len(v), dim)


def unit(dim: int):
    """A pandas UDF vector -> array<double> of length 1; zero vectors stay."""

    @F.pandas_udf("array<double>")
    def units(v: pd.Series) -> pd.Series:
        x = _matrix(v, dim)
        n = np.sqrt((x**2).sum(axis=1))[:, None]
        return pd.Series(list(x / np.where(n == 0, 1, n)))

    return units


def sign_keys(tables: int, bits: int, dim: int, seed: int):
    """A pandas UDF vector -> array<long>: for each table the signs on its planes, with the table's number."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        signs = (_matrix(v, dim) @ planes.T > 0).reshape(len(v), tables, bits)
        codes = signs @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
        return pd.Series(list(codes.astype(np.int64)))

    return keys


def nearest_centres(centres: list[list[float]], probes: int):
    """A pandas UDF vector -> array<int> of the nearest centres of its unit vector, the nearest first."""
    c = np.array(centres)
    square = 0.5 * (c**2).sum(axis=1)

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        x = _matrix(v, c.shape[1])
        n = np.sqrt((x**2).sum(axis=1))[:, None]
        d = square - (x / np.where(n == 0, 1, n)) @ c.T
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return lists
