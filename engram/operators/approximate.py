"""Approximate vector search: inverted lists of k-means, random hyperplanes; exact ranking of the candidates.

Candidates are ranked in cells of bounded size, a block of queries against a block of vectors: a matrix product of unit
vectors leaves those that can be among the k best, and only these get the cosine of functions.vector. No list of pairs is
made, a cell gives on k rows for each of its queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.project import nearest_centres, sign_keys, unit

#: Bounds of a cell: vectors (VECTORS_LEAST, if there would be fewer cells than cores) and queries; rows of one matrix product.
VECTORS, VECTORS_LEAST, QUERIES, SLAB_V, SLAB_Q = 32_768, 4096, 2048, 2048, 512
#: Norms beyond this range can leave that of doubles when squared or multiplied: such rows are always compared in full.
TINY, HUGE = 1e-140, 1e140


def fit_lists(vectors: DataFrame, lists: int, sample_rows: int = 50_000, seed: int = 42) -> list[list[float]]:
    """Centres of inverted lists, fitted on at most about sample_rows rows; every row is then assigned to one."""
    n = vectors.count()
    share = min(1.0, sample_rows / max(1, n))
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    model = KMeans(k=lists, seed=seed, maxIter=15).fit(some.select(array_to_vector(unit(len(vectors.first().vec))("vec")).alias("features")))
    return [c.tolist() for c in model.clusterCenters()]


def assigned(vectors: DataFrame, centres: list[list[float]], probes: int = 1) -> DataFrame:
    """vectors with `lists`: the nearest centres of each."""
    return vectors.withColumn("lists", nearest_centres(centres, probes)("vec"))


def ivf_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 8, probes: int = 4) -> DataFrame:
    """(query_id, rank, id, sim): queries probe a few lists; exact cosines within a list."""
    centres = fit_lists(vectors, lists)
    base = assigned(vectors, centres).select("id", "vec", F.col("lists")[0].alias("key"))
    probe = assigned(queries, centres, probes).select("query_id", "vec", F.explode("lists").alias("key"))
    return _ranked(_cells(base, probe, k), k)


def lsh_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 24, bits: int = 4, seed: int = 42) -> DataFrame:
    """(query_id, rank, id, sim): candidates share the signs of some random hyperplanes in one table at least.

    Where the tables together hold a pair about once or more, as tables / 2^bits says, each pair is looked at once with all
    its keys; else cells are made within each key."""
    keys = sign_keys(tables, bits, len(vectors.first().vec), seed)
    if tables * 4 >= 1 << bits:
        return _ranked(_cells(vectors.select("id", "vec", keys("vec").alias("codes")), queries.select("query_id", "vec", keys("vec").alias("codes")), k), k)
    return _ranked(_cells(vectors.select("id", "vec", F.explode(keys("vec")).alias("key")), queries.select("query_id", "vec", F.explode(keys("vec")).alias("key")), k).distinct(), k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, sim) of queries (query_id, vec) over all vectors."""
    return _ranked(_cells(vectors.select("id", "vec"), queries.select("query_id", "vec"), k), k)


def _cells(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim): for each query and block of vectors the k best, by cosines rounded to 9 places, then by id. Vectors
    (id, vec) and queries (query_id, vec) may have a key, then those of one key meet, and codes, then those meet that have an
    equal one at an equal place. Vectors of other lengths, with nulls or with components that are not finite meet nothing."""
    if "key" not in vectors.columns:
        vectors, queries = vectors.withColumn("key", F.lit(0)), queries.withColumn("key", F.lit(0))
    kept = [F.col(c).alias(c) for c in ("key", "vec", "codes") if c in vectors.columns]  # by new names, as both sides may be of one table
    sizes = lambda df: df.groupBy("key").count().agg(F.count(F.lit(1)), F.coalesce(F.max("count"), F.lit(0))).first()
    (keys, v), (_, q) = sizes(vectors), sizes(queries)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    nv, nq = max(1, -(-v // VECTORS), min(-(-cores // max(1, keys)), -(-v // VECTORS_LEAST))), max(1, -(-q // QUERIES))
    cells, at = min(max(cores, keys * nv * nq), 10_000), ["key", "vb", "qb"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c, "vec"), F.lit(n)).cast("int")
    base = vectors.select(F.col("id").cast("long").alias("id"), *kept, block("id", nv).alias("vb"), each(nq).alias("qb"))
    asked = queries.select(F.col("query_id").cast("long").alias("id"), *kept, each(nv).alias("vb"), block("query_id", nq).alias("qb"))
    pairs = base.repartition(cells, *at).groupBy(*at).cogroup(asked.repartition(cells, *at).groupBy(*at))
    return pairs.applyInArrow(_cell(k), "query_id long, id long, sim double")


def _by_length(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Length, ids, vectors and codes of the rows that take part."""
    flat = lambda a: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    vec, ids = flat(t.column("vec")), t.column("id").to_numpy()
    size = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
    for n in sorted({*size.tolist()} - {-1}):
        rows = np.flatnonzero(size == n)
        x = vec.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), n)
        rows, x = rows[good := np.isfinite(x).all(axis=1)], x[good]
        codes = np.array(flat(t.column("codes")).take(pa.array(rows)).to_pylist(), np.int64).reshape(len(rows), -1) if "codes" in t.column_names else None
        if len(rows):
            yield n, ids[rows], x, codes


def rounded(s: np.ndarray) -> np.ndarray:
    """Cosines rounded to 9 places, half up by their decimal digits, as Spark rounds."""
    m = np.abs(s) * 1e9
    out = np.floor(m + 0.5) / 1e9
    for i in np.flatnonzero(np.abs(m - np.floor(m) - 0.5) < 1e-4).tolist():
        out[i] = float(Decimal(repr(abs(float(s[i])))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return np.copysign(out, s) + 0.0


def _norms(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for c in range(x.shape[1]):
        s += x[:, c] * x[:, c]
    return np.sqrt(s)


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if base.num_rows and asked.num_rows:
            by = {n: some for n, *some in _by_length(base)}
            with np.errstate(all="ignore"):
                for n, ids, q, codes in _by_length(asked):
                    if n in by:
                        found += _nearest(*by[n], ids, q, codes, k)
        return pa.table({c: pa.array(np.concatenate([f[i] for f in found]) if found else [], kind) for i, (c, kind) in enumerate((("query_id", pa.int64()), ("id", pa.int64()), ("sim", pa.float64())))})

    return run


def _nearest(xid: np.ndarray, x: np.ndarray, xcodes: np.ndarray | None, qid: np.ndarray, q: np.ndarray, qcodes: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, cosines): the k best of each query. Equal vectors are looked at once, the k smallest ids of each."""
    dim = x.shape[1]
    margin = 2e-9 + (dim + 8) * 2.0**-23  # of rounding to 9 places and of products of floats
    same = lambda m: np.unique(np.ascontiguousarray(m).view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)[1:] if dim else (np.array([0]), np.zeros(len(m), int))
    _, copy = same(x)
    order = np.lexsort((xid, copy))
    held = order[place(copy[order]) < k]  # of copies that the order by id cuts
    x, xid, xcodes = x[held], xid[held], None if xcodes is None else xcodes[held]
    once, which = same(q)
    q, qcodes = q[once], None if qcodes is None else qcodes[once]
    xn, qn = _norms(x), _norms(q)
    odd = lambda n: (n < TINY) | (n > HUGE)
    unit = lambda m, n: np.where(odd(n)[:, None], 0, m / n[:, None]).astype(np.float32)
    ux, uq, xodd, qodd, xt, qt = unit(x, xn), unit(q, qn), odd(xn), odd(qn), np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)
    got_i, got_j, got_s = [], [], []
    for a in range(0, len(q), SLAB_Q):
        rows = slice(a, a + SLAB_Q)
        n = len(uq[rows])
        least = np.full(n, -np.inf)
        pi, pj, ps = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for b in range(0, len(x), SLAB_V):
            cols = slice(b, b + SLAB_V)
            sim = uq[rows] @ ux[cols].T
            plain, meets, low = ~(xodd[cols][None, :] | qodd[rows][:, None]), None, least
            if np.isneginf(least).any():
                if qcodes is not None:
                    meets = np.zeros(sim.shape, bool)
                    for t in range(qcodes.shape[1]):
                        meets |= qcodes[rows, t][:, None] == xcodes[cols, t][None, :]
                if sim.shape[1] > k:
                    some = np.where(plain if meets is None else plain & meets, sim, -np.inf)
                    low = np.maximum(least, np.partition(some, -k, axis=1)[:, -k])
            near = (sim >= (low - margin)[:, None]) | ~plain
            i, j = np.nonzero(near if meets is None else near & meets)
            j = j + b
            if qcodes is not None and meets is None:
                i, j = (y[(qcodes[i + a] == xcodes[j]).any(axis=1)] for y in (i, j))
            s = np.zeros(len(i))
            for c in range(dim):
                s += qt[c][i + a] * xt[c][j]
            size = xn[j] * qn[i + a]
            s = np.where(size == 0, 0.0, s / size)
            good = ~np.isnan(s)
            pi, pj, ps = np.concatenate([pi, i[good]]), np.concatenate([pj, j[good]]), np.concatenate([ps, rounded(s[good])])
            order = np.lexsort((xid[pj], -ps, pi))
            order = order[place(pi[order]) < k]
            pi, pj, ps = pi[order], pj[order], ps[order]
            last = np.flatnonzero(place(pi) == k - 1)
            least[pi[last]] = ps[last]
        got_i.append(pi + a)
        got_j.append(pj)
        got_s.append(ps)
    gi, gj, gs = np.concatenate(got_i), np.concatenate(got_j), np.concatenate(got_s)
    start, times = np.searchsorted(gi, np.arange(len(q))), np.bincount(gi, minlength=len(q))
    of = np.repeat(np.arange(len(qid)), times[which])
    at = np.repeat(start[which], times[which]) + place(of)
    yield qid[of], xid[gj[at]], gs[at]


def place(groups: np.ndarray) -> np.ndarray:
    """The place of each row within its group; rows of a group lie together."""
    n = np.arange(len(groups))
    new = np.r_[True, groups[1:] != groups[:-1]][: len(groups)]
    return n - np.maximum.accumulate(np.where(new, n, 0))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("sim", 6).alias("sim"))


def recall_at(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall) of an approximate result against the exact one."""
    hit = exact.join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
