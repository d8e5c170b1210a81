"""Exact top-k search by dual cover trees.

Vectors near one pivot form groups of bounded size (with sign bits of random planes where a pivot has more). A task builds
a cover tree over a group's vectors and one over each block of queries that visits it. Pairs of nodes are pruned when no
inner product between them can reach the worst kth score of the query node: <q, r> <= <cq, cr> + |cq| Rr + |cr| Rq + Rq Rr
for centres c and covering radii R.

Queries first visit the group of their own pivot, which gives them a kth score. The roots of all groups and of all blocks
of queries are then compared by the same bound, in blocks of roots, and queries are sent only to groups that the bound
leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import arrow_map, cut, partitions, prepare
from .vectors import doubles, matrix

#: Bounds: vectors of a group and queries of a block, leaves of trees, the pivots' sample (expected rows) and number, roots of a block.
GROUP, BLOCK, LEAF, SAMPLE_ROWS, PIVOTS, ROOTS = 8192, 512, 64, 2048, 128, 1024
#: Components from here on make a vector huge: its squares could leave the range of doubles, so it is never pruned.
HUGE = 2.0**200
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Node:
    """A node of a cover tree: rows of the matrix, centre, covering radius, children within half the radius."""

    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.rows = rows
        if np.abs(x[rows]).max() >= HUGE:  # bounds say nothing
            self.centre, self.norm, self.radius = np.zeros(x.shape[1]), 0.0, math.inf
            half = len(rows) // 2
            self.children = [Node(x, rows[:half]), Node(x, rows[half:])] if len(rows) > LEAF else []
            return
        near = x[rows].mean(axis=0)
        self.centre = x[rows[np.argmin(((x[rows] - near) ** 2).sum(axis=1))]]
        d = np.sqrt(((x[rows] - self.centre) ** 2).sum(axis=1))
        self.norm, self.radius, self.children = float(np.sqrt((self.centre**2).sum())), float(d.max()) * (1 + 1e-12), []
        if len(rows) > LEAF and self.radius > 0:
            nearest, owner, k = d, np.zeros(len(rows), np.int64), 1
            while nearest.max() > self.radius / 2 and k < 16:  # farthest points first, until all are covered
                far = int(nearest.argmax())
                to = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(axis=1))
                owner[to < nearest] = k
                nearest, k = np.minimum(nearest, to), k + 1
            parts = [rows[owner == j] for j in range(k)]
            if k > 1:
                self.children = [Node(x, p) for p in parts if len(p)]

    def bound(self, other: Node) -> float:
        return float(bounds(self.centre[None], np.array([self.norm]), np.array([self.radius]), other.centre[None], np.array([other.norm]), np.array([other.radius]))[0, 0])


def bounds(c: np.ndarray, norm: np.ndarray, radius: np.ndarray, c2: np.ndarray, norm2: np.ndarray, radius2: np.ndarray) -> np.ndarray:
    """The largest inner products between members of balls, in units of scores, and a margin for rounding."""
    with np.errstate(invalid="ignore"):
        b = c @ c2.T + norm[:, None] * radius2[None, :] + radius[:, None] * (norm2 + radius2)[None, :]
        b = (b + 1e-12 * (norm + radius)[:, None] * (norm2 + radius2)[None, :]) * 65536 + 1e-6
    return np.where(np.isnan(b) | ~np.isfinite(radius)[:, None] | ~np.isfinite(radius2)[None, :], np.inf, b)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.astype(float), [[] for _ in range(n)]

    def put(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        mine = self.found[q]
        mine += [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        mine.sort()
        del mine[self.k :]
        if len(mine) == self.k:
            self.least[q] = max(self.least[q], below(-mine[-1][0]))


def below(score: int) -> float:
    """A double that is not above a score."""
    return float(score) if abs(score) < 1 << 53 else float(score) - abs(float(score)) * 1e-15


def search(queries: Node, x: np.ndarray, xid: np.ndarray, tree: Node, r: np.ndarray, rid: np.ndarray, best: Best) -> None:
    stack = [(queries.bound(tree), queries, tree)]
    while stack:
        bound, q, t = stack.pop()
        if bound < best.least[q.rows].min():
            continue
        if not q.children and not t.children:
            s, other = products(x[q.rows], r[t.rows]), xid[q.rows][:, None] != rid[t.rows][None, :]
            good = (s >= best.least[q.rows][:, None]) & other
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                at = np.flatnonzero(good[i])
                best.put(int(q.rows[i]), s[i][at], rid[t.rows][at])
            continue
        if q.children and (not t.children or q.radius > t.radius):
            pairs = [(c.bound(t), c, t) for c in q.children]
        else:
            pairs = [(q.bound(c), q, c) for c in t.children]
        stack += sorted(pairs, key=lambda p: p[0])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of vectors whose components are multiples of 1/256: 65536 times their inner products, whole numbers within
    the range of a long. Pairs whose sums doubles may not hold are computed by Python's integers."""
    big = np.abs(np.concatenate([a, b])).max() >= HUGE
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.sqrt((a**2).sum(axis=1))[:, None] * np.sqrt((b**2).sum(axis=1))[None, :] * 65536
        good = (top < 2.0**52) if not big else np.nan_to_num(top, nan=np.inf, posinf=np.inf) < 2.0**52
        s = np.where(good, (a * 256) @ (b * 256).T, 0) if good.all() or not big else np.array([[p @ q * 65536 if g else 0.0 for q, g in zip(b, line, strict=True)] for p, line in zip(a, good, strict=True)])
    out = np.rint(s).astype(np.int64)
    whole = lambda v: [int(x) * 256 if abs(x) >= HUGE else int(x * 256) for x in v.tolist()]
    for i, j in zip(*(k.tolist() for k in np.nonzero(~good)), strict=True):
        out[i, j] = max(_LEAST, min(_MOST, sum(u * v for u, v in zip(whole(a[i]), whole(b[j]), strict=True))))
    return out


#: What a visit gives: kind 0 a hit (id, other, score); 1 the root of a group; 2 a query (g, b, id, x: its kth score); 3 the
#: root of a block of queries (z: the least kth score). Roots have centre v, norm x and radius y.
_OUT = "kind int, g long, b int, id long, other long, score long, x double, y double, z double, v binary"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]


def _tasks(k: int, home: bool):
    """Rows come sorted by group and kind: first the group's vectors (kind 0), then the queries (kind 1). At home, roots and
    kth scores are given too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, tree, r, rid, waiting, block = None, [], None, None, None, [], 0

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(_NAMES, _TYPES, zip(*found, strict=True), strict=True)})

        def root(kind: int, node: Node, least: float | None) -> tuple:
            return (kind, group, block, None, None, None, node.norm, node.radius, least, node.centre.tobytes())

        def planted() -> Iterator[pa.RecordBatch]:
            nonlocal r, rid, tree, held
            if held:
                r, rid = matrix([h[1] for h in held]), np.array([h[0] for h in held], np.int64)
                tree, held = Node(r, np.arange(len(r))), []
                if home:
                    yield from rows([root(1, tree, None)])

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, block
            some, waiting = waiting, []
            if some and tree is not None:
                x, xid = matrix([s[1] for s in some]), np.array([s[0] for s in some], np.int64)
                best, queries = Best(len(some), k, np.array([-np.inf if s[2] is None else s[2] for s in some])), Node(x, np.arange(len(some)))
                search(queries, x, xid, tree, r, rid, best)
                found = [(0, None, None, int(xid[i]), j, -s, None, None, None, None) for i, mine in enumerate(best.found) for s, j in mine]
                if home:
                    found += [(2, group, block, i, None, None, None if least == -np.inf else least, None, None, v) for (i, v, _), least in zip(some, best.least.tolist(), strict=True)]
                    found.append(root(3, queries, float(best.least.min())))
                    block += 1
                yield from rows(found)

        for b in batches:
            for g, kind, i, v, least in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if g != group:
                    yield from planted()
                    yield from answer()
                    group, tree, block = g, None, 0
                if kind == 0:
                    held.append((i, v))
                    continue
                yield from planted()
                waiting.append((i, v, least))
                if len(waiting) >= BLOCK:
                    yield from answer()
        yield from planted()
        yield from answer()

    return run


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, kind, g, b, x, y, z, v) come sorted by task and kind: at most a few blocks of roots of groups, then roots
    of blocks of queries. Gives (g, b, to): groups that may hold more for a block of queries."""
    task, roots = None, {}

    def check(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        for size in {len(q[7]) for q in rows}:
            some = [q for q in rows if len(q[7]) == size]
            if size in roots:
                to = roots[size]
                parts = [(matrix([q[7] for q in s]), *(np.array([q[j] for q in s], float) for j in (4, 5))) for s in (some, to)]
                good = bounds(*parts[0], *parts[1]) >= np.array([q[6] for q in some])[:, None]
                good &= np.array([q[2] for q in some])[:, None] != np.array([t[2] for t in to])[None, :]
                out += [(some[i][2], some[i][3], to[j][2]) for i, j in zip(*(c.tolist() for c in np.nonzero(good)), strict=True)]
        return pa.RecordBatch.from_pydict({"g": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int32()), "to": pa.array([o[2] for o in out], pa.int64())})

    for batch in batches:
        rows: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != task:
                if rows:
                    yield check(rows)
                task, roots, rows = row[0], {}, []
            if row[1] == 1:
                roots.setdefault(len(row[7]), []).append(row)
            else:
                rows.append(row)
        if rows:
            yield check(rows)


def _pivots(table: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots for each length by farthest-first choice from a sample of bounded size; a hash of the id picks the sample."""
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    some = [bytes(r.v) for r in table.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).where("not huge").select("v").collect()]
    out, wanted = {}, min(PIVOTS, max(1, 2 * n // GROUP))
    for size in {len(v) for v in some}:
        x = matrix([v for v in some if len(v) == size])
        chosen, nearest = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < max(1, wanted * len(x) // len(some)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[size] = x[chosen]
    return out


def _celled(pivots: dict[int, np.ndarray], n: int) -> Callable[[pa.RecordBatch], dict]:
    """(id, v, size, pivot, bits): where a vector belongs. Huge vectors and lengths without a pivot have pivot -1."""
    bits = max(0, math.ceil(math.log2(max(1, n) / GROUP / max(1, sum(map(len, pivots.values()))) or 1)))
    bits = min(bits, 40)

    def run(b: pa.RecordBatch) -> dict:
        vs, huge = b.column(1).to_pylist(), b.column(2).to_pylist()
        size, pivot, side = np.array([len(v) for v in vs]), np.full(len(vs), -1), np.zeros(len(vs), np.int64)
        for s in np.unique(size).tolist():
            at = np.flatnonzero((size == s) & ~np.array(huge, bool))
            if s in pivots and len(at):
                p, x = pivots[s], matrix([vs[i] for i in at])
                pivot[at] = ((p**2).sum(axis=1)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
                if bits:
                    planes = np.random.default_rng(s).standard_normal((bits, x.shape[1]))
                    side[at] = ((x - p[pivot[at]]) @ planes.T > 0) @ (1 << np.arange(bits, dtype=np.int64))
        return {"id": b.column(0), "v": b.column(1), "size": pa.array(size.astype(np.int32)), "pivot": pa.array(pivot.astype(np.int32)), "bits": pa.array(side)}

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(256 * x) for each query row, ties to the
    smaller id, fewer where there are fewer; exact.

    is_query is a condition over `id`. Vectors that are null, empty or hold null or non-finite components take no part, nor
    do null ids. Vectors meet those of their own length. A query never meets rows of its own id; rows that repeat an id as
    candidates count each, as queries the smallest vector (by its bytes) asks. Equal scores are ties. Scores beyond the
    range of a long are its limits, and tie there. An empty table gives no rows."""
    spark = prepare(vectors.sparkSession)

    def whole(b: pa.RecordBatch) -> dict:
        out, huge = [], []
        for packed in b.column(2).to_pylist():
            x = None if packed is None else np.frombuffer(packed, np.float64)
            if x is not None:
                top = np.abs(x) >= 2.0**44  # these are multiples of 1/256
                x = np.where(top, x, np.floor(np.where(top, 0, x) * 256) / 256)
            out.append(None if x is None else x.tobytes())
            huge.append(x is not None and bool((np.abs(x) >= HUGE).any()))
        return {"id": b.column(0), "v": pa.array(out, pa.binary()), "huge": pa.array(huge)}

    table = cut(arrow_map(doubles(vectors, id_col, vec_col), whole, "id long, v binary, huge boolean").where("id is not null and v is not null"))
    n = table.count()
    cells = arrow_map(table, _celled(_pivots(table, n), n), "id long, v binary, size int, pivot int, bits long")
    cells = cut(cells.withColumn("cell", F.xxhash64("size", "pivot", "bits")).select("id", "v", "cell"))
    parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    table = cut(cells.join(parts, "cell").select(F.xxhash64("cell", F.pmod(F.xxhash64("id", "v"), "parts")).alias("g"), "id", "v"))
    none = F.lit(None).cast("double").alias("least")
    refs = table.select("g", F.lit(0).alias("kind"), "id", "v", none)
    asked = table.where(is_query).groupBy("id").agg(F.min(F.struct("v", "g")).alias("q")).select("q.g", "id", "q.v", none)

    def visit(queries: DataFrame, home: bool) -> DataFrame:
        both = refs.unionAll(queries.select("g", F.lit(1).alias("kind"), "id", "v", "least"))
        return both.repartition(max(1, min(partitions(spark), n // GROUP + 1) * 2), "g").sortWithinPartitions("g", "kind").mapInArrow(_tasks(k, home), _OUT)

    seen = cut(visit(asked, True))
    at = F.pmod(F.xxhash64("g", "b"), F.lit(1 << 30))
    roots, blocks = seen.where("kind = 1"), seen.where("kind = 3")
    rows, columns = (df.count() // ROOTS + 1 for df in (roots, blocks))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    pairs = roots.withColumn("i", at % rows).withColumn("j", every(columns)).unionByName(blocks.withColumn("j", at % columns).withColumn("i", every(rows)))
    pairs = pairs.select((F.col("i") * columns + F.col("j")).alias("task"), "kind", "g", "b", "x", "y", "z", "v").repartition(min(rows * columns, partitions(spark)), "task").sortWithinPartitions("task", "kind")
    pairs = pairs.mapInArrow(_left, "g long, b int, to long")
    away = seen.where("kind = 2").select("g", "b", "id", "v", F.col("x").alias("least")).join(pairs, ["g", "b"]).select(F.col("to").alias("g"), "id", "v", "least")
    found = seen.where("kind = 0").select("id", "other", "score").unionAll(visit(away, False).select("id", "other", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.select(F.col("id").alias("query_id"), F.col("other").alias("vec_id"), "score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    """Of each vec_id divisible by 50, its 5 best: query_id, rank, vec_id, score. Cases are those of top_k."""
    return top_k(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0, 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
