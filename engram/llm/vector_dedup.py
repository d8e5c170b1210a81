"""Embedding near-dedup by sorted projection passes.

Each pass orders the different vectors of a label lexicographically by concatenated random hashes (sign bits of random
planes). Vectors that agree in the first bits lie in one run of this order. Within a run each vector is compared with its
next WINDOW neighbours by a sketch of SKETCH further sign bits, which travel in place of the vectors; vectors with a likely
partner are fetched and verified. Runs longer than the window have an exact way: they are fetched whole and compared in
blocks. Verified pairs of one pass spare the next ones what already is in one component, and are united across passes.

The number of passes follows from the table's size, so that a pair at the threshold shares a run in none of them with a
chance below MISS, however dense the vectors lie. Within a component all pairs are then counted exactly in blocks, of
which only sums leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import arrow_map, connected_components, cut, prepare
from .vectors import doubles, matrix

SIMILARITY, BUCKET, MISS, AT_ONCE, BLOCK, SEED = 0.98, 16, 1e-6, 24, 1024, 20
WINDOW, BITS, SKETCH = 48, 62, 256


def bits_needed(n: int) -> int:
    """First bits that leave BUCKET of n vectors in a run on average, if they are spread evenly."""
    return min(BITS, max(1, math.ceil(math.log2(max(2, n) / BUCKET))))


def passes_needed(n: int, similarity: float) -> int:
    """Passes for n vectors of a label: a pass finds a pair if it agrees in the first bits."""
    found = (1 - math.acos(min(1.0, similarity)) / math.pi) ** bits_needed(n)
    return max(4, math.ceil(math.log(MISS) / math.log(max(1e-12, 1 - found))))


def _planes(k: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, k]).standard_normal((63, dim))


def codes(x: np.ndarray, k: int) -> np.ndarray:
    """The sign bits of each row in pass k as one number, the first bit the highest."""
    return (x @ _planes(k, x.shape[1])[:BITS].T > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def sketches(x: np.ndarray) -> np.ndarray:
    """SKETCH sign bits of each row, packed in 64-bit words."""
    planes = np.random.default_rng([SEED, 1 << 20]).standard_normal((SKETCH, x.shape[1]))
    return np.packbits(x @ planes.T > 0, axis=1).view(np.uint64)


def apart(similarity: float) -> int:
    """Sketch bits by which a pair at the threshold differs with a chance below 1e-9 at most: six and a half deviations."""
    p = math.acos(min(1.0, similarity)) / math.pi
    return math.ceil(SKETCH * p + 6.5 * math.sqrt(SKETCH * p * (1 - p)) + 2)


def _likely(similarity: float):
    """Rows (run, code, own, component, sketch) come sorted by run and code, a run in one task. Gives (run, own) of those
    that one of WINDOW neighbours in a run is likely similar to and not in one component with."""
    most = apart(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            table = (pa.concat_tables([tail, now]) if tail is not None else now).combine_chunks()
            name, own, part = (table[c].to_numpy() for c in ("run", "own", "component"))
            x = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(own), -1)
            hit = np.zeros(len(own), bool)
            for d in range(1, min(WINDOW, len(own) - 1) + 1):
                at = np.flatnonzero((name[d:] == name[:-d]) & (part[d:] != part[:-d]))
                at = at[np.bitwise_count(x[at] ^ x[at + d]).sum(axis=1) <= most]
                hit[at] = hit[at + d] = True
            yield pa.RecordBatch.from_pydict({"run": pa.array(name[hit]), "own": pa.array(own[hit])})
            tail = table.slice(max(0, len(own) - WINDOW))

    return run


def _unit(packed: bytes) -> bytes | None:
    v = np.frombuffer(packed, np.float64)
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return (v / np.sqrt((v**2).sum())).tobytes()


def _links(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return x @ y.T >= similarity


def _run_links(similarity: float):
    """Links between different components within a block of a run, or between two blocks: a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        task, own, part, left, right = (table[c].to_numpy() for c in ("task", "own", "component", "left", "right"))
        label = np.unique(table["label"].to_pylist(), return_inverse=True)[1]
        vs = table["v"].to_pylist()
        size = np.array([len(v) for v in vs])
        order = np.lexsort((size, label, task))
        new = (np.diff(task[order]) != 0) | (np.diff(label[order]) != 0) | (np.diff(size[order]) != 0)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in np.split(order, np.flatnonzero(new) + 1):
            p, q = at[left[at]], at[right[at]]
            if not (len(p) and len(q)):
                continue
            good = _links(matrix([vs[k] for k in p]), matrix([vs[k] for k in q]), similarity)
            good &= part[p][:, None] != part[q][None, :]
            names, of = np.unique(np.concatenate([part[p], part[q]]), return_inverse=True)
            tree, x, y = np.arange(len(names)), of[: len(p)], of[len(p) :]
            for r in np.flatnonzero(good.any(axis=1)):
                to = np.flatnonzero(good[r])
                trees, first = np.unique(tree[y[to]], return_index=True)
                other = trees != tree[x[r]]
                if other.any():
                    ends = own[q[to[first[other]]]]
                    out.append((np.full(len(ends), own[p[r]]), ends))
                    tree[np.isin(tree, trees[other])] = tree[x[r]]
        a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})

    return run


def _counts(similarity: float):
    """Links of the rows of block i to rows of block j of one component, as sums of the rows' multiplicities."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block = np.array(table["block"].to_pylist())
        ids, m, vs = np.array(table["id"].to_pylist(), np.int64), np.array(table["m"].to_pylist(), np.int64), table["v"].to_pylist()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n = np.zeros(len(left), np.int64)
        size = np.array([len(v) for v in vs])
        for s in np.unique(size[left]):
            p, q = np.flatnonzero(size[left] == s), right[size[right] == s]
            if len(q):
                good = _links(matrix([vs[k] for k in left[p]]), matrix([vs[k] for k in q]), similarity)
                good &= ids[left[p]][:, None] != ids[q][None, :]
                n[p] = good @ m[q]
        return pa.table({"id": pa.array(ids[left]), "n": pa.array(n)})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: rows with the same label and cosine >= similarity are linked.

    Vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with
    nothing (n_links 0, a component of their own). Vectors of different length never link. Rows that repeat an id
    are vectors of their own: they are linked if similar and have a result row each. Equal vectors are links like others:
    copies are folded into one vector with a multiplicity before the passes. Other columns are not read, whatever their
    names. An empty table gives no rows."""
    spark = prepare(vectors.sparkSession)
    raw = doubles(vectors, id_col, vec_col, label_col)

    def units(b: pa.RecordBatch) -> dict:
        v = [None if v is None or i is None or lab is None else _unit(v) for i, lab, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        return {"id": b.column(0), "label": b.column(1), "v": pa.array(v, pa.binary())}

    table = cut(arrow_map(raw, units, "id long, label string, v binary"))
    good = table.where("v is not null").withColumn("h", F.xxhash64("v"))
    classes = cut(good.groupBy("label", "h", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")).withColumn("own", F.xxhash64("label", "v")))
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    # classes are named by a hash of label and vector while the passes run, since ids may repeat
    p, bits, found, parts = passes_needed(n, similarity) if n > 1 else 0, bits_needed(n), None, None
    # the first pass alone, since its components spare the others most of the pairs in dense places
    for ks in [range(min(p, 1)), *(range(k, min(p, k + AT_ONCE)) for k in range(1, p, AT_ONCE))] if p else []:

        def coded(b: pa.RecordBatch, ks=ks) -> dict:
            vs = b.column(2).to_pylist()
            code, sketch = np.zeros((len(ks), len(vs)), np.int64), np.zeros((len(vs), SKETCH // 64), np.uint64)
            size = np.array([len(v) for v in vs])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                x = matrix([vs[i] for i in at])
                sketch[at] = sketches(x)
                for j, k in enumerate(ks):
                    code[j, at] = codes(x, k)
            take = pa.array(np.tile(np.arange(len(vs)), len(ks)))
            packed = pa.array([x.tobytes() for x in sketch], pa.binary())
            return {"pass": pa.array(np.repeat(np.array(ks, np.int32), len(vs))), "label": b.column(1).take(take), "own": b.column(0).take(take), "code": pa.array(code.ravel()), "sketch": packed.take(take)}

        rows = arrow_map(classes.select("own", "label", "v"), coded, "pass int, label string, own long, code long, sketch binary")
        rows = rows.withColumn("component", F.col("own")) if parts is None else rows.join(parts.withColumnRenamed("node", "own"), "own", "left").withColumn("component", F.coalesce("component", "own"))
        rows = cut(rows.select(F.xxhash64("pass", "label", F.shiftright("code", BITS - bits)).alias("run"), "code", "own", "component", "sketch"))
        runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("run", "size")
        open_ = rows.join(runs, "run")
        short = open_.where(F.col("size") <= WINDOW + 1).select("run", "code", "own", "component", "sketch")
        short = short.repartitionByRange(common.partitions(spark), "run").sortWithinPartitions("run", "code").mapInArrow(_likely(similarity), "run long, own long").distinct()
        asked = cut(short.unionAll(open_.where(F.col("size") > WINDOW + 1).select("run", "own")))
        sizes = asked.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        mixed = asked.join(sizes, "run").join(classes.select("own", "label", "v"), "own")
        mixed = mixed.withColumn("component", F.col("own")) if parts is None else mixed.join(parts.withColumnRenamed("node", "own"), "own", "left").withColumn("component", F.coalesce("component", "own"))
        mixed = mixed.withColumn("block", F.pmod(F.xxhash64("own", F.lit(2)), F.col("blocks")).cast("int"))
        mixed = mixed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
        task = F.xxhash64("run", "i", "j")
        groups = asked.count() // (4 * BLOCK) + 1  # small runs share a group
        mixed = mixed.select(F.when(F.col("blocks") == 1, F.pmod(task, F.lit(groups))).otherwise(task).alias("group"), task.alias("task"), "label", "own", "component", "v", (F.col("block") == F.col("i")).alias("left"), (F.col("block") == F.col("j")).alias("right"))
        both = cut(mixed.groupBy("group").applyInArrow(_run_links(similarity), "a long, b long").distinct())
        if not both.isEmpty():
            found = both if found is None else found.unionAll(both)
            parts = connected_components(found)
    own = classes.select("own", "label", "v", "id", "m")
    if parts is not None:
        inside = own.join(parts.withColumnRenamed("node", "own"), "own")
        sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        x = inside.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("own", F.lit(1)), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
        cols = ["component", "block", F.col("own").alias("id"), "m", "v"]
        ends = x.select(*cols, other).select("component", F.col("block").alias("i"), F.col("o").alias("j"), "block", "id", "m", "v").unionAll(x.select(*cols, other).where("o != block").select("component", F.col("o").alias("i"), F.col("block").alias("j"), "block", "id", "m", "v"))
        ends = ends.withColumn("task", F.xxhash64("component", "i", "j")).drop("component")
        links = ends.groupBy("task", "i", "j").applyInArrow(_counts(similarity), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "own")
        least = inside.groupBy("component").agg(F.min("id").alias("component_id"))
        own = own.join(links, "own", "left").join(parts.withColumnRenamed("node", "own"), "own", "left").join(least, "component", "left")
    else:
        own = own.withColumns({"n": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")})
    own = own.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component_id", "id").alias("component_id"))
    hit = table.join(own, ["label", "v"], "left")
    out = hit.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op8_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each row of embeddings: vec_id, n_links, component_id, kept. Cases are those of near_vectors."""
    d = near_vectors(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return d.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.a = c.component_id AS kept FROM c LEFT JOIN n ON c.a = n.a
"""
