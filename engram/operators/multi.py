"""Many queries at once: BM25 by postings of their terms, and documents that hold given passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..schema import QUERY_TERMS
from .approximate import place, rounded
from .lexicon import Lexicon, counted

#: Patterns of an automaton, queries that are answered at once, documents whose parts a task sorts and adds up at once.
BLOCK, ASKED, DOCUMENTS, SOME = 50_000, 1024, 20_000, 256


def postings(documents: DataFrame, text: str = "data") -> DataFrame:
    """(id, term, tf, dl): the terms of a document are cut and counted once."""
    return counted(documents, text)


def containing(documents: DataFrame, patterns: DataFrame, text: str = "data") -> DataFrame:
    """(pattern_id, id) where a document holds a pattern (pattern_id, pattern): patterns are gathered in automata of BLOCK
    each, and each document runs through these once; no pairs are listed but the hits."""
    blocks = patterns.where("pattern != ''").select(F.struct("pattern_id", "pattern").alias("p"), F.pmod(F.xxhash64("pattern_id"), F.lit(patterns.count() // BLOCK + 1)).alias("block"))
    blocks = blocks.groupBy("block").agg(F.collect_list("p").alias("patterns"))  # about BLOCK each
    out = None
    for r in blocks.toLocalIterator():

        def run(batches: Iterator[pa.RecordBatch], some=[(p.pattern_id, p.pattern) for p in r.patterns]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            tree, ids = ahocorasick.Automaton(), {}
            for i, p in some:
                ids.setdefault(p, []).append(i)
            for p, i in ids.items():
                tree.add_word(p, i)
            tree.make_automaton()
            for part in X.pieces(batches):
                hits = [(p, i) for i, t in zip(*part, strict=True) for p in {x for _, found in tree.iter(t) for x in found}]
                yield pa.RecordBatch.from_pydict({"pattern_id": pa.array([h[0] for h in hits], pa.int64()), "id": pa.array([h[1] for h in hits], pa.int64())})

        found = X.bounded(documents).select(F.col("id").cast("long").alias("id"), F.col(text).cast("string").alias("data")).mapInArrow(run, "pattern_id long, id long")
        out = found if out is None else out.unionAll(found)
    return documents.sparkSession.createDataFrame([], "pattern_id long, id long") if out is None else out


def lexical_many(index: Lexicon, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score) of queries (query_id, query) against a stored index, ASKED queries at a time: only terms that
    are asked for leave the scan's stage. A document's parts come together once, and a task adds them up for all queries and
    gives on k rows for each."""
    asked = queries.select("query_id", F.explode(F.slice(F.array_distinct(X.tokens(F.col("query"))), 1, QUERY_TERMS)).alias("term"))
    sums, kind, spark = index.sums(), queries.schema["query_id"].dataType, queries.sparkSession
    stats = sums.select("n", (F.col("total") / F.col("n")).alias("avgdl"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sums.first().n or 0) // DOCUMENTS)
    blocks = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(queries.count() // ASKED + 1)).alias("block")).agg(F.collect_list(F.struct("query_id", "term")).alias("asked"))
    out = None
    for r in blocks.toLocalIterator():
        terms, ids = sorted({x.term for x in r.asked}), sorted({x.query_id for x in r.asked})
        at, of = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
        place_ = spark.createDataFrame(list(at.items()), "term string, pos int")
        rows = index.postings().join(F.broadcast(place_), "term").select("pos", "id", "tf", "dl")  # the terms of a block
        df = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats))
        part = rows.join(F.broadcast(df), "pos").select("id", "pos", X.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")).alias("s"))
        run = _added([at[x.term] for x in r.asked], [of[x.query_id] for x in r.asked], len(terms), ids, to_arrow_type(kind), k)
        top = part.repartition(parts, "id").sortWithinPartitions("id", "pos").mapInArrow(run, f"query_id {kind.simpleString()}, id long, score double")
        out = top if out is None else out.unionAll(top)
    if out is None:
        out = spark.createDataFrame([], f"query_id {kind.simpleString()}, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _added(terms: list[int], queries: list[int], width: int, names: list, kind: pa.DataType, k: int):
    """Rows (id, pos, s) in order of ids to the k best (query_id, id, score) of each query; terms and queries: the pairs asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(terms, kind="stable")
        asking, first, n = np.array(queries)[order], np.searchsorted(np.array(terms)[order], np.arange(width + 1)), len(names)
        least = np.full(n, -np.inf)
        best = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        rest = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)

        def add(ids: np.ndarray, pos: np.ndarray, s: np.ndarray) -> None:
            nonlocal best
            one, row = np.unique(ids, return_inverse=True)
            times = first[pos + 1] - first[pos]
            q = asking[np.repeat(first[pos] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            sums = np.bincount(np.repeat(row, times) * n + q, np.repeat(s, times), len(one) * n)  # in order of terms; parts are above 0
            at = np.flatnonzero((sums > 0) & (sums.reshape(-1, n) >= least - 1e-8).ravel())
            q, i, v = (np.concatenate(x) for x in zip(best, (at % n, one[at // n], rounded(sums[at])), strict=True))
            order = np.lexsort((i, -v, q))
            order = order[place(q[order]) < k]
            best = q[order], i[order], v[order]
            last = place(best[0]) == k - 1
            least[best[0][last]] = best[2][last]

        for b in batches:
            ids, pos, s = (np.concatenate([x, b.column(c).to_numpy(zero_copy_only=False)]) for c, x in enumerate(rest))
            whole = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0  # the last document may go on
            edges = np.flatnonzero(np.diff(ids[:whole])) + 1
            edges = [0, *edges[SOME - 1 :: SOME].tolist(), whole]
            for i, j in zip(edges, edges[1:], strict=False):
                if j > i:
                    add(ids[i:j], pos[i:j], s[i:j])
            rest = ids[whole:], pos[whole:], s[whole:]
        if len(rest[0]):
            add(*rest)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array([names[q] for q in best[0].tolist()], kind), "id": pa.array(best[1]), "score": pa.array(best[2])})

    return run
