"""Ranked search: exact cosine, BM25, their fusion by reciprocal ranks, and reads by filters alone.

Ranks are global and come before all filters. Every list is cut to FETCH_MAX rows by TakeOrdered before it is
numbered, so no window sorts the whole table. BM25 reads a stored index (see lexicon), or cuts every document once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import text as X
from ..functions import vector as V
from ..schema import FETCH_MAX, OFFSET_MAX, RRF_K, SCAN_CAP, TOP_K, TOP_K_MAX, EngineError
from .filters import capped, record_filter
from .lexicon import Lexicon
from .temporal import decay


@dataclass(frozen=True)
class SearchParams:
    query: str | None = None
    embedding: tuple[float, ...] | None = None
    type: str | None = None
    tags: tuple[str, ...] = ()
    match: str = "all"
    start: int | None = None
    end: int | None = None
    max_importance: float | None = None
    namespace: str | None = None
    min_score: float | None = None
    half_life: int | None = None
    top_k: int = TOP_K
    offset: int = 0
    now: int = 0
    order: str = "recent"
    scan_cap: int = SCAN_CAP
    dim: int | None = None
    explain: bool = field(default=False)

    @property
    def want(self) -> int:
        return self.skip + self.limit

    @property
    def limit(self) -> int:
        return max(1, min(self.top_k, TOP_K_MAX))

    @property
    def skip(self) -> int:
        return max(0, min(self.offset, OFFSET_MAX))

    def predicate(self) -> Column:
        return record_filter(self.type, self.tags, self.match, self.start, self.end, self.max_importance, self.namespace, self.now)


def similarities(vectors: DataFrame, q, best_of: bool = False) -> DataFrame:
    """(id, sim) against a query vector, rounded so that copies tie; with best_of, the largest of a record's vectors."""
    s = vectors.select("id", F.round(V.cosine_query(F.col("vec"), list(q)), 9).alias("sim"))
    return s.groupBy("id").agg(F.max("sim").alias("sim")) if best_of else s


def ranked(hits: DataFrame, score: str, rank: str, limit: int = FETCH_MAX) -> DataFrame:
    """The best `limit` rows with a rank from 1; ties go to the smaller id."""
    top = hits.orderBy(F.col(score).desc(), "id").limit(limit)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.col(score).desc(), "id")))


def lexical(documents: DataFrame, query: str, text: str = "data", index: Lexicon | None = None) -> DataFrame:
    """(id, bm25) of documents with a term of the query. N, df and lengths are those of all documents with a term.

    With an index only its rows of the query's terms are read. Without one, every document is cut into terms once: a row
    of counts for each is written, from which the statistics and the scores come."""
    terms = X.query_terms(query)
    if index is not None:
        return index.search(query)
    if not terms:
        return documents.sparkSession.createDataFrame([], "id long, bm25 double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.pieces(batches):
            ids, size, tfs = [], [], []
            for i, t in zip(*part, strict=True):
                if c := X.term_counts(t):
                    ids.append(i)
                    size.append(sum(c.values()))
                    tfs.append([c.get(q, 0) for q in terms])
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "dl": pa.array(size, pa.int64()), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    rows = X.bounded(documents).select(F.col("id").cast("long").alias("id"), F.col(text).cast("string").alias("data"))
    counted = cut(rows.mapInArrow(run, "id long, dl long, tfs array<long>"))
    df = F.array(*[F.count_if(F.col("tfs")[i] > 0) for i in range(len(terms))])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), df.alias("dfs"))
    stats = stats.select((F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"), F.transform("dfs", lambda d: X.idf(F.col("n"), d)).alias("idfs"))
    hit = counted.where(F.exists("tfs", lambda x: x > 0)).join(F.broadcast(stats))  # a row of statistics
    part = F.zip_with("tfs", "idfs", lambda tf, idf: F.when(tf > 0, X.weighted(tf, idf, F.col("dl"), F.col("avgdl"))).otherwise(0.0))
    return hit.select("id", F.round(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 9).alias("bm25"))


def fused(semantic: DataFrame, lexical_: DataFrame) -> DataFrame:
    """Full outer join of two ranked lists with the sum of reciprocal ranks."""
    both = semantic.join(lexical_, "id", "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", part("srank") + part("lrank"))


def weight() -> Column:
    w = F.col("importance") * F.col("confidence")
    return F.when(w > 0, w).otherwise(1.0)


def fetch_level(fused_: DataFrame, survivors: DataFrame, want: int) -> int:
    """The depth at which both lists are cut: 4 * want + 32, times 4 until enough survive, both lists end, or FETCH_MAX.

    One aggregate counts the survivors of every level."""
    levels = [min(FETCH_MAX, 4 * want + 32)]
    while levels[-1] < FETCH_MAX:
        levels.append(min(FETCH_MAX, levels[-1] * 4))
    best = F.least(F.coalesce("srank", F.lit(FETCH_MAX + 1)), F.coalesce("lrank", F.lit(FETCH_MAX + 1)))
    marked = fused_.join(survivors.select("id", F.lit(True).alias("good")), "id", "left")
    row = marked.agg(F.max("srank").alias("s"), F.max("lrank").alias("l"), *[F.count_if(F.col("good") & (best <= x)).alias(f"n{i}") for i, x in enumerate(levels)]).first()
    for i, x in enumerate(levels):
        if row[f"n{i}"] >= want or (row["s"] or 0) < x and (row["l"] or 0) < x:
            return x
    return levels[-1]


def search(records: DataFrame, params: SearchParams, vectors: DataFrame | None = None, index: Lexicon | None = None) -> DataFrame:
    """The page of hits, best first: the record, score, and the parts of an explanation.

    records: current images. vectors: (id, vec) rows, several for an id if it has several. index: the records' stored
    postings. The source is vectors and text, vectors, text, or filters alone, by what params has."""
    p = params
    if p.embedding is not None and len(p.embedding) == 0:
        p = SearchParams(**{**p.__dict__, "embedding": None})
    if p.embedding is not None and p.dim is not None and len(p.embedding) != p.dim:
        raise EngineError("INVALID_REQUEST", "embedding length")
    good = records.where(p.predicate())
    if p.embedding is None and not p.query:
        base = records if p.tags else capped(records.where(F.col("created").between(p.start, p.end)) if p.start is not None and p.end is not None else records, p.scan_cap, p.order == "oldest")
        return base.where(p.predicate()).orderBy("created", "id").offset(p.skip).limit(p.limit)
    sem = lex = None
    if p.embedding is not None:
        s = similarities(vectors, p.embedding, best_of=True)
        sem = ranked(s if p.min_score is None else s.where(F.col("sim") >= p.min_score), "sim", "srank")
    if p.query:
        lex = ranked(lexical(records, p.query, index=index), "bm25", "lrank")
    if sem is not None and lex is not None:
        sem, lex = cut(sem), cut(lex)  # FETCH_MAX rows each: the level and the page come from the same lists
        both = fused(sem, lex)
        level = fetch_level(both, good, p.want)
        hits = fused(sem.where(F.col("srank") <= level), lex.where(F.col("lrank") <= level)).withColumn("relevance", F.col("rrf"))
        found = good.join(F.broadcast(hits), "id")  # at most twice FETCH_MAX rows
        found = found.withColumns({"weight": F.lit(1.0), "recency": F.lit(1.0)})
    else:
        one = sem if sem is not None else lex
        hits = one.withColumn("relevance", F.col("sim" if sem is not None else "bm25"))
        found = good.join(F.broadcast(hits), "id").withColumn("weight", weight())
        found = found.withColumn("recency", decay(F.col("updated"), p.now, p.half_life) if p.half_life else F.lit(1.0))
    found = found.withColumn("score", F.round(F.col("weight") * F.col("relevance") * F.col("recency"), 9))
    return found.orderBy(F.col("score").desc(), "id").offset(p.skip).limit(p.limit)


def explained(hits: DataFrame) -> Column:
    """The explanation of a hit as JSON; what does not apply is left out."""
    have = set(hits.columns)
    names = {"semantic": F.col("srank").isNotNull() if "srank" in have else F.lit(False), "lexical": F.col("lrank").isNotNull() if "lrank" in have else F.lit(False)}
    take = {"score": "score", "similarity": "sim", "bm25": "bm25", "semantic_rank": "srank", "lexical_rank": "lrank", "rrf": "rrf", "importance": "importance", "confidence": "confidence", "weight": "weight", "recency_factor": "recency"}
    return F.to_json(F.struct(*[c.alias(n) for n, c in names.items()], *[F.col(c).alias(n) for n, c in take.items() if c in have]))


def count(records: DataFrame, params: SearchParams, whole: bool = False) -> DataFrame:
    """(n, capped): visible rows of a filter; reads without tags see at most scan_cap rows. With whole, n is of all rows, and
    capped tells that a read would not see them all."""
    p = params
    if p.tags:
        return records.where(p.predicate()).agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("capped"))
    seen = records.where(~F.col("deleted"))
    if p.start is not None and p.end is not None:
        seen = seen.where(F.col("created").between(p.start, p.end))
    if whole:
        return seen.agg(F.count_if(p.predicate()).alias("n"), (F.count(F.lit(1)) > p.scan_cap).alias("capped"))
    total = seen.agg((F.count(F.lit(1)) > p.scan_cap).alias("capped"))
    return capped(seen, p.scan_cap).where(p.predicate()).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
