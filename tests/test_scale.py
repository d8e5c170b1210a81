"""What must not grow with the input: rows that searches and joins make, batches, tasks of the index."""

import numpy as np
import pytest

from engram.operators import approximate


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def brute(x, q, k, meets=lambda i, j: True):
    """(query, rank, id, sim) by Python's decimals and sums in order."""
    out = {}
    for i, a in q:
        hits = []
        for j, b in x:
            if b is None or len(b) != len(a) or any(v is None or not np.isfinite(v) for v in b) or not meets(a, b):
                continue
            dot = lambda u, v: sum((float(s) * float(t) for s, t in zip(u, v, strict=True)), 0.0)
            n = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
            hits.append((-round(0.0 if n == 0 else dot(a, b) / n, 9), j))
        out[i] = [(j, round(-s, 6)) for s, j in sorted(hits)[:k]]
    return out


def some_vectors(n=300, dim=6):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (n, dim)).astype(float)
    x[40:90] = x[40]  # copies
    x[100], x[101], x[102] = 0, x[3] * 1e-160, x[4] * 1e150
    return [*((i, v.tolist()) for i, v in enumerate(x)), (300, None), (301, [1.0, 2.0]), (302, [float("nan")] * dim), (303, [None, *[1.0] * (dim - 1)])]


@pytest.mark.parametrize("search", ["exact", "lsh", "lsh_keys"])
def test_cells_against_brute_force(spark, monkeypatch, search):
    """blocks of queries against blocks of vectors, and no list of pairs."""
    monkeypatch.setattr(approximate, "VECTORS", 50)
    monkeypatch.setattr(approximate, "QUERIES", 7)
    rows = some_vectors()
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = [r for r in rows[:103] if r[0] % 5 == 0 or 100 <= r[0]]
    asked = spark.createDataFrame(q, "query_id long, vec array<double>")
    if search == "exact":
        got, meets = approximate.exact_topk(v, asked, 4), lambda a, b: True
    else:
        tables, bits = (3, 3) if search == "lsh" else (2, 5)
        planes = np.random.default_rng(42).standard_normal((tables * bits, 6))
        signs = lambda a: (np.array(a) @ planes.T > 0).reshape(tables, bits)
        got, meets = approximate.lsh_topk(v, asked, 4, tables, bits), lambda a, b: (signs(a) == signs(b)).all(axis=1).any()
    assert "Join" not in plan(got) and "CoGroups" in plan(got)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.id, r.sim))
    assert found == {i: h for i, h in brute(rows, q, 4, meets).items() if h}


def test_cells_in_slabs(monkeypatch):
    monkeypatch.setattr(approximate, "SLAB_V", 16)
    monkeypatch.setattr(approximate, "SLAB_Q", 3)
    rows = [r for r in some_vectors() if r[0] < 300]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    q = np.r_[0:110]
    (qid, xid, s), *_ = approximate._nearest(ids, x, None, ids[q], x[q], None, 5)
    got = {}
    for i, j, c in zip(qid.tolist(), xid.tolist(), s.tolist(), strict=True):
        got.setdefault(i, []).append((j, round(c, 6)))
    assert got == brute(rows, [rows[i] for i in q], 5)


def test_rounding_is_sparks(spark):
    from pyspark.sql import functions as F

    s = np.r_[np.random.default_rng(1).uniform(-1, 1, 2000), [0.1234567885, -0.1234567885, 0.0000000005, 1.0, -0.0, 0.9999999995]]
    df = spark.createDataFrame([(float(v),) for v in s], "s double").select(F.round("s", 9).alias("r"))
    assert approximate.rounded(s).tolist() == [r.r for r in df.collect()]


def test_count_filtered_beyond_the_cap(spark, tmp_path):
    """more rows than a scan's cap."""
    import duckdb

    from engram.plans.oracles import ORACLES
    from engram.plans.queries import QUERIES

    c = duckdb.connect()
    c.sql("CREATE TABLE documents AS SELECT range AS doc_id, 'x' AS text, 'en' AS lang, 'src0' AS source, 1::BIGINT AS n_chars FROM range(100200)")
    c.sql("CREATE TABLE labels AS SELECT range AS doc_id, 1 AS quality, 0 AS toxic FROM range(10)")
    for t in ("documents", "labels"):
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    assert [tuple(r) for r in QUERIES["count_filtered"](spark, str(tmp_path)).collect()] == c.sql(ORACLES["count_filtered"]).fetchall()


def test_pieces_are_bounded(monkeypatch):
    """F4, F6 to F9, F12: whatever a batch holds, a worker cuts few texts at a time."""
    import pyarrow as pa

    from engram.functions import text as X

    monkeypatch.setattr(X, "PIECE_BYTES", 100)
    texts = ["a" * 30, None, "b" * 250, "", "c" * 60, "d" * 60, "é" * 40]
    b = pa.RecordBatch.from_pydict({"id": pa.array(range(7), pa.int64()), "data": pa.array(texts)})
    got = list(X.pieces([b, b.slice(0, 0)]))
    assert [i for ids, _ in got for i in ids] == list(range(7)) and [t for _, some in got for t in some] == [t or "" for t in texts]
    sizes = [[len(t.encode()) for t in some] for _, some in got]
    assert all(sum(z) - max(z) <= 100 for z in sizes) and len(got) > 3
    for t in ("a-b a-b A_b . x", "", "é-ü é.é-ü " * 3):
        assert X.term_counts(t) == {w: X.terms(t).count(w) for w in X.terms(t)}


def test_index_files_follow_the_size(spark, tmp_path):
    """a folder of the index is sorted in parts of Spark's advisory size, not in one task."""
    from engram.operators.lexicon import Lexicon

    docs = spark.range(4000).selectExpr("id", "concat('same ', id % 97, ' ', hash(id)) AS data").repartition(8)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        x = Lexicon.build(docs, str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    import glob

    folder = x.postings(["same"]).first().bucket
    assert len(glob.glob(f"{tmp_path}/index/postings/bucket={folder}/*.parquet")) > 1
    assert x.search("same").count() == 4000 and x.sums().first()[:] == (4000, 12000)


def test_many_queries_against_sums(spark, tmp_path, monkeypatch):
    """parts are added up by documents, and a task gives on k rows for each query."""
    from pyspark.sql import functions as F

    from engram.functions import text as X
    from engram.operators import multi
    from engram.operators.lexicon import Lexicon

    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd-ee", "ff"], 1 + i % 9))) for i in range(200)] + [(200, ""), (201, None)]
    x = Lexicon.build(spark.createDataFrame(docs, "id long, data string"), str(tmp_path / "index"))
    assert x.sums().first()[:] == (200, x._read("lengths").agg(F.sum("dl")).first()[0]) and x._read("lengths").count() == 200
    q = spark.createDataFrame([(7, "aa dd-ee"), (8, "ff"), (9, "zz"), (10, "bb cc aa")], "query_id long, query string")
    monkeypatch.setattr(multi, "ASKED", 2)
    got = multi.lexical_many(x, q, 5)
    assert plan(got).count("HashAggregate") == plan(got).count("HashAggregate(keys=[pos") + plan(got).count("HashAggregate(keys=[]")  # by term only
    stats = x.sums().select("n", (F.col("total") / F.col("n")).alias("avgdl"))
    asked = q.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term"))
    p = x.postings().select("term", "id", "tf", "dl")
    s = p.join(p.groupBy("term").agg(F.count("id").alias("df")), "term").join(stats).join(asked, "term")
    s = s.groupBy("query_id", "id").agg(F.round(F.sum(X.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))), 9).alias("score")).collect()
    want = {i: sorted(((-r.score, r.id) for r in s if r.query_id == i))[:5] for i in (7, 8, 10)}
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((-r.score, r.id))
    assert found == want


def test_superseded_in_cells(spark, monkeypatch):
    """a subject of many facts is dealt to many tasks; odd beginnings as by the definition."""
    import re

    from pyspark.sql import functions as F

    from engram.operators import capture

    monkeypatch.setattr(capture, "SIDE", 8)
    monkeypatch.setattr(capture, "PAIRS", 100)
    odd = ["", None, " ", "one", "On", "one two", "one twofold", "one  two", "one\ttwo", "\none two", "one\n", "one two\nthree", "é à b", "é àb", "w" * 70, "w" * 71 + " x", "w" * 80 + " " + "y" * 70, "w" * 80 + " " + "y" * 71 + " z", " two words", "ONE two "]
    texts = [*odd, *(f"the same {i % 60}" for i in range(120))]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = capture.superseded(df, df)
    words = lambda t: " ".join(re.split(r"[ \t\n\x0b\f\r]+", t)[:2])
    low = [(i, t.strip(" ").lower()) for i, t in rows if t is not None]
    want = sorted((i, j) for i, a in low for j, b in low if words(a) and b.startswith(words(a)) and a != b)
    tasks = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sorted(map(tuple, got.collect())) == want
    assert max(r["count"] for r in tasks) < len(want) / 8


def test_cells_of_one_table(spark):
    """Queries and vectors of one derived table, joined with it again."""
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "k long, e array<double>")
    v = spark.range(30).withColumn("k", F.col("id") % 5).join(few, "k").select("id", F.col("e").alias("vec"))
    got = approximate.exact_topk(v, v.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vec"), 3).join(v, "id").select("query_id", "rank", "id", "vec")
    assert got.count() == 9
