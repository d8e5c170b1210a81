"""Golden cases of the record operators on tiny frames."""

import pytest
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import evaluate, filters, graph, maintain, multi, recall, search, temporal
from engram.operators.search import SearchParams
from engram.schema import EngineError

MEM = "id long, type string, created long, updated long, importance double, confidence double, agent_id string, tags array<string>, data string, expires_at long, deleted boolean"


def mem(spark, rows):
    """rows: dicts over defaults."""
    base = {"type": "semantic", "created": 0, "updated": 0, "importance": 0.0, "confidence": 1.0, "agent_id": "a", "tags": [], "data": "x", "expires_at": 0, "deleted": False}
    names = [c.split()[0] for c in MEM.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": i + 1} | r)[n] for n in names) for i, r in enumerate(rows)], MEM)


def ids(df):
    return [r.id for r in df.collect()]


def toks(spark, s):
    return spark.range(1).select(X.tokens(F.lit(s)).alias("t")).first().t


def test_tokenizer(spark):
    assert toks(spark, "--tenant-max-records") == ["tenant-max-records", "tenant", "max", "records"]
    assert toks(spark, "see hnsw.c:214 now") == ["see", "hnsw.c:214", "hnsw", "214", "now"]
    assert toks(spark, "_private (coffee), tea. done:") == ["_private", "private", "coffee", "tea", "done"]
    assert toks(spark, "Straße ÀB ...") == ["straße", "Àb"]
    assert toks(spark, "a" * 80) == ["a" * 64]
    assert toks(spark, "") == [] and X.query_terms("Tea tea --x-yy") == ["tea", "x-yy", "yy"]


def test_bm25(spark):
    m = mem(spark, [{"data": "the log"}, {"data": "the log rare_marker"}, {"data": "the log and the log again"}])
    hits = search.lexical(m, "rare_marker the").orderBy(F.desc("bm25"), "id").collect()
    assert hits[0].id == 2 and len(hits) == 3
    assert ids(search.search(m, SearchParams(query="log"))) == [1, 3, 2]  # the shorter one first
    assert search.lexical(m, "...").count() == 0


def test_vectors(spark):
    ys = [0, 0.25, 0.5, 1, 2, 4]
    m = mem(spark, [{} for _ in ys])
    v = spark.createDataFrame([(i + 1, [1.0, float(y), 0.0]) for i, y in enumerate(ys)], "id long, vec array<float>")
    q = (1.0, 0.0, 0.0)
    assert ids(search.search(m, SearchParams(embedding=q, top_k=3), v)) == [1, 2, 3]
    assert ids(search.search(m, SearchParams(embedding=q, top_k=2, offset=2), v)) == [3, 4]
    assert ids(search.search(m, SearchParams(embedding=q, min_score=0.95), v)) == [1, 2]
    with pytest.raises(EngineError):
        search.search(m, SearchParams(embedding=q, dim=4), v)


def test_widening(spark):
    m = mem(spark, [{"tags": ["common"]}] * 60 + [{"tags": ["rare"]}] * 3)
    v = spark.createDataFrame([(i + 1, [1.0, 0.001 * i, 0.0]) for i in range(63)], "id long, vec array<float>")
    assert ids(search.search(m, SearchParams(embedding=(1.0, 0.0, 0.0), tags=("rare",), top_k=3), v)) == [61, 62, 63]


def test_hybrid(spark):
    m = mem(spark, [{"data": "near only"}, {"data": "the exact marker"}, {"data": "marker marker"}])
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "id long, vec array<float>")
    rows = search.search(m, SearchParams(query="marker", embedding=(1.0, 0.0)), v).collect()
    assert rows[0].id == 2 and {r.id for r in rows} == {1, 2, 3} and rows[0].weight == 1.0
    one = search.search(m, SearchParams(query="marker", embedding=(1.0, 0.0), min_score=0.999), v)
    assert {r.id: (r.srank, r.lrank) for r in one.collect()}[2][0] is None
    assert any('"lexical":true' in r.e and '"semantic":false' in r.e for r in one.select(search.explained(one).alias("e")).collect())


def test_filters_and_caps(spark):
    m = mem(spark, [{"importance": x, "created": i} for i, x in enumerate([0.1, 0.2, 0.9, 0.3, 0.95])])
    assert ids(search.search(m, SearchParams(max_importance=0.5))) == [1, 2, 4]
    assert search.count(m, SearchParams(scan_cap=2)).first()[:] == (2, True)
    assert ids(search.search(mem(spark, [{"expires_at": 5}, {}]), SearchParams(now=5))) == [2]
    assert m.where(filters.record_filter(start=1)).count() == 5  # one end alone does not count
    p = filters.export_page(m, "a", 0, 2).collect()
    assert [r.id for r in p] == [1, 2] and p[0].has_more and p[0].cursor == 2
    assert not filters.export_page(m, "a", 2, 3).first().has_more


def versions(spark):
    rows = [(1, 1, 10, "v1", False), (1, 2, 20, "v2", False), (1, 3, 30, "v3", False), (1, 4, 40, "v3", True)]
    return spark.createDataFrame(rows, "id long, seq long, updated long, data string, deleted boolean")


def test_time(spark):
    v = versions(spark)
    assert [(r.valid_from, r.valid_to) for r in temporal.history(v).orderBy("seq").collect()] == [(10, 20), (20, 30), (30, 40), (40, 0)]
    assert [temporal.as_of(v, t).select("data").collect() and temporal.as_of(v, t).first().data for t in (10, 20, 9, 30, 50)] == ["v1", "v2", [], "v3", []]
    assert temporal.current(v).count() == 0
    assert maintain.compaction_worthwhile(v).first()[:] == (0, 4, True)


def test_forget(spark):
    m = mem(spark, [{"type": "episodic", "importance": 0.4}, {"type": "episodic", "importance": 0.4}, {"importance": 0.01}, {"type": "episodic", "importance": 0.0}])
    u = spark.createDataFrame([(1, 9, 0)], "id long, recall_count long, last_recalled long")
    assert sorted(ids(maintain.forget(m, u, 0, min_retention=0.5))) == [2, 4]
    assert sorted(ids(maintain.forget(m, u, 0, min_retention=0.5, usage_weight=0.0))) == [1, 2, 4]
    assert ids(maintain.forget(m, u, 0, min_retention=0.5, max_forget=1)) == [2]


def test_consolidate(spark, tmp_path):
    m = mem(spark, [{"importance": 0.2, "tags": ["a"], "updated": 1}, {"importance": 0.9, "tags": ["b"], "updated": 2}, {"importance": 0.5, "tags": ["c"], "updated": 3}, {"importance": 0.5}])
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.999, 0.001, 0.0]), (3, [0.998, 0.002, 0.0]), (4, [0.0, 1.0, 0.0])], "id long, vec array<double>")
    p = maintain.similar_pairs(v, 0.95)
    assert {(r.a, r.b) for r in p.collect()} == {(1, 2), (1, 3), (2, 3)}
    r = maintain.merged(m, maintain.stars(p, p.select(F.col("a").alias("id")).union(p.select("b")))).collect()
    assert len(r) == 1 and r[0].survivor == 3 and r[0].tags == ["a", "b", "c"] and r[0].importance == 0.9 and r[0].supersedes == [1, 2]


def test_stars_run_to_the_end(spark):
    """A chain of 90 ids: every other id seeds, however many rounds that takes; copies follow their representative."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 90)], "a long, b long")
    got = {r.id: r.seed for r in maintain.stars(chain, chain.select(F.col("a").alias("id")).union(chain.select("b"))).collect()}
    assert got == {i: i - 1 if i % 2 == 0 else i for i in range(1, 91)}
    near = [1.0, 0.0], [0.999, 0.02], [0.0, 1.0]
    v = spark.createDataFrame([(1, near[0]), (5, near[0]), (3, near[1]), (8, near[1]), (9, near[2])], "id long, vec array<double>")
    assert {r.id: r.seed for r in maintain.clusters(v, 0.95).collect()} == {1: 1, 5: 1, 3: 1, 8: 1, 9: 9}


def test_containing(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "xbc"), (3, None), (4, "")], "id long, data string")
    asked = spark.createDataFrame([(7, "bc"), (8, "abc"), (9, "bc"), (10, "zz"), (11, "")], "pattern_id long, pattern string")
    assert sorted(map(tuple, multi.containing(docs, asked).collect())) == [(7, 1), (7, 2), (8, 1), (9, 1), (9, 2)]


def test_terms_are_tokens(spark):
    for t in ("--tenant-max-records", "see hnsw.c:214 now", "_private (coffee), tea. done:", "Straße ÀB ...", "a" * 80, "", "x_-_y __ a.b"):
        assert X.terms(t) == toks(spark, t)


def test_graph(spark):
    m = mem(spark, [{} for _ in range(26)])
    e = spark.createDataFrame([(1, i, "link") for i in range(2, 27)] + [(2, 1, "back")], "from_id long, to_id long, kind string")
    assert graph.traverse(m, e, 1).count() == 26
    assert graph.traverse(m.where("id != 2"), e, 2, 3).count() == 0
    r, bad = graph.relate(m.withColumn("relationships", F.expr("cast(array() as array<struct<from_id:bigint,to_id:bigint,kind:string>>)")), spark.createDataFrame([(1, 2, "k"), (1, 2, "k"), (1, 1, "k"), (1, 99, "k")], "from_id long, to_id long, kind string"))
    assert len(r.first().relationships) == 1 and sorted(x.reason for x in bad.collect()) == ["INVALID_REQUEST", "NOT_FOUND"]


def test_capture(spark):
    s = spark.createDataFrame([("Note that the build is green.",), ("position: fixed; top: 0;",), ("12\tdef f():",), ("We decided to always use tabs.",), ("",)], "t string")
    r = s.select(F.round(X.salience(F.col("t")), 6).alias("s"), X.looks_like_code(F.col("t")).alias("c"), X.inferred_tags(F.col("t")).alias("g")).collect()
    assert [x.s for x in r] == [0.6, 0.6, 0.0, 0.9, 0.0]
    assert [x.c for x in r] == [False, True, True, False, False]
    assert r[3].g == ["session", "decision", "preference"]


def test_recall_context(spark):
    h = spark.createDataFrame([(1, i, i, "word " * 30, ["t"]) for i in range(1, 4)], "query_id long, rank int, id long, data string, tags array<string>")
    r = recall.context(h, per_memory=50, budget=130).first()
    assert r.included == 1 and "(+2 more relevant memories omitted" in r.context and " […]" in r.context


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 9)], "query_id long, rank int, id long")
    rel = spark.createDataFrame([(1, 6), (2, 7)], "query_id long, id long")
    assert evaluate.means(evaluate.per_query(hits, rel, (1, 2))).first()[:] == (2, 0.0, 0.5, 0.25)
