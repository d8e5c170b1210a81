"""The vector operators against brute force."""

import numpy as np
import pytest

from engram.llm import common, topk, vector_dedup
from engram.llm.common import connected_components


def vectors(n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 3):
        x[i] = x[(i // 30) * 30] + rng.standard_normal(dim) * 0.03 * (i % 5)
    x[7] = x[8]
    x[9] = 2 * x[8]
    rows = [(i, x[i].tolist(), i % 3 if i % 11 else None, "c") for i in range(n)]
    rows += [(n, None, 1, "c"), (n + 1, [0.0] * dim, 1, "c"), (n + 2, [float("nan")] * dim, 1, "c"), (n + 3, [None] + [1.0] * (dim - 1), 1, "c"), (None, x[0].tolist(), 1, "c")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int, score string").repartition(3)


def test_topk(spark, table, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 64)
    rows = [(i, np.floor(256 * np.array(v))) for i, v, _, _ in vectors() if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in rows:
        if i % 50 == 0:
            for r, (s, j) in enumerate(sorted((-(q @ p), j) for j, p in rows if j != i)[:5], 1):
                want.add((i, r, j, int(-s)))
    assert set(map(tuple, topk.top_k(table, topk.F.col("id") % 50 == 0).collect())) == want
    few = table.where("vec_id < 3")
    assert topk.top_k(few, topk.F.col("id") == 0).count() == 2 and topk.top_k(table.limit(0), topk.F.col("id") == 0).count() == 0


def brute_top_k(rows, k):
    """rows: (id, vector of any length). Python's integers throughout."""
    whole = [(i, [int(x // 2**-8) if abs(x) < 2**44 else int(x) * 256 for x in v]) for i, v in rows]
    out = set()
    for i, q in whole:
        if i % 50 == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, p, strict=True)))), j) for j, p in whole if j != i and len(p) == len(q)]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_topk_of_odd_vectors(spark, monkeypatch):
    """Components near the ends of doubles, sums beyond 2^53 and beyond a long, several lengths, ties, repeated rows."""
    monkeypatch.setattr(topk, "GROUP", 32)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(-3, 12)).tolist()) for i in range(150)]
    rows += [(200 + i, rng.standard_normal(3).tolist()) for i in range(120)]
    rows += [(400, [1e307, -1e307, 3.0]), (401, [1e307, 1.0, 2.0]), (450, [-1e300, 2.0, 1.0]), (500, [1.0]), (501, [2.0]), (502, [2.0]), (503, [2.0]), (504, [0.5]), (505, [0.25]), (506, [-3.0]), (550, [7.0] * 9)]
    d = spark.createDataFrame(rows + [(None, [1.0]), (600, None)], "vec_id long, embedding array<double>").repartition(5)
    assert set(map(tuple, topk.top_k(d, topk.F.col("id") % 50 == 0).collect())) == brute_top_k(rows, 5)
    twice = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(twice, topk.F.col("id") == 0, 2).orderBy("rank").collect()] == [(0, 1, 3, 196608), (0, 2, 7, 196608)]


def test_topk_prunes_groups(spark, monkeypatch):
    """Queries are not sent to every group: far groups are dropped by centre and radius before any vector is dealt."""
    monkeypatch.setattr(topk, "GROUP", 64)
    rng = np.random.default_rng(6)
    centres = np.array([[np.cos(t), np.sin(t), 0, 0] for t in np.linspace(0, 6.1, 24)]) * 50
    rows = [(i, (centres[i % 24] + rng.standard_normal(4) * 0.1).tolist()) for i in range(2400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dealt, real = [], topk.cut

    def counted(df):  # the first visit's result holds the roots
        out = real(df)
        if "other" in out.columns:
            dealt.append(out)
        return out

    monkeypatch.setattr(topk, "cut", counted)
    asked, mapped = [], type(d).mapInArrow

    def pairs_of(self, f, schema, *a):
        out = mapped(self, f, schema, *a)
        if "to long" in schema:
            asked.append(out)
        return out

    monkeypatch.setattr(type(d), "mapInArrow", pairs_of)
    got = set(map(tuple, topk.top_k(d, topk.F.col("id") % 50 == 0).collect()))
    assert got == brute_top_k(rows, 5)
    pairs, blocks, groups = asked[0].count(), dealt[0].where("kind = 3").count(), dealt[0].where("kind = 1").count()
    assert groups > 8 and pairs < 0.4 * blocks * (groups - 1)


def test_near_vectors(spark, table):
    rows = [r for r in vectors() if r[0] is not None]
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, lab, _ in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {r[0]: r[2] for r in rows}
    links = {i: [j for j in good if j != i and label[i] == label[j] and good[i] @ good[j] >= 0.98] for i in good}
    comp = {r[0]: r[0] for r in rows}
    for i in sorted(links):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(seen)
    got = {r.id: r for r in vector_dedup.near_vectors(table).collect()}
    for r in rows:
        assert (got[r[0]].n_links, got[r[0]].component_id) == (len(links.get(r[0], ())), comp[r[0]])
    assert got[None].n_links == 0 and got[None].kept and vector_dedup.near_vectors(table.limit(0)).count() == 0


def test_two_dense_groups_with_one_link(spark):
    """i and j are just similar; all others of their groups lie next to them, on the far side."""
    angle, rows, sizes = np.arccos(0.98) - 1e-7, [], [(150, 90), (200, 130), (170, 210)]
    for label, (a, b) in enumerate(sizes):
        turns = [-1e-4 * k for k in range(a)] + [angle + 1e-4 * k for k in range(b)]
        rows += [(1000 * label + k, [float(np.cos(t)), float(np.sin(t)), 0.0], label) for k, t in enumerate(turns)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: r for r in vector_dedup.near_vectors(d).collect()}
    for label, (a, b) in enumerate(sizes):
        i = 1000 * label
        assert {got[i + k].component_id for k in range(a + b)} == {i}
        assert [got[i + k].n_links for k in (0, 1, a, a + 1)] == [a, a - 1, b, b - 1]


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40) if i in got) and all(got[k] == 100 for k in range(100, 140))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HELD_EDGES", 20)
    chain = [(i * 7919 % 3001, (i + 1) * 7919 % 3001) for i in range(2500)]
    hub = [(9000, 9000 + k) for k in range(1, 2500)] + [(8999, 9000), (9100, 12000), (12000, 12001)]
    e = spark.createDataFrame(chain + hub, "a long, b long").repartition(17)
    got = {r.node: r.component for r in connected_components(e).collect()}
    low = min(i * 7919 % 3001 for i in range(2501))
    assert {got[i * 7919 % 3001] for i in range(2501)} == {low} and {got[k] for k in [*range(8999, 11500), 12000, 12001]} == {8999}
    assert len(got) == 2501 + 2501 + 2
