"""The thin queries on the smallest tables: against their SQL or brute force; the pipeline's stages on odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import html_extract, minhash
from engram.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_op1(spark, sf, docs):
    """Counts and base scores by brute force; the model is better than them on held-out texts."""
    got = {r.doc_id: r for r in QUERIES["op1_lm_score"](spark, sf).collect()}
    words = {i: [*(w.lower() if w.isascii() else "".join(ch.lower() if ch.isascii() else ch for ch in w) for w in (t or "").split()), None] for i, t in docs.items() if not any(x in (t or "") for x in "\x1c\x1d\x1e\x1f\x85\xa0")}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    if len(words) == len(docs):
        c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
        n, v = c.total(), len(c)
        for i, ws in words.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
            assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    assert sum(got[i].score for i in docs if held[i]) > sum(got[i].base_score for i in docs if held[i])


def test_op3(spark, sf, docs):
    rows = QUERIES["op3_mixing"](spark, sf).collect()
    assert len(rows) == len(docs) and min(r.rate for r in rows) >= 0 and all(abs(r.low_quality + r.high_quality - 1) < 1e-9 for r in rows)
    t = np.array([[r.low_quality, r.high_quality] for r in rows]) * np.array([[r.tokens * r.rate] for r in rows])
    assert np.allclose(t.sum(axis=0) / t.sum(), [0.25, 0.75], atol=1e-6)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [r for r in rows if quality.get(r.doc_id) is not None and r.tokens]
    assert sum((r.high_quality >= 0.5) == (quality[r.doc_id] == 1) for r in known) >= 0.85 * len(known) > 0


def test_op5(spark, sf):
    got = {r.page_id: r for r in QUERIES["op5_html"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = " ".join(b.text for b in html_extract.blocks(p.html or "") if b.box.main)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


def test_op6(spark, sf, docs):
    got, seen = {r.doc_id: r for r in QUERIES["op6_substring_dedup"](spark, sf).collect()}, set()
    for i in sorted(docs):
        words = (docs[i] or "").encode().split()
        off = [False] * len(words)
        for s in range(len(words) - 19):
            k = tuple(words[s : s + 20])
            if k in seen:
                off[s : s + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(w for w, g in zip(words, off, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), sum(off), hashlib.sha256(kept).hexdigest())


def test_op10(spark, sf, docs):
    """Classes are those of all pairs; recall of the bands is whole on this table."""
    sets = {i: minhash.units(*minhash.weighted(t or "")) for i, t in docs.items()}
    up = {i: i for i in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    some = sorted(i for i in docs if len(sets[i]))
    for k, i in enumerate(some):
        for j in some[:k]:
            if top(i) != top(j) and minhash.alike(sets[i], sets[j], 0.8):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = {r.doc_id: r for r in QUERIES["op10_minhash"](spark, sf).collect()}
    assert {i: got[i].component_id for i in docs} == {i: top(i) for i in docs}
    assert all(got[i].kept == (top(i) == i) and got[i].copy_of <= i for i in docs)


def odd(spark, sf):
    """Rows of the documents' columns: null and repeated ids, null and empty texts, one very long text, a clashing name."""
    kind = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, "some words here", "en", "s", 3), (None, None, None, None, None), (7, "", "en", "s", 0), (7, "a b c d e f", "de", "s", 9), (7, "a b c d e f", "de", "s", 9), (8, "word " * 50_000, "en", "s", 1)]
    return spark.createDataFrame([tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True))[n] for n in kind.names) for r in rows], kind).withColumn("__doc", F.lit("c"))


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, sf, name):
    stage, d = dict(corpus_pipeline.STAGES)[name], odd(spark, sf)
    out = stage(spark, d, sf)
    rows = out.collect()
    assert set(d.columns) <= set(out.columns) and {r["__doc"] for r in rows} == {"c"}
    if name in ("line dedup", "bpe"):
        assert len(rows) == 6
    if name == "minhash near-dedup":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 0, 7, 7, 7, 8]
    assert stage(spark, d.limit(0), sf).count() == 0
