"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gc
import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engram.llm import bpe, common, html_extract, line_dedup, lm_score, minhash, mixing, substring_dedup, toxicity
from engram.llm.common import hashed_words
from engram.llm.fm_index import FMIndex

WORDS = [f"w{i}" for i in range(60)]


def texts(n=60, seed=1):
    """Texts that share passages and lines; some copies, near copies, null, empty and long ones."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    out = [None, "", "  \n ", "One line that is long enough here\nshort\n" * 3, "x " * 4000]
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 150))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        t = " ".join(words)
        if i % 5 == 0:
            t += "\n\tOne LINE that is long enough here \nown line number %d of this text" % i
        out.append(t)
        if i % 6 == 0:
            out.append(t)
        if i % 7 == 0 and len(words) > 60:
            out.append(t.replace(words[3], "changed", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i * 2) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, extra long").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_hashed_words():
    """Equal words have equal hashes wherever they stand, different ones different hashes."""
    rng = random.Random(1)
    some = [b"", b" \n", b"one", b"x" * 5000, *["".join(rng.choice("abAB\xc3\xa9 \t\x0b.") for _ in range(rng.randrange(300))).encode("latin-1") for _ in range(400)]]
    for lower in (False, True):
        h, n = hashed_words(some, lower)
        words = [(w.lower() if lower else w) for t in some for w in t.split()]
        assert n.tolist() == [len(t.split()) for t in some] and len(h) == len(words)
        names = dict(zip(words, h.tolist(), strict=True))
        assert [names[w] for w in words] == h.tolist() and len(set(names.values())) == len(names)
    assert hashed_words([])[1].tolist() == hashed_words([b""])[0].tolist() == []


def test_line_dedup(spark, docs):
    rows = texts()
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t in enumerate(rows):
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20:
                held.setdefault(key(s), set()).add(i)
    got = by_id(line_dedup.dedup_lines(docs))
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        lines = (t or "").split("\n")
        stay = [s for s in lines if not (len(held.get(key(s), ())) >= 3 and max(held[key(s)]) != i)]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped, got[i].extra) == ("\n".join(stay), len(lines), len(lines) - len(stay), 2 * i)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    same = spark.createDataFrame([(None, "a line of twenty characters"), (1, "a line of twenty characters"), (1, "a line of twenty characters")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(same).collect()) == [(0, ""), (1, "a line of twenty characters"), (1, "a line of twenty characters")]


def test_perfect_hash():
    for n in (1, 2, 7, 500):
        h = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64) * np.uint64(12)
        p = line_dedup.PerfectHash.build(h)
        assert sorted(p.slot(h).tolist()) == list(range(n))


def test_arrays_of_keys_that_share_a_half():
    """Keys whose first, second or combined halves are equal still get slots of their own."""
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 300))
    h1[1], h2[3] = h1[0], h2[2]
    h1[5], h2[5] = h2[4], h1[4]  # one name under salt 0
    n, last = np.full(300, 3), np.arange(300)
    a = line_dedup.Arrays.unpack(line_dedup.Arrays(h1, h2, n, last).pack())
    assert a.salt > 0 and not a.dropped(h1, h2, last).any() and a.dropped(h1, h2, last + 1).all()
    assert not a.dropped(h1 + 1, h2, last + 1).any()


def test_line_dedup_names(spark):
    line = "a line of twenty characters and more"
    d = spark.createDataFrame([(i, f"{line}\nown {i}", "c", "d") for i in range(4)], "doc_id long, text string, __doc string, __gone string")
    got = line_dedup.dedup_lines(d).collect()
    assert {(r.doc_id, r.text, r["__doc"], r["__gone"]) for r in got} == {*((i, f"own {i}", "c", "d") for i in range(3)), (3, f"{line}\nown 3", "c", "d")}


def test_fm_index():
    rng = np.random.default_rng(3)
    for window in (1, 5, 20):
        s = rng.integers(1, 6, 600)
        s[300:400] = s[100:200]
        s[::97] = 0
        values = rng.permutation(600)
        f = FMIndex(s, 6, window, values)
        for p in [s[i : i + m] for m in (1, window, window + 1) for i in range(0, 600 - m, 7)]:
            low, high = np.array([0]), np.array([len(s)])
            for c in p[::-1]:
                low, high = f.extend(np.array([c]), low, high)
            want = [i for i in range(601 - len(p)) if (s[i : i + len(p)] == p).all()]
            assert high[0] - low[0] == len(want)
            if len(p) == window:
                assert f.least[f.of[low[0]]] == values[want].min() and f.start[f.of[low[0]]] == low[0] and f.end[f.of[low[0]]] == high[0]


def shortened(rows):
    """Brute force: rows of (id, text) in any order to (id, words that stay)."""
    out, seen = [], {}
    sha = lambda t: hashlib.sha256(" ".join((t or "").split()).encode()).digest()
    order = sorted({(-1 if i is None else i, sha(t)) for i, t in rows})
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], sha(r[1]))):
        words, at = (t or "").split(), order.index((-1 if i is None else i, sha(t)))
        off = [False] * len(words)
        for s in range(len(words) - 19):
            if seen.setdefault(tuple(words[s : s + 20]), (at, s)) < (at, s):
                off[s : s + 20] = [True] * 20
        out.append((i, " ".join(w for w, g in zip(words, off, strict=True) if not g), len(words), sum(off)))
    return sorted(out, key=str)


def test_substring_dedup(spark, docs):
    rows = list(enumerate(texts()))
    got = substring_dedup.dedup_substrings(docs).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got), key=str) == shortened(rows)
    assert {r.n_lines for r in got} == {"clash"} and substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_substring_dedup_ids(spark):
    """Null and repeated ids, whole copies of one text of an id, repeated rows, names that clash."""
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))
    p, q, own = some(45), some(30), [some(25) for _ in range(4)]
    rows = [(None, f"{p} {own[0]}"), (None, f"{own[1]} {p}"), (None, own[2]), (1, q), (1, f"{own[3]} {q}"), (1, f"{own[3]} {q}"), (2, q), (2, f"{p} {own[1]} new words"), (3, None), (4, f"{p} {p}")]
    d = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, __doc string, __gone string").repartition(3)
    got = substring_dedup.dedup_substrings(d).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got), key=str) == shortened(rows)
    assert {(r["__doc"], r["__gone"]) for r in got} == {("c", "d")}


def test_substring_dedup_of_short_texts(spark):
    """Tasks that hold no window at all, beside others that do."""
    d = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_words) for r in substring_dedup.dedup_substrings(d).collect()) == [(1, "a b", 2), (2, "c", 1), (3, "", 0)]
    long = " ".join(WORDS)
    rows = [(i, "short") for i in range(20)] + [(i, long) for i in range(20, 25)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartitionByRange(5, "doc_id")
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(d).collect()), key=str) == shortened(rows)


def names_of(text):
    return set(minhash.units(*minhash.weighted(text or "")).tolist())


def test_minhash(spark, docs):
    rows = texts()
    sets = [names_of(t) for t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = {r.doc: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: got[i].component for i in got} == {i: top(i) for i in range(len(rows))}
    assert {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()} == {i for i in range(len(rows)) if top(i) == i}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_large_group(spark):
    """Near copies of one text whose links among each other differ: no link is lost."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 9])):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [names_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = {r.doc: r.component for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in range(len(rows))}


def test_minhash_ids(spark):
    """Null ids have a row each and no links; rows of one id are one document; equal texts are copies."""
    a, b = " ".join(WORDS), " ".join(f"z{i}" for i in range(50))
    rows = [(None, a), (None, a), (3, a), (3, b), (3, b), (9, a.upper()), (7, b + " more"), (8, "short"), (4, "SHORT"), (5, None), (6, " ")]
    d = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, __doc string")
    got = sorted(((r.doc, r.copy_of, r.component) for r in minhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, None, None)] * 2 + [(3, 3, 3), (9, 3, 3), (7, 7, 3), (8, 4, 4), (4, 4, 4), (5, 5, 5), (6, 6, 6)], key=str)
    assert sorted((r.doc_id or 0, r["__doc"]) for r in minhash.drop_near_duplicates(d).collect()) == [(i, "c") for i in (0, 0, 3, 3, 3, 4, 5, 6)]


def test_signatures_estimate_similarity():
    a = [f"w{i}" for i in range(600)]
    b = a[:570] + [f"z{i}" for i in range(30)]
    heavy = (a[:40] * 30, a[:40] * 20 + [f"z{i}" for i in range(200)])
    for x, y in ((a, b), heavy):
        u, v = minhash.weighted(" ".join(x)), minhash.weighted(" ".join(y))
        s = minhash.signatures([u, v], 1600)
        p, q = Counter(dict(zip(*(c.tolist() for c in u), strict=True))), Counter(dict(zip(*(c.tolist() for c in v), strict=True)))
        true = (p & q).total() / (p | q).total()
        assert abs((s[0] == s[1]).mean() - true) < 0.04
        assert abs(minhash.jaccard(minhash.units(*u), minhash.units(*v)) - true) < 1e-12


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return bpe.WordBPE(f.read())


def test_bpe_library(model):
    rng = random.Random(2)
    chars = "abcdeéßİΣσǺ'stnre0123 \n\t\x1c\x85 😀$#<|>中文ñ²½_"
    names = [t.replace("</w>", "") for t in model.vocab]
    some = ["", "a<|startoftext|>b<|endoftext|>", "a" * 900, "$" * 700, "Don't we'll", *["".join(rng.choice(chars) for _ in range(rng.randrange(120))) for _ in range(300)], *["".join(rng.choice(names) for _ in range(4)) for _ in range(1500)], *[t or "" for t in texts()]]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
    got = model.encode_batch(some)
    assert got == want
    assert model.decode_batch(got) == [tok.decode(w, skip_special_tokens=False) for w in want]


def test_bpe_frames(spark, docs):
    out = bpe.encode(docs, decoded="decoded")
    rows = by_id(out)
    assert rows[0].n_tokens == 0 and rows[0].decoded == "" and rows[4].n_tokens == len(rows[4].token_ids) and rows[5].extra == 10
    again = bpe.decode(out.select("doc_id", "token_ids", "decoded"), out_col="again").where("again != decoded").count()
    assert again == 0 and bpe.encode(empty(spark)).count() == 0


def test_workers_are_left_empty(spark, docs):
    """Python workers, which the tasks of all operators share, hold neither another operator's tokenizer nor a memo of words."""

    def held(batches):
        for _ in batches:
            pass
        models = sum(type(x).__name__ == "WordBPE" for x in gc.get_objects())
        yield pa.RecordBatch.from_pydict({"models": pa.array([models]), "words": pa.array([len(common._words)])})

    look = lambda: spark.range(0, 64, 1, 16).mapInArrow(held, "models long, words long").agg(F.sum("models").alias("models"), F.sum("words").alias("words")).first()
    bpe.encode(docs).write.format("noop").mode("overwrite").save()
    assert look().models > 0  # they stay for the operator's next task
    minhash.near_duplicates(docs).write.format("noop").mode("overwrite").save()
    assert tuple(look()) == (0, 0)


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["vile", "rotten", "zakba", "zakbi"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad[:3])
        rows.append((i, " ".join(words), "c"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "c"), (1001, "", "c"), (1002, "w1 zakbuu w2 zakbuu zakbi w3", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    m = toxicity.fit_toxicity(d, spark.createDataFrame(labels[:300] + [(5, None), (None, 1)], "doc_id long, toxic int"))
    got = by_id(toxicity.score_toxicity(d, m))
    assert sum(got[i].predicted != int(i % 5 == 0) for i in range(400)) <= 4
    assert got[1000].predicted == 0 and got[1000].score == got[1001].score and got[1002].predicted == 1 and got[0].passages
    none = toxicity.fit_toxicity(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_toxicity(d, none).collect()} == {0}


def test_maximal_segments():
    """Against the definition: segments that are better than all within them, and within no other such segment."""
    rng = random.Random(6)
    for _ in range(300):
        x = np.array([rng.choice([-3, -1, 1, 2]) for _ in range(rng.randrange(12))], float)
        n, total = len(x), lambda i, j, x=x: x[i:j].sum()
        good = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if total(i, j) > 0 and all(total(a, b) < total(i, j) for a in range(i, j) for b in range(a + 1, j + 1) if (a, b) != (i, j))]
        want = [(i, j) for i, j in good if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in good)]
        assert [g[:2] for g in toxicity.maximal_segments(x)] == want and all(g[2] == total(*g[:2]) for g in toxicity.maximal_segments(x))


def test_every_passage_counts():
    """The evidence of several significant passages is above that of the best alone; weak ones change nothing."""
    m = toxicity.Model({}, 10, 10, 0.5)
    z = [m.normalised(s, 20) for s in (9.0, 8.0, 1.0)]
    assert abs(m.evidence([(0, 1, 8.0), (4, 5, 9.0), (8, 9, 1.0)], 20) - (z[0] + z[1] - math.log(2))) < 1e-9 and m.evidence([(0, 1, 9.0)], 20) == z[0] < z[0] + z[1] - math.log(2)
    assert m.evidence([], 20) is None and m.probability(None) == 0.5


def test_toxicity_query(spark, sf):
    """Held-out accuracy on the smallest tables; a null id, repeated rows and a very long text score as their text does."""
    got = toxicity.op2_toxicity(spark, sf)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = got.collect()
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and all(r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held) > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    text = docs.first().text
    odd = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text + " und" * 100_000)], "doc_id long, text string")
    scores = [r.score for r in toxicity.score_toxicity(odd, m).orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert scores[0] == scores[1] == scores[2] and 0 <= scores[3] <= 1


def test_lm_score(spark, docs):
    rows = texts()
    train = docs.where("doc_id % 5 != 0")
    m, counts = lm_score.fit(train)
    c = Counter(w for i, t in enumerate(rows) if i % 5 for w in [*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    assert (m.n, m.v) == (n, v)
    got = {r.id: r for r in lm_score.score(docs, m, counts).collect()}
    for i, t in enumerate(rows):
        w = [*(t or "").lower().split(), None]
        assert abs(got[i].base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(c[x] > 0 for x in w) and got[i].score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    em, ec = lm_score.fit(empty(spark))
    assert {r.n_known for r in lm_score.score(docs, em, ec).collect()} == {0}


def test_lm_probabilities_sum_to_one(spark, docs):
    """Classes, the members of each class, and the shares within members, after contexts of the training texts."""
    m, _ = lm_score.fit(docs)
    h, ends = lm_score._joined([(t or "").encode() for t in texts()[5:9]])
    c = lm_score.contexts(h, ends)
    x = m.logits(lm_score.features(c))
    p = np.exp(x - x.max(axis=1)[:, None])
    p /= p.sum(axis=1)[:, None]
    assert m.rest > 1 and np.abs(m.inner).max() > 0
    for i in range(0, len(h), 97):
        total = 0.0
        for k in range(m.rest):
            at = np.flatnonzero(m.cls[:-1] == k)
            some = [np.repeat(f[i], len(at)) for f in c]
            total += p[i, k] * np.exp(m.member_scores(some, m.cls[at], m.member[at]) + m.inside[at]).sum()
        rest = np.flatnonzero(m.cls == m.rest)  # with the place of all unseen tokens
        assert abs(total + p[i, m.rest] * np.exp(m.inside[rest].astype(float)).sum() - 1) < 1e-3


def test_lm_step_and_its_cost():
    """A step is that of sums over sorted rows, at less than three quarters of their CPU time; tokens are found by their first bits."""
    rng = np.random.default_rng(3)
    rows = [np.minimum(rng.zipf(1.2, lm_score.STEP) * 7919 % 8192, 8191).astype(np.uint16), rng.integers(0, 8192, lm_score.STEP).astype(np.uint16)]
    x = rng.normal(size=(lm_score.STEP, 33)).astype(np.float32)

    def plain(weights, squares, rows, width, x):
        for k, f in enumerate(rows):
            order = np.argsort(f, kind="stable")
            first = np.flatnonzero(np.r_[True, f[order][1:] != f[order][:-1]])
            grad = np.add.reduceat(x[order], first, axis=0) / np.sqrt(np.diff(np.r_[first, len(f)]))[:, None].astype(np.float32)
            at = f[order][first].astype(np.int32) + k * width
            squares[at] += grad * grad
            weights[at] += lm_score.RATE * grad / np.sqrt(squares[at] + 1)

    took, got = {}, {}
    for step in (plain, lm_score._updated) * 5:
        got[step] = weights, squares = np.zeros((2 * 8192, 33), np.float32), np.ones((2 * 8192, 33), np.float32)
        began = time.thread_time()
        step(weights, squares, rows, 8192, x)
        took[step] = min(took.get(step, 9.0), time.thread_time() - began)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-4) for a, b in zip(got[plain], got[lm_score._updated], strict=True))
    assert took[lm_score._updated] < 0.75 * took[plain]
    head = np.unique(np.r_[rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64), ~np.arange(50, dtype=np.uint64)])
    asked = np.r_[head, head[100:-100] + np.uint64(1), np.uint64(0), ~np.uint64(0), ~np.uint64(77)]
    for some in (head, head[60:-60], head[:0]):
        model = lm_score.Model(some, np.ones(len(some), np.int64), some[:0], np.zeros(0, np.int64), len(some), len(some))
        where = {v: i for i, v in enumerate(some.tolist())}
        assert model.find(asked).tolist() == [where.get(v, len(some)) for v in asked.tolist()]


def test_lm_context_matters(spark):
    """A token that follows another one always is likelier there, within its class too."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"k{j} v{j}" for j in (rng.randrange(40) for _ in range(60)))) for i in range(400)]
    d = spark.createDataFrame(rows + [(900, "k3 v3 k9 v9"), (901, "k3 v9 k9 v3")], "doc_id long, text string")
    m, counts = lm_score.fit(d.where("doc_id < 400"))
    got = {r.id: r for r in lm_score.score(d, m, counts).where("id >= 900").collect()}
    assert got[900].score > got[901].score + 1 and abs(got[900].base_score - got[901].base_score) < 1e-9
    alone = m.inner
    m.inner = np.zeros_like(alone)
    flat = {r.id: r for r in lm_score.score(d, m, counts).where("id >= 900").collect()}
    assert got[900].score > flat[900].score


def test_lm_classes_come_from_all_occurrences(spark, docs):
    """No token of these texts is frequent within a slice; all have a class, however the rows are dealt."""
    few, many = (lm_score.fit(docs.repartition(n))[0] for n in (1, 7))
    assert few.rest > 1 and (few.cls[:-1] < few.rest).all() and (few.cls == many.cls).all()


def mixed_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) + ("###" if i % 3 == 0 else "") for _ in range(rng.randrange(5, 80))), "c") for i in range(300)] + [(900, None, "c"), (901, "", "c"), (902, "w1 " * 20_000, "c"), (7, "w2 w3", "c"), (7, "w2 w3", "c"), (None, "w5 w6", "c")]
    return rows, [(i, 0 if i % 3 == 0 else 1) for i in range(200)] + [(3, 7), (4, None)]


def totals(m):
    return m.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col("posteriors")[k]).alias(f"t{k}") for k in range(2)], F.min("rate").alias("low"), F.sum("tokens").alias("n")).first()


def test_mixing(spark):
    rows, labels = mixed_rows()
    d = spark.createDataFrame([(*r, 7.0, 8.0) for r in rows], "doc_id long, text string, rate string, __chars double, __mtokens double")
    labels = spark.createDataFrame(labels, "doc_id long, domain int")
    m = mixing.mix_sources(d, labels, {0: 0.2, 1: 0.8})
    r = totals(m)
    assert abs(r.t0 / r.n - 0.2) < 1e-6 and abs(r.t1 / r.n - 0.8) < 1e-6 and r.low >= 0 and m.count() == len(rows)
    got = by_id(m)
    assert got[900].rate == got[901].rate == 1.0 and got[901].tokens == 0 and got[3].posteriors[0] > 0.9 and got[902].tokens == 20_000
    assert {(x["__chars"], x["__mtokens"]) for x in got.values()} == {(7.0, 8.0)}
    least = mixing.mix_sources(d.where("doc_id < 902"), labels, {0: 0.2, 1: 0.8}, total="least", most=1.0)
    kept = mixing.resample(least).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in kept} >= {i for i in range(300) if i % 3} | {900, 901} and max(r["count"] for r in kept if r.doc_id != 7) == 1
    r = totals(least)
    assert abs(r.t0 / (r.t0 + r.t1) - 0.2) < 2e-3 and least.where("rate > 1 or posteriors[1] > 0.5 and rate < 1").count() == 0
    assert mixing.mix_sources(d.limit(0), labels, {0: 1.0, 1: 1.0}).count() == 0


def test_mixing_of_words_alone(spark):
    """Domains of equal shape that differ in words: posteriors of rows without a label."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("ab", "cd", "ef", "gh", "ij") if rng.random() < (0.7 if i % 2 else 0.3) else ("ba", "dc", "fe", "hg", "ji")) + str(rng.randrange(40)) for _ in range(60))) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = by_id(mixing.mix_sources(d, spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, domain int"), {0: 1, 1: 1}))
    assert sum((m[i].posteriors[1] > 0.5) == (i % 2 == 1) for i in range(600, 900)) >= 285


def test_rates_against_nonnegative_least_squares(spark):
    """Totals of the fit are those of the optimum, also where targets cannot be reached: it lies on the cone of the rows."""
    rng = np.random.default_rng(5)
    for k, share, most in ((2, (1.0, 0.0), None), (3, (0.3, 0.3, 0.4), None), (2, (0.2, 0.8), 1.0), (3, (0.5, 0.3, 0.0), 2.0)):
        p = rng.dirichlet([3.0] * k, 200)
        tokens = rng.integers(1, 400, 200)
        a, t = p * tokens[:, None], np.array(share) * tokens.sum()
        w = np.ones(200)  # brute force: coordinate descent
        r = a.T @ w - t
        for _ in range(4000):
            for i in range(200):
                new = min(most or np.inf, max(0.0, w[i] - a[i] @ r / (a[i] @ a[i])))
                r += a[i] * (new - w[i])
                w[i] = new
        table = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "tokens long, posteriors array<double>")
        steps, residual = mixing.fit_rates(table, t.tolist(), most)
        got = np.array([x.w for x in table.withColumn("w", mixing.rate(steps, most)).collect()])
        assert got.min() >= 0 and got.max() <= (most or np.inf) and abs(np.linalg.norm(a.T @ got - t) - np.linalg.norm(r)) < 1e-4 * tokens.sum()
        assert abs(residual - np.abs(a.T @ got - t).max() / t.sum()) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body class="page"><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header id="top"><h1>Site</h1></header><div class="cookie-notice">We use cookies, please accept all of them today.</div><main><article><h1>Title &amp; more</h1>
<p>First <b>para</b>graph of the text,
 long enough &eacute;.<p>Second one.<br>After the break.<div class="ad">Buy now, this is a great offer for all.</div><ul><li>one</li><li>two</li></ul>
<form>Subscribe <input name=x></form></article></main><aside><p>Related stories that you may like to read.</p></aside><section id="comments"><article class="comment"><p>I think that this is a very good article.</p></article></section><footer>&copy; 2020 us</footer></body></html>"""


def test_html(spark):
    want = "Title & more First paragraph of the text, long enough é. Second one. After the break. one two"
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (2, "u", None, "c"), (3, "u", "", "c"), (4, "u", "<div>" * 3000 + "Deep text that stands alone here, long enough to be the content of a page. " * 3 + "<p>x" * 50, "c"), (5, "u", "<p>Unclosed < text & more", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_text(pages).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == got[3].text == ""
    assert got[4].text.startswith("Deep text") and got[5].n_chars > 0
    assert html_extract.extract_text(pages.limit(0)).count() == 0


NAMED = [
    ('<article class="post"><div class="post-header"><h1>The heading of it</h1></div><p>Some prose that stands here, as long as it is.</p></article>', "The heading of it Some prose that stands here, as long as it is."),
    ('<article><p>Some prose that stands here, as long as it is.</p><div class="social-commentary"><p>More of the prose, and of the same kind.</p></div></article>', "Some prose that stands here, as long as it is. More of the prose, and of the same kind."),
    ('<div class="legal-news-story"><article><h1>On law</h1><p>Some prose that stands here, as long as it is.</p></article></div>', "On law Some prose that stands here, as long as it is."),
    ('<div class="content no-sidebar" style="overflow:hidden" title="a hidden gem"><p>Some prose that stands here, as long as it is.</p><p>More of it, and as long.</p></div><div class="sidebar"><p>Read this other thing, it is good.</p></div>', "Some prose that stands here, as long as it is. More of it, and as long."),
    ('<div><ul><li><a href="a">Home page</a></li><li><a href="b">All of the news</a></li><li><a href="c">Contact</a></li></ul><p>' + "</p><p>".join(f"Paragraph {i} of a page without any names, and long enough for it." for i in range(5)) + '</p></div><div hidden><p>Not to be seen by anyone, never.</p></div><div style="display: none"><p>Nor this one, as long as it is.</p></div>', " ".join(f"Paragraph {i} of a page without any names, and long enough for it." for i in range(5))),
    ('<div class="promo"><div class="inner">' + "".join(f"<p>Prose {i} that a wrapper's name does not take away, long enough, and more of it.</p>" for i in range(60)) + "</div></div>", " ".join(f"Prose {i} that a wrapper's name does not take away, long enough, and more of it." for i in range(60))),
    ('<main><p>Some prose that stands here, as long as it is.</p></main><div id="comments">' + "".join(f"<div class='comment'><p>I think so too, number {i}, and I say so at length here.</p></div>" for i in range(30)) + "</div>", "Some prose that stands here, as long as it is."),
]


@pytest.mark.parametrize("html, want", NAMED)
def test_html_names(html, want):
    assert html_extract.main_text(f"<html><body>{html}</body></html>")[0] == want


def test_html_cut_decides(spark, sf):
    """On the tables the cut turns the labels of many blocks: prose in adverts and footers, short items of articles."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_extract.fit_blocks(pages)
    assert weights != html_extract.PLAIN and weights[2] < 0 < weights[1]
    r = html_extract.extract_text(pages, weights=weights).agg(F.sum("n_turned").alias("t"), F.sum("n_blocks").alias("n"), F.min("n_chars").alias("low")).first()
    assert r.t > 0.02 * r.n and r.low > 0
    for row in pages.collect():
        whole = html_extract.main_text(row.html, weights)[0]
        parts = [b.text for b in html_extract.blocks(row.html) if b.box.main]  # these pages have one article, with nothing else in it
        assert whole == " ".join(parts)


def test_minimum_cut():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randrange(1, 8)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        pay = lambda lab: sum(max(0, c) if not x else max(0, -c) for c, x in zip(costs, lab, strict=True)) + sum(w for i, j, w in ties if lab[i] != lab[j])
        best = min(pay([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(pay(html_extract.minimum_cut(costs, ties)) - best) < 1e-6


def test_digests(spark, sf):
    """The thin queries on the smallest tables: columns and digests."""
    d = by_id(bpe.op4_bpe(spark, sf))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in list(text)[:40]:
        ids = tok.encode(text[i] or "", add_special_tokens=False).ids
        assert d[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and d[i].n_tokens == len(ids)
