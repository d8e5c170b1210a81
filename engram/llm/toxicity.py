"""Toxicity by maximum-scoring segments.

Log-odds of tokens come from labelled documents, smoothed by Dirichlet priors in two levels: the prior of a token
is the class share of its longest known beginning, and that of a beginning is the base rate. Less a constant drift,
tokens of clean text have a negative mean, so that segment scores obey extreme-value theory (lambda from the score
distribution, K by the mean of clean documents' maxima). A linear scan finds every maximal scoring segment of a
text; a segment's normalised score is lambda * S - ln(K * n). A document's evidence is the sum statistic of its segments:
the largest sum of its r best normalised scores less ln r!, so that every significant passage adds to it. The evidence is
calibrated to a probability; texts without any segment have the rate of label 1 among such texts.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import add_columns, arrow_map, cut, prepare, quoted, widened

TOKEN = re.compile(r"[^\W_]+")
#: Bounds of the model, whatever the input: labelled rows (expected), kept tokens, characters of beginnings, prior weight, drift.
SAMPLE_ROWS, KEPT, BEGINNINGS, WEIGHT, DRIFT = 20_000, 40_000, (4, 5, 6), 8.0, 1.5
#: Tokens by which a text counts as longer than it is, so that a weak token does not decide a short one.
SHORT = 50
_MEMO = 400_000


class Model:
    """Scores of tokens, the extreme-value parameters and the calibration."""

    def __init__(self, counts: dict[str, tuple[int, int]], n0: int, n1: int, prior: float):
        self.counts, self.prior = counts, prior
        self.base = (n1 + 0.5) / (n0 + n1 + 1)
        self.lam, self.log_k, self.slope, self.shift, self.memo = 1.0, 0.0, 1.0, math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), {}
        self.without = prior  # the probability of texts without a segment

    def share(self, key: str, above: float) -> float:
        c = self.counts.get(key)
        return (c[1] + WEIGHT * above) / (c[0] + c[1] + WEIGHT) if c else above

    def token(self, w: str) -> float:
        """Log-odds of a lower-case token less the drift, at least -DRIFT."""
        if (x := self.memo.get(w)) is None:
            p = self.base
            for k in BEGINNINGS:
                if len(w) > k:
                    p = self.share("^" + w[:k], p)
            p = self.share(w, p)
            x = max(-DRIFT, math.log(p / (1 - p)) - math.log(self.base / (1 - self.base)) - DRIFT)
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[w] = x
        return x

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Every maximal scoring segment (first token, end, score) in one linear scan, and the number of tokens."""
        scores = np.fromiter(map(self.token, TOKEN.findall(text.lower())), float)
        return maximal_segments(scores), len(scores)

    def normalised(self, score: float, n: int) -> float:
        return self.lam * score - self.log_k - math.log(n + SHORT)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float | None:
        """The sum statistic of a document's segments; None without any."""
        best, total = None, 0.0
        for r, s in enumerate(sorted((s[2] for s in segments), reverse=True), 1):
            total += self.normalised(s, n) - math.log(r)
            best = total if best is None or total > best else best
            if total < best - 50:
                break  # further ones are smaller still
        return best

    def probability(self, z: float | None) -> float:
        if z is None:
            return self.without
        x = self.shift + self.slope * z
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores; runs of negative scores are stepped over."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(r - left)) for s, e, left, r, _ in stack]


def _train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> Model:
    """labels: id and 0 or 1, a row for each id. The sample is chosen by a hash of the id."""
    n = dict(labels.groupBy("toxic").count().collect())
    total = sum(n.values())
    prior = (n.get(1, 0) + 0.5) / (total + 2)
    if not n.get(0) or not n.get(1):
        return Model({}, 1, 0, prior)
    share = min(1.0, sample_rows / total)
    some = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)  # expected: sample_rows of two numbers each
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(some), "id")

    def tokens(b: pa.RecordBatch) -> dict:
        held: dict[str, list[int]] = {}
        for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = set(TOKEN.findall((text or "").lower()))
            for w in words | {"^" + w[:k] for w in words for k in BEGINNINGS if len(w) > k}:
                held.setdefault(w, [0, 0])[y] += 1
        return {"w": pa.array(list(held), pa.string()), "c0": pa.array([c[0] for c in held.values()], pa.int64()), "c1": pa.array([c[1] for c in held.values()], pa.int64())}

    sample = cut(rows.select("id", "text", F.col("toxic").cast("int").alias("toxic")))
    counts = cut(arrow_map(sample, tokens, "w string, c0 long, c1 long").groupBy("w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where("c0 + c1 > 1"))
    total = dict(sample.groupBy("toxic").count().collect())
    d0, d1 = total.get(0, 0), total.get(1, 0)
    if not d0 or not d1:
        return Model({}, 1, 0, prior)
    rate = d1 / (d0 + d1)
    gain = (F.col("c1") - rate * (F.col("c0") + F.col("c1"))) / F.sqrt(rate * (1 - rate) * (F.col("c0") + F.col("c1")))
    kept = counts.orderBy(F.abs(gain).desc(), "w").limit(KEPT).collect()
    model = Model({r.w: (r.c0, r.c1) for r in kept}, d0, d1, prior)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    hist = arrow_map(sample.where("toxic = 0"), lambda b: _histogram(shared.value, b), "x long, c long").groupBy("x").agg(F.sum("c").alias("c")).collect()
    model.lam = decay(np.array([r.x for r in hist]) / 100, np.array([r.c for r in hist], float))
    lam = model.lam

    def maxima(b: pa.RecordBatch) -> dict:
        out = [(max([0.0, *(s[2] for s in segments)]), n) for segments, n in map(shared.value.segments, (t or "" for t in b.column(1).to_pylist()))]
        return {"x": pa.array([lam * s - math.log(n + SHORT) for s, n in out if n], pa.float64())}

    mean = arrow_map(sample.where("toxic = 0"), maxima, "x double").agg(F.avg("x")).first()[0]
    model.log_k = (mean or 0.0) - 0.5772156649  # mean of a Gumbel variable
    lam, log_k = model.lam, model.log_k

    def evidence(b: pa.RecordBatch) -> dict:
        m = shared.value
        m.lam, m.log_k = lam, log_k
        return {"y": b.column(2).cast(pa.int32()), "z": pa.array([m.evidence(*m.segments(t or "")) for t in b.column(1).to_pylist()], pa.float64())}

    got = arrow_map(sample, evidence, "y int, z double").toArrow()  # two numbers for each row of the sample
    calibrate(model, got["y"].to_numpy().astype(float), got["z"].to_numpy())
    model.memo = {}
    shared.destroy()
    return model


def _histogram(model: Model, b: pa.RecordBatch) -> dict:
    held: dict[int, int] = {}
    for text in b.column(1).to_pylist():
        x, c = np.unique(np.round([100 * model.token(w) for w in TOKEN.findall((text or "").lower())]).astype(np.int64), return_counts=True)
        for k, v in zip(x.tolist(), c.tolist(), strict=True):
            held[k] = held.get(k, 0) + v
    return {"x": pa.array(list(held), pa.int64()), "c": pa.array(list(held.values()), pa.int64())}


def decay(x: np.ndarray, c: np.ndarray) -> float:
    """lambda with sum p * exp(lambda x) = 1 over clean tokens' scores x, which occur c times."""
    if not len(x) or not (x > 0).any() or (x * c).sum() >= 0:
        return 1.0
    p, low, high = c / c.sum(), 1e-3, 1.0
    while (p * np.exp(np.minimum(high * x, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * x, 700))).sum() < 1 else (low, mid)
    return high


def calibrate(model: Model, y: np.ndarray, z: np.ndarray) -> None:
    """A logistic curve over the evidence z; where it is nan, the smoothed rate of label 1."""
    none = np.isnan(z)
    model.without = float((y[none].sum() + model.prior) / (none.sum() + 1))
    y, z = y[~none], z[~none]
    a, b = 0.0, model.shift
    for _ in range(50):  # Newton steps of a logistic regression with a weak normal prior
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((y - p) * z).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    model.slope, model.shift = max(a, 1e-3), b


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on about sample_rows labelled rows (all, if fewer); of their tokens the KEPT most telling are the model's. labels: id_col and toxic; null labels are left out, and an
    id with several labels is toxic if one of them is. Without both classes the model scores every text alike, by the
    smoothed rate of label 1."""
    prepare(docs.sparkSession)
    labels = labels.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    return _train(docs, labels, id_col, text_col, sample_rows)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", evidence: float = 0.0) -> DataFrame:
    """docs with score (double, 0 to 1), predicted (int, 1 if score >= 0.5) and passages: array of (first token, end,
    score, z) of every maximal scoring segment whose normalised score z is above evidence.

    Only the text counts. Null and empty texts score as texts without a segment; equal texts score alike. Columns
    of docs with these names are replaced, all others pass through; no row is dropped."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)  # at most KEPT tokens

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, score, passages = shared.value, [], []
        for text in batch.column(batch.schema.names.index(text_col)).cast(pa.string()).to_pylist():
            found, n = m.segments(text or "")
            score.append(m.probability(m.evidence(found, n)))
            passages.append([{"first": a, "end": b, "score": s, "z": z} for a, b, s in found if (z := m.normalised(s, n)) > evidence])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("z", pa.float64())]))
        return add_columns(batch, score=pa.array(score, pa.float64()), predicted=pa.array([int(s >= 0.5) for s in score], pa.int32()), passages=pa.array(passages, kind))

    return arrow_map(docs, run, widened(docs, score="double", predicted="int", passages="array<struct<first:int,end:int,score:double,z:double>>"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, held_out (false for a null id), score, predicted, n_passages. Cases are those
    of score_toxicity."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").where(common.fold(F.col("doc_id"), 5) != 0)
    out = score_toxicity(docs, fit_toxicity(docs, labels))
    return out.select("doc_id", F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
