"""LM scoring with a hashed maximum-entropy model.

Counts of every token of the training documents are gathered in one pass, and how often each of the most frequent
ones follows each of a few groups of words, over all of its occurrences, in a second. The most frequent tokens fall into
classes of like contexts (k-means), all others into a last class. The class of the next token is predicted by a softmax over
hashed features: the word before, the word before that (a skip), and both together. Within a class a second softmax over
the same features, hashed with the class, predicts the member: its most frequent tokens are members of their own, the
others share a few members in bands of frequency; within a band, and in the last class, a token has its share of counts.
The features' weights learn by distributed gradient updates: in each of some rounds over growing slices of the
documents, each learner takes adaptive steps over small batches of tokens from the shared weights, and the changes are
averaged. Texts are scored in numpy batches that touch only the rows of features that occur.

Counts of tokens beyond the most frequent ones, which no broadcast can hold, are joined to the texts by token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import arrow_map, cut, hashed_words, prepare, quoted, release, texts

#: Bounds, whatever the input: counts that are broadcast, tokens with a class, classes, groups of contexts, feature rows of a kind.
HEAD, CLASSED, CLASSES, GROUPS, ROWS, KINDS = 1 << 18, 1 << 14, 32, 16, 1 << 13, 3
#: Members of a class, those of them that are one token, feature rows of a kind for members.
MEMBERS, SINGLE, INNER = 32, 24, 1 << 14
#: Training: tokens of a step, step size, weights in a row that is sent, tokens of a learner, and the slices of all documents
#: (sixteenths) of the rounds: every document is in one of them. Learners, and what they send, grow with the tokens.
STEP, RATE, SENT, LEARNER, ROUNDS = 16384, 0.35, 1 << 15, 2_000_000, ((0, 1), (1, 5), (5, 16))
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text, as a hash
_START = np.uint64(0x14057B7EF767814F)
_M = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(64 - HEAD.bit_length() + 1)  # bits of a hash after those that stand for its beginning
HELD, MANY = 200_000, 8


def _joined(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts (words between ASCII white space, A-Z lower-cased, and an end for each), and where each text ends."""
    h, n = hashed_words(batch, lower=True)
    ends = np.cumsum(n + 1)
    out = np.full(len(h) + len(n), END, np.uint64)
    word = np.ones(len(out), bool)
    word[ends - 1] = False
    out[word] = h
    return out, ends


def _before(h: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The token k places before each, within its text."""
    out = np.empty_like(h)
    out[k:], out[:k] = h[:-k], _START
    starts = np.r_[0, ends[:-1]]
    for j in range(k):
        at = starts + j
        out[at[at < np.r_[ends]]] = _START
    return out


def contexts(h: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's features: word before, skip, pair."""
    a, b = _before(h, ends, 1), _before(h, ends, 2)
    return [a, b * np.uint64(3) + np.uint64(1), (a ^ (b * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(5)]


def features(c: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of the classes' weights."""
    top = np.uint64(64 - ROWS.bit_length() + 1)
    return [((x * _M) >> top).astype(np.uint16) for x in c]


def inner_features(c: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
    """Rows of the members' weights: features hashed with the class."""
    top, salt = np.uint64(64 - INNER.bit_length() + 1), (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
    return [(((x ^ salt) * _M) >> top).astype(np.uint16) for x in c]


def _sums(x: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, times, sum of x) for each number in f. Rows of x that share a number are added one after the other, for all numbers
    at once; numbers with many rows, which are few, each for itself."""
    order = np.argsort(f, kind="stable")
    g = f[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    times = np.diff(np.r_[first, len(g)])
    by = np.argsort(times, kind="stable")
    first, times = first[by], times[by]
    few = int(np.searchsorted(times, MANY, side="right"))
    out = np.take(x, order[first], 0)
    for j in range(1, MANY):
        at = int(np.searchsorted(times[:few], j, side="right"))
        if at == few:
            break
        out[at:few] += np.take(x, order[first[at:few] + j], 0)
    for i in range(few, len(first)):
        out[i] = np.take(x, order[first[i] : first[i] + times[i]], 0).sum(axis=0, dtype=np.float64)
    return g[first].astype(np.intp), times, out


def _updated(weights: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], width: int, x: np.ndarray) -> None:
    """A step along x, the gradient by the logits of each token: rows that occur, scaled by their past squares."""
    for k, f in enumerate(rows):
        at, times, grad = _sums(x, f)
        grad /= np.sqrt(times).astype(np.float32)[:, None]
        at += k * width
        past = np.take(squares, at, 0)
        past += grad * grad
        squares[at] = past
        past += 1
        grad *= np.float32(RATE)
        grad /= np.sqrt(past, out=past)
        grad += np.take(weights, at, 0)
        weights[at] = grad


def _top(x: np.ndarray) -> np.ndarray:
    """What is taken off each row of logits before they go through exp: the largest of all where no row vanishes by that, else
    the largest of each row."""
    most = x.max()
    return np.full((len(x), 1), most) if most - x.min() < 80 else x.max(axis=1)[:, None]


def _errors(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The gradient of the log probability of outcome `of` by logits x, which it replaces."""
    x -= _top(x)
    np.exp(x, out=x)
    x /= -np.einsum("ij->i", x)[:, None]
    x[np.arange(len(x)), of] += 1
    return x


def _logs(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of logits x, which it replaces, at outcome `of`."""
    x -= _top(x)
    out = x[np.arange(len(x)), of]
    return out - np.log(np.einsum("ij->i", np.exp(x, out=x)))


def _summed(table: np.ndarray, rows: list[np.ndarray], width: int) -> np.ndarray:
    """The sum of a row of each kind; table: width rows of a kind, one kind after the other."""
    x = np.take(table, rows[0].astype(np.intp), 0)
    for k in range(1, KINDS):
        x += np.take(table, rows[k].astype(np.intp) + k * width, 0)
    return x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): counts of tokens, summed over what memory holds."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> None:
        if held:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held[:] = [(h[first], np.add.reduceat(n, first))]

    def sent() -> Iterator[pa.RecordBatch]:
        for h, n in held:
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n)})
        held.clear()

    for b in batches:
        some = texts(b.column(0))
        for i in range(0, len(some), 500):
            u, n = np.unique(_joined(some[i : i + 500])[0], return_counts=True)
            held.append((u, n.astype(np.int64)))
            size += len(u)
            if size > 2 * HELD:
                out()
                size = len(held[0][0])
                if size > HELD:
                    yield from sent()
                    size = 0
    out()
    yield from sent()


def _contexts(classed):
    """(h, g, n): how often each token of a broadcast sorted array follows each group of words, summed over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = classed.value
        cell = np.zeros(len(names) * GROUPS, np.int64)
        for b in batches:
            some = texts(b.column(0))
            for i in range(0, len(some), 500):
                h, ends = _joined(some[i : i + 500])
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                hit = names[at] == h
                g = ((_before(h, ends, 1)[hit] * _M) >> np.uint64(60)).astype(np.int64)
                cell += np.bincount(at[hit] * GROUPS + g, minlength=len(cell))
        hit = np.flatnonzero(cell)
        for i in range(0, len(hit), HELD):
            k = hit[i : i + HELD]
            yield pa.RecordBatch.from_pydict({"h": pa.array(names[k // GROUPS].view(np.int64)), "g": pa.array((k % GROUPS).astype(np.int32)), "n": pa.array(cell[k])})

    return run


def _clusters(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k-means over rows of log-ratios, weighted by counts; starts at rows spread by rank."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(20):
        own = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        total = np.bincount(own, weight, k)
        for j in range(x.shape[1]):
            s = np.bincount(own, weight * x[:, j], k)
            centres[:, j] = np.where(total > 0, s / np.maximum(total, 1e-9), centres[:, j])
    return own


class Model:
    """Counts of the most frequent tokens, classes and weights; all of bounded size."""

    def __init__(self, head: np.ndarray, count: np.ndarray, classed: np.ndarray, own: np.ndarray, n: int, v: int):
        """head: sorted hashes; classed: those with a class, own: their classes; n, v: all training tokens and different ones."""
        self.head, self.count, self.n, self.v = head, count, n, v
        self.begin = np.searchsorted(head, np.arange(HEAD, dtype=np.uint64) << _FIRST)
        k = int(own.max()) + 1 if len(own) else 0
        self.rest = k
        self.cls = np.full(len(head) + 1, k, np.int32)
        at = np.searchsorted(head, classed)
        self.cls[at] = own
        c = np.append(count, 0).astype(float)
        mass = np.bincount(own, count[at], k) if len(own) else np.zeros(0)
        n_rest, v_rest = n - mass.sum(), v - len(classed)
        self.below = float(n_rest + v_rest + 1)  # the last class: add-one, with one place for all unseen tokens
        inside = np.log((c + 1) / self.below)
        self.member = np.zeros(len(head) + 1, np.int32)
        self.inner_bias = np.full((k, MEMBERS), -30.0, np.float32)
        for j in range(k):  # the most frequent tokens are members of their own, the others share some by frequency
            mine = at[own == j]
            mine = mine[np.lexsort((mine, -count[mine]))]
            place = np.arange(len(mine))
            more = count[mine[SINGLE:]].astype(float)
            if len(more):
                place[SINGLE:] = SINGLE + ((np.cumsum(more) - more) / more.sum() * (MEMBERS - SINGLE)).astype(int)
            self.member[mine] = place
            weight = np.bincount(place, count[mine], MEMBERS)
            some = weight > 0
            self.inner_bias[j, some] = np.log(weight[some] / mass[j])
            inside[mine] = np.log(count[mine] / weight[place])
        self.inside = inside.astype(np.float32)
        prior = np.append(mass, self.below)
        self.bias = np.log(prior / prior.sum()).astype(np.float32)
        self.weights = np.zeros((KINDS * ROWS, k + 1), np.float32)
        self.inner = np.zeros((KINDS * INNER, MEMBERS), np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in head; len(head) where a token is not there. A token's first bits tell where its search begins; hashes are
        spread evenly, so that few steps follow."""
        if not len(self.head):
            return np.zeros(len(h), np.int64)
        at, last = self.begin[(h >> _FIRST).astype(np.intp)], len(self.head) - 1
        go = np.flatnonzero(self.head[np.minimum(at, last)] < h)
        while len(go):
            at[go] += 1
            go = go[(at[go] <= last) & (self.head[np.minimum(at[go], last)] < h[go])]
        return np.where(self.head[np.minimum(at, last)] == h, at, last + 1)

    def logits(self, f: list[np.ndarray]) -> np.ndarray:
        x = _summed(self.weights, f, ROWS)
        x += self.bias
        return x

    def inner_logits(self, f: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        x = _summed(self.inner, f, INNER)
        x += np.take(self.inner_bias, cls, 0)
        return x

    def class_scores(self, c: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's class."""
        out, f = np.empty(len(cls)), features(c)
        for i in range(0, len(cls), STEP):
            out[i : i + STEP] = _logs(self.logits([g[i : i + STEP] for g in f]), cls[i : i + STEP])
        return out

    def member_scores(self, c: list[np.ndarray], cls: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's member in its class; 0 in the last class."""
        out, on = np.zeros(len(cls)), np.flatnonzero(cls < self.rest)
        for i in range(0, len(on), STEP):
            at = on[i : i + STEP]
            out[at] = _logs(self.inner_logits(inner_features([x[at] for x in c], cls[at]), cls[at]), member[at])
        return out

    def train(self, c: list[np.ndarray], cls: np.ndarray, member: np.ndarray, squares: tuple[np.ndarray, np.ndarray]) -> None:
        """A step for each STEP tokens, of the classes' weights and of the members'."""
        f = features(c)
        for i in range(0, len(cls), STEP):
            g = [x[i : i + STEP] for x in f]
            _updated(self.weights, squares[0], g, ROWS, _errors(self.logits(g), cls[i : i + STEP]))
        on = np.flatnonzero(cls < self.rest)
        for i in range(0, len(on), STEP):
            at = on[i : i + STEP]
            g = inner_features([x[at] for x in c], cls[at])
            _updated(self.inner, squares[1], g, INNER, _errors(self.inner_logits(g, cls[at]), member[at]))


def _learned(model: Model, train: DataFrame, learners: int) -> np.ndarray:
    """The mean of the learners' changes of all weights; each learner takes its steps over its own documents, which are some
    partitions of train."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = model.weights.size + model.inner.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shared.value
        start, squares, seen = (m.weights, m.inner), (np.zeros_like(m.weights), np.zeros_like(m.inner)), 0
        m.weights, m.inner = (w.copy() for w in start)
        for b in batches:
            some = texts(b.column(0))
            for i in range(0, len(some), 500):
                h, ends = _joined(some[i : i + 500])
                at = m.find(h)
                m.train(contexts(h, ends), m.cls[at], m.member[at], squares)
                seen += len(h)
        change = np.concatenate([(m.weights - start[0]).ravel(), (m.inner - start[1]).ravel()]) * seen
        m.weights, m.inner = start
        part = TaskContext.get().partitionId()
        if seen:
            for at in range(0, size, SENT):
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([seen], pa.int64()), "w": pa.array([change[at : at + SENT].astype(np.float32).tobytes()], pa.binary())})

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = 0.0, 0
        for b in batches:
            for x, y in zip(b.column("w").to_pylist(), b.column("n").to_pylist(), strict=True):
                w, n = w + np.frombuffer(x, np.float32).astype(np.float64), n + y
        yield pa.RecordBatch.from_pydict({"at": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    kind = "at int, part int, n long, w binary"
    change = train.coalesce(learners).mapInArrow(run, kind)
    for few in (math.isqrt(learners) + 1, 1):  # a tree of sums, so that no task adds up the changes of all learners
        change = change.groupBy("at", (F.col("part") % few).alias("few")).applyInArrow(_iterated(total), kind)
    rows = change.collect()  # of the size of the weights
    out = np.zeros(size)
    for r in rows:
        w = np.frombuffer(r.w, np.float32)
        out[r["at"] : r["at"] + len(w)] = w / r.n
    shared.destroy()
    del change
    release(spark)  # the shuffles of the changes
    return out.astype(np.float32)


def _iterated(f):
    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(f(key, table.to_batches()))

    return whole


def fit(train: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the counts (h, n) of all training tokens, from every row of train. Null and empty texts are one token, the
    end; rows that repeat count each. An empty table gives a model that knows no token."""
    prepare(train.sparkSession)
    text = train.select(F.col(quoted(text_col)).cast("string").alias("text"))
    counts = cut(text.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    bucket = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect(), reverse=True)
    n, v = sum(s.n for s in sizes), sum(s.k for s in sizes)

    def most(limit: int) -> int:
        got, least = 0, 10**9
        for s in sizes:
            got += s.k
            if got > limit:
                break
            least = s.b
        return least

    rows = counts.where(bucket >= most(HEAD)).toPandas()  # at most HEAD
    order = np.argsort(rows.h.to_numpy(np.int64).view(np.uint64))
    head, count = rows.h.to_numpy(np.int64).view(np.uint64)[order], rows.n.to_numpy(np.int64)[order]
    often = counts.where(bucket >= most(CLASSED)).select("h").toPandas()  # at most CLASSED, with GROUPS rows each
    names = np.sort(often.h.to_numpy(np.int64).view(np.uint64))
    table = np.zeros((len(names), GROUPS))
    if len(names):
        shared = train.sparkSession.sparkContext.broadcast(names)
        near = text.mapInArrow(_contexts(shared), "h long, g int, n long").groupBy("h", "g").agg(F.sum("n").alias("n")).toPandas()
        table[np.searchsorted(names, near.h.to_numpy(np.int64).view(np.uint64)), near.g.to_numpy(int)] = near.n.to_numpy(float)
        share = (table.sum(axis=0) + 1) / (table.sum() + GROUPS)
        ratio = np.log((table + 8 * share) / ((table.sum(axis=1) + 8)[:, None] * share))
        rank = np.argsort(-table.sum(axis=1), kind="stable")
        own = np.empty(len(names), np.int64)
        own[rank] = _clusters(ratio[rank], table.sum(axis=1)[rank], CLASSES)
        own = np.unique(own, return_inverse=True)[1]
    else:
        own = np.zeros(0, np.int64)
    model = Model(head, count, names, own, int(n), int(v))
    slice_ = F.pmod(F.xxhash64("text", F.lit("round")), F.lit(16))
    for low, high in ROUNDS if n else ():
        change, k = _learned(model, text.where((slice_ >= low) & (slice_ < high)), int(n * (high - low) / 16 // LEARNER) + 1), model.weights.size
        model.weights = model.weights + change[:k].reshape(model.weights.shape)
        model.inner = model.inner + change[k:].reshape(model.inner.shape)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row: base_score is the add-one unigram's log10 probability,
    score the model's. Null and empty texts have one token, the end. Rows that repeat an id are scored each."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    pair = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    id_kind = pair.schema["id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> dict:
        m = shared.value
        h, ends = _joined(texts(b.column(1)))
        starts = np.r_[0, ends[:-1]]
        at = m.find(h)
        cls = m.cls[at]
        c = contexts(h, ends)
        s = (m.class_scores(c, cls) + m.member_scores(c, cls, m.member[at]) + m.inside[at]) / math.log(10)
        tail = at == len(m.head)  # their count is not known here: inside has them as unseen, the join adds log10(c + 1)
        c = np.append(m.count, 0)[at]
        base = np.log10(c + 1.0)
        total = lambda x: np.add.reduceat(x, starts)
        far, of = h[tail], np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[tail]
        order = np.lexsort((far, of))
        far, of = far[order], of[order]
        first = np.flatnonzero(np.r_[True, (far[1:] != far[:-1]) | (of[1:] != of[:-1])]) if len(far) else np.zeros(0, int)
        times = np.diff(np.r_[first, len(far)]).astype(np.int32)
        offsets = pa.array(np.searchsorted(of[first], np.arange(len(ends) + 1)).astype(np.int32))
        return {
            "id": b.column(0), "n_tokens": pa.array(np.diff(np.r_[0, ends]).astype(np.int64)), "known": pa.array(total((c > 0).astype(np.int64))), "base": pa.array(total(base)), "part": pa.array(total(s)),
            "h": pa.ListArray.from_arrays(offsets, pa.array(far[first].view(np.int64))), "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
        }

    got = arrow_map(pair, run, f"id {id_kind}, n_tokens long, known long, base double, part double, h array<long>, times array<int>")
    got = cut(got.withColumn("row", F.monotonically_increasing_id()))
    far = got.select("row", F.explode(F.arrays_zip("h", "times")).alias("t")).select("row", "t.h", "t.times").join(counts, "h")
    more = far.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    out = got.select("id", "row", "n_tokens", "known", "base", "part").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select("id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + extra - F.col("n_tokens") * math.log10(model.n + model.v + 1)).alias("base_score"), (F.col("part") + extra).alias("score"))


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, held_out (false for a null id), n_tokens, n_known, train_tokens, base_score,
    score. Cases are those of fit and score."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    held: Column = F.coalesce(common.fold(F.col("doc_id"), 7) == 2, F.lit(False))
    model, counts = fit(docs.where(~held))
    out = score(docs, model, counts)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(common.fold(F.col("id"), 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
