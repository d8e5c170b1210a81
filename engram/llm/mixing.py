"""Mixing sources to target weights, with DataFrame functions only.

Soft membership: one-against-rest logistic models over shape features of a text and the mean log-ratio of its words give
each document a posterior for every domain of the labelled table. The words' log-ratios come from one half of the labelled
sample, the models from the other; all sums are aggregates. Document rates are the nonnegative least-squares fit of the
expected domain token totals to the targets, by projected gradient: rows at zero whose gradient would hold them there stay,
the others take a step that is scaled by their own Gram matrix, along which the length is searched. The fit ends where the
totals meet the targets or the Karush-Kuhn-Tucker conditions hold. A round sends a few sums to the driver and a step vector
back; rates themselves are never stored, they are a fold over the steps.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, once, prepare, quoted

#: Bounds: labelled rows of the sample (expected), buckets of words, rounds of the classifier and of the fit; the residual
#: (share of all tokens) and the size of the projected gradient to stop at; with rates bounded above, the residual from which
#: on a round has to take more than some share of what is left.
SAMPLE_ROWS, BUCKETS, NEWTON, STEPS, CLOSE, FLAT, NEAR, GAIN = 20_000, 1024, 12, 30, 1e-9, 1e-6, 2e-2, 0.9
SHAPES = ("one", "chars", "symbols", "varied", "width")
_SPACE = r"[ \t\n\x0B\f\r]+"


def _prefix(docs: DataFrame) -> str:
    """The beginning of names that docs does not have."""
    p = "__m"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    return p


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), _SPACE, " ")), " ")


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def shapes(docs: DataFrame, text_col: str, p: str, ratios: list[Column]) -> DataFrame:
    """docs with p + tokens (words, null and blank: 0) and, p before each name, the features of a text: SHAPES, and for each
    array of log-ratios by bucket the mean over the text's different words."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    d = docs.withColumns({p + "w": _words(text)} | {f"{p}r{k}": r for k, r in enumerate(ratios)}).withColumn(p + "u", F.array_distinct(p + "w"))
    n = F.when(F.element_at(p + "w", 1) == "", 0).otherwise(F.size(p + "w")).cast("long")
    chars, symbols = F.length(text), F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    mean = lambda r: F.aggregate(p + "u", F.lit(0.0), lambda x, w: x + F.get(r, _bucket(w))) / F.size(p + "u")
    new = {"tokens": n, "one": F.lit(1.0), "chars": F.log1p(chars.cast("double")), "symbols": symbols / (chars + 1), "varied": F.size(p + "u") / F.size(p + "w"), "width": F.least(F.lit(40.0), chars / (n + 1))}
    new |= {f"ratio{k}": F.when(n > 0, mean(F.col(f"{p}r{k}"))).otherwise(0.0) for k in range(len(ratios))}
    return d.withColumns({p + k: v for k, v in new.items()}).drop(p + "w", p + "u", *[f"{p}r{k}" for k in range(len(ratios))])


def word_ratios(sample: DataFrame, domains: list[int]) -> list[DataFrame]:
    """For each domain but the first a table of one array: by bucket, the log of how much likelier a text of the domain holds
    a word of the bucket than others do. sample: text, domain."""
    words = sample.select("domain", F.explode(F.array_distinct(F.transform(_words(F.coalesce("text", F.lit(""))), _bucket))).alias("b"))
    counts: dict[int, dict[int, int]] = {d: {} for d in domains}
    for r in words.groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most BUCKETS a domain
        counts[r.domain][r.b] = r.n
    n = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for d in domains[1:]:
        rest = sum(n.values()) - n.get(d, 0)
        by = [math.log((counts[d].get(b, 0) + 0.5) / (n.get(d, 0) + 1) / ((sum(c.get(b, 0) for c in counts.values()) - counts[d].get(b, 0) + 0.5) / (rest + 1))) for b in range(BUCKETS)]
        out.append(sample.sparkSession.createDataFrame([(by,)], "r array<double>"))
    return out


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for a handful of unknowns; a vanishing pivot gives 0."""
    n = len(b)
    m = [[*row, v] for row, v in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        if abs(m[i][i]) < 1e-14:
            continue
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] if abs(m[i][i]) >= 1e-14 else 0.0 for i in range(n)]


def _dot(columns: list[Column], weights: list[float]) -> Column:
    return reduce(lambda x, y: x + y, [c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


def fit_domains(features: DataFrame, names: list[str], domains: list[int]) -> list[list[float]]:
    """Weights over the named features (the first is the constant 1) for each domain, from rows with these and a domain. Sums
    over rows are aggregates."""
    first = features.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"a{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names]).first()
    if not first["n"]:
        return [[0.0] * len(names) for _ in domains]
    scale = [(first[f"a{c}"], first[f"s{c}"] or 1.0) if c != names[0] else (0.0, 1.0) for c in names]
    x = [(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in zip(names, scale, strict=True)]
    weights = [[0.0] * len(names) for _ in domains]
    for _ in range(NEWTON):
        sums = []
        for k, d in enumerate(domains):
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _dot(x, weights[k])))))
            error = (F.col("domain") == d).cast("double") - p
            sums += [F.sum(error * c) for c in x] + [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)]
        row, at, largest = list(features.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()), 0, 0.0
        for k in range(len(domains)):
            g, at = row[at : at + len(x)], at + len(x)
            h = [[0.0] * len(x) for _ in x]
            for i in range(len(x)):
                for j in range(i + 1):
                    h[i][j] = h[j][i] = row[at] + (0.1 if i == j else 0.0)
                    at += 1
            step = [max(-2.0, min(2.0, s)) for s in _solve(h, [gi - 0.1 * w for gi, w in zip(g, weights[k], strict=True)])]
            weights[k] = [w + s for w, s in zip(weights[k], step, strict=True)]
            largest = max(largest, *map(abs, step))
        if largest < 1e-6:
            break
    out = []
    for w in weights:  # back to raw features
        raw = [v / s for v, (_, s) in zip(w, scale, strict=True)]
        raw[0] = w[0] - sum(v * m / s for v, (m, s) in zip(w[1:], scale[1:], strict=True))
        out.append(raw)
    return out


def posteriors(names: list[str], weights: list[list[float]]) -> Column:
    """array<double> of domain posteriors: one-against-rest probabilities, made to sum to 1."""
    x = [F.col(f) for f in names]
    p = [1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _dot(x, w))))) for w in weights]
    return F.transform(F.array(*p), lambda v: v / reduce(lambda a, b: a + b, p))


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[int, float], id_col: str = "doc_id", text_col: str = "text", total: str = "same", most: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with tokens (long), posteriors (array<double>, in the order of sorted targets) and rate (double, >= 0).

    labels: id_col and domain (int); null, unknown and repeated labels: nulls and domains without a target are left
    out, of repeated ones the smallest counts. targets: share of tokens for each domain (made to sum to 1). total:
    "same" keeps the number of tokens, "least" takes the largest total that asks for no more of any domain than
    there is. most: no rate is above it. Targets that no such rates reach are met as closely as least squares can, with a
    warning where more than a hundredth of the tokens is missing. About sample_rows
    labelled rows fit the classifier; posteriors and rates cover every row. Null and blank texts have no tokens and keep
    rate 1. A domain without labels gets near-equal posteriors; without tokens at all every rate is 1. Repeated rows have a
    rate each. Columns of docs with the new names are replaced, the others stay, whatever their names."""
    prepare(docs.sparkSession)
    domains, p = sorted(targets), _prefix(docs)
    share = {d: max(0.0, float(v)) / sum(targets.values()) for d, v in targets.items()}
    key = F.col(quoted(id_col)).cast("string")
    known = labels.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col("domain").cast("int").alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain"))
    part = min(1.0, sample_rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)  # expected: sample_rows of two values
    sample = cut(docs.select(key.alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(some), "id"))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))
    tables = word_ratios(sample.where(half == 0), domains)
    names = [p + f for f in (*SHAPES, *(f"ratio{k}" for k in range(len(tables))))]
    ratios = [t.scalar() for t in tables]
    weights = fit_domains(cut(shapes(sample.where(half == 1), "text", p, ratios).select("domain", *names)), names, domains)
    d = once(shapes(docs.drop("tokens", "posteriors", "rate"), text_col, p, ratios), tokens=F.col(p + "tokens"), posteriors=posteriors(names, weights))
    d = d.select(*[quoted(c) for c in docs.columns if c not in ("tokens", "posteriors", "rate")], "tokens", "posteriors")
    table = cut(d.select("tokens", "posteriors").where("tokens > 0"))
    wanted = wanted_totals(table, [share[k] for k in domains], total)
    steps, residual = fit_rates(table, wanted, most)
    if residual > 1e-2:
        warnings.warn(f"no such rates reach the targets: {residual:.4f} of the tokens are missing", stacklevel=2)
    return once(d, rate=F.when(F.col("tokens") > 0, rate(steps, most)).otherwise(F.lit(1.0)))


Step = tuple[tuple[float, ...], tuple[float, ...]]


def _literal(v: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _along(v: Column, k: int) -> Column:
    """The inner product of a document's expected domain tokens with v."""
    return reduce(lambda x, y: x + y, [F.col("posteriors")[i] * v[i] for i in range(k)]) * F.col("tokens")


def _held(w: Column, slope: Column, most: float | None) -> Column:
    """Rows at a bound whose gradient holds them there."""
    low = (w == 0) & (slope > 0)
    return low if most is None else low | (w == most) & (slope < 0)


def _moved(w: Column, slope: Column, step: Column, most: float | None) -> Column:
    """Rows that are held stay, others take the step up to a bound at most."""
    to = F.greatest(F.lit(0.0), w - step)
    return F.when(_held(w, slope, most), w).otherwise(to if most is None else F.least(F.lit(float(most)), to))


def rate(steps: list[Step], most: float | None = None) -> Column:
    """The fold of steps (residual, step) from 1, or from most if that is less."""
    first = F.lit(1.0 if most is None else min(1.0, float(most)))
    if not steps:
        return first
    table, k = F.array(*[F.struct(_literal(r).alias("r"), _literal(s).alias("s")) for r, s in steps]), len(steps[0][0])
    return F.aggregate(table, first, lambda w, s: _moved(w, _along(s["r"], k), _along(s["s"], k), most))


def wanted_totals(table: DataFrame, shares: list[float], total: str) -> list[float]:
    """The targets in tokens. table: tokens, posteriors."""
    first = table.agg(F.sum("tokens").alias("all"), *[F.sum(F.col("posteriors")[i] * F.col("tokens")).alias(f"t{i}") for i in range(len(shares))]).first()
    size = float(first["all"] or 0)
    if size and total == "least":
        size = min(first[f"t{i}"] / s for i, s in enumerate(shares) if s > 0)
    return [s * size for s in shares]


def fit_rates(table: DataFrame, wanted: list[float], most: float | None = None) -> tuple[list[Step], float]:
    """Steps of a projected gradient for |A'w - wanted|^2, 0 <= w <= most, and the relative residual. table: tokens, posteriors.

    A round takes two or three aggregates. The first gives the Gram matrix of the rows that may move and the largest violation of the
    Karush-Kuhn-Tucker conditions, the others the totals after some steps, of which the best is taken. Present
    rates are carried in a table that is written anew each few rounds, so that plans stay short."""
    k, size, steps = len(wanted), sum(wanted), []
    if not size:
        return steps, 0.0
    a, w = [F.col("posteriors")[i] * F.col("tokens") for i in range(k)], F.col("w")
    long = F.sqrt(reduce(lambda x, y: x + y, [c * c for c in a]))
    rows = table.withColumn("w", rate([], most))
    less = lambda sums: tuple((x or 0.0) - y for x, y in zip(sums, wanted, strict=True))
    r = less(rows.agg(*[F.sum(w * c) for c in a]).first())
    for n in range(STEPS if most is None else 12):
        residual, norm = max(map(abs, r)) / size, math.sqrt(sum(x * x for x in r))
        if residual < CLOSE:
            break
        slope_of = _along(_literal(r), k)
        free = ~_held(w, slope_of, most)
        sums = [F.sum(F.when(free, a[i] * a[j]).otherwise(0.0)) for i in range(k) for j in range(i + 1)]
        *gram, slope = rows.agg(*sums, F.max(F.when(free, F.abs(slope_of) / long))).first()
        if slope is None or slope <= FLAT * norm:
            break
        full = [[gram[max(i, j) * (max(i, j) + 1) // 2 + min(i, j)] for j in range(k)] for i in range(k)]
        trace = sum(full[i][i] for i in range(k))
        newton = lambda m: _solve([[g + m * trace / k * (i == j) for j, g in enumerate(line)] for i, line in enumerate(full)], list(r))
        tried, ends = [], []
        # the whole step first; where it gains little, shorter and damped ones, and some along the gradient
        for more in ([newton(1e-9)], [*([t * x for x in newton(1e-9)] for t in (0.25, 0.0625, 0.0078125)), *map(newton, (1e-3, 0.1, 10.0)), *([t * x / trace for x in r] for t in (1, 16, 256, 4096))]):
            tried += map(tuple, more)
            got = list(rows.agg(*[F.sum(_moved(w, slope_of, _along(_literal(s), k), most) * c) for s in more for c in a]).first())
            ends += [less(got[j * k : j * k + k]) for j in range(len(more))]
            best = min(range(len(tried)), key=lambda j: sum(x * x for x in ends[j]))
            if sum(x * x for x in ends[best]) < 0.8 * norm * norm:
                break
        left = sum(x * x for x in ends[best]) / (norm * norm)
        if left >= 1 - 1e-9 or most is not None and residual < NEAR and left > GAIN:  # as close as it gets, or, with a bound
            # that the targets can't quite be met under, close enough for its pace
            break
        steps.append((r, tried[best]))
        rows = once(rows, w=_moved(w, slope_of, _along(_literal(tried[best]), k), most))
        if n % 4 == 3:
            rows = cut(rows)
        r = ends[best]
    return steps, max(map(abs, r)) / size  # of the last step, also where the rounds ran out


def resample(mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a mixed table in whole copies: floor(rate + u), u a hash of id and text in [0, 1), so that the expected number
    is the rate. tokens, posteriors and rate are dropped."""
    n = common.fresh(mixed, "__n")
    u = F.pmod(F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = once(mixed, **{n: F.floor(F.col("rate") + u).cast("int")}).where(F.col(n) > 0)
    return copies.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n, "tokens", "posteriors", "rate")


#: The mixture of the query: domains are the labels' quality.
TARGETS = {0: 0.25, 1: 0.75}


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, tokens, low_quality, high_quality (posteriors), rate. Cases are those of
    mix_sources."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("domain"))
    m = mix_sources(docs, labels, TARGETS)
    return m.select("doc_id", "tokens", F.col("posteriors")[0].alias("low_quality"), F.col("posteriors")[1].alias("high_quality"), "rate")
