"""Substring dedup with a compressed FM-index per shard.

Shards are cut by content, not by document, so that each passage is searched in one index only: a window of WINDOW
words is named by its minimizer (the smallest hash of GRAM words in it), and a run of windows with one minimizer is
a segment. Equal windows have equal minimizers, so they meet in one shard. Segments whose minimizer occurs once
cannot hold a repeated window and stop there. Shards index their segments; backward search over the wavelet matrix
streams every segment through the index from right to left and gives for each window the interval of all windows
like it (matching statistics cut at WINDOW: after each step the interval is widened to the class of WINDOW words).
A window that does not hold the earliest place of its interval is covered.

Copies meet early: whole documents by their words, minimizers and segments within what a task holds. Minimizers that
could fill a task (at most HOT of them) send single windows, dealt out by their first and last words too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import add_columns, arrow_map, cut, longs, partitions, prepare, quoted, release, texts, widened, word_hashes, written
from .fm_index import FMIndex
from .line_dedup import _NONE, _ids

WINDOW, GRAM, HOT, SHARD_WORDS, HELD = 20, 6, 2000, 200_000, 1_500_000
_M, _C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def segments(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, text, first window, windows) of each segment of some texts."""
    n = np.array([len(w) for w in words])
    ends = np.cumsum(n)
    h = word_hashes([x for w in words for x in w])
    if len(h) < WINDOW:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    g, c = h[: len(h) - GRAM + 1].copy(), _C
    for j in range(1, GRAM):
        g += h[j : len(h) - GRAM + 1 + j] * c
        c = np.uint64(int(c) * int(_C) & (1 << 64) - 1)
    g ^= g >> np.uint64(31)
    g *= _M
    g ^= g >> np.uint64(33)
    width, at, have = WINDOW - GRAM + 1, np.arange(len(g)), 1
    while have < width:  # the leftmost smallest of ever more places
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        have += step
    start = np.arange(len(at))
    of = np.searchsorted(ends, start, side="right")
    inside = start + WINDOW <= ends[of]
    at, start, of = at[inside], start[inside], of[inside]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.zeros(0, int)
    return g[at[first]], of[first], start[first] - (ends - n)[of[first]], np.diff(np.r_[first, len(at)])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, g, doc, first, windows, sure): segments of documents; of those whose minimizer repeats in what is held, all
    are sure, and all but one are dealt out at random."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def sent() -> pa.RecordBatch:
        g, doc, first, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(g, kind="stable")
        g, doc, first, n = g[order], doc[order], first[order], n[order]
        again = np.zeros(len(g), bool)
        again[1:] = g[1:] == g[:-1]
        sure = again.copy()
        sure[:-1] |= again[1:]
        spread = g ^ ((doc.view(np.uint64) * _M + first.astype(np.uint64)) * _C)
        k = np.where(again, spread, g).view(np.int64)
        return pa.RecordBatch.from_pydict({"k": pa.array(k), "g": pa.array(g.view(np.int64)), "doc": pa.array(doc), "first": pa.array(first.astype(np.int32)), "windows": pa.array(n.astype(np.int32)), "sure": pa.array(sure)})

    for b in batches:
        ids, some = _ids(b.column(0)), texts(b.column(1))
        for i in range(0, len(some), 400):
            g, of, first, n = segments([t.split() for t in some[i : i + 400]])
            held.append((g, ids[i : i + 400][of], first, n))
            size += len(g)
            if size > HELD:
                yield sent()
                size = 0
    if held:
        yield sent()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by k, those that are sure or share it with another one."""
    kept: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if kept is not None:
            b = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
        k = b.column(0).to_numpy()
        same = np.r_[k[1:] == k[:-1], False]
        sure = b.column(5).to_numpy(zero_copy_only=False) | same | np.r_[False, same[:-1]]
        if b.num_rows > 1:
            yield b.slice(0, b.num_rows - 1).filter(pa.array(sure[:-1])).select(["g", "doc", "first", "windows"])
        last = b.slice(b.num_rows - 1)
        kept = last.set_column(5, "sure", pa.array(sure[-1:]))
    if kept is not None and kept.column(5)[0].as_py():
        yield kept.select(["g", "doc", "first", "windows"])


_SENT = "shard int, doc long, first int, windows int, words binary"


def _dealt(shards: int, hot: set[int]):
    """Segments with their words, for the shards. Of equal ones within what is held only the earliest goes to a shard;
    the others are covered, which a row without words says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        covered: list[tuple[int, int, int, int, None]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            rows = [(s, d, f, n, w) for (s, w), (d, f, n) in held.items()] + covered
            held.clear()
            covered.clear()
            return pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate((("shard", pa.int32()), ("doc", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("words", pa.binary())))})

        for b in batches:
            for doc, text, found in zip(_ids(b.column(0)).tolist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.split()
                for x in found:
                    g, first, n = x["g"], x["first"], x["windows"]
                    parts = [(first + i, 1) for i in range(n)] if g in hot else [(first, n)]
                    for f, m in parts:
                        mine = words[f : f + m + WINDOW - 1]
                        key = b"%d" % g if g not in hot else b"%d %s %s" % (g, mine[0], mine[-1])
                        s, w = xxhash.xxh3_64_intdigest(key) % shards, b" ".join(mine)
                        was = held.get((s, w))
                        if was is None:
                            held[s, w] = (doc, f, m)
                            size += len(w) + 120
                        elif was[:2] != (doc, f):
                            early, late = sorted([was, (doc, f, m)])
                            held[s, w] = early
                            covered.append((xxhash.xxh3_64_intdigest(w, late[0] & 0xFFFF) % shards, *late, None))
                            size += 120
                if size > 48 << 20:
                    yield sent()
                    size = 0
        if held or covered:
            yield sent()

    return run


def _covered_in(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(doc, start, end) of words that covered windows of a shard's segments hold. rows: doc, first, windows, words."""
    earliest: dict[bytes, tuple[int, int]] = {}
    for d, f, _, w in rows:
        earliest[w] = min(earliest.get(w, (d, f)), (d, f))
    for d, f, n, w in rows:  # what equals an earlier segment is covered whole and is not indexed
        if earliest[w] != (d, f):
            yield d, f, f + n + WINDOW - 1
    some = {(r[0], r[1]): r for r in rows if earliest[r[3]] == (r[0], r[1])}
    split = [r[3].split(b" ") for r in some.values()]
    flat = [w for s in split for w in [*s, b""]]  # b"" is no word: the border
    names = {b"": 0}
    symbols = np.fromiter((names.setdefault(w, len(names)) for w in flat), np.int64, len(flat))
    length = np.array([len(s) for s in split])
    begin = np.r_[0, np.cumsum(length + 1)[:-1]]
    doc, first, n = (np.array([r[i] for r in some.values()], np.int64) for i in range(3))
    # windows are numbered in the order of documents and places
    of = np.repeat(np.arange(len(split)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    d, s = doc[of], first[of] + nth
    order = np.lexsort((s, d))
    mine = np.empty(len(of), np.int64)
    mine[order] = np.arange(len(of))
    place = np.full(len(symbols), np.iinfo(np.int64).max)
    place[begin[of] + nth] = mine
    index = FMIndex(symbols, len(names), WINDOW, place)
    # backward search of all segments side by side, from their right ends
    low, high = np.zeros(len(split), np.int64), np.full(len(split), len(symbols), np.int64)
    gone = np.zeros(len(of), bool)
    base = np.cumsum(n) - n
    for step in range(1, int(length.max()) + 1):
        on = np.flatnonzero(length >= step)
        low[on], high[on] = index.extend(symbols[begin[on] + length[on] - step], low[on], high[on])
        if step >= WINDOW:
            cls = index.of[low[on]]
            low[on], high[on] = index.start[cls], index.end[cls]
            at = base[on] + length[on] - step
            gone[at] = mine[at] > index.least[cls]
    run = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (of[1:] != of[:-1])])
    stop = np.flatnonzero(gone & np.r_[~gone[1:] | (of[1:] != of[:-1]), True])
    yield from zip(d[run].tolist(), s[run].tolist(), (s[stop] + WINDOW).tolist(), strict=True)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; each shard is indexed and searched when it is complete."""
    shard, rows = None, []

    def out(some: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if some:
            yield pa.RecordBatch.from_pydict({"doc": pa.array([x[0] for x in some], pa.int64()), "start": pa.array([x[1] for x in some], pa.int32()), "end": pa.array([x[2] for x in some], pa.int32())})

    for b in batches:
        known = []
        for s, doc, first, n, words in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
            if words is None:
                known.append((doc, first, first + n + WINDOW - 1))
                continue
            if s != shard:
                if rows:
                    yield from out(list(_covered_in(rows)))
                shard, rows = s, []
            rows.append((doc, first, n, words))
        yield from out(known)
    if rows:
        yield from out(list(_covered_in(rows)))


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _numbered(seen: DataFrame) -> DataFrame:
    """(doc, sha, key): a number for each document, in the order of ids, then of words. seen: doc, sha."""
    return cut(seen.select("doc", "sha").distinct().orderBy("doc", "sha").withColumn("key", F.monotonically_increasing_id()))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col made of the words that stay, joined by one space, and n_words, n_removed (long).

    Words end at ASCII white space. A word goes if a window of WINDOW words of its document that holds it also
    starts earlier: in a smaller id, or earlier in the same document. Windows are judged on the input. Null, empty and
    short texts lose nothing. A null id is smaller than any other. Rows that repeat an id (or have none) are documents of
    their own, in the order of a hash of their words; rows with equal words too are one document that occurs twice: they
    do not cover each other and keep the same words. Columns of docs named n_words or n_removed are replaced; all others
    pass through, whatever their names; no row is lost."""
    spark = prepare(docs.sparkSession)
    own, cuts = common.fresh(docs, "__doc"), common.fresh(docs, "__gone")
    base = docs.withColumn(own, F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(int(_NONE))))
    text = F.col(quoted(text_col)).cast("string").alias("text")

    def whole(b: pa.RecordBatch) -> dict:
        words = [t.split() for t in texts(b.column(1))]
        return {"doc": b.column(0), "n": longs([len(w) for w in words]), "sha": pa.array([_sha(w) for w in words], pa.binary())}

    seen = cut(arrow_map(base.select(F.col(own).alias("doc"), text), whole, "doc long, n long, sha binary"))
    if not seen.groupBy("doc").count().where("count > 1").isEmpty():  # ids do not tell documents apart: numbers do
        numbered, sha = _numbered(seen), common.fresh(base, "__sha")

        def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
            column = b.column(b.schema.names.index(text_col)).cast(pa.string())
            return add_columns(b, **{sha: pa.array([_sha(t.split()) for t in texts(column)], pa.binary())})

        named = numbered.select(F.col("doc").alias(own), F.col("sha").alias(sha), F.col("key").alias(cuts))
        base = arrow_map(base, hashed, widened(base, **{sha: "binary"})).join(named, [own, sha]).drop(own, sha).withColumnRenamed(cuts, own)
        seen = cut(seen.join(numbered, ["doc", "sha"]).select(F.col("key").alias("doc"), "n", "sha"))
    pair = base.select(F.col(own).alias("doc"), text)
    copies = cut(seen.where(f"n >= {WINDOW}").groupBy("sha").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    most = (copies.agg(F.sum("k")).first()[0] or 0) // HOT + 1000
    often = F.broadcast(copies.where(F.col("k") > most))  # fewer than HOT: their counts add up to the sum at most
    copies = seen.join(often, "sha").unionByName(seen.join(often, "sha", "left_anti").join(copies.where(F.col("k") <= most), "sha"))
    copies = cut(copies.where("doc > least").select("doc", "n").distinct())
    found = pair.mapInArrow(_found, "k long, g long, doc long, first int, windows int, sure boolean").repartition(partitions(spark), "k").sortWithinPartitions("k")
    found = found.mapInArrow(_again, "g long, doc long, first int, windows int").join(copies.select("doc"), "doc", "left_anti")
    found = cut(found.select("g", "doc", "first", "windows"))
    release(spark)  # the shuffle of all segments
    total = found.count()
    hot = {r.g for r in found.groupBy("g").count().where(F.col("count") >= max(1000, total // HOT + 1)).select("g").collect()}  # at most HOT
    mine = found.groupBy("doc").agg(F.collect_list(F.struct("g", "first", "windows")).alias("found"))  # at most a document's windows
    flagged = written(pair.join(mine, "doc"), "flagged")
    release(spark)  # the shuffle of texts
    shards = max(partitions(spark), total * (WINDOW + 10) // SHARD_WORDS + 1)  # a task holds one at a time
    dealt = flagged.select("doc", "text", "found").mapInArrow(_dealt(shards, hot), _SENT).repartition(partitions(spark), "shard").sortWithinPartitions("shard")
    gone = dealt.mapInArrow(_searched, "doc long, start int, end int").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    gone = gone.unionAll(copies.select("doc", F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))).alias(cuts)))
    kept = base.join(gone.withColumnRenamed("doc", own), own, "left")

    def rebuild(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.schema.names
        out, n, lost = [], [], []
        for text, spans in zip(texts(b.column(names.index(text_col)).cast(pa.string())), b.column(names.index(cuts)).to_pylist(), strict=True):
            words = text.split()
            n.append(len(words))
            if spans:
                off = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    off[min(s["start"], len(words))] += 1
                    off[min(s["end"], len(words))] -= 1
                stay = np.cumsum(off)[:-1] <= 0
                words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
            out.append(b" ".join(words))
            lost.append(n[-1] - len(words))
        keep = b.select([x for x in names if x not in (own, cuts)])
        return add_columns(keep, **{text_col: pa.array(out, pa.binary()).cast(pa.string()), "n_words": longs(n), "n_removed": longs(lost)})

    return arrow_map(kept, rebuild, widened(docs, **{text_col: "string", "n_words": "bigint", "n_removed": "bigint"}))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_removed, kept_sha256. Cases are those of dedup_substrings."""
    d = dedup_substrings(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
