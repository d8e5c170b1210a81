"""Line dedup with a sharded minimal perfect hash.

Every distinct line (its key: stripped of ASCII white space, A-Z lower-cased) is hashed to 128 bits. Counts and
the largest document of a line are partial sums. Lines found in enough documents go to shards; each shard gets
a minimal perfect hash (hash, displace) over compact arrays of fingerprints, counts and largest documents.
Lines of documents probe these arrays: no join on lines takes place. Lines so frequent that they could fill a
task are at most HOT by arithmetic (each holds more than one in HOT of all lines), so their arrays are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SPACE, add_columns, arrow_map, as_task, cut, longs, partitions, prepare, quoted, texts, widened

#: A line is hot if it holds more than one in so many of all lines; so there are fewer hot lines than this.
HOT = 2000
_BUCKET = 4  # keys for each displacement, on average
_STRIP = SPACE.encode()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys(text: bytes, min_chars: int) -> list[tuple[bytes, bytes]]:
    """(line, key) for each line; the key is empty where it is shorter than min_chars code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP).lower()
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            key = b""
        out.append((line, key))
    return out


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _slots(h: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    x = (h ^ (np.asarray(seed, np.uint64) * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _names(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    """64-bit names of 128-bit keys. Different keys may share a name under one salt, but not under each."""
    return (h1.view(np.uint64) + np.uint64(salt) * _MIX) ^ (h2.view(np.uint64) * np.uint64(2 * salt + 1))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a seed for each bucket sends its keys to slots of their own."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        n = len(h)
        nb = max(1, n // _BUCKET)
        bucket = _slots(h, 0, nb)
        seeds, taken = np.zeros(nb, np.uint32), np.zeros(n, bool)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(nb + 1))
        sizes = np.diff(ends)
        for b in np.argsort(-sizes, kind="stable"):
            mine = h[order[ends[b] : ends[b + 1]]]
            if not len(mine):
                break
            seed = 0
            while True:  # for the last buckets, many seeds are tried at once
                tried = np.arange(seed + 1, seed + 65, dtype=np.uint64)
                at = _slots(mine[None, :], tried[:, None], n)
                good = ~taken[at].any(axis=1)
                if len(mine) > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    i = int(good.argmax())
                    seeds[b], _ = tried[i], taken.__setitem__(at[i], True)
                    break
                seed += 64
        return cls(seeds, n)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return _slots(h, self.seeds[_slots(h, 0, len(self.seeds))], self.n)


class Arrays:
    """Fingerprints, counts and largest documents of distinct 128-bit keys, in the order of a perfect hash."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.salt = 0
        while len(np.unique(names := _names(h1, h2, self.salt))) < len(h1):  # two keys share a name: it takes another salt
            self.salt += 1
        self.hash = PerfectHash.build(names)
        at = self.hash.slot(names)
        self.print, self.count, self.last = (np.empty(len(h1), x.dtype) for x in (h2, count, last))
        self.print[at], self.count[at], self.last[at] = h1 ^ (h2 << 1), count, last

    def pack(self) -> bytes:
        return b"".join([np.array([self.hash.n, len(self.hash.seeds), self.salt], np.int64).tobytes(), self.print.tobytes(), self.count.tobytes(), self.last.tobytes(), self.hash.seeds.tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> Arrays:
        n, nb, salt = np.frombuffer(data, np.int64, 3)
        self = cls.__new__(cls)
        self.print, self.count, self.last = (np.frombuffer(data, np.int64, n, 24 + 8 * n * k) for k in range(3))
        self.hash, self.salt = PerfectHash(np.frombuffer(data, np.uint32, nb, 24 + 24 * n), int(n)), int(salt)
        return self

    def dropped(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True where a line is in the arrays and the document is not its largest."""
        at = self.hash.slot(_names(h1, h2, self.salt))
        return (self.print[at] == h1 ^ (h2 << 1)) & (self.last[at] != doc)


_NONE = np.iinfo(np.int64).min  # stands for a null id: smaller than any other


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(_NONE)).to_numpy(zero_copy_only=False)


def _lines(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, document) of each different keyed line of each row."""
    found, docs = [], []
    for doc, text in zip(_ids(batch.column(0)).tolist(), texts(batch.column(1)), strict=True):
        mine = {digest(k) for _, k in keys(text, min_chars) if k}
        found.extend(mine)
        docs.extend([doc] * len(mine))
    h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return h[:, 0].copy(), h[:, 1].copy(), np.array(docs, np.int64)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    r"""docs with text_col rebuilt from the lines that stay, and n_lines, n_dropped (long).

    Texts are split at \n. A key of at least min_chars code points that at least min_docs rows hold loses all its
    lines but those in the largest id that holds it. Null and empty texts are one empty line (the text becomes
    empty). Every row is a document: rows that repeat an id count each, and are all kept as the largest. A null id
    is smaller than any other. Columns of docs named n_lines or n_dropped are replaced; all others pass through,
    whatever their names.
    No row is lost: a document may become empty."""
    spark = prepare(docs.sparkSession)
    own, cuts = common.fresh(docs, "__doc"), common.fresh(docs, "__gone")
    pair = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).cast("string").alias("text"))
    lines = arrow_map(pair, lambda b: dict(zip(("h1", "h2", "doc"), map(pa.array, _lines(b, min_chars)), strict=True)), "h1 long, h2 long, doc long")
    stats = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs))
    total = stats.agg(F.sum("n"), F.count(F.lit(1))).first()
    least = max(min_docs, (total[0] or 0) // HOT + 1)
    rows = stats.where(F.col("n") >= least).collect()  # fewer than HOT: their counts add up to the total at most
    hot_of = {(r.h1, r.h2): r.last for r in rows}
    hot = Arrays(*(np.array([r[i] for r in rows], np.int64) for i in range(4))).pack() if rows else b""
    shards = max(partitions(spark), -(-(total[1] or 0) // 50_000))  # a task holds the arrays of one at a time

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard: first its repeated lines, which become arrays, then the lines that probe them."""
        shard, held, arrays = None, [], None
        for b in batches:
            h1, h2, doc, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            where = b.column(0).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(where[1:] != where[:-1]) + 1, len(where)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if where[i] != shard:
                    shard, held, arrays = where[i], [], None
                k = i + int((n[i:j] > 0).sum())
                if k > i:
                    held.append((h1[i:k], h2[i:k], n[i:k], doc[i:k]))
                if k == j or not held and arrays is None:
                    continue
                if arrays is None:
                    arrays, held = Arrays(*map(np.concatenate, zip(*held, strict=True))), []
                if (gone := arrays.dropped(h1[k:j], h2[k:j], doc[k:j])).any():
                    yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[k:j][gone]), "h1": pa.array(h1[k:j][gone])})

    spread = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    arrays = stats.where(F.col("n") < least).select(spread, "h1", "h2", F.col("last").alias("doc"), "n")

    def probing(b: pa.RecordBatch) -> dict:
        h1, h2, doc = _lines(b, min_chars)
        if hot:
            gone = np.isin(h1, hot_first)
            h1, h2, doc = h1[~gone], h2[~gone], doc[~gone]
        return {"h1": pa.array(h1), "h2": pa.array(h2), "doc": pa.array(doc)}

    hot_first = np.array([k[0] for k in hot_of], np.int64)
    probes = arrow_map(pair, probing, "h1 long, h2 long, doc long").select(spread, "h1", "h2", "doc", F.lit(0).cast("long").alias("n"))
    dealt = arrays.unionAll(probes).repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("n") == 0)
    gone = dealt.mapInArrow(as_task(build), "doc long, h1 long").groupBy(F.col("doc").alias(own)).agg(F.collect_set("h1").alias(cuts))  # at most the lines of a document
    kept = docs.withColumn(own, F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(int(_NONE)))).join(gone, own, "left")

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        column = lambda n: batch.column(names.index(n))
        at, out, n_lines, n_dropped = Arrays.unpack(hot) if hot else None, [], [], []
        for doc, text, lost in zip(_ids(column(own)).tolist(), texts(column(text_col).cast(pa.string())), column(cuts).to_pylist(), strict=True):
            lines, lost = keys(text, min_chars), set(lost or ())
            if at is not None or lost:
                h = np.frombuffer(b"".join(digest(k) for _, k in lines), np.int64).reshape(-1, 2)
                gone = np.array([bool(k) for _, k in lines])
                hit = np.isin(h[:, 0], list(lost)) if lost else np.zeros(len(lines), bool)
                if at is not None:
                    hit |= at.dropped(h[:, 0].copy(), h[:, 1].copy(), np.full(len(lines), doc, np.int64))
                gone &= hit
                stay = [line for (line, _), g in zip(lines, gone, strict=True) if not g]
            else:
                stay = [line for line, _ in lines]
            out.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        keep = [n for n in names if n not in (own, cuts)]
        return add_columns(batch.select(keep), **{text_col: pa.array(out, pa.binary()).cast(pa.string()), "n_lines": longs(n_lines), "n_dropped": longs(n_dropped)})

    return arrow_map(kept, rebuild, widened(docs, **{text_col: "string", "n_lines": "bigint", "n_dropped": "bigint"}))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_lines, n_dropped, kept_sha256. Cases are those of dedup_lines."""
    d = dedup_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND r.last <> k.doc_id) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
