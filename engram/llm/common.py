"""What the operators of this subpackage share: durable cuts of lineage, Arrow helpers, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define a word: [^\x20\x09-\x0D]+
SPACE = " \t\n\x0b\x0c\r"
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches (long texts) and makes sure that checkpoints have a folder.

    The folder comes from spark.checkpoint.dir; a temporary one is set only where that is unset and Spark runs in one
    process (tests). On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
            sc.setCheckpointDir(folder)
        elif re.match(r"local(\[[^\]]*\])?$", sc.master):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: lineage is cut in that shared folder")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Runs df and cuts its lineage by a checkpoint in the shared folder, which outlives executors."""
    prepare(df.sparkSession)
    return df.checkpoint(True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files and checkpoints that nothing refers to any more, which else waits for the driver's
    next garbage collection: iterations leave many small ones."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def once(df: DataFrame, **cols) -> DataFrame:
    """df with columns (replaced or appended) that later expressions refer to as values: a generator stands between, so
    that the optimizer does not copy their expressions into each use."""
    name = fresh(df, "__once")
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias(name)
    d = df.select(*[quoted(c) for c in df.columns if c not in cols], row)
    return d.select(*[quoted(c) for c in d.columns if c != name], *[F.col(name)[n].alias(n) for n in cols])


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the folder of checkpoints, read again."""
    spark = prepare(df.sparkSession)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(of: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo; null ids give null."""
    return F.crc32(of.cast("string").cast("binary")) % modulus


#: What operators keep in a Python worker for their next tasks, by operator.
kept: dict[str, object] = {}


def leave(operator: str = "", end: bool = True) -> None:
    """A Python worker outlives its tasks, and those of all operators share it: what others than this one keep in it goes, at
    the end of a task also the memo of words, and free memory returns to the system. A function of this module, since a nested
    one, which is sent by value, would see copies of the module's tables."""
    others = [k for k in kept if k != operator]
    for k in others:
        del kept[k]
    if others:
        gc.collect()
    if end:
        _words.clear()
    if others or end:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)


def as_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that finds and leaves its Python worker without what is not the operator's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave(operator, end=False)
        yield from run(batches)
        leave(operator)

    return task


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str, operator: str = "") -> DataFrame:
    """mapInArrow for a function of one batch; a dict of arrays becomes a batch, None is left out. operator: whose entry in
    kept stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(as_task(run, operator), schema)


def texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64))


def add_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with columns replaced or appended, in the order of `widened`."""
    cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    cols.update(new)
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def widened(df: DataFrame, without: tuple[str, ...] = (), **kinds: str) -> str:
    """Schema text of df with columns replaced or appended."""
    cols = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in without} | kinds
    return ", ".join(f"{quoted(n)} {k}" for n, k in cols.items())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, through a memo of bounded size."""
    if new := set(words).difference(_words):
        if len(_words) + len(new) > 200_000:
            _words.clear()
            new = set(words)
        _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


_BLANK = np.zeros(256, bool)
_BLANK[list(SPACE.encode())] = True
_BYTES = np.random.default_rng(97).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)  # a number for each byte
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POWERS = np.ones(1, np.uint64)


def hashed_words(texts_: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, one after the other, and how many each text has. Words end at ASCII white
    space; with lower, A-Z count as a-z. All bytes are hashed at once: a sum of a number for each byte by a power for its
    place in the word, mixed with the word's length."""
    global _POWERS
    data = np.frombuffer(b"\n".join([*texts_, b""]), np.uint8)
    word = ~_BLANK[data]
    place = np.flatnonzero(word)
    stops = np.cumsum([len(t) + 1 for t in texts_])
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(len(texts_), np.int64)
    begin = np.flatnonzero(np.r_[True, np.diff(place) > 1])
    size = np.diff(np.r_[begin, len(place)])
    if (top := int(size.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(2 * top, 0x9E3779B97F4A7C15, np.uint64)])
    at = np.arange(len(place)) - np.repeat(begin, size)
    h = np.add.reduceat((_LOWER if lower else _BYTES)[data[place]] * _POWERS[at], begin) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((32, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return h, np.bincount(np.searchsorted(stops, place[begin], side="right"), minlength=len(texts_))


HOT = 2000  # a key is hot if it holds more than one in so many of all rows, so there are fewer hot keys than this
HELD_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the components of some edges as stars; the root, the smallest node, has no row of its own."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (k, u, v), dealt by k, which is u or v, become stars (u, v, moved). A node's edge comes from the task of its own
    key; other tasks give it only where they know a smaller end. moved: this is not the edge that was there."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def stars() -> pa.RecordBatch:
        k, u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        child, root = forest(u, v)
        at = np.searchsorted(child, u)  # each u is larger than its v, so that it has a root below it
        stale = root[at] != v
        home, old, new = np.zeros(len(child), bool), np.zeros(len(child), bool), np.zeros(len(child), bool)
        home[at[k == u]], old[at], new[at[stale]] = True, True, True
        moved = ~home | new
        give = home | new | ~old
        return pa.RecordBatch.from_pydict({"u": pa.array(child[give]), "v": pa.array(root[give]), "moved": pa.array(moved[give])})

    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if (size := size + batch.num_rows) > HELD_EDGES:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge do not appear.

    In each round an edge goes to the tasks of both of its ends; each task turns the edges it holds into stars. This ends
    when nothing changes (rounds grow with the logarithm of a path's length). Nodes
    with so many edges that they could fill a task are few: the driver looks up the parents of these only. Each round
    ends in a checkpoint; no round is left out."""
    e = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct().withColumn("moved", F.lit(True)))
    spark, end = e.sparkSession, lambda k: F.struct(F.col(k).alias("k"), "u", F.when(F.lit(k) == "u", F.coalesce("above", "v")).otherwise(F.col("v")).alias("v"))
    above: dict[int, int] = {}
    while True:
        n, moved = e.agg(F.count(F.lit(1)), F.count_if("moved")).first()
        if not moved and all(v == m for v, m in above.items()):
            break
        above = {}
        if n >= 1000:
            often = e.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1000, n // HOT + 1))
            above = {r.v: r.v for r in often.select("v").collect()}  # fewer than HOT
        if above:  # edges to a hot node go to its own parent at once and are not gathered
            above |= {r.u: r.m for r in e.where(F.col("u").isin(list(above))).groupBy("u").agg(F.min("v").alias("m")).collect()}
            ends = e.join(F.broadcast(spark.createDataFrame(list(above.items()), "v long, above long")), "v", "left")
        else:
            ends = e.withColumn("above", F.lit(None).cast("long"))
        both = ends.select(F.explode(F.when(F.col("above").isNull(), F.array(end("u"), end("v"))).otherwise(F.array(end("u")))).alias("e"))
        e = cut(both.select("e.k", "e.u", "e.v").repartition(n // 100_000 + 1, "k").mapInArrow(as_task(_contracted), "u long, v long, moved boolean"))
        release(spark)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct().toDF("node", "component"))
