"""MinHash near-dedup with DartMinHash.

A document is a weighted set of shingles of five words (weight: how often it occurs). The region of an element is
its weight by all ranks; it is cut into cells (ranks in cells of doubling width, weights in [0, 1), [1, 2), [2, 4), ...).
Hashed darts are thrown into the cells an element reaches, in order of rank, and darts beyond its weight miss. Each
dart names a coordinate and the earliest dart of a coordinate is kept, until all are filled: about k ln k darts for
a document instead of k hashes for an element, and cells grow with the logarithm of a weight. Signatures are banded;
bands join different texts only, since copies are first folded into classes.

Every member of a bucket is paired with the bucket's smallest document and verified exactly; the links' components are
found once. Buckets that then still hold several components are searched for links between these, in blocks: a task
takes two blocks of texts, counts their common shingles by a matrix product and sends on pairs of components only.
So no link within a bucket is lost, and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import arrow_map, as_task, connected_components, cut, prepare, quoted, word_hashes

SHINGLE, SIMILARITY, BANDS, ROWS, BLOCK = 5, 0.8, 25, 4, 512
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_FIRST = -8  # the first cell of ranks is [0, 2^_FIRST), each further one as wide as all before


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    return x ^ (x >> np.uint64(33))


def weighted(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit names of a text's shingles and how often each occurs.

    Words are lower-cased and end at ASCII white space. Fewer words than size make one shingle; none makes none."""
    w = word_hashes(text.lower().encode("utf-8", "replace").split())
    if not len(w):
        return w, np.zeros(0, np.int64)
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(size, len(w))):
        h = mix(h + w[j : j + n] + np.uint64(j + 1))
    h.sort()
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.diff(np.r_[first, n])


def units(names: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sorted 64-bit names of (shingle, occurrence): the Jaccard similarity of these sets is the weighted one."""
    if not len(names) or times.max() == 1:
        return names
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    h = np.repeat(names, times)
    h = np.where(nth > 0, mix(h + nth.astype(np.uint64) * _M1), h)
    h.sort()
    return h


def _poisson(width: float) -> np.ndarray:
    """Cumulative probabilities of the number of darts in a cell of unit weight."""
    top = int(width + 12 * width**0.5 + 12)
    logs = np.arange(top + 1) * np.log(width) - width - np.r_[0, np.cumsum(np.log(np.arange(1, top + 1)))]
    return np.cumsum(np.exp(logs))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """k coordinates of each weighted set (none empty): the name of the earliest dart that fell to each."""
    d = len(sets)
    names, weight = (np.concatenate(x) for x in zip(*sets, strict=True))
    of = np.repeat(np.arange(d), [len(s[0]) for s in sets])
    out, filled, cell = np.zeros(d * k, np.uint64), np.zeros(d * k, bool), 0
    while len(names):
        low = 0.0 if cell == 0 else 2.0 ** (_FIRST + cell - 1)
        width = 2.0**_FIRST - low if cell == 0 else low
        keys, darts = [], []
        for j in range(int(weight.max() - 1).bit_length() + 1):  # cells of weights: [0, 1), [1, 2), [2, 4), ...
            floor, height = (0, 1) if j == 0 else (1 << j - 1, 1 << j - 1)
            reach = slice(None) if j == 0 else weight > floor
            seed = mix(names[reach] + np.uint64((cell + 1) * int(_M2) + j * int(_M1) & (1 << 64) - 1))
            n = np.searchsorted(_poisson(width * height), (seed >> np.uint64(11)) * 2.0**-53, side="right")
            hit = np.flatnonzero(n)
            n = n[hit]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(np.repeat(seed[hit], n) + (nth.astype(np.uint64) + np.uint64(1)) * _M1)
            mine = np.repeat(of[reach][hit], n)
            if j:  # a dart beyond the weight of its element misses
                at = floor + (mix(dart + np.uint64(11)) >> np.uint64(11)) * 2.0**-53 * height < np.repeat(weight[reach][hit], n)
                dart, mine = dart[at], mine[at]
            keys.append(mine * k + (mix(dart + np.uint64(7)) % np.uint64(k)).astype(np.int64))
            darts.append(dart)
        key, dart = np.concatenate(keys), np.concatenate(darts)
        free = ~filled[key]
        key, dart = key[free], dart[free]
        order = np.lexsort((dart, key))  # within a cell of ranks the hash itself is the rank
        key, dart = key[order], dart[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        out[key[first]], filled[key[first]] = dart[first], True
        open_ = ~filled.reshape(d, k).all(axis=1)
        if not open_.all():
            stay = open_[of]
            names, weight, of = names[stay], weight[stay], of[stay]
        cell += 1
    return out.reshape(d, k)


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """A number for each band of a signature; bands differ in it, so that it names a bucket."""
    bands = sig.shape[1] // rows
    h = np.tile(np.arange(bands, dtype=np.uint64) * _M1, (sig.shape[0], 1))
    for j in range(rows):
        h = mix(h + sig[:, j::rows][:, :bands] + np.uint64(j))
    return h.view(np.int64)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().encode("utf-8", "replace").split()))


def _sets(b: pa.RecordBatch) -> dict:
    """(node, units) of the rows whose text is that of the node: c1 and c2 are its digest."""
    node, out = [], []
    for i, c1, c2, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
        if np.frombuffer(_digest(text or ""), np.int64).tolist() == [c1, c2]:
            node.append(i)
            out.append(units(*weighted(text or "")).tobytes())
    return {"node": pa.array(node, pa.int64()), "units": pa.array(out, pa.binary())}


def _signed(b: pa.RecordBatch, bands: int, rows: int) -> dict:
    ids, got, n, hashes = b.column(0), [], [], []
    for text in b.column(1).to_pylist():
        got.append(u := weighted(text or ""))
        n.append(int(u[1].sum()))
        hashes.append(_digest(text or ""))
    full = [i for i, c in enumerate(n) if c]
    values = np.zeros((len(ids), bands), np.int64)
    for start in range(0, len(full), 256):
        some = full[start : start + 256]
        values[some] = band_hashes(signatures([got[i] for i in some], bands * rows), rows)
    c = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * bands
    return {"doc": ids, "c1": pa.array(c[:, 0].copy()), "c2": pa.array(c[:, 1].copy()), "n": pa.array(n, pa.int64()), "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))}


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(both) - same)


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    return min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(x, y) >= least


def _set(u: bytes) -> np.ndarray:
    return np.frombuffer(u, np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("units").alias("ua")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("units").alias("ub")), "b")

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        good = [alike(_set(u), _set(v), least) for u, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        return b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return arrow_map(x.select("a", "b", "ua", "ub"), check, "a long, b long")


def _links_between(part: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of components with a link between a row of left and one of right; pairs that others imply are left out."""
    size = np.array([len(s) for s in sets])
    names, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), size)
    common = times[place] > 1  # the others are in no intersection
    place, of = np.unique(place[common], return_inverse=True)[1], of[common]
    row = np.zeros(len(sets), np.int64)
    both, width = np.zeros((len(left), len(right)), np.float32), 4096
    for start in range(0, int(place.max()) + 1 if len(place) else 0, width):
        here = (place >= start) & (place < start + width)
        m = []
        for some in (left, right):
            row[:] = -1
            row[some] = np.arange(len(some))
            at = here & (row[of] >= 0)
            x = np.zeros((len(some), width), np.float32)
            x[row[of[at]], place[at] - start] = 1
            m.append(x)
        both += m[0] @ m[1].T
    good = both >= least * (size[left][:, None] + size[right][None, :] - both) - 1e-3
    good &= part[left][:, None] != part[right][None, :]
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    for p, q in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
        x, y = top(int(part[left[p]])), top(int(part[right[q]]))
        if x != y and alike(sets[left[p]], sets[right[q]], least):
            root[max(x, y)] = min(x, y)
            yield max(x, y), min(x, y)


def _searched(least: float):
    """Rows (bucket, i, j, block, component, units) come sorted by the first three, which name two blocks to compare."""

    def found(rows: list[tuple[int, int, bytes]], key: tuple[int, int, int]) -> list[tuple[int, int]]:
        block, part = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        if not len(left) or not len(right) or part.min() == part.max():
            return []
        return list(_links_between(part, left, right, [_set(r[2]) for r in rows], least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            out = []
            for k, i, j, block, part, u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, i, j) != key:
                    if rows:
                        out += found(rows, key)
                    key, rows = (k, i, j), []
                rows.append((block, part, u))
            yield _pairs(out)
        if rows:
            yield _pairs(found(rows, key))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, copy_of, component) for each id: the smallest id with the same words, and the smallest id that chains of
    pairs with weighted Jaccard similarity >= similarity reach.

    Null, empty and blank texts link with nothing. Rows that repeat an id are one document that has the links of each
    and one row. Each row of a null id has a row without any id and links with nothing. Texts that are equal up to case
    and white space are copies, whatever their length. Other columns are not read. An empty table gives no rows."""
    spark = prepare(docs.sparkSession)
    doc = F.col(quoted(id_col)).cast("long").alias("doc")
    pair = docs.select(doc, F.col(quoted(text_col)).cast("string").alias("text")).where("doc is not null")
    signed = cut(arrow_map(pair, lambda b: _signed(b, bands, rows), "doc long, c1 long, c2 long, n long, bands array<long>"))
    reps = signed.where("n > 0").groupBy("c1", "c2").agg(F.min("doc").alias("copy_of"), F.first("bands").alias("bands"))  # copies have the same bands
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    placed = cut(signed.select("doc", "c1", "c2").join(reps.select("c1", "c2", "node", "copy_of"), ["c1", "c2"], "left").select("doc", "node", "copy_of"))
    banded = reps.select("node", F.explode("bands").alias("k"))
    buckets = banded.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre")).where("size > 1")
    members = cut(banded.join(buckets, "k"))
    pairs = members.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    asked = reps.join(members.select("node").distinct(), "node").select("node", "c1", "c2", F.col("copy_of").alias("doc"))
    sets = cut(arrow_map(pair.join(asked, "doc").select("node", "c1", "c2", "text"), _sets, "node long, units binary").dropDuplicates(["node"]))
    links = _verified(pairs, sets, similarity)
    several = placed.groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("x")).where("b < x")
    if not several.isEmpty():  # the texts of one id
        links = links.unionAll(placed.join(several, "doc").where("node > b").select(F.col("node").alias("a"), "b"))
    parts = connected_components(links)
    # what buckets with several components have left; of buckets with the same members one is searched
    held = members.where("size > 2").join(parts, "node", "left").select("k", "node", "size", F.coalesce("component", "node").alias("component"))
    several = held.groupBy("k").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t")).where("x != y")
    several = several.groupBy("m", "s", "t").agg(F.min("k").alias("k")).select("k")
    mixed = held.join(several, "k").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    mixed = cut(mixed.select("k", "node", "component", "blocks", "block"))
    dealt = mixed.join(sets, "node").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("k", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "component", "units")
    dealt = dealt.repartition(common.partitions(spark), "k", "i", "j").sortWithinPartitions("k", "i", "j")
    more = connected_components(dealt.mapInArrow(as_task(_searched(similarity)), "a long, b long"))
    classes = reps.select("node", "copy_of").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    classes = classes.join(more.select(F.col("node").alias("part"), F.col("component").alias("whole")), "part", "left").select("node", "copy_of", F.coalesce("whole", "part").alias("whole"))
    least = classes.groupBy("whole").agg(F.min("copy_of").alias("component"), F.count(F.lit(1)).alias("m")).where("m > 1").select("whole", "component")
    found = placed.join(classes.join(least, "whole").select("node", "component"), "node", "left")
    own = found.select("doc", F.coalesce("copy_of", "doc").alias("copy_of"), F.coalesce("component", "copy_of", "doc").alias("component"))
    none = F.lit(None).cast("long")
    return own.groupBy("doc").agg(F.min("copy_of").alias("copy_of"), F.min("component").alias("component")).unionAll(docs.select(doc).where("doc is null").select("doc", none, none))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without rows whose id is not the smallest of its component; rows of a null id stay. Rows that repeat an id
    stay or go together. Columns stay as they are."""
    key = common.fresh(docs, "__doc")
    gone = near_duplicates(docs, id_col, text_col, similarity).where("doc != component").select(F.col("doc").alias(key))
    return docs.join(gone, F.col(quoted(id_col)).cast("long") == F.col(key), "left_anti")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """One row for each doc_id of documents: copy_of, component_id and kept (it is its component's smallest id). Cases are
    those of near_duplicates; a null doc_id has null ids and is kept."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("doc").alias("doc_id"), "copy_of", F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))
