"""Text: the identifier-preserving tokenizer, BM25 terms, sentence units, salience, code or prose."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import QUERY_TERMS, TERM_BYTES

#: BM25 parameters and character classes of terms.
K1, B = 1.2, 0.75
RUN, EDGE, PART = r"([A-Za-z0-9_\-.:/+#\x{80}-\x{10FFFF}]+)", r"^[-.:/+#]+|[-.:/+#]+$", r"[_\-.:/+#]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases with their weights, phrases of what is not to be kept, phrases of tags.
SALIENCE = {
    "remember": 1.0, "decided": 0.8, "decision": 0.8, "we'll use": 0.7, "we will use": 0.7, "prefer": 0.7, "convention": 0.7, "always": 0.6,
    "never": 0.6, "the fix": 0.7, "fixed": 0.6, "root cause": 0.7, "important": 0.6, "note that": 0.5, "going forward": 0.7,
}
EPHEMERAL = ("don't remember", "do not remember", "ephemeral", "temporary", "scratch", "ignore this", "forget this", "secret", "do not store")
TAGS = {
    "decision": ("decided", "decision", "we'll use", "we will use", "going forward"),
    "preference": ("prefer", "convention", "always", "never"),
    "fix": ("the fix", "fixed", "root cause", "bug"),
}
#: Patterns of code and tool output.
CODE = (
    r"^\s*\d{1,6}([\t|:]|\s{2,})",
    r"^\s*[$#>]\s|^\s*(sed|grep|awk|echo|cat|make|docker|npm|pip|cd|git|curl|python3?|nc|sudo|chmod|mkdir|rm|ls|tail|head)\b",
    r"^\s*([-+][^-+ ]|@@ )",
    r"=>|::|</|/>|/\*|\bvar\(--|\bfunction\b|\bconst\b|\blet\b|\bdef\b|\bclass\b|\bimport\b|\breturn\b|#include|\btypedef\b|\bstruct\b",
)
SYMBOLS = "{}[]()<>=|/\\`"


def tokens(text: Column) -> Column:
    """array<string> of terms with repetitions: each run's full term, then its parts of two bytes or more."""
    full = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(1)), lambda t: F.translate(F.regexp_replace(t, EDGE, ""), UPPER, LOWER)), lambda t: t != "")
    cut = F.transform(full, lambda t: F.when(F.octet_length(t) > TERM_BYTES, F.substring(t.cast("binary"), 1, TERM_BYTES).cast("string")).otherwise(t))
    parts = lambda t: F.filter(F.split(t, PART), lambda p: (F.octet_length(p) >= 2) & (F.octet_length(p) < F.octet_length(t)))
    return F.flatten(F.transform(cut, lambda t: F.when(t.rlike(PART), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))


_RUNS, _PARTS, _ASCII = re.compile("[A-Za-z0-9_\\-.:/+#\x80-\U0010ffff]+"), re.compile(r"[_\-.:/+#]+"), str.maketrans(UPPER, LOWER)
_memo: dict[str, tuple[str, ...]] = {}
#: Bounds of what a worker holds: runs in the memo and their characters, bytes of a batch and of the texts cut at once.
MEMO, MEMO_CHARS, BATCH_BYTES, PIECE_BYTES = 32_768, 64, 4 << 20, 1 << 20


def _of_run(run: str) -> tuple[str, ...]:
    """A run's full term and its parts."""
    t = run.strip("-.:/+#").translate(_ASCII)
    size = len(t.encode("utf-8", "replace"))
    if size > TERM_BYTES:
        t, size = t.encode("utf-8", "replace")[:TERM_BYTES].decode("utf-8", "replace"), TERM_BYTES
    if not t:
        return ()
    return (t, *(p for p in _PARTS.split(t) if 2 <= len(p.encode("utf-8", "replace")) < size)) if _PARTS.search(t) else (t,)


def _known(run: str) -> tuple[str, ...]:
    """_of_run through a memo of bounded size."""
    if (t := _memo.get(run)) is None:
        t = _of_run(run)
        if len(run) <= MEMO_CHARS:
            if len(_memo) >= MEMO:
                _memo.clear()
            _memo[run] = t
    return t


def terms(text: str) -> list[str]:
    """What `tokens` gives, for use within an Arrow batch."""
    return [t for run in _RUNS.findall(text) for t in _known(run)]


def term_counts(text: str) -> dict[str, int]:
    """The terms of a text with their numbers; each different run is looked at once."""
    out: dict[str, int] = {}
    for run, n in Counter(_RUNS.findall(text)).items():
        for t in _known(run):
            out[t] = out.get(t, 0) + n
    return out


def bounded(documents: DataFrame) -> DataFrame:
    """documents, with Arrow batches that long texts do not make large."""
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return documents


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts (null: empty) of batches (id, text), of some PIECE_BYTES or one text at a time, whatever a batch holds."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(size // PIECE_BYTES)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:], strict=False):
            if j > i:
                yield b.column(0).slice(i, j - i).to_pylist(), [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]


def lengths(documents: DataFrame, text: str = "data") -> DataFrame:
    """(id, dl): the number of each document's terms, with repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "dl": pa.array([sum(len(_known(r)) for r in _RUNS.findall(t)) for t in texts], pa.int64())})

    rows = bounded(documents).select(F.col("id").cast("long").alias("id"), F.col(text).cast("string").alias("data"))
    return rows.mapInArrow(run, "id long, dl long")


def query_terms(query: str) -> list[str]:
    """The first different terms of a query."""
    return list(dict.fromkeys(terms(query)))[:QUERY_TERMS]


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weighted(tf: Column, idf_: Column, dl: Column, avgdl: Column) -> Column:
    """A term's part of the score."""
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    return weighted(tf, idf(n, df), dl, avgdl)


def any_of(low: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def word_count(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def salience(text: Column) -> Column:
    """The largest weight of a phrase that occurs, a tenth more (1 at most) for six words or more."""
    low = F.lower(text)
    top = F.greatest(*[F.when(F.contains(low, F.lit(p)), w).otherwise(0.0) for p, w in SALIENCE.items()])
    return F.when((top > 0) & (word_count(text) >= 6), F.least(F.lit(1.0), top + 0.1)).otherwise(top)


def inferred_tags(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(F.lit("session"), *[F.when(any_of(low, phrases), F.lit(tag)) for tag, phrases in TAGS.items()]))


def ephemeral(text: Column) -> Column:
    return any_of(F.lower(text), EPHEMERAL)


def looks_like_code(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    hit = reduce(lambda a, b: a | b, [t.rlike(p) for p in CODE])
    return F.when(t == "", False).otherwise(hit | (F.length(t) - F.length(F.replace(t, F.lit(";"))) >= 2) | ((F.length(t) >= 12) & (symbols / F.greatest(F.length(t), F.lit(1)) > 0.08)))


def sentences(text: Column) -> Column:
    """Trimmed sentence units of eight characters or more, in order."""
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?\n]+[.!?]?)"), F.lit(1)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: F.length(s) >= 8)


def truncated(text: Column, limit: int) -> Column:
    """Cut at limit, back to a space that keeps 60 % of it, with a mark."""
    if not limit:
        return text
    cut = F.substring(text, 1, limit)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # zero-based place of the last space
    back = F.when((F.instr(cut, " ") > 0) & (space >= limit * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(back), F.lit(" […]")))
