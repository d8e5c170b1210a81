"""BPE encoding and decoding by speculation and verification.

New words of a batch get a greedy longest-match proposal. A proposal is the exact encoding if and only if each of
its tokens encodes to itself and each pair of neighbours, encoded alone, splits into just these two tokens. The
pairs of all proposals are tested together against a sorted table of known pairs; words with a failing token or
pair are merged exactly. Finished words stay in a cache of bounded size.
"""

from __future__ import annotations

import json
import re
import sys
from heapq import heapify, heappop, heappush
from itertools import chain
from unicodedata import category, normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import add_columns, arrow_map, prepare, widened

CACHE = 200_000
#: The end of a word, and Unicode white space as the file's patterns mean it.
END = "</w>"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled(pattern: str) -> re.Pattern:
    r"""A pattern over \p{L}, \p{N} and \s for the re module, which is the faster one and knows \w and \d only."""
    numbers = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isdecimal() and category(c)[0] != "L"]
    runs: list[list[int]] = []
    for c in map(ord, numbers):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    n = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\w{_SPACE}]+|_+)+").replace(r"[\p{L}]", rf"[^\W\d_{n}]").replace(r"[\p{N}]", rf"[\d{n}]")
    if r"\p" in pattern:
        raise ValueError(f"a class that is not known here: {pattern[:80]}")
    return re.compile(pattern.replace(r"\s", f"[{_SPACE}]"))


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else from 256 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBPE:
    """A tokenizer file of kind BPE with word ends, lower case and byte-level characters."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.names = {i: t for t, i in chain(self.vocab.items(), self.specials.items())}
        self.table = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.makes = [self.vocab[a + b] for a, b in pairs]
        self.starts: dict[str, int] = {}  # beginnings of tokens: the token's id, or -1
        for t, i in self.vocab.items():
            for k in range(1, len(t)):
                self.starts.setdefault(t[:k], -1)
            self.starts[t] = i
        self.chars = byte_chars()
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = compiled(pattern)
        self.named = {t: (i,) for t, i in self.specials.items()}  # letters and signs mixed: no piece of a text is one
        self.words: dict[str, tuple[int, ...]] = dict(self.named)
        self.known: dict[str, tuple[int, ...]] = {}  # the same for what stands between white space
        self.space = re.compile(f"[{_SPACE}]+")
        self.cut: dict[int, list[int]] = {}  # the symbols of a token
        self.whole: dict[int, bool] = {}  # does a token encode to itself?
        self.codes, self.fits = np.empty(0, np.int64), np.empty(0, bool)  # known pairs, sorted

    def text(self, word: str) -> str:
        return "".join([self.chars[b] for b in word.encode("utf-8", "replace")])

    def symbols(self, word: str) -> list[int]:
        t = self.text(word)
        return [*map(self.vocab.__getitem__, t[:-1]), self.vocab[t[-1] + END]]

    def merged(self, s: list[int]) -> list[int]:
        """Exact merging of a list of symbols: the lowest rank first, the leftmost of equals."""
        if len(s) > 48:
            return self._merged_long(s)
        s, get, never = s[:], self.ranks.get, 1 << 30
        r = [get(a << 20 | b, never) for a, b in zip(s, s[1:])]
        while r and (best := min(r)) < never:
            i = r.index(best)
            s[i] = self.makes[best]
            del s[i + 1], r[i]
            if i:
                r[i - 1] = get(s[i - 1] << 20 | s[i], never)
            if i < len(r):
                r[i] = get(s[i] << 20 | s[i + 1], never)
        return s

    def _merged_long(self, s: list[int]) -> list[int]:
        """The same with a heap of pairs, for long words; a merged symbol stays at its left end."""
        s = s[:]
        after, before = [*range(1, len(s)), -1], [*range(-1, len(s) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(s, s[1:])) if (r := self.ranks.get(a << 20 | b)) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j], k = self.makes[rank], -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := self.ranks.get(s[x] << 20 | s[y])) is not None:
                    heappush(heap, (r, x, s[x], s[y]))
        return [x for x in s if x >= 0]

    def parts(self, token: int) -> list[int]:
        if token not in self.cut:
            t = self.names[token]
            end = t.endswith(END) and len(t) > len(END)
            self.cut[token] = [*map(self.vocab.__getitem__, t[: -len(END) - 1]), self.vocab[t[-len(END) - 1 :]]] if end else [*map(self.vocab.__getitem__, t)]
        return self.cut[token]

    def greedy(self, word: str) -> list[int]:
        """The longest token at each place; the last symbol carries the end of the word and is not torn off."""
        t = self.text(word)
        body, i, out, get = len(t), 0, [], self.starts.get
        while True:
            j, at, found = i + 1, i, -1
            while j < body and (k := get(t[i:j])) is not None:
                if k >= 0:
                    at, found = j, k
                j += 1
            if j == body and (k := get(t[i:] + END, -1)) >= 0:
                out.append(k)
                return out
            out.append(found)
            i = at

    def _fit(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens (left << 20 | right) stays apart, from the table; new pairs are merged once."""
        asked, back = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, asked), max(0, len(self.codes) - 1))
        new = asked[self.codes[at] != asked] if len(self.codes) else asked
        if len(new):
            if len(self.codes) > 4 * CACHE:
                self.codes, self.fits = self.codes[:0], self.fits[:0]
                new = asked
            fits = np.empty(len(new), bool)
            for i, c in enumerate(new.tolist()):
                a, b = c >> 20, c & 0xFFFFF
                fits[i] = self.merged(self.parts(a) + self.parts(b)) == [a, b]
            codes, fits = np.concatenate([self.codes, new]), np.concatenate([self.fits, fits])
            order = np.argsort(codes)
            self.codes, self.fits = codes[order], fits[order]
        return self.fits[np.searchsorted(self.codes, asked)][back]

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of words into the cache."""
        proposals = [self.greedy(w) for w in words]
        flat = np.fromiter(chain.from_iterable(proposals), np.int64)
        of = np.repeat(np.arange(len(words)), [len(p) for p in proposals])
        bad = np.zeros(len(words), bool)
        used, back = np.unique(flat, return_inverse=True)
        for t in used.tolist():
            if t not in self.whole:
                self.whole[t] = self.merged(self.parts(t)) == [t]
        bad[of[~np.array([self.whole[t] for t in used.tolist()], bool)[back]]] = True
        inside = of[1:] == of[:-1]
        if inside.any():
            fits = self._fit((flat[:-1] << 20 | flat[1:])[inside])
            bad[of[1:][inside][~fits]] = True
        for i in np.flatnonzero(bad).tolist():
            proposals[i] = self.merged(self.symbols(words[i]))
        self.words.update(zip(words, map(tuple, proposals), strict=True))

    def chunks(self, text: str) -> list[str]:
        """Special tokens and the runs between white space; no piece reaches over white space."""
        if self.special and self.special.search(text):
            return [c for p in self.special.split(text) for c in ([p] if p in self.specials else self.chunks(p))]
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for split(), not for the pattern
            return [c for c in self.space.split(text) if c]
        return text.split()

    def pieces(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if chunk in self.specials:
            return [chunk]
        return self.split.findall(normalize("NFC", chunk).replace("\u03a3", "\u03c3").lower())

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for start in range(0, len(texts), 256):
            some = list(map(self.chunks, texts[start : start + 256]))
            need = set().union(*some)
            if new := need.difference(self.known):
                if len(self.known) + len(new) > CACHE:
                    self.known = {c: self.known[c] for c in need if c in self.known}
                parts = list(map(self.pieces, new))
                if words := set().union(*parts).difference(self.words):
                    if len(self.words) + len(words) > CACHE:
                        words = set().union(*parts)
                        self.words = self.named | {w: self.words[w] for w in words if w in self.words}
                        words = words.difference(self.words)
                    self.learn(list(words))
                get = self.words.__getitem__
                self.known.update((c, get(p[0]) if len(p) == 1 else tuple(chain.from_iterable(map(get, p)))) for c, p in zip(new, parts, strict=True))
            get = self.known.__getitem__
            out += [list(chain.from_iterable(map(get, c))) for c in some]
        return out

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """The file has no decoder: names of the tokens, joined by spaces. Unknown ids are left out."""
        get, top, out = self.table.__getitem__, len(self.table), []
        for x in ids:
            if x and not 0 <= min(x) <= max(x) < top:
                x = [i for i in x if 0 <= i < top]
            out.append(" ".join(map(get, x)))
        return out


def _model(shared) -> WordBPE:
    """The tokenizer of this Python worker; it and its caches outlive a task, until one of another operator begins."""
    key, data = shared.value
    if common.kept.get("bpe", ("",))[0] != key:
        common.kept["bpe"] = key, WordBPE(data)
    return common.kept["bpe"][1]


def _shared(spark, path: str):
    """The file's bytes (a few MB, whatever the input), read by the driver and broadcast."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((path, data))


def _array(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """docs with token_ids (array<int>) and n_tokens (long); with decoded, also the ids' decoded text under that name.

    Ids are those of the tokenizers library without special tokens added; the names of special tokens that stand
    in a text become their ids, as there. Null and empty texts have no ids and decode to the empty text. Columns of
    docs with the names of new columns are replaced, all others pass through, each row for itself."""
    spark = prepare(docs.sparkSession)
    shared = _shared(spark, path or public_tokenizers.path("word_bpe_49k.json"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(shared)
        column = batch.column(batch.schema.names.index(text_col)).cast(pa.string())
        ids = model.encode_batch(["" if t is None else t for t in column.to_pylist()])
        new = {"token_ids": _array(ids), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
        if decoded:
            new[decoded] = pa.array(model.decode_batch(ids), pa.string())
        return add_columns(batch, **new)

    kinds = {"token_ids": "array<int>", "n_tokens": "bigint"} | ({decoded: "string"} if decoded else {})
    return arrow_map(docs, run, widened(docs, **kinds), "bpe")


def decode(df: DataFrame, path: str | None = None, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of each array of ids. A null array gives the empty text; null or unknown ids are left out."""
    spark = prepare(df.sparkSession)
    shared = _shared(spark, path or public_tokenizers.path("word_bpe_49k.json"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [[i for i in x or () if i is not None] for x in batch.column(batch.schema.names.index(ids_col)).to_pylist()]
        return add_columns(batch, **{out_col: pa.array(_model(shared).decode_batch(ids), pa.string())})

    return arrow_map(df, run, widened(df, **{out_col: "string"}), "bpe")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    d = encode(common.read(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return d.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
