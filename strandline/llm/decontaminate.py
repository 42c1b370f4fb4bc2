"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items
(an item of fewer words is one pattern). For each pattern length a shift table
over blocks of two words says how far the search may jump; where the shift is
zero, the hash of the last words selects a bucket of test strings, and words are
then compared directly. The search runs on all lanes of a text run at once in
numpy, inside one scan of the documents: no document row is shuffled.

The benchmark is read through an iterator and compiled in blocks of at most
``BLOCK_WINDOWS`` windows, each its own broadcast; a document is searched for
every block in turn, so no broadcast exceeds the bound.

Defined cases: words are maximal runs of digits, letters and non-ASCII
characters after lower-casing A-Z. A null or empty text has no words and is
clean. Null or wordless items give no pattern. Repeated items with one id count
once; an item without id marks words but is not counted. A window never spans
two documents. Repeated document rows each give a row. Texts of any length are
searched whole. Other columns are returned as they are; one that has the name of
the result is replaced. An empty table gives an empty result, an empty benchmark
no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, free_name
from .textkit import ALNUM_WORDS, LOWER, mix, runs, span_hashes, spans, text_buffer

#: Windows in one broadcast block: about 40 MB at 10 words.
BLOCK_WINDOWS = 1 << 18
LANE = 512
_SPLIT = bytes(b if ALNUM_WORDS[b] else 0x20 for b in LOWER.tolist())

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_starts", T.ArrayType(T.IntegerType())),
        T.StructField("hit_ends", T.ArrayType(T.IntegerType())),
    ]
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_SPLIT).split()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b)


class Matcher:
    """Wu-Manber tables of patterns with one common number of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str | None]], length: int):
        self.length, self.block = length, min(2, length)
        self.suffix = min(4, length)
        words = list(patterns)
        joined = b" ".join(b" ".join(p) for p in words)
        data = np.frombuffer(joined, np.uint8)
        starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM_WORDS)
        hashes = span_hashes(data, starts, ends).reshape(len(words), length)
        order = np.argsort(self._suffix(hashes, np.full(len(words), length - 1), np.arange(len(words))), kind="stable")
        self.words, self.items = [words[i] for i in order], [sorted(patterns[words[i]], key=str) for i in order]
        self.hashes = hashes[order]
        self.buckets = self._suffix(self.hashes, np.full(len(order), length - 1), np.arange(len(order)))
        most = length - self.block + 1
        bits = int(np.clip(np.ceil(np.log2(32 * len(words) * most)), 12, 24))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, most, np.uint8 if most < 256 else np.int32)
        for end in range(self.block - 1, length):  # blocks nearer the end come later and have the smaller shift
            at = self._block(self.hashes[:, end - 1] if self.block == 2 else None, self.hashes[:, end])
            self.shift[at] = np.minimum(self.shift[at], length - 1 - end)

    def _block(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return (_pair(last, last) if before is None else _pair(before, last)) >> self.down

    def _suffix(self, hashes: np.ndarray, at: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(self.suffix):
            h = _pair(h, hashes[at - j] if row is None else hashes[row, at - j])
        return h

    def places(self, words: np.ndarray) -> np.ndarray:
        """Last words of windows that the shift table does not rule out."""
        starts = np.arange(0, len(words), LANE)
        ends = np.minimum(starts + LANE, len(words))
        at, found = np.maximum(starts, self.length - 1), []
        while True:
            alive = at < ends
            at, ends = at[alive], ends[alive]
            if not len(at):
                return np.concatenate(found) if found else at
            step = self.shift[self._block(words[at - 1] if self.block == 2 else None, words[at])].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)

    def occurrences(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Last words of windows and the patterns whose word hashes equal theirs, some at a time."""
        at = self.places(words)
        suffix = self._suffix(words, at)
        low, high = np.searchsorted(self.buckets, suffix, "left"), np.searchsorted(self.buckets, suffix, "right")
        at, low, high = (x[high > low] for x in (at, low, high))
        for part in range(0, len(at), 1 << 15):
            n = (high - low)[part : part + (1 << 15)]
            where = np.repeat(at[part : part + (1 << 15)], n)
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part : part + (1 << 15)], n)
            for j in range(self.length):
                same = words[where - j] == self.hashes[which, self.length - 1 - j]
                where, which = where[same], which[same]
            yield where, which


def compile_block(items: list[tuple[str | None, list[bytes]]], window: int) -> list[Matcher]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = {}
    for item_id, words in items:
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item_id)
    return [Matcher(p, n) for n, p in sorted(by_length.items())]


def pattern_blocks(benchmark: DataFrame, window: int, limit: int = BLOCK_WINDOWS) -> Iterator[list[Matcher]]:
    """Compiled blocks of at most ``limit`` windows (a longer item is a block of its own)."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        words = words_of(row.t or "")
        n = max(1, len(words) - window + 1)
        if held and size + n > limit:
            yield compile_block(held, window)
            held, size = [], 0
        if words:
            held.append((row.i, words))
            size += n
    if held:
        yield compile_block(held, window)


def search(column: pa.Array, blocks: list) -> list[tuple]:
    """(n_words, n_hit, item ids, starts and ends of hit runs) of each row."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, ALNUM_WORDS)
    words, raw = span_hashes(data, starts, ends), data.tobytes()
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cover = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str | None]] = {}
    for block in blocks:
        for m in block.value if hasattr(block, "value") else block:
            for where, which in m.occurrences(words):
                begin = where - m.length + 1
                inside = rows[begin] == rows[where]
                for a, b, p in zip(begin[inside].tolist(), where[inside].tolist(), which[inside].tolist(), strict=True):
                    if tuple(raw[starts[a] : ends[b]].translate(_SPLIT).split()) == m.words[p]:
                        cover[a] += 1
                        cover[b + 1] -= 1
                        items.setdefault(int(rows[a]), set()).update(m.items[p])
    hit = np.cumsum(cover[:-1]) > 0
    out = []
    for i in range(len(first) - 1):
        n = int(first[i + 1] - first[i])
        if i not in items:
            out.append((n, 0, [], [], []))
            continue
        mine = np.diff(np.concatenate([[0], hit[first[i] : first[i + 1]].astype(np.int8), [0]]))
        ids = sorted(x for x in items[i] if x is not None)
        out.append((n, int(hit[first[i] : first[i + 1]].sum()), ids, np.flatnonzero(mine == 1).tolist(), np.flatnonzero(mine == -1).tolist()))
    return out


def find_benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, name: str = "_sl"
) -> DataFrame:
    """docs with a struct: n_words, n_hit, item_ids, and the word spans [hit_starts, hit_ends) of hits."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in pattern_blocks(benchmark, window)]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def make():
        def compute(batch: pa.RecordBatch) -> pa.StructArray:
            rows = [x for part in runs(batch, text) for x in search(part.column(text), blocks)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RESULT.names)

        return compute

    return annotate(docs, make, RESULT, name, keep)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a benchmark window, columns as they came."""
    hits = free_name(docs, "hits")
    found = find_benchmark_hits(docs, benchmark, window, name=hits)
    return found.where(F.col(hits)["n_hit"] == 0).drop(hits)
