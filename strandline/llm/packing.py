"""Packing of tokenised documents into windows by Karmarkar-Karp differencing.

Each task tokenises its documents as they stream in and packs them in groups of
about ``GROUP_WINDOWS`` windows, so no row is shuffled and memory stays bounded.
Documents longer than a window give full windows of their own first. The other
parts of a group are partitioned over the windows by multiway differencing:
partial partitions are merged, the fullest window of one on the emptiest of the
other, largest imbalance first. Whenever a window exceeds the capacity, the
window count rises and the group is partitioned anew. The gaps of the near-equal
windows are then closed by cutting up the emptiest windows, and what is left
over moves on to the next group. The last rest of a task becomes windows of
powers of two, so nothing is padded.

The near-equal windows leave the same small gap in each, which one cut-up window
in some dozens fills.

Defined cases: a null or empty text is its end token alone. Repeated rows and rows
without id are packed one by one. Texts of any length are taken whole. Only doc_id
and text are read, so other columns may have any name. An empty table gives no
row. Sequence ids are unique: the partition's number and a counter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import LOWER, SPACE_WORDS, give_back, runs, spans, text_buffer

GROUP_WINDOWS = 64
#: Bytes of texts encoded together.
TOGETHER = 1 << 20
#: Most words remembered by a task, about 50 MB.
REMEMBERED = 200_000
#: New words encoded in one call.
CHUNK = 8192
#: Words that the tokenizer neither changes nor parts: small Latin letters, each of one code point.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[33:127] = True
for _first, _last in ((48, 58), (65, 91), (97, 123)):  # digits and letters are no marks
    _MARK[_first:_last] = False
#: The word that stands for the end of a document.
_END = 0


class WordTokenizer:
    """Encodes with a lower-casing tokenizer that drops white space, remembering white-space separated words.

    The words of many texts are told apart, made distinct by Arrow and looked up once.
    New plain words go through the tokenizer's merges alone, in one text: the
    vocabulary marks the tokens that end a word. Other new words are also encoded
    together, a special token between them: it ends normalisation and merges just as
    white space does, and its id tells the words apart.
    """

    def __init__(self, path: str, end_id: int = 2):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # the same merges, without normalisation
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        added = self.tokenizer.get_added_tokens_decoder()
        special = {i: t for i, t in added.items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)}
        self.cut_id = min(special)
        self.cut = special[self.cut_id].content.encode()
        self.special = [t.content.encode().lower() for t in added.values()]
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self._remember([b""], np.array([self.end_id]), np.zeros(1, np.int64), np.ones(1, np.int64))  # no word is empty

    def _ids(self, tokenizer, text: bytes) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _remember(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        k = len(self.words)
        while k + len(words) > len(self.starts):
            self.starts, self.sizes = np.append(self.starts, self.starts * 0), np.append(self.sizes, self.sizes * 0)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, self.flat * 0)
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[k : k + len(words)] = starts + self.used
        self.sizes[k : k + len(words)] = ends - starts
        self.used += len(ids)
        self.words.update(zip(words, range(k, k + len(words)), strict=True))

    def _learn(self, new: list[bytes]) -> None:
        plain, together, alone = [], [], []
        for w in new:
            (plain if _PLAIN.fullmatch(w.decode()) else alone if self.cut in w else together).append(w)
        if not self.ends_word.any():
            plain, together = [], plain + together
        for i in range(0, len(plain), CHUNK):
            words = plain[i : i + CHUNK]
            ids = self._ids(self.merges, b" ".join(words))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            self._remember(words, ids, np.append(0, ends[:-1]), ends)
        for i in range(0, len(together), CHUNK):
            words = together[i : i + CHUNK]
            ids = self._ids(self.tokenizer, b"".join(w + self.cut for w in words))
            ends = np.flatnonzero(ids == self.cut_id)
            self._remember(words, ids, np.append(0, ends[:-1] + 1), ends)
        for w in alone:
            ids = self._ids(self.tokenizer, w)
            self._remember([w], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, an end after each, and the row's offsets in them."""
        data, offsets = text_buffer(column)
        lower = LOWER[data]
        raw = lower.tobytes()
        if not any(t in raw for t in self.special):
            # white space between a plain letter and a mark, which the tokenizer parts: fewer different words
            part = _LETTER[lower[:-1]] & _MARK[lower[1:]]
            part[offsets[(offsets > 0) & (offsets < len(lower))] - 1] = False
            at = np.flatnonzero(part) + 1
            data, offsets = np.insert(lower, at, 32), offsets + np.searchsorted(at, offsets)
        starts, ends, first = spans(data, offsets, SPACE_WORDS)
        places = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        kept = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)]).dictionary_encode()
        if len(self.words) > REMEMBERED:
            self._clear()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.words]
        if new:
            self._learn(new)
        known = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        at = np.insert(known[words.indices.to_numpy()], first[1:], _END)
        sizes = self.sizes[at]
        ends = np.append(0, np.cumsum(sizes))
        flat = self.flat[np.arange(int(ends[-1])) + np.repeat(self.starts[at] - ends[:-1], sizes)]
        return flat, ends[np.append(0, first[1:] + np.arange(1, len(first)))]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of item numbers with near-equal sums, by Karmarkar-Karp multiway differencing."""
    heap = []
    for i, s in enumerate(sizes):
        # a partial partition: windows as (sum, items), fullest first; those not listed are empty
        heap.append((-s, i, [(s, [i])]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, ia, a = heapq.heappop(heap)
        _, ib, b = heapq.heappop(heap)
        free = k - len(a)
        # the fullest of b fall on the empty windows of a, the others on its emptiest ones
        merged = a[: len(a) - max(0, len(b) - free)] + b[:free]
        for x, y in zip(reversed(a), b[free:], strict=False):
            merged.append((x[0] + y[0], x[1] + y[1]))
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], min(ia, ib), merged))
    out = [w[1] for w in heap[0][2]] if heap else []
    return out + [[] for _ in range(k - len(out))]


def fill_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers none of which exceeds the capacity; the count rises until that holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += max(1, k // 24)


class Packer:
    """Packs parts (document, start, ids) of one task; gives (part, sequence, offset) rows."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.parts: list[tuple] = []
        self.held = 0

    def _emit(self, parts: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in parts:
            yield doc, start, ids, total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start, total = 0, len(ids)
        while total - start >= self.capacity:
            yield from self._emit([(doc, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start < total:
            self.parts.append((doc, start, ids[start:], total))
            self.held += total - start
        if self.held >= GROUP_WINDOWS * self.capacity:
            yield from self._pack()

    def _pack(self) -> Iterator[tuple]:
        windows = fill_windows([len(p[2]) for p in self.parts], self.capacity)
        filled = sorted(([self.parts[i] for i in w] for w in windows), key=lambda w: -sum(len(p[2]) for p in w))
        room = [self.capacity - sum(len(p[2]) for p in w) for w in filled]
        at, rest = 0, []
        while filled:  # the emptiest window is cut up to close the gaps of the fullest
            if at >= len(filled) or not room[at]:
                if at >= len(filled):
                    break
                at += 1
                continue
            if not rest:
                if len(filled) - 1 == at:
                    rest = filled.pop()
                    break
                rest = filled.pop()
                room.pop()
            doc, start, ids, total = rest.pop()
            n = min(room[at], len(ids))
            filled[at].append((doc, start, ids[:n], total))
            room[at] -= n
            if n < len(ids):
                rest.append((doc, start + n, ids[n:], total))
        for w in filled:
            yield from self._emit(w)
        self.parts, self.held = rest, sum(len(p[2]) for p in rest)

    def finish(self) -> Iterator[tuple]:
        if self.held >= self.capacity:
            yield from self._pack()
        size = 1 << (self.capacity.bit_length() - 1)
        while self.parts:
            while size > self.held:
                size >>= 1
            window, left = [], size
            while left:
                doc, start, ids, total = self.parts.pop()
                n = min(left, len(ids))
                window.append((doc, start, ids[:n], total))
                left -= n
                if n < len(ids):
                    self.parts.append((doc, start + n, ids[n:], total))
            self.held -= size
            yield from self._emit(window)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, rows: int = 4096) -> DataFrame:
    """One row per piece of a document: where it starts there, its length and checksum, its sequence and offset.

    ``tokenizer`` is the path of the tokenizer's definition, readable on the executors;
    ``with_ids`` adds the piece's token ids.
    """
    fields = [("doc_id", T.LongType())] + [(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(("token_ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    names = schema.names

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        columns = [
            pa.array([m[0] for m in made], pa.int64()),
            pa.array([m[1] for m in made], pa.int64()),
            pa.array([len(m[2]) for m in made], pa.int64()),
            pa.array([zlib.crc32(m[2].astype("<u4").tobytes()) for m in made], pa.int64()),
            *(pa.array([m[j] for m in made], pa.int64()) for j in (3, 4, 5)),
        ]
        if with_ids:
            columns.append(pa.array([m[2].astype(np.int32) for m in made], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer, end_id)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        made: list[tuple] = []
        for part in (p for batch in batches for p in runs(batch, "text", TOGETHER)):
            ids, ends = words.encode(part.column("text"))
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                made += packer.add(doc, ids[ends[i] : ends[i + 1]])
                if len(made) >= rows:
                    yield batch_of(made)
                    made = []
        made += packer.finish()
        if made:
            yield batch_of(made)
        del words
        give_back()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)
