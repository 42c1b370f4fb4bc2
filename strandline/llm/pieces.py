"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays.

Texts are cut wherever no piece of the vocabulary holds the two neighbouring
characters side by side: no merge crosses such a place, so the words between cuts
are encoded apart and each distinct one once. All new words of a slice of texts
lie in one flat array of symbols. A round takes the best pair rank of every word
(a segmented minimum), merges the leftmost pairs that have it in all words at
once, and compacts the arrays; words without a mergeable pair leave. Pairs of one
rank are merged together only as far as sequential merging would come to the same:
up to the first whose new neighbours rank as high. After ``SLOW_ROUNDS`` rounds that merge
less than one of ``PACE`` symbols (long runs of spaces, or the last merges of words of
many thousand letters) the words left go on with a heap, which merges in the same order.

The model must be a BPE model without normalisation rules that escapes white
space, adds a leading space and falls back to bytes; others are refused.

Defined cases: a null or empty text is the begin and end id alone and decodes to
the empty text. Texts of any length are taken whole, slices hold ``SLICE`` bytes or
one text. Repeated rows and rows without id are encoded one by one. Only the text
is read, so other columns may have any name; an empty table gives no row. Ties of
rank go to the left. A decoded byte that is no UTF-8 becomes U+FFFD.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate
from .textkit import runs, text_buffer

#: Bytes of texts encoded together.
SLICE = 1 << 20
#: Words and ids remembered by a task, some 100 MB at most.
REMEMBERED, REMEMBERED_IDS = 300_000, 3_000_000
#: A round is slow with more symbols than this for each merge; so many of them are made.
PACE, SLOW_ROUNDS = 512, 16

SPACE = "▁"
_NEVER = np.int32(2**31 - 1)


class PieceTokenizer:
    """Encodes and decodes as the model at ``path`` does, with begin and end ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if model.trainer_spec.model_type != 2 or not plain or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model is no BPE model over unchanged text with a leading space")
        known = {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
        if any(p.type not in known for p in model.pieces) or sum(p.type == kinds.BYTE for p in model.pieces) != 256:
            raise ValueError("the model has pieces of another kind than normal, byte and control, or lacks bytes")
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p.piece == x) for x in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        self.byte_ids = np.zeros(256, np.uint32)
        normal: dict[str, tuple[int, float]] = {}
        texts = []
        self.leading = np.zeros(len(model.pieces), bool)
        self.silent = np.zeros(len(model.pieces), bool)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                texts.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                normal[p.piece] = (i, p.score)
                self.leading[i] = p.piece.startswith(SPACE)
                texts.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.silent[i] = p.type == kinds.CONTROL
                texts.append(b"" if p.type == kinds.CONTROL else model.trainer_spec.unk_surface.encode())
        self.is_byte = np.zeros(len(texts), bool)
        self.is_byte[self.byte_ids] = True
        self.text_at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._learn_pairs(normal, len(model.pieces))
        self._clear()

    def _learn_pairs(self, normal: dict[str, tuple[int, float]], size: int) -> None:
        letters = sorted({c for piece in normal for c in piece})
        #: Class of each code point: 0 where no piece holds it.
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.classes[0x20] = self.classes[ord(SPACE)]
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        symbols = {piece: i for piece, (i, _) in normal.items()}
        for k, c in enumerate(letters):
            symbols.setdefault(c, size + k)
        self.symbol_of = np.array([0] + [symbols[c] for c in letters], np.int64)
        self.letter_bytes = [c.encode() for c in letters]
        self.size, self.symbols = size, size + len(letters)
        ranks = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        keys, to, rank = [], [], []
        for piece, (i, score) in normal.items():
            points = self.classes[[ord(c) for c in piece]]
            self.joined[points[:-1], points[1:]] = True
            for at in range(1, len(piece)):
                left, right = symbols.get(piece[:at]), symbols.get(piece[at:])
                if left is not None and right is not None:
                    keys.append(left * self.symbols + right)
                    to.append(i)
                    rank.append(ranks[score])
        order = np.argsort(keys)
        self.keys, self.to, self.rank = np.array(keys, np.int64)[order], np.array(to, np.int64)[order], np.array(rank, np.int32)[order]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (the lower the earlier; a large number without a piece) and the symbol it makes."""
        key = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER), self.to[at]

    def merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of every word until no pair is left: symbols and their words, in order."""
        rank = np.full(len(symbol), _NEVER, np.int32)
        to = np.zeros(len(symbol), np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same], to[same] = self.pairs(symbol[same], symbol[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        slow = 0
        while slow <= SLOW_ROUNDS:
            # words without a pair leave
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            if not len(starts):
                break
            sizes = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            busy = np.repeat(least < _NEVER, sizes)
            done.append((symbol[~busy], word[~busy]))
            least = np.repeat(least, sizes)[busy]
            symbol, word, rank, to = symbol[busy], word[busy], rank[busy], to[busy]
            if not len(word):
                break
            # the leftmost pairs of the word's best rank that do not overlap
            at = np.flatnonzero(rank == least)
            fresh = np.append(True, np.diff(at) > 1)
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]
            at = at[self._as_in_turn(at, symbol, word, least, to)]
            slow += len(symbol) > PACE * len(at)
            symbol[at] = to[at]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            place = np.cumsum(kept) - 1
            symbol, word, rank, to = symbol[kept], word[kept], rank[kept], to[kept]
            changed = np.concatenate([place[at], place[at] - 1])
            changed = changed[changed >= 0]
            rank[changed] = _NEVER
            changed = changed[changed + 1 < len(word)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], to[changed] = self.pairs(symbol[changed], symbol[changed + 1])
        if len(word):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            for part, which in zip(np.split(symbol, starts[1:]), word[starts], strict=True):
                rest = self._merge_by_heap(part)
                done.append((rest, np.full(len(rest), which)))
        symbol, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (symbol, word)
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order]

    def _as_in_turn(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray, least: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Which merges of a round one after another would also make: those up to a word's first that brings a pair as good."""
        last, made = len(symbol) - 1, to[at]
        merged_before = np.append(False, np.diff(at) == 2)  # the symbol to the left is this round's own
        before = np.where(merged_before, np.append(0, made[:-1]), symbol[np.maximum(at - 1, 0)])
        has_before, has_after = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at]), (at < last - 1) & (word[np.minimum(at + 2, last)] == word[at])
        left, _ = self.pairs(before, made)
        right, _ = self.pairs(made, symbol[np.minimum(at + 2, last)])
        stops = (has_before & (left <= least[at])) | (has_after & (right <= least[at]))
        earlier = np.cumsum(stops) - stops
        first = np.append(True, word[at][1:] != word[at][:-1])
        return earlier == earlier[first][np.cumsum(first) - 1]

    def _merge_by_heap(self, symbols: np.ndarray) -> np.ndarray:
        """The same order of merges for one word: best rank first, then leftmost."""
        s, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, to = self.pairs(symbols[:-1], symbols[1:])
        heap = [(r, i, s[i], s[i + 1], t) for i, (r, t) in enumerate(zip(rank.tolist(), to.tolist(), strict=True)) if r < _NEVER]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                pair = (s[i], s[j])
                if pair not in known:
                    r, t = self.pairs(np.array([pair[0]]), np.array([pair[1]]))
                    known[pair] = (int(r[0]), int(t[0]))
                if known[pair][0] < _NEVER:
                    heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue
            s[i], s[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in s if x >= 0], np.int64)

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.flat[:2] = self.begin, self.end
        self.used = 2
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.starts[:2], self.sizes[:2] = (0, 1), 1

    def _remember(self, new: list[bytes]) -> None:
        """Encodes words, all of them in one flat array."""
        text = b"".join(new).decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        word = np.searchsorted(np.cumsum([len(w) for w in new]), np.cumsum(width) - width, "right")
        kind = self.classes[points]
        # a character that no piece holds is a word of its own: symbol -1, its bytes are its ids
        symbol, word = self.merge(np.where(kind > 0, self.symbol_of[kind], -1), word)
        count = np.ones(len(symbol), np.int64)
        spelt = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        for i in spelt.tolist():
            count[i] = len(new[word[i]]) if symbol[i] < 0 else len(self.letter_bytes[symbol[i] - self.size])
        ids = np.repeat(symbol, count)
        ends = np.cumsum(count)
        for i in spelt.tolist():
            raw = new[word[i]] if symbol[i] < 0 else self.letter_bytes[symbol[i] - self.size]
            ids[ends[i] - count[i] : ends[i]] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        sizes = np.bincount(word, count, len(new)).astype(np.int64)
        k = len(self.words) + 2
        while k + len(new) > len(self.starts):
            self.starts, self.sizes = np.append(self.starts, self.starts * 0), np.append(self.sizes, self.sizes * 0)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, self.flat * 0)
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[k : k + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[k : k + len(new)] = sizes
        self.used += len(ids)
        self.words.update(zip(new, range(k, k + len(new)), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, begin and end included, and the rows' offsets in them."""
        data, offsets = text_buffer(column)
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], 0x20)
        offsets = offsets + np.append(0, np.cumsum(some))
        if len(self.words) > REMEMBERED or self.used > REMEMBERED_IDS:
            self._clear()
        index, first = np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        if len(data):
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((data & 0xC0) != 0x80)  # a character's first byte
            kind = self.classes[points]
            pair = kind[:-1].astype(np.int32)
            pair *= len(self.joined)
            pair += kind[1:]
            cut = np.append(True, ~self.joined.ravel().take(pair))
            cut[np.searchsorted(at, offsets[offsets < len(data)])] = True
            edges = np.append(at[cut], len(data))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [w for w in distinct if w not in self.words]
            if new:
                self._remember(new)
            known = np.array([self.words[w] for w in distinct], np.int64)
            index = known[coded.indices.to_numpy()]
            first = np.searchsorted(edges, offsets)
        # each row begins with entry 0 and ends with entry 1
        places = np.column_stack([first[:-1], first[1:]]).ravel()
        index = np.insert(index, places, np.tile([0, 1], len(first) - 1))
        count = self.sizes[index]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.starts[index] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        rows = first + 2 * np.arange(len(first))
        return ids, np.append(0, ends)[rows]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all rows of ids, and the rows' offsets in them."""
        ids = ids.astype(np.int64)
        start, count = self.text_at[ids], np.diff(self.text_at)[ids]
        # a row's first piece that is not a control loses its leading space
        spoken = np.flatnonzero(~self.silent[ids])
        if len(spoken):
            first = spoken[np.minimum(np.searchsorted(spoken, offsets[:-1]), len(spoken) - 1)]
            first = first[(first >= offsets[:-1]) & (first < offsets[1:])]
            first = first[self.leading[ids[first]]]
            start[first] += 1
            count[first] -= 1
        ends = np.cumsum(count)
        data = self.text_bytes[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[offsets]
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            raw = self.is_byte[ids]
            rows = [self._mended(data[bounds[i] : bounds[i + 1]], np.repeat(raw[a:b], count[a:b])) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
            return np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(r) for r in rows]))
        return data, bounds

    @staticmethod
    def _mended(data: np.ndarray, raw: np.ndarray) -> bytes:
        """Each byte of a byte piece that is no part of a character becomes U+FFFD."""
        text, out, i = data.tobytes(), [], 0
        while i < len(text):
            for n in (1, 2, 3, 4):
                try:
                    text[i : i + n].decode()
                except UnicodeDecodeError:
                    continue
                if i + n <= len(text) and (raw[i : i + n] == raw[i]).all():
                    out.append(text[i : i + n])
                    i += n
                    break
            else:
                out.append(b"\xef\xbf\xbd")
                i += 1
        return b"".join(out)


def encode_pieces(docs: DataFrame, path: str, text: str = "text", name: str = "pieces", keep: list[str] | None = None) -> DataFrame:
    """Adds a struct of a text's ids (little-endian unsigned 32-bit integers), their number, and the text they decode to."""
    result = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def make() -> Callable[[pa.RecordBatch], pa.StructArray]:
        tokenizer = PieceTokenizer(path)

        def compute(batch: pa.RecordBatch) -> pa.StructArray:
            ids, rows = tokenizer.encode(batch.column(text))
            data, bounds = tokenizer.decode(ids, rows)
            return pa.StructArray.from_arrays([_binary(ids.astype("<u4").tobytes(), rows * 4), pa.array(np.diff(rows)), _binary(data.tobytes(), bounds).cast(pa.string())], names=["ids", "n_tokens", "decoded"])

        return compute

    return annotate(docs, make, result, name, keep, lambda batch: runs(batch, text, SLICE))


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds a struct with the text that a column of ids (little-endian unsigned 32-bit integers) decodes to; null ids: the empty text."""

    def make() -> Callable[[pa.RecordBatch], pa.StructArray]:
        tokenizer = PieceTokenizer(path)

        def compute(batch: pa.RecordBatch) -> pa.StructArray:
            raw = [b or b"" for b in batch.column(ids).to_pylist()]
            data, bounds = tokenizer.decode(np.frombuffer(b"".join(raw), "<u4"), np.append(0, np.cumsum([len(b) // 4 for b in raw])))
            return pa.StructArray.from_arrays([_binary(data.tobytes(), bounds).cast(pa.string())], names=["text"])

        return compute

    return annotate(df, make, T.StructType([T.StructField("text", T.StringType())]), name, None, lambda batch: runs(batch, ids, SLICE))


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(pa.binary())
