"""Exact substring dedup: suffixes sorted by a difference-cover algorithm.

Every ``length``-byte string that also starts in a document of smaller id is
removed from the bytes of the later one. Equal strings must meet, so each window
of ``length`` bytes is routed by its anchor, the gram of ``GRAM`` bytes with the
smallest hash in it: a run of windows with one anchor is one stretch of text.
Anchors that occur in one document only are left out first.

Spark aggregates equal stretches and routes the distinct ones by anchor. A block
of them is sorted by the difference-cover method: the triples at places 1 and 2
modulo 3 are sorted and named, the names are sorted by recursion, the remaining
suffixes are sorted by one byte and their successor's rank and merged in. Windows
that are neighbours in that order and agree in their first ``length`` bytes are
one class, whose smallest document is joined back to all occurrences.

An anchor at the edge of a passage that many documents share has another stretch
in each of them. Keys with more than ``KEY_BYTES`` of stretches could outgrow a
block, so the windows of their distinct ones meet one by one instead, by an
aggregate over each window's bytes, which spreads over all tasks.

Whole copies of an earlier document never enter the search: all their windows
occur in it.

Defined cases: a null text has no bytes. Matches never cross documents. Rows
without id neither remove nor lose bytes. Rows that repeat an id are one
document to the others and never remove each other's bytes; what is found in one
of their texts is cut out of that text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .textkit import _power_tables, mix, runs, text_buffer

GRAM = 20
#: Bytes of text whose anchors are counted together.
FLUSH = 8 << 20
#: Longest stretch of one text handled at once; also keeps places within 24 bits.
SEGMENT = 8 << 20
#: Bits of the broadcast anchor filter (16 MB), each for one remainder of a key. It lets some unique
#: anchors through, which the search then leaves out; with many more anchors a join filters as well.
FILTER_BITS = 1 << 27
FILTER_ROWS = FILTER_BITS >> 3
BROADCAST_ROWS = 300_000
#: Bytes of stretches for each block, and of one key's occurrences beyond which its windows are spread.
BLOCK_BYTES = KEY_BYTES = 1 << 20
#: A row: its id and the hash of its text, as rows may repeat an id.
ROW = ["doc_id", "th"]
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` entries."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor key, row, first window's place and number of windows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(keyed, length - GRAM + 1)
    place = (least & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + length <= offsets[row + 1]
    fresh = np.empty(len(least), bool)
    fresh[0] = True
    fresh[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(least)))
    kept = inside[begin]
    begin, count = begin[kept], count[kept]
    return (least[begin] >> np.uint64(24)).astype(np.int64), row[begin], begin, count


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """(bytes, offsets, ids and text hashes, place of each row's first byte in its text) with bounded bytes."""
    for part in runs(batch, "text"):
        data, offsets = text_buffer(part.column("text"))
        ids = part.column("doc_id").to_numpy(), part.column("th").to_numpy()
        if len(data) <= SEGMENT:
            yield data, offsets, ids, np.zeros(len(ids[0]), np.int64)
        else:  # one long text: windows that start in a segment need the bytes after it
            for at in range(0, len(data), SEGMENT):
                piece = data[at : at + SEGMENT + length - 1]
                yield piece, np.array([0, len(piece)]), ids, np.array([at])


def _common_anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(key): anchors that more than one document may hold."""

    def blobs(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(held)  # (key, row) in one number each, so equal keys are neighbours
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        key, row = pairs[order, 0], pairs[order, 1]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        several = np.zeros(len(key), bool)
        several[:-1] = (key[1:] == key[:-1]) & (row[1:] != row[:-1])
        owner = np.cumsum(first) - 1
        many = np.bincount(owner, several, int(first.sum())) > 0
        marked = (key[first] << 1) | many
        at = key[first] % buckets
        order = np.argsort(at, kind="stable")
        marked, at = marked[order], at[order]
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        values = [x.tobytes() for x in np.split(marked, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(at[cuts].astype(np.int32)), pa.array(values, pa.binary())], ["bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0
        for batch in batches:
            for data, offsets, ids, _ in _parts(batch, length):
                key, row, _, _ = stretches(data, offsets, length)
                held.append(np.column_stack([key, row + base]))
                size += len(data)
                base += len(ids[0]) if len(offsets) > 2 or len(data) <= SEGMENT else 0
                if size > FLUSH:
                    yield blobs(held)
                    held, size = [], 0
            base += 1
        if held and sum(map(len, held)):
            yield blobs(held)

    def several(table):
        marked = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64)
        key, n = np.unique(marked >> 1, return_counts=True)
        again = np.union1d(key[n > 1], marked[(marked & 1) == 1] >> 1)
        return pa.table([pa.array(again, pa.int64())], ["key"])

    return docs.mapInArrow(run, "bucket int, keys binary").groupBy("bucket").applyInArrow(several, "key long")


def _filter(anchors: DataFrame) -> np.ndarray:
    """The bitmap of the anchors' keys, made in blocks by tasks."""
    width = FILTER_BITS >> 8

    def block(key, table):
        bits = np.zeros(width, np.uint8)
        bits[table["bit"].to_numpy() % width] = 1
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    bit = F.pmod("key", F.lit(FILTER_BITS)).alias("bit")
    keyed = anchors.select(bit).distinct().withColumn("block", F.floor(F.col("bit") / width))
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in keyed.groupBy("block").applyInArrow(block, "block long, bits binary").collect():
        out[r["block"] * (width >> 3) : (r["block"] + 1) * (width >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _occurrences(docs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, th, start, content, low, high) of every stretch whose anchor is common.

    Of equal contents in a batch the first row alone has low and high, their smallest and largest document; the others' are null.
    """
    few = anchors.count() <= FILTER_ROWS
    seen = docs.sparkSession.sparkContext.broadcast(_filter(anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seen.value
        for batch in batches:
            for data, offsets, ids, place in _parts(batch, length):
                key, row, begin, count = stretches(data, offsets, length)
                bit = key % FILTER_BITS
                common = (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                key, row, begin, count = key[common], row[common], begin[common], count[common]
                size = count + length - 1
                ends = np.cumsum(size)
                flat = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
                content = pa.BinaryArray.from_buffers(
                    pa.binary(), len(key), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
                )
                start, doc = begin - offsets[row] + place[row], ids[0][row]
                same = content.dictionary_encode().indices.to_numpy()
                lead = np.unique(same, return_index=True)[1]
                low, high, again = doc[lead], doc[lead], np.ones(len(same), bool)
                np.minimum.at(low, same, doc)
                np.maximum.at(high, same, doc)
                again[lead] = False
                ends_of = [pa.array(x[same], mask=again) for x in (low, high)]
                columns = [pa.array(key), pa.array(doc), pa.array(ids[1][row]), pa.array(start), content, *ends_of]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "th", "start", "content", "low", "high"])

    made = docs.mapInArrow(run, "key long, doc_id long, th long, start long, content binary, low long, high long")
    return made if few else made.join(anchors, "key", "left_semi")


def suffix_order(s: np.ndarray, reach: int, covered: int = 1) -> np.ndarray:
    """Ranks of all suffixes of s (values above 0), right at least for their first ``reach`` symbols.

    The difference-cover recursion: names of sampled triples, ranks of their string, then the others merged in.
    """
    n = len(s)
    t = np.zeros(n + 4, np.int64)
    t[:n] = s
    if n < 3:
        return np.argsort(np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)) if n else np.zeros(0, np.int64)
    first, second = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    wide = int(t.max()) + 1
    if wide < 1 << 20:
        key = (t[sample] * wide + t[sample + 1]) * wide + t[sample + 2]
    else:  # two steps where three names do not fit one number
        pair = np.unique(t[sample] * wide + t[sample + 1], return_inverse=True)[1]
        key = pair * wide + t[sample + 2]
    names, name = np.unique(key, return_inverse=True)
    if len(names) < len(sample) and covered * 3 < reach:
        ranks = suffix_order(name + 1, reach, covered * 3)
    else:
        ranks = np.empty(len(sample), np.int64)
        ranks[np.argsort(name, kind="stable")] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = ranks + 1
    rest = np.arange(0, n, 3)
    span = len(sample) + 2
    by_one = t * span + np.append(rank[1:], 0)  # a byte and the rank after it
    rest = rest[np.argsort(by_one[rest], kind="stable")]
    sampled = np.empty(len(sample), np.int64)
    sampled[ranks] = sample
    sampled = sampled[sampled < n]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    pairs = t[:-2] * wide + t[1:-1]
    if wide * wide * span >= 1 << 62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    by_two = pairs * span + rank[2:]
    below = np.searchsorted(by_one[ones], by_one[rest]) + np.searchsorted(by_two[twos], by_two[rest])
    below = np.maximum.accumulate(below)  # suffixes that agree beyond reach have no set order
    out = np.empty(n, np.int64)
    at = below + np.arange(len(rest))
    out[rest] = at
    free = np.ones(n, bool)
    free[at] = False
    out[sampled] = np.flatnonzero(free)
    return out


def smallest_documents(contents: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, smallest document) of every window of the contents; low is each content's smallest document."""
    sizes = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(contents)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.repeat(np.cumsum(sizes) - sizes, windows) + offset
    order = np.argsort(suffix_order(data.astype(np.int64) + 1, length)[place], kind="stable")
    owner, offset, place = owner[order], offset[order], place[order]
    same = np.ones(max(len(place) - 1, 0), bool)
    for j in range(length):
        live = np.flatnonzero(same)
        same[live] = data[place[live] + j] == data[place[live + 1] + j]
    group = np.cumsum(np.append(True, ~same)[: len(place)]) - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, low[owner])
    return owner, offset, least[group]


def _verdicts(contents: DataFrame, length: int, buckets: int) -> DataFrame:
    """(key, ck, lo, hi, least): windows lo..hi of a content that start in document ``least`` and in a later one."""

    def judge(table):
        contents, key, ck = table["content"].to_pylist(), table["key"].to_numpy(), table["ck"].to_numpy()
        low, high = table["low"].to_numpy(), table["high"].to_numpy()
        owner, offset, least = smallest_documents(contents, low, length)
        useful = least < high[owner]
        owner, offset, least = owner[useful], offset[useful], least[useful]
        order = np.lexsort((offset, owner))
        owner, offset, least = owner[order], offset[order], least[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (least[1:] != least[:-1])
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(owner)) - 1 if len(begin) else begin
        columns = [key[owner[begin]], ck[owner[begin]], offset[begin], offset[end], least[begin]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["key", "ck", "lo", "hi", "least"])

    bucket = F.pmod("key", F.lit(buckets)).alias("bucket")
    return contents.select(bucket, "key", "ck", "content", "low", "high").groupBy("bucket").applyInArrow(judge, "key long, ck long, lo long, hi long, least long")


def _frequent_keys(met: DataFrame) -> DataFrame:
    """(key): keys whose occurrences hold more than KEY_BYTES, so that others' distinct contents hold less; at most one for each KEY_BYTES of met.

    Whether their contents are distinct is not asked: rows of met stay where they are, and each batch's distinct contents are routed.
    """
    size = F.sum(F.octet_length("content")).alias("b")
    return saved(met.groupBy("key").agg(size).where(F.col("b") > KEY_BYTES).select("key"), "frequent-keys")


def _spread_verdicts(contents: DataFrame, length: int) -> DataFrame:
    """_verdicts without blocks: windows of equal bytes meet by an aggregate."""
    places = F.explode(F.sequence(F.lit(0), F.octet_length("content") - length)).alias("at")
    windows = contents.select("key", "ck", "low", "high", "content", places).withColumn("window", F.substring("content", F.col("at") + 1, F.lit(length)))
    least = windows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").drop("most")
    useful = windows.select("key", "ck", "high", "at", "window").join(least, "window").where("least < high")
    place = F.row_number().over(Window.partitionBy("key", "ck", "least").orderBy("at"))
    runs_of = useful.select("key", "ck", "least", F.col("at").cast("long").alias("at")).withColumn("run", F.col("at") - place)
    return runs_of.groupBy("key", "ck", "least", "run").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select("key", "ck", "lo", "hi", "least")


def _cut(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, copy, found) as doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            raw, out = data.tobytes(), []
            rows = zip(batch.column("copy").to_pylist(), batch.column("found").to_pylist(), strict=True)
            for i, (copy, found) in enumerate(rows):
                text = raw[offsets[i] : offsets[i + 1]]
                spans: list[list[int]] = [[0, len(text)]] if copy else []
                for f in sorted((f["from"], f["to"]) for f in found or ()):
                    if spans and f[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], f[1])
                    else:
                        spans.append([f[0], f[1]])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeated_strings(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row."""
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").withColumn("th", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    buckets = max(48, int(size >> 23))
    long_enough = docs.where(F.octet_length("text") >= length).where("doc_id is not null")
    texts = long_enough.select("doc_id", "th", F.sha2("text", 256).alias("sha"))
    firsts = texts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").select("sha", "first")
    copies = saved(texts.join(firsts, "sha").where("doc_id != first").select(*ROW, F.lit(True).alias("copy")).distinct(), "whole-copies")
    few = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    searched = long_enough.join(few, ROW, "left_anti")
    anchors = saved(_common_anchors(searched, length, buckets), "anchors")
    met = saved(_occurrences(searched, anchors, length).withColumn("ck", F.xxhash64("content")), "stretches")
    blocks_bytes = met.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b")).first()["b"]
    blocks_of = max(48, int(blocks_bytes // BLOCK_BYTES))
    # Spark filters by key before it aggregates, so what it filters has to be distinct in each batch already
    distinct = met.where("low is not null").select("key", "content", "low", "high", "ck")
    contents = distinct.groupBy("key", "content").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("ck").alias("ck"))
    frequent = _frequent_keys(met)
    if frequent.isEmpty():
        verdicts = saved(_verdicts(contents, length, blocks_of), "verdicts")
    else:
        blocks = saved(_verdicts(contents.join(F.broadcast(frequent), "key", "left_anti"), length, blocks_of), "verdicts")
        spread = saved(contents.join(F.broadcast(frequent), "key", "left_semi"), "spread-contents")
        verdicts = blocks.unionByName(saved(_spread_verdicts(spread, length), "spread-verdicts"))
    hits = met.select("key", "ck", *ROW, "start").join(verdicts, ["key", "ck"]).where("least < doc_id")
    span = F.struct((F.col("start") + F.col("lo")).alias("from"), (F.col("start") + F.col("hi") + length).alias("to"))
    found = hits.groupBy(*ROW).agg(F.collect_list(span).alias("found"))
    return _cut(docs.join(few, ROW, "left").join(found, ROW, "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "found"))
