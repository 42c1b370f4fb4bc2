"""Hard negatives by norm-bucketed search.

Rows are sorted by norm across the cluster and cut into buckets of bounded size; a
few buckets in a row are a shard. Anchors are cut into blocks in the same way. A
score is at most the product of both norms (Cauchy-Schwarz), so a block leaves out
every shard, and inside a task every bucket, whose largest norm cannot reach what
the block still needs: for each anchor and window the larger of the window's lower
limit and the running k-th best score. Each block first meets the shard of largest
norms, which gives the running scores that its other shards are pruned by; inside a
task they rise from bucket to bucket. Bounds are widened by a margin and compared
non-strictly, so equal scores, which the smaller id decides, are never missed.

Positives are searched in the same way over rows sorted by label, then norm, where a
block meets only shards whose labels overlap its own. A task holds one block and
one shard, whatever the labels' sizes.

Products are exact: components are integers held in doubles, and scores are computed by
matrix products while the product of norms is below 2**53, else in Python's integers.

Defined cases: rows take no part whose label, id or vector is null or whose vector
holds null or non-finite components (or ones beyond 1e300). Vectors of different
length never meet. Rows of one id are rows of their own, but no row is its own id's
positive or negative; each anchor row of a repeated id gives its own result. An empty
vector scores 0. Scores beyond the long range are held at its ends. A positive with a
negative score has an empty window. Ties go to the smaller id. An empty table gives no row.
Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved

#: Bytes of a bucket's vectors, buckets of a shard, bytes of a block's vectors.
BUCKET_BYTES, SHARD, BLOCK_BYTES = 1 << 20, 8, 1 << 19
#: Rows of a bucket or block at most.
MOST_ROWS = 4096
_MARGIN = 1 + 1e-9
_LEAST, _MOST = -(2**63), 2**63 - 1
_PACKED = "part long, shard long, d int, n int, top double, low long, high long, keys binary, ids binary, labels binary, queries binary, lows binary, highs binary, vectors binary"


def _packed(rows: DataFrame, order: list[str | Column], limit: int, parts_of: int) -> DataFrame:
    """Rows (key, vec_id, label, v, and for queries q, lo, hi) in the given order, cut into packed parts of at most ``limit`` bytes.

    Parts are numbered within Spark's partition; ``parts_of`` of them in a row share a shard number.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, n_held, length = TaskContext.get().partitionId() << 32, 0, [], 0, -1

        def pack() -> pa.RecordBatch:
            nonlocal held, n_held, made
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            vectors = table.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            labels = table.column("label").to_numpy()
            column = lambda c: np.asarray(table.column(c).to_numpy(zero_copy_only=False), np.int64).tobytes()
            lists = [np.asarray(table.column(c).flatten().to_numpy(zero_copy_only=False), np.int64).tobytes() for c in ("lo", "hi")] if "lo" in names else [b"", b""]
            counts = table.column("lo").value_lengths().to_numpy().astype(np.int64).tobytes() if "lo" in names else b""
            row = {"part": first + made, "shard": first + made // parts_of, "d": length, "n": table.num_rows, "top": float(max(table.column("norm").to_pylist())), "low": int(labels.min()), "high": int(labels.max()),
                   "keys": column("key"), "ids": column("vec_id"), "labels": column("label"), "queries": counts, "lows": lists[0], "highs": lists[1], "vectors": vectors.tobytes()}
            held, n_held, made = [], 0, made + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            sizes = batch.column("d").to_numpy()
            start = 0
            while start < len(sizes):
                if held and sizes[start] != length:
                    yield pack()
                length = int(sizes[start])
                differ = np.flatnonzero(sizes[start:] != length)
                room = min(MOST_ROWS, max(1, limit // (8 * max(1, length)))) - n_held
                take = min(int(differ[0]) if len(differ) else len(sizes) - start, room)
                held.append(batch.slice(start, take))
                n_held, start = n_held + take, start + take
                if take == room:
                    yield pack()
        if held:
            yield pack()

    names = rows.columns
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _PACKED.split(", ")])
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _PACKED)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """All inner products, exact."""
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    left, right = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b))
    exact = left @ right.T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.array([[min(max(x, _LEAST), _MOST) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


class Best:
    """The k best rows of each query of a block so far, by score and then id."""

    def __init__(self, block: dict, k: int, same: bool, limits: np.ndarray | None = None):
        self.k, self.same = k, same
        self.keys, self.ids, self.labels = (_longs(block[c]) for c in ("keys", "ids", "labels"))
        self.vectors = np.frombuffer(block["vectors"], np.float64).reshape(len(self.keys), block["d"])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        counts = _longs(block["queries"]) if not same else np.ones(len(self.keys), np.int64)
        self.row = np.repeat(np.arange(len(self.keys)), counts)
        self.number = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        self.low = np.full(len(self.row), _LEAST) if same else _longs(block["lows"])
        self.high = np.full(len(self.row), _MOST) if same else _longs(block["highs"])
        #: Scores below it are not wanted any more.
        self.limit = self.low.copy() if limits is None else np.maximum(self.low, limits)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, score, id
        self.compared = 0

    def need(self) -> float:
        """The least norm of a row that some query could still want."""
        if not len(self.row):
            return np.inf
        asks = self.limit > 0
        least = np.where(asks, self.limit / np.maximum(self.norms[self.row] * _MARGIN, 1e-300), 0.0)
        return float(least.min())

    def meet(self, bucket: dict) -> None:
        bound = self.norms[self.row] * bucket["top"] * _MARGIN
        wanted = np.flatnonzero((self.limit <= bound) | (self.limit <= 0))
        if not len(wanted):
            return
        ids, labels = _longs(bucket["ids"]), _longs(bucket["labels"])
        vectors = np.frombuffer(bucket["vectors"], np.float64).reshape(len(ids), bucket["d"])
        for start in range(0, len(wanted), 256):
            asked = wanted[start : start + 256]
            rows, place = np.unique(self.row[asked], return_inverse=True)
            score = _scores(self.vectors[rows], vectors, float(self.norms[rows].max(initial=0.0)) * bucket["top"] * _MARGIN)
            self.compared += score.size
            other = (self.labels[rows][:, None] == labels) == self.same
            other &= self.ids[rows][:, None] != ids
            mine = score[place]
            good = other[place] & (mine >= self.limit[asked][:, None]) & (mine <= self.high[asked][:, None])
            q, c = np.nonzero(good)
            self._keep(asked[q], mine[q, c], ids[c])

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.zeros(len(self.row), bool)
        touched[query] = True
        old = touched[self.found[0]]
        query, score, ids = (np.concatenate([x, f[old]]) for x, f in zip((query, score, ids), self.found, strict=True))
        order = np.lexsort((ids, ~score, query))  # ~ turns the order round, without overflow
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kth = place == self.k - 1
        self.limit[query[kth]] = np.maximum(self.limit[query[kth]], score[kth])
        kept = place < self.k
        self.found = tuple(np.concatenate([f[~old], x[kept]]) for x, f in zip((query, score, ids), self.found, strict=True))


_FOUND = "block long, key long, anchor_id long, q int, score long, id long, need double, limits binary"


def _search(blocks: DataFrame, shards: DataFrame, k: int, same: bool) -> DataFrame:
    """(key, anchor_id, q, score, id): the k best rows of every query, at least."""
    # a row for each shard, some 50 bytes; a shard holds SHARD * BUCKET_BYTES of vectors, so this is a millionth of the table
    known = shards.groupBy("shard", "d").agg(F.max("top").alias("top"), F.min("low").alias("low"), F.max("high").alias("high"))
    known = known.agg(F.collect_list(F.struct("top", "shard", "d", "low", "high")).alias("known"))

    def meets(s: Column) -> Column:
        fits = s["d"] == F.col("d")
        if same:
            return fits & (s["low"] <= F.col("high")) & (s["high"] >= F.col("low"))
        return fits & ~((s["low"] == s["high"]) & (F.col("low") == F.col("high")) & (s["low"] == F.col("low")))

    asked = blocks.withColumnRenamed("shard", "_group").join(F.broadcast(known), how="cross").withColumn("known", F.filter("known", meets))  # one row
    first = asked.withColumn("shard", F.array_max("known")["shard"]).where("shard is not null")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in left.to_pylist():
            best = Best(block, k, same, _longs(block["limits"]) if block.get("limits") is not None else None)
            for bucket in sorted(right.to_pylist(), key=lambda b: (-b["top"], b["part"])):
                if bucket["d"] == block["d"]:  # a shard may hold the last bucket of one length and the first of another
                    best.meet(bucket)
            query, score, ids = best.found
            rows = best.row[query]
            n = len(query)
            out.append(pa.table([pa.array(np.full(n, block["part"])), pa.array(best.keys[rows]), pa.array(best.ids[rows]), pa.array(best.number[query].astype(np.int32)), pa.array(score), pa.array(ids), pa.nulls(n, pa.float64()), pa.nulls(n, pa.binary())], names))
            if block.get("limits") is None:
                out.append(pa.table([[block["part"]], [None], [None], [None], [None], [None], [best.need()], [best.limit.tobytes()]], schema=schema))
        return pa.concat_tables(x.cast(schema) for x in out) if out else schema.empty_table()

    names = [c.split()[0] for c in _FOUND.split(", ")]
    schema = pa.schema([(n, {"q": pa.int32(), "need": pa.float64(), "limits": pa.binary()}.get(n, pa.int64())) for n in names])
    keyed = ["part", "d", "n", "keys", "ids", "labels", "queries", "lows", "highs", "vectors", "shard"]
    held = shards.select("part", "d", "top", "ids", "labels", "vectors", "shard")

    def round_of(pairs: DataFrame) -> DataFrame:
        # a shard's buckets go to the blocks that need them: pairs of part and shard, each a group of bounded size
        right = pairs.select(F.col("part").alias("_block"), F.col("shard").alias("_shard")).join(held, F.col("_shard") == F.col("shard")).drop("shard")
        return pairs.groupBy("part", "shard").cogroup(right.groupBy("_block", "_shard")).applyInArrow(run, _FOUND)

    opened = saved(round_of(first.select(*keyed)), "first-scores")
    limits = opened.where("limits is not null").select(F.col("block").alias("part"), "need", "limits")
    rest = asked.join(first.select("part", F.col("shard").alias("_first")), "part").join(limits, "part")
    rest = rest.withColumn("shard", F.explode(F.filter("known", lambda s: (s["shard"] != F.col("_first")) & (s["top"] >= F.col("need")))["shard"]))
    other = round_of(rest.select(*keyed, "limits"))
    columns = ["key", "anchor_id", "q", "score", "id"]
    return opened.where("limits is null").select(*columns).unionByName(other.select(*columns))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, of the k that each shard at most has for it."""
    place = F.row_number().over(Window.partitionBy("key", "q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine_hard_negatives(
    embeddings: DataFrame, anchors: str = "vec_id % 50 = 0", label: str = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end",
    positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive the best negatives of its window.

    A negative's score lies between the two percentages of the positive's, both included. ``anchors`` and
    ``label`` are expressions over vec_id and label.
    """
    rows = embeddings.selectExpr("cast(vec_id as long) as vec_id", "cast(label as long) as label", "cast(embedding as array<double>) as e")
    rows = rows.where("vec_id is not null and label is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) <= 1e300)")
    whole = F.transform("e", lambda x: _floor(x * scale))
    rows = rows.select("vec_id", F.expr(label).cast("long").alias("label"), whole.alias("v")).where("label is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    rows = rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "v", F.size("v").alias("d"), norm.alias("norm"))
    rows = saved(rows, "rows-with-norms")
    asking = rows.where(anchors)
    by_label, by_norm = ["d", "label", F.desc("norm"), "vec_id", "key"], ["d", F.desc("norm"), "vec_id", "key"]
    near = saved(_packed(rows, by_label, BUCKET_BYTES, SHARD), "buckets-by-label")
    blocks = saved(_packed(asking, by_label, BLOCK_BYTES, 1), "anchors-by-label")
    found = saved(_best(_search(blocks, near, positives, True), positives), "positives")
    for done in (near, blocks):
        dropped(done)
    limits = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # as many as positives
    # ceil(low * s / 100) and floor(high * s / 100) in decimals, so that nothing overflows
    share = lambda s, percent: s.cast("decimal(38,0)") * percent / F.lit(100).cast("decimal(38,0)")
    low = F.transform("p", lambda p: F.ceil(share(p["score"], low_percent)).cast("long"))
    high = F.transform("p", lambda p: F.floor(share(p["score"], high_percent)).cast("long"))
    asking = asking.join(limits, "key").withColumns({"lo": low, "hi": high}).drop("p")
    far = saved(_packed(rows, by_norm, BUCKET_BYTES, SHARD), "buckets-by-norm")
    blocks = saved(_packed(asking, by_norm, BLOCK_BYTES, 1), "anchors-by-norm")
    best = _best(_search(blocks, far, negatives, False), negatives)
    positive = found.select("key", F.col("rank").alias("q"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = best.join(positive, ["key", "q"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor(x: Column) -> Column:
    """The floor of a double as a double, also where a long could not hold it (such doubles are integers)."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
