"""Codes of vectors: the nearest entry of each part's codebook, found in vantage-point trees.

Components become integers, vectors are cut into parts, and each part position has
a codebook whose entries start as the parts of the vectors with the smallest ids.
Rounds assign every part to its nearest entry and move each entry to the floor of
its parts' mean. A round is one pass over the saved integer vectors: tasks return
sums and counts by part and entry, Spark adds them up, and the driver sees one row
for each entry (its number does not depend on the number of vectors).

A part position's entries form a vantage-point tree: a node holds one entry and a
radius that parts the others into those near it and those beyond. Searching descends
with all parts of a batch at once, the likelier side first, and leaves a side out
where the triangle inequality shows that all in it are farther than the best so
far. Distances are square roots and so rounded: a node's radii are kept as the
least and largest distance of each side, widened by a margin, and a side is visited
whenever it could hold an entry as near as the best (non-strict), so ties stay. The
squared distance of every entry that is visited is computed in integers, and only
these decide, ties by the lower index.

Defined cases: vectors that are null or hold null or non-finite components are left
out. Components beyond what keeps a squared distance within a long (2**29 after
scaling with eight components a part) are held at that bound. Vectors of different
length have codebooks of their own, made in the same rounds; parts of a length that
does not divide evenly differ by one component. Repeated rows each count, also among
the first entries, and rows of one id are taken in order of their components. Rows
without id get codes but give no first entries (where a length has no id at all, codes
are empty and errors 0). Where there are fewer rows than
entries the codebook is smaller. An empty table gives no row. Only the three named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows looked up together.
TOGETHER = 8192
#: Relative widening of rounded distances.
_MARGIN = 1e-9


@dataclass
class _Node:
    entry: int
    near: _Node | None = None
    far: _Node | None = None
    #: Least and largest distance of each side's entries from this one, widened.
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


class VantagePointTree:
    """Exact nearest entries (integer rows) of many integer vectors at once."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._grow(list(range(len(entries))))
        self.visited = 0

    def _grow(self, members: list[int]) -> _Node | None:
        if not members:
            return None
        node, rest = _Node(members[0]), members[1:]
        if rest:
            gap = self.entries[rest] - self.entries[node.entry]
            distance = np.sqrt((gap * gap).sum(1).astype(np.float64))
            order = np.argsort(distance, kind="stable")
            half = (len(rest) + 1) // 2
            sides = [order[:half], order[half:]]
            low = [distance[s].min() * (1 - _MARGIN) if len(s) else np.inf for s in sides]
            high = [distance[s].max() * (1 + _MARGIN) if len(s) else -np.inf for s in sides]
            node.bounds = (low[0], high[0], low[1], high[1])
            node.near, node.far = (self._grow([rest[i] for i in s]) for s in sides)
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every row; ties go to the lower index."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.entries), np.int64)
        reach = np.full(len(x), np.inf)
        columns = np.ascontiguousarray(x.T, np.int64)

        def visit(node: _Node, rows: np.ndarray) -> None:
            self.visited += len(rows)
            squared = np.zeros(len(rows), np.int64)
            for column, value in zip(columns, self.entries[node.entry].tolist(), strict=True):
                gap = column[rows] - value
                gap *= gap
                squared += gap
            better = (squared < best[rows]) | ((squared == best[rows]) & (node.entry < index[rows]))
            won = rows[better]
            best[won], index[won] = squared[better], node.entry
            if node.near is None:
                return
            distance = np.sqrt(squared.astype(np.float64))
            reach[won] = distance[better] * (1 + _MARGIN)
            inner_low, inner_high, outer_low, outer_high = node.bounds
            inside = distance - inner_high <= outer_low - distance if node.far is not None else np.ones(len(rows), bool)
            for first in (True, False):
                mine = inside == first
                for side, low, high in ((node.near, inner_low, inner_high), (node.far, outer_low, outer_high))[:: 1 if first else -1]:
                    if side is not None:
                        d, r = distance[mine], rows[mine]
                        may = (d * (1 + _MARGIN) + reach[r] >= low) & (d * (1 - _MARGIN) - reach[r] <= high)
                        if may.any():
                            visit(side, r[may])

        if self.root is not None and len(x):
            visit(self.root, np.arange(len(x)))
        return index, best


def _cuts(d: int) -> list[int]:
    return [p * d // PARTS for p in range(PARTS + 1)]


def _matrix(batch: pa.RecordBatch, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, integer vectors) of at most TOGETHER rows from start on."""
    part = batch.column("parts").slice(start, TOGETHER)
    sizes = part.value_lengths().to_numpy()
    flat, ends = part.flatten().to_numpy(), np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, start + rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _trees(codebooks: dict[int, list[np.ndarray]]) -> dict[int, list[VantagePointTree]]:
    return {d: [VantagePointTree(b) for b in books] for d, books in codebooks.items()}


def _sums(rows: DataFrame, codebooks: dict[int, list[np.ndarray]]) -> DataFrame:
    """(d, part, entry, place, total, n): componentwise sums of the parts assigned to each entry, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(codebooks)
        total = {d: [np.zeros((len(b), b.shape[1]), object) for b in books] for d, books in codebooks.items()}
        count = {d: [np.zeros(len(b), np.int64) for b in books] for d, books in codebooks.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                for d, _, x in _matrix(batch, start):
                    cuts = _cuts(d)
                    for p, tree in enumerate(trees.get(d, [])):
                        part = x[:, cuts[p] : cuts[p + 1]]
                        index, _ = tree.nearest(part)
                        sums = np.zeros(total[d][p].shape, np.int64)  # of few rows, so within a long
                        np.add.at(sums, index, part)
                        total[d][p] += sums
                        count[d][p] += np.bincount(index, minlength=len(tree.entries))
        found = [
            (d, p, e, list(map(str, total[d][p][e])), int(count[d][p][e])) for d in total for p in range(PARTS) for e in range(len(count[d][p])) if count[d][p][e]
        ]
        if found:
            yield pa.RecordBatch.from_pylist([{"d": d, "part": p, "entry": e, "total": t, "n": n} for d, p, e, t, n in found], schema=schema)

    schema = pa.schema([("d", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("total", pa.list_(pa.string())), ("n", pa.int64())])
    partial = rows.select("parts").mapInArrow(run, "d int, part int, entry int, total array<string>, n long")
    by_place = partial.select("d", "part", "entry", "n", F.posexplode_outer("total").alias("place", "t"))
    return by_place.groupBy("d", "part", "entry", "place").agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def _first_entries(rows: DataFrame, entries: int) -> dict[int, list[np.ndarray]]:
    """The vectors of the smallest ids of each length, as the parts' first entries."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, list[int]]]] = {}
        for batch in batches:
            ids = batch.column("vec_id")
            order = pa.compute.sort_indices(ids)
            sizes = batch.column("parts").value_lengths().to_numpy()[order.to_numpy()]
            for d in np.unique(sizes).tolist():
                mine = order.take(pa.array(np.flatnonzero(sizes == d)))
                last = ids[mine[min(entries, len(mine)) - 1].as_py()].as_py()
                mine = mine.filter(pa.compute.less_equal(ids.take(mine), last))
                new = list(zip(ids.take(mine).to_pylist(), batch.column("parts").take(mine).to_pylist(), strict=True))
                best[d] = sorted(best.get(d, []) + new)[:entries]
        found = [{"vec_id": i, "parts": v, "d": d} for d, some in best.items() for i, v in some]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("vec_id", pa.int64()), ("parts", pa.list_(pa.int64())), ("d", pa.int32())]))

    some = rows.where("vec_id is not null").select("vec_id", "parts").mapInArrow(smallest, "vec_id long, parts array<long>, d int")
    place = F.row_number().over(Window.partitionBy("d").orderBy("vec_id", "parts"))
    first = some.withColumn("_r", place).where(F.col("_r") <= entries).orderBy("d", "_r").select("d", "parts").collect()  # a few rows for each length
    out: dict[int, list[np.ndarray]] = {}
    for d in sorted({r["d"] for r in first}):
        vectors = np.array([r["parts"] for r in first if r["d"] == d], np.int64)
        out[d] = [vectors[:, a:b].copy() for a, b in zip(_cuts(d), _cuts(d)[1:], strict=False)]
    return out


def encode_vectors(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """vec_id, label, code (list of 8 entry indexes), error and d of each vector, and the codebooks by vector length."""
    finite = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = embeddings.selectExpr("cast(vec_id as long) as vec_id", "label", "cast(embedding as array<double>) as embedding").where(finite)
    most = F.floor(F.sqrt(F.lit(float(2**61)) / F.greatest(F.lit(1), F.ceil(F.size("embedding") / F.lit(PARTS)))))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x * scale, -most.cast("double")), most.cast("double"))).cast("long"))
    rows = saved(rows.select("vec_id", "label", whole.alias("parts")), "integer-vectors")
    codebooks = _first_entries(rows, entries)
    for _ in range(rounds if codebooks else 0):
        for r in _sums(rows, codebooks).collect():  # a row for each component of each entry
            if r["place"] is not None:
                codebooks[r["d"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(codebooks)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                for d, at, x in _matrix(batch, start):
                    found = [tree.nearest(x[:, a:b]) for tree, a, b in zip(trees[d], _cuts(d), _cuts(d)[1:], strict=False)] if d in trees else []
                    take = pa.array(at)
                    code = np.column_stack([i for i, _ in found]) if found else np.zeros((len(at), 0), np.int64)
                    error = sum((e for _, e in found), np.zeros(len(at), np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * code.shape[1]), pa.array(code.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("label").take(take), lists, pa.array(error), pa.array(np.full(len(at), d, np.int32))], ["vec_id", "label", "code", "error", "d"])

    label = rows.schema["label"].dataType.simpleString()
    coded = saved(rows.mapInArrow(run, f"vec_id long, label {label}, code array<int>, error long, d int"), "vector-codes")
    dropped(rows)
    return coded, codebooks


def codebook_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector."""
    coded, codebooks = encode_vectors(embeddings)
    sums = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    digest = F.lit(None).cast("string")
    for d, books in codebooks.items():
        digest = F.when(F.col("d") == d, hashlib.sha256(codebook_text(books).encode()).hexdigest()).otherwise(digest)
    digits = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i.cast("long")), 2, "0"))), "")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l")))
    return out.select("vec_id", digits.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
