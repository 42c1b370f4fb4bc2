"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine at least c are within squared distance 2 - 2c. They are
rotated onto the principal axes of a bounded sample and split into blocks, and
the squared distance is budgeted over the blocks in proportion to their
variance: a pair within the whole budget is within that of at least one block.
Each block is range-joined on a grid over its first two axes, as wide as the
block's radius, so a vector meets its own cell and the eight around it. A pair
counts in the first block whose budget it keeps, so the union of candidates
holds it once; its cosine is then computed in double precision.

Equal vectors are one row with a count. A cell is joined by tiles of bounded
size, and a tile returns link counts and a spanning forest of its links, never
the pairs. The sample (``SAMPLE_ROWS``) shapes only the rotation: every vector is
joined and nothing is missed by it.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors without a label, link with nothing. Vectors of different
length never link. Repeated ids are returned as often as they come and are one
node. Rows without id link with nothing and have a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components

SAMPLE_ROWS = 20_000
BLOCKS = 4
#: Rows of one side of a tile.
TILE = 2048


def _valid() -> str:
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return f"vec_id is not null and label is not null and embedding is not null and {finite} and exists(embedding, x -> x != 0)"


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit rows; sums run over the axes one by one, so that a row's result never depends on its company."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    square = np.zeros(len(v))
    for j in range(v.shape[1]):
        square += v[:, j] * v[:, j]
    return v / np.sqrt(square)[:, None]


class Rotation:
    """Principal axes of sample vectors, split into blocks with squared-distance budgets."""

    def __init__(self, sample: np.ndarray, cosine: float, blocks: int = BLOCKS):
        unit = _unit(sample)
        centred = unit - unit.mean(0)
        variance, axes = np.linalg.eigh(centred.T @ centred / len(unit))
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        d = len(variance)
        self.cuts = [round(i * d / min(blocks, d)) for i in range(min(blocks, d) + 1)]
        share = np.array([variance[::-1][a:b].clip(min=0).sum() for a, b in zip(self.cuts, self.cuts[1:], strict=False)])
        share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / len(share))
        share = np.maximum(share, 0.25 / len(share))
        self.cosine = cosine
        self.budgets = (2 - 2 * cosine) * share / share.sum() + 1e-9

    def turn(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros_like(unit)
        for j in range(unit.shape[1]):
            out += unit[:, j : j + 1] * self.axes[j]
        return out

    def within(self, x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
        """Whether rows of x and y keep the budget of a block."""
        total = np.zeros(len(x))
        for j in range(self.cuts[block], self.cuts[block + 1]):
            total += (x[:, j] - y[:, j]) ** 2
        return total <= self.budgets[block]

    def cells(self, turned: np.ndarray, block: int) -> np.ndarray:
        axes = turned[:, self.cuts[block] : min(self.cuts[block] + 2, self.cuts[block + 1])]
        cells = np.floor(axes / np.sqrt(self.budgets[block])).astype(np.int64)
        return cells if cells.shape[1] == 2 else np.column_stack([cells, np.zeros(len(cells), np.int64)])


#: A vector is at home in its cell and a guest in four of its neighbours, so two cells meet once.
VISITS = ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))


def join_tile(ids: np.ndarray, weight: np.ndarray, home: np.ndarray, side: np.ndarray, vectors: np.ndarray, rotation: Rotation, block: int):
    """Links of a tile: weighted link counts of its rows, and a spanning forest as (root, node) ids.

    Pairs are those of two homes or a home and a guest; in a tile of two sides, pairs of one row of each.
    """
    unit = _unit(vectors)
    turned = rotation.turn(unit)
    a, b = rotation.cuts[block], rotation.cuts[block + 1]
    part = turned[:, a:b]
    norm = (part * part).sum(1)
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    two = len(np.unique(side)) > 1
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side != side.min()) if two else left
    for start in range(0, len(left), 512):
        rows = left[start : start + 512]
        near = norm[rows, None] + norm[None, right] - 2 * part[rows] @ part[right].T <= rotation.budgets[block] + 1e-7
        near &= home[rows, None] | home[None, right]
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        keep = (ids[i] != ids[j]) if two else (i < j) & (ids[i] != ids[j])
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            keep = rotation.within(turned[p], turned[q], block)
            for earlier in range(block):
                keep[keep] = ~rotation.within(turned[p[keep]], turned[q[keep]], earlier)
            p, q = p[keep], q[keep]
            linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= rotation.cosine
            p, q = p[linked], q[linked]
            links += np.bincount(p, weight[q], len(ids)).astype(np.int64) + np.bincount(q, weight[p], len(ids)).astype(np.int64)
            pairs = np.unique(np.column_stack([label[p], label[q]]), axis=0)
            for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
                x, y = root(x), root(y)
                label[max(x, y)] = min(x, y)
            for _ in range(64):
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return links, ids[label[moved]], ids[moved]


def _links(reps: DataFrame, rotation: Rotation) -> DataFrame:
    """(a, b, links): link counts of representatives a (b null), and forest edges (links null)."""
    shared = reps.sparkSession.sparkContext.broadcast(rotation)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float32)
            turned = shared.value.turn(_unit(vectors))
            rep = batch.column("rep").to_numpy()
            raw = pa.array([v.tobytes() for v in vectors], pa.binary())
            for block in range(len(shared.value.budgets)):
                cells = shared.value.cells(turned, block)
                for dx, dy in VISITS:
                    n = len(cells)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("label").cast(pa.int64()),
                            pa.array(np.full(n, block, np.int32)),
                            pa.array(cells[:, 0] + dx),
                            pa.array(cells[:, 1] + dy),
                            pa.array(np.full(n, (dx, dy) == (0, 0))),
                            pa.array(rep),
                            batch.column("weight"),
                            raw,
                        ],
                        ["label", "block", "x", "y", "home", "rep", "weight", "v"],
                    )

    def tile(key, table):
        ids = table["rep"].to_numpy()
        vectors = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32).reshape(len(ids), -1)
        home = table["home"].to_numpy()
        links, roots, nodes = join_tile(ids, table["weight"].to_numpy(), home, table["side"].to_numpy(), vectors, shared.value, key[1].as_py())
        some = links > 0
        a = np.concatenate([ids[some], roots])
        b = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(nodes, pa.int64())])
        w = pa.concat_arrays([pa.array(links[some]), pa.nulls(len(nodes), pa.int64())])
        return pa.table([pa.array(a, pa.int64()), b, w], ["a", "b", "links"])

    placed = reps.mapInArrow(place, "label long, block int, x long, y long, home boolean, rep long, weight long, v binary")
    placed = saved(placed, "placed-vectors")
    cell = ["label", "block", "x", "y"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("homes > 0 and n > 1")
    sizes = sizes.withColumn("s", F.ceil(F.col("n") / TILE).cast("int"))
    mine = placed.join(sizes.select(*cell, "s"), cell).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int"))
    # side i meets every side once: it goes to the tiles (i, j) and (j, i), lower first
    other = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    tiles = mine.withColumn("_o", other).withColumn("t1", F.least("side", "_o")).withColumn("t2", F.greatest("side", "_o")).drop("s", "_o")
    return tiles.groupBy(*cell, "t1", "t2").applyInArrow(tile, "a long, b long, links long")


def link_vectors(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of embeddings (vec_id, embedding, label)."""
    rows = embeddings.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<float>) as embedding", "cast(label as long) as label")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("embedding").to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_pylist()
            fps = [hashlib.blake2b((np.asarray(v, np.float32) + 0.0).tobytes() + b"%d" % x, digest_size=16).digest() for v, x in zip(values, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "embedding", "label")), pa.array(fps, pa.binary())], ["vec_id", "embedding", "label", "fp"])

    marked = saved(rows.where(_valid()).mapInArrow(mark, "vec_id long, embedding array<float>, label long, fp binary"), "vectors")
    classes = marked.groupBy("fp").agg(
        F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("weight"), F.first("embedding").alias("embedding"), F.first("label").alias("label")
    )
    classes = saved(classes, "vector-classes")
    found = None
    for size in [r["d"] for r in classes.select(F.size("embedding").alias("d")).distinct().collect()]:
        same = classes.where(F.size("embedding") == size)
        sample = same.orderBy(F.xxhash64("rep")).limit(SAMPLE_ROWS).select("embedding").collect()  # a bounded fit sample
        part = _links(same, Rotation(np.array([r["embedding"] for r in sample]), cosine))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "a long, b long, links long")
    found = saved(found, "vector-links")
    counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    parts = connected_components(found.where("b is not null").select("a", "b"))
    known = classes.select("fp", "rep", "weight").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select("fp", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    linked = marked.select("vec_id", "fp").join(known, "fp").groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
