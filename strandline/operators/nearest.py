"""Mutual k-nearest neighbours inside groups, for several k at once, and what their graphs show."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import by_run

#: Pairs of rows whose distances are in memory together; a row meets at least all that may be near it.
PAIRS = 1 << 16
#: Groups of at most so many rows are taken together; of more than so many rows are cut into leaves; rows of a leaf.
SMALL, LARGE, LEAF = 32, 1024, 64

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class _Places:
    """A batch's rows, sorted by item inside a group: places on the axes, items as codes (-1: none), rows without a place."""

    def __init__(self, x: list[np.ndarray], code: np.ndarray, lost: np.ndarray, most: int):
        self.code, self.lost, self.most = code, lost, most
        self.bounded = ~lost & np.isfinite(np.column_stack(x)).all(1)
        self.x = self.short(x)

    def short(self, x: list[np.ndarray]) -> list[np.ndarray]:
        """The axes in half the bytes where their squared distances are whole numbers that these hold exactly."""
        with np.errstate(invalid="ignore", over="ignore"):
            moved = [v - v[~self.lost].min(initial=np.inf) for v in x]
            whole = all((v[~self.lost] % 1 == 0).all() for v in x) and sum(v[~self.lost].max(initial=0) ** 2 for v in moved) <= 1 << 24
            return [v.astype(np.float32) for v in moved] if whole else x

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = None
        with np.errstate(invalid="ignore", over="ignore"):
            for v in self.x:
                d = v[b] - v[a]
                d *= d
                out = d if out is None else np.add(out, d, out=out)
        return out

    def nearest(self, me: np.ndarray, other: np.ndarray, d: np.ndarray, null: np.ndarray) -> Pairs:
        """The pairs of each row's ``most`` nearest others: no number after all numbers, null after that, ties by item."""
        order = np.lexsort((other, np.where(null, 0.0, d), null, me))
        me = me[order]
        begin = np.flatnonzero(np.append(True, me[1:] != me[:-1])[: len(me)])
        kept = np.arange(len(me)) - np.repeat(begin, np.diff(np.append(begin, len(me)))) < self.most
        order = order[kept]
        return me[kept], other[order], d[order], null[order]

    def reach(self, d: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """How far each row's ``most``-th other is, of those that are apart from it; no number counts as endless."""
        if d.shape[1] <= self.most:
            return np.full(len(d), np.inf)
        return np.partition(np.where(apart, d, np.inf), self.most - 1, axis=1)[:, self.most - 1]

    def among(self, me: np.ndarray, other: np.ndarray) -> Iterator[Pairs]:
        """Each row's nearest of the others, from all distances between them, some rows at a time."""
        step = max(PAIRS // max(len(other), 1), 1)
        bounded = bool(self.bounded[me].all() and self.bounded[other].all())
        for at in range(0, len(me) if len(other) else 0, step):
            a, b = me[at : at + step, None], other[None, :]
            d, apart = self.distances(a, b), self.code[a] != self.code[b]
            if bounded:
                kept = d <= self.reach(d, apart)[:, None]
            else:
                numbers = apart & ~np.isnan(d)  # a row without a place has no distance that is a number
                kept = ~(d > self.reach(d, numbers)[:, None])
            kept &= apart
            i, j = np.divmod(np.flatnonzero(kept), len(other))  # with all ties of the last
            mine, far = a[i, 0], other[j]
            yield self.nearest(mine, far, d[i, j], self.lost[mine] | self.lost[far])

    def firsts(self, rows: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
        """The rows that can be in a list at all: of equal places the first ``most`` items and one, as a row is not its own neighbour."""
        order = np.lexsort((rows, *axes))
        rows, axes = rows[order], [v[order] for v in axes]
        new = np.append(True, np.any([v[1:] != v[:-1] for v in axes], axis=0) if axes else np.zeros(max(len(rows) - 1, 0), bool))[: len(rows)]
        item = new | np.append(True, self.code[rows[1:]] != self.code[rows[:-1]])[: len(rows)]
        at, number = np.arange(len(rows)), np.cumsum(item)
        begin = np.maximum.accumulate(np.where(item, at, 0))
        first = np.maximum.accumulate(np.where(new, number, 0))
        return rows[(number - first <= self.most) & (at - begin < self.most)]

    def in_leaves(self, rows: np.ndarray) -> Iterator[Pairs]:
        """Each row's nearest in a large group: leaves of near rows meet only the leaves that can hold a nearer row."""
        bounded, lost = rows[self.bounded[rows]], rows[self.lost[rows]]
        odd = rows[~self.bounded[rows] & ~self.lost[rows]]
        held = np.zeros(len(self.code), bool)
        held[self.firsts(bounded, [v[bounded] for v in self.x])] = True
        beside = np.append(odd, self.firsts(lost, []))  # no place bounds these
        yield from self.among(lost, self.firsts(rows, []))
        yield from self.among(odd, np.append(np.flatnonzero(held), beside))
        leaves = self.leaves(bounded)
        if not leaves:
            return
        starts, flat = np.cumsum([0, *map(len, leaves[:-1])]), np.concatenate(leaves)
        boxes = []
        for v in self.x:
            low, high = (np.where(held[flat], v[flat], end) for end in (np.inf, -np.inf))
            boxes.append((np.minimum.reduceat(v[flat], starts), np.maximum.reduceat(v[flat], starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
        inside = [leaf[held[leaf]] for leaf in leaves]
        sizes, enough = np.array(list(map(len, inside))), 2 * max(LEAF, self.most)
        for k, leaf in enumerate(leaves):
            apart = sum(np.square(np.maximum(np.maximum(low - ends[k], begins[k] - high), 0)) for begins, ends, low, high in boxes)
            order = np.argsort(apart, kind="stable")
            first = order[: int(np.searchsorted(np.cumsum(sizes[order]), enough)) + 1]
            some = np.concatenate([inside[i] for i in first])
            reach = self.reach(self.distances(leaf[:, None], some), self.code[leaf[:, None]] != self.code[some]).max()
            yield from self.among(leaf, np.concatenate([*(inside[i] for i in np.flatnonzero(apart <= reach)), beside]))

    def leaves(self, rows: np.ndarray) -> list[np.ndarray]:
        """The rows cut in halves along their widest axis until they fit a leaf."""
        out, left = [], [rows] if len(rows) else []
        while left:
            part = left.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            widest = max((v[part] for v in self.x), key=np.ptp)
            order, half = np.argpartition(widest, len(part) // 2), len(part) // 2
            left += [part[order[:half]], part[order[half:]]]
        return out

    def pairs(self, starts: np.ndarray, n: np.ndarray) -> Iterator[Pairs]:
        """The nearest of all rows: small groups together, the others one by one. Rows without item are left out."""
        none = np.zeros(0, np.int64)
        yield none, none, none.astype(float), none.astype(bool)
        small = np.flatnonzero(n <= SMALL)
        cost, at = np.cumsum(n[small] ** 2), 0
        while at < len(small):
            end = max(int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")), at + 1)
            g = small[at:end]
            size = np.repeat(n[g], n[g])  # a row's group
            rows = np.arange(len(size)) + np.repeat(starts[g] - np.cumsum(n[g]) + n[g], n[g])
            me = np.repeat(rows, size)
            other = np.arange(len(me)) - np.repeat(np.cumsum(size) - size - np.repeat(starts[g], n[g]), size)
            fine = (self.code[me] != self.code[other]) & (self.code[me] >= 0) & (self.code[other] >= 0)
            me, other = me[fine], other[fine]
            yield self.nearest(me, other, self.distances(me, other), self.lost[me] | self.lost[other])
            at = end
        for g in np.flatnonzero(n > SMALL):
            rows = np.arange(starts[g], starts[g] + n[g])
            rows = rows[self.code[rows] >= 0]
            yield from self.among(rows, rows) if len(rows) <= LARGE else self.in_leaves(rows)


def _along(rows: DataFrame, group: list[str], item: str, axes: list[str], label: str) -> DataFrame:
    """(group, item, y and the axes), a group's rows together, in the order of their items."""
    plain = rows.select(*group, F.col(item).alias("item"), F.col(label).cast("int").alias("y"), *[F.col(a).cast("double").alias(f"_x{k}") for k, a in enumerate(axes)])
    return plain.repartition(*group).sortWithinPartitions(*group, "item")


def _nearest(b: pa.RecordBatch, starts: np.ndarray, axes: int, most: int) -> Pairs:
    """The pairs of each row of the batch and its nearest others, in the order of rows and nearest first."""
    x = [b.column(f"_x{k}").to_numpy(zero_copy_only=False).astype(np.float64) for k in range(axes)]
    lost = np.zeros(b.num_rows, bool)
    for k in range(axes):
        lost |= b.column(f"_x{k}").is_null().to_numpy(zero_copy_only=False)
    code = b.column("item").dictionary_encode().indices.fill_null(-1).to_numpy()
    n = np.diff(np.append(starts, b.num_rows))
    me, other, d, null = (np.concatenate(v) for v in zip(*_Places(x, code, lost, most).pairs(starts, n), strict=True))
    order = np.argsort(me, kind="stable")
    return me[order], other[order], d[order].astype(np.float64), null[order]


def neighbour_lists(rows: DataFrame, group: list[str], item: str, axes: list[str], label: str, most: int) -> DataFrame:
    """(group, item, y, n, near): the ``most`` nearest others of each row by squared distance, ties by item, nearest first.

    All rows of a group are compared, in numpy: up to ``LARGE`` rows with each other, in larger groups with those of the
    leaves that can hold a nearer row, so time does not follow a large group's square. An item names one row of its group.
    A row without item is in no list and has none; a distance of null comes last. A group's rows stay together.
    """
    along = _along(rows, group, item, axes, label)
    keys = along.select(*group, "item", "y").schema
    near = f"array<struct<d: double, i: {keys['item'].dataType.simpleString()}, y: int>>"

    def lists(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        n = np.diff(np.append(starts, b.num_rows))
        me, other, d, null = _nearest(b, starts, len(axes), most)
        taken, ends = pa.array(other), np.append(0, np.cumsum(np.bincount(me, minlength=b.num_rows))).astype(np.int32)
        held = pa.StructArray.from_arrays([pa.array(d, mask=null), b.column("item").take(taken), b.column("y").take(taken)], ["d", "i", "y"])
        columns = [*(b.column(c) for c in keys.names), pa.array(np.repeat(n, n).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), held)]
        return pa.RecordBatch.from_arrays(columns, [*keys.names, "n", "near"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["n int", f"near {near}"])
    return by_run(along, group, lists, schema)


def _listed(b: pa.RecordBatch, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the rows that their lists name."""
    near, item = b.column("near"), b.column("item")
    me = np.repeat(np.arange(len(run)), pc.list_value_length(near).fill_null(0).to_numpy(zero_copy_only=False))
    code = pa.concat_arrays([item, near.flatten()]).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    span = int(code.max(initial=0)) + 1
    named = np.flatnonzero(code[: len(run)] >= 0)
    named = named[np.argsort(run[named] * span + code[named], kind="stable")]
    return me, named[np.searchsorted(run[named] * span + code[named], run[me] * span + code[len(run) :])] if len(me) else me


def _mutual(rows: int, me: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, rank): pairs a < b of rows that hold each other; they are mutual neighbours for every k from ``rank`` on."""
    sizes = np.bincount(me, minlength=rows)
    rank = np.arange(len(me)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    key = np.minimum(me, other) * rows + np.maximum(me, other)
    order = np.argsort(key, kind="stable")
    key, rank = key[order], rank[order]
    both = np.flatnonzero(key[1:] == key[:-1])
    return key[both] // rows, key[both] % rows, np.maximum(rank[both], rank[both + 1])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component: roots are hung below the least root they meet, then paths are cut short."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


_STATISTICS = "k int, n int, edges int, homophily double, isolated double, components int"


def _statistics(b: pa.RecordBatch, starts: np.ndarray, group: list[str], ks: list[int], me: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """The statistics of each group and k, from rows and their nearest others, nearest first."""
    n, groups = np.diff(np.append(starts, b.num_rows)), len(starts)
    run = np.repeat(np.arange(groups), n)
    known = b.column("y").is_valid().to_numpy(zero_copy_only=False)
    y = b.column("y").fill_null(0).to_numpy().astype(np.float64)
    named = b.column("item").is_valid().to_numpy(zero_copy_only=False)
    one, two, rank = _mutual(len(run), me, other)
    alike = known[one] & known[two] & (y[one] == y[two])
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.bincount(run, y * known, groups) / np.bincount(run, known, groups)
        chance = p * p + (1 - p) * (1 - p)
        for k in ks:
            mine = rank <= k
            c, d = one[mine], two[mine]
            edges = np.bincount(run[c], minlength=groups)
            share = np.bincount(run[c], alike[mine], groups) / edges
            touched = np.zeros(len(run), bool)
            touched[c] = touched[d] = True
            alone = n - np.bincount(run[touched], minlength=groups)
            heads = np.bincount(run[(_roots(len(run), c, d) == np.arange(len(run))) & named], minlength=groups)
            asked = np.flatnonzero(n > k)
            out.append((asked, np.full(len(asked), k), n[asked], edges[asked], ((share - chance) / (1 - chance))[asked], (alone / n)[asked], heads[asked]))
    at, k, size, edges, homophily, isolated, components = (np.concatenate(v) for v in zip(*out, strict=True))
    whole = [pa.array(v.astype(np.int32)) for v in (k, size, edges)]
    columns = [*(b.column(g).take(pa.array(starts[at])) for g in group), *whole, pa.array(homophily, mask=~np.isfinite(homophily)), pa.array(isolated), pa.array(components.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, [*group, "k", "n", "edges", "homophily", "isolated", "components"])


def _kinds(rows: DataFrame, group: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)


def mutual_statistics(lists: DataFrame, group: list[str], ks: list[int]) -> DataFrame:
    """(group, k, n, edges, homophily, isolated, components) of the mutual k-nearest-neighbour graph, for k below the group's rows.

    Homophily is the share of edges between equal labels, adjusted for chance (null without edges or with one label).
    ``lists`` are those of ``neighbour_lists``, whose groups lie together, so that they are not moved again. A row without
    item is in no component.
    """

    def made(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b.num_rows)))
        return _statistics(b, starts, group, ks, *_listed(b, run))

    held = lists.select(*group, "item", "y", F.col("near.i").alias("near"))
    return by_run(held, group, made, f"{_kinds(lists, group)}, {_STATISTICS}")


def mutual_graphs(rows: DataFrame, group: list[str], item: str, axes: list[str], label: str, ks: list[int]) -> DataFrame:
    """``mutual_statistics`` of the rows' ``neighbour_lists``, without lists between them: a group's lists never leave its batch."""

    def made(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        return _statistics(b, starts, group, ks, *_nearest(b, starts, len(axes), max(ks))[:2])

    return by_run(_along(rows, group, item, axes, label), group, made, f"{_kinds(rows, group)}, {_STATISTICS}")
