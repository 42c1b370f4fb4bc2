"""Passes over rows that Spark has brought together by keys and sorted: whole runs of equal keys, summed in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a run of equal keys begins; nulls are equal, and so are values that are no number."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        a, b = batch.column(k)[1:], batch.column(k)[:-1]
        unlike = pc.not_equal(a, b)
        if pa.types.is_floating(a.type):
            unlike = pc.and_not(unlike, pc.and_(pc.is_nan(a), pc.is_nan(b)))
        new |= pc.fill_null(unlike, False).to_numpy(zero_copy_only=False) | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(new) + 1)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that cut no run: a batch's last run waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and len(_starts(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]), keys)) > 1:
            yield pa.concat_batches(held)
            held = []
        cut = int(_starts(b, keys)[-1])
        if cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs of rows sorted by the keys, and the runs' starts."""
    for b in _whole(batches, keys):
        yield b, _starts(b, keys)


def by_run(rows: DataFrame, keys: list[str], made: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``made`` of batches of whole runs and the runs' starts. Rows are already partitioned by the keys and sorted with them first."""

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_runs(batches, keys):
            yield made(b, starts)

    return rows.mapInArrow(along, schema)


class Runs:
    """Sums, quantiles and covariances of columns over runs; a column is its values and where they are not null."""

    def __init__(self, batch: pa.RecordBatch, starts: np.ndarray, columns: list[str]):
        self.starts, self.n = starts, np.diff(np.append(starts, batch.num_rows))
        self.run = np.repeat(np.arange(len(starts)), self.n)
        self.valid = {c: batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns}
        self.x = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns}
        self._off: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def centred(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """Values less their run's least (so that a constant run is exactly 0), and that least one."""
        if c not in self._off:
            least = np.minimum.reduceat(np.where(self.valid[c], self.x[c], np.inf), self.starts)
            least = np.where(least == np.inf, 0.0, least)
            self._off[c] = np.where(self.valid[c], self.x[c] - least[self.run], 0.0), least
        return self._off[c]

    def mean(self, c: str) -> np.ndarray:
        y, least = self.centred(c)
        return least + self.total(y) / self.total(self.valid[c].astype(float))

    def covariance(self, a: str, b: str) -> np.ndarray:
        both = self.valid[a] & self.valid[b]
        n = self.total(both.astype(float))
        x, y = (np.where(both, self.centred(c)[0], 0.0) for c in (a, b))
        dx, dy = (v - (self.total(v) / n)[self.run] for v in (x, y))
        return self.total(np.where(both, dx * dy, 0.0)) / n

    def deviation(self, c: str) -> np.ndarray:
        return np.sqrt(self.covariance(c, c))

    def levels(self, c: str, levels: tuple[float, ...]) -> np.ndarray:
        """A row a run: linear-interpolation quantiles of the values that are not null."""
        ordered = self.x[c][np.lexsort((self.x[c], ~self.valid[c], self.run))]
        k = self.total(self.valid[c].astype(int))
        at = np.maximum(k - 1, 0)[:, None] * np.array(levels)
        low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
        lo, hi = ordered[self.starts[:, None] + low], ordered[self.starts[:, None] + high]
        out = np.where(low == high, lo, lo + (hi - lo) * (at - low))
        return np.where(k[:, None] > 0, out, np.nan)


def arrays(columns: list[np.ndarray], missing: np.ndarray | None = None) -> pa.Array:
    """One array<double> of each row's values in several columns; values of ``missing`` (the same shape) are null."""
    flat = np.column_stack(columns).astype(np.float64)
    ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), mask=None if missing is None else missing.ravel()))
