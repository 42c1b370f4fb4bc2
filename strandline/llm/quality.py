"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each whole text come from vectorised byte counts inside one scan.
Small boosted trees are grown on a bounded sample of labelled documents, every
path from a root becomes a conjunctive rule, a lasso logistic regression keeps
few of them, and the kept rules become one Spark column expression.

The sample is at most ``SAMPLE_ROWS`` labelled rows (those with the smallest
hashes of their ids), so the driver holds a bounded matrix at any corpus size.

Defined cases: a null or empty text has all statistics 0 and gets a score like
any other. Labels that are null or not 0 or 1 are ignored, repeated labels of an
id count once (the largest). Without both label values in the sample the score
is the smoothed share of good labels. Repeated rows and rows without id are scored
row by row, texts of any length are read whole, other columns are returned as they
are, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column, free_name
from .textkit import LOWER, SPACE_WORDS, runs, span_hashes, spans, text_buffer

SAMPLE_ROWS = 20_000

STATISTICS = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "long_words",
    "upper_share",
    "digit_share",
    "mark_share",
    "loud_share",
    "bar_share",
    "foreign_share",
    "space_share",
    "log_line_bytes",
    "distinct_words",
    "top_word",
    "same_as_before",
    "ended_words",
    "short_words",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
MARK, LOUD, BAR, END = _table("#$%&*+<>=@^_~{}[]\\/"), _table("!?"), _table("|"), _table(".!?")
FOREIGN = np.arange(256) >= 128


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, offsets = text_buffer(column)
    rows, n_bytes = len(offsets) - 1, np.diff(offsets)
    starts, ends, first = spans(data, offsets, SPACE_WORDS)
    n_words = np.diff(first)
    row = np.repeat(np.arange(rows), n_words)
    size = ends - starts

    def share(mask: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(of, 1)

    words = span_hashes(LOWER[data], starts, ends) if len(data) else np.zeros(0, np.uint64)
    keys = np.sort((row.astype(np.uint64) << np.uint64(44)) | (words >> np.uint64(20)))
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    owner = (keys[begin] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, owner, np.diff(np.append(begin, len(keys))))
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (row[1:] == row[:-1])]) if len(words) else np.zeros(0, bool)
    lines = share(data == 10, offsets, np.ones(rows)) + 1
    last = data[ends - 1] if len(ends) else data
    return np.column_stack(
        [
            np.log1p(n_bytes),
            np.log1p(n_words),
            share(~(data == 0) & SPACE_WORDS[data], offsets, n_words),
            share(size > 14, first, n_words),
            *(share(t[data], offsets, n_bytes) for t in (UPPER, DIGIT, MARK, LOUD, BAR, FOREIGN)),
            share(~SPACE_WORDS[data], offsets, n_bytes),
            np.log1p(n_bytes / lines),
            np.bincount(owner, minlength=rows) / np.maximum(n_words, 1),
            most / np.maximum(n_words, 1),
            share(again, first, n_words),
            share(END[last], first, n_words),
            share(size < 4, first, n_words),
        ]
    ).astype(np.float64)


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "_sl") -> DataFrame:
    """docs with a struct of STATISTICS."""
    result = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])

    def make():
        def compute(batch: pa.RecordBatch) -> pa.StructArray:
            found = [text_statistics(part.column(text)) for part in runs(batch, text)]
            table = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            return pa.StructArray.from_arrays([pa.array(table[:, j]) for j in range(len(STATISTICS))], list(STATISTICS))

        return compute

    return annotate(docs, make, result, name, keep)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_greater, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, greater, t in self.terms:
            out &= (x[:, j] > t) == greater
        return out

    def column(self, stats: str) -> Column:
        out = None
        for j, greater, t in self.terms:
            c = F.col(f"{stats}.{STATISTICS[j]}")
            test = c > F.lit(float(t)) if greater else c <= F.lit(float(t))
            out = test if out is None else out & test
        return out


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str = "_sl") -> Column:
        """The score as a Spark expression over a struct of STATISTICS."""
        z = F.lit(float(self.bias))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(stats), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x_bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on gradients: rules of all its nodes below the root, and its leaf values a row."""
    rules, value = [], np.zeros(len(g))

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        value[rows] = gs / (hs + 1)
        if not left or len(rows) < 2 * least:
            return
        best = (1e-6, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = x_bins[rows, j]
            cg, ch, cn = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
            gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
            gain[(cn < least) | (len(rows) - cn < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
        if best[1] is None:
            return
        j, k = best[1]
        for greater in (False, True):
            own = (*terms, (j, greater, float(edges[j][k])))
            rules.append(Rule(own))
            split(rows[(x_bins[rows, j] > k) == greater], own, left - 1)

    split(np.arange(len(g)), (), depth)
    return rules, value


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 0.002, steps: int = 300) -> RuleEnsemble:
    """Boosted trees, their paths as rules, and lasso logistic weights (accelerated proximal gradient)."""
    n, good = len(y), float(y.sum())
    bias = float(np.log((good + 1) / (n - good + 1)))
    if not 0 < good < n:
        return RuleEnsemble(bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    z, seen = np.full(n, bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rules, value = _grow(bins, edges, y - p, p * (1 - p), depth, max(5, n // 500))
        z += rate * value
        seen.update({r: None for r in rules})
    rules = list(seen)
    if not rules:
        return RuleEnsemble(bias)
    a = np.column_stack([r.holds(x) for r in rules]).astype(np.float32)
    mean = a.mean(0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    a -= mean
    a /= scale
    w, v, b, t = np.zeros(len(rules), np.float32), np.zeros(len(rules), np.float32), bias, 1.0
    u = np.ones(n, np.float32) / np.sqrt(n)
    for _ in range(15):  # the largest singular value bounds the curvature
        u = a @ (a.T @ u)
        norm = float(np.linalg.norm(u))
        u /= norm
    rate_w = 4 * n / norm
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v + b)))
        step = v + rate_w / n * (a.T @ (y - p).astype(np.float32))
        new = np.sign(step) * np.maximum(np.abs(step) - rate_w * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
        b += float((y - p).mean())
    kept = np.flatnonzero(w)
    raw = (w / scale)[kept]
    return RuleEnsemble(b - float((raw * mean[kept]).sum()), [rules[i] for i in kept], [float(r) for r in raw])


def learn_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fits on labelled documents; ``usable`` filters labels by their doc_id."""
    known = labels.where("doc_id is not null and quality in (0, 1)")
    known = known if usable is None else known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a bounded fit sample
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = with_statistics(chosen, keep=["doc_id", "_y"]).select("doc_id", "_y", "_sl.*").toPandas()
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id").head(rows)
    return fit_rules(got[list(STATISTICS)].to_numpy(float), got["_y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleEnsemble, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns of docs and their score, which replaces a column of that name."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != name.lower()]
    statistics = free_name(docs, "statistics")
    scored = with_statistics(docs, keep=kept, name=statistics)
    return scored.select(*map(column, kept), model.column(statistics).alias(name))
