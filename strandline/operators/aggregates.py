"""Grouped summaries of ragged readings, rates and fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def moments(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Count, means and population deviations per group."""
    cols = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_reads"), *cols)


def quantiles(df: DataFrame, group: list[str], column: str, levels: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact linear-interpolation quantiles q5, q25, ... with spread iqr and tail (outermost levels)."""
    q = df.groupBy(*group).agg(F.percentile(column, F.array(*[F.lit(x) for x in levels])).alias("_q"))
    names = [f"q{round(x * 100)}" for x in levels]
    out = q.select(*group, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    return out.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("tail", F.col(names[-1]) - F.col(names[0]))


def safe_corr(x: str, y: str, least: int = 5) -> Column:
    """Pearson correlation of a group; 0 for few rows or a constant column."""
    c = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(F.count(F.lit(1)) < least, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))


def contrasts(before: str, at: str, after: str) -> dict[str, Column]:
    """Within-reading differences over three neighbouring places."""
    a, b, c = F.col(before), F.col(at), F.col(after)
    return {"centre": b - (a + c) * 0.5, "gradient": c - a, "abs_gradient": F.abs(c - a)}


def loo_group_mean(df: DataFrame, group: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*group)
    n = F.count(value).over(w)
    mean = (F.sum(value).over(w) - F.col(value)) / F.nullif(n - 1, F.lit(0))
    return df.withColumn("loo_group_mean", F.coalesce(mean, F.lit(0.0)))


def weighted_merge(df: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """Copies of a key as one row: weighted mean, summed weight, number of copies."""
    return df.groupBy(*key).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias(value), F.sum(weight).alias(weight), F.count(F.lit(1)).alias("copies")
    )


def out_of_fold_rate(df: DataFrame, key: str, fold: str, label: str) -> DataFrame:
    """Each (key, fold) with the label's mean over the key's other folds, or over all other folds where there is none."""
    cell = df.groupBy(key, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k"))
    by_key, by_fold = Window.partitionBy(key), Window.partitionBy(fold)
    inside = (F.sum("k").over(by_key) - F.col("k")) / F.nullif(F.sum("n").over(by_key) - F.col("n"), F.lit(0))
    totals = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_k"))
    cell = cell.withColumn("_inside", inside).withColumn("_fn", F.sum("n").over(by_fold)).withColumn("_fk", F.sum("k").over(by_fold))
    rest = (F.col("_k") - F.col("_fk")) / F.nullif(F.col("_n") - F.col("_fn"), F.lit(0))
    return cell.join(F.broadcast(totals), how="cross").select(key, fold, "n", F.coalesce("_inside", rest).alias("rate"))


def loglinear_fit(df: DataFrame, group: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted straight line through (x, ln y) in closed form: slope, intercept, and scale = -1 / slope where it falls."""
    w, a, b = F.col(weight), F.col(x), F.ln(F.col(y))
    s = df.where(F.col(y) > 0).groupBy(*group).agg(
        F.sum(w).alias("w"), F.sum(w * a).alias("wx"), F.sum(w * b).alias("wy"), F.sum(w * a * a).alias("wxx"), F.sum(w * a * b).alias("wxy")
    )
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.nullif(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))
    out = s.withColumn("slope", slope).withColumn("intercept", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"))
    return out.withColumn("scale", F.when(F.col("slope") < 0, -1 / F.col("slope"))).select(*group, "slope", "intercept", "scale")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def leading_direction(cov: Column) -> Column:
    """(largest, v0, v1, v2): largest eigenvalue and unit eigenvector of a symmetric 3 x 3 matrix, an array [xx, xy, xz, yy, yz, zz].

    The eigenvalue is the closed trigonometric form. The vector is the longest cross product of two rows of the matrix less
    that eigenvalue; where all eigenvalues are equal it is the last axis.
    """

    def largest(c: Column, m: Column, p: Column) -> Column:
        x, y, z = c[0] - m, c[3] - m, c[5] - m
        det = x * (y * z - c[4] * c[4]) - c[1] * (c[1] * z - c[4] * c[2]) + c[2] * (c[1] * c[4] - y * c[2])
        cosine = F.coalesce(det / F.nullif(2 * p * p * p, F.lit(0.0)), F.lit(1.0))
        return m + 2 * p * F.cos(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / 3)

    def spread(c: Column, m: Column) -> Column:
        off = c[1] * c[1] + c[2] * c[2] + c[4] * c[4]
        return F.sqrt(((c[0] - m) * (c[0] - m) + (c[3] - m) * (c[3] - m) + (c[5] - m) * (c[5] - m) + 2 * off) / 6)

    def longest(c: Column, g: Column) -> Column:
        rows = ((c[0] - g, c[1], c[2]), (c[1], c[3] - g, c[4]), (c[2], c[4], c[5] - g))
        made = []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            u, v = rows[i], rows[j]
            made.append(F.array(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]))
        square = F.transform(F.array(*made), lambda v: F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("n"), v[0].alias("v0"), v[1].alias("v1"), v[2].alias("v2")))
        return F.array_max(square)

    def unit(g: Column, v: Column) -> Column:
        parts = [F.when(v["n"] > 0, v[f"v{i}"] / F.sqrt(v["n"])).otherwise(F.lit(float(i == 2))).alias(f"v{i}") for i in range(3)]
        return F.struct(g.alias("largest"), *parts)

    return _let(cov, lambda c: _let((c[0] + c[3] + c[5]) / 3, lambda m: _let(spread(c, m), lambda p: _let(largest(c, m, p), lambda g: _let(longest(c, g), lambda v: unit(g, v))))))


def eigen_alignment(df: DataFrame, group: list[str], columns: list[str], schema_keys: str) -> DataFrame:
    """Leading eigenvector of the group's covariance: alignment with the diagonal and dominance of its eigenvalue.

    The covariance numbers are aggregated by Spark. Three columns are solved in columns; for another number one small
    matrix a group reaches Python.
    """
    k = len(columns)
    if k == 3:
        pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
        held = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.coalesce(F.covar_samp(x, y), F.lit(0.0)) for x, y in pairs]).alias("_c"))
        held = held.withColumn("_e", leading_direction(F.col("_c")))
        total = F.col("_c")[0] + F.col("_c")[3] + F.col("_c")[5]
        fine = (F.col("_n") >= 5) & (total > 0)
        along = F.abs(F.col("_e.v0") + F.col("_e.v1") + F.col("_e.v2")) / F.sqrt(F.lit(3.0))
        return held.select(*group, F.when(fine, along).otherwise(0.0).alias("alignment"), F.when(fine, F.col("_e.largest") / total).otherwise(0.0).alias("dominance"))
    names = [f"_c{i}_{j}" for i in range(k) for j in range(i, k)]
    cov = [F.covar_samp(columns[i], columns[j]).alias(f"_c{i}_{j}") for i in range(k) for j in range(i, k)]
    table = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *cov)

    def solve(frames):
        for f in frames:
            m = np.zeros((len(f), k, k))
            for c, (i, j) in zip(names, [(i, j) for i in range(k) for j in range(i, k)], strict=True):
                m[:, i, j] = m[:, j, i] = f[c].fillna(0).to_numpy()
            values, vectors = np.linalg.eigh(m)
            total = values.sum(1)
            fine = (f["_n"].to_numpy() >= 5) & (total > 0)
            align = np.where(fine, np.abs(vectors[:, :, -1].sum(1)) / np.sqrt(k), 0.0)
            share = np.where(fine, values[:, -1] / np.where(total > 0, total, 1), 0.0)
            yield pd.DataFrame({**{g: f[g] for g in group}, "alignment": align, "dominance": share})

    return table.mapInPandas(solve, f"{schema_keys}, alignment double, dominance double")


def mahalanobis(df: DataFrame, group: list[str], columns: list[str], shrink: float = 0.1) -> DataFrame:
    """Median and 95 % quantile of d squared / k of a group's rows under its shrunk correlation matrix; 0 for under 5 rows.

    Covariances are aggregated by Spark, one small matrix a group is inverted in Python, distances are columns of the rows.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    stats = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in columns]).alias("_m"), F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).alias("_c")
    )

    def invert(frames):
        for f in frames:
            cov = np.zeros((len(f), k, k))
            flat = np.array(f["_c"].tolist(), float).reshape(len(f), len(pairs))
            for at, (i, j) in enumerate(pairs):
                cov[:, i, j] = cov[:, j, i] = flat[:, at]
            sd = np.sqrt(np.maximum(cov[:, range(k), range(k)], 0))
            varies = sd > 0
            scale = np.where(varies, sd, 1)
            r = cov / (scale[:, :, None] * scale[:, None, :]) * (1 - shrink) * varies[:, :, None] * varies[:, None, :]
            r[:, range(k), range(k)] = 1  # a constant column stands alone, its distance is 0
            f["_s"] = list(scale)
            f["_i"] = list(np.linalg.inv(r).reshape(len(f), k * k))
            f["_k"] = varies.sum(1)
            yield f.drop(columns=["_c"])

    keys = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    known = stats.mapInPandas(invert, f"{keys}, _n long, _m array<double>, _s array<double>, _i array<double>, _k long")
    row = df.select(*group, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")).join(known, group)
    z = F.zip_with(F.zip_with("_x", "_m", lambda a, b: a - b), "_s", lambda a, b: a / b)
    row = row.withColumn("_z", z)
    d = F.aggregate(
        F.transform("_z", lambda v, i: v * F.aggregate(F.zip_with("_z", F.slice("_i", i * k + 1, k), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)),
        F.lit(0.0), lambda a, b: a + b,
    )
    d = F.when(F.col("_n") < 5, F.lit(0.0)).otherwise(d / F.greatest("_k", F.lit(1)))
    q = row.select(*group, d.alias("_d")).groupBy(*group).agg(F.percentile("_d", F.array(F.lit(0.5), F.lit(0.95))).alias("_q"))
    return q.select(*group, F.col("_q")[0].alias("d_q50"), F.col("_q")[1].alias("d_q95"))
