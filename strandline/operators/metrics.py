"""Tie-aware ranking metrics, thresholds, calibration and paired comparison, by group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved
from .windows import running_sums


def by_threshold(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """One row per distinct score: positives tp and rows n at it, and both summed from the top (ctp, cn)."""
    t = df.groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    return running_sums(t, group, score, {"tp": "ctp", "n": "cn"}, descending=True)


def average_precision(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Average precision with tied scores at one threshold; null without positives."""
    t = by_threshold(df, group, score, label)
    return t.groupBy(*group).agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.nullif(F.sum("tp"), F.lit(0))).alias("ap"))


def roc_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties; null with a single class."""
    t = by_threshold(df, group, score, label)
    negatives = F.col("n") - F.col("tp")
    won = F.sum(negatives * (F.col("ctp") - F.col("tp") / 2.0))  # positives above a negative, those at it half
    return t.groupBy(*group).agg((won / F.nullif(F.sum("tp") * F.sum(negatives), F.lit(0))).alias("auc"))


def ap_and_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """ap and auc of each group, and its rows n and positives, from one count of its distinct scores."""
    t = by_threshold(df, group, score, label)
    tp, n = F.sum("tp"), F.sum("n")
    ap = F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.nullif(tp, F.lit(0))
    won = F.sum((F.col("n") - F.col("tp")) * (F.col("ctp") - F.col("tp") / 2.0))
    return t.groupBy(*group).agg(ap.alias("ap"), (won / F.nullif(tp * (n - tp), F.lit(0))).alias("auc"), n.alias("n"), tp.alias("positives"))


def exact_levels(df: DataFrame, column: str, levels: list[float]) -> DataFrame:
    """One row with ``levels``, the linear-interpolation quantiles of a column, from counts of its distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(counts, [], "_v", {"_n": "_le"})
    n = placed.agg(F.max("_le").alias("_all"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(levels)])

    def holds(at: Column) -> Column:
        return (at >= F.col("_le") - F.col("_n")) & (at < F.col("_le"))

    rows = placed.join(F.broadcast(n), how="cross").select("_v", "_n", "_le", "_all", F.explode(asked).alias("a"))
    place = F.col("a.q") * (F.col("_all") - 1)
    low, high = F.floor(place), F.ceil(place)
    ends = rows.where(holds(low) | holds(high)).groupBy("a").agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("lo"), F.max(F.when(holds(high), F.col("_v"))).alias("hi"), F.max(place - low).alias("f")
    )
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f"))
    found = ends.agg(F.array_sort(F.collect_list(F.struct(F.col("a.i").alias("i"), value.alias("v")))).alias("_l"))  # a row per level
    return found.select(F.transform("_l", lambda x: x["v"]).alias("levels"))


def top_share(df: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The rows of the highest scores, max(1, round(share * n)) of them; ties are broken by key. Halves round to even.

    Only rows of the one score at the cut are ranked. Rows are saved first, so that their scores are computed once.
    """
    df = saved(df, "rows-to-cut")
    t = running_sums(df.groupBy(score).agg(F.count(F.lit(1)).alias("_n")), [], score, {"_n": "_cn"}, descending=True)
    k = t.agg(F.greatest(F.lit(1), F.bround(F.lit(share) * F.max("_cn"), 0).cast("long")).alias("_k"))
    cut = t.join(F.broadcast(k), how="cross").where("_cn - _n < _k")
    inside = df.join(cut.withColumnRenamed(score, "_s"), F.col(score).eqNullSafe(F.col("_s"))).drop("_n", "_s")
    whole, split = inside.where("_cn <= _k"), inside.where("_cn > _k")
    n_before = F.col("_cn") - F.count(F.lit(1)).over(Window.partitionBy(score))
    split = split.withColumn("_r", n_before + F.row_number().over(Window.partitionBy(score).orderBy(key))).where("_r <= _k")
    return whole.unionByName(split.drop("_r")).drop("_cn", "_k")


def threshold_table(df: DataFrame, score: str, label: str, points: int = 201) -> DataFrame:
    """Counts, precision, recall and f1 of ``score >= t`` on an even grid of [0, 1].

    Rows fall into their grid cell once and cells are summed from the top: no row meets the whole grid.
    """
    spark = df.sparkSession
    last = points - 1
    cell = F.least(F.greatest(F.floor(F.round(F.col(score) * last, 9)).cast("long"), F.lit(-1)), F.lit(last))
    hist = df.groupBy(cell.alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("k"))
    totals = df.agg(F.sum(F.col(label).cast("long")).alias("p"))
    grid = spark.range(points).withColumnRenamed("id", "i").join(hist, "i", "left").fillna(0, ["n", "k"])
    w = Window.orderBy(F.desc("i"))  # the grid alone is ordered: a fixed number of rows
    out = grid.select("i", F.sum("n").over(w).alias("called"), F.sum("k").over(w).alias("tp")).join(F.broadcast(totals), how="cross")
    precision, recall = F.col("tp") / F.nullif(F.col("called"), F.lit(0)), F.col("tp") / F.nullif(F.col("p"), F.lit(0))
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.select((F.col("i") / last).alias("threshold"), "called", "tp", "precision", "recall", f1.alias("f1"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and rate of right-closed score quantile bins; equal edges are one."""
    edges = exact_levels(df, score, [i / bins for i in range(1, bins)]).select(F.array_distinct("levels").alias("_e"))
    at = F.size(F.filter("_e", lambda e: e < F.col(score)))
    return (
        df.join(F.broadcast(edges), how="cross")
        .groupBy(at.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    )


def expected_calibration_error(cal: DataFrame) -> DataFrame:
    return cal.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


#: The edges of the depth bands.
DEPTH_EDGES = (1, 2, 3, 5, 10, 20, 32, 47, 84, 304, 600)


def depth_band(depth: Column, edges: tuple[int, ...] = DEPTH_EDGES) -> Column:
    """Half-open depth band as text; the last one is open."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, [*edges[1:], None], strict=True):
        inside = depth >= lo if hi is None else (depth >= lo) & (depth < hi)
        name = f"{lo}+" if hi is None else (str(lo) if hi == lo + 1 else f"{lo}-{hi - 1}")
        out = F.when(inside, name).otherwise(out)
    return out


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p value of Student's t."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 1.0 if x >= 1 else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_chance(t: Column, df: Column, steps: int = 4000) -> Column:
    """Two-sided p value of Student's t as a column: the density's integral from 0 to |t| by midpoints; null without a t."""
    half = (df + 1) / 2.0
    front = F.exp(_log_gamma(half) - _log_gamma(df / 2.0)) / F.sqrt(df * math.pi)
    width = F.abs(t) / steps

    def density(i: Column) -> Column:
        x = (i + 0.5) * width
        return F.pow(1 + x * x / df, -half)

    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda acc, i: acc + density(i))
    return F.when(t.isNotNull() & df.isNotNull(), F.greatest(1 - 2 * front * area * width, F.lit(0.0)))


def _log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of positive numbers, by Stirling's series eight places up."""
    up = z + 8
    series = (up - 0.5) * F.log(up) - up + math.log(2 * math.pi) / 2 + 1 / (12 * up) - 1 / (360 * up * up * up)
    return series - sum((F.log(z + i) for i in range(8)), F.lit(0.0))


def welch(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_a, n_b, difference, t, df) of two unpaired samples with unequal variances; null t without spread."""
    sides = []
    for df, n in ((a, "a"), (b, "b")):
        sides.append(df.groupBy(*keys).agg(F.count(value).alias(f"n_{n}"), F.avg(value).alias(f"_m{n}"), F.var_samp(value).alias(f"_v{n}")))
    j = sides[0].join(sides[1], keys)
    ea, eb = F.col("_va") / F.col("n_a"), F.col("_vb") / F.col("n_b")
    se = F.nullif(ea + eb, F.lit(0.0))
    freedom = se * se / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1))
    gap = F.col("_ma") - F.col("_mb")
    return j.where("n_a > 1 and n_b > 1").select(*keys, "n_a", "n_b", gap.alias("difference"), (gap / F.sqrt(se)).alias("t"), freedom.alias("df"))


def paired_comparison(obs: DataFrame, a: str, b: str, folds: int) -> dict[str, float]:
    """Paired differences of two arms over repeated folds: mean, wins, and naive and corrected p values."""
    d = F.col(a) - F.col(b)
    row = obs.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("var"), F.avg((d > 0).cast("double")).alias("wins")).first()
    n, mean, var = row["n"], row["mean"], row["var"]
    out = {"n": n, "mean": mean, "wins": row["wins"], "p_naive": None, "p_corrected": None}
    if n > 1 and var:
        out["p_naive"] = t_two_sided(mean / math.sqrt(var / n), n - 1)
        out["p_corrected"] = t_two_sided(mean / math.sqrt(var * (1 / n + 1 / (folds - 1))), n - 1)
    return out


def hit_expectation(n: Column, positives: Column, k: int) -> Column:
    """Chance that k of n rows drawn without return hold a positive: 1 - C(n - p, k) / C(n, k); 1 where fewer than k are negative."""
    missed = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - positives - i) / F.greatest(n - i, F.lit(1)))
    return F.when(n - positives < k, F.lit(1.0)).otherwise(1 - missed)


def interpolate(curve: DataFrame, keys: list[str], x: str, y: str, points: int = 201) -> DataFrame:
    """The piecewise linear curve of each group at ``points`` even places of [0, 1]; flat beyond its ends.

    ``curve`` holds one row per key and x, of a bounded number (a threshold sweep).
    """
    grid = curve.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    grid = grid.select(*keys, (F.col("_i") / F.lit(float(points - 1))).alias(x), F.lit(None).cast("double").alias(y), F.col("_i").alias("step"))
    every = curve.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y), F.lit(None).cast("int").alias("step")).unionByName(grid)
    up = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(F.col(y).isNotNull(), F.col(x))
    sided = every.select(*keys, x, "step", F.max(known).over(up).alias("_x0"), F.min(known).over(down).alias("_x1"),
                         F.max_by(y, known).over(up).alias("_y0"), F.min_by(y, known).over(down).alias("_y1"))
    between = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(x) - F.col("_x0")) / F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0.0))
    return sided.where("step is not null").select(*keys, "step", F.coalesce(between, "_y0", "_y1").alias(y))
