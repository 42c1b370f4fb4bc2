"""Keyed sampling, folds, bootstraps: results depend on keys and seeds, never on row order."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import keyed, poisson_weight
from .tables import saved
from .windows import numbered


def keyed_order(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def thin_rows(df: DataFrame, group: list[str], item: str, depth: int, seed: int = 0) -> DataFrame:
    """At most ``depth`` rows a group, those of smallest keyed hash; groups with fewer stay whole."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    w = Window.partitionBy(*group).orderBy(keyed_order(seed, *group, item), item)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= depth).drop("_r")


def thin_exact(counts: DataFrame, keys: list[str], n: str, depth: int, seed: int, schema: str) -> DataFrame:
    """Per key the sorted reading numbers that a keyed draw without replacement keeps.

    The draw is that of numpy's default generator seeded by the blake2b hash of ``seed:depth:key...``.
    """

    def draw(frames):
        for f in frames:
            kept = []
            for row in f.itertuples(index=False):
                text = ":".join(str(x) for x in (seed, depth, *[getattr(row, k) for k in keys]))
                state = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
                m = int(getattr(row, n))
                kept.append(list(range(m)) if depth >= m else sorted(np.random.default_rng(state).choice(m, depth, replace=False).tolist()))
            yield pd.DataFrame({**{k: f[k] for k in keys}, "kept": kept})

    return counts.select(*keys, n).mapInPandas(draw, f"{schema}, kept array<long>")


def grouped_folds(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """(group, fold): whole groups in one fold each, sizes of folds in groups at most one apart.

    Groups are dealt in keyed hash order. The hash's leading bits order them in cells, whose sizes are summed before
    the places inside.
    """
    g = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_h", keyed_order(seed, group))
    parts = g.withColumn("_cell", F.call_function("shiftright", F.col("_h"), F.lit(52)))
    sizes = parts.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 cells
    sizes = sizes.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", group)) - 1
    return parts.join(F.broadcast(sizes), "_cell").select(group, ((F.col("_before") + place) % folds).cast("int").alias("fold"))


def role_split(df: DataFrame, key: str) -> DataFrame:
    """Half of the keys to train, a quarter each to validation and test, by the first digit of the key's md5."""
    digit = F.substring(F.md5(F.col(key).cast("string")), 1, 1)
    return df.withColumn("role", F.when(digit < "8", "train").when(digit < "c", "validation").otherwise("test"))


def bootstrap_means(df: DataFrame, cluster: str, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """Means over ``resamples`` Poisson cluster bootstraps: (resample, mean).

    Rows are summed to clusters first, so what is multiplied is clusters and not rows.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    drawn = sums.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.pmod(F.xxhash64(F.lit(seed), "resample", cluster), F.lit(1 << 30)) / float(1 << 30)
    weight, cumulative, p = F.lit(0), 0.0, np.exp(-1.0)
    for k in range(8):  # the inverse of the Poisson(1) distribution
        cumulative += p
        weight = weight + (u >= cumulative).cast("int")
        p /= k + 1
    drawn = drawn.withColumn("_w", weight)
    return drawn.groupBy("resample").agg((F.sum(F.col("_w") * F.col("_s")) / F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0))).alias("mean"))


def repetition_seeds(n: int, base: int) -> list[int]:
    """Seeds of n repetitions: the base itself, then children of its seed sequence, which do not depend on n."""
    if n < 1:
        raise ValueError("at least one repetition is needed")
    children = np.random.SeedSequence(base).spawn(n - 1)
    return [base, *(int(c.generate_state(1)[0]) for c in children)]


def repeated_folds(df: DataFrame, group: str, folds: int, repetitions: int, base: int) -> DataFrame:
    """(rep, group, fold): whole groups dealt to folds anew in each repetition, in the order of a draw keyed by its seed.

    Sizes of folds in groups are at most one apart. Repetition 0 is the base split, whatever number is asked for.
    """
    seeds = F.array(*[F.struct(F.lit(i).alias("rep"), F.lit(str(s)).alias("_seed")) for i, s in enumerate(repetition_seeds(repetitions, base))])
    g = df.select(group).where(F.col(group).isNotNull()).distinct().select(group, F.inline(seeds))
    g = g.withColumn("_h", F.substring(F.md5(F.concat_ws(":", "_seed", F.col(group).cast("string"))), 1, 8))
    return numbered(g, ["rep"], [F.asc("_h"), F.asc(group)], "_at").select("rep", group, (F.col("_at") % folds).cast("int").alias("fold"))


def out_of_fold_rates(rows: DataFrame, folds: DataFrame, group: str, key: str, label: str) -> DataFrame:
    """rows of every repetition with rep, fold and score: the label's rate among rows of the same key in the other folds.

    A key that the other folds lack takes their overall rate. The folds' sums are subtracted from the whole, so one
    pass over the rows serves all folds of all repetitions.
    """
    dealt = rows.join(folds, group)
    cells = saved(dealt.groupBy("rep", "fold", key).agg(F.count(F.lit(1)).alias("_cn"), F.sum(F.col(label).cast("long")).alias("_cp")), "fold-sums")
    by_key = cells.groupBy("rep", F.col(key).alias("_key")).agg(F.sum("_cn").alias("_n"), F.sum("_cp").alias("_k"))
    by_fold = cells.groupBy(F.col("rep").alias("_r"), F.col("fold").alias("_f")).agg(F.sum("_cn").alias("_fn"), F.sum("_cp").alias("_fk"))
    whole = cells.groupBy(F.col("rep").alias("_w")).agg(F.sum("_cn").alias("_wn"), F.sum("_cp").alias("_wk"))
    c = cells.join(by_key.withColumnRenamed("rep", "_kr"), (F.col("rep") == F.col("_kr")) & F.col(key).eqNullSafe(F.col("_key")))
    c = c.join(by_fold, (F.col("rep") == F.col("_r")) & (F.col("fold") == F.col("_f"))).join(whole, F.col("rep") == F.col("_w"))
    other = (F.col("_k") - F.col("_cp")) / F.nullif(F.col("_n") - F.col("_cn"), F.lit(0))
    rest = (F.col("_wk") - F.col("_fk")) / F.nullif(F.col("_wn") - F.col("_fn"), F.lit(0))
    c = c.select(F.col("rep").alias("_cr"), F.col("fold").alias("_cf"), F.col(key).alias("_ck"), F.coalesce(other, rest).alias("score"))
    return dealt.join(c, (F.col("rep") == F.col("_cr")) & (F.col("fold") == F.col("_cf")) & F.col(key).eqNullSafe(F.col("_ck"))).drop("_cr", "_cf", "_ck")


def resampled_ratio(sums: DataFrame, cluster: str, keys: list[str], above: str, below: str, resamples: int, seed: str) -> DataFrame:
    """(keys, point, lo, hi): sum(above) / sum(below) over clusters, with the central 95 % of Poisson resamples of clusters.

    ``sums`` has a row for each cluster and key. Clusters are drawn in a table of their own, so nothing the size of what
    was summed is multiplied.
    """
    drawn = sums.select(cluster).distinct().withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    drawn = drawn.withColumn("_w", poisson_weight(keyed(seed, "resample", cluster))).where("_w > 0")
    drawn = drawn.unionByName(sums.select(cluster).distinct().select(cluster, F.lit(0).alias("resample"), F.lit(1).alias("_w")))
    each = sums.join(drawn, cluster).groupBy(*keys, "resample").agg((F.sum(F.col("_w") * F.col(above)) / F.nullif(F.sum(F.col("_w") * F.col(below)), F.lit(0.0))).alias("_v"))
    again = F.when(F.col("resample") > 0, F.col("_v"))
    q = each.groupBy(*keys).agg(F.max(F.when(F.col("resample") == 0, F.col("_v"))).alias("point"), F.percentile(again, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return q.select(*keys, "point", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
