"""Window operators over rows ordered along an axis inside groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import band_pairs
from .runs import whole_runs
from .tables import in_cells, same, saved

#: Stands for "no neighbour on this side" in distances.
NO_NEIGHBOUR = 100_000.0


def leave_one_out(df: DataFrame, group: list[str], pos: str, value: str, width: int) -> DataFrame:
    """Adds n_neighbours, loo_mean and loo_max of the other rows within ``width`` (0 where there are none).

    One sort serves all three frames. Positions must be unique in a group.
    """
    w = Window.partitionBy(*group).orderBy(pos)
    around, left, right = w.rangeBetween(-width, width), w.rangeBetween(-width, -1), w.rangeBetween(1, width)
    n = F.count(F.lit(1)).over(around) - 1
    mean = (F.sum(value).over(around) - F.col(value)) / F.nullif(n, F.lit(0))
    top = F.greatest(F.max(value).over(left), F.max(value).over(right))
    return df.select(
        "*",
        n.alias("n_neighbours"),
        F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("loo_mean"),
        F.coalesce(top, F.lit(0.0)).alias("loo_max"),
    )


def neighbour_counts(df: DataFrame, group: list[str], pos: str, widths: list[int]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(pos)
    return df.select("*", *[(F.count(F.lit(1)).over(w.rangeBetween(-x, x)) - 1).alias(f"n_{x}") for x in widths])


def gaps(df: DataFrame, group: list[str], pos: str) -> DataFrame:
    """Distances to the previous, next and nearest row."""
    w = Window.partitionBy(*group).orderBy(pos)
    before = F.coalesce((F.col(pos) - F.lag(pos).over(w)).cast("double"), F.lit(NO_NEIGHBOUR))
    after = F.coalesce((F.lead(pos).over(w) - F.col(pos)).cast("double"), F.lit(NO_NEIGHBOUR))
    return df.select("*", before.alias("gap_before"), after.alias("gap_after")).withColumn("gap_nearest", F.least("gap_before", "gap_after"))


def relative_position(df: DataFrame, group: list[str], pos: str) -> DataFrame:
    """Place between the group's ends and rank by position, both from 0 to 1 and 0 for a single row."""
    whole, w = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(pos)
    low, high, n = F.min(pos).over(whole), F.max(pos).over(whole), F.count(F.lit(1)).over(whole)
    return df.select(
        "*",
        F.coalesce(F.round((F.col(pos) - low) / F.nullif(high - low, F.lit(0)), 6), F.lit(0.0)).alias("rel_pos"),
        F.coalesce(F.round((F.row_number().over(w) - 1) / F.nullif(n - 1, F.lit(0)), 6), F.lit(0.0)).alias("rel_rank"),
    )


def running_sums(values: DataFrame, group: list[str], by: str | list[Column], columns: dict[str, str], descending: bool = False) -> DataFrame:
    """values with sums up to each row in the order of ``by``, named by ``columns``.

    ``by`` is a column (values distinct in it and the group) or an order of several. Two levels: sums of cells first, then
    running sums inside each cell. Nulls come first, or last if descending.
    """
    order = by if isinstance(by, list) else [F.desc(by) if descending else F.asc(by)]
    placed = in_cells(values, group, order)
    sums = placed.groupBy(*group, "_cell").agg(*[F.sum(c).alias(f"_t_{n}") for c, n in columns.items()])
    before = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    sums = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_cell").alias("_c"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in columns.values()])
    inside = Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(sums, same(placed, sums, {g: f"_g_{g}" for g in group} | {"_cell": "_c"}))
    return joined.select(*values.columns, *[(F.col(f"_b_{n}") + F.sum(c).over(inside)).alias(n) for c, n in columns.items()])


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number from 0 in an order of each group, without ordering a whole group in one task."""
    counted = running_sums(rows.withColumn("_one", F.lit(1).cast("long")), group, order, {"_one": name})
    return counted.withColumn(name, F.col(name) - 1).drop("_one")


def average_rank(df: DataFrame, group: list[str], by: str, name: str, share: bool = False) -> DataFrame:
    """Adds the rank of ``by`` from 1 with ties at their mean, as a share of the group's rows if asked. Null values rank first.

    Ranks are made of distinct values and joined back, so no task orders all rows of a group; null groups are groups.
    The rows are saved first: a mean that is computed twice may differ in its last digit and would find no rank.
    """
    df = saved(df, "rows-to-rank")
    counts = df.groupBy(*group, by).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_sums(counts, group, by, {"_n": "_le"})
    rank = F.col("_le") - (F.col("_n") - 1) / 2.0
    if share:
        if not group:
            ranks = ranks.join(F.broadcast(ranks.agg(F.max("_le").alias("_all"))), how="cross")  # one row
        else:
            totals = ranks.groupBy(*[F.col(g).alias(f"_t_{g}") for g in group]).agg(F.max("_le").alias("_all"))
            ranks = ranks.join(totals, same(ranks, totals, {g: f"_t_{g}" for g in group}))
        rank = rank / F.col("_all")
    ranks = ranks.select(*[F.col(g).alias(f"_r_{g}") for g in group], F.col(by).alias("_r_by"), rank.alias("_rank"))
    out = df.join(ranks, same(df, ranks, {by: "_r_by"} | {g: f"_r_{g}" for g in group}))
    return out.select(*[df[c] for c in df.columns], F.col("_rank").alias(name))


def rank_share(df: DataFrame, by: str, name: str, spread: list[str]) -> DataFrame:
    """Adds what ``average_rank`` adds with share and without groups, for values that are mostly distinct: rows move once and meet no join by value.

    Rows are ranged by ``by`` and a hash of ``spread``, so a range (cell) holds a bounded part even of one value's rows. Places
    are counted along a cell; a row per cell then tells what lies before it and how many of its first and last value lie in
    other cells. df is read twice, so it should be a saved table or this function's own result.
    """
    kept = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_less", T.LongType()), T.StructField("_like", T.LongType())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b, starts in whole_runs(batches, [by]):
            n = np.diff(np.append(starts, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.repeat(starts + before, n)), pa.array(np.repeat(n, n))], schema.names)
            before += b.num_rows

    ranged = df.repartitionByRange(F.col(by), F.xxhash64(*spread)).sortWithinPartitions(by)
    placed = saved(ranged.select(*kept, F.spark_partition_id().alias("_cell")).mapInArrow(places, schema), "ranked-cells")
    first, last = F.col("_less") == 0, F.col("_less") + F.col("_like") == F.col("_n")
    cells = placed.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(by, "_less").alias("_lo"), F.min_by("_like", "_less").alias("_n_lo"), F.max_by(by, "_less").alias("_hi"), F.max_by("_like", "_less").alias("_n_hi")
    )
    cells = saved(cells, "cells-of-ranks")  # a row per cell
    others = cells.select(*[F.col(c).alias(f"_o{c}") for c in cells.columns])
    earlier, later = F.col("_o_cell") < F.col("_cell"), F.col("_o_cell") > F.col("_cell")

    def total(where: Column, count: str) -> Column:
        return F.sum(F.when(where, F.col(count)).otherwise(0))

    around = cells.join(F.broadcast(others), how="cross").groupBy("_cell", "_n").agg(
        total(earlier, "_o_n").alias("_before"), F.sum("_o_n").alias("_all"),
        total(earlier & F.col("_o_hi").eqNullSafe(F.col("_lo")), "_o_n_hi").alias("_earlier"), total(later & F.col("_o_lo").eqNullSafe(F.col("_hi")), "_o_n_lo").alias("_later"),
    )
    joined = placed.join(F.broadcast(saved(around, "ranks-of-cells")), "_cell")
    tied_before = F.when(first, F.col("_earlier")).otherwise(0)
    like = F.col("_like") + tied_before + F.when(last, F.col("_later")).otherwise(0)
    rank = F.col("_before") - tied_before + F.col("_less") + (like + 1) / 2.0
    return joined.select(*kept, (rank / F.col("_all")).alias(name))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rk") <= k)


def running_intervals(df: DataFrame, group: list[str], order: list[str], length: str) -> DataFrame:
    """Adds t_start and t_end: the half-open interval of each row on the axis of summed lengths."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("t_end", F.sum(length).over(w)).withColumn("t_start", F.col("t_end") - F.col(length))


def interval_union(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Unions of closed integer intervals; adjacent ones merge."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)
    island = F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_opens", opens)
        .withColumn("_island", island)
        .groupBy(*group, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_intervals"))
        .drop("_island")
    )


def kernel_mean(df: DataFrame, group: list[str], pos: str, value: str, radius: int, scale: float) -> DataFrame:
    """Adds kernel_mean: the mean of other rows within ``radius``, weighted by exp(-distance / scale); 0 without any.

    Pairs meet in cells of the radius, each once, and count for both of their rows.
    """
    near = band_pairs(df, group, pos, radius, [value]).withColumn("_w", F.exp(-F.col("distance") / scale))
    both = F.array(*[F.struct(F.col(f"{pos}_{me}").alias("_p"), F.col(f"{value}_{you}").alias("_u")) for me, you in ("ab", "ba")])
    means = near.select(*group, "_w", F.inline(both)).groupBy(*group, "_p").agg((F.sum(F.col("_w") * F.col("_u")) / F.sum("_w")).alias("kernel_mean"))
    joined = df.join(means.withColumnRenamed("_p", pos), [*group, pos], "left")
    return joined.withColumn("kernel_mean", F.coalesce(F.round("kernel_mean", 6), F.lit(0.0)))


def kernel_neighbours(df: DataFrame, group: list[str], pos: str, value: str, radius: int, scale: float, best_radius: int) -> DataFrame:
    """Adds kernel_mean as ``kernel_mean`` does, best (the largest other value within ``best_radius``, 0 without one) and has_neighbour."""
    near = band_pairs(df, group, pos, radius, [value])
    both = F.array(*[F.struct(F.col(f"{pos}_{me}").alias("_p"), F.col(f"{value}_{you}").alias("_u")) for me, you in ("ab", "ba")])
    each = near.select(*group, "distance", F.exp(-F.col("distance") / scale).alias("_w"), F.inline(both))
    found = each.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group], "_p").agg(
        (F.sum(F.col("_w") * F.col("_u")) / F.sum("_w")).alias("_mean"), F.max(F.when(F.col("distance") <= best_radius, F.col("_u"))).alias("_best")
    )
    joined = df.join(found, same(df, found, {pos: "_p"} | {g: f"_g_{g}" for g in group}), "left")
    zero = F.lit(0.0)
    return joined.select(
        *[df[c] for c in df.columns], F.coalesce(F.round("_mean", 6), zero).alias("kernel_mean"),
        F.coalesce(F.col("_best").cast("double"), zero).alias("best"), F.col("_mean").isNotNull().cast("int").alias("has_neighbour"),
    )
