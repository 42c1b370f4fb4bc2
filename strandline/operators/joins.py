"""Range, interval and nearest joins inside groups: cells of the radius or one ordered stream, never a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import in_cells, same


def band_pairs(df: DataFrame, group: list[str], pos: str, radius: int, columns: list[str] | None = None) -> DataFrame:
    """Unordered pairs of a group's rows at most ``radius`` apart: columns suffixed _a and _b, and distance.

    Rows are cut into cells of the radius, so a row only meets its own and the next cell.
    """
    cols = [pos, *(columns or [])]
    cell = F.floor(F.col(pos) / radius)
    a = df.select(*group, *[F.col(c).alias(f"{c}_a") for c in cols], cell.alias("_cell"))
    b = df.select(*[F.col(g).alias(f"_b_{g}") for g in group], *[F.col(c).alias(f"{c}_b") for c in cols], F.explode(F.array(cell, cell - 1)).alias("_cell_b"))
    # the later row visits its own cell and the one before it
    met = a.join(b, same(a, b, {g: f"_b_{g}" for g in group} | {"_cell": "_cell_b"})).drop("_cell_b", *[f"_b_{g}" for g in group]).where((F.col(f"{pos}_a") < F.col(f"{pos}_b")) & (F.col(f"{pos}_b") - F.col(f"{pos}_a") <= radius))
    return met.drop("_cell").withColumn("distance", F.col(f"{pos}_b") - F.col(f"{pos}_a"))


def _carried(stream: DataFrame, group: list[str], order: list[Column], value: str, forward: bool = True) -> tuple[DataFrame, Column]:
    """The stream in cells of its order, and the last value at or before a row (the first at or after it if not ``forward``).

    Inside a cell it is a window; what the cells before hold last is one row a cell and is carried on, so no task
    orders a whole group.
    """
    place = F.struct(*[F.col(c) for c in ("_at", "_kind")])
    pick = F.max_by if forward else F.min_by
    ends = stream.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_cell").alias("_c")).agg(pick(value, F.when(F.col(value).isNotNull(), place)).alias("_end"))
    cells = Window.partitionBy(*[f"_g_{g}" for g in group]).orderBy("_c")
    span = cells.rowsBetween(Window.unboundedPreceding, -1) if forward else cells.rowsBetween(1, Window.unboundedFollowing)
    name = "_before" if forward else "_after"
    ends = ends.withColumn(name, (F.last if forward else F.first)("_end", True).over(span)).drop("_end")
    joined = stream.join(ends, same(stream, ends, {g: f"_g_{g}" for g in group} | {"_cell": "_c"})).drop("_c", *[f"_g_{g}" for g in group])
    inside = Window.partitionBy(*group, "_cell").orderBy(*order)
    own = F.last(value, True).over(inside.rangeBetween(Window.unboundedPreceding, 0) if len(order) == 1 else inside.rowsBetween(Window.unboundedPreceding, 0)) if forward else F.first(value, True).over(inside.rangeBetween(0, Window.unboundedFollowing))
    return joined, F.coalesce(own, F.col(name))


def place_in_intervals(points: DataFrame, intervals: DataFrame, group: list[str], pos: str, how: str = "left") -> DataFrame:
    """Points with the interval [t_start, t_end) of their group that holds them; a group's intervals do not overlap.

    Points and starts are one ordered stream: the last start before a point is the only interval that can hold it.
    """
    others = [c for c in intervals.columns if c not in group]
    at = points.select(*group, F.col(pos).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    starts = intervals.select(*group, F.col("t_start").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(*others).alias("_interval"))
    order = [F.asc("_at"), F.asc("_kind")]
    both, last = _carried(in_cells(at.unionByName(starts, allowMissingColumns=True), group, order), group, order, "_interval")
    placed = both.withColumn("_last", last).where("_kind = 1")
    placed = placed.withColumn("_last", F.when(F.col("_at") < F.col("_last.t_end"), F.col("_last")))
    if how == "inner":
        placed = placed.where("_last is not null")
    return placed.select("_point.*", *[F.col("_last")[c].alias(c) for c in others])


def nearest_event(points: DataFrame, events: DataFrame, group: list[str], pos: str) -> DataFrame:
    """Adds event_gap, the distance to the nearest event of the group on either side (null without events).

    Points and events are one ordered stream, so each side is one running value and nothing multiplies.
    """
    cols = points.columns
    marks = events.select(*group, F.col(pos).alias("_at"), F.lit(0).alias("_kind"), F.col(pos).cast("long").alias("_event"))
    both = points.select("*", F.col(pos).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_event")).unionByName(marks, allowMissingColumns=True)
    stream, back = _carried(in_cells(both, group, [F.asc("_at")]), group, [F.asc("_at")], "_event")
    stream, ahead = _carried(stream.withColumn("_back", back), group, [F.asc("_at")], "_event", forward=False)
    gap = F.least(F.col("_at") - F.col("_back"), ahead - F.col("_at"))
    return stream.withColumn("event_gap", gap).where("_kind = 1").select(*cols, "event_gap")


def audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are on both sides or one only."""
    joined = left.select(*keys).distinct().withColumn("_l", F.lit(1)).join(right.select(*keys).distinct().withColumn("_r", F.lit(1)), keys, "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return joined.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def best_shift(left: DataFrame, right: DataFrame, pos: str, shifts: list[int]) -> DataFrame:
    """Hits of each shift of ``pos`` against the other side's positions: shift, hits."""
    moved = left.select(F.col(pos), F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift")).withColumn(pos, F.col(pos) + F.col("shift"))
    return moved.join(right.select(pos).distinct(), pos, "left_semi").groupBy("shift").agg(F.count(F.lit(1)).alias("hits"))


def band_of(distance: Column, edges: list[int]) -> Column:
    """The label of the half-open band [lo, hi) that holds the distance."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = F.when((distance >= lo) & (distance < hi), f"{lo}-{hi}").otherwise(out)
    return out


def exon_lists(exons: DataFrame, group: str) -> DataFrame:
    """(_g, _exons): a transcript's exons along it, each with its number k and its half-open place [t_start, t_end) on the transcript.

    ``exons`` are closed intervals (group, chrom, strand, start, end); on the minus strand their order runs down. A
    transcript's exons are one list, as they are one molecule; its points are not.
    """
    order = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    length = (F.col("end") - F.col("start") + 1).cast("long")
    row = F.struct(order.alias("o"), "chrom", "strand", "start", "end", length.alias("n"))
    lists = exons.groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(row)).alias("_l"))

    def placed(e: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("_l", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        return F.struct((i + 1).alias("k"), e["chrom"].alias("chrom"), e["strand"].alias("strand"), e["start"].alias("start"), e["end"].alias("end"), before.alias("t_start"), (before + e["n"]).alias("t_end"))

    return lists.select("_g", F.transform("_l", placed).alias("_exons"))


def on_exons(points: DataFrame, exons: DataFrame, group: str, pos: str) -> DataFrame:
    """Points with _exons, their transcript's list, and _exon, the one that holds them (null beyond the last): one join by transcript."""
    lists = exon_lists(exons, group)
    j = points.join(lists, same(points, lists, {group: "_g"}), "left").drop("_g")
    holds = F.filter("_exons", lambda e: (F.col(pos) >= e["t_start"]) & (F.col(pos) < e["t_end"]))
    return j.withColumn("_exon", F.get(holds, F.lit(0)))


def lift_over(points: DataFrame, exons: DataFrame, group: str, pos: str) -> DataFrame:
    """Points with chrom, strand and gpos: the genome's place of a transcript's place, null beyond its last exon.

    ``exons`` are closed intervals (group, chrom, strand, start, end); on the minus strand both order and places run down.
    """
    held = on_exons(points, exons, group, pos)
    e = F.col("_exon")
    into = F.col(pos) - e["t_start"]
    gpos = F.when(e["strand"] == "-", e["end"] - into).otherwise(e["start"] + into)
    return held.select(*points.columns, e["chrom"].alias("chrom"), e["strand"].alias("strand"), gpos.cast("long").alias("gpos"))
