"""Grading of scored sites against a truth on the genome: lift-over, shift, deepest copy, bands, precision at a recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lift_over
from .metrics import ap_and_auc
from .tables import saved
from .windows import average_rank, running_sums, same

PLACE = ["chrom", "gpos", "strand"]


def deepest(rows: DataFrame, place: list[str], depth: str, ties: list[str]) -> DataFrame:
    """One row of each place: the one of the largest depth, then of the smallest ties."""
    rest = [c for c in rows.columns if c not in place]
    best = F.min(F.struct((-F.col(depth)).alias("_d"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)], F.struct(*rest).alias("_row"))).alias("_b")
    return rows.groupBy(*place).agg(best).select(*place, "_b._row.*")


def best_offset(truth: DataFrame, places: DataFrame, shifts: list[int]) -> DataFrame:
    """One row: the shift of truth's gpos that lands most of it on the places (the first of equals), its hits, and the number of truths."""
    moved = truth.select("chrom", "strand", "gpos", F.explode(F.array(*map(F.lit, shifts))).alias("shift")).withColumn("gpos", F.col("gpos") + F.col("shift"))
    hits = moved.join(places.select(*PLACE).distinct().withColumn("_on", F.lit(1)), PLACE, "left").groupBy("shift").agg(F.count("_on").alias("hits"), F.count(F.lit(1)).alias("n"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(shifts) for x in (s, i)]), F.col("shift"))
    return hits.agg(F.max_by(F.struct("shift", "hits", "n"), F.struct("hits", -place)).alias("b")).select("b.*")


def place_and_label(sites: DataFrame, exons: DataFrame, truth: DataFrame, ties: list[str], shifts: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """Sites on the genome, the deepest copy of each place, with label and ratio of the truth moved by its best shift.

    ``sites`` have tx, pos, gene and n_reads, ``exons`` tx, chrom, strand, start and end, ``truth`` chrom, gpos, strand
    and ratio. Only genes with a true site stay, as the others say nothing about the truth's coverage.
    """
    held = lift_over(sites, exons, "tx", "pos").where("gpos is not null")
    kept = saved(deepest(held, PLACE, "n_reads", ties), "placed-sites")
    shift = best_offset(truth, kept, list(shifts))  # one row
    moved = truth.join(F.broadcast(shift.select("shift")), how="cross").withColumn("gpos", F.col("gpos") + F.col("shift")).groupBy(*PLACE).agg(F.max("ratio").alias("ratio"))
    labelled = kept.join(moved, PLACE, "left").withColumn("label", F.col("ratio").isNotNull().cast("int"))
    covered = labelled.where("label = 1").select("gene").distinct()
    return labelled.join(covered, "gene", "left_semi")


def precision_at_recall(rows: DataFrame, group: list[str], order: list[Column], label: str, recall: DataFrame) -> DataFrame:
    """(group, precision): of the shortest head of the order that holds the share ``recall`` (a one-row table) of a group's positives.

    Heads are running sums over ranges of the order, so no group is ordered in one task.
    """
    r = running_sums(rows.withColumns({"_y": F.col(label).cast("long"), "_one": F.lit(1).cast("long")}), group, order, {"_y": "_tp", "_one": "_n"})
    totals = r.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.max("_tp").alias("_all"))
    j = r.join(totals, same(r, totals, {g: f"_g_{g}" for g in group})).join(F.broadcast(recall.toDF("_recall")), how="cross")
    reached = j.where(F.col("_tp") >= F.col("_recall") * F.col("_all") - 1e-9)
    return reached.groupBy(*group).agg(F.min_by(F.col("_tp") / F.col("_n"), "_n").alias("precision"))


def precision_of_top(rows: DataFrame, group: list[str], order: list[Column], label: str, share: float = 0.01) -> DataFrame:
    """(group, precision_top): of the first max(1, round(share * n)) rows of each group's order; halves round to even."""
    r = running_sums(rows.withColumns({"_y": F.col(label).cast("long"), "_one": F.lit(1).cast("long")}), group, order, {"_y": "_tp", "_one": "_n"})
    sizes = r.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.greatest(F.lit(1), F.bround(F.lit(share) * F.max("_n"), 0).cast("long")).alias("_k"))
    at = r.join(sizes, same(r, sizes, {g: f"_g_{g}" for g in group})).where("_n = _k")
    return at.select(*group, (F.col("_tp") / F.col("_n")).alias("precision_top"))


def grade(rows: DataFrame, group: list[str], score: str, ties: list[str], label: str, recall: DataFrame, least: int = 20) -> DataFrame:
    """Metrics of each group with at least ``least`` positives and a negative: n, positives, rate, ap, lift, auc, precision of the top 1 % and at the recall."""
    order = [F.desc(score), *[F.asc(c) for c in ties]]
    m = saved(ap_and_auc(rows, group, score, label).where((F.col("positives") >= least) & (F.col("positives") < F.col("n"))), "grades")
    rate = F.col("positives") / F.col("n")
    out = m.withColumns({"rate": rate, "lift": F.col("ap") / rate})
    for extra in (precision_of_top(rows, group, order, label), precision_at_recall(rows, group, order, label, recall)):
        e = extra.toDF(*[f"_g_{g}" for g in group], extra.columns[-1])
        out = out.join(e, same(out, e, {g: f"_g_{g}" for g in group})).drop(*[f"_g_{g}" for g in group])
    return out


def with_bands(rows: DataFrame, band: Column) -> DataFrame:
    """Each row in its band and in ``all``."""
    return rows.withColumn("band", F.explode(F.array(F.lit("all"), band)))


def rank_correlation(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, rho): Spearman's correlation, ties at their mean rank."""
    r = average_rank(average_rank(rows.select(*group, x, y), group, x, "_x"), group, y, "_y")
    return r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))
