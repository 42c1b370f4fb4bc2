"""Evaluation over rows of (key, score, label): comparisons of arms, resampling by md5, ranks between tables.

Draws are ranks or thresholds of md5 hashes of keys, so they depend on keys and
seeds alone and any SQL engine gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import below, keyed, poisson_weight, region_of, verdict
from . import metrics as M
from .tables import same, saved
from .windows import average_rank, numbered, running_sums

def thin_readings(reads: DataFrame, site: list[str], item: list[str], depths: list[int], seed: str) -> DataFrame:
    """Readings kept at each depth: those of the smallest keyed draws, all where there are fewer; one ranking a depth."""
    at = reads.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    w = Window.partitionBy(*site, "depth").orderBy(keyed(seed, "depth", *site, *item), *item)
    return at.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("depth")).drop("_r")


def thinning_envelope(reads: DataFrame, site: list[str], item: list[str], value: str, depths: list[int], draws: int, seed: str) -> DataFrame:
    """(site, depth, median, p10, p90) of a site's mean over ``draws`` keyed draws of ``depth`` readings each, for every site."""
    # readings are shuffled once; every draw sorts a site's list in place instead of a copy of the table
    sites = reads.groupBy(*site).agg(F.collect_list(F.struct(*[F.col(c).alias(f"i{k}") for k, c in enumerate(item)], F.col(value).cast("double").alias("v"))).alias("_r"))

    def mean(draw: int, depth: int) -> Column:
        def placed(r: Column) -> Column:
            key = F.concat_ws(":", F.lit(f"{seed}:{draw}:{depth}"), *[F.col(c).cast("string") for c in site], *[r[f"i{k}"].cast("string") for k in range(len(item))])
            return F.struct(F.substring(F.md5(key), 1, 8).alias("h"), *[r[f"i{k}"].alias(f"i{k}") for k in range(len(item))], r["v"].alias("v"))

        kept = F.filter(F.transform(F.slice(F.array_sort(F.transform("_r", placed)), 1, depth), lambda r: r["v"]), lambda v: v.isNotNull())
        total = F.aggregate(kept, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n")))
        return F.aggregate(F.array(total), F.lit(None).cast("double"), lambda _, t: t["s"] / F.nullif(t["n"], F.lit(0.0)))

    each = F.array(*[F.struct(F.lit(n).alias("depth"), F.array_sort(F.array_compact(F.array(*[mean(i + 1, n) for i in range(draws)]))).alias("_m")) for n in depths])
    means = sites.select(*site, F.inline(each))

    def level(q: float) -> Column:
        at = (F.size("_m") - 1) * F.lit(q)
        low, high = F.get("_m", F.floor(at).cast("int")), F.get("_m", F.ceil(at).cast("int"))
        return F.when(F.size("_m") > 0, low + (high - low) * (at - F.floor(at)))

    return means.select(*site, "depth", level(0.5).alias("median"), level(0.1).alias("p10"), level(0.9).alias("p90"))


def depth_sweep(scored: DataFrame, full: int) -> DataFrame:
    """Metrics of each depth of (depth, s, y), and the share of the deepest average precision that is retained."""
    m = saved(M.ap_and_auc(scored, ["depth"], "s", "y").select("depth", "ap", "auc"), "depths")  # a row a depth
    top = m.where(F.col("depth") == full).select(F.col("ap").alias("_full"))  # one row
    return m.join(F.broadcast(top), how="cross").select("depth", "ap", "auc", (F.col("ap") / F.nullif(F.col("_full"), F.lit(0.0))).alias("retained"))


def align_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observations that both runs hold, as value_a and value_b; a key twice in one run is an error."""

    def once(df: DataFrame, name: str) -> DataFrame:
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(name))
        return g.withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.raise_error(F.lit("an observation occurs twice")))).drop("_n")

    return once(a, f"{value}_a").join(once(b, f"{value}_b"), keys)


def contract_mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many keys only one side holds, and on how many both hold another value: one row, all 0 for equal tables."""
    j = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r")), keys, "full")
    return j.agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"),
    )


def paired(obs: DataFrame, group: list[str], a: str, b: str, folds: int, least: int = 2) -> DataFrame:
    """Paired differences of two arms by group: n, mean, share of wins, and t with the naive and the corrected variance.

    The corrected variance of repeated folds is var * (1 / n + 1 / (folds - 1)). Groups with fewer than ``least`` pairs are left out.
    """
    d = F.col(a) - F.col(b)
    g = obs.where(d.isNotNull()).groupBy(*group).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("_v"), F.avg((d > 0).cast("double")).alias("wins"))
    g = g.where(F.col("n") >= least)

    def t(factor: Column) -> Column:
        return F.col("mean") / F.nullif(F.sqrt(F.col("_v") * factor), F.lit(0.0))

    return g.withColumns({"t_naive": t(1 / F.col("n")), "t_corrected": t(1 / F.col("n") + 1 / (folds - 1))}).drop("_v")


def weighted_ap_auc(df: DataFrame, group: list[str], order: list[Column], label: str, weight: str) -> DataFrame:
    """Average precision and AUC of rows in their given order, each row a step of its own, whatever scores tie.

    ``order`` tells all rows of a group apart; running sums are made of ranges of it.
    """
    y, x = F.col(label).cast("double"), F.col(weight).cast("double")
    r = running_sums(df.withColumns({"_p": x * y, "_n": x * (1 - y), "_x": x}), group, order, {"_p": "_tp", "_x": "_all"})
    positives, negatives = F.sum("_p"), F.sum("_n")
    ap = F.sum(F.col("_p") * F.col("_tp") / F.nullif(F.col("_all"), F.lit(0.0))) / F.nullif(positives, F.lit(0.0))
    auc = F.sum(F.col("_n") * F.col("_tp")) / F.nullif(positives * negatives, F.lit(0.0))
    return r.groupBy(*group).agg(ap.alias("ap"), auc.alias("auc"))


def envelope(curve: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """y replaced by its largest value at this x or beyond: the falling envelope of a precision-recall curve."""
    w = Window.partitionBy(*group).orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, 0)
    return curve.withColumn(y, F.max(y).over(w))


def bootstrap_ap(df: DataFrame, cluster: list[str], arms: list[str], label: str, resamples: int, seed: str, group: list[str] | None = None) -> DataFrame:
    """Average precision of every arm in each Poisson resample of clusters: (group, resample, arm, ap).

    All arms and groups share a resample's draws, which are made before the arms are told apart. Drawn rows are summed by
    score at once: no table of clusters and scores, which is as long as the rows, is shuffled. Resamples without positives are left out.
    """
    group = group or []
    drawn = df.select(*group, *cluster, *arms, F.col(label).cast("long").alias("_y"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    drawn = drawn.withColumn("_w", poisson_weight(keyed(seed, "resample", *cluster))).where("_w > 0")
    keys = [*group, "resample", "arm"]
    long = drawn.select(*group, "resample", "_w", "_y", F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("s")) for a in arms])))
    t = long.groupBy(*keys, "s").agg(F.sum(F.col("_w") * F.col("_y")).alias("tp"), F.sum("_w").cast("long").alias("n"))
    t = running_sums(t, keys, "s", {"tp": "ctp", "n": "cn"}, descending=True)
    sums = t.groupBy(*keys).agg(F.sum("tp").alias("_p"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("_x")).where("_p > 0")
    return sums.select(*keys, (F.col("_x") / F.col("_p")).alias("ap"))


def head_to_head(rows: DataFrame, group: list[str], a: str, b: str, label: str, cluster: str, resamples: int, seed: str, least: int = 20) -> DataFrame:
    """Two scores of the same rows, for each group with ``least`` positives: n, positives, ap of both, their difference and its interval, wins."""
    rows = saved(rows.select(*group, a, b, label, cluster), "head-to-head")
    ours, theirs = (M.ap_and_auc(rows, group, x, label).select(*group, F.col("ap").alias(f"ap_{n}"), F.col("auc").alias(f"auc_{n}"), "n", "positives") for x, n in ((a, "a"), (b, "b")))
    boot = bootstrap_ap(rows, [cluster], [a, b], label, resamples, seed, group)
    by_arm = boot.groupBy(*group, "resample").agg((F.max(F.when(F.col("arm") == a, F.col("ap"))) - F.max(F.when(F.col("arm") == b, F.col("ap")))).alias("_d"))
    spread = interval(by_arm.where("_d is not null"), group, "_d").select(*group, "low", "high", F.col("share_positive").alias("wins"))
    out = ours.where(F.col("positives") >= least)
    for other in (theirs.drop("n", "positives"), spread):
        other = other.toDF(*[f"_g_{g}" for g in group], *[c for c in other.columns if c not in group])
        out = out.join(other, same(out, other, {g: f"_g_{g}" for g in group})).drop(*[f"_g_{g}" for g in group])
    return out.withColumn("gain", F.col("ap_a") - F.col("ap_b"))


def by_type(rows: DataFrame, families: dict[str, Column], draws: list[str], label: str, cluster: str, least: int) -> DataFrame:
    """(family, type, n, positives, clusters, pair_accuracy, draw_sd, note): each draw's AUC in every type of every family, and their mean.

    Types with fewer than ``least`` of either class get a note and no number.
    """
    kinds = F.array(*[F.struct(F.lit(f).alias("family"), c.cast("string").alias("type")) for f, c in families.items()])
    long = saved(rows.select(label, cluster, *draws, F.inline(kinds)), "types")
    keys = ["family", "type"]
    each = long.select(*keys, label, F.inline(F.array(*[F.struct(F.lit(d).alias("draw"), F.col(d).cast("double").alias("s")) for d in draws])))
    auc = M.roc_auc(each, [*keys, "draw"], "s", label).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg("auc").alias("_mean"), F.stddev_pop("auc").alias("_sd"))
    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.count_distinct(cluster).alias("clusters"))
    few = F.least(F.col("positives"), F.col("n") - F.col("positives")) < least
    out = n.join(auc, same(n, auc, {k: f"_{k}" for k in keys}), "left")
    return out.select(*keys, "n", "positives", "clusters", F.when(~few, F.col("_mean")).alias("pair_accuracy"), F.when(~few, F.col("_sd")).alias("draw_sd"), F.when(few, "too few to judge").otherwise("").alias("note"))


def interval(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Number, mean and central 95 % of resampled values, and the share above 0."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = values.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("_q"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"))
    return g.select(*group, "n", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "share_positive")


def union_folds(first: DataFrame, second: DataFrame, key: str, folds: int, seed: str) -> DataFrame:
    """(key, fold, origin): the first table's folds as they are; keys of the second alone are dealt out among themselves."""
    new = second.select(key).distinct().join(first.select(key), key, "left_anti")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", key)) - 1
    new = new.withColumn("_h", keyed(seed, key)).withColumn("_cell", F.substring("_h", 1, 3))
    sizes = new.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4,096 cells
    new = new.join(F.broadcast(sizes.select("_cell", before.alias("_before"))), "_cell").select(key, ((F.col("_before") + place) % folds).cast("long").alias("fold"))
    return first.select(key, F.col("fold").cast("long").alias("fold"), F.lit("first").alias("origin")).unionByName(new.withColumn("origin", F.lit("second")))


def thin_labels(df: DataFrame, key: list[str], label: str, rate: float, seed: str) -> DataFrame:
    """df with only round(rate * n) of its positive rows kept positive, those of the smallest keyed draws.

    Draws are counted in 4,096 cells first, so only the cell at the cut is ranked.
    """
    y = df.withColumn("_h", keyed(seed, *key)).withColumn("_cell", F.substring("_h", 1, 3))
    sizes = y.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_k"))
    w = Window.orderBy("_cell")
    sizes = sizes.select("_cell", F.coalesce(F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    y = y.join(F.broadcast(sizes), "_cell")
    place = F.sum(F.col(label).cast("long")).over(Window.partitionBy("_cell").orderBy("_h", *key).rowsBetween(Window.unboundedPreceding, 0))
    kept = (F.col(label) == 1) & (F.col("_before") + place <= F.round(F.lit(rate) * F.col("_all")))
    return y.withColumn(label, kept.cast("int")).drop("_h", "_cell", "_before", "_all")


def cross_source_summary(cells: DataFrame, base: str, least: float = -0.005) -> DataFrame:
    """Gains of every arm over the base on two sources (arm, source, metric), the worse of both, and whether that is allowed."""
    b = cells.where(F.col("arm") == base).select("source", F.col("metric").alias("_b"))
    g = cells.where(F.col("arm") != base).join(F.broadcast(b), "source").withColumn("gain", F.col("metric") - F.col("_b"))
    worst = F.min("gain")
    return g.groupBy("arm").agg(F.avg("gain").alias("mean_gain"), worst.alias("worst_gain"), F.count(F.lit(1)).alias("sources"), (worst >= least).alias("eligible"))


def keep_scored(arms: dict[str, DataFrame], keys: list[str], least_share: float = 0.999) -> DataFrame:
    """Rows that every arm scores, one column an arm; fewer than ``least_share`` of any arm's rows is an error."""
    out = None
    for name, df in arms.items():
        part = df.select(*keys, F.col("s").alias(name))
        out = part if out is None else out.join(part, keys, "full")
    share = out.agg(*[F.avg(F.col(n).isNotNull().cast("double")).alias(n) for n in arms])
    guard = F.least(*[F.col(f"_share.{n}") for n in arms]) if len(arms) > 1 else F.col(f"_share.{next(iter(arms))}")
    share = share.select(F.struct(*arms).alias("_share"))
    whole = out.dropna(subset=list(arms)).join(F.broadcast(share), how="cross")
    checked = F.when(guard >= least_share, F.col(next(iter(arms)))).otherwise(F.raise_error(F.lit("an arm leaves too many rows unscored")))
    return whole.withColumn(next(iter(arms)), checked).drop("_share")


def averaged_labels(own: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """own's rows with y the mean of both labellings where both judge a row, else its own."""
    return own.join(other.select(*keys, F.col("y").alias("_o")), keys, "left").withColumn("y", F.coalesce((F.col("y") + F.col("_o")) / 2.0, F.col("y").cast("double"))).drop("_o")


def rank_shift(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shared rows of two tables (s, y): how far the rank moves from the first to the second, by how the labels agree."""
    ra, rb = (average_rank(t.select(*keys, "s", F.col("y").alias(f"y{n}")), [], "s", f"r{n}", share=True).drop("s") for t, n in ((a, "a"), (b, "b")))
    j = ra.join(rb, keys)
    kind = F.when((F.col("ya") == 1) & (F.col("yb") == 1), "both").when(F.col("ya") == 1, "first").when(F.col("yb") == 1, "second").otherwise("neither")
    return j.groupBy(kind.alias("agreement")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("rb") - F.col("ra")).alias("mean_shift"))


def rank_in_sample(new: DataFrame, sample: DataFrame, score: str) -> DataFrame:
    """Adds place: the average rank share of each score within a stored sample, (below + at or below + 1) / 2 / n."""
    new = saved(new, "rows-to-place")  # their scores are computed once
    zero = new.groupBy(F.col(score).alias("_s")).agg(F.lit(0).cast("long").alias("_n"))
    counts = zero.unionByName(sample.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))).groupBy("_s").agg(F.sum("_n").alias("_n"))
    place = running_sums(counts, [], "_s", {"_n": "_le"})
    place = place.join(F.broadcast(place.agg(F.max("_le").alias("_all"))), how="cross")  # one row
    place = place.select(F.col("_s").alias(score), ((F.col("_le") - F.col("_n") + F.col("_le") + 1) / 2.0 / F.col("_all")).alias("place"))
    return new.join(place, score)


def out_of_fold(parts: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    """One score a key from per-fold columns of which all but one are null; keys with none or several are counted, not guessed."""
    g = parts.groupBy(*keys).agg(F.max("s").alias("s"), F.count("s").alias("_n"))
    return g.select(*keys, F.when(F.col("_n") == 1, F.col("s")).alias("s"), F.col("_n").alias("n_scores"))


def fold_distribution(scored: DataFrame, group: list[str]) -> DataFrame:
    """Average precision and AUC of every fold, as mean, deviation, least and most by group (fold is a column)."""
    m = M.ap_and_auc(scored, [*group, "fold"], "s", "y")
    cols = [f(c).alias(f"{c}_{n}") for c in ("ap", "auc") for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return m.groupBy(*group).agg(F.count(F.lit(1)).alias("folds"), *cols)


def density_view(sites: DataFrame, group: list[str], pos: str, width: int, share: float, seed: str) -> DataFrame:
    """Adds n_seen: neighbours within ``width`` of which each is seen with chance ``share``, drawn once a site."""
    seen = sites.withColumn("_seen", below(keyed(seed, *group, pos), share).cast("int"))
    w = Window.partitionBy(*group).orderBy(pos).rangeBetween(-width, width)
    return seen.withColumn("n_seen", F.sum("_seen").over(w) - F.col("_seen")).drop("_seen")


def circular_views(sites: DataFrame, group: list[str], pos: str, share: float, seed: str) -> DataFrame:
    """(view, home, *sites): every site in the views that hold it; each other site shares a site's home view with chance ``share``.

    A keyed draw places each site on a circle; view j holds the arc of length ``share`` from j * share on, and a site's
    home is the arc that its place begins in. Neighbour features are computed on a view and kept where ``home`` is true.
    Places are whole numbers below 2**32 and arcs are rounded to them, so any engine cuts them alike.
    """
    whole = 1 << 32
    arc, views = round(share * whole), -(-whole // round(share * whole))
    at = sites.withColumn("_u", F.conv(keyed(seed, *group, pos), 16, 10).cast("long"))
    each = at.withColumn("view", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(views - 1).cast("long"))))
    inside = each.where(F.pmod(F.col("_u") - F.col("view") * F.lit(arc), F.lit(whole)) < arc)
    return inside.withColumn("home", F.floor(F.col("_u") / arc) == F.col("view")).drop("_u")


def covered(sites: DataFrame, depth: str, share: float, least: int) -> DataFrame:
    """The sites that a run at this share of the depth would still hold."""
    return sites.where(F.col(depth) * share >= least)


def without_neighbours(sites: DataFrame, group: list[str], seed: str) -> DataFrame:
    """One site of each group, that of the smallest keyed draw: every site a single one. Ties go to the smaller columns."""
    rest = [c for c in sites.columns if c not in group]
    first = F.min(F.struct(keyed(seed, *sites.columns).alias("_h"), F.struct(*rest).alias("_row"))).alias("_b")
    return sites.groupBy(*group).agg(first).select(*group, "_b._row.*")


def homophily(sites: DataFrame, group: list[str], pos: str, label: str, width: int, seeds: list[str]) -> DataFrame:
    """Lift of positives next to a positive over those next to none, as they are (draw 0) and with labels shuffled in each group.

    A shuffle deals a group's labels, in order of position, to its places in order of a keyed draw.
    """
    base = sites.select(*group, pos, F.col(label).alias("_y"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(pos))
    worlds = base.withColumn("draw", F.lit(0))
    for i, seed in enumerate(seeds):
        at = base.drop("_y").withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(keyed(seed, *group, pos), pos)))
        dealt = at.join(base.withColumn("_k", place).drop(pos), [*group, "_k"]).drop("_k")
        worlds = worlds.unionByName(dealt.withColumn("draw", F.lit(i + 1)))
    w = Window.partitionBy("draw", *group).orderBy(pos).rangeBetween(-width, width)
    near = (F.sum("_y").over(w) - F.col("_y")) > 0
    alone = (F.count(F.lit(1)).over(w)) == 1
    r = worlds.select("draw", F.col("_y").cast("double").alias("_y"), near.alias("_near"), alone.alias("_alone")).where("not _alone")
    with_, without = F.avg(F.when(F.col("_near"), F.col("_y"))), F.avg(F.when(~F.col("_near"), F.col("_y")))
    return r.groupBy("draw").agg(with_.alias("rate_near"), without.alias("rate_apart"), (with_ / F.nullif(without, F.lit(0.0))).alias("lift"))


def drawn_number(seed: str, *columns: str) -> Column:
    """An even draw of 0 to 2**32 - 1 for each key."""
    return F.conv(keyed(seed, *columns), 16, 10).cast("long")


def donors(rows: DataFrame, key: list[str], group: str, item: str, seed: str) -> DataFrame:
    """Adds donor: another row of the same key and of another group, each with the same chance; null only where there is none.

    A key's rows are numbered by group, so a row's own group is one block of numbers. A keyed draw picks one of the
    other numbers, and the row of that number is joined.
    """
    r = saved(numbered(rows.select(*key, group, item), key, [F.asc(group), F.asc(item)], "_at"), "numbered")
    blocks = r.groupBy(*key, group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    sizes = r.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.count(F.lit(1)).alias("_all"))
    blocks = blocks.join(sizes, same(blocks, sizes, {k: f"_k_{k}" for k in key})).select(*[F.col(k).alias(f"_b_{k}") for k in [*key, group]], "_first", "_m", "_all")
    asked = rows.join(blocks, same(rows, blocks, {k: f"_b_{k}" for k in [*key, group]})).select(*[rows[c] for c in rows.columns], "_first", "_m", "_all")
    number = drawn_number(seed, *key, item) % F.nullif(F.col("_all") - F.col("_m"), F.lit(0))
    asked = asked.withColumn("_want", number + F.when(number >= F.col("_first"), F.col("_m")).otherwise(0))
    held = r.select(*[F.col(k).alias(f"_d_{k}") for k in key], F.col("_at"), F.col(item).alias("donor"))
    out = asked.join(held, same(asked, held, {k: f"_d_{k}" for k in key} | {"_want": "_at"}), "left")
    return out.select(*[asked[c] for c in rows.columns], "donor")


def replacement_worlds(rows: DataFrame, item: str, group: str, kind: str, value: str, seed: str) -> DataFrame:
    """(world, item, group, kind, value): four worlds in which neighbours are replaced.

    ``value``: the value of a row of the same kind in another group (its own where there is none). ``kind``: the kind of
    any row. ``both``: kind and value of any row. ``baseline``: the value less its group's mean, plus the mean of all.
    """
    own = saved(rows.select(item, group, kind, value), "world")
    columns = [item, group, kind, value]
    given = own.select(F.col(item).alias("_i"), F.col(value).alias("_v"), F.col(kind).alias("_k"))
    same_kind = donors(own, [kind], group, item, f"{seed}-value")
    same_kind = same_kind.join(given, F.col("donor") == F.col("_i"), "left").select(item, group, kind, F.coalesce("_v", value).alias(value))
    all_rows = saved(numbered(own, [], [F.asc(item)], "_at"), "numbered")
    total = all_rows.agg(F.count(F.lit(1)).alias("_all"))  # one row
    held = all_rows.select("_at", F.col(kind).alias("_k"), F.col(value).alias("_v"))

    def any_row(name: str) -> DataFrame:
        asked = own.join(F.broadcast(total), how="cross").withColumn("_want", drawn_number(f"{seed}-{name}", item) % F.col("_all"))
        return asked.join(held, F.col("_want") == F.col("_at"))

    means = own.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_m"))
    overall = own.agg(F.avg(value).alias("_o"))
    level = own.join(means, F.col(group).eqNullSafe(F.col("_g"))).join(F.broadcast(overall), how="cross")
    worlds = {
        "value": same_kind,
        "kind": any_row("kind").select(item, group, F.col("_k").alias(kind), value),
        "both": any_row("both").select(item, group, F.col("_k").alias(kind), F.col("_v").alias(value)),
        "baseline": level.select(item, group, kind, (F.col(value) - F.col("_m") + F.col("_o")).alias(value)),
    }
    parts = [w.select(F.lit(name).alias("world"), *columns) for name, w in worlds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def standardised(reads: DataFrame, columns: list[str], logged: list[str]) -> DataFrame:
    """Columns less their mean over their deviation (1 where it is 0), the logged ones on a log scale with a floor."""
    x = reads.withColumns({c: F.ln(F.greatest(F.col(c).cast("double"), F.lit(1e-6))) for c in logged})
    stats = x.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return x.join(F.broadcast(stats), how="cross").withColumns(z).select(*reads.columns)


def linear_cka(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Linear kernel alignment of two sets of columns and each side's participation ratio, from covariances alone: one row."""

    def square(a: list[str], b: list[str]) -> Column:
        return sum((F.pow(F.covar_pop(x, y), 2) for x in a for y in b), F.lit(0.0))

    def spread(a: list[str]) -> Column:
        return F.pow(sum((F.var_pop(x) for x in a), F.lit(0.0)), 2) / F.nullif(square(a, a), F.lit(0.0))

    cka = square(left, right) / F.nullif(F.sqrt(square(left, left) * square(right, right)), F.lit(0.0))
    return df.agg(cka.alias("cka"), spread(left).alias("spread_left"), spread(right).alias("spread_right"))


def column_audit(df: DataFrame, columns: list[str], level: str) -> DataFrame:
    """For each column: the shift of every level's mean from that of level 0, in deviations of level 0 (null where 0)."""
    long = df.select(level, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns])))
    means = long.groupBy("column", level).agg(F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"))
    zero = means.where(F.col(level) == 0).select("column", F.col("_m").alias("_m0"), F.col("_s").alias("_s0"))
    return means.join(F.broadcast(zero), "column").select("column", level, ((F.col("_m") - F.col("_m0")) / F.nullif(F.col("_s0"), F.lit(0.0))).alias("shift"))


def audit_shapes(shifts: DataFrame, level: str, last: float) -> DataFrame:
    """For each column of ``column_audit``: rank correlation of shift and level, the level and shift of its peak, the shift at ``last``, and the hump between.

    A hump is how much larger the peak's shift is than the last one's; of equal peaks the lowest level counts.
    """
    known = saved(shifts.where("shift is not null"), "shifts")
    ranked = average_rank(average_rank(known, ["column"], level, "_a"), ["column"], "shift", "_b")
    size = F.abs("shift")
    end = F.max(F.when(F.col(level) == last, F.col("shift")))
    peak = F.max_by(F.struct(F.col(level).alias("l"), F.col("shift").alias("s")), F.struct(size, -F.col(level)))
    g = ranked.groupBy("column").agg(F.corr("_a", "_b").alias("monotonic"), peak.alias("_p"), end.alias("shift_at_last"), F.max(size).alias("_top"))
    return g.select("column", "monotonic", F.col("_p.l").alias("peak"), F.col("_p.s").alias("shift_at_peak"), "shift_at_last", (F.col("_top") - F.abs("shift_at_last")).alias("hump"))


def window_links(points: DataFrame, sites: DataFrame, group: list[str], flank: int) -> DataFrame:
    """Site pairs (a < b) and the largest value of the point pairs (x, y, v) whose ends lie within ``flank`` of each.

    Positions go to the 2 * flank + 1 places that own them, so both joins are on equal places.
    """
    owned = sites.select(*group, F.col("p").alias("site"), F.explode(F.sequence(F.col("p") - flank, F.col("p") + flank)).alias("at"))
    one = points.join(owned.withColumnRenamed("site", "a").withColumnRenamed("at", "x"), [*group, "x"])
    both = one.join(owned.withColumnRenamed("site", "b").withColumnRenamed("at", "y"), [*group, "y"]).where(F.col("a") != F.col("b"))
    return both.groupBy(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("v").alias("v"))
