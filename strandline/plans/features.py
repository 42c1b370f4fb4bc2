"""Feature families over the driver's tables, each with DuckDB SQL: part and supplier stand for a site, its lines for readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..sources.sites import READ_COLUMNS
from .catalog import _cov_sql, leading_sql, query, table

#: Readings of a line: nine numbers, positive where a measurement must be; the factor keeps means off the edges of rounding.
_READING = {
    "dwell_m1": "(1 + l_discount * 100 + l_linenumber) * 0.7310585786",
    "sd_m1": "(l_tax * 50 + 0.5) * 0.7310585786",
    "mean_m1": "(l_quantity + l_discount * 20) * 0.7310585786",
    "dwell_0": "(l_extendedprice / 1000) * 0.7310585786",
    "sd_0": "(l_discount * 30 + l_tax * 10 + 0.25) * 0.7310585786",
    "mean_0": "(l_quantity - l_tax * 40) * 0.7310585786",
    "dwell_p1": "(l_quantity * 0.1 + l_linenumber) * 0.7310585786",
    "sd_p1": "(l_extendedprice / 20000 + l_tax) * 0.7310585786",
    "mean_p1": "(l_quantity * 1.5 - l_linenumber * 2) * 0.7310585786",
}
_KMER = (
    "concat(substr('ACGT', cast(l_partkey % 4 + 1 as int), 1), substr('AGT', cast(l_partkey % 3 + 1 as int), 1), substr('AG', cast(l_partkey % 2 + 1 as int), 1), 'AC', "
    "substr('ACT', cast(l_suppkey % 3 + 1 as int), 1), substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1))"
)


def readings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.expr("l_suppkey % 20").alias("t"), F.col("l_partkey").alias("p"), F.expr(_KMER).alias("kmer"), *[F.expr(f"cast({e} as double)").alias(c) for c, e in _READING.items()])


R = f"""r as (select l_suppkey % 20 t, l_partkey p, {_KMER} kmer, {", ".join(f"cast({e} as double) {c}" for c, e in _READING.items())} from lineitem)"""


def _out(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("t", "p", *[F.round(c, 6).alias(c) for c in columns])


def _sql(columns: dict[str, str]) -> str:
    return f"with {R} select t, p, " + ", ".join(f"round({e}, 6) {c}" for c, e in columns.items()) + " from r group by t, p"


_POOLED = {f"{c}_{n}": f"{f}({c})" for c in READ_COLUMNS for n, f in (("mean", "avg"), ("std", "stddev_pop"))}
_COUNTS = {"n_reads": "cast(count(*) as double)", "log_n_reads": "ln(1 + count(*))"}
_MOTIFS = {f"motif_{m}": f"case when substr(min(kmer), 2, 5) = '{m}' then 1.0::double else 0.0::double end" for m in X.MOTIFS}
_QUANTILES = {f"{c}_q{round(q * 100):02d}": f"quantile_cont({c}, {q})" for c in READ_COLUMNS for q in X.QUANTILES} | {
    f"{c}_{n}": f"quantile_cont({c}, {hi}) - quantile_cont({c}, {lo})" for c in READ_COLUMNS for n, hi, lo in (("iqr", 0.75, 0.25), ("tail", 0.95, 0.05))
}


@query(_sql(_POOLED | _COUNTS | _MOTIFS))
def feature_set_pooled(spark, d):
    f = X.feature_set(readings(spark, d), "pooled_v1")
    return _out(f, f.columns[2:])


@query(_sql(_POOLED | _QUANTILES | _COUNTS | _MOTIFS))
def feature_set_quantiles(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_v1")
    return _out(f, f.columns[2:])


@query(_sql({f"{s}_{b}": f"case when substr(min(kmer), {i}, 1) = '{b}' then 1.0::double else 0.0::double end" for s, i in (("left", 1), ("right", 7)) for b in X.BASES}))
def feature_family_flank(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_flank_v1")
    return _out(f, [c for c in f.columns if c.startswith(("left_", "right_"))])


_CS, _GRAD = "{m}_0 - 0.5 * ({m}_m1 + {m}_p1)", "{m}_p1 - {m}_m1"
_GRID = [("cs", _CS, (5, 50, 95)), ("grad", _GRAD, (5, 95)), ("absgrad", f"abs({_GRAD})", (50, 95))]


@query(_sql({f"grid_{m}_{k}_q{q:02d}": f"quantile_cont({e.format(m=m)}, {q / 100})" for m in X.MEASURES for k, e, qs in _GRID for q in qs}))
def feature_family_grid(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_grid_v1")
    return _out(f, [c for c in f.columns if c.startswith("grid_")])


def _corr(x: str, y: str) -> str:
    r = f"least(greatest(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), -1), 1)"
    return f"case when count(*) < 5 then 0 else coalesce({r}, 0) end"


_COUPLED = {f"coupling_{m}_{a}_{b}": _corr(f"{m}_{a}", f"{m}_{b}") for m, a, b in X._ACROSS}
_COUPLED |= {f"coupling_{m}_mean": "(" + " + ".join(_corr(f"{m}_{a}", f"{m}_{b}") for n, a, b in X._ACROSS if n == m) + ") / 3.0" for m in X.MEASURES}
_COUPLED |= {f"coupling_chan_{a}_{b}": _corr(f"{a}_0", f"{b}_0") for a, b in X._CHANNELS}


@query(_sql(_COUPLED))
def feature_family_coupling(spark, d):
    return _out(X.feature_set(readings(spark, d), "quantiles_coupling_v1"), list(_COUPLED))


def _directions_sql() -> str:
    parts = []
    for m in X.MEASURES:
        sound = "n >= 5 and least(xx, yy, zz) > 0 and total > 0"
        cov = _cov_sql([f"{m}_{x}" for x in X.PLACES], "covar_pop")
        parts.append(f"""{m} as (with c as (select t, p, count(*) n, {cov} from r group by t, p), {leading_sql("c", "t, p")}
select t, p, round(case when {sound} then (abs(v0) + abs(v1) + abs(v2)) / sqrt(3.0) else 0 end, 6) coupling_{m}_align111, round(case when {sound} then largest / total else 0 end, 6) coupling_{m}_lead_frac from e4)""")
    return f"with {R}, {', '.join(parts)} select * from {X.MEASURES[0]} {' '.join(f'join {m} using (t, p)' for m in X.MEASURES[1:])}"


@query(_directions_sql())
def feature_family_directions(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_coupling_v1")
    return _out(f, [c for c in f.columns if c.endswith(("_align111", "_lead_frac"))])


def _logged(c: str) -> str:
    return c if c.startswith("mean") else f"ln(greatest({c}, 1e-6))"


@query(_sql({f"moments_{x}__{y}": _corr(_logged(x), _logged(y)) for x, y in X.MOMENT_PAIRS}))
def feature_family_moments(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_all_moments_v1", ("moments_",))
    return _out(f, [c for c in f.columns if c.startswith("moments_")])


_UP = {c: f"(case when {c} > h_{c} + 1e-9 then 1 else 0 end)" for c in READ_COLUMNS}
_EXT = {c: f"(case when {c} > h_{c} + 1e-9 or {c} < l_{c} - 1e-9 then 1 else 0 end)" for c in READ_COLUMNS}


@query(f"""with {R}, q as (select t, p, {", ".join(f"quantile_cont({c}, 0.1) l_{c}, quantile_cont({c}, 0.9) h_{c}" for c in READ_COLUMNS)} from r group by t, p),
x as (select t, p, {" + ".join(_EXT.values())} x, {" + ".join(_UP.values())} u, {" + ".join(_EXT[c] for c in X.CENTRAL)} c from r join q using (t, p))
select t, p, round(avg(x), 6) joint_coex_mean, cast(max(x) as double) joint_coex_max, {", ".join(f"round(avg(case when x >= {k} then 1.0 else 0.0 end), 6) joint_coex_frac_ge{k}" for k in (2, 3, 4))},
round(avg(case when u >= 2 then 1.0 else 0.0 end), 6) joint_coex_up_frac_ge2, round(avg(case when c >= 2 then 1.0 else 0.0 end), 6) joint_coex_central_frac_ge2 from x group by t, p""")
def feature_family_coextreme(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_joint_v1")
    return _out(f, [c for c in f.columns if c.startswith("joint_coex")])


@query()
def feature_family_distances(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_joint_v1")
    return _out(f, [c for c in f.columns if c.startswith("joint_maha")])


_S = f"""{R}, s as (select t, p, cast(count(*) as double) n_reads, {", ".join(f"quantile_cont({c[:-4]}, {int(c[-2:]) / 100}) {c}" for c in X.AGGREGATED)} from r group by t, p)"""
_BEFORE, _AFTER = "coalesce(cast(p - lag(p) over w as double), 100000)", "coalesce(cast(lead(p) over w - p as double), 100000)"
_PLACES = """coalesce(round((p - min(p) over g) / nullif(cast(max(p) over g - min(p) over g as double), 0), 6), 0) nbr_rel_position,
coalesce(round((row_number() over w - 1) / nullif(cast(count(*) over g - 1 as double), 0), 6), 0) nbr_rank_on_transcript"""


@query(f"""with {_S} select t, p, {_BEFORE} nbr_dist_prev, {_AFTER} nbr_dist_next, least({_BEFORE}, {_AFTER}) nbr_dist_nearest,
{", ".join(f"cast(count(*) over (partition by t order by p range between {x} preceding and {x} following) - 1 as double) nbr_count_{x}" for x in X.COUNT_WINDOWS)},
cast(count(*) over g as double) nbr_n_on_transcript, {_PLACES} from s window w as (partition by t order by p), g as (partition by t)""")
def feature_family_structure(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_nbr_struct_v1")
    return _out(f, [c for c in f.columns if c.startswith("nbr_")])


def _near(x: int) -> str:
    return f"(partition by t order by p range between {x} preceding and {x} following exclude current row)"


@query(f"""with {_S} select t, p, {", ".join(f"cast(count(*) over {_near(x)} as double) nbrsig_n_w{x}" for x in X.SIGNAL_WINDOWS)},
{", ".join(f"coalesce(round({f}({c}) over {_near(x)}, 6), 0) nbrsig_{c}_w{x}_{n}" for x in X.SIGNAL_WINDOWS for c in X.AGGREGATED for n, f in (("mean", "avg"), ("max", "max")))} from s""")
def feature_family_signal(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_nbr_signal_v1", ("nbrsig_",))
    return _out(f, [c for c in f.columns if c.startswith("nbrsig_")])


_LOO = ", ".join(f"coalesce(round((sum({c}) over g - {c}) / nullif(count(*) over g - 1, 0), 6), 0) {n}" for c, n in [("n_reads", "tx_n_reads_loo_mean"), *[(c, f"tx_{c}_loo_mean") for c in X.AGGREGATED]])


@query(f"with {_S} select t, p, cast(count(*) over g as double) tx_n_sites, {_LOO} from s window g as (partition by t)")
def feature_family_group(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_transcript_v1")
    return _out(f, [c for c in f.columns if c.startswith("tx_")])


@query(f"with {_S} select t, p, {_PLACES}, {_LOO} from s window w as (partition by t order by p), g as (partition by t)")
def feature_family_robust(spark, d):
    f = X.feature_set(readings(spark, d), "quantiles_crosssite_robust_v1")
    return _out(f, [c for c in f.columns if c.startswith(("nbr_", "tx_"))])
