"""All queries of the engine by name over the driver's tables, each with DuckDB SQL where SQL expresses it.

``events`` stand for sites on an ordered axis (user = group, second = position),
``lineitem`` for ragged readings, ``labels`` joined to ``documents`` for scored,
labelled rows with strata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as X
from ..operators import resample as R
from ..operators import windows as W
from ..operators.tables import saved
from ..sources import sinks as K
from ..sources import sites as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, d: str) -> DataFrame:
    """(u, p, v): one site per user and second."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("u"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("p")).agg(F.sum("value").alias("v"))


SITES = "s as (select user_id u, cast(floor(epoch(ts)) as bigint) p, sum(value) v from events group by 1, 2)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, s, y, t, lang, source): a score, two labels and strata."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("s"), "n_chars", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("t"))
    return docs.join(labels, "doc_id")


SCORED = "d as (select doc_id, least(n_chars / 10000.0::double, 1.0::double) s, n_chars, lang, source, quality y, toxic t from documents join labels using (doc_id))"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# --- windows -----------------------------------------------------------------


@query(f"""with {SITES} select u, p, v, count(*) over w n_neighbours, coalesce(round(avg(v) over w, 6), 0) loo_mean, coalesce(max(v) over w, 0) loo_max
from s window w as (partition by u order by p range between 86400 preceding and 86400 following exclude current row)""")
def loo_window_mean_max(spark, d):
    return W.leave_one_out(sites(spark, d), ["u"], "p", "v", 86400)


@query(f"""with {SITES} select u, p, v, count(*) over (partition by u order by p range between 3600 preceding and 3600 following) - 1 n_3600,
count(*) over (partition by u order by p range between 86400 preceding and 86400 following) - 1 n_86400 from s""")
def neighbour_counts(spark, d):
    return W.neighbour_counts(sites(spark, d), ["u"], "p", [3600, 86400])


@query(f"""with {SITES}, g as (select u, p, v, coalesce(cast(p - lag(p) over w as double), 100000) gap_before, coalesce(cast(lead(p) over w - p as double), 100000) gap_after
from s window w as (partition by u order by p)) select *, least(gap_before, gap_after) gap_nearest from g""")
def prev_next_nearest(spark, d):
    return W.gaps(sites(spark, d), ["u"], "p")


@query(f"""with {SITES} select u, p, v, coalesce(round((p - min(p) over q) / nullif(cast(max(p) over q - min(p) over q as double), 0), 6), 0) rel_pos,
coalesce(round((row_number() over w - 1) / nullif(cast(count(*) over q - 1 as double), 0), 6), 0) rel_rank
from s window q as (partition by u), w as (partition by u order by p)""")
def relative_position(spark, d):
    return W.relative_position(sites(spark, d), ["u"], "p")


@query("""select event_id, round((rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0)
/ count(*) over (partition by event_type), 6) pct from events""")
def average_rank_pct(spark, d):
    ranked = W.average_rank(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "pct", share=True)
    return rounded(ranked.select("event_id", "pct"), "pct")


@query("""with r as (select l_orderkey, l_linenumber, l_quantity q, (rank() over (partition by l_quantity order by l_extendedprice)
+ (count(*) over (partition by l_quantity, l_extendedprice) - 1) / 2.0) / count(*) over (partition by l_quantity) pct from lineitem)
select q, count(*) n, sum(case when pct > 0.95 then 1 else 0 end) top from r group by q""")
def band_top5pct(spark, d):
    r = W.average_rank(table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), "l_extendedprice"), ["q"], "l_extendedprice", "pct", share=True)
    return r.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("pct") > 0.95, 1).otherwise(0)).alias("top"))


@query("""select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rk from orders) where rk <= 3""")
def topk_per_group(spark, d):
    return W.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("""select event_type, user_id, event_id, row_number() over (partition by event_type, user_id order by value desc, event_id) pos from events where value is not null""")
def rank_in_batches(spark, d):
    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("value"), "event_id")
    e = table(spark, d, "events").where("value is not null")
    return e.select("event_type", "user_id", "event_id", F.row_number().over(w).cast("long").alias("pos"))


@query(f"""with {SCORED}, t as (select lang, s, cast(sum(y) as bigint) tp, count(*) n from d group by 1, 2)
select lang, s, tp, n, cast(sum(tp) over w as bigint) ctp, cast(sum(n) over w as bigint) cn from t window w as (partition by lang order by s desc)""")
def cumulative_tp(spark, d):
    return M.by_threshold(scored(spark, d), ["lang"], "s", "y")


@query("""select l_orderkey, l_linenumber, round(avg(l_quantity) over w, 6) mean_so_far, round(stddev_pop(l_quantity) over w, 6) sd_so_far from lineitem
window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice rows unbounded preceding)""")
def prefix_evidence(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.avg("l_quantity").over(w), 6).alias("mean_so_far"), F.round(F.stddev_pop("l_quantity").over(w), 6).alias("sd_so_far")
    )


@query(f"""with {SITES}, i as (select u, p a, p + 7200 b from s), m as (select *, max(b) over (partition by u order by a, b rows between unbounded preceding and 1 preceding) pe from i),
k as (select *, sum(case when pe is null or a > pe + 1 then 1 else 0 end) over (partition by u order by a, b rows unbounded preceding) g from m)
select u, min(a) a, max(b) b, count(*) n_intervals from k group by u, g""")
def interval_union(spark, d):
    i = sites(spark, d).select("u", F.col("p").alias("a"), (F.col("p") + 7200).alias("b"))
    return W.interval_union(i, ["u"], "a", "b")


@query(f"""with {SITES}, k as (select a.u, a.p, sum(exp(-abs(a.p - b.p) / 20000.0) * b.v) / sum(exp(-abs(a.p - b.p) / 20000.0)) m
from s a join s b on a.u = b.u and a.p <> b.p and abs(a.p - b.p) <= 50000 group by 1, 2)
select s.u, s.p, v, coalesce(round(m, 6), 0) kernel_mean from s left join k on k.u = s.u and k.p = s.p""")
def kernel_neighbour_mean(spark, d):
    return W.kernel_mean(sites(spark, d), ["u"], "p", "v", 50000, 20000.0)


@query("""select o_custkey, o_orderkey, round(sum(o_totalprice) over w, 4) t_end, round(sum(o_totalprice) over w - o_totalprice, 4) t_start from orders
window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)""")
def interval_from_running_sum(spark, d):
    o = W.running_intervals(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")
    return rounded(o.select("o_custkey", "o_orderkey", "t_end", "t_start"), "t_end", "t_start", places=4)


# --- joins and sets ----------------------------------------------------------


@query("select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def join_inner_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")


@query("select d.doc_id, lang, quality is not null judged from documents d left join labels using (doc_id)")
def join_left_truth(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", "lang", F.col("quality").isNotNull().alias("judged"))


@query("""select case when l.k is null then 'right_only' when r.k is null then 'left_only' else 'both' end side, count(*) n
from (select distinct c_custkey k from customer) l full join (select distinct o_custkey k from orders) r on l.k = r.k group by 1""")
def join_full_audit(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return J.audit(left, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def join_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""select r_name, n_name, count(*) n_orders, round(sum(o_totalprice), 2) total from region join nation on n_regionkey = r_regionkey
join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1, 2""")
def join_nway_inner(spark, d):
    r, n, c, o = (table(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with m as (select l_partkey, l_returnflag f, avg(l_quantity) q from lineitem group by 1, 2)
select a.f fa, b.f fb, count(*) n, round(avg(abs(a.q - b.q)), 6) gap from m a join m b on a.l_partkey = b.l_partkey and a.f < b.f group by 1, 2""")
def join_pairs_of_groups(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("f")).agg(F.avg("l_quantity").alias("q"))
    a, b = (m.select("l_partkey", F.col("f").alias(f"f{x}"), F.col("q").alias(f"q{x}")) for x in "ab")
    j = a.join(b, "l_partkey").where("fa < fb")
    return j.groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("qa") - F.col("qb"))), 6).alias("gap"))


@query(f"with {SITES} select a.u, a.p p_a, b.p p_b, b.p - a.p distance from s a join s b on a.u = b.u and a.p < b.p and b.p - a.p <= 20000")
def band_self_join(spark, d):
    return J.band_pairs(sites(spark, d), ["u"], "p", 20000)


PAIR_EDGES = [0, 5000, 20000, 50000]


@query(f"""with {SITES}, x as (select a.v va, b.v vb, b.p - a.p g from s a join s b on a.u = b.u and a.p < b.p and b.p - a.p <= 50000)
select case when g < 5000 then '0-5000' when g < 20000 then '5000-20000' when g < 50000 then '20000-50000' end band, count(*) n,
sum(case when va > 50 and vb > 50 then 1 else 0 end) both_high from x group by 1""")
def pair_bands(spark, d):
    x = J.band_pairs(sites(spark, d), ["u"], "p", 50000, ["v"])
    both = F.when((F.col("v_a") > 50) & (F.col("v_b") > 50), 1).otherwise(0)
    return x.groupBy(J.band_of(F.col("distance"), PAIR_EDGES).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(both).alias("both_high"))


@query("""with i as (select o_custkey k, o_orderkey, sum(o_totalprice) over w e, sum(o_totalprice) over w - o_totalprice b from orders
window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)),
q as (select c_custkey k, c_acctbal * 50 pos from customer)
select q.k, o_orderkey, round(pos - b, 2) into_it from q left join i on q.k = i.k and pos >= b and pos < e""")
def interval_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate", "o_totalprice")
    i = W.running_intervals(o, ["k"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice").select("k", "o_orderkey", "t_start", "t_end")
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 50).alias("pos"))
    return J.place_in_intervals(q, i, ["k"], "pos").select("k", "o_orderkey", F.round(F.col("pos") - F.col("t_start"), 2).alias("into_it"))


@query(f"""with {SITES}, e as (select distinct user_id u, cast(floor(epoch(ts)) as bigint) p from events where event_type = (select min(event_type) from events))
select s.u, s.p, v, (select min(abs(e.p - s.p)) from e where e.u = s.u) event_gap from s""")
def nearest_event_asof(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    marks = e.join(F.broadcast(first), "event_type").select(F.col("user_id").alias("u"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("p")).distinct()
    return J.nearest_event(sites(spark, d), marks, ["u"], "p")


@query("""with a as (select o_orderkey p from orders), b as (select distinct l_partkey + 1 p from lineitem)
select k shift, count(*) hits from a, (values (-1), (0), (1)) t(k) where p + k in (select p from b) group by k""")
def shift_match(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("p"))
    b = table(spark, d, "lineitem").select((F.col("l_partkey") + 1).alias("p"))
    return J.best_shift(a, b, "p", [-1, 0, 1])


@query("""select k off, cast(sum(case when substr(p_name, cast(1 + k as bigint), 3) = substr(p_type, 1, 3) then 1 else 0 end) as bigint) hits from part, (select unnest(range(0, 6)) k) group by k""")
def substring_match(spark, d):
    p = table(spark, d, "part").withColumn("off", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    hit = F.substr("p_name", (F.col("off") + 1).cast("int"), F.lit(3)) == F.substring("p_type", 1, 3)
    return p.groupBy("off").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"))


@query("select doc_id k from documents union all select doc_id from labels")
def union_all_depths(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k")).unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("k")))


@query("select c_nationkey k from customer union select s_nationkey from supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("select l_partkey k from lineitem where l_quantity > 45 intersect select l_partkey from lineitem where l_quantity < 5")
def intersect_keys(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(li.where("l_quantity < 5").select(F.col("l_partkey").alias("k")))


@query("select c_custkey k from customer except select o_custkey from orders")
def except_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("select l_orderkey, l_partkey, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- aggregates --------------------------------------------------------------

READINGS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


SMALL = ["l_quantity", "l_discount", "l_tax"]


@query("select l_partkey, count(*) n_reads, " + ", ".join(f"round(avg({c}), 8) mean_{c}, round(stddev_pop({c}), 8) sd_{c}" for c in SMALL) + " from lineitem group by 1")
def site_moments(spark, d):
    m = A.moments(table(spark, d, "lineitem"), ["l_partkey"], SMALL)
    return rounded(m, *[f"{k}_{c}" for c in SMALL for k in ("mean", "sd")], places=8)


_Q = ", ".join(f"round(quantile_cont({{x}}, {q}), 6) q{round(q * 100)}" for q in A.QUANTILES) + ", round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 6) iqr, round(quantile_cont({x}, 0.95) - quantile_cont({x}, 0.05), 6) tail"
_QNAMES = ["q5", "q25", "q50", "q75", "q95", "iqr", "tail"]


@query(f"select l_partkey, {_Q.format(x='l_extendedprice')} from lineitem group by 1")
def site_quantiles(spark, d):
    return rounded(A.quantiles(table(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice"), *_QNAMES)


@query(f"with c as (select l_partkey, l_quantity - (l_discount + l_tax) * 0.5 x from lineitem) select l_partkey, {_Q.format(x='x')} from c group by 1")
def within_row_contrast_quantiles(spark, d):
    li = table(spark, d, "lineitem").withColumn("x", A.contrasts("l_discount", "l_quantity", "l_tax")["centre"])
    return rounded(A.quantiles(li, ["l_partkey"], "x"), *_QNAMES)


@query("""select l_orderkey, round(case when count(*) < 5 then 0 else coalesce(covar_pop(l_quantity, l_tax) / nullif(stddev_pop(l_quantity) * stddev_pop(l_tax), 0), 0) end, 6) r
from lineitem group by 1""")
def safe_correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(A.safe_corr("l_quantity", "l_tax"), 6).alias("r"))


def leading_sql(source: str, keys: str) -> str:
    """SQL CTEs e1 to e4 over rows (keys, n, xx, xy, xz, yy, yz, zz): e4 has largest, total and the unit vector v0, v1, v2."""
    rows = {0: ("xx - largest", "xy", "xz"), 1: ("xy", "yy - largest", "yz"), 2: ("xz", "yz", "zz - largest")}

    def cross(i: int, j: int) -> str:
        u, v = ([f"({x})" for x in rows[k]] for k in (i, j))
        made = [f"{u[1]} * {v[2]} - {u[2]} * {v[1]}", f"{u[2]} * {v[0]} - {u[0]} * {v[2]}", f"{u[0]} * {v[1]} - {u[1]} * {v[0]}"]
        return f"[{' + '.join(f'power({m}, 2)' for m in made)}, {', '.join(made)}]"

    return f"""e1 as (select *, xx + yy + zz total, (xx + yy + zz) / 3 mid, sqrt((power(xx - (xx + yy + zz) / 3, 2) + power(yy - (xx + yy + zz) / 3, 2) + power(zz - (xx + yy + zz) / 3, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) wide from {source}),
e2 as (select *, mid + 2 * wide * cos(acos(least(greatest(coalesce(((xx - mid) * ((yy - mid) * (zz - mid) - yz * yz) - xy * (xy * (zz - mid) - yz * xz) + xz * (xy * yz - (yy - mid) * xz)) / nullif(2 * wide * wide * wide, 0), 1), -1), 1)) / 3) largest from e1),
e3 as (select *, greatest({cross(0, 1)}, {cross(0, 2)}, {cross(1, 2)}) l from e2),
e4 as (select {keys}, n, xx, yy, zz, total, largest, {", ".join(f"case when l[1] > 0 then l[{i + 2}] / sqrt(l[1]) else {float(i == 2)} end v{i}" for i in range(3))} from e3)"""


def _cov_sql(columns: list[str], f: str) -> str:
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    return ", ".join(f"coalesce({f}({x}, {y}), 0) {n}" for n, (x, y) in zip(names, [(x, y) for i, x in enumerate(columns) for y in columns[i:]], strict=True))


@query(f"""with c as (select l_partkey, count(*) n, {_cov_sql(["l_quantity", "l_discount", "l_tax"], "covar_samp")} from lineitem group by 1), {leading_sql("c", "l_partkey")}
select l_partkey, round(case when n >= 5 and total > 0 then abs(v0 + v1 + v2) / sqrt(3.0) else 0 end, 6) alignment, round(case when n >= 5 and total > 0 then largest / total else 0 end, 6) dominance from e4""")
def eigen_alignment(spark, d):
    return rounded(A.eigen_alignment(table(spark, d, "lineitem"), ["l_partkey"], ["l_quantity", "l_discount", "l_tax"], "l_partkey long"), "alignment", "dominance")


@query()
def mahalanobis(spark, d):
    return rounded(A.mahalanobis(table(spark, d, "lineitem"), ["l_partkey"], READINGS), "d_q50", "d_q95")


@query("""with q as (select l_partkey, quantile_cont(l_quantity, 0.9) a, quantile_cont(l_extendedprice, 0.9) b from lineitem group by 1)
select l_partkey, cast(sum(case when l_quantity > a and l_extendedprice > b then 1 else 0 end) as bigint) both_high from lineitem join q using (l_partkey) group by 1""")
def coextreme_counts(spark, d):
    li = table(spark, d, "lineitem")
    q = li.groupBy("l_partkey").agg(F.percentile("l_quantity", F.lit(0.9)).alias("a"), F.percentile("l_extendedprice", F.lit(0.9)).alias("b"))
    both = F.when((F.col("l_quantity") > F.col("a")) & (F.col("l_extendedprice") > F.col("b")), 1).otherwise(0)
    return li.join(q, "l_partkey").groupBy("l_partkey").agg(F.sum(both).alias("both_high"))


@query("""select event_id, coalesce(round((sum(value) over w - value) / nullif(count(value) over w - 1, 0), 8), 0) loo_group_mean from events window w as (partition by user_id)""")
def loo_group_mean(spark, d):
    return A.loo_group_mean(table(spark, d, "events"), ["user_id"], "value").select("event_id", F.round("loo_group_mean", 8).alias("loo_group_mean"))


@query("select l_partkey, l_suppkey, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 6) l_extendedprice, sum(l_quantity) l_quantity, count(*) copies from lineitem group by 1, 2")
def weighted_merge(spark, d):
    return rounded(A.weighted_merge(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice", "l_quantity"), "l_extendedprice")


@query("select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) pooled from lineitem group by 1")
def pool_arrays(spark, d):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda s: s["l_partkey"].cast("string")), ",").alias("pooled"))


@query("""with n as (select l_orderkey, count(*) n from lineitem group by 1) select min(n) lo, round(quantile_cont(n, 0.25), 6) p25, round(quantile_cont(n, 0.5), 6) p50, round(quantile_cont(n, 0.75), 6) p75,
max(n) hi, round(avg(case when n >= 5 then 1.0 else 0.0 end), 6) share_5, round(avg(case when n % 2 = 0 then 1.0 else 0.0 end), 6) even, count(distinct n) kinds from n""")
def depth_profile(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    q = [F.round(F.percentile("n", F.lit(x)), 6).alias(f"p{round(x * 100)}") for x in (0.25, 0.5, 0.75)]
    share = [F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(k) for k, c in (("share_5", F.col("n") >= 5), ("even", F.col("n") % 2 == 0))]
    return n.agg(F.min("n").alias("lo"), *q, F.max("n").alias("hi"), *share, F.count_distinct("n").alias("kinds"))


@query(f"""with {SCORED}, c as (select lang, doc_id % 5 fold, count(*) n, sum(y) k from d group by 1, 2), a as (select count(*) n, sum(y) k from d)
select lang, fold, c.n, round(coalesce((sum(c.k) over (partition by lang) - c.k) / nullif(cast(sum(c.n) over (partition by lang) - c.n as double), 0),
(a.k - sum(c.k) over (partition by fold)) / nullif(cast(a.n - sum(c.n) over (partition by fold) as double), 0)), 6) rate from c, a""")
def out_of_fold_rate(spark, d):
    return rounded(A.out_of_fold_rate(scored(spark, d).withColumn("fold", F.col("doc_id") % 5), "lang", "fold", "y"), "rate")


@query("select event_id, round(value - avg(value) over (partition by event_type), 6) excess from events")
def group_centred(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    means = e.groupBy("event_type").agg(F.avg("value").alias("m"))  # joined back: Spark broadcasts it while it is small
    return e.join(means, "event_type").select("event_id", F.round(F.col("value") - F.col("m"), 6).alias("excess"))


@query(f"""with {SITES}, g as (select u, count(*) n, sum(case when v > 50 then 1 else 0 end) k from s group by u),
x as (select a.u, case when b.p - a.p < 20000 then 'near' else 'far' end band, a.v > 50 and b.v > 50 both_high from s a join s b on a.u = b.u and a.p < b.p and b.p - a.p <= 50000)
select band, count(*) pairs, sum(case when both_high then 1 else 0 end) both_high, round(sum(k * (k - 1) / nullif(cast(n * (n - 1) as double), 0)), 6) expected from x join g using (u) group by band""")
def pair_band_ratio(spark, d):
    s = sites(spark, d)
    g = s.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("v") > 50, 1).otherwise(0)).alias("k"))
    x = J.band_pairs(s, ["u"], "p", 50000, ["v"]).withColumn("band", F.when(F.col("distance") < 20000, "near").otherwise("far"))
    both = F.when((F.col("v_a") > 50) & (F.col("v_b") > 50), 1).otherwise(0)
    expected = F.col("k") * (F.col("k") - 1) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    return x.join(g, "u").groupBy("band").agg(F.count(F.lit(1)).alias("pairs"), F.sum(both).alias("both_high"), F.round(F.sum(expected), 6).alias("expected"))


@query("""with s as (select l_returnflag, sum(w) w, sum(w * x) wx, sum(w * y) wy, sum(w * x * x) wxx, sum(w * x * y) wxy from
(select l_returnflag, l_quantity w, l_discount x, ln(l_extendedprice) y from lineitem where l_extendedprice > 0) group by 1),
f as (select *, (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) slope from s)
select l_returnflag, round(slope, 4) slope, round((wy - slope * wx) / w, 4) intercept from f""")
def weighted_loglinear_fit(spark, d):
    f = A.loglinear_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_extendedprice", "l_quantity")
    return rounded(f.select("l_returnflag", "slope", "intercept"), "slope", "intercept", places=4)


@query("""with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 a,
rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 b from lineitem)
select l_returnflag, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) rho from r group by 1""")
def spearman_matrix(spark, d):
    r = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    for c, n in (("l_quantity", "a"), ("l_extendedprice", "b")):
        r = W.average_rank(r, ["l_returnflag"], c, n)
    return r.groupBy("l_returnflag").agg(F.round(A.safe_corr("a", "b"), 6).alias("rho"))


@query("""select l_returnflag, round(avg(case when l_linestatus = 'F' then l_quantity end), 6) F, round(avg(case when l_linestatus = 'O' then l_quantity end), 6) O from lineitem group by 1""")
def pivot_mean(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return rounded(p, "F", "O")


@query(f"with {SCORED} select lang, source, count(*) n, round(avg(cast(y as double)), 6) rate from d group by grouping sets ((), (lang), (source))")
def grouping_sets_rates(spark, d):
    g = scored(spark, d).groupingSets([[], ["lang"], ["source"]], "lang", "source")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"))


@query("""with c as (select user_id, event_type, count(*) n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) k from c)
select user_id, max(case when k = 1 then event_type end) mode, string_agg(event_type, ',' order by event_type) kinds from r group by 1""")
def mode_and_sorted_set(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("mode"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("select cast(floor(l_extendedprice / 10000) as bigint) bin, count(*) n, round(sum(l_quantity), 4) weight, case when count(*) >= 30 then round(avg(l_discount), 6) end mean from lineitem group by 1")
def weighted_histogram(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 10000).alias("bin"))
    return g.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("weight"), F.when(F.count(F.lit(1)) >= 30, F.round(F.avg("l_discount"), 6)).alias("mean")
    )


@query("select l_returnflag, count(distinct l_partkey) parts, count(distinct l_suppkey) suppliers from lineitem group by 1")
def count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""with t as (select p_type, avg(l_quantity) m, stddev_pop(l_quantity) sd, count(*) n from lineitem join part on l_partkey = p_partkey where l_orderkey % 5 <> 0 group by 1),
g as (select avg(l_quantity) m, stddev_pop(l_quantity) sd from lineitem where l_orderkey % 5 <> 0)
select l_orderkey, round(avg((l_quantity - case when t.n >= 200 then t.m else g.m end) / case when t.n >= 200 then t.sd else g.sd end), 6) z
from lineitem join part on l_partkey = p_partkey left join t using (p_type), g group by 1""")
def kmer_normalise(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    train = li.where("l_orderkey % 5 <> 0")
    stats = [F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("sd")]
    t, g = train.groupBy("p_type").agg(*stats, F.count(F.lit(1)).alias("n")), train.agg(*[s.alias(f"g{i}") for i, s in enumerate(stats)])
    j = li.join(t, "p_type", "left").join(F.broadcast(g), how="cross")
    known = F.coalesce(F.col("n") >= 200, F.lit(False))
    z = (F.col("l_quantity") - F.when(known, F.col("m")).otherwise(F.col("g0"))) / F.when(known, F.col("sd")).otherwise(F.col("g1"))
    return j.groupBy("l_orderkey").agg(F.round(F.avg(z), 6).alias("z"))


# --- metrics -----------------------------------------------------------------


@query(f"""with {SCORED}, t as (select lang, s, sum(y) tp, count(*) n from d group by 1, 2),
c as (select lang, s, tp, sum(tp) over (partition by lang order by s desc) ctp, sum(n) over (partition by lang order by s desc) cn from t)
select lang, round(sum(tp * (ctp / cast(cn as double))) / nullif(sum(tp), 0), 6) ap from c group by 1""")
def average_precision(spark, d):
    return rounded(M.average_precision(scored(spark, d), ["lang"], "s", "y"), "ap")


@query(f"""with {SCORED}, r as (select lang, y, rank() over (partition by lang order by s) + (count(*) over (partition by lang, s) - 1) / 2.0 r from d)
select lang, round((sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(cast(sum(y) * sum(1 - y) as double), 0), 6) auc from r group by 1""")
def roc_auc(spark, d):
    return rounded(M.roc_auc(scored(spark, d), ["lang"], "s", "y"), "auc")


@query(f"""with {SCORED}, o as (select y, row_number() over (order by s desc, doc_id) r, sum(y) over (order by s desc, doc_id rows unbounded preceding) tp from d)
select round(sum(case when y = 1 then tp / cast(r as double) else 0 end) / sum(y), 6) ap_in_order from o""")
def sorted_ap_auc_weighted(spark, d):
    # ties keep their order: positives' precision at their own place, by running counts over score classes and places inside
    s = scored(spark, d)
    t = M.by_threshold(s, [], "s", "y").select("s", (F.col("ctp") - F.col("tp")).alias("tp0"), (F.col("cn") - F.col("n")).alias("n0"))
    w = Window.partitionBy("s").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = s.select("s", "y", F.sum("y").over(w).alias("tp1"), F.count(F.lit(1)).over(w).alias("n1")).join(t, "s")
    at = (F.col("tp0") + F.col("tp1")) / (F.col("n0") + F.col("n1"))
    return inside.agg(F.round(F.sum(F.when(F.col("y") == 1, at).otherwise(0.0)) / F.sum("y"), 6).alias("ap_in_order"))


@query(f"""with {SCORED}, g as (select i, i / 200.0::double th from (select unnest(range(0, 201)) i)),
c as (select th, count(*) filter (where round(s * 200, 9) >= i) called, coalesce(sum(y) filter (where round(s * 200, 9) >= i), 0) tp, sum(y) p from g, d group by th)
select round(th, 6) threshold, called, cast(tp as bigint) tp, round(tp / nullif(cast(called as double), 0), 6) "precision", round(tp / nullif(cast(p as double), 0), 6) recall,
round(2 * (tp / nullif(cast(called as double), 0)) * (tp / cast(p as double)) / nullif(tp / nullif(cast(called as double), 0) + tp / cast(p as double), 0), 6) f1 from c""")
def threshold_sweep(spark, d):
    return rounded(M.threshold_table(scored(spark, d), "s", "y"), "threshold", "precision", "recall", "f1")


@query(f"""with {SCORED}, c as (select i / 200.0::double t, (select count(*) from d where round(s * 200, 9) >= i) called from (select unnest(range(0, 201)) i))
select max(case when round(t * 200) = 60 then called end) at_low, max(case when round(t * 200) = 140 then called end) at_high from c""")
def count_swing(spark, d):
    t = M.threshold_table(scored(spark, d), "s", "y").withColumn("i", F.round(F.col("threshold") * 200))
    return t.agg(*[F.max(F.when(F.col("i") == i, F.col("called"))).alias(n) for n, i in (("at_low", 60), ("at_high", 140))])


@query(f"""with {SCORED}, c as (select i / 200.0::double t, (select sum(y) from d where round(s * 200, 9) >= i) / cast((select sum(y) from d) as double) r,
(select sum(y) / cast(count(*) as double) from d where round(s * 200, 9) >= i) p from (select unnest(range(0, 201)) i))
select round(t, 6) threshold, round(2 * p * r / nullif(p + r, 0), 6) f1 from c where p is not null order by round(2 * p * r / nullif(p + r, 0), 9) desc nulls last, t limit 1""")
def operating_points(spark, d):
    t = M.threshold_table(scored(spark, d), "s", "y").where("f1 is not null")
    return t.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 9), -F.col("threshold"))).alias("b")).select(
        F.round("b.threshold", 6).alias("threshold"), F.round("b.f1", 6).alias("f1")
    )


@query(f"""with {SCORED}, c as (select i / 200.0::double t, (select sum(y) / cast(count(*) as double) from d where lang = 'en' and round(s * 200, 9) >= i) p from (select unnest(range(0, 201)) i)), m as (select min(t) cut from c where p >= 0.85) select round(cut, 6) cutoff, (select count(*) from d, m where lang <> 'en' and round(s * 200, 9) >= round(cut * 200)) called_elsewhere from m""")
def borrowed_cutoff(spark, d):
    s = scored(spark, d)
    cut = M.threshold_table(s.where("lang = 'en'"), "s", "y").where("precision >= 0.85").agg(F.min("threshold").alias("cutoff"))
    j = s.where("lang <> 'en'").join(F.broadcast(cut), how="cross")
    hit = F.round(F.col("s") * 200, 9) >= F.round(F.col("cutoff") * 200)
    return j.agg(F.round(F.max("cutoff"), 6).alias("cutoff"), F.count_if(hit).alias("called_elsewhere"))


_BAND = "case " + " ".join(
    f"when n >= {lo}{'' if hi is None else f' and n < {hi}'} then '{f'{lo}+' if hi is None else (lo if hi == lo + 1 else f'{lo}-{hi - 1}')}'"
    for lo, hi in zip(M.DEPTH_EDGES, [*M.DEPTH_EDGES[1:], None], strict=True)
) + " end"


@query(f"""with {SCORED}, b as (select *, {_BAND.replace("n >=", "n_chars >=").replace("n <", "n_chars <")} band from d), t as (select band, s, sum(y) tp, count(*) n from b group by 1, 2),
c as (select band, tp, n, sum(tp) over (partition by band order by s desc) ctp, sum(n) over (partition by band order by s desc) cn from t)
select band, cast(sum(n) as bigint) n, case when sum(tp) >= 5 and sum(tp) < sum(n) then round(sum(tp * (ctp / cast(cn as double))) / sum(tp), 6) end ap from c group by 1""")
def depth_band_metrics(spark, d):
    t = M.by_threshold(scored(spark, d).withColumn("band", M.depth_band(F.col("n_chars"))), ["band"], "s", "y")
    ap = F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.nullif(F.sum("tp"), F.lit(0))
    fine = (F.sum("tp") >= 5) & (F.sum("tp") < F.sum("n"))
    return t.groupBy("band").agg(F.sum("n").alias("n"), F.when(fine, F.round(ap, 6)).alias("ap"))


_CAL = f"""{SCORED}, e as (select list_distinct(quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) e from d),
c as (select cast(len(list_filter(e, lambda x: x < s)) as bigint) bin, count(*) n, avg(s) mean_score, avg(cast(y as double)) rate from d, e group by 1)"""


@query(f"with {_CAL} select bin, n, round(mean_score, 6) mean_score, round(rate, 6) rate from c")
def calibration_bins(spark, d):
    return rounded(M.calibration(scored(spark, d), "s", "y"), "mean_score", "rate")


@query(f"with {_CAL} select round(sum(n * abs(mean_score - rate)) / sum(n), 6) ece, (select round(avg(power(s - y, 2)), 6) from d) brier from c")
def ece_brier(spark, d):
    s = scored(spark, d)
    brier = s.agg(F.round(F.avg(F.pow(F.col("s") - F.col("y"), 2)), 6).alias("brier"))
    return rounded(M.expected_calibration_error(M.calibration(s, "s", "y")), "ece").join(F.broadcast(brier), how="cross")


@query("""with o as (select user_id % 5 fold, (user_id / 5) % 10 rep, avg(value) a, avg(value) filter (where event_id % 2 = 0) b from events group by 1, 2),
x as (select a - b d from o where b is not null) select count(*) n, round(avg(d), 6) mean, round(var_samp(d) * (1 / cast(count(*) as double) + 0.25), 6) corrected from x""".replace("(user_id / 5) % 10", "(user_id // 5) % 10"))
def corrected_variance(spark, d):
    e = table(spark, d, "events").withColumn("fold", F.col("user_id") % 5).withColumn("rep", F.floor(F.col("user_id") / 5) % 10)
    o = e.groupBy("fold", "rep").agg(F.avg("value").alias("a"), F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("b")).where("b is not null")
    x = F.col("a") - F.col("b")
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.var_samp(x) * (1 / F.count(F.lit(1)) + 0.25), 6).alias("corrected"))


@query(f"""with {SCORED}, r as (select source, y, row_number() over (partition by source order by s desc, doc_id) k, count(*) over (partition by source) n from d)
select count(distinct source) sources, round(avg(hit), 6) hit_rate from (select source, max(case when k <= 3 and y = 0 then 1.0 else 0.0 end) hit from r where n >= 5 group by source)""")
def hit_rate_at_k(spark, d):
    n = scored(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source"))).where("n >= 5")
    w = Window.partitionBy("source").orderBy(F.desc("s"), "doc_id")
    hit = F.max(F.when((F.col("k") <= 3) & (F.col("y") == 0), 1.0).otherwise(0.0)).alias("hit")
    g = n.withColumn("k", F.row_number().over(w)).groupBy("source").agg(hit)
    return g.agg(F.count(F.lit(1)).alias("sources"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("""with r as (select event_id, (rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0) / count(*) over (partition by event_type) a,
(rank() over (partition by event_type order by user_id) + (count(*) over (partition by event_type, user_id) - 1) / 2.0) / count(*) over (partition by event_type) b from events) select event_id, round((a + b) / 2, 6) mean_rank from r""")
def rank_average_ensemble(spark, d):
    r = table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    for c, n in (("value", "a"), ("user_id", "b")):
        r = W.average_rank(r, ["event_type"], c, n, share=True)
    return r.select("event_id", F.round((F.col("a") + F.col("b")) / 2, 6).alias("mean_rank"))


@query("""with r as (select p_brand, l_linestatus, avg(l_discount) v from lineitem join part on l_partkey = p_partkey group by 1, 2)
select p_brand, round(min(v), 6) trust from r group by 1 having count(*) = 2""")
def trust_min_of_two(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = li.groupBy("p_brand", "l_linestatus").agg(F.avg("l_discount").alias("v"))
    return r.groupBy("p_brand").agg(F.round(F.min("v"), 6).alias("trust"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


# --- sorts, projections, sampling, exports ------------------------------------


@query(f"""with {SCORED}, k as (select greatest(1, cast(round_even(0.01 * count(*), 0) as bigint)) k from d)
select count(*) k, round(avg(cast(y as double)), 6) "precision" from (select y, row_number() over (order by s desc, doc_id) r from d), k where r <= k""")
def top_fraction_precision(spark, d):
    s = scored(spark, d)
    return M.top_share(s, "s", "doc_id", 0.01).agg(F.count(F.lit(1)).alias("k"), F.round(F.avg(F.col("y").cast("double")), 6).alias("precision"))


@query("select l_partkey, l_suppkey, max(l_quantity) l_quantity from lineitem group by 1, 2")
def dedupe_keep_deepest(spark, d):
    return W.top_k(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), ["l_partkey", "l_suppkey"], [F.desc("l_quantity")], 1).drop("rk")


@query("""select tier, p_partkey, p_name from (select case when lower(p_name) like 'a%' then 1 when lower(p_brand) like 'brand#1%' then 2 when p_name like '%red%' then 3 end tier, p_partkey, p_name from part)
where tier is not null order by tier, p_partkey limit 8""")
def tiered_search(spark, d):
    tier = F.when(F.lower("p_name").startswith("a"), 1).when(F.lower("p_brand").startswith("brand#1"), 2).when(F.col("p_name").contains("red"), 3)
    return table(spark, d, "part").select(tier.alias("tier"), "p_partkey", "p_name").where("tier is not null").orderBy("tier", "p_partkey").limit(8)


@query("select l_orderkey, l_partkey, l_tax from lineitem where l_shipdate >= timestamp '1995-01-01' and l_quantity > 40")
def column_subset(spark, d):
    li = table(spark, d, "lineitem").where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 40))
    return li.select("l_orderkey", "l_partkey", "l_tax")


@query("select event_id, " + ", ".join(f"case when event_type = '{t}' then 1.0::double else 0.0::double end is_{t}" for t in ("click", "view", "purchase")) + " from events")
def onehot_category(spark, d):
    return table(spark, d, "events").select("event_id", *[(F.col("event_type") == t).cast("double").alias(f"is_{t}") for t in ("click", "view", "purchase")])


@query("select p_partkey, substr(p_name, 2, 5) middle, substr(p_name, 1, 1) first, right(p_name, 1) last from part")
def slice_strings(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.substring("p_name", 2, 5).alias("middle"), F.substring("p_name", 1, 1).alias("first"), F.right("p_name", F.lit(1)).alias("last")
    )


@query("select l_suppkey, count(*) n, round(avg(l_discount), 6) m from lineitem group by 1 having count(*) >= 500")
def min_group_filter(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("m")).where("n >= 500")


@query("select p_partkey, p_type from part where regexp_matches(p_type, '^[A-M][A-Za-z]+')")
def regex_motif_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_type").rlike("^[A-M][A-Za-z]+")).select("p_partkey", "p_type")


@query("select p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) brand_no, regexp_extract(p_type, '^([^ ]+)', 1) head from part")
def text_gtf_like_extract(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("brand_no"), F.regexp_extract("p_type", "^([^ ]+)", 1).alias("head"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def props_json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""select cast(l_orderkey as varchar) transcript_id, l_partkey % 100 pos, count(*) n_reads, round(sum(l_quantity), 4) total from lineitem group by 1, 2""")
def scan_nested_json(spark, d):
    li = table(spark, d, "lineitem").withColumn("pos", F.col("l_partkey") % 100)
    packed = li.groupBy("l_orderkey", "pos").agg(F.collect_list("l_quantity").alias("q"))
    inner = F.create_map(F.lit("AAGACCA"), F.transform("q", lambda q: F.array_repeat(q.cast("float"), 9)))
    line = F.to_json(F.create_map(F.col("l_orderkey").cast("string"), F.create_map(F.col("pos").cast("string"), inner)))
    lines = packed.select(F.explode(F.array(line)).alias("value"))  # else the reader's test for blank lines makes each line twice
    parsed = S.explode_reads(S.parse_sites(lines))
    g = parsed.groupBy("transcript_id", F.col("transcript_position").cast("long").alias("pos"))
    return g.agg(F.count(F.lit(1)).alias("n_reads"), F.round(F.sum(F.col("mean_0").cast("double")), 4).alias("total"))


@query("""select doc_id, case when substr(md5(cast(doc_id as varchar)), 1, 1) < '8' then 'train' when substr(md5(cast(doc_id as varchar)), 1, 1) < 'c' then 'validation' else 'test' end as role from documents""")
def role_split_md5(spark, d):
    return R.role_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query()
def keyed_hash_sample(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return R.thin_rows(li, ["l_partkey"], "l_orderkey", 10, seed=2317)


@query()
def exact_thinning_udf(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return R.thin_exact(n, ["l_partkey"], "n", 10, 2317, "l_partkey long")


@query()
def grouped_folds(spark, d):
    return R.grouped_folds(table(spark, d, "orders"), "o_custkey", 5, 2317)


@query()
def cluster_bootstrap_ci(spark, d):
    b = R.bootstrap_means(table(spark, d, "events"), "user_id", "value", 500)
    return b.agg(F.count(F.lit(1)).alias("resamples"), *[F.percentile("mean", F.lit(q)).alias(n) for n, q in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))])


@query("""with o as (select o_orderkey, octet_length(encode(o_orderstatus || ',' || cast(o_orderkey as varchar))) + 1 n from orders)
select o_orderkey, cast(sum(n) over w as bigint) "end", cast(sum(n) over w - n as bigint) "start" from o window w as (order by o_orderkey rows unbounded preceding)""")
def offset_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("line"))
    return K.offset_index(o, "o_orderkey", "line").select("o_orderkey", "end", "start")


@query("""select 'not_numeric' kind, 0::bigint n union all select 'out_of_range', count(*) from lineitem where l_tax > 1 or l_tax < 0
union all select 'duplicate', count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)
union all select 'missing', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'extra', count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders)""")
def validate_submission(spark, d):
    scores = table(spark, d, "lineitem").select("l_orderkey", F.col("l_tax").alias("score"))
    return K.submission_problems(scores, table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("""with n as (select count(*) n, sum(case when t = 1 then 1 else 0 end) k from (select toxic t from labels)), c as (select source, count(*) m, sum(case when toxic = 1 then 1 else 0 end) h
from documents join labels using (doc_id) group by 1) select source, m, cast(h as bigint) h, round(h / cast(m as double) - (k - h) / nullif(cast(n - m as double), 0), 6) effect from c, n where m >= 10""")
def class_enrichment(spark, d):
    s = scored(spark, d)
    n = s.agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("k"))
    c = s.groupBy("source").agg(F.count(F.lit(1)).alias("m"), F.sum("t").alias("h")).join(F.broadcast(n), how="cross").where("m >= 10")
    effect = F.col("h") / F.col("m") - (F.col("k") - F.col("h")) / F.nullif(F.col("n") - F.col("m"), F.lit(0))
    return c.select("source", "m", "h", F.round(effect, 6).alias("effect"))


@query("""select date_trunc('hour', ts) as "hour", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def tumbling_counts(spark, d):
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""with {SITES}, g as (select u, p, sum(case when b is null or p - b > 43200 then 1 else 0 end) over (partition by u order by p rows unbounded preceding) k
from (select u, p, lag(p) over (partition by u order by p) b from s)) select u, min(p) started, max(p) ended, count(*) n from g group by u, k""")
def session_gaps(spark, d):
    w = Window.partitionBy("u").orderBy("p")
    g = sites(spark, d).withColumn("b", F.lag("p").over(w))
    k = F.sum(F.when(F.col("b").isNull() | (F.col("p") - F.col("b") > 43200), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("k", k).groupBy("u", "k").agg(F.min("p").alias("started"), F.max("p").alias("ended"), F.count(F.lit(1)).alias("n")).drop("k")


# --- models and their evaluation -----------------------------------------------


TRAITS = ["size", "spaces", "digits", "lines"]


def traits(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, y and four measures of the text) for labelled documents: a saved table, as every pass of a fit reads it anew."""
    n = F.greatest(F.length("text"), F.lit(1))
    docs = table(spark, d, "documents").select(
        "doc_id", "source", F.log1p(n).alias("size"), (F.regexp_count("text", F.lit(" ")) / n).alias("spaces"),
        (F.regexp_count("text", F.lit("[0-9]")) / n).alias("digits"), (F.regexp_count("text", F.lit("\n")) / n).alias("lines"),
    )
    return saved(docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id"), "traits")


def thirds(df: DataFrame) -> DataFrame:
    """df with a group of rows that stands for a gene."""
    return df.withColumn("g", F.floor(F.col("doc_id") / 7))


@query()
def model_logistic(spark, d):
    df = traits(spark, d)
    return X.score(df, X.fit(df, TRAITS, "y", "logistic"), TRAITS).select("doc_id", "y", F.round("score", 6).alias("score"))


@query()
def model_mlp(spark, d):
    df = traits(spark, d)
    return X.score(df, X.fit(df, TRAITS, "y", "mlp"), TRAITS).select("doc_id", "y", F.round("score", 6).alias("score"))


@query()
def model_boosted_calibrated(spark, d):
    return X.calibrated(thirds(traits(spark, d)), TRAITS, "y", "g").select("doc_id", "y", F.round("score", 6).alias("score"))


@query()
def model_cross_fit(spark, d):
    return X.cross_fit(thirds(traits(spark, d)), TRAITS, "y", "g").select("doc_id", "y", "_fold", F.round("score", 6).alias("score"))


PARTS_BY_FLAG = """a as (select l_partkey k, avg(l_quantity) x, max(cast(l_discount > 0.05 as int)) y from lineitem where l_returnflag = 'A' group by 1),
b as (select l_partkey k, avg(l_quantity) x, max(cast(l_discount > 0.05 as int)) y from lineitem where l_returnflag = 'R' group by 1)"""


def parts_by_flag(spark: SparkSession, d: str, flag: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return li.groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_quantity").alias("x"), F.max((F.col("l_discount") > 0.05).cast("int")).alias("y"))


@query(f"""with {PARTS_BY_FLAG}
select k, round(a.x, 6) x, 'a' origin, case when b.k is null then 1.0::double else 0.5::double end weight, a.y from a left join b using (k)
union all select k, round(b.x, 6), 'b', case when a.k is null then 1.0::double else 0.5::double end, b.y from b left join a using (k)""")
def cross_source_pooled(spark, d):
    return rounded(X.cross_source_rows(parts_by_flag(spark, d, "A"), parts_by_flag(spark, d, "R"), "k", "y"), "x")


@query(f"""with {PARTS_BY_FLAG}, f as (select k, x, 'a' origin from a union all select k, x, 'b' from b), l as (select k, y from a union all select k, y from b),
n as (select k, count(*) n from l group by 1)
select k, round(x, 6) x, origin, case when n = 2 then 0.25::double else 1.0::double end weight, y from f join l using (k) join n using (k)""")
def cross_source_pooled_both(spark, d):
    return rounded(X.cross_source_rows(parts_by_flag(spark, d, "A"), parts_by_flag(spark, d, "R"), "k", "y", both=True), "x")


@query("""with s as (select l_discount f, 100 / (1 + exp(-(l_quantity - 25) / 10.0::double)) s from lineitem)
select f, count(*) n, round(quantile_cont(s, 0.25), 6) q25, round(quantile_cont(s, 0.5), 6) mid, round(quantile_cont(s, 0.75), 6) q75 from s group by 1""")
def mixture_summary(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_discount").alias("f"), (100 / (1 + F.exp(-(F.col("l_quantity") - 25) / F.lit(10.0)))).alias("s"))
    quartiles = {"q25": 0.25, "mid": 0.5, "q75": 0.75}
    return rounded(s.groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.percentile("s", F.lit(q)).alias(c) for c, q in quartiles.items()]), *quartiles)


@query("""with g as (select l_suppkey, count(*) n, sum(cast(l_returnflag = 'R' as int)) p from lineitem group by 1 having count(*) >= 5)
select l_suppkey, n, cast(p as bigint) p, round(case when n - p < 5 then 1 else 1 - exp(lgamma(n - p + 1) - lgamma(n - p - 5 + 1) - lgamma(n + 1) + lgamma(n - 5 + 1)) end, 6) expected from g""")
def shortlist_expectation(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("p"))
    return g.where("n >= 5").withColumn("expected", F.round(M.hit_expectation(F.col("n"), F.col("p"), 5), 6))


@query("""with e as (select l_returnflag g, l_quantity / 50.0::double x, count(*) n from lineitem group by 1, 2),
c as (select g, x, sum(n) over (partition by g order by x) / sum(n) over (partition by g)::double y from e),
i as (select g, step, step / 200.0::double x from (select distinct g from c), range(201) t(step)),
b as (select i.g, step, i.x, max(l.x) x0, max_by(l.y, l.x) y0 from i left join c l on l.g = i.g and l.x <= i.x group by 1, 2, 3),
u as (select i.g, step, min(r.x) x1, min_by(r.y, r.x) y1 from i left join c r on r.g = i.g and r.x >= i.x group by 1, 2)
select g, cast(step as int) step, round(coalesce(y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0), y0, y1), 6) y from b join u using (g, step)""")
def curve_interpolation(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), (F.col("l_quantity") / F.lit(50.0)).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g")
    c = e.select("g", "x", (F.sum("n").over(w.orderBy("x")) / F.sum("n").over(w)).alias("y"))
    return rounded(M.interpolate(c, ["g"], "x", "y"), "y")
