"""Composite studies over the driver's tables: grading against truth, neighbour graphs, resampled bands, worlds and views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import grading as G
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as X
from ..operators import nearest as N
from ..operators import resample as R
from ..operators import windows as W
from .catalog import SITES, query, rounded, sites, table
from .evaluation import _h, _ranked, _weight

# --- grading against a truth on the genome -----------------------------------
# A transcript is an order of three exons of 100 places, orders of one customer are its isoforms.


def exons(spark, d):
    o = table(spark, d, "orders")
    base = (F.col("o_custkey") % 50) * 2000
    e = o.select(F.col("o_orderkey").alias("tx"), F.col("o_orderpriority").alias("chrom"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"), base.alias("base"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i"))
    return e.select("tx", "chrom", "strand", (F.col("base") + F.col("i") * 500).alias("start"), (F.col("base") + F.col("i") * 500 + 99).alias("end"))


def scored_sites(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("tx"), ((F.col("l_linenumber") * 37 + F.col("l_partkey")) % 300).alias("pos"), F.col("l_quantity").cast("long").alias("n_reads"),
        "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", F.col("l_tax").alias("tax"), ((F.round("l_extendedprice").cast("long") % 997) / 997.0).alias("s"), (F.col("l_tax") >= 0.04).cast("int").alias("other"),
    )
    return li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("gene")), "tx")


TIES = ["tx", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "tax"]


def labelled_sites(spark, d):
    sites, ex = scored_sites(spark, d), exons(spark, d)
    found = G.lift_over(sites.where("l_discount >= 0.08"), ex, "tx", "pos").where("gpos is not null")
    truth = found.groupBy("chrom", "strand", (F.col("gpos") + 1).alias("gpos")).agg(F.max(F.col("l_discount") * 10).alias("ratio"))  # one place off
    return G.place_and_label(sites, ex, truth, TIES)


_BANDS = "case when n_reads < 10 then '1-9' when n_reads < 20 then '10-19' when n_reads < 40 then '20-39' else '40+' end"
_LABELLED = f"""e as (select o_orderkey tx, o_orderpriority chrom, case when o_orderstatus = 'F' then '-' else '+' end strand, (o_custkey % 50) * 2000 + i * 500 st from orders, (values (1), (2), (3)) t(i)),
c as (select *, 100 * (row_number() over (partition by tx order by case strand when '-' then -st else st end) - 1) t0 from e),
x as (select l_orderkey tx, (l_linenumber * 37 + l_partkey) % 300 pos, cast(l_quantity as bigint) n_reads, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, (cast(round(l_extendedprice) as bigint) % 997) / 997.0::double s,
case when l_tax >= 0.04 then 1 else 0 end other, o_custkey gene from lineitem join orders on o_orderkey = l_orderkey),
g as (select x.*, chrom, strand, case strand when '-' then st + 99 - (pos - t0) else st + pos - t0 end gpos from x join c on c.tx = x.tx and pos >= t0 and pos < t0 + 100),
tr as (select chrom, strand, gpos + 1 gpos, max(l_discount * 10) ratio from g where l_discount >= 0.08 group by 1, 2, 3),
k as (select * from g qualify row_number() over (partition by chrom, gpos, strand order by n_reads desc, tx, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax) = 1),
sh as (select v.shift, count(*) filter (where k.gpos is not null) hits from (values (-1, 0), (0, 1), (1, 2)) v(shift, o) cross join tr left join k on k.chrom = tr.chrom and k.strand = tr.strand and k.gpos = tr.gpos + v.shift group by v.shift, v.o order by hits desc, v.o limit 1),
l as (select k.*, tr.ratio, case when tr.ratio is null then 0 else 1 end y from k cross join sh left join tr on tr.chrom = k.chrom and tr.strand = k.strand and tr.gpos + sh.shift = k.gpos),
f as (select * from l where gene in (select gene from l where y = 1))"""


@query(f"""with {_LABELLED}, rc as (select avg(other) filter (where y = 1) recall from f),
b as (select 'all' band, s, y, chrom, gpos, strand from f union all select {_BANDS}, s, y, chrom, gpos, strand from f),
m as ({_ranked("b", "band")}), z as (select band, count(*) n, sum(y) positives from b group by band having sum(y) >= 20 and sum(y) < count(*)),
o as (select band, sum(y) over w tp, row_number() over w n from b window w as (partition by band order by s desc, chrom, gpos, strand rows unbounded preceding)),
p as (select o.band, arg_min(o.tp / cast(o.n as double), o.n) v from o join z using (band), rc where o.tp >= recall * z.positives - 1e-9 group by o.band),
t as (select o.band, o.tp / cast(o.n as double) v from o join z using (band) where o.n = greatest(1, round_even(0.01 * z.n, 0)))
select band, z.n, cast(positives as bigint) positives, round(positives / cast(z.n as double), 6) rate, round(ap, 6) ap, round(ap / (positives / cast(z.n as double)), 6) lift, round(auc, 6) auc, round(t.v, 6) precision_top, round(p.v, 6) "precision"
from z join m using (band) join p using (band) join t using (band)""")
def truth_by_depth_band(spark, d):
    rows = G.saved(labelled_sites(spark, d), "labelled-sites")
    recall = rows.where("label = 1").agg(F.avg("other").alias("recall"))  # what the other labelling finds of the truth: one row
    n = F.col("n_reads")
    band = F.when(n < 10, "1-9").when(n < 20, "10-19").when(n < 40, "20-39").otherwise("40+")
    out = G.grade(G.with_bands(rows, band), ["band"], "s", G.PLACE, "label", recall)
    return rounded(out, "rate", "ap", "lift", "auc", "precision_top", "precision")


@query(f"""with {_LABELLED}, p as (select s, ratio, 0 least from f where y = 1 union all select s, ratio, 20 from f where y = 1 and n_reads >= 20),
r as (select least, rank() over (partition by least order by s) + (count(*) over (partition by least, s) - 1) / 2.0::double a, rank() over (partition by least order by ratio) + (count(*) over (partition by least, ratio) - 1) / 2.0::double b from p)
select least, count(*) n, round(corr(a, b), 6) rho from r group by least""")
def score_against_ratio(spark, d):
    true = labelled_sites(spark, d).where("label = 1").withColumn("least", F.explode(F.array(F.lit(0), F.lit(20)))).where("n_reads >= least")
    return rounded(G.rank_correlation(true, ["least"], "s", "ratio"), "rho")


# --- mutual nearest neighbours ------------------------------------------------

_KS = [3, 5, 10]


@query(f"""with t as (select l_suppkey g, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 i, min(cast(round(l_quantity) as bigint)) x, min(cast(round(l_extendedprice / 1000) as bigint)) z, min(case when l_returnflag = 'R' then 1 else 0 end) y from lineitem group by 1, 2),
r as (select * from t),
n as (select a.g, a.i a, b.i b, a.y ya, b.y yb, row_number() over (partition by a.g, a.i order by (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z), b.i) k from r a join r b on a.g = b.g and a.i <> b.i qualify k <= 10),
m as (select p.g, p.a, p.b, p.ya, p.yb, greatest(p.k, q.k) rank from n p join n q on p.g = q.g and p.a = q.b and p.b = q.a where p.a < p.b),
v as (select g, count(*) n, avg(y) p from r group by g), ks as (select g, n, p, unnest([3, 5, 10]) k from v),
e as (select ks.g, ks.k, count(m.a) edges, avg(case when ya = yb then 1.0 else 0.0 end) filter (where m.a is not null) share from ks left join m on m.g = ks.g and m.rank <= ks.k group by 1, 2),
d as (select ks.g, ks.k, r.i a from ks join r using (g)), l as (select ks.g, ks.k, a, b from ks join m on m.g = ks.g and m.rank <= ks.k union all select ks.g, ks.k, b, a from ks join m on m.g = ks.g and m.rank <= ks.k),
reach as (with recursive w(g, k, a, b) as (select g, k, a, a from d union select w.g, w.k, w.a, l.b from w join l on l.g = w.g and l.k = w.k and l.a = w.b) select g, k, a, min(b) root from w group by 1, 2, 3),
o as (select g, k, count(distinct root) components from reach group by 1, 2), iso as (select d.g, d.k, count(*) filter (where l.a is null) isolated from d left join (select distinct g, k, a from l) l using (g, k, a) group by 1, 2)
select ks.g, ks.k, ks.n, e.edges, round((e.share - (p * p + (1 - p) * (1 - p))) / nullif(1 - (p * p + (1 - p) * (1 - p)), 0), 6) homophily, round(iso.isolated / cast(ks.n as double), 6) isolated, o.components
from ks join e using (g, k) join o using (g, k) join iso using (g, k) where ks.k < ks.n""")
def mutual_neighbours(spark, d):
    li = table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100
    t = li.groupBy(F.col("l_suppkey").alias("g"), key.alias("i")).agg(
        F.min(F.round("l_quantity").cast("long")).alias("x"), F.min(F.round(F.col("l_extendedprice") / 1000).cast("long")).alias("z"), F.min(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y")
    )
    return rounded(N.mutual_graphs(t.where("g is not null"), ["g"], "i", ["x", "z"], "y", _KS), "homophily", "isolated")


# --- neighbours by weight, views, resampled bands -------------------------------


@query(f"""with {SITES}, x as (select a.u, a.p, b.v, exp(-abs(a.p - b.p) / 10000.0::double) w, abs(a.p - b.p) g from s a join s b on a.u = b.u and a.p <> b.p and abs(a.p - b.p) <= 50000),
k as (select u, p, sum(w * v) / sum(w) m, max(v) filter (where g <= 20000) best from x group by 1, 2)
select s.u, s.p, coalesce(round(m, 6), 0) kernel_mean, coalesce(round(best, 6), 0) best, case when m is null then 0 else 1 end has_neighbour from s left join k using (u, p)""")
def kernel_neighbours(spark, d):
    out = W.kernel_neighbours(sites(spark, d), ["u"], "p", "v", 50000, 10000.0, 20000)
    return out.select("u", "p", "kernel_mean", F.round("best", 6).alias("best"), "has_neighbour")


_ARC = round(0.3 * (1 << 32))


@query(f"""with {SITES}, c as (select u, p, cast('0x' || {_h("circle", "u", "p")} as bigint) at from s),
v as (select u, p, at, view from c, range(4) t(view) where (((at - view * {_ARC}) % 4294967296) + 4294967296) % 4294967296 < {_ARC}),
n as (select u, p, at, view, count(*) over (partition by view, u order by p range between 86400 preceding and 86400 following) - 1 n_seen from v)
select u, p, n_seen from n where at // {_ARC} = view""".replace(" at,", " plc,").replace(" at from", " plc from").replace("(at -", "(plc -").replace("where at //", "where plc //"))
def circular_density(spark, d):
    v = E.circular_views(sites(spark, d), ["u"], "p", 0.3, "circle")
    w = Window.partitionBy("view", "u").orderBy("p").rangeBetween(-86400, 86400)
    return v.withColumn("n_seen", F.count(F.lit(1)).over(w) - 1).where("home").select("u", "p", "n_seen")


@query("""with k as (select l_suppkey % 10 u, l_partkey p from lineitem group by 1, 2 having count(*) * 0.5 >= 2)
select u, p, count(*) over (partition by u order by p range between 20 preceding and 20 following) - 1 n_seen from k""")
def coverage_density(spark, d):
    li = table(spark, d, "lineitem")
    n = li.groupBy((F.col("l_suppkey") % 10).alias("u"), F.col("l_partkey").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return W.neighbour_counts(E.covered(n, "n", 0.5, 2).select("u", "p"), ["u"], "p", [20]).withColumnRenamed("n_20", "n_seen")


@query(f"""with {SITES}, h as (select u, p, v, substr(md5(concat_ws(':', 'single', cast(u as varchar), cast(p as varchar))), 1, 8) h from s)
select u, p, round(v, 6) v from h qualify row_number() over (partition by u order by h, p) = 1""")
def single_sites(spark, d):
    s = sites(spark, d)
    one = E.without_neighbours(s.select("u", "p"), ["u"], "single")
    return rounded(one.join(s, ["u", "p"]), "v")


@query(f"""with {SITES}, y as (select u, p, case when v > 50 then 1 else 0 end y from s), g as (select u, count(*) n, sum(y) k from y group by u),
x as (select a.u, case when b.p - a.p < 20000 then 'near' else 'far' end band, a.y * b.y both_high from y a join y b on a.u = b.u and a.p < b.p and b.p - a.p <= 50000),
c as (select x.u, band, sum(both_high) b, count(*) * any_value(k * (k - 1) / nullif(cast(n * (n - 1) as double), 0)) e from x join g using (u) group by 1, 2),
r as (select u, i resample, {_weight(_h("pairs", "i", "u"))} w from (select distinct u from c), range(1, 51) t(i) union all select distinct u, 0, 1 from c),
v as (select band, resample, sum(w * b) / nullif(sum(w * e), 0) v from c join r using (u) where w > 0 group by 1, 2)
select band, round(max(v) filter (where resample = 0), 6) point, round(quantile_cont(v, 0.025) filter (where resample > 0), 6) lo, round(quantile_cont(v, 0.975) filter (where resample > 0), 6) hi from v group by band""")
def resampled_bands(spark, d):
    s = sites(spark, d).withColumn("y", (F.col("v") > 50).cast("int"))
    g = s.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    x = J.band_pairs(s, ["u"], "p", 50000, ["y"]).withColumn("band", F.when(F.col("distance") < 20000, "near").otherwise("far"))
    sums = x.groupBy("u", "band").agg(F.sum(F.col("y_a") * F.col("y_b")).alias("both"), F.count(F.lit(1)).alias("pairs")).join(g, "u")
    expected = F.col("pairs") * (F.col("k") * (F.col("k") - 1) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)))
    sums = G.saved(sums.select("u", "band", "both", expected.alias("expected")), "band-sums")
    return rounded(R.resampled_ratio(sums, "u", ["band"], "both", "expected", 50, "pairs"), "point", "lo", "hi")


# --- repeated cross-validation, partial dependence --------------------------------

_SEEDS = R.repetition_seeds(3, 11)


@query(f"""with g as (select distinct user_id u, r.rep, r.seed from events, (values {", ".join(f"({i}, '{s}')" for i, s in enumerate(_SEEDS))}) r(rep, seed)),
f as (select rep, u, (row_number() over (partition by rep order by substr(md5(concat_ws(':', seed, cast(u as varchar))), 1, 8), u) - 1) % 5 fold from g)
select rep, u, cast(fold as integer) fold from f""")
def repeated_folds(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("u"))
    return R.repeated_folds(e, "u", 5, 3, 11)


_REPEATED = f"""g as (select distinct user_id u, r.rep, r.seed from events, (values {", ".join(f"({i}, '{s}')" for i, s in enumerate(_SEEDS))}) r(rep, seed)),
f as (select rep, u, (row_number() over (partition by rep order by substr(md5(concat_ws(':', seed, cast(u as varchar))), 1, 8), u) - 1) % 5 fold from g),
x as (select rep, fold, event_id, event_type t, case when value > 60 then 1 else 0 end y from events join f on f.u = events.user_id),
c as (select rep, fold, t, count(*) n, sum(y) k from x group by 1, 2, 3),
o as (select rep, fold, t, (sum(k) over (partition by rep, t) - k) / nullif(cast(sum(n) over (partition by rep, t) - n as double), 0) own,
(sum(k) over (partition by rep) - sum(k) over (partition by rep, fold)) / nullif(cast(sum(n) over (partition by rep) - sum(n) over (partition by rep, fold) as double), 0) rest from c),
z as (select rep, fold, event_id, y, coalesce(own, rest) s from x join o using (rep, fold, t))"""


def repeated_scores(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("u"), F.col("event_type").alias("t"), (F.col("value") > 60).cast("int").alias("y"))
    return R.out_of_fold_rates(e, R.repeated_folds(e, "u", 5, 3, 11), "u", "t", "y")


@query(f"with {_REPEATED} select rep, cast(fold as integer) fold, event_id, round(s, 6) score from z")
def repeated_out_of_fold(spark, d):
    return rounded(repeated_scores(spark, d).select("rep", "fold", "event_id", "score"), "score")


@query(f"""with {_REPEATED}, m as ({_ranked("z", "rep, fold")}), n as (select rep, fold, count(*) n, sum(y) positives from z group by 1, 2)
select rep, cast(fold as integer) fold, n, cast(positives as bigint) positives, round(ap, 6) ap, round(auc, 6) auc from m join n using (rep, fold)""")
def train_and_evaluate(spark, d):
    scored = repeated_scores(spark, d)
    return rounded(M.ap_and_auc(scored.withColumn("s", F.round("score", 12)), ["rep", "fold"], "s", "y"), "ap", "auc").select("rep", "fold", "n", "positives", "ap", "auc")


_LEVELS = [i / 10 for i in range(11)]


def _logit_score(x):
    return 1 / (1 + np.exp(-(0.03 * x["l_quantity"] - 20 * x["l_discount"] + 0.5 * np.sqrt(x["l_quantity"]) * x["l_tax"])))


@query(f"""with q as (select unnest(range(0, 11)) step), v as (select step, (select list_extract(quantile_cont(l_discount, {_LEVELS}), step + 1) from lineitem) value from q)
select cast(step as integer) step, round(step / 10.0::double, 6) level, round(value, 6) value, round((select avg(1 / (1 + exp(-(0.03 * l_quantity - 20 * value + 0.5 * sqrt(l_quantity) * l_tax)))) from lineitem), 6) mean from v""")
def partial_dependence(spark, d):
    inputs = ["l_quantity", "l_discount", "l_tax"]
    out = X.partial_dependence(table(spark, d, "lineitem"), inputs, "l_discount", _logit_score, _LEVELS)
    return rounded(out, "level", "value", "mean")
