"""Reports that chain what is built: head to head, lines side by side, reliability by type, context, profiles, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import verdict
from ..operators import evaluation as E
from ..operators import grading as G
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import windows as W
from .catalog import SCORED, query, rounded, scored, table
from .evaluation import _OBS, _h, _ranked, _weight, observations
from .studies import _BANDS, _LABELLED, exons, labelled_sites, scored_sites

_DRAWN = f"""q as (select band, gene, arm, s, y, resample, {_weight(_h("genes", "resample", "gene"))} w from (select band, gene, 'a' arm, s, y from b union all select band, gene, 'b', o, y from b), (select unnest(range(1, 21)) resample)),
qt as (select band, arm, resample, s, sum(w * y) tp, sum(w) n from q where w > 0 group by 1, 2, 3, 4),
qc as (select band, arm, resample, tp, sum(tp) over x ctp, sum(n) over x cn from qt window x as (partition by band, arm, resample order by s desc)),
qa as (select band, arm, resample, sum(tp * (ctp / cast(cn as double))) / sum(tp) ap from qc group by 1, 2, 3 having sum(tp) > 0),
qd as (select band, resample, max(ap) filter (where arm = 'a') - max(ap) filter (where arm = 'b') v from qa group by 1, 2)"""


@query(f"""with {_LABELLED}, b as (select band, s, ((pos * 7 + l_partkey) % 89) / 89.0::double o, y, gene from (select *, 'all' band from f union all select *, {_BANDS} from f)),
bo as (select band, o s, y from b), ma as ({_ranked("b", "band")}), mb as ({_ranked("bo", "band")}), z as (select band, count(*) n, sum(y) positives from b group by 1 having sum(y) >= 20), {_DRAWN},
i as (select band, quantile_cont(v, 0.025) low, quantile_cont(v, 0.975) high, avg(case when v > 0 then 1.0 else 0.0 end) wins from qd where v is not null group by 1)
select band, z.n, cast(z.positives as bigint) positives, round(ma.ap, 6) ap_a, round(mb.ap, 6) ap_b, round(ma.auc, 6) auc_a, round(mb.auc, 6) auc_b, round(ma.ap - mb.ap, 6) gain, round(low, 6) low, round(high, 6) high, round(wins, 6) wins
from z join ma using (band) join mb using (band) join i using (band)""")
def head_to_head(spark, d):
    n = F.col("n_reads")
    band = F.when(n < 10, "1-9").when(n < 20, "10-19").when(n < 40, "20-39").otherwise("40+")
    rows = G.with_bands(labelled_sites(spark, d).withColumn("o", ((F.col("pos") * 7 + F.col("l_partkey")) % 89) / 89.0), band)
    out = E.head_to_head(rows, ["band"], "s", "o", "label", "gene", 20, "genes").withColumnRenamed("gain", "_gain")
    return rounded(out.withColumnRenamed("_gain", "gain"), "ap_a", "ap_b", "auc_a", "auc_b", "gain", "low", "high", "wins")


# --- lines side by side: return flags are lines, a supplier's part is a site -----------------

_SITE = "x as (select l_returnflag line, l_suppkey % 20 g, l_partkey p, count(*) n, round(avg(l_quantity), 9) s from lineitem group by 1, 2, 3)"
_DEPTH = "case when {0} < 2 then '1' when {0} < 3 then '2' else '3+' end"


def line_sites(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("line"), (F.col("l_suppkey") % 20).alias("g"), F.col("l_partkey").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 9).alias("s"))


def depth_of(n):
    return F.when(n < 2, "1").when(n < 3, "2").otherwise("3+")


@query(f"""with {_SITE}, t as (select line, count(*) total, quantile_cont(n, 0.5) median_reads from x group by 1)
select line, {_DEPTH.format("n")} band, count(*) sites, round(count(*) / cast(any_value(total) as double), 6) share, round(avg(s), 6) mean_score, round(any_value(median_reads), 6) median_reads from x join t using (line) group by 1, 2""")
def line_profile(spark, d):
    x = line_sites(spark, d)
    t = x.groupBy("line").agg(F.count(F.lit(1)).alias("total"), F.percentile("n", F.lit(0.5)).alias("median_reads"))  # a row a line
    g = x.groupBy("line", depth_of(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("sites"), F.avg("s").alias("mean_score")).join(t, "line")
    return rounded(g.withColumn("share", F.col("sites") / F.col("total")).drop("total"), "share", "mean_score", "median_reads")


@query(f"""with {_SITE}, j as (select a.line || '-' || b.line pair, {_DEPTH.format("least(a.n, b.n)")} band, a.s sa, b.s sb from x a join x b on a.g = b.g and a.p = b.p and a.line < b.line),
r as (select pair, band, rank() over (partition by pair, band order by sa) + (count(*) over (partition by pair, band, sa) - 1) / 2.0::double ra, rank() over (partition by pair, band order by sb) + (count(*) over (partition by pair, band, sb) - 1) / 2.0::double rb from j)
select pair, band, count(*) n, round(corr(ra, rb), 6) rho from r group by 1, 2""")
def line_agreement(spark, d):
    x = line_sites(spark, d)
    a, b = (x.select("g", "p", F.col("line").alias(f"line_{m}"), F.col("n").alias(f"n_{m}"), F.col("s").alias(f"s_{m}")) for m in "ab")
    j = a.join(b, ["g", "p"]).where("line_a < line_b")
    j = j.select(F.concat_ws("-", "line_a", "line_b").alias("pair"), depth_of(F.least("n_a", "n_b")).alias("band"), "s_a", "s_b")
    return rounded(G.rank_correlation(j, ["pair", "band"], "s_a", "s_b"), "rho")


@query(f"""with {_SITE}, c as (select g, p from x where n >= 1 group by 1, 2 having count(*) = 3), m as (select line, g, avg(s) v, count(*) sites from x join c using (g, p) group by 1, 2),
r as (select *, (rank() over (partition by line order by v) + (count(*) over (partition by line, v) - 1) / 2.0::double) / count(*) over (partition by line) place from m)
select g, cast(max(sites) as bigint) sites, round(min(place), 6) least_place, round(max(v) - min(v), 6) spread, min(place) > 0.7 top_everywhere from r group by g having count(*) = 3""")
def groups_in_every_line(spark, d):
    x = line_sites(spark, d)
    common = x.groupBy("g", "p").agg(F.count(F.lit(1)).alias("_lines")).where("_lines = 3").drop("_lines")
    m = x.join(common, ["g", "p"]).groupBy("line", "g").agg(F.avg("s").alias("v"), F.count(F.lit(1)).alias("sites"))
    r = W.average_rank(m, ["line"], "v", "place", share=True)
    out = r.groupBy("g").agg(F.max("sites").alias("sites"), F.min("place").alias("least_place"), (F.max("v") - F.min("v")).alias("spread"), (F.min("place") > 0.7).alias("top_everywhere"), F.count(F.lit(1)).alias("_n"))
    return rounded(out.where("_n = 3").drop("_n"), "least_place", "spread")


# --- reliability by type ---------------------------------------------------------------

_TYPES = "select 'all' family, 'all sites' type, * from v union all select 'lang', lang, * from v union all select 'source', source, * from v"


@query(f"""with {SCORED}, v as (select doc_id, lang, source, y, s, (n_chars % 97) / 97.0::double b, (n_chars % 31) / 31.0::double c from d), t as ({_TYPES}),
l as (select family, type, 's' draw, s, y from t union all select family, type, 'b', b, y from t union all select family, type, 'c', c, y from t), m as ({_ranked("l", "family, type, draw")}),
a as (select family, type, avg(auc) mean, stddev_pop(auc) sd from m group by 1, 2), n as (select family, type, count(*) n, sum(y) k, count(distinct source) clusters from t group by 1, 2)
select family, type, n, cast(k as bigint) positives, clusters, case when least(k, n - k) >= 10 then round(mean, 6) end pair_accuracy, case when least(k, n - k) >= 10 then round(sd, 6) end draw_sd, case when least(k, n - k) < 10 then 'too few to judge' else '' end note
from n join a using (family, type)""")
def reliability_by_type(spark, d):
    rows = scored(spark, d).withColumns({"b": (F.col("n_chars") % 97) / 97.0, "c": (F.col("n_chars") % 31) / 31.0})
    families = {"all": F.lit("all sites"), "lang": F.col("lang"), "source": F.col("source")}
    return rounded(E.by_type(rows.withColumn("cl", F.col("source")), families, ["s", "b", "c"], "y", "cl", 10), "pair_accuracy", "draw_sd")


# --- annotation context ------------------------------------------------------------------


@query("""with e as (select o_orderkey tx, case when o_orderstatus = 'F' then '-' else '+' end strand, (o_custkey % 50) * 2000 + i * 500 st from orders, (values (1), (2), (3)) t(i)),
c as (select tx, row_number() over (partition by tx order by case strand when '-' then -st else st end) k from e),
x as (select l_orderkey tx, (l_linenumber * 37 + l_partkey) % 300 pos, case when l_tax >= 0.04 then 1 else 0 end y from lineitem),
j as (select x.tx, pos, y, k, (select min(abs(q - pos)) from (values (100), (200)) t(q)) gap from x join c on c.tx = x.tx and pos >= 100 * (k - 1) and pos < 100 * k),
r as (select case k when 1 then 'first' when 3 then 'last' else 'internal' end exon, case when gap < 25 then '0-25' when gap < 50 then '25-50' when gap < 100 then '50-100' end junction, y from j),
u as (select 'exon' feature, exon "value", y from r union all select 'junction', junction, y from r)
select feature, "value", count(*) n, round(avg(y), 6) rate, round(avg(y) / (select avg(y) from r), 6) lift from u group by 1, 2""")
def annotation_context(spark, d):
    sites = scored_sites(spark, d).select("tx", "pos", F.col("other").alias("y"))
    held = J.on_exons(sites, exons(spark, d), "tx", "pos").where("_exon is not null")
    junctions = F.filter("_exons", lambda e: e["t_start"] > 0)
    gap = F.array_min(F.transform(junctions, lambda e: F.abs(F.col("pos") - e["t_start"])))
    near = held.select("y", F.col("_exon.k").alias("k"), F.size("_exons").alias("m"), gap.alias("event_gap"))
    exon = F.when(F.col("m") == 1, "single").when(F.col("k") == 1, "first").when(F.col("k") == F.col("m"), "last").otherwise("internal")
    kinds = F.array(F.struct(F.lit("exon").alias("feature"), exon.alias("value")), F.struct(F.lit("junction").alias("feature"), J.band_of(F.col("event_gap"), [0, 25, 50, 100]).alias("value")))
    rows = G.saved(near.select("y", F.inline(kinds)), "contexts")
    overall = rows.where("feature = 'exon'").agg(F.avg("y").alias("_all"))  # one row
    g = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).join(F.broadcast(overall), how="cross")
    return rounded(g.withColumn("lift", F.col("rate") / F.col("_all")).drop("_all"), "rate", "lift")


# --- profiles of files, their match, motif shifts ----------------------------------------------


@query("""with x as (select l_returnflag file, l_suppkey t, l_partkey p, count(*) n from lineitem group by 1, 2, 3), tr as (select file, t, count(*) m from x group by 1, 2)
select x.file, count(*) sites, count(distinct x.t) transcripts, cast(sum(n) as bigint) n_reads, round(quantile_cont(n, 0.5), 6) median_reads, round(avg(case when n >= 2 then 1.0 else 0.0 end), 6) share_deep, round(any_value(q.m), 6) median_sites
from x join (select file, quantile_cont(m, 0.5) m from tr group by 1) q on q.file = x.file group by 1""")
def file_profile(spark, d):
    li = table(spark, d, "lineitem")
    x = li.groupBy(F.col("l_returnflag").alias("file"), F.col("l_suppkey").alias("t"), F.col("l_partkey").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tr = x.groupBy("file", "t").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("r"))
    q = tr.groupBy("file").agg(F.count(F.lit(1)).alias("transcripts"), F.percentile("m", F.lit(0.5)).alias("median_sites"))
    g = x.groupBy("file").agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n_reads"), F.percentile("n", F.lit(0.5)).alias("median_reads"), F.avg(F.when(F.col("n") >= 2, 1.0).otherwise(0.0)).alias("share_deep"))
    return rounded(g.join(q, "file"), "median_reads", "share_deep", "median_sites")


@query("""with x as (select l_returnflag file, l_suppkey % 10 t, l_partkey p, count(*) n from lineitem group by 1, 2, 3), y as (select l_linestatus sample, l_suppkey % 10 t, l_partkey p, count(*) n from lineitem group by 1, 2, 3)
select file, v.sample, round(avg(case when y.n is null then 0.0 else 1.0 end), 6) present, round(avg(case when y.n = x.n then 1.0 else 0.0 end), 6) same_depth from x cross join (values ('F'), ('O')) v(sample) left join y on y.sample = v.sample and y.t = x.t and y.p = x.p group by 1, 2""")
def provenance_match(spark, d):
    li = table(spark, d, "lineitem").withColumn("t", F.col("l_suppkey") % 10)
    x = li.groupBy(F.col("l_returnflag").alias("file"), "t", F.col("l_partkey").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    y = li.groupBy("t", F.col("l_partkey").alias("p")).agg(*[F.count(F.when(F.col("l_linestatus") == s, 1)).alias(s) for s in "FO"])
    j = x.join(y, ["t", "p"], "left")
    each = j.select("file", "n", F.inline(F.array(*[F.struct(F.lit(s).alias("sample"), F.coalesce(F.col(s), F.lit(0)).alias("m")) for s in "FO"])))
    return rounded(each.groupBy("file", "sample").agg(F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("present"), F.avg(F.when(F.col("m") == F.col("n"), 1.0).otherwise(0.0)).alias("same_depth")), "present", "same_depth")


@query("""with g as (select p_brand motif, l_returnflag file, sum(l_quantity * l_discount) / sum(l_quantity) m, sum(l_quantity * l_tax) / sum(l_quantity) sd, count(*) n from lineitem join part on p_partkey = l_partkey group by 1, 2)
select a.file, count(*) shared, round(quantile_cont(abs(a.m - r.m), 0.5), 6) median_distance, round(quantile_cont(a.m - r.m, 0.5), 6) median_shift, round(quantile_cont(a.sd / r.sd, 0.5), 6) median_ratio
from g a join g r on r.motif = a.motif and r.file = 'A' where a.n >= 20 and r.n >= 20 group by 1""")
def motif_shifts(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w = F.sum("l_quantity")
    g = li.groupBy(F.col("p_brand").alias("motif"), F.col("l_returnflag").alias("file")).agg((F.sum(F.col("l_quantity") * F.col("l_discount")) / w).alias("m"), (F.sum(F.col("l_quantity") * F.col("l_tax")) / w).alias("sd"), F.count(F.lit(1)).alias("n"))
    g = G.saved(g.where("n >= 20"), "motifs")
    r = g.where("file = 'A'").select("motif", F.col("m").alias("rm"), F.col("sd").alias("rsd"))
    j = g.join(r, "motif")
    half = F.lit(0.5)
    gap = F.col("m") - F.col("rm")
    out = j.groupBy("file").agg(F.count(F.lit(1)).alias("shared"), F.percentile(F.abs(gap), half).alias("median_distance"), F.percentile(gap, half).alias("median_shift"), F.percentile(F.col("sd") / F.col("rsd"), half).alias("median_ratio"))
    return rounded(out, "median_distance", "median_shift", "median_ratio")


_AUDIT = """l as (select l_linenumber - 1 lev, 'l_quantity' col, l_quantity v from lineitem union all select l_linenumber - 1, 'l_tax', l_tax from lineitem), m as (select col, lev, avg(v) m, stddev_samp(v) s from l group by 1, 2),
h as (select a.col, a.lev, (a.m - z.m) / nullif(z.s, 0) shift from m a join m z on a.col = z.col and z.lev = 0)"""


@query(f"""with {_AUDIT}, r as (select col, lev, shift, rank() over (partition by col order by lev) a, rank() over (partition by col order by shift) b, max(lev) over () top from h),
p as (select col, corr(a, b) monotonic, arg_max((lev, shift), (abs(shift), -lev)) pk, max(shift) filter (where lev = 6) e, max(abs(shift)) t from r group by col)
select col "column", round(monotonic, 6) monotonic, pk[1] peak, round(pk[2], 6) shift_at_peak, round(e, 6) shift_at_last, round(t - abs(e), 6) hump from p""")
def audit_shapes(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("lev"), "l_quantity", "l_tax")
    return rounded(E.audit_shapes(E.column_audit(li, ["l_quantity", "l_tax"], "lev"), "lev", 6), "monotonic", "shift_at_peak", "shift_at_last", "hump")


# --- comparisons with p values and verdicts ---------------------------------------------------

_P = "greatest(1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * (abs(t) / 4000) * list_sum(list_transform(range(0, 4000), lambda i: power(1 + power((i + 0.5) * abs(t) / 4000, 2) / df, -(df + 1) / 2.0))), 0)"


@query(f"""with {_OBS}, p as (select lang, count(a - b) n, avg(a) mean_a, avg(b) mean_b, avg(a - b) mean, var_samp(a - b) v, avg(case when a > b then 1.0 else 0.0 end) wins from o where a - b is not null group by 1 having count(*) >= 2),
c as (select *, mean / sqrt(v * (1.0 / n + 0.25)) t, n - 1 df from p), q as (select *, {_P} p from c)
select lang, n, round(mean_a, 6) mean_a, round(mean_b, 6) mean_b, round(mean, 6) difference, round(wins, 6) wins, round(p, 4) p, case when p < 0.05 and wins >= 0.9 then 'better' when p < 0.05 and wins <= 0.1 then 'worse' else 'no difference' end verdict from q""")
def comparison_frame(spark, d):
    o = G.saved(observations(spark, d), "observations")
    means = o.where((F.col("ap_a") - F.col("ap_b")).isNotNull()).groupBy("lang").agg(F.avg("ap_a").alias("mean_a"), F.avg("ap_b").alias("mean_b"))
    p = E.paired(o, ["lang"], "ap_a", "ap_b", 5).withColumn("p", M.t_chance(F.col("t_corrected"), F.col("n") - 1))
    out = p.join(means, "lang").select("lang", "n", "mean_a", "mean_b", F.col("mean").alias("difference"), "wins", "p", verdict(F.col("p"), F.col("wins")).alias("verdict"))
    return rounded(rounded(out, "mean_a", "mean_b", "difference", "wins"), "p", places=4)


@query(f"""with {_OBS}, g as (select lang, count(a) na, count(b) nb, avg(a) - avg(b) difference, var_samp(a) / count(a) ea, var_samp(b) / count(b) eb from o group by 1),
c as (select lang, na n_a, nb n_b, difference, difference / sqrt(ea + eb) t, power(ea + eb, 2) / (power(ea, 2) / (na - 1) + power(eb, 2) / (nb - 1)) df from g where na > 1 and nb > 1), q as (select *, {_P} p from c)
select lang, n_a, n_b, round(difference, 6) difference, round(t, 4) t, round(df, 4) df, round(p, 4) p from q""")
def unpaired_comparison(spark, d):
    o = G.saved(observations(spark, d), "observations")
    w = M.welch(o.select("lang", F.col("ap_a").alias("v")), o.select("lang", F.col("ap_b").alias("v")), ["lang"], "v")
    return rounded(rounded(w.withColumn("p", M.t_chance(F.col("t"), F.col("df"))), "difference"), "t", "df", "p", places=4)


# --- ensembles of seeds against a base ---------------------------------------------------------


@query(f"""with {SCORED}, v as (select lang, source, y, (n_chars % 89) / 89.0::double base, (n_chars % 97) / 97.0::double b, (n_chars % 31) / 31.0::double c, s from d),
k as (select *, ((rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double) / count(*) over () + (rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0::double) / count(*) over () + (rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double) / count(*) over ()) / 3 e from v),
x as (select lang band, source gene, round(e, 9) s, base o, y from k), b as (select * from x), bo as (select band, o s, y from b), ma as ({_ranked("b", "band")}), mb as ({_ranked("bo", "band")}), {_DRAWN},
i as (select band, quantile_cont(v, 0.025) low, quantile_cont(v, 0.975) high, avg(case when v > 0 then 1.0 else 0.0 end) wins from qd where v is not null group by 1), z as (select band, sum(y) k from b group by 1)
select band lang, round(ma.ap, 6) ap_ensemble, round(mb.ap, 6) ap_base, round(ma.ap - mb.ap, 6) gain, round(low, 6) low, round(high, 6) high, round(wins, 6) wins from ma join mb using (band) join i using (band) join z using (band) where k >= 5""")
def ensemble_against_base(spark, d):
    s = scored(spark, d)
    v = s.select("doc_id", "lang", "source", "y", "s", *[((F.col("n_chars") % m) / float(m)).alias(n) for n, m in (("base", 89), ("b", 97), ("c", 31))])
    for c in ("b", "c", "s"):
        v = W.average_rank(v, [], c, f"r_{c}", share=True)
    v = v.withColumn("e", F.round((F.col("r_b") + F.col("r_c") + F.col("r_s")) / 3, 9)).withColumn("gene", F.col("source"))
    out = E.head_to_head(v, ["lang"], "e", "base", "y", "gene", 20, "genes", least=5)
    return rounded(out.select("lang", F.col("ap_a").alias("ap_ensemble"), F.col("ap_b").alias("ap_base"), "gain", "low", "high", "wins"), "ap_ensemble", "ap_base", "gain", "low", "high", "wins")
