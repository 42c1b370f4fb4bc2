"""Evaluation, resampling and label queries over the driver's tables, each with DuckDB SQL. Draws are md5 hashes, so both agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import metrics as M
from ..operators import windows as W
from .catalog import SCORED, SITES, query, rounded, scored, sites, table


def _h(seed: str, *columns: str) -> str:
    return f"substr(md5(concat_ws(':', '{seed}', {', '.join(f'cast({c} as varchar)' for c in columns)})), 1, 8)"


def _weight(draw: str) -> str:
    p, total, out = 0.36787944117144233, 0.0, []
    for k in range(8):
        total += p
        out.append(f"(case when {draw} >= '{int(min(total, 1 - 2**-33) * (1 << 32)):08x}' then 1 else 0 end)")
        p /= k + 1
    return "(" + " + ".join(out) + ")"


def _ranked(source: str, group: str) -> str:
    """SQL for average precision and AUC of (group, s, y) with ties at one threshold."""
    return f"""select {group}, sum(tp * (ctp / cast(cn as double))) / nullif(sum(tp), 0) ap, sum((n - tp) * (ctp - tp / 2.0::double)) / nullif(cast(sum(tp) * sum(n - tp) as double), 0) auc
from (select {group}, s, tp, n, sum(tp) over (partition by {group} order by s desc) ctp, sum(n) over (partition by {group} order by s desc) cn
from (select {group}, s, sum(y) tp, count(*) n from {source} group by {group}, s)) group by {group}"""


@query(f"""with x as (select l_partkey k, depth, l_quantity q, row_number() over (partition by l_partkey, depth order by {_h("thin", "depth", "l_partkey", "l_orderkey", "l_linenumber")}, l_orderkey, l_linenumber) r
from lineitem, (values (1), (2), (5)) v(depth)), z as (select depth, k, avg(q) s from x where r <= depth group by 1, 2),
w as (select depth, s, case when p_size > 25 then 1 else 0 end y from z join part on p_partkey = k), m as ({_ranked("w", "depth")})
select depth, round(ap, 6) ap, round(auc, 6) auc, round(ap / (select ap from m where depth = 5), 6) retained from m""")
def depth_sweep(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    kept = E.thin_readings(li, ["l_partkey"], ["l_orderkey", "l_linenumber"], [1, 2, 5], "thin")
    s = kept.groupBy("depth", F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("s"))
    y = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 25).cast("int").alias("y"))
    return rounded(E.depth_sweep(s.join(y, "p_partkey"), 5), "ap", "auc", "retained")


def two_arms(spark, d):
    return scored(spark, d).withColumn("b", (F.col("n_chars") % 97) / 97.0).withColumnRenamed("s", "a")


ARMS = f"{SCORED}, ab as (select doc_id, lang, source, y, s a, (n_chars % 97) / 97.0::double b from d)"
_FOLDED = """l as (select lang, rep, fold, 'a' arm, a s, y from f union all select lang, rep, fold, 'b', b, y from f)"""
_OBS = f"""{ARMS}, f as (select ab.*, rep, (case when rep = 0 then doc_id else doc_id // 5 end) % 5 fold from ab, (values (0), (1)) r(rep)), {_FOLDED},
m as ({_ranked("l", "lang, rep, fold, arm")}), o as (select lang, rep, fold, max(case when arm = 'a' then ap end) a, max(case when arm = 'b' then ap end) b from m group by 1, 2, 3)"""


def observations(spark, d):
    f = two_arms(spark, d).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1))))
    f = f.withColumn("fold", F.when(F.col("rep") == 0, F.col("doc_id")).otherwise(F.floor(F.col("doc_id") / 5)) % 5)
    runs = [M.average_precision(f, ["lang", "rep", "fold"], arm, "y") for arm in "ab"]
    return E.align_runs(*runs, ["lang", "rep", "fold"], "ap")


@query(f"with {_OBS} select lang, rep, fold, round(a, 6) ap_a, round(b, 6) ap_b from o")
def run_alignment(spark, d):
    return rounded(observations(spark, d), "ap_a", "ap_b")


@query(f"""with {_OBS}, p as (select lang, count(a - b) n, avg(a - b) mean, var_samp(a - b) v, avg(case when a > b then 1.0 else 0.0 end) wins from o where a - b is not null group by 1 having count(*) >= 2)
select lang, n, round(mean, 6) mean, round(wins, 6) wins, round(mean / sqrt(v * (1.0 / n)), 4) t_naive, round(mean / sqrt(v * (1.0 / n + 0.25)), 4) t_corrected from p""")
def paired_by_stratum(spark, d):
    return rounded(rounded(E.paired(observations(spark, d), ["lang"], "ap_a", "ap_b", 5), "mean", "wins"), "t_naive", "t_corrected", places=4)


@query("""select sum(case when l.doc_id is null then 1 else 0 end) left_only, sum(case when d.doc_id is null then 1 else 0 end) right_only,
sum(case when l.doc_id is not null and d.doc_id is not null and doc_id % 7 is distinct from l.k % 5 then 1 else 0 end) different
from documents d full join (select doc_id, doc_id k from labels) l using (doc_id)""".replace("l.doc_id is null", "l.k is null").replace("l.doc_id is not null", "l.k is not null").replace("d.doc_id is null", "d.text_id is null").replace("d.doc_id is not null", "d.text_id is not null").replace("from documents d", "from (select doc_id, doc_id text_id from documents) d"))
def contract_check(spark, d):
    a = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 7).alias("v"))
    return E.contract_mismatches(a, table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 5).alias("v")), ["doc_id"], "v")


def _boot(cluster: str) -> str:
    w = _weight(_h("boot", "resample", cluster))
    return f"""with {ARMS}, l as (select {cluster} c, 'a' arm, a s, y from ab union all select {cluster}, 'b', b, y from ab),
r as (select resample, arm, s, y, {w.replace(f"cast({cluster} as varchar)", "cast(c as varchar)")} w from l, (select unnest(range(1, 21)) resample)),
t as (select resample, arm, s, sum(w * y) tp, sum(w) n from r where w > 0 group by 1, 2, 3),
c as (select resample, arm, tp, sum(tp) over q ctp, sum(n) over q cn from t window q as (partition by resample, arm order by s desc)),
m as (select resample, arm, sum(tp * (ctp / cast(cn as double))) / sum(tp) ap from c group by 1, 2 having sum(tp) > 0),
g as (select a.ap - b.ap v from m a join m b on a.resample = b.resample and a.arm = 'a' and b.arm = 'b')
select count(*) n, round(avg(v), 6) mean, round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.975), 6) high, round(avg(case when v > 0 then 1.0 else 0.0 end), 6) share_positive from g"""


def _gain(spark, d, cluster):
    ap = E.bootstrap_ap(two_arms(spark, d), [cluster], ["a", "b"], "y", 20, "boot")
    gain = ap.where("arm = 'a'").join(ap.where("arm = 'b'").select("resample", F.col("ap").alias("_b")), "resample").select((F.col("ap") - F.col("_b")).alias("v"))
    return rounded(E.interval(gain, [], "v"), "mean", "low", "high", "share_positive")


@query(_boot("doc_id"))
def paired_bootstrap(spark, d):
    return _gain(spark, d, "doc_id")


@query(_boot("source"))
def paired_cluster_bootstrap(spark, d):
    return _gain(spark, d, "source")


@query(f"""with a as (select distinct source k, length(source) % 3 fold from documents where doc_id % 4 = 0), n as (select distinct source k from documents where source not in (select k from a))
select k, fold, 'first' origin from a union all select k, (row_number() over (order by {_h("union", "k")}, k) - 1) % 3, 'second' from n""")
def union_folds(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("k"), "doc_id")
    first = docs.where("doc_id % 4 = 0").select("k", (F.length("k") % 3).alias("fold")).distinct()
    return E.union_folds(first, docs, "k", 3, "union")


@query(f"""with r as (select doc_id, quality, row_number() over (partition by quality order by {_h("labels", "doc_id")}, doc_id) r, count(*) over () n from labels)
select doc_id, case when quality = 1 and r <= round(0.2 * n) then 1 else 0 end quality from r""")
def label_thinning(spark, d):
    return E.thin_labels(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 0.2, "labels")


@query(f"""with {SITES}, k as (select u, p, case when {_h("view", "u", "p")} < '{int(0.3 * (1 << 32)):08x}' then 1 else 0 end seen from s)
select u, p, sum(seen) over (partition by u order by p range between 86400 preceding and 86400 following) - seen n_seen from k""")
def density_view(spark, d):
    return E.density_view(sites(spark, d), ["u"], "p", 86400, 0.3, "view").select("u", "p", "n_seen")


@query(f"""select case when {_h("parts", "doc_id")} < '55555555' then 0 when {_h("parts", "doc_id")} < 'aaaaaaaa' then 1 else 2 end part, count(*) n from documents group by 1""")
def disjoint_subsets(spark, d):
    h = E.keyed("parts", "doc_id")
    return table(spark, d, "documents").groupBy(F.when(h < "55555555", 0).when(h < "aaaaaaaa", 1).otherwise(2).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, lang from documents order by {_h('sample', 'doc_id')}, doc_id limit 100")
def exact_size_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").orderBy(E.keyed("sample", "doc_id"), "doc_id").limit(100)


@query(f"select source, count(*) n from documents where {_h('smoke', 'source')} < '80000000' group by source")
def group_subsample(spark, d):
    return table(spark, d, "documents").where(E.below(E.keyed("smoke", "source"), 0.5)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {ARMS}, l as (select lang, 'a' arm, a s, y from ab union all select lang, 'b', b, y from ab), m as ({_ranked("l", "lang, arm")}), g as (select x.arm, x.ap - b.ap gain from m x join m b on b.lang = x.lang and b.arm = 'b' where x.arm <> 'b')
select arm, round(avg(gain), 6) mean_gain, round(min(gain), 6) worst_gain, count(*) sources, min(gain) >= -0.005 eligible from g group by arm""")
def cross_source_gains(spark, d):
    t = two_arms(spark, d)
    cells = [M.average_precision(t, ["lang"], arm, "y").select(F.lit(arm).alias("arm"), F.col("lang").alias("source"), F.col("ap").alias("metric")) for arm in "ab"]
    return rounded(E.cross_source_summary(cells[0].unionByName(cells[1]), "b"), "mean_gain", "worst_gain")


@query("select o_orderkey, round(o_totalprice, 6) a, round(o_custkey / 7.0::double, 6) b from orders where o_orderkey % 1500 <> 7")
def commonly_scored(spark, d):
    o = table(spark, d, "orders")
    a = o.select("o_orderkey", F.col("o_totalprice").alias("s"))
    b = o.where("o_orderkey % 1500 <> 7").select("o_orderkey", (F.col("o_custkey") / 7.0).alias("s"))  # one in 1500 rows has no score
    return rounded(E.keep_scored({"a": a, "b": b}, ["o_orderkey"]), "a", "b")


@query("""select a.doc_id, round(coalesce((a.quality + b.toxic) / 2.0, a.quality), 6) y from labels a left join (select doc_id, toxic from labels where doc_id % 2 = 0) b using (doc_id)""")
def averaged_labels(spark, d):
    t = table(spark, d, "labels")
    own, other = t.select("doc_id", F.col("quality").alias("y")), t.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("y"))
    return rounded(E.averaged_labels(own, other, ["doc_id"]), "y")


def _place(score: str) -> str:
    return f"(rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0::double) / count(*) over ()"


@query(f"""with {SCORED}, r as (select y, t, {_place("s")} ra, {_place("(n_chars % 97)")} rb from d)
select case when y = 1 and t = 1 then 'both' when y = 1 then 'first' when t = 1 then 'second' else 'neither' end agreement, count(*) n, round(avg(rb - ra), 6) mean_shift from r group by 1""")
def rank_shift(spark, d):
    s = scored(spark, d)
    a, b = s.select("doc_id", "s", "y"), s.select("doc_id", (F.col("n_chars") % 97).alias("s"), F.col("t").alias("y"))
    return rounded(E.rank_shift(a, b, ["doc_id"]), "mean_shift")


@query("""select c_custkey, round(((select count(*) from supplier where s_acctbal < c_acctbal) + (select count(*) from supplier where s_acctbal <= c_acctbal) + 1) / 2.0::double / (select count(*) from supplier), 6) place from customer""")
def rank_in_sample(spark, d):
    new = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("s"))
    sample = table(spark, d, "supplier").select(F.col("s_acctbal").alias("s"))
    return E.rank_in_sample(new, sample, "s").select("c_custkey", F.round("place", 6).alias("place"))


@query(f"with {SCORED} select doc_id, round(case doc_id % 3 when 0 then s when 1 then (n_chars % 97) / 97.0::double end, 6) s, cast(case when doc_id % 3 = 2 then case when doc_id % 2 = 0 then 2 else 0 end else 1 end as bigint) n_scores from d")
def out_of_fold_scores(spark, d):
    # one fold's model scores each row but those of the last fold, which none or two of them score
    s, fold = scored(spark, d), F.col("doc_id") % 3
    twice = (fold == 2) & (F.col("doc_id") % 2 == 0)
    runs = [s.where((fold == 0) | twice).select("doc_id", "s"), s.where((fold == 1) | twice).select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("s"))]
    parts = s.select("doc_id", F.lit(None).cast("double").alias("s")).unionByName(runs[0]).unionByName(runs[1])
    return rounded(E.out_of_fold(parts, ["doc_id"]), "s")


@query(f"""with {SCORED}, f as (select lang, doc_id % 4 fold, s, y from d), m as ({_ranked("f", "lang, fold")})
select lang, count(*) folds, {", ".join(f"round({f}({c}), 6) {c}_{n}" for c in ("ap", "auc") for n, f in (("mean", "avg"), ("sd", "stddev_samp"), ("min", "min"), ("max", "max")))} from m group by lang""")
def fold_distribution(spark, d):
    f = E.fold_distribution(scored(spark, d).withColumn("fold", F.col("doc_id") % 4), ["lang"])
    return rounded(f, *[f"{c}_{n}" for c in ("ap", "auc") for n in ("mean", "sd", "min", "max")])


@query(f"""with {SCORED}, r as (select lang, y, 1 + doc_id % 3 w, sum((1 + doc_id % 3) * y) over q tp, sum(1 + doc_id % 3) over q n from d window q as (partition by lang order by s desc, doc_id rows unbounded preceding))
select lang, round(sum(w * y * tp / cast(n as double)) / nullif(sum(w * y), 0), 6) ap, round(sum(w * (1 - y) * tp) / nullif(cast(sum(w * y) * sum(w * (1 - y)) as double), 0), 6) auc from r group by lang""")
def weighted_metrics_in_order(spark, d):
    s = scored(spark, d).withColumn("w", 1 + F.col("doc_id") % 3)
    return rounded(E.weighted_ap_auc(s, ["lang"], [F.desc("s"), F.col("doc_id")], "y", "w"), "ap", "auc")


@query(f"""with {SCORED}, g as (select i from (select unnest(range(0, 201)) i)), c as (select i, count(*) filter (where round(s * 200, 9) >= i) called, coalesce(sum(y) filter (where round(s * 200, 9) >= i), 0) tp, sum(y) p from g, d group by i),
r as (select i, tp / cast(p as double) recall, tp / nullif(cast(called as double), 0) pr from c) select round(i / 200.0, 6) threshold, round(recall, 6) recall, round(max(pr) over (order by recall desc range between unbounded preceding and current row), 6) "precision" from r""")
def falling_envelope(spark, d):
    t = M.threshold_table(scored(spark, d), "s", "y").withColumn("g", F.lit(1))
    return rounded(E.envelope(t, ["g"], "recall", "precision").select("threshold", "recall", "precision"), "threshold", "recall", "precision")


_REGION = " ".join(f"union all select '{rule}', case when l_linenumber < 2 then 'utr5' when l_linenumber <= {last} then 'cds' else 'utr3' end from lineitem" for rule, last in (("through_stop", 6), ("before_stop", 3), ("span", 4)))[10:]


@query(f"select rule, region, count(*) n from ({_REGION}) x(rule, region) group by 1, 2")
def region_rules(spark, d):
    pos, start, end = F.col("l_linenumber"), F.lit(2), F.lit(4)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), E.region_of(pos, start, end, r).alias("region")) for r in ("through_stop", "before_stop", "span")])
    return table(spark, d, "lineitem").select(F.inline(rules)).groupBy("rule", "region").agg(F.count(F.lit(1)).alias("n"))


@query("""select a.doc_id, a.quality label_a, b.quality label_b from (select * from labels where doc_id % 3 > 0) a join (select * from labels where doc_id % 2 = 0) b using (doc_id)""")
def shared_labels(spark, d):
    t = table(spark, d, "labels").select("doc_id", "quality")
    return t.where("doc_id % 3 > 0").withColumnRenamed("quality", "label_a").join(t.where("doc_id % 2 = 0").withColumnRenamed("quality", "label_b"), "doc_id")


@query("""with s as (select distinct l_suppkey % 5 g, l_partkey % 400 p from lineitem), q as (select c_nationkey % 5 g, c_custkey % 400 x, (c_custkey * 7) % 400 y, c_acctbal v from customer)
select q.g, least(a.p, b.p) a, greatest(a.p, b.p) b, max(v) v from q join s a on a.g = q.g and abs(a.p - q.x) <= 5 join s b on b.g = q.g and abs(b.p - q.y) <= 5 where a.p <> b.p group by 1, 2, 3""")
def window_links(spark, d):
    s = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("g"), (F.col("l_partkey") % 400).alias("p")).distinct()
    c = table(spark, d, "customer")
    q = c.select((F.col("c_nationkey") % 5).alias("g"), (F.col("c_custkey") % 400).alias("x"), (F.col("c_custkey") * 7 % 400).alias("y"), F.col("c_acctbal").alias("v"))
    return E.window_links(q, s, ["g"], 5)


@query("""with m as (select p_partkey, s.k from part, (values ('red'), ('PROMO'), ('BRASS')) s(k) where contains(p_name || p_type, s.k)),
x as (select s.k, l_returnflag line, l_discount v, m.p_partkey is not null inside from lineitem cross join (values ('red'), ('PROMO'), ('BRASS')) s(k) left join m on m.p_partkey = l_partkey and m.k = s.k)
select k, line, count(*) filter (where inside) n, round(avg(v) filter (where inside) - avg(v) filter (where not inside), 6) effect from x group by 1, 2""")
def gene_set_effects(spark, d):
    sets = F.array(*[F.lit(x) for x in ("red", "PROMO", "BRASS")])
    text = F.concat("p_name", "p_type")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.filter(sets, lambda s: F.contains(text, s)).alias("held"))
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("line"), F.col("l_discount").alias("v"))
    x = li.join(part, "l_partkey").select("line", "v", "held", F.explode(sets).alias("k"))
    inside = F.array_contains("held", F.col("k"))
    effect = F.avg(F.when(inside, F.col("v"))) - F.avg(F.when(~inside, F.col("v")))
    return x.groupBy("k", "line").agg(F.count_if(inside).alias("n"), F.round(effect, 6).alias("effect"))


def _number(seed: str, *columns: str) -> str:
    return f"cast('0x' || {_h(seed, *columns)} as bigint)"


_KIND = "partition by o_orderpriority, o_orderstatus"


@query(f"""with r as (select o_orderkey, o_custkey, o_orderpriority, o_orderstatus, row_number() over ({_KIND} order by o_custkey, o_orderkey) - 1 place, count(*) over ({_KIND}) n from orders),
b as (select *, min(place) over ({_KIND}, o_custkey) f, count(*) over ({_KIND}, o_custkey) m from r),
w as (select *, {_number("donor", "o_orderpriority", "o_orderstatus", "o_orderkey")} % nullif(n - m, 0) k from b)
select w.o_orderkey, r.o_orderkey donor from w left join r on r.o_orderpriority = w.o_orderpriority and r.o_orderstatus = w.o_orderstatus and r.place = k + case when k >= f then m else 0 end""")
def replacement_donors(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return E.donors(o, ["o_orderpriority", "o_orderstatus"], "o_custkey", "o_orderkey", "donor").select("o_orderkey", "donor")


_ANY = """(select o.o_orderkey, o.o_custkey, o.o_orderpriority k, o.o_totalprice v, {0} % n want from orders o, (select count(*) n from orders))"""


@query(f"""with r as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice, row_number() over (order by o_orderkey) - 1 place from orders),
q as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice, row_number() over (partition by o_orderpriority order by o_custkey, o_orderkey) - 1 place, count(*) over (partition by o_orderpriority) n from orders),
b as (select *, min(place) over (partition by o_orderpriority, o_custkey) f, count(*) over (partition by o_orderpriority, o_custkey) m from q),
w as (select *, {_number("world-value", "o_orderpriority", "o_orderkey")} % nullif(n - m, 0) k from b),
x as (select 'value' world, w.o_orderkey, w.o_orderpriority, coalesce(q.o_totalprice, w.o_totalprice) v from w left join q on q.o_orderpriority = w.o_orderpriority and q.place = k + case when k >= f then m else 0 end
union all select 'kind', a.o_orderkey, r.o_orderpriority, a.v from {_ANY.format(_number("world-kind", "o_orderkey"))} a join r on r.place = a.want
union all select 'both', a.o_orderkey, r.o_orderpriority, r.o_totalprice from {_ANY.format(_number("world-both", "o_orderkey"))} a join r on r.place = a.want
union all select 'baseline', o_orderkey, o_orderpriority, o_totalprice - avg(o_totalprice) over (partition by o_custkey) + avg(o_totalprice) over () from orders)
select world, o_orderkey, o_orderpriority, round(v, 4) v from x""")
def replacement_worlds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    return rounded(E.replacement_worlds(o, "o_orderkey", "o_custkey", "o_orderpriority", "v", "world").drop("o_custkey"), "v", places=4)


_W = "(partition by {} order by p range between 86400 preceding and 86400 following)"


@query(f"""with {SITES}, y as (select u, p, case when v > 60 then 1 else 0 end y from s), a as (select u, p, y, row_number() over (partition by u order by p) k from y),
b as (select u, p, row_number() over (partition by u order by {_h("shuffle", "u", "p")}, p) k from y), w as (select 0 draw, u, p, y from y union all select 1, b.u, b.p, a.y from a join b using (u, k)),
x as (select draw, y, sum(y) over {_W.format("draw, u")} - y > 0 near, count(*) over {_W.format("draw, u")} n from w)
select draw, round(avg(y) filter (where near), 6) rate_near, round(avg(y) filter (where not near), 6) rate_apart, round(avg(y) filter (where near) / nullif(avg(y) filter (where not near), 0), 6) lift from x where n > 1 group by draw""")
def homophily_lift(spark, d):
    s = sites(spark, d).withColumn("y", (F.col("v") > 60).cast("int"))
    return rounded(E.homophily(s, ["u"], "p", "y", 86400, ["shuffle"]), "rate_near", "rate_apart", "lift")


@query("""with s as (select avg(ln(greatest(l_quantity, 1e-6))) m, stddev_pop(ln(greatest(l_quantity, 1e-6))) sd, avg(l_tax) tm, stddev_pop(l_tax) ts from lineitem)
select l_returnflag, round(avg((ln(greatest(l_quantity, 1e-6)) - m) / sd), 6) z_quantity, round(avg((l_tax - tm) / ts), 6) z_tax from lineitem, s group by 1""")
def read_standardiser(spark, d):
    z = E.standardised(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], ["l_quantity"])
    return z.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("z_quantity"), F.round(F.avg("l_tax"), 6).alias("z_tax"))


_SQ = " + ".join
_L, _RT = ["l_quantity", "l_discount"], ["l_tax", "l_linenumber"]


def _sq(a, b):
    return "(" + _SQ(f"power(covar_pop({x}, {y}), 2)" for x in a for y in b) + ")"


def _spread(a):
    return f"power({_SQ(f'var_pop({x})' for x in a)}, 2) / {_sq(a, a)}"


@query(f"select round({_sq(_L, _RT)} / sqrt({_sq(_L, _L)} * {_sq(_RT, _RT)}), 9) cka, round({_spread(_L)}, 6) spread_left, round({_spread(_RT)}, 6) spread_right from lineitem")
def kernel_alignment(spark, d):
    return rounded(rounded(E.linear_cka(table(spark, d, "lineitem"), _L, _RT), "cka", places=9), "spread_left", "spread_right")


@query("""with l as (select l_linenumber - 1 lev, 'l_quantity' col, l_quantity v from lineitem union all select l_linenumber - 1, 'l_tax', l_tax from lineitem), m as (select col, lev, avg(v) m, stddev_samp(v) s from l group by 1, 2)
select a.col "column", a.lev, round((a.m - z.m) / nullif(z.s, 0), 6) shift from m a join m z on a.col = z.col and z.lev = 0""")
def column_audit(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("lev"), "l_quantity", "l_tax")
    return rounded(E.column_audit(li, ["l_quantity", "l_tax"], "lev"), "shift")


@query("""with m as (select l_suppkey g, l_partkey p, round(avg(l_discount), 9) s, count(*) n from lineitem group by 1, 2)
select g, count(*) n_sites, round(avg(case when s > 0.05 then 1.0 else 0.0 end), 6) share_high, max(s) best, arg_max(p, (s, -p)) best_site from m group by g having count(*) >= 5""".replace("max(s) best,", "round(max(s), 6) best,"))
def group_shares(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("p")).agg(F.round(F.avg("l_discount"), 9).alias("s"))  # rounded: a threshold must not hang on the order of a sum
    share, best = F.avg(F.when(F.col("s") > 0.05, 1.0).otherwise(0.0)), F.max_by("p", F.struct("s", -F.col("p")))
    return m.groupBy("g").agg(F.count(F.lit(1)).alias("n_sites"), F.round(share, 6).alias("share_high"), F.round(F.max("s"), 6).alias("best"), best.alias("best_site")).where("n_sites >= 5")


@query("""with c as (select o_custkey % 10 fold, row_number() over (partition by o_custkey % 10 order by o_orderdate, o_orderkey) it, o_totalprice v from orders), n as (select min(k) k from (select fold, count(*) k from c group by 1))
select it, round(avg(v), 4) mean, round(stddev_samp(v), 4) sd from c, n where it <= k group by it""")
def learning_curve(spark, d):
    o = table(spark, d, "orders").withColumn("fold", F.col("o_custkey") % 10)
    c = W.numbered(o, ["fold"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "at")
    shortest = c.groupBy("fold").agg(F.max("at").alias("k")).agg(F.min("k").alias("k"))  # one row: curves end with the shortest
    c = c.join(F.broadcast(shortest), how="cross").where("at <= k")
    return rounded(c.groupBy((F.col("at") + 1).alias("it")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd")), "mean", "sd", places=4)


@query("""with g as (select p_brand, l_linestatus, sum(l_quantity * l_discount) / sum(l_quantity) s, count(*) n from lineitem join part on p_partkey = l_partkey group by 1, 2)
select p_brand, round(max(case when l_linestatus = 'F' then s end) - max(case when l_linestatus = 'O' then s end), 6) difference from g where n >= 20 group by 1 having count(*) = 2""")
def motif_signal(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy("p_brand", "l_linestatus").agg((F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    sides = [F.max(F.when(F.col("l_linestatus") == x, F.col("s"))) for x in "FO"]
    return g.groupBy("p_brand").agg(F.round(sides[0] - sides[1], 6).alias("difference"), F.count(F.lit(1)).alias("k")).where("k = 2").drop("k")


@query(f"""with {SCORED}, k as (select *, case when y = 1 and t = 1 then 'both' when y = 1 then 'first only' when t = 1 then 'second only' else 'neither' end kind from d)
select lang, kind, count(*) n, round(avg(s), 6) mean_score from k group by 1, 2""")
def discordance_table(spark, d):
    kind = F.when((F.col("y") == 1) & (F.col("t") == 1), "both").when(F.col("y") == 1, "first only").when(F.col("t") == 1, "second only").otherwise("neither")
    return scored(spark, d).groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_score"))


_STRATA = "select 'all' family, 'all' stratum, a, b, y from ab union all select 'lang', lang, a, b, y from ab union all select 'source', source, a, b, y from ab"


@query(f"""with {ARMS}, x as ({_STRATA}), l as (select family, stratum, 'a' arm, a s, y from x union all select family, stratum, 'b', b, y from x), m as ({_ranked("l", "family, stratum, arm")}),
n as (select family, stratum, count(*) n, sum(y) k from x group by 1, 2), g as (select family, stratum, max(case when arm = 'a' then ap end) - max(case when arm = 'b' then ap end) gain from m group by 1, 2)
select family, stratum, n, case when n >= 50 and k >= 20 then round(gain, 6) end gain from n join g using (family, stratum)""")
def gain_by_strata(spark, d):
    strata = F.array(*[F.struct(F.lit(f).alias("family"), c.alias("stratum")) for f, c in (("all", F.lit("all")), ("lang", F.col("lang")), ("source", F.col("source")))])
    x = two_arms(spark, d).select("a", "b", "y", F.inline(strata))
    keys = ["family", "stratum"]
    a, b = (M.average_precision(x, keys, arm, "y").withColumnRenamed("ap", f"ap_{arm}") for arm in "ab")
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    gain = F.when((F.col("n") >= 50) & (F.col("k") >= 20), F.round(F.col("ap_a") - F.col("ap_b"), 6))
    return n.join(a, keys).join(b, keys).select(*keys, "n", gain.alias("gain"))


@query(f"""with x as (select l_partkey, draw, depth, l_quantity q, row_number() over (partition by l_partkey, draw, depth order by {_h("env", "draw", "depth", "l_partkey", "l_orderkey", "l_linenumber")}, l_orderkey, l_linenumber, l_quantity) r
from lineitem, (values (1), (2), (3), (4), (5)) a(draw), (values (1), (3), (10)) b(depth)), m as (select l_partkey, depth, draw, avg(q) s from x where r <= depth group by 1, 2, 3)
select l_partkey, depth, round(quantile_cont(s, 0.5), 6) median, round(quantile_cont(s, 0.1), 6) p10, round(quantile_cont(s, 0.9), 6) p90 from m group by 1, 2""")
def thinning_envelope(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    m = E.thinning_envelope(li, ["l_partkey"], ["l_orderkey", "l_linenumber"], "l_quantity", [1, 3, 10], 5, "env")
    return rounded(m, "median", "p10", "p90")


@query(f"""with {SCORED}, b as (select *, source in (select source from documents where doc_id % 10 = 0) seen, lang = 'en' known from d)
select seen, known, not seen and source <> '' new_source, count(*) n from b group by 1, 2, 3""")
def slice_masks(spark, d):
    docs = table(spark, d, "documents")
    seen = docs.where("doc_id % 10 = 0").select("source", F.lit(True).alias("_seen")).distinct()
    b = scored(spark, d).join(seen, "source", "left").withColumn("seen", F.coalesce("_seen", F.lit(False)))
    return b.groupBy("seen", (F.col("lang") == "en").alias("known"), (~F.col("seen") & (F.col("source") != "")).alias("new_source")).agg(F.count(F.lit(1)).alias("n"))


@query("""with f as (select o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)) place from orders group by 1, 2)
select o_custkey, string_agg(o_orderpriority, ',' order by place) priorities, count(*) n from f group by 1""")
def ordered_distinct(spark, d):
    f = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("at"))
    once = F.transform(F.array_sort(F.collect_list(F.struct("at", "o_orderpriority"))), lambda x: x["o_orderpriority"])  # as many as there are priorities
    return f.groupBy("o_custkey").agg(F.array_join(once, ",").alias("priorities"), F.count(F.lit(1)).alias("n"))


@query(f"""with {SCORED}, f as (select case when n_chars < 1000 then 0 when n_chars < 3000 then 50 else 100 end fraction, s from d), x as (select 0 g, s, case when fraction = 100 then 1 else 0 end y from f where fraction <> 50), m as ({_ranked("x", "g")})
select fraction, count(*) n, round(avg(s), 6) mean, (select round(auc, 6) from m) auc from f group by 1""")
def external_block(spark, d):
    f = scored(spark, d).withColumn("fraction", F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 3000, 50).otherwise(100))
    ends = f.where("fraction != 50").withColumn("y", (F.col("fraction") == 100).cast("int")).withColumn("g", F.lit(0))
    auc = M.roc_auc(ends, ["g"], "s", "y").select(F.round("auc", 6).alias("auc"))
    return f.groupBy("fraction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean")).join(F.broadcast(auc), how="cross")
