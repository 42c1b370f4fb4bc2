"""Queries that write files of the driver's tables and read them back: scans, writers, exports, scoring of a file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import models as X
from ..operators import site_graph as G
from ..operators.tables import shared_folder
from ..operators.windows import average_rank
from ..sources import readers as R
from ..sources import sinks as K
from ..sources import sites as S
from .catalog import query, rounded, table
from .evaluation import _h
from .studies import exons


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def site_lines(spark, d, flag: str | None = None):
    """JSON lines of sites: the readings of each order and part, nine numbers each."""
    li = table(spark, d, "lineitem")
    li = li if flag is None else li.where(F.col("l_returnflag") == flag)
    li = li.withColumn("pos", F.col("l_partkey") % 100)
    packed = li.groupBy("l_orderkey", "pos").agg(F.collect_list("l_quantity").alias("q"))  # one number a reading moves
    reads = F.transform("q", lambda q: F.array(*[(q + i).cast("float") for i in range(1, 10)]))
    inner = F.create_map(F.lit("AAGACCA"), reads)
    return packed.select(F.to_json(F.create_map(F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit(".1")), F.create_map(F.col("pos").cast("string"), inner))).alias("value"))


@query("""select 'T' || l_orderkey || '.1' transcript_id, cast(l_partkey % 100 as int) transcript_position, count(*) n_reads, round(sum(l_quantity + 5), 4) total from lineitem group by 1, 2""")
def sites_from_files(spark, d):
    path = folder(spark, "sites")
    site_lines(spark, d).write.text(path, compression="gzip")
    rows = S.explode_reads(S.read_sites(spark, path))
    return rows.groupBy("transcript_id", "transcript_position").agg(F.count(F.lit(1)).alias("n_reads"), F.round(F.sum(F.col("mean_0").cast("double") - 1), 4).alias("total"))


@query("""with x as (select 'T' || l_orderkey transcript_id, cast(l_partkey % 100 as int) transcript_position, l_quantity q from lineitem where l_returnflag in ('A', 'R') and l_orderkey % 3 = 0)
select transcript_id, transcript_position, count(*) n_reads, round(sum(q + 1), 4) total from x group by 1, 2""")
def pooled_samples(spark, d):
    paths = []
    for flag in "AR":
        paths.append(folder(spark, f"sample-{flag}"))
        site_lines(spark, d, flag).write.text(paths[-1])
    wanted = table(spark, d, "lineitem").where("l_orderkey % 3 = 0").select(F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("transcript_id"), (F.col("l_partkey") % 100).cast("int").alias("transcript_position")).distinct()
    pooled = R.pool_samples(spark, paths, wanted)
    total = F.aggregate("reads", F.lit(0.0), lambda acc, r: acc + r[0].cast("double"))
    return pooled.select("transcript_id", "transcript_position", F.col("n_reads").cast("long").alias("n_reads"), F.round(total, 4).alias("total"))


@query("""select o_orderkey k, o_custkey p, round(o_totalprice / 1e6, 4) score from orders""")
def written_scores(spark, d):
    path = folder(spark, "scores")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("transcript_id"), F.col("o_custkey").alias("transcript_position"), F.round(F.col("o_totalprice") / 1e6, 4).alias("score"))
    K.write_scores(o, path)
    back = spark.read.csv(path, header=True, schema="transcript_id long, transcript_position long, score double")
    return back.select(F.col("transcript_id").alias("k"), F.col("transcript_position").alias("p"), "score")


@query("""with o as (select o_orderkey, octet_length(encode(o_orderstatus || ',' || cast(o_orderkey as varchar))) + 1 n from orders)
select o_orderkey, cast(sum(n) over w as bigint) "end", cast(sum(n) over w - n as bigint) "start" from o window w as (order by o_orderkey rows unbounded preceding)""")
def written_index(spark, d):
    path = folder(spark, "indexed")
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("line"))
    K.write_indexed(o, path, "o_orderkey", "line", ["o_orderkey"])
    lines = spark.read.text(f"{path}/data").select(F.split("value", ",")[1].cast("long").alias("o_orderkey"), (F.octet_length("value") + 1).alias("_n"))
    info = spark.read.csv(f"{path}/info", header=True, schema='o_orderkey long, start long, end long')
    return info.join(lines, "o_orderkey").where(F.col("end") - F.col("start") == F.col("_n")).select("o_orderkey", "end", "start")


@query(f"""with f as (select distinct o_custkey g, o_custkey % 4 own from orders), n as (select unnest(range(0, 4)) fold),
p as (select fold, g, case when own = fold then 'test' when substr(md5(concat_ws(':', 'validation', cast(fold as varchar), cast(g as varchar))), 1, 8) < '{int(0.1 * (1 << 32)):08x}' then 'validation' else 'train' end part from f, n)
select cast(fold as integer) fold, part, count(*) n, round(sum(o_totalprice), 2) total from p join orders on o_custkey = g group by 1, 2""")
def written_folds(spark, d):
    path = folder(spark, "folds")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    folds = o.select("o_custkey").distinct().withColumn("fold", F.col("o_custkey") % 4)
    K.write_folds(o, folds, path, "o_custkey")
    back = spark.read.csv(path, header=True, inferSchema=False)
    return back.groupBy(F.col("fold").cast("int").alias("fold"), "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query("""select substr(sha256(cast(l_orderkey as varchar)), 1, 24) "name", l_orderkey, count(*) n, round(sum(l_quantity), 4) total from lineitem group by l_orderkey""")
def written_by_name(spark, d):
    path = folder(spark, "named")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), "l_linenumber", "l_quantity")
    # one file a key is meant for the few keys of a page: the records go by the first digits of their names
    named = K.write_by_name(li, path, ["l_orderkey"], ["l_linenumber", "l_quantity"], digits=1)
    back = spark.read.schema("l_orderkey string, sites array<struct<l_linenumber: int, l_quantity: double>>").json(path).select("l_orderkey", "sites")
    total = F.aggregate("sites", F.lit(0.0), lambda acc, x: acc + x["l_quantity"])
    return back.join(named, "l_orderkey").select("name", F.col("l_orderkey").cast("long").alias("l_orderkey"), F.size("sites").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("""select o_orderstatus || ',' || o_orderkey line from orders order by md5(concat_ws(':', 'sample', cast(o_orderkey as varchar))), o_orderkey limit 200""")
def written_sample(spark, d):
    path = folder(spark, "sample")
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("line"))
    K.write_sample(o, path, 200, "o_orderkey", "line")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""select p_partkey, replace(p_type, 'T', 'U') kmer, p_name || '"' "name", row_number() over (order by p_retailprice desc, p_partkey) place from part""")
def written_ranking(spark, d):
    path = folder(spark, "ranking")
    p = table(spark, d, "part").select((-F.col("p_retailprice")).alias("_o"), "p_partkey", F.col("p_type").alias("kmer"), F.concat("p_name", F.lit('"')).alias("name"))
    K.write_ranked(p, path, ["_o", "p_partkey"])
    # every line is a whole csv record: its place is its byte order, which the prices give again
    back = spark.read.csv(path, schema="o string, p_partkey string, kmer string, name string", escape='"').where("o <> '_o'")
    r = back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "kmer", "name", F.col("o").cast("double").alias("o"))
    return average_rank(r.withColumn("at", F.struct("o", "p_partkey")), [], "at", "place").select("p_partkey", "kmer", "name", F.col("place").cast("long").alias("place"))


_LIFT = """e as (select o_orderkey tx, o_orderpriority chrom, case when o_orderstatus = 'F' then '-' else '+' end strand, (o_custkey % 50) * 2000 + i * 500 st from orders, (values (1), (2), (3)) t(i)),
c as (select *, 100 * (row_number() over (partition by tx order by case strand when '-' then -st else st end) - 1) t0 from e)"""


@query(f"""with {_LIFT}, p as (select l_orderkey tx, l_linenumber, l_partkey % 400 pos from lineitem)
select p.tx, l_linenumber, pos, chrom, strand, case strand when '-' then st + 99 - (pos - t0) else st + pos - t0 end gpos from p left join c on c.tx = p.tx and pos >= t0 and pos < t0 + 100""")
def annotation_lift(spark, d):
    path = folder(spark, "annotation")
    e = exons(spark, d)
    line = F.concat_ws("\t", "chrom", F.lit("made"), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit('transcript_id "'), F.col("tx").cast("string"), F.lit('"; gene_id "G";')))
    e.select(line.alias("value")).write.text(path)
    held = S.read_annotation(spark, path, ["exon"]).select(F.col("transcript_id").cast("long").alias("tx"), "chrom", "strand", "start", "end")
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), "l_linenumber", (F.col("l_partkey") % 400).alias("pos"))
    return J.lift_over(points, held, "tx", "pos").select("tx", "l_linenumber", "pos", "chrom", "strand", "gpos")


@query("""with g as (select l_suppkey gene, l_partkey pos, l_returnflag line, l_linestatus batch, l_linenumber, l_quantity from lineitem),
s as (select line, gene, pos, cast(sum(l_quantity) as bigint) n, round(avg(l_quantity), 6) / 50 r from g group by 1, 2, 3),
b as (select line, batch, gene, pos, round(avg(l_quantity), 6) / 50 r from g group by 1, 2, 3, 4),
p as (select *, row_number() over (partition by line, batch, gene order by r desc, pos) place from b),
h as (select line, gene, pos, count(*) filter (where place <= 5) holds, count(*) batches from p group by 1, 2, 3)
select gene, line, pos, cast(round(r * 9999) as integer) r, n, cast(holds as integer) holds, cast(batches as integer) batches from s join h using (line, gene, pos)""")
def browser_export(spark, d):
    path = folder(spark, "export")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("line"), F.col("l_linestatus").alias("batch"), "l_quantity", F.col("l_orderkey").alias("tx"))
    rank = (F.round(F.avg("l_quantity"), 6) / 50).alias("rank")
    sites = li.groupBy("line", "gene", "pos").agg(rank, F.sum("l_quantity").cast("long").alias("n_reads"), F.min("tx").alias("tx")).withColumns({"kmer": F.lit("AAGACCA"), "region": F.lit("cds")})
    K.write_export(K.gene_records(sites, li.groupBy("line", "batch", "gene", "pos").agg(rank)), path, 16)
    back = spark.read.json(f"{path}/shards").select("gene", "shard", F.explode("lines").alias("l")).select("gene", "shard", "l.line", F.explode("l.sites").alias("s"))
    genes = spark.read.json(f"{path}/genes").select("gene", "shard", F.explode("lines").alias("i")).select("gene", "shard", "i.line", "i.best")
    best = back.groupBy("gene", "shard", "line").agg(F.max("s.r").alias("best")).join(genes, ["gene", "shard", "line", "best"])  # where index and shard agree
    rows = back.join(best.select("gene", "line"), ["gene", "line"])
    return rows.select("gene", "line", "s.pos", F.col("s.r").cast("int").alias("r"), "s.n", F.col("s.holds").cast("int").alias("holds"), F.size("s.batches").alias("batches"))


@query()
def score_file(spark, d):
    """A file of sites scored by three networks of the two kinds, written as a score file and read back."""
    path, out = folder(spark, "sites"), folder(spark, "scores")
    site_lines(spark, d).write.text(path)
    networks = [G.random_weights(1), G.random_weights(2, form="gate"), G.random_weights(3, form="scalar")]
    K.write_scores(G.score_sites(S.read_sites(spark, path), networks), out)
    return rounded(spark.read.csv(out, header=True, schema="transcript_id string, transcript_position int, score double"), "score")


@query()
def order_of_lines(spark, d):
    """Nations in the order in which average linkage joins them, by rank correlation of their customers' balances and segments."""
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    m = c.groupBy(F.col("c_nationkey").cast("string").alias("line"), "o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    ranked = average_rank(m, ["line"], "v", "r")
    a, b = (ranked.select("o_orderpriority", "o_orderstatus", F.col("line").alias(f"line_{x}"), F.col("r").alias(f"r_{x}")) for x in "ab")
    pairs = a.join(b, ["o_orderpriority", "o_orderstatus"]).where("line_a < line_b").groupBy("line_a", "line_b").agg(F.corr("r_a", "r_b").alias("rho"))
    apart = {(r.line_a, r.line_b): 1 - (r.rho or 0.0) for r in pairs.collect()}  # a row for each pair of 25 nations
    return spark.createDataFrame([(i, x) for i, x in enumerate(X.average_linkage(apart))], "place long, line string")
