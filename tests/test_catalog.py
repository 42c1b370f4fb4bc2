"""Every query with SQL, against DuckDB, over the smallest tables; and the hand-computed fixtures."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.operators import aggregates as A
from strandline.operators import joins as J
from strandline.operators import metrics as M
from strandline.operators import resample as R
from strandline.operators import windows as W
from strandline.plans import every as catalog
from strandline.sources import sites as S

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    res = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == sorted([plain(r[names.index(c)]) for c in cols] for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_leave_one_out(spark):
    df = spark.createDataFrame([("t", 100, 10.0), ("t", 140, 20.0), ("t", 180, 80.0), ("t", 900, 5.0)], "g string, p long, v double")
    rows = W.leave_one_out(df, ["g"], "p", "v", 50).orderBy("p").collect()
    assert [(r.n_neighbours, r.loo_mean, r.loo_max) for r in rows] == [(1, 20.0, 20.0), (2, 45.0, 80.0), (1, 20.0, 20.0), (0, 0.0, 0.0)]


def test_ap_and_auc_with_ties(spark):
    df = spark.createDataFrame(list(zip([0.9, 0.9, 0.8, 0.7, 0.7, 0.7, 0.2, 0.1], [1, 0, 1, 0, 0, 1, 0, 1], strict=True)), "s double, y int").withColumn("g", F.lit(1))
    assert M.average_precision(df, ["g"], "s", "y").first().ap == pytest.approx(0.5416667)
    assert M.roc_auc(df, ["g"], "s", "y").first().auc == pytest.approx(0.53125)


def test_quantiles_and_correlation(spark):
    df = spark.createDataFrame([(1, float(v), 2.0) for v in (1, 2, 4, 8, 16, 3)], "g int, v double, c double")
    q = A.quantiles(df, ["g"], "v").first()
    assert [q.q5, q.q25, q.q50, q.q75, q.q95] == pytest.approx([1.25, 2.25, 3.5, 7, 14])
    assert df.groupBy("g").agg(A.safe_corr("v", "c").alias("r")).first().r == 0.0


def test_interval_union_and_lift_over(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 6, 9), ("g", 20, 30), ("g", 25, 40)], "g string, a int, b int")
    assert sorted((r.a, r.b) for r in W.interval_union(df, ["g"], "a", "b").collect()) == [(1, 9), (20, 40)]
    exons = spark.createDataFrame([("t", 100, 109), ("t", 200, 209)], "t string, lo int, hi int").withColumn("len", F.expr("hi - lo + 1"))
    laid = W.running_intervals(exons, ["t"], [F.desc("lo")], "len")  # minus strand: the last exon first
    points = spark.createDataFrame([("t", 0), ("t", 10), ("t", 20)], "t string, pos int")
    placed = J.place_in_intervals(points, laid, ["t"], "pos").orderBy("pos").select((F.col("hi") - (F.col("pos") - F.col("t_start"))).alias("g")).collect()
    assert [r.g for r in placed] == [209, 109, None]


def test_site_json(spark):
    line = '{"ENST01": {"244": {"AAGACCA": [[1,2,3,4,5,6,7,8,9],[1,2,3,4,5,6,7,8,9]]}}}'
    row = S.parse_sites(spark.createDataFrame([(line,), ("",)], "value string")).collect()
    assert [(r.transcript_id, r.transcript_position, r.motif, r.n_reads) for r in row] == [("ENST01", 244, "AGACC", 2)]
    with pytest.raises(Exception, match="reading does not have"):
        S.parse_sites(spark.createDataFrame([('{"a": {"1": {"AAGACCA": [[1,2]]}}}',)], "value string")).collect()


def test_folds_keep_groups(spark):
    df = spark.range(300).select((F.col("id") % 60).alias("g"))
    folds = R.grouped_folds(df, "g", 5, 1).collect()
    assert len(folds) == 60 and sorted({sum(r.fold == k for r in folds) for k in range(5)}) == [12]
    again = R.grouped_folds(df.orderBy(F.desc("g")), "g", 5, 1).collect()
    assert sorted(folds) == sorted(again)


def test_t_distribution():
    assert M.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert M.t_two_sided(0.0, 4) == pytest.approx(1.0)


def test_streaming_moments(spark, tmp_path):
    from strandline.streaming.events import event_stream, running_moments

    batch = spark.read.parquet(f"{DIR}/events.parquet").select("user_id", "value")
    batch.write.parquet(str(tmp_path / "in"))
    q = running_moments(event_stream(spark, str(tmp_path / "in"), batch.schema)).writeStream.outputMode("update").format("memory").queryName("moments")
    run = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.user_id: round(r["mean"], 6) for r in spark.table("moments").collect()}
    assert got == {r.user_id: round(r.m, 6) for r in batch.groupBy("user_id").agg(F.avg("value").alias("m")).collect()}
