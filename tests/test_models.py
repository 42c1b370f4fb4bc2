"""Model wrappers: held-out order, balance, calibration, nulls, and fixtures worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import metrics as M
from strandline.operators import models as X
from strandline.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select("id", (F.col("id") % 50).alias("g"), ((F.xxhash64("id") % 1000) / 1000.0).alias("a"), ((F.xxhash64("id", F.lit(1)) % 1000) / 1000.0).alias("b"))
    return df.withColumn("y", (F.col("a") + 0.3 * F.col("b") > 0.4).cast("int"))


def auc(df):
    return M.roc_auc(df.withColumn("_k", F.lit(1)), ["_k"], "score", "y").first().auc


@pytest.mark.parametrize("kind", ["logistic", "boosted", "mlp"])
def test_cross_fit_finds_the_rule(rows, kind):
    out = X.cross_fit(rows, ["a", "b"], "y", "g", kind=kind)
    assert out.count() == 600 and auc(out) > 0.95
    assert out.groupBy("g").agg(F.count_distinct("_fold").alias("n")).where("n > 1").count() == 0


def test_unknown_kind_and_label(rows):
    with pytest.raises(KeyError):
        X.fit(rows, ["a"], "y", "forest")
    with pytest.raises(ValueError):
        X.fit(rows.withColumn("y", F.lit(2)), ["a"], "y")


def test_null_features_get_no_score_and_columns_stay(rows):
    df = rows.withColumn("a", F.when(F.col("id") > 5, F.col("a"))).withColumn("score", F.lit(9.0))
    out = X.score(df, X.fit(df, ["a", "b"], "y"), ["a", "b"])
    assert out.columns == df.columns
    assert out.where("score is null").count() == 6 and out.where("a is null").count() == 6


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "y int")
    got = {r.y: r.w for r in df.withColumn("w", X.balanced_weight(df, "y")).where("y is not null").distinct().collect()}
    assert got == pytest.approx({1: 2.0, 0: 2 / 3})


def test_calibration_keeps_order_and_refuses_reversal(rows):
    out = X.calibrated(rows, ["a", "b"], "y", "g", kind="logistic")
    assert auc(out) > 0.95
    base = out.agg(F.avg("y"), F.avg("score")).first()
    assert base[0] == pytest.approx(base[1], abs=0.05)
    with pytest.raises(ValueError):
        X.platt(out.withColumn("score", 1 - F.col("score")), "score", "y")


def test_cross_source_weights_sum_to_one_per_key(spark):
    a = spark.createDataFrame([(1, 0.1, 0), (2, 0.2, 1)], "k int, x double, y int")
    b = spark.createDataFrame([(2, 0.3, 0), (3, 0.4, 1)], "k int, x double, y int")
    for both, n in ((False, 4), (True, 6)):
        out = X.cross_source_rows(a, b, "k", "y", both)
        assert out.count() == n
        assert {r.k: r.w for r in out.groupBy("k").agg(F.sum("weight").alias("w")).collect()} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_hit_expectation(spark):
    df = spark.createDataFrame([(10, 3), (5, 0), (6, 5), (3, 0)], "n int, p int").withColumn("e", M.hit_expectation(F.col("n"), F.col("p"), 2))
    got = [r.e for r in df.collect()]
    assert got == pytest.approx([1 - math.comb(7, 2) / math.comb(10, 2), 0.0, 1.0, 0.0])


def test_interpolation_is_linear_and_flat_beyond_the_ends(spark):
    df = spark.createDataFrame([("a", 0.25, 1.0), ("a", 0.75, 3.0), ("a", None, 9.0)], "g string, x double, y double")
    got = [r.y for r in M.interpolate(df, ["g"], "x", "y", 5).orderBy("step").collect()]
    assert got == pytest.approx([1.0, 1.0, 2.0, 3.0, 3.0])


def test_fits_read_measures_not_texts(spark):
    made = catalog.thirds(catalog.traits(spark, "/root/testdata/sf0.001"))
    assert made.count() > 0 and not any("documents.parquet" in f for f in made.inputFiles())
    assert "regexp_count" not in made._jdf.queryExecution().optimizedPlan().toString()
