"""Event-time windows and sessions of a stream of files against the same over the whole table."""

from pyspark.sql import functions as F

from strandline.functions import scalars as C
from strandline.operators import evaluation as E
from strandline.streaming import events as S

DIR = "/root/testdata/sf0.001/events.parquet"


def collected(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_windows_and_sessions(spark, tmp_path):
    e = spark.read.parquet(DIR).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.event_stream(spark, f"{tmp_path}/in", e.schema)
    got = collected(spark, S.windowed_counts(stream, late="3650 days", width="6 hours"), "windows")
    want = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")
    assert sorted(map(tuple, got.select("started", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))
    got = collected(spark, S.session_counts(stream, late="3650 days"), "sessions")
    want = e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect())


def test_draws_and_rules(spark):
    w = spark.range(4000).select(C.poisson_weight(C.keyed("s", "id")).alias("w"), C.below(C.keyed("s", "id"), 0.25).cast("int").alias("b"))
    r = w.agg(F.avg("w").alias("w"), F.avg("b").alias("b")).first()
    assert abs(r.w - 1) < 0.06 and abs(r.b - 0.25) < 0.03
    v = spark.createDataFrame([(0.01, 0.95), (0.01, 0.05), (0.01, 0.5), (0.2, 1.0)], "p double, wins double").select(C.verdict(F.col("p"), F.col("wins")).alias("v"))
    assert [x.v for x in v.collect()] == ["better", "worse", "no difference", "no difference"]
    obs = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 1.0), ("a", 2.0, 1.5), ("b", 1.0, None)], "g string, x double, y double")
    p = E.paired(obs, ["g"], "x", "y", 5).collect()
    assert len(p) == 1 and abs(p[0]["mean"] - 2 / 3) < 1e-9 and abs(p[0]["t_naive"] - 4) < 1e-6 and abs(p[0]["t_corrected"] - 2 / 3 / (1 / 12 * (1 / 3 + 0.25)) ** 0.5) < 1e-6


def test_pooled_sites_equal_the_pooled_files(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "ts timestamp, sample int, transcript_id string, transcript_position int, kmer string, reads array<array<float>>"
    rows = [("2024-01-01 00:00:00", s, f"t{t}", 7 * t, "AAGACCA", [[float(10 * s + i)] * 9 for i in range(s + t)]) for s in (2, 0, 1) for t in range(1, 4)]
    for i in range(0, len(rows), 3):
        part = spark.createDataFrame([(None, *r[1:]) for r in rows[i : i + 3]], schema).withColumn("ts", F.lit(rows[0][0]).cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(None, 9, "z", 1, "AAGACCA", [[1.0] * 9])], schema).withColumn("ts", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.pooled_sites(stream, quiet="2 hours").writeStream.format("memory").queryName("pooled").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {(r.transcript_id, r.transcript_position): [x[0] for x in r.reads] for r in spark.table("pooled").collect()}
    assert got == {(f"t{t}", 7 * t): [float(10 * s + i) for s in range(3) for i in range(s + t)] for t in range(1, 4)}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
