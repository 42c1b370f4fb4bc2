"""Readers and writers on small files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import joins as J
from strandline.sources import readers as R
from strandline.sources import sinks as K
from strandline.sources import sites as S


def line(t, p, k, n, first=0.0):
    return json.dumps({t: {str(p): {k: [[first + i] * 9 for i in range(n)]}}})


@pytest.fixture
def samples(tmp_path):
    one = [line("ENST1.2", 10, "AAAAAAA", 2), "", line("ENST2.1", 5, "CCCCCCC", 1), line("ENST1.2", 30, "GGGGGGG", 1)]
    two = [line("ENST1.3", 10, "AAAAAAA", 1, 50.0), "{broken", line("ENST9", 1, "TTTTTTT", 3)]
    for name, lines in (("one", one), ("two", two)):
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "one.json.gz", "wt") as f:
        f.write("\n".join(one))
    return tmp_path


def test_scans(spark, samples):
    assert S.read_sites(spark, str(samples / "one.json.gz"), 2).count() == 3
    assert R.first_lines(spark, str(samples / "one.json"), 2).count() == 1
    wanted = spark.createDataFrame([("ENST1", 10), ("ENST1", 99)], "transcript_id string, transcript_position int")
    rows = R.pool_samples(spark, [str(samples / "one.json"), str(samples / "two.json")], wanted).collect()
    assert [(r.transcript_id, r.transcript_position, r.kmer, r.n_reads, r.reads[2][0]) for r in rows] == [("ENST1", 10, "AAAAAAA", 3, 50.0)]
    every = spark.createDataFrame([('{"a": {"1": {"AAAAAAA": [[1]], "CCCCCCC": []}, "2": {"GGGGGGG": [[1], [2]]}}}',)], "value string")
    assert sorted(tuple(r) for r in R.all_site_counts(every).collect()) == [("a", 1, "AAAAAAA", 1), ("a", 1, "CCCCCCC", 0), ("a", 2, "GGGGGGG", 2)]


def test_tables(spark, tmp_path):
    (tmp_path / "info.csv").write_text("gene_id,transcript_id,transcript_position,label\n,T1,3,0\nNA,T2,4,1\n")
    assert sorted((r.gene_id, r.label) for r in R.read_info(spark, str(tmp_path / "info.csv")).collect()) == [("", 0), ("NA", 1)]
    for fold in (0, 1):
        (tmp_path / f"fold_{fold}").mkdir()
        (tmp_path / f"fold_{fold}" / "p.csv").write_text("transcript_id,transcript_position,probability\nT1,3,0.5\nT1,3,0.5\nT2,x,0.1\nT3,7,NaN\n")
    got = R.read_predictions(spark, [str(tmp_path / f"fold_{i}" / "p.csv") for i in (0, 1)]).collect()
    assert sorted((r.transcript_id, r.probability, r.fold) for r in got) == [("T1", 0.5, 0), ("T1", 0.5, 1)]
    gtf = ['#x', 'chr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "G1.3"; gene_name "RPL3"; gene_type "coding";', 'chr1\ts\texon\t1\t9\t.\t+\t.\tgene_id "G1.3"; transcript_id "T1.1";', 'chr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "G0.3"; gene_name "RPL3"; gene_biotype "rna";']
    (tmp_path / "a.gtf").write_text("\n".join(gtf))
    genes = R.read_genes(spark, str(tmp_path / "a.gtf"))
    assert sorted(tuple(r) for r in genes.collect()) == [("G0", "RPL3", "rna"), ("G1", "RPL3", "coding")]
    assert [r.transcript_id for r in S.read_annotation(spark, str(tmp_path / "a.gtf"), ["exon"]).collect()] == ["T1.1"]
    (tmp_path / "fold_0" / "q.csv").write_text("transcript_id,transcript_position,probability\nT1,3,0.7\n")
    both = R.read_predictions(spark, [str(tmp_path / "fold_0" / f"{n}.csv") for n in "pq"]).collect()
    assert [(r.transcript_id, r.probability) for r in both] == [("T1", None)]  # two that differ are none
    (tmp_path / "sets.gmt").write_text("S1\thttp://x\tRPL3\tNONE\n")
    assert [tuple(r) for r in R.read_gene_sets(spark, str(tmp_path / "sets.gmt"), genes).collect()] == [("S1", "G0")]
    assert genes.where(R.ribosomal(F.col("gene_name"))).count() == 2
    (tmp_path / "t.bed").write_text("chrM\t4\t5\tx\t0.5\t+\nchr2\t8\t9\ty\t0.1\t-\n")
    assert sorted(tuple(r) for r in R.read_truth_bed(spark, str(tmp_path / "t.bed")).collect()) == [("2", 9, "-", 0.1), ("MT", 5, "+", 0.5)]
    (tmp_path / "t.csv").write_text("chrom,pos,strand,ratio\nchrM,5,+,0.5\n")
    assert [r.chrom for r in S.read_truth(spark, str(tmp_path / "t.csv")).collect()] == ["MT"]
    (tmp_path / "n.csv").write_text("a,b,c\nT1.4,3,20\n")
    assert [tuple(r) for r in R.read_counts(spark, str(tmp_path / "n.csv")).collect()] == [("T1", 3, 20)]
    (tmp_path / "f.fa").write_text(">T1.1 x\nACG\nT\n>T2 y\nGG\n")
    assert sorted(tuple(r) for r in S.read_fasta(spark, str(tmp_path / "f.fa")).collect()) == [("T1", "ACGT"), ("T2", "GG")]
    (tmp_path / "l.csv").write_text("gene_id,transcript_id,transcript_position,label\ng,t,1,0\n")
    assert S.read_labels(spark, str(tmp_path / "l.csv")).count() == 1


def test_checked_scores(spark, tmp_path):
    good = "transcript_id,kmer,score,rank\nT1,AAAAAAA,0.5,0.1\nT2,CCCCCCC,1e3,1\n"
    bad = {"7 bases": "T3,AAX,0.1,0.1", "finite": "T3,AAAAAAA,x,0.1", "within": "T3,AAAAAAA,0.1,2", "twice": "T1,AAAAAAA,0.1,0.1"}
    (tmp_path / "good.csv").write_text(good)
    assert R.read_checked_scores(spark, str(tmp_path / "good.csv"), ["transcript_id"]).count() == 2
    for said, row in bad.items():
        (tmp_path / "bad.csv").write_text(good + row + "\n")
        with pytest.raises(Exception, match=said):
            R.read_checked_scores(spark, str(tmp_path / "bad.csv"), ["transcript_id"]).collect()
    with pytest.raises(ValueError, match="rank"):
        (tmp_path / "short.csv").write_text("transcript_id,kmer,score\n")
        R.read_checked_scores(spark, str(tmp_path / "short.csv"), ["transcript_id"])


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"g{i % 20}", "é" * (i % 7) + str(i)) for i in range(200)], "i long, g string, line string").repartition(5)
    K.write_indexed(rows, str(tmp_path / "x"), "i", "line", ["g"])
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "x" / "data").glob("part-*")))
    info = spark.read.csv(str(tmp_path / "x" / "info"), header=True, inferSchema=True).orderBy("start").collect()
    assert [data[r.start : r.end].decode() for r in info] == [f"{'é' * (i % 7)}{i}\n" for i in range(200)]
    folds = spark.createDataFrame([(f"g{j}", j % 3) for j in range(20)], "g string, fold int")
    K.write_folds(rows, folds, str(tmp_path / "folds"), "g")
    back = spark.read.csv(str(tmp_path / "folds"), header=True).select("g", "fold", "part").distinct().join(folds.withColumnRenamed("fold", "own"), "g")
    assert back.where("(part = 'test') != (fold = own)").count() == 0 and back.select("g", "fold").count() == back.select("g", "fold").distinct().count() == 60
    names = K.write_by_name(rows, str(tmp_path / "byname"), ["g"], ["i", "line"])
    assert names.count() == 20 and spark.read.json(str(tmp_path / "byname")).select("name").distinct().count() == 20
    scores = rows.select("g", "i", (F.col("i") / 7).alias("score"))
    assert K.write_scored_sample(scores, rows, str(tmp_path / "s"), ["g"], folds.where("g = 'g3'")) and not K.write_scored_sample(scores, rows, str(tmp_path / "s"), ["g"], folds)
    assert spark.read.parquet(str(tmp_path / "s" / "reads")).count() == 10 and "0.14286" in {r.score for r in spark.read.csv(str(tmp_path / "s" / "scores"), header=True).collect()}
    for name in ("a", "b"):
        K.write_sample(rows, str(tmp_path / name), 17, "i", "line")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "a")).collect()) == sorted(r.value for r in spark.read.text(str(tmp_path / "b")).collect())
    assert spark.read.text(str(tmp_path / "a")).count() == 17
    K.write_ranked(spark.createDataFrame([("ATT", 2, 'a"b'), ("GGG", 1, None)], "kmer string, n int, x string").repartition(2), str(tmp_path / "r"), ["n"])
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "r").glob("part-*")))
    assert whole == b'"kmer","n","x"\r\n"GGG","1",""\r\n"AUU","2","a""b"\r\n'
    K.write_scores(spark.createDataFrame([("t", 1, 0.5, "x")], "transcript_id string, transcript_position int, score double, more string"), str(tmp_path / "sub"))
    assert spark.read.csv(str(tmp_path / "sub"), header=True).columns == ["transcript_id", "transcript_position", "score"]
    K.write_sharded(rows.withColumn("shard", F.col("i") % 4), str(tmp_path / "sh"), "shard")
    assert R.read_shards(spark, str(tmp_path / "sh"), ["1"]).count() == 50


def test_lift_over(spark):
    exons = spark.createDataFrame([("p", "1", "+", 100, 109), ("p", "1", "+", 200, 204), ("m", "2", "-", 100, 109), ("m", "2", "-", 200, 204)], "t string, chrom string, strand string, start int, end int")
    points = spark.createDataFrame([("p", x) for x in (0, 9, 10, 14, 15)] + [("m", x) for x in (0, 4, 5, 14)] + [("q", 1)], "t string, pos int")
    got = {(r.t, r.pos): r.gpos for r in J.lift_over(points, exons, "t", "pos").collect()}
    assert got == {("p", 0): 100, ("p", 9): 109, ("p", 10): 200, ("p", 14): 204, ("p", 15): None, ("m", 0): 204, ("m", 4): 200, ("m", 5): 109, ("m", 14): 100, ("q", 1): None}


def test_transcript_names_are_no_field_names_to_the_parser(spark):
    def line(head, rest='"7": {"AAGACCA": [[1,2,3,4,5,6,7,8,9]]}'):
        return f"{head}: {{{rest}}}}}"

    heads = ['{"T1.1"', ' {  "T2" ', '{"T\\u0033"', '{"T\\"4"', "{'T5'", '\t{"T6"', '{""']
    lines = [line(h) for h in heads] + ["", '{"T8":{"9":{"A":[],"B":[[1]]}},"T9":{"1":{}}}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [(r.transcript_id, r.transcript_position, r.kmer, r.n_reads) for r in S.parse_sites(df).collect()]
    assert got == [(t, 7, "AAGACCA", 1) for t in ("T1.1", "T2", "T3", 'T"4', "T5", "T6", "")] + [("T8", 9, "A", 0)]
    for broken in (line('{"T1"')[:-1], line('{"T1'), '{"T1":', "T1"):
        with pytest.raises(Exception, match="9 values"):
            S.parse_sites(spark.createDataFrame([(broken,)], "value string")).collect()
    assert 'concat({""' in S.parse_sites(df)._jdf.queryExecution().optimizedPlan().toString()


def test_scanned_lines_are_made_once(spark):
    from strandline.plans import catalog

    told = catalog.queries()["scan_nested_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("StructsToJson") == 1
