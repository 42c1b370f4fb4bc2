"""Steps that move their rows once: the plans, and results on odd rows."""

from strandline.operators import evaluation as E
from strandline.operators import joins as J
from strandline.sources import sinks as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lift_over_is_one_join_by_transcript(spark):
    exons = spark.createDataFrame([("a", "1", "+", 100, 109), ("a", "1", "+", 200, 204), ("b", "2", "-", 100, 109), ("b", "2", "-", 200, 204), (None, "3", "+", 5, 6)], "tx string, chrom string, strand string, start long, end long")
    points = spark.createDataFrame([("a", 0), ("a", 9), ("a", 10), ("a", 15), ("b", 0), ("b", 5), ("c", 0), (None, 1), ("a", None)], "tx string, pos int")
    out = J.lift_over(points, exons, "tx", "pos")
    assert "rangepartitioning" not in plan(out) and "Window" not in plan(out) and "cells-" not in plan(out)
    got = {(r.tx, r.pos): r.gpos for r in out.collect()}
    assert got == {("a", 0): 100, ("a", 9): 109, ("a", 10): 200, ("a", 15): None, ("b", 0): 204, ("b", 5): 109, ("c", 0): None, (None, 1): 6, ("a", None): None}
    held = J.on_exons(points, exons, "tx", "pos").where("_exon is not null").select("tx", "pos", "_exon.k").collect()
    assert {(r.tx, r.pos): r.k for r in held} == {("a", 0): 1, ("a", 9): 1, ("a", 10): 2, ("b", 0): 1, ("b", 5): 2, (None, 1): 1}


def test_the_envelope_moves_its_readings_once(spark):
    reads = spark.createDataFrame([("s", i, float(i)) for i in range(6)] + [("t", 0, None), ("u", 0, 2.0), ("u", 1, None)], "site string, item int, v double")
    out = E.thinning_envelope(reads, ["site"], ["item"], "v", [1, 10], 3, "x")
    assert plan(out).count("Exchange") == 1
    got = {(r.site, r.depth): (r.median, r.p10, r.p90) for r in out.collect()}
    assert got["s", 10] == (2.5, 2.5, 2.5) and got["t", 1] == (None, None, None) and got["u", 10] == (2.0, 2.0, 2.0)
    assert got["s", 1][1] <= got["s", 1][0] <= got["s", 1][2] and len(got) == 6


def test_resampled_rows_are_summed_by_score_alone(spark):
    rows = spark.createDataFrame([(f"g{i}", (i % 3) / 2, i % 2) for i in range(200)], "gene string, s double, y int")
    sums = []
    kept, E.running_sums = E.running_sums, lambda t, *a, **k: sums.append(t) or kept(t, *a, **k)
    try:
        boot = E.bootstrap_ap(rows, ["gene"], ["s"], "y", 5, "seed").collect()
    finally:
        E.running_sums = kept
    assert plan(sums[0]).count("Exchange") == 1 and len(boot) == 5 and all(0 < r.ap <= 1 for r in boot)


def test_gene_records_move_their_tables_once(spark):
    sites = spark.createDataFrame([("A", "g", 1, "K", "cds", "t", 0.5, 3), ("B", "g", 1, "K", "cds", "u", 0.25, 2), ("A", "h", 2, "K", None, "t", None, 1)], "line string, gene string, pos int, kmer string, region string, tx string, rank double, n_reads long")
    batches = spark.createDataFrame([("A", "x", "g", 1, 0.5), ("A", "y", "g", 1, None), ("A", "x", "g", 9, 0.9), ("B", "x", "h", 2, 0.1)], "line string, batch string, gene string, pos int, rank double")
    out = K.gene_records(sites, batches, 1)
    assert plan(out).count("Exchange hashpartitioning") <= 2
    got = {r.gene: r.asDict(True) for r in out.collect()}
    assert got["g"]["sites"] == [{"pos": 1, "kmer": "K", "region": "cds", "tx": ["t", "u"]}] and len(got) == 2
    a = {"pos": 1, "r": 5000, "n": 3, "batches": [{"batch": "x", "r": 5000}, {"batch": "y", "r": -1}], "holds": 0}
    assert got["g"]["lines"] == [{"line": "A", "sites": [a]}, {"line": "B", "sites": [{"pos": 1, "r": 2500, "n": 2, "batches": [], "holds": 0}]}]
    assert got["h"]["lines"] == [{"line": "A", "sites": [{"pos": 2, "r": -1, "n": 1, "batches": [], "holds": 0}]}]
