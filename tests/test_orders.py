"""Ranks, running sums and draws by number: null groups, hot values, and whole results by plain loops."""

from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.operators import evaluation as E
from strandline.operators import metrics as M
from strandline.operators import windows as W

ROWS = [(g, v) for g in ("a", None, "b") for v in (3.0, 1.0, 1.0, None, 2.0, 1.0)] + [("c", None), ("d", 5.0)] + [("hot", float(i % 3)) for i in range(900)]


def ranks_by_loop(rows):
    out = []
    for g, v in rows:
        mine = [(-1e9 if x is None else x) for h, x in rows if h == g]
        x = -1e9 if v is None else v
        below, ties = sum(y < x for y in mine), sum(y == x for y in mine)
        out.append((str(g), str(v), below + (ties + 1) / 2, len(mine)))
    return sorted(out)


def test_average_rank_keeps_null_groups_and_null_values(spark):
    df = spark.createDataFrame(ROWS, "g string, v double").repartition(5)
    got = [(str(r.g), str(r.v), r.r) for r in W.average_rank(df, ["g"], "v", "r").collect()]
    want = ranks_by_loop(ROWS)
    assert sorted(got) == [w[:3] for w in want]
    share = [(str(r.g), str(r.v), round(r.r, 9)) for r in W.average_rank(df, ["g"], "v", "r", share=True).collect()]
    assert sorted(share) == [(g, v, round(r / n, 9)) for g, v, r, n in want]
    whole = W.average_rank(df.select("v"), [], "v", "r").agg(F.sum("r")).first()[0]
    assert whole == len(ROWS) * (len(ROWS) + 1) / 2


def test_metrics_of_a_null_group(spark):
    rows = [(g, s, y) for g in ("a", None) for s, y in zip((0.9, 0.9, 0.8, 0.7, 0.7, 0.7, 0.2, 0.1), (1, 0, 1, 0, 0, 1, 0, 1), strict=True)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    for name, want in (("ap", 0.5416667), ("auc", 0.53125)):
        for table in (getattr(M, {"ap": "average_precision", "auc": "roc_auc"}[name])(df, ["g"], "s", "y"), M.ap_and_auc(df, ["g"], "s", "y")):
            assert {(r.g, round(r[name], 7)) for r in table.collect()} == {("a", want), (None, want)}
    both = M.ap_and_auc(df, ["g"], "s", "y").first()
    assert (both.n, both.positives) == (8, 4)


def test_running_sums_and_numbers_in_any_order(spark):
    rows = [(i % 4 if i % 4 else None, i % 7, i, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, a int, b int, v double").repartition(7)
    got = {r.b: (r.t, r.n) for r in W.numbered(W.running_sums(df, ["g"], [F.desc("a"), F.asc("b")], {"v": "t"}), ["g"], [F.desc("a"), F.asc("b")], "n").collect()}
    for g in (None, 1, 2, 3):
        total = 0.0
        for n, (_, _, b, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            total += v
            assert got[b] == (total, n)


def test_every_row_that_can_have_a_donor_has_one(spark):
    rows = [(i, "own" if i % 10 < 8 else f"o{i}", i % 2) for i in range(400)] + [(1000 + i, "alone", 9) for i in range(5)] + [(2000, None, None), (2001, "x", None)]
    df = spark.createDataFrame(rows, "item long, grp string, kind int").repartition(6)
    group, kind = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    got = {r.item: r.donor for r in E.donors(df, ["kind"], "grp", "item", "s").collect()}
    assert set(got) == set(group)
    used = defaultdict(int)
    for i, donor in got.items():
        if 1000 <= i < 1005:
            assert donor is None
        else:
            assert kind[donor] == kind[i] and group[donor] != group[i]
            used[donor] += 1
    assert len(used) > 60


def test_replacement_worlds_take_whole_rows(spark):
    rows = [(i, i // 4, i % 3, float(i * i % 31)) for i in range(120)]
    df = spark.createDataFrame(rows, "item int, grp int, kind int, v double")
    worlds = defaultdict(dict)
    for r in E.replacement_worlds(df, "item", "grp", "kind", "v", "w").collect():
        worlds[r.world][r.item] = (r.kind, r.v)
    assert all(len(w) == 120 for w in worlds.values()) and set(worlds) == {"value", "kind", "both", "baseline"}
    own, mean = {i: (k, v) for i, _, k, v in rows}, sum(r[3] for r in rows) / 120
    given = {(k, v) for _, _, k, v in rows}
    assert all(worlds["value"][i][0] == own[i][0] and worlds["value"][i] in given and worlds["kind"][i][1] == own[i][1] and worlds["both"][i] in given for i in own)
    for i, g, k, v in rows:
        group = [r[3] for r in rows if r[1] == g]
        assert worlds["baseline"][i] == (k, pytest.approx(v - sum(group) / len(group) + mean))


def test_too_few_common_scores_raise(spark):
    a = spark.createDataFrame([(i, 0.5) for i in range(2000)], "k int, s double")
    kept = E.keep_scored({"a": a, "b": a.where("k <> 7")}, ["k"])
    assert kept.count() == 1999
    with pytest.raises(PySparkException, match="too many rows unscored"):
        E.keep_scored({"a": a, "b": a.where("k > 100")}, ["k"]).collect()


def test_rank_shares_by_cells_equal_those_by_value(spark):
    rows = [(i, v) for i, v in enumerate([2.0] * 200 + [float(x) for x in range(60)] * 2 + [float("nan")] * 9 + [None] * 5 + [-0.0, 7.5])]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {r.k: r.r for r in W.average_rank(df, [], "v", "r", share=True).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part, n in ((df, 4), (df.where("v = 2"), 4), (df.where("k < 0"), 0)):
            out = W.rank_share(part, "v", "r", ["k"])
            got = {r.k: r.r for r in out.collect()}
            if part is df:
                assert got == want
            elif n:  # one value's rows are held by several cells
                assert set(got.values()) == {(len(got) + 1) / 2 / len(got)} and sum("ranked-cells" in f for f in out.inputFiles()) > 1
            else:
                assert got == {}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
