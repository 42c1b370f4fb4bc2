"""Views, folds, neighbour graphs, grading and streams of cells against plain loops."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import evaluation as E
from strandline.operators import grading as G
from strandline.operators import joins as J
from strandline.operators import metrics as M
from strandline.operators import models as X
from strandline.operators import nearest as N
from strandline.operators import resample as R
from strandline.operators import windows as W
from strandline.sources import sinks as K

RNG = np.random.default_rng(17)


def test_seeds_and_folds_of_repetitions(spark):
    assert R.repetition_seeds(5, 9)[:3] == R.repetition_seeds(3, 9) and R.repetition_seeds(1, 9) == [9]
    with pytest.raises(ValueError, match="at least one"):
        R.repetition_seeds(0, 9)
    df = spark.createDataFrame([(f"g{i % 23}",) for i in range(200)] + [(None,)], "g string").repartition(3)
    few, many = ({(r.rep, r.g): r.fold for r in R.repeated_folds(df, "g", 4, n, 9).collect()} for n in (2, 4))
    assert few == {k: v for k, v in many.items() if k[0] < 2} and len(many) == 4 * 23
    for rep in range(4):
        sizes = [sum(1 for k, f in many.items() if k[0] == rep and f == fold) for fold in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert len({tuple(many[rep, f"g{i}"] for i in range(23)) for rep in range(4)}) == 4


def test_out_of_fold_rates_leave_the_fold_out(spark):
    rows = [(i, f"g{i % 9}", "a" if i % 9 == 3 else (None if i % 5 == 0 else "b"), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g string, k string, y int")
    folds = R.repeated_folds(df, "g", 3, 2, 4)
    fold = {(r.rep, r.g): r.fold for r in folds.collect()}
    for r in R.out_of_fold_rates(df, folds, "g", "k", "y").collect():
        other = [x for x in rows if fold[r.rep, x[1]] != r.fold]
        mine = [x[3] for x in other if x[2] == r.k] or [x[3] for x in other]
        assert r.score == pytest.approx(sum(mine) / len(mine))


def test_resampled_ratio(spark):
    sums = spark.createDataFrame([(c, k, float(c % 3 + 1), 2.0) for c in range(60) for k in "xy"], "c int, k string, a double, b double")
    for r in R.resampled_ratio(sums, "c", ["k"], "a", "b", 80, "s").collect():
        assert r.point == pytest.approx(1.0) and 0.8 < r.lo < 1.0 < r.hi < 1.2


def test_a_view_shows_each_other_site_with_its_chance(spark):
    sites = spark.createDataFrame([(g, p) for g in range(30) for p in range(60)], "g int, p int")
    for share in (0.25, 0.3):
        views = E.circular_views(sites, ["g"], "p", share, "s")
        seen = views.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("view", "g")) - 1).where("home")
        got = seen.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("g", "p").alias("sites"), F.avg("n").alias("n")).first()
        assert got.rows == got.sites == 1800 and abs(got.n / 59 - share) < 0.02
    ones = E.without_neighbours(sites, ["g"], "s")
    assert ones.count() == 30 and ones.columns == ["g", "p"]


def neighbours_by_loop(points, k):
    near = {}
    for i, (x, z, _) in points.items():
        near[i] = [j for _, j in sorted(((x - a) ** 2 + (z - b) ** 2, j) for j, (a, b, _) in points.items() if j != i)[:k]]
    edges = [(i, j) for i, j in itertools.combinations(sorted(points), 2) if j in near[i] and i in near[j]]
    root = {i: i for i in points}
    for i, j in edges:
        old = root[j]
        root = {n: root[i] if r == old else r for n, r in root.items()}
    p = sum(y for *_, y in points.values()) / len(points)
    chance = p * p + (1 - p) * (1 - p)
    share = sum(points[i][2] == points[j][2] for i, j in edges) / len(edges) if edges else None
    homophily = (share - chance) / (1 - chance) if edges and chance < 1 else None
    return len(edges), homophily, sum(all(i not in e for e in edges) for i in points) / len(points), len(set(root.values()))


def test_mutual_neighbours(spark):
    groups = {g: {int(i): (float(RNG.integers(0, 9)), float(RNG.integers(0, 9)), int(RNG.integers(0, 2))) for i in range(n)} for g, n in (("a", 12), ("b", 30), ("c", 2), (None, 7))}
    groups["d"] = {i: (float(i), 0.0, 1) for i in range(6)}
    rows = [(g, i, *v) for g, points in groups.items() for i, v in points.items()]
    lists = N.neighbour_lists(spark.createDataFrame(rows, "g string, i int, x double, z double, y int"), ["g"], "i", ["x", "z"], "y", 5)
    got = {(r.g, r.k): (r.edges, r.homophily, r.isolated, r.components) for r in N.mutual_statistics(lists, ["g"], [1, 3, 5]).collect()}
    want = {(g, k): neighbours_by_loop(points, k) for g, points in groups.items() for k in (1, 3, 5) if k < len(points)}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values), key


def test_neighbours_of_groups_are_found_in_blocks(spark, monkeypatch):
    rows = [(g, i, float(RNG.integers(0, 5)), float(RNG.integers(0, 5)), i % 2) for g, n in (("a", 1), ("b", 25), (None, 8), ("c", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, x double, z double, y int").repartition(3)

    def lists():
        made = N.neighbour_lists(df, ["g"], "i", ["x", "z"], "y", 4)
        assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()
        return {(r.g, r.item): (r.n, r.y, [(o.d, o.i, o.y) for o in r.near]) for r in made.collect()}

    want = {}
    for g, i, x, z, y in rows:
        others = [((x - a) ** 2 + (z - b) ** 2, j, v) for h, j, a, b, v in rows if h == g and j != i]
        want[g, i] = (len(others) + 1, y, sorted(others)[:4])
    assert lists() == want
    monkeypatch.setattr(N, "PAIRS", 10)
    assert lists() == want


def test_grades(spark):
    rows = [(g, round(float(s), 1), int(k), int(y)) for g in ("x", None) for k, (s, y) in enumerate(zip(RNG.random(90), RNG.random(90) < 0.4, strict=True))] + [("few", 0.5, 1, 1)]
    df = spark.createDataFrame(rows, "g string, s double, k int, y int")
    recall = spark.createDataFrame([(0.6,)], "r double")
    got = {r.g: r for r in G.grade(df, ["g"], "s", ["k"], "y", recall).collect()}
    assert set(got) == {"x", None}
    for g, r in got.items():
        ranked = [y for _, _, y in sorted((-s, k, y) for h, s, k, y in rows if h == g)]
        cut = next(i for i in range(len(ranked)) if sum(ranked[: i + 1]) >= 0.6 * sum(ranked) - 1e-9) + 1
        assert (r.n, r.positives, r.precision) == (90, sum(ranked), pytest.approx(sum(ranked[:cut]) / cut))
        assert r.precision_top == ranked[0] and r.lift == pytest.approx(r.ap / (sum(ranked) / 90))


def test_truth_is_moved_by_its_best_shift(spark):
    exons = spark.createDataFrame([("t1", "1", "+", 100, 199), ("t2", "1", "+", 100, 199), ("t3", "2", "-", 50, 59)], "tx string, chrom string, strand string, start int, end int")
    sites = spark.createDataFrame([("t1", 5, "g", 10, "a"), ("t2", 5, "g", 30, "b"), ("t1", 8, "g", 4, "c"), ("t3", 2, "h", 9, "d"), ("t3", 99, "h", 9, "e")], "tx string, pos int, gene string, n_reads int, id string")
    truth = spark.createDataFrame([("1", 106, "+", 0.7), ("1", 990, "+", 0.1)], "chrom string, gpos long, strand string, ratio double")
    got = {(r.gpos, r.id, r.label, r.ratio) for r in G.place_and_label(sites, exons, truth, ["tx"]).collect()}
    assert got == {(105, "b", 1, 0.7), (108, "c", 0, None)}


def test_points_meet_the_last_start_across_cells(spark):
    starts = [(g, float(10 * i), float(10 * i + 6), i) for g in ("hot", None) for i in range(400)]
    points = [(g, float(p)) for g in ("hot", None, "none") for p in RNG.integers(-5, 4100, 300)]
    got = J.place_in_intervals(spark.createDataFrame(points, "g string, p double").repartition(5), spark.createDataFrame(starts, "g string, t_start double, t_end double, i int"), ["g"], "p")
    for r in got.collect():
        held = [i for g, a, b, i in starts if g == r.g and a <= r.p < b]
        assert r.i == (held[0] if held else None)
    assert got.count() == len(points)
    marks = [(g, int(p)) for g in ("hot", None) for p in RNG.integers(0, 4000, 40)]
    near = J.nearest_event(spark.createDataFrame(points, "g string, p double").withColumn("p", F.col("p").cast("long")), spark.createDataFrame(marks, "g string, p long"), ["g"], "p").collect()
    assert len(near) == len(points)
    for r in near:
        gaps = [abs(r.p - p) for g, p in marks if g == r.g]
        assert r.event_gap == (min(gaps) if gaps else None)


def test_kernel_neighbours(spark):
    rows = [(g, int(p), float(v)) for g in ("a", None) for p, v in zip(sorted(RNG.choice(500, 25, replace=False)), RNG.random(25), strict=True)]
    for r in W.kernel_neighbours(spark.createDataFrame(rows, "g string, p int, v double"), ["g"], "p", "v", 40, 12.0, 15).collect():
        near = [(abs(p - r.p), v) for g, p, v in rows if g == r.g and p != r.p and abs(p - r.p) <= 40]
        weights = [math.exp(-d / 12) for d, _ in near]
        assert r.has_neighbour == bool(near)
        assert r.kernel_mean == pytest.approx(sum(w * v for w, (_, v) in zip(weights, near, strict=True)) / sum(weights) if near else 0.0, abs=1e-6)
        assert r.best == pytest.approx(max([v for d, v in near if d <= 15], default=0.0))


def test_partial_dependence(spark):
    rows = [(float(a), float(b)) for a, b in RNG.random((200, 2))] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    got = X.partial_dependence(df, ["a", "b"], "a", lambda x: x["a"] * 2 + x["b"], [0.0, 0.5, 1.0], raise_to="b").orderBy("step").collect()
    a, b = np.array([r[0] for r in rows[:-1]]), np.array([r[1] for r in rows[:-1]])
    for r, q in zip(got, (0.0, 0.5, 1.0), strict=True):
        v = np.quantile(a, q)
        assert (r.level, r.value, r["mean"]) == (q, pytest.approx(v), pytest.approx(float((2 * v + np.maximum(b, v)).mean())))


def test_average_linkage_of_a_hand_worked_table():
    # d and e join first (1), then a and b (2); c is 4 from a, b and 5 from d, e on average, so it joins a and b
    apart = {("a", "b"): 2, ("a", "c"): 4, ("b", "c"): 4, ("d", "e"): 1, ("a", "d"): 9, ("a", "e"): 9, ("b", "d"): 9, ("b", "e"): 9, ("c", "d"): 5, ("c", "e"): 5}
    assert X.average_linkage(apart) == ["d", "e", "c", "a", "b"]


def test_export_is_whole_or_an_error(spark, tmp_path):
    sites = spark.createDataFrame([("A", "g1", 5, "AAGACCA", "cds", "t2", 0.5, 9), ("A", "g1", 5, "AAGACCA", "utr3", "t1", 0.9, 3), ("A", "g1", 7, "AAGACCC", "cds", "t1", 0.1, 4), ("B", "g1", 7, "AAGACCC", "cds", "t1", 1.0, 2)],
                                  "line string, gene string, pos int, kmer string, region string, tx string, rank double, n_reads int")
    batches = spark.createDataFrame([("A", "x", "g1", 5, 0.4), ("A", "y", "g1", 5, None), ("A", "x", "g1", 7, 0.6)], "line string, batch string, gene string, pos int, rank double")
    record = json.loads(K.gene_records(sites, batches, first=1).toJSON().first())
    assert record["sites"] == [{"pos": 5, "kmer": "AAGACCA", "region": "cds", "tx": ["t1", "t2"]}, {"pos": 7, "kmer": "AAGACCC", "region": "cds", "tx": ["t1"]}]
    a, b = record["lines"]
    assert a == {"line": "A", "sites": [{"pos": 5, "r": 8999, "n": 12, "batches": [{"batch": "x", "r": 4000}, {"batch": "y", "r": -1}], "holds": 0}, {"pos": 7, "r": 1000, "n": 4, "batches": [{"batch": "x", "r": 5999}], "holds": 1}]} or a["sites"][0]["r"] == 8999
    assert b["sites"][0] == {"pos": 7, "r": 9999, "n": 2, "batches": [], "holds": 0}
    path = f"file://{tmp_path}/export"
    K.write_export(K.gene_records(sites, batches), path, 4)
    assert spark.read.json(f"{path}/genes").count() == 1 and [p.name for p in tmp_path.iterdir()] == ["export"]
    with pytest.raises(FileExistsError):
        K.write_export(K.gene_records(sites, batches), path, 4)


def test_t_chance_and_welch(spark):
    cases = [(t, n) for t in (0.0, 0.7, -1.96, 2.5, 6.0) for n in (1.0, 4.0, 9.5, 60.0)]
    for r in spark.createDataFrame(cases, "t double, n double").withColumn("p", M.t_chance(F.col("t"), F.col("n"))).collect():
        assert r.p == pytest.approx(M.t_two_sided(r.t, r.n), abs=1e-6)
    a = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4)] + [("y", 1.0)], "g string, v double")
    b = spark.createDataFrame([("x", float(v)) for v in (2, 4, 9)] + [("y", 1.0)], "g string, v double")
    (r,) = M.welch(a, b, ["g"], "v").collect()
    ea, eb = (5 / 3) / 4, 13 / 3
    assert (r.g, r.n_a, r.n_b, r.difference) == ("x", 4, 3, -2.5)
    assert r.t == pytest.approx(-2.5 / math.sqrt(ea + eb)) and r.df == pytest.approx((ea + eb) ** 2 / (ea**2 / 3 + eb**2 / 2))


def test_types_and_shapes(spark):
    rows = [("big" if i < 60 else "small", i % 2, f"c{i % 7}", float(i % 5), float(i % 2)) for i in range(64)]
    df = spark.createDataFrame(rows, "kind string, y int, cl string, a double, b double")
    got = {(r.family, r.type): r for r in E.by_type(df, {"all": F.lit("all"), "kind": F.col("kind")}, ["a", "b"], "y", "cl", 10).collect()}
    big = [(y, a) for k, y, _, a, _ in rows if k == "big"]
    auc = np.mean([(p > n) + (p == n) / 2 for y, p in big if y for z, n in big if not z])
    r = got["kind", "big"]
    assert (r.n, r.positives, r.clusters, r.note) == (60, 30, 7, "") and r.pair_accuracy == pytest.approx((auc + 1) / 2) and r.draw_sd == pytest.approx(abs(1 - auc) / 2)
    assert got["kind", "small"].note == "too few to judge" and got["kind", "small"].pair_accuracy is None and ("all", "all") in got
    shifts = spark.createDataFrame([("u", 0, 0.0), ("u", 1, 2.0), ("u", 2, -3.0), ("u", 3, 1.0), ("v", 0, 0.0), ("v", 3, 5.0), ("v", 1, None)], "column string, lev int, shift double")
    u, v = sorted(E.audit_shapes(shifts, "lev", 3).collect(), key=lambda r: r["column"])
    assert (u.peak, u.shift_at_peak, u.shift_at_last, u.hump) == (2, -3.0, 1.0, 2.0) and (v.monotonic, v.hump) == (1.0, 0.0)
    assert u.monotonic == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4, 1, 3])[0, 1])
