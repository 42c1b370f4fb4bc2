"""Neighbours among all rows of a group: the query against its SQL over odd rows, and large groups against plain sorting."""

import duckdb
import numpy as np
import pytest

from strandline.operators import nearest as N
from strandline.plans import every as catalog

DIR = "/root/testdata/sf0.001"


def test_all_lines_of_a_supplier_are_compared(spark):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet")
    named = lines.selectExpr("l_suppkey g", "l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 i").distinct()
    sizes = {r.g: r["count"] for r in named.groupBy("g").count().collect()}
    got = catalog.queries()["mutual_neighbours"](spark, DIR).collect()
    assert {(r.g, r.k): r.n for r in got} == {(g, k): n for g, n in sizes.items() for k in (3, 5, 10)}
    assert all(n > 60 for n in sizes.values())  # once the depth of a group


def test_odd_lines_give_what_the_sql_gives(spark, tmp_path):
    con = duckdb.connect()
    path = tmp_path / "lineitem.parquet"
    con.execute(f"""copy (select * replace (case when l_orderkey % 11 = 0 then null else l_orderkey % 5 end as l_suppkey, case when l_partkey % 7 = 0 then null else l_quantity end as l_quantity,
        case when l_partkey % 5 = 0 then null else l_extendedprice end as l_extendedprice, case when l_partkey % 3 = 0 then null else l_returnflag end as l_returnflag) from '{DIR}/lineitem.parquet' where l_orderkey < 160
        union all by name select * replace (90 + l_orderkey % 3 as l_suppkey, 7 as l_quantity, 7 as l_extendedprice) from '{DIR}/lineitem.parquet' where l_orderkey < 20
        union all by name select * replace (95 as l_suppkey, null as l_quantity) from '{DIR}/lineitem.parquet' where l_orderkey = 3
        union all by name select * replace (96 as l_suppkey, case when l_orderkey < 24 then null else l_orderkey end as l_orderkey) from '{DIR}/lineitem.parquet' where l_orderkey between 22 and 30) to '{path}' (format parquet)""")
    con.execute(f"create view lineitem as select * from read_parquet('{path}')")
    df = catalog.queries()["mutual_neighbours"](spark, str(tmp_path))
    want = sorted(map(repr, (tuple(r) for r in con.execute(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()['mutual_neighbours']})").fetchall())))
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == want and len(want) > 20


def by_sorting(rows, most):
    """{i: (d, i, y) of the nearest others}, no number after all numbers, null last, ties by item."""
    at = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows], float)
    lost = np.array([None in r[1:3] for r in rows])
    items, out = np.array([r[0] for r in rows]), {}
    for k in range(len(rows)):
        with np.errstate(invalid="ignore"):
            d = ((at - at[k]) ** 2).sum(1)
        null = lost | lost[k]
        order = [j for j in np.lexsort((items, np.where(null, 0, d), null)) if items[j] != items[k]][:most]
        out[int(items[k])] = [(None if null[j] else float(d[j]), int(items[j]), rows[j][3]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["whole", "plain", "odd"])
def test_large_groups_are_searched_by_leaves(spark, kind):
    rng = np.random.default_rng(5)
    places = [(float(a), float(b)) for a, b in rng.integers(0, 40, (900, 2))] + [(3.0, 3.0)] * 400 + [(float(a), float(b)) for a, b in rng.normal(500, 1, (400, 2))] + [(1e5, -1e5)]
    if kind == "whole":
        places = [(float(a), float(b)) for a, b in rng.integers(10**9, 10**9 + 60, (1500, 2))] + [(10.0**9 + 2800, 10.0**9 + 2800), (None, 0.5)]
    places += [(None, 1.0), (2.0, None), (None, None), (float("nan"), 1.0), (float("inf"), 3.0)] * 12 if kind == "odd" else []
    order = rng.permutation(len(places))
    rows = [(int(i), *places[j], int(i) % 2) for i, j in enumerate(order)]
    assert len(rows) > N.LARGE > 60 and len({r[1:3] for r in rows}) > 1000
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in rows[:50]] + [("a", None, 1.0, 1.0, 1)], "g string, i int, x double, z double, y int").repartition(3)
    got = {(r.g, r.item): [(o.d, o.i, o.y) for o in r.near] for r in N.neighbour_lists(df, ["g"], "i", ["x", "z"], "y", 10).collect()}
    want = {(g, i): near for g, part in (("a", rows), ("b", rows[:50])) for i, near in by_sorting(part, 10).items()} | {("a", None): []}
    assert got.keys() == want.keys()
    for key, near in want.items():
        assert repr(got[key]) == repr(near), key


def test_equal_places_and_repeated_items_make_few_candidates():
    n = 5000
    code = np.repeat(np.arange(n // 2), 2)
    places = N._Places([np.repeat([1.0, 2.0], n // 2), np.ones(n)], code, np.zeros(n, bool), 3)
    rows = np.arange(n)
    assert len(places.firsts(rows, [v[rows] for v in places.x])) == 2 * 2 * 4
    me, other, d, _ = (np.concatenate(v) for v in zip(*places.pairs(np.array([0]), np.array([n])), strict=True))
    assert len(me) == 3 * n and not d.any() and (code[me] != code[other]).all()
    assert other[me == 9].tolist() == [0, 1, 2] and other[me == 0].tolist() == [2, 3, 4] and sorted(other[me == n - 1].tolist()) == [n // 2, n // 2 + 1, n // 2 + 2]


def test_graphs_made_in_one_pass_are_those_of_the_lists(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(i), float(a), None if i % 9 == 0 else float(b), None if i % 13 == 0 else int(i % 2)) for g, n in (("a", 40), (None, 12), ("b", 4), ("c", 1)) for i, (a, b) in enumerate(rng.integers(0, 6, (n, 2)))]
    df = spark.createDataFrame([*rows, ("b", None, 1.0, 1.0, 0)], "g string, i int, x double, z double, y int").repartition(3)
    two = N.mutual_statistics(N.neighbour_lists(df, ["g"], "i", ["x", "z"], "y", 5), ["g"], [2, 5])
    one = N.mutual_graphs(df, ["g"], "i", ["x", "z"], "y", [2, 5])
    assert one.schema == two.schema and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert {(r.g, r.k) for r in one.collect()} == {("a", 2), ("a", 5), (None, 2), (None, 5), ("b", 2)}
