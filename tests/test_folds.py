"""The ordered fold, points in ranges and the as-of join against plain versions."""

import random
from datetime import datetime, timedelta

import pytest

from cairnlake import schemas
from cairnlake.operators import graph, intervals

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("topic", [None, "b"])
def test_fold_equals_one_row_after_the_other(spark, topic):
    dice = random.Random(3)
    some = lambda k: dice.sample("abcdef", dice.randint(0, k)) + (["a"] if dice.random() < 0.2 else [])
    row = lambda id_, i: (id_, dice.choice("xy"), f"n{i}", f"s{i}", [], some(3), some(2), dice.choice(["active", "deprecated"]), dice.choice([None, 0.1, 0.5, 0.5, 0.9]), T0 + timedelta(i), i)
    nodes = spark.createDataFrame([row(f"k{i}", i) for i in range(6)], schemas.NODES)
    rows = [(*row(f"k{dice.randint(0, 11)}", i), dice.choice([None, "k1", "k9"]), 100 - i) for i in range(60)]
    incoming = spark.createDataFrame(rows, schemas.NODES + ", target string, n int")
    one_by_one = nodes
    for r in sorted(rows, key=lambda r: r[-1]):
        one_by_one = spark.createDataFrame(graph.merge_once(one_by_one, spark.createDataFrame([r], incoming.schema), topic).collect(), one_by_one.schema)
        if r[-1] > 75:  # enough rows of some targets
            break
    few = incoming.where(f"n <= {r[-1]}")
    folded = graph.upsert_nodes(nodes, few, active_topic=topic, order_col="n")
    assert sorted(map(str, folded.collect())) == sorted(map(str, one_by_one.select(*folded.columns).collect()))


def test_the_plan_of_a_fold_does_not_grow_with_repeats(spark):
    node = lambda i: ("k", "x", "n", f"s{i}", [], ["a"], [], "active", 0.5, T0, 0, i)
    nodes = spark.createDataFrame([node(0)[:-1]], schemas.NODES)
    plans = [len(graph.upsert_nodes(nodes, spark.createDataFrame([node(i) for i in range(n)], schemas.NODES + ", n int"), order_col="n")._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 200)]
    assert abs(plans[0] - plans[1]) < 200


def test_points_in_ranges_equal_all_pairs(spark):
    dice = random.Random(4)
    ranges = [(dice.choice("abc"), s := dice.randint(-50, 5000), s + dice.choice([-3, 0, 1, 7, 40, 300])) for _ in range(60)] + [("d", 0, 2**31 - 1), ("e", None, 5), (None, 1, 5), ("a", 10, 10), ("a", 10, 10)]
    points = [(dice.choice("abcde"), dice.randint(-60, 5400), i) for i in range(1500)] + [("d", -1, -1), ("d", 2**31 - 1, -2), ("a", None, -3), (None, 2, -4), ("e", 3, -5), ("a", 10, -6), ("a", 10, -6)]
    p, r = spark.createDataFrame(points, "k string, line long, i int"), spark.createDataFrame(ranges, "k string, start_line long, end_line long")
    want = [x for x in points if any(x[0] == k and x[1] is not None and x[0] is not None and s is not None and s <= x[1] <= e for k, s, e in ranges)]
    assert sorted(map(str, map(tuple, intervals.points_in_ranges(p, r, key="k", point="line").collect()))) == sorted(map(str, want))


def test_one_hot_file_stays_linear(spark):
    """50,000 points and as many overlapping ranges of one file: the join has a few rows a point, not a few thousand."""
    n = 50_000
    points = spark.range(n).selectExpr("'f' AS k", "id * 7 % 100000 AS line")
    ranges = spark.range(n).selectExpr("'f' AS k", "id * 2 AS start_line", "id * 2 + 40 AS end_line")
    blocks = ranges.select("k", intervals.F.explode(intervals._blocks(intervals.F.col("start_line"), intervals.F.col("end_line"))).alias("b"))
    assert blocks.count() < 20 * n and blocks.distinct().count() < 2.2 * n
    assert intervals.points_in_ranges(points, ranges, key="k", point="line").count() == n


@pytest.mark.parametrize("seconds", [3600, 86_400 * 30])
def test_as_of_equals_a_look_back(spark, seconds):
    dice = random.Random(5)
    at = lambda: T0 + timedelta(minutes=dice.randint(0, 60 * 24 * 20))
    right = [(dice.choice("abc"), at(), i, f"v{i}") for i in range(300)] + [(None, T0, -1, "no"), ("a", None, -2, "no"), ("d", T0, 1, "x"), ("d", T0, 2, "y")]
    left = [(dice.choice("abce"), at(), i) for i in range(300)] + [("d", T0, 900), ("d", T0 - timedelta(seconds=1), 901), (None, T0, 902), ("a", None, 903), ("d", T0 + timedelta(400), 904), ("d", T0 + timedelta(400), 904)]
    l, r = spark.createDataFrame(left, "k string, t timestamp, i int"), spark.createDataFrame(right, "k string, t timestamp, v int, w string")
    want = []
    for k, t, i in left:
        seen = [(u, v, w) for j, u, v, w in right if k is not None and t is not None and u is not None and j == k and u <= t]
        want.append((k, t, i, *(max(seen)[1:] if seen else (None, None))))
    assert sorted(map(str, map(tuple, intervals.as_of(l, r, key="k", time="t", values=["v", "w"], seconds=seconds).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("own", [True, False])
def test_carried_values_equal_one_window(spark, own):
    dice = random.Random(6)
    rows = [(1000 * i + dice.randint(0, 9), dice.choice([None, None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, x string")
    want, last = [], None
    for o, x in sorted(rows):
        before, last = last, x if x is not None else last
        want.append((o, x, last if own else before))
    for size in (1, 5000, 10**9):
        assert sorted(map(str, map(tuple, intervals.carried(df, "ord", intervals.F.col("x"), own=own, size=size).collect()))) == sorted(map(str, want))
    assert intervals.carried(df.limit(0), "ord", intervals.F.col("x")).collect() == []


def test_points_are_laid_out_for_levels_that_ranges_have(spark):
    """Ranges of a few lines have blocks of the lowest level only, so no point is joined on eight rows."""
    points = spark.createDataFrame([(i % 7, i) for i in range(200)], "k int, p int")
    ranges = spark.createDataFrame([(k, 10 * k, 10 * k + 5) for k in range(7)], "k int, start_line int, end_line int")
    found = intervals.points_in_ranges(points, ranges, key="k", point="p")
    assert {tuple(r) for r in found.collect()} == {(i % 7, i) for i in range(200) if 10 * (i % 7) <= i <= 10 * (i % 7) + 5}
    assert ", 28)" not in found._jdf.queryExecution().analyzed().toString()  # the shift of the highest level
    assert intervals.points_in_ranges(points, ranges.limit(0), key="k", point="p").count() == 0
