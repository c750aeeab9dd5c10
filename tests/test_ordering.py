"""Neighbours in one exchange, against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from duskveil.operators.context import mask_adjacent, mask_adjacent_consistently, mask_cyclic
from duskveil.operators.cover import spread_masks
from duskveil.plans.ordering import RANGES_EACH, beside, in_ranges, latest, running_sums
from duskveil.plans.scratch import stash


def around(df, order, cyclic=False):
    found = beside(df, order, [F.col("v").alias("v")], cyclic)
    return {r.v: (r["__before"] and r["__before"].v, r["__after"] and r["__after"].v) for r in found.collect()}


def expected(values, cyclic=False):
    out = {}
    for i, v in enumerate(values):
        before = values[i - 1] if i or cyclic else None
        after = values[(i + 1) % len(values)] if i + 1 < len(values) or cyclic else None
        out[v] = (before, after)
    return out


@pytest.mark.parametrize("count", [1, 4, 37])
@pytest.mark.parametrize("cyclic", [False, True])
def test_neighbours_at_any_partitioning(spark, partitions, count, cyclic):
    partitions(count)
    # a third of the rows share the first key, and some have none
    keys = [(None if i % 11 == 0 else "a" if i % 3 == 0 else f"k{i * 7919 % 500}", i) for i in range(700)]
    order = sorted(range(700), key=lambda i: (keys[i][0] is not None, keys[i][0] or "", keys[i][1]))
    rows = [(a, b, str(b)) for a, b in keys]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b int, v string").repartition(5)
    assert around(df, ["a", "b"], cyclic) == expected([str(i) for i in order], cyclic)


@pytest.mark.parametrize(
    "kind, keys",
    [
        ("double", [float("-inf"), -1.5, 0.0, 3e300, float("inf"), float("nan")]),
        ("timestamp", [datetime.datetime(2020, 1, 1, 0, 0, i // 3, i * 1000) for i in range(40)]),
        ("date", [datetime.date(2020, 1, 1 + i) for i in range(30)]),
        ("binary", [b"", b"\x00", b"\x7f", b"\xff", b"\xff\x00"]),
        ("boolean", [None, False, True]),
        ("array<int>", [[], [1], [1, 2], [2]]),
        ("struct<x:string,y:int>", [("", 1), ("a", None), ("a", 1), ("b", 0)]),
        ("string", ["", '"', "\\", "a\nb", "é", "日"]),
        ("decimal(38,10)", [__import__("decimal").Decimal(i) / 7 for i in range(9)]),
    ],
)
def test_every_kind_of_key(spark, kind, keys):
    rows = [(k, str(i)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows[::-1], f"k {kind}, v string")
    assert around(df, ["k"]) == expected([v for _, v in rows])


def test_small_tables_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    assert around(df, ["k"]) == {"x": (None, None)}
    assert around(df, ["k"], True) == {"x": ("x", "x")}
    assert beside(df.limit(0), ["k"], [F.col("v")]).count() == 0
    with pytest.raises(Exception, match="held by more than one row"):
        beside(df.union(df), ["k"], [F.col("v")]).collect()


def test_ranges_are_even_and_a_function_of_the_key(spark, partitions):
    partitions(4)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"))
    placed = in_ranges(df, ["k"])
    sizes = [r["count"] for r in placed.groupBy("__range").count().collect()]
    assert len(sizes) >= 4 * RANGES_EACH and max(sizes) < 4 * 20_000 / len(sizes)
    again = in_ranges(df.repartition(7), ["k"])
    assert placed.select("k", "__range").exceptAll(again.select("k", "__range")).count() == 0


def exchanges(df):
    """Exchanges that whole rows pass: those that carry the column ``wide``."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            columns = [str(c.name()) for c in _seq(node.output())]
            if "wide" in columns:
                found.append(columns)
        for child in _seq(node.children()):
            walk(child)
        return None

    def _seq(scala):
        return [scala.apply(i) for i in range(scala.length())]

    walk(df._jdf.queryExecution().executedPlan())
    return len(found)


def test_rows_pass_one_exchange(spark):
    rows = [(i, f"name {i % 7}", f"text{i % 5}*", "wide" * 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v string, w string, wide string").repartition(3)
    df = stash(df)
    for masked in (
        mask_adjacent(df, ["v", "w"], 3, ["id"]),
        mask_cyclic(df, ["v", "w"], 1, ["id"]),
        spread_masks(df, ["v", "w"], 2, ["id"]),
    ):
        assert exchanges(masked) == 1
    one, four = (
        mask_adjacent_consistently(df.withColumns({f"c{i}": F.col("v") for i in range(n)}), [f"c{i}" for i in range(n)], 3, ["id"])
        for n in (1, 4)
    )
    count = [str(x._jdf.queryExecution().sparkPlan()).count("Join") for x in (one, four)]
    assert count[0] == count[1]



@pytest.mark.parametrize("count, few", [(1, 0), (4, 0), (37, 0), (4, 10_000)])
def test_running_sums_and_latest_rows(spark, partitions, count, few):
    partitions(count)
    rng = random.Random(5)
    numbers = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rng.sample(numbers, 500), "k int, n long").repartition(3)
    found = {r.k: r.before for r in running_sums(df, ["k"], {"before": "n"}, few).collect()}
    assert found == {k: sum(n for j, n in numbers if j < k) for k, _ in numbers}
    # a third of the lookups ask for one place
    asked = [(i, 40 if i % 3 == 0 else rng.randint(-5, 130)) for i in range(600)]
    table = spark.createDataFrame([(x, f"row {x}") for x in range(0, 120, 7)], "x int, name string")
    met = latest(spark.createDataFrame(asked, "id int, x int").repartition(4), table, "x", few).collect()
    assert {r.id: r["__row"] and r["__row"].name for r in met} == {
        i: None if x < 0 else f"row {min(x, 119) // 7 * 7}" for i, x in asked
    }
    assert latest(df.limit(0).withColumn("x", F.lit(1)), table, "x").count() == 0
    assert latest(table, table.limit(0), "x").where("__row is null").count() == 18
