"""k-anonymity on hand-made tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskveil.operators.kanon import k_metric, kanonymize, microaggregate, restore
from duskveil.operators.mondrian import mondrian, mondrian_classes
from duskveil.plans.scratch import stash


def rows(df, *key):
    return [tuple(r) for r in df.orderBy(*key).collect()]


def test_k_metric_counts_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "q int, r string")
    assert k_metric(df, ["q", "r"]).first().k == 1
    with pytest.raises(ValueError):
        k_metric(df, [])


def test_labels_of_numbers_dates_and_text(spark):
    day = datetime.date
    data = [
        (1, 10, day(2020, 1, 1), "b", "x"),
        (2, 12, day(2020, 1, 1), "a", "y"),
        (3, 30, day(2020, 3, 1), "c", "z"),
        (4, 30, day(2020, 3, 5), "c", "w"),
        (5, 31, day(2020, 3, 9), "d", "v"),
    ]
    df = spark.createDataFrame(data, "id int, n int, d date, s string, other string")
    out = microaggregate(df, ["n", "d", "s"], 2, ["id"])
    assert out.columns == df.columns
    assert rows(out, "id") == [
        (1, "10–12", "2020-01-01", "a", "x"),
        (2, "10–12", "2020-01-01", "a", "y"),
        (3, "30–31", "2020-03-01 – 2020-03-09", "c", "z"),
        (4, "30–31", "2020-03-01 – 2020-03-09", "c", "w"),
        (5, "30–31", "2020-03-01 – 2020-03-09", "c", "v"),
    ]


@pytest.mark.parametrize(
    "value, k, label", [(1, 5, "0–3"), (0, 2, "0–1"), (50, 4, "48–52"), (-7, 4, "-9–-5"), (2, 3, "1–3")]
)
def test_equal_numbers_are_widened(spark, value, k, label):
    df = spark.createDataFrame([(i, value) for i in range(k)], "id int, n int")
    assert {r.n for r in microaggregate(df, ["n"], k, ["id"]).collect()} == {label}


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5), (4, 3.5)], "id int, x double")
    assert [r[1] for r in rows(microaggregate(df, ["x"], 2, ["id"]), "id")] == ["0–2", "0–2", "2–4", "2–4"]


def test_missing_values_come_last_and_label_empty(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 9)], "id int, n int")
    assert [r[1] for r in rows(microaggregate(df, ["n"], 2, ["id"]), "id")] == ["", "", "5–9", "5–9"]


def test_short_tables_are_refused_and_small_k_is_a_no_op(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "id int, n int")
    with pytest.raises(ValueError):
        microaggregate(df, ["n"], 3, ["id"])
    assert rows(microaggregate(df, ["n"], 1, ["id"]), "id") == [(1, 2), (2, 3)]
    with pytest.raises(ValueError):
        kanonymize(df, ["n"], 2, ["id"], "other")


def test_only_text_means_one_score_for_all(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("s"))
    out = microaggregate(df, ["s"], 10, ["id"])
    assert out.count() == 1000
    assert out.where("s = 'hot'").count() == 1000  # every ten in a row hold the frequent value


@pytest.mark.parametrize("count", [1, 4, 37])
def test_same_result_under_any_partitioning(spark, partitions, count):
    df = spark.range(500).select(
        "id", (F.col("id") * 37 % 101).alias("a"), (F.col("id") % 7).alias("b"), F.lit("x").alias("c")
    )
    partitions(4)
    want = rows(microaggregate(df, ["a", "b"], 6, ["id"]), "id")
    partitions(count)
    assert rows(microaggregate(df, ["a", "b"], 6, ["id"]), "id") == want


def test_restore(spark):
    df = spark.createDataFrame([(1, 2, "u"), (2, 3, "v")], "id int, n int, s string")
    kept = microaggregate(df, ["n"], 2, ["id"], keep_backup=True)
    assert "backup_n" in kept.columns
    assert rows(restore(kept), "id") == rows(df, "id")
    with pytest.raises(ValueError):
        restore(df)


def median_cuts(points, k):
    """Classes by recursion on sets of row numbers, widest cuttable side first."""
    span = [max(p[d] for p in points) - min(p[d] for p in points) or 1.0 for d in range(len(points[0]))]

    def cut(members):
        options = []
        for d in range(len(span)):
            values = sorted(points[m][d] for m in members)
            middle = values[(len(values) - 1) // 2]
            low = [m for m in members if points[m][d] <= middle]
            if k <= len(low) <= len(members) - k:
                options.append((-(values[-1] - values[0]) / span[d], d, low))
        if not options:
            return [frozenset(members)]
        low = min(options)[2]
        return cut(low) + cut([m for m in members if m not in set(low)])

    return set(cut(list(range(len(points)))))


@pytest.mark.parametrize("local_rows", [25, 100_000])
def test_mondrian_equals_recursion(spark, local_rows):
    rng = np.random.default_rng(5)
    points = [(int(a), float(b)) for a, b in zip(rng.integers(0, 12, 300), rng.normal(0, 9, 300).round(1))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "id int, a int, b double")
    found = mondrian_classes(df, ["a", "b"], 7, ["id"], local_rows).collect()
    classes = {}
    for r in found:
        classes.setdefault((r["__level"], r["__class"], r["__part"]), set()).add(r["id"])
    assert {frozenset(c) for c in classes.values()} == median_cuts(points, 7)


def test_mondrian_writes_rows_once_for_several_levels(spark, monkeypatch):
    from duskveil.operators import mondrian as module

    written = []
    monkeypatch.setattr(module, "stash", lambda df: written.append(df.columns) or stash(df))
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 2000).alias("a"))
    rows = mondrian_classes(df, ["a"], 10, ["id"], local_rows=40)
    levels = max(r[0] for r in rows.select("__level").distinct().collect())
    moved = [c for c in written if "__state" in c]
    assert levels >= 5 and len(moved) == -(-levels // module.LEVELS)
    assert len(written) == 1 + 2 * levels + len(moved)


def test_mondrian_levels_do_not_grow_with_the_table(spark, monkeypatch):
    from duskveil.operators import mondrian as module

    monkeypatch.setattr(module, "LOCAL_SHARE", 6, raising=False)
    points = [(i * 7919 % 2000, i % 37) for i in range(2000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "id int, a int, b int")
    found = mondrian_classes(df, ["a", "b"], 7, ["id"], local_rows=20).collect()
    assert max(r["__level"] for r in found) <= 3
    classes = {}
    for r in found:
        classes.setdefault((r["__level"], r["__class"], r["__part"]), set()).add(r["id"])
    assert {frozenset(c) for c in classes.values()} == median_cuts(points, 7)


def test_mondrian_hot_tuple_never_reaches_one_task(spark):
    df = spark.range(600).select(
        "id",
        F.when(F.col("id") < 400, 5).otherwise(F.col("id") % 50).alias("a"),
        F.when(F.col("id") < 400, "same").otherwise(F.concat(F.lit("v"), F.col("id") % 9)).alias("s"),
    )
    classes = mondrian_classes(df, ["a", "s"], 5, ["id"], local_rows=50)
    sizes = classes.groupBy("__level", "__class", "__part").count()
    assert sizes.agg(F.min("count")).first()[0] >= 5
    assert classes.where("__part = -1").count() >= 400  # final on the executors
    labels, names = mondrian(df, ["a", "s"], 5, ["id"], local_rows=50)
    assert labels.count() == 600 and set(names) == {"a", "s"}


def test_mondrian_reads_text_as_number_date_or_order(spark):
    data = [(i, str(i), f"2020-01-{i + 1:02d}", "abcdefgh"[i]) for i in range(8)]
    df = spark.createDataFrame(data, "id int, n string, d string, s string")
    out = kanonymize(df, ["n", "d", "s"], 4, ["id"], "mondrian")
    assert {tuple(r)[1:] for r in out.collect()} == {
        ("0–3", "2020-01-01–2020-01-04", "a–d"), ("4–7", "2020-01-05–2020-01-08", "e–h"),
    }
