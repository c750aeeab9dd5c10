"""Shapes, profiles, chart data, sources, joins and streams."""

import collections
import datetime
import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskveil.operators import charts, masks, profile, shape
from duskveil.plans.joins import counted_join, lookup_join
from duskveil.plans.ordering import NUMBER, exact_quantiles, freeze_order, neighbours, number_rows, ordered_counts
from duskveil.plans.release import ReleaseInfo
from duskveil.plans.scratch import drop_scratch, scratch, scratch_root, stash
from duskveil.sources import arrays, catalogue, tables
from duskveil.streaming import STATELESS


def test_selection_and_names(spark):
    df = spark.createDataFrame([(1, "a", True)], "i int, n string, b boolean").toDF(" Id", "Na.Me ", "b")
    assert shape.tidy_names(df).columns == ["id", "na.me", "b"]
    assert shape.select_columns(df, ["Na.Me "]).columns == ["Na.Me "]
    assert shape.numeric_columns(df).columns == [" Id"]
    assert shape.rename_columns(df, {"b": "c", "zz": "y"}).columns == [" Id", "Na.Me ", "c"]
    for bad in (lambda: shape.select_columns(df, []), lambda: shape.select_columns(df, ["none"]),
                lambda: shape.numeric_columns(df.select("b")),
                lambda: shape.tidy_names(df.select("b", F.col("b").alias(" B")))):
        with pytest.raises(ValueError):
            bad()


def test_filter_transform_sort_preview(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id int, n int")
    assert shape.filter_rows(df, lambda t: t.n > 2).count() == 1
    assert [r.id for r in shape.sort_rows(df, "n").collect()] == [3, 1, 2]
    assert [r.id for r in shape.sort_rows(df, "n", ascending=False).collect()] == [1, 3, 2]
    with pytest.raises(ValueError):
        shape.transform_table(df, lambda t: t.limit(1), check_rows=True)
    for change in (
        lambda t: t.withColumn("n", t.n + 1),
        lambda t: t.orderBy("n"),
        lambda t: t.repartitionByRange(3, "n"),
        lambda t: t.join(t.groupBy("id").count(), "id"),
    ):
        assert shape.transform_table(df, change, check_rows=True).count() == 3
    for change in (lambda t: t.union(t), lambda t: t.union(t).orderBy("n"), lambda t: t.where("n > 2")):
        with pytest.raises(ValueError):
            shape.transform_table(df, change, check_rows=True)
    assert shape.preview(spark.range(500), ["id"]).count() == 100
    assert shape.drop_missing_numbers(df, "n").count() == 2
    with pytest.raises(ValueError):
        shape.drop_missing_numbers(df.where("id = 1"), "n")


def test_dates(spark):
    rows = [(1, "2020-02-03", "x", "2020-01-01", 20200101), (2, None, "2020-05-05", "2020-01-09", 7)]
    df = spark.createDataFrame(rows, "id int, d string, s string, e string, n int")
    assert [r[0] for r in shape.date_like_columns(df).orderBy("column_name").collect()] == ["d", "e"]
    assert shape.expand_dates(df).columns == [
        "id", "s", "n", "d_year", "d_month", "d_day", "e_year", "e_month", "e_day"
    ]
    assert shape.expand_dates(df).orderBy("id").first().d_month == 2
    out = shape.sanitise_features(df, ["id"], date_pair=("d", "e")).orderBy("id").collect()
    assert out[0].asDict() == {
        "id": 1, "s_year": 2020, "s_month": 5, "s_day": 5, "n": 20200101,
        "admit_ord": datetime.date(2020, 2, 3).toordinal(), "disch_ord": datetime.date(2020, 1, 1).toordinal(),
        "los_days": -33,
    }
    assert out[1].admit_ord == out[0].admit_ord  # mean of the one known value


def test_profile(spark):
    rows = [(1, 2.0, "a"), (2, None, "a"), (3, 5.0, None), (4, 2.0, "b")]
    df = spark.createDataFrame(rows, "id int, x double, s string")
    got = {r.column_name: tuple(r)[1:] for r in profile.column_profile(df).collect()}
    assert got["x"] == ("double", 1, 3, 2, 3.0, 1.73)
    assert got["s"] == ("string", 1, 3, 2, None, None)
    exact, near = (profile.column_profile(df, approximate=a).orderBy("column_name").collect() for a in (False, True))
    assert exact == near
    empty = spark.createDataFrame([(None,)], "z double")
    assert tuple(profile.column_profile(empty).first()) == ("z", "double", 1, 0, 0, None, None)
    top = [tuple(r) for r in profile.top_values(df).where("column_name = 's'").orderBy("rank").collect()]
    assert top == [("s", "a", 2, 1), ("s", "b", 1, 2)]
    many = spark.range(30).select(F.col("id").cast("string").alias("s"))
    assert [r.value for r in profile.top_values(many).orderBy("rank").collect()][:3] == ["0", "1", "10"]
    info = ReleaseInfo(k=4, l=2)
    assert tuple(profile.dataset_header(df, info).first()) == (4, 3, True, True, 4, 2)
    assert tuple(profile.dataset_header(df).first()) == (4, 3, False, False, None, None)
    assert profile.summary_report(df, info).where("section = 'dataset'").count() == 6


def test_changed_columns(spark):
    df = spark.createDataFrame([(1, 2, "a", None), (2, 3, "b", "x")], "id int, n int, s string, t string")
    changed = df.withColumn("n", F.col("n").cast("string")).withColumn("s", F.lit("a"))
    assert [r[0] for r in profile.changed_columns(changed, df, ["id"]).orderBy("column_name").collect()] == ["n", "s"]
    assert profile.changed_columns(df, df, ["id"]).count() == 0
    assert profile.changed_columns(df.limit(1), df, ["id"]).count() == 4


def test_chart_numbers(spark):
    cells = {"1,5": 1.5, "3–7": 5.0, "3 to 7": 5.0, "3 – 7": 5.0, "3 TO 7": 5.0, "*": None, " ": None, "-4": -4.0,
             "2019-06-18": None, "2019-06": 1012.5, "-9–-5": -7.0, "1.5-2,5": 2.0, "1e3": None, "7\n": 7.0,
             "1,000,5": None}
    df = spark.createDataFrame([(c,) for c in [*cells, None]], "v string")
    raw = df.withColumn("cell", F.col("v"))
    got = {r.cell: r.v for r in charts.numeric_cells(raw, ["v"]).collect()}
    assert got == {**cells, None: None}


def test_counts_histogram_scatter(spark):
    df = spark.createDataFrame([("a", 1.0), ("", 2.0), (None, 5.0), ("a", 11.0)], "s string, x double")
    assert {r.label: r.n for r in charts.category_counts(df, "s").collect()} == {"a": 2, "N/A": 2}
    bins = {r.bin: (r.low, r.high, r.n) for r in charts.histogram(df, "x", 5).collect()}
    assert bins == {1: (1.0, 3.0, 2), 3: (5.0, 7.0, 1), 5: (9.0, 11.0, 1)}
    one = charts.histogram(spark.createDataFrame([("4",), ("4",)], "x string"), "x").collect()
    assert [(r.bin, r.n) for r in one] == [(1, 2)]
    assert charts.histogram(df.limit(0), "x").count() == 0
    with pytest.raises(ValueError):
        charts.histogram(df, "x", 51)
    assert charts.scatter_pairs(df, "s", "x").count() == 0
    both = charts.before_after(df, df.limit(1), lambda t: charts.category_counts(t, "s"))
    assert both.groupBy("version").count().count() == 2


@pytest.mark.parametrize("count", [1, 4, 37])
def test_exact_quantiles_equal_numpy(spark, partitions, count):
    partitions(count)
    rng = np.random.default_rng(1)
    hot = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(0, 20, 3000).round(2))
    groups = np.where(rng.random(3000) < 0.6, "hot", rng.choice(list("abc"), 3000))
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(groups, hot)], "g string, x double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p1": 1.0}
    counts = ordered_counts(df, ["g"], "x")
    for row in exact_quantiles(counts, ["g"], "x", probs).collect():
        want = np.quantile(hot[groups == row.g], list(probs.values()))
        assert np.allclose([row[p] for p in probs], want) and row.n == (groups == row.g).sum()
    single = exact_quantiles(ordered_counts(df, [], "x"), [], "x", probs).first()
    assert np.allclose([single[p] for p in probs], np.quantile(hot, list(probs.values())))


def test_boxes(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 1.0)], "g string, x double")
    box = charts.grouped_boxes(df, "g", "x").collect()
    assert [tuple(b) for b in box] == [("a", 5, 1.0, 2.0, 3.0, 4.0, 100.0, 1.0, 4.0, 1)]
    assert [b.column_name for b in charts.box_summary(df).collect()] == ["x"]


@pytest.mark.parametrize("count", [1, 4, 37])
def test_row_numbers_and_neighbours(spark, partitions, count):
    partitions(count)
    df = spark.range(400).select((F.col("id") * 7 % 400).alias("id"), F.lit(1).alias("same"))
    order = [F.col("same").asc(), F.col("id").asc()]
    numbered = number_rows(df, order)
    assert numbered.rows == 400
    assert numbered.df.where(F.col(NUMBER) != F.col("id") + 1).count() == 0
    beside = neighbours(freeze_order(df, order), [F.col("id").alias("v")])
    wrong = beside.where(
        (F.coalesce(F.col("__before.v"), F.lit(-1)) != F.col("id") - 1)
        | (F.coalesce(F.col("__after.v"), F.lit(400)) != F.col("id") + 1)
    )
    assert wrong.count() == 0 and beside.count() == 400
    ring = neighbours(freeze_order(df, order), [F.col("id").alias("v")], cyclic=True)
    assert ring.where("id = 0").first()["__before"].v == 399
    assert ring.where("id = 399").first()["__after"].v == 0


def test_lookup_join_cuts_hot_keys_and_keeps_all_rows(spark):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") < 400, "hot").when(F.col("id") < 700, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 90)).alias("k")
    )
    table = df.where("k is not null").groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("top"))
    table = table.where("k != 'k5'")
    got = lookup_join(df, table, ["k"], "w", ["id"], slice_rows=50)
    want = df.join(table.drop("w"), "k", "left").select("id", "k", "top")
    assert got.columns == ["id", "k", "top"] and got.count() == 1000
    assert got.exceptAll(want).count() == 0


def test_counted_join_gives_the_same_with_and_without_broadcast(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("k"))
    table = df.where("k < 5").groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("top"))
    one = counted_join(df, table, 5, "k", "w", ["id"]).select("id", "k", "top")
    two = counted_join(df, table, 5, "k", "w", ["id"], broadcast_bytes=1).select("id", "k", "top")
    assert one.count() == 300 and one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_scratch_follows_the_session(spark):
    table = stash(spark.range(5))
    assert table.count() == 5 and scratch_root(spark) in table.inputFiles()[0]


def test_scratch_can_be_dropped(spark):
    table = stash(spark.range(5))
    path = pathlib.Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists()
    drop_scratch(spark)
    assert not path.exists()
    assert stash(spark.range(3)).count() == 3


def test_scratch_block_leaves_nothing(spark):
    keep = stash(spark.range(2))
    with scratch(spark):
        folder = pathlib.Path(stash(spark.range(5)).inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
        assert folder.parent.parent.stat().st_mode & 0o077 == 0  # no one else may read it
    assert not folder.exists() and not folder.parent.exists()
    assert keep.count() == 2


def test_keys_may_be_null_but_not_repeated(spark):
    from duskveil.operators.context import mask_adjacent
    from duskveil.operators.kanon import kanonymize
    from duskveil.plans.joins import row_join

    df = spark.createDataFrame([(i if i else None, i % 5, "ab", i) for i in range(12)], "id int, q int, s string, rest int")
    for strategy in ("micro", "mondrian"):
        assert kanonymize(df, ["q"], 3, ["id"], strategy).count() == 12
        with pytest.raises(Exception, match="more than one row"):
            kanonymize(df.union(df), ["q"], 3, ["id"], strategy).collect()
    assert mask_adjacent(df, ["s"], 1, ["id"]).count() == 12
    with pytest.raises(Exception, match="more than one row"):
        mask_adjacent(df.union(df), ["s"], 1, ["id"]).collect()
    table = spark.createDataFrame([(None, "n"), (3, "t")], "k int, v string")
    found = {r.id: r.v for r in row_join(df, table, ["id"], ["k"]).collect()}
    assert len(found) == 12 and found[None] == "n" and found[3] == "t" and found[4] is None


def test_not_a_number_is_missing(spark):
    from duskveil.operators import federated, perturb, secure
    from duskveil.operators.kanon import kanonymize

    nan = float("nan")
    df = spark.createDataFrame([(i, nan if i == 3 else float(i), i % 2) for i in range(12)], "id int, x double, g int")
    gap = df.withColumn("x", F.nanvl("x", F.lit(None)))
    assert shape.drop_missing_numbers(df, "x").count() == 11
    noisy = perturb.laplace_noise(df, {"x": 1.0}, ["id"], 1)
    assert noisy.where("x < 1e300").count() == 11
    parties = secure.masked_contributions(df, "x", ["id"], 1)
    assert secure.secure_sum(parties, 1).first().actual_sum == 63.0
    for strategy in ("micro", "mondrian"):
        got, want = (
            sorted(map(str, kanonymize(t, ["x"], 3, ["id"], strategy).collect())) for t in (df, gap)
        )
        assert got == want
    assert shape.sanitise_features(df, ["id"]).agg(F.round(F.sum("x"), 6)).first()[0] == pytest.approx(63 + 63 / 11)
    one, two = (federated.fit_average(t, "g", "x", ["id"], 2)[0].collect() for t in (df, gap))
    assert one == two and len(one[0].coefficients) == 2


def test_csv(spark, tmp_path):
    text = 'id,name,x,flag,none,admit date\n1,"a, ""b""\nc",1.5,True,NA,2020-01-02\n2,n/a,3,False,,bad\n'
    path = tmp_path / "in.csv"
    path.write_text(text)
    df = tables.read_csv(spark, str(path), multi_line=True)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "x": "double", "flag": "boolean",
                               "none": "double", "admit date": "string"}
    rows = df.orderBy("id").collect()
    assert rows[0].name == 'a, "b"\nc' and rows[1].name is None and rows[1].none is None
    path = tmp_path / "lines.csv"
    path.write_text(text.replace("\nc", " c"))
    some = tables.read_table(spark, str(path), ["id", "admit date"])
    assert [tuple(r) for r in some.orderBy("id").collect()] == [(1, datetime.datetime(2020, 1, 2)), (2, None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "in.xlsx"))
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), ["absent"])
    back = tables.read_csv(spark, tables.write_csv(df, str(tmp_path / "a" / "out")), multi_line=True)
    assert back.orderBy("id").collect() == rows
    fixed = tables.read_csv(spark, str(path), ["x"], schema="id int, name string, x double, flag boolean, none string, d string")
    assert fixed.dtypes == [("x", "double")]
    again = tables.read_csv(spark, str(path), schema=tables.read_csv(spark, str(path)).schema)
    assert again.orderBy("id").collect()[1].name is None  # n/a is missing under a schema too
    assert spark.read.parquet(tables.write_parquet(df, str(tmp_path / "p"))).count() == 2
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, str(path), schema="id int, name int").collect()


def test_top_values_of_long_texts(spark):
    long = ["x" * 70 + str(i) for i in range(3)]
    df = spark.createDataFrame([(v, 1) for v in [long[0], long[1], long[1], "short", None, long[2] * 400]], "v string, n int")
    found = {(r.column_name, r.value): (r.n, r["rank"]) for r in profile.top_values(df).collect()}
    assert found["v", long[1]] == (2, 1) and found["v", "short"][0] == 1 and ("v", long[2] * 400) in found
    assert len(found) == 5 and found["n", "1"] == (6, 1)
    assert {r.column_name: r.distinct for r in profile.column_profile(df).collect()} == {"v": 4, "n": 1}


def test_long_whole_numbers(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b,c\n1234567890123456789,12345678901234567890123,1\n1234567890123456788,1,0.5\n")
    df = tables.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "double"}
    assert {r.a for r in df.collect()} == {1234567890123456789, 1234567890123456788}
    assert max(r.b for r in df.collect()) == 12345678901234567890123


def test_date_spellings(spark):
    from duskveil.operators.perturb import shift_dates

    day = datetime.datetime(2019, 6, 18)
    cells = {"us": "06/18/2019", "eu": "18/06/2019", "dot": "18.6.2019", "word": "18 Jun 2019", "long": "June 18, 2019 13:05",
             "noon": "06/18/2019 1:05 PM", "iso": "2019-06-18 13:05:00"}
    df = spark.createDataFrame([(1, *cells.values(), "x"), (2, *[None] * len(cells), "06/18/2019")], ["id", *cells, "part"])
    assert {r[0] for r in shape.date_like_columns(df).collect()} == set(cells)
    done = shift_dates(df, "id", list(cells), 0, 1, drop_time=True).where("id = 1").first()
    assert all(done[c] == day.date() for c in cells)
    with pytest.raises(ValueError):
        shape.expand_dates(df.withColumn("us_year", F.lit(1)))
    parts = shape.expand_dates(df).where("id = 1").first()
    assert all((parts[f"{c}_year"], parts[f"{c}_month"], parts[f"{c}_day"]) == (2019, 6, 18) for c in cells)
    assert shift_dates(df, "id", ["us"], 0, 1, formats=["d/M/yyyy"]).first()["us"] is None


def test_catalogue_and_arrays(spark, tmp_path):
    path = tmp_path / "datasets.json"
    path.write_text(json.dumps([{"name": "one", "versions": ["1", "2"]}, {"name": "two", "versions": []}], indent=1))
    table = catalogue.read_catalogue(spark, str(path))
    assert [r.name for r in catalogue.dataset_names(table).collect()] == ["one", "two"]
    assert [r.version for r in catalogue.dataset_versions(table, "one").collect()] == ["1", "2"]
    assert catalogue.dataset_versions(table, "absent").count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [[4.0], [5.0]], "s"), (2, [], [[1.0]], "t")],
                               "k int, a array<double>, b array<array<double>>, s string")
    got = arrays.arrays_to_rows(df, keep=["k"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1.0, 4.0), (1, 1, 2.0, 5.0)]
    with pytest.raises(ValueError):
        arrays.arrays_to_rows(df, ["s"])


def test_stateless_operators_run_on_a_stream(spark, tmp_path):
    assert masks.mask_word_tails in STATELESS
    df = spark.createDataFrame([("Ann Lee",), ("Bo",)], "v string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        masks.suppress_text(masks.mask_word_tails(stream, ["v"], 2).withColumn("w", F.col("v"))).withColumn(
            "v", F.col("w")
        )
        .writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert {r.w for r in spark.table("released").collect()} == {"***"}


def test_csv_types_need_a_numeric_spelling(spark, tmp_path):
    cells = {
        "ids": ["1d", "2f", "1f"], "hex": ["0x1p3", "1", "2"], "ends": ["1D", "1.5F", "2"],
        "numbers": ["1.5", ".5", "2e3"], "far": ["Infinity", "-inf", "1."], "whole": ["1", "-2", "+3"],
    }
    lines = [",".join(cells), *[",".join(row) for row in zip(*cells.values())]]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    read = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(read.dtypes) == {
        "ids": "string", "hex": "string", "ends": "string", "numbers": "double", "far": "double", "whole": "bigint",
    }
    assert [r.ids for r in read.collect()] == cells["ids"]
    assert [r.far for r in read.collect()] == [float("inf"), float("-inf"), 1.0]


@pytest.mark.parametrize("held, most", [(2048, 8192), (8, 8192), (8, 1), (1, 8192)])
def test_top_values_from_any_summary(spark, held, most):
    """Frequent values among thousands of rare ones, columns without any, and ties."""
    rows = [
        (f"hot{i % 12}" if i % 3 == 0 else f"rare{i}", i, None if i % 5 else i % 4, "z" * 70 + str(i % 25))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "a string, b int, c int, d string").repartition(5)
    found = {}
    for r in profile.top_values(df, 10, held, most).orderBy("column_name", "rank").collect():
        found.setdefault(r.column_name, []).append((r.value, r.n))
    for i, name in enumerate("abcd"):
        counts = {}
        for row in rows:
            if row[i] is not None:
                counts[str(row[i])] = counts.get(str(row[i]), 0) + 1
        assert found[name] == sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:10]


def test_frequent_values_have_the_stated_error(spark):
    values = [i % 7 if i % 2 else 1000 + i for i in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(4)
    found = profile._frequent(df, 20).collect()
    error = found[0]["error"]
    assert 0 < error <= len(values) / 20
    codes = {r.code: r.v for r in df.distinct().select(F.xxhash64(F.col("v").cast("string")).alias("code"), "v").collect()}
    least = {codes[r.code]: r.least for r in found}
    for v in set(values):
        assert least.get(v, 0) <= values.count(v) <= least.get(v, 0) + error


def test_sketch_boxes_and_scatter_sample(spark):
    df = spark.createDataFrame(
        [("a" if i % 3 else "b", float(i % 997), float(i * 37 % 1009), i) for i in range(5000)],
        "g string, x double, y double, id int",
    )
    for box in charts.grouped_boxes(df, "g", "x", accuracy=200).collect():
        own = np.sort([i % 997 for i in range(5000) if (i % 3 > 0) == (box.label == "a")])
        for p, value in ((0, box.low), (0.25, box.q1), (0.5, box.median), (0.75, box.q3), (1, box.high)):
            assert abs(np.searchsorted(own, value) - p * len(own)) <= len(own) / 200 + 6
    assert charts.box_summary(df.limit(0), ["x"], accuracy=100).count() == 0
    one = charts.scatter_sample(df, "x", "y", ["id"], per_cell=2, grid=6, seed=3)
    two = charts.scatter_sample(df.repartition(7), "x", "y", ["id"], per_cell=2, grid=6, seed=3)
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 72
    other = charts.scatter_sample(df, "x", "y", ["id"], per_cell=2, grid=6, seed=4)
    assert sorted(other.collect()) != sorted(one.collect())
    flat = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 2.0, 2), (float("inf"), 1.0, 3)], "x double, y double, id int")
    assert charts.scatter_sample(flat, "x", "y", ["id"], per_cell=1).count() == 1


@pytest.mark.parametrize("most", [0, 8192])
def test_top_values_send_no_ties_to_one_task(spark, most):
    head = "h" * 64
    texts = [f"{head}{i:05d}" for i in range(3000)] + [head, "i" * 64] + [f"{head}x"] * 2 + ["short"] * 3
    df = spark.createDataFrame([(t, t[::-1]) for t in texts], "a string, b string").repartition(5)
    counts = profile._value_counts(df)
    groups = profile._leading_groups(counts, 10)
    assert groups.count() <= 20 and groups.agg(F.sum("size")).first()[0] > 3000
    # what the window's exchange moves is at most ten rows per column and partition
    assert groups._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    found = {(r.column_name, r["rank"]): (r.value, r.n) for r in profile.top_values(df, 10, 4, most).collect()}
    for name, values in (("a", texts), ("b", [t[::-1] for t in texts])):
        wanted = sorted(collections.Counter(values).items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [found[name, i + 1] for i in range(10)] == wanted
