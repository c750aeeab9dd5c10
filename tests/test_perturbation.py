"""Keyed noise, gated release, date shifts and secure sums."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskveil.functions import noise
from duskveil.operators import perturb, secure


def test_uniform_is_open_repeatable_and_even(spark):
    df = spark.range(20_000).select(noise.uniform("s", F.col("id")).alias("u"))
    first = [r.u for r in df.collect()]
    assert first == [r.u for r in df.repartition(3).select("u").collect()] or sorted(first) == sorted(
        r.u for r in df.repartition(3).collect()
    )
    assert 0 < min(first) and max(first) < 1
    assert abs(np.mean(first) - 0.5) < 0.01 and abs(np.var(first) - 1 / 12) < 0.01


def test_laplace_scale(spark):
    draws = [r[0] for r in spark.range(50_000).select(noise.laplace(3, 2.0, F.col("id"))).collect()]
    assert abs(np.mean(draws)) < 0.06 and abs(np.mean(np.abs(draws)) - 2) < 0.05


def test_noise_touches_numbers_only(spark):
    df = spark.createDataFrame([(1, 5, 1.0, "a", True), (2, None, 3.0, "b", False), (3, 9, 2.0, "c", True)],
                               "id int, n int, x double, s string, b boolean")
    out = perturb.laplace_noise(df, {"n": 1.0, "x": 1.0, "s": 1.0, "b": 1.0, "none": 1.0}, ["id"], 4)
    rows = out.orderBy("id").collect()
    assert out.schema["n"].dataType.simpleString() == "double"
    assert rows[1].n is None and rows[0].s == "a" and rows[0].b is True
    assert rows[0].n != 5 and rows[0].x != 1.0
    assert rows == perturb.laplace_noise(df, {"n": 1.0, "x": 1.0}, ["id"], 4).orderBy("id").collect()
    assert rows != perturb.laplace_noise(df, {"n": 1.0, "x": 1.0}, ["id"], 5).orderBy("id").collect()
    with pytest.raises(ValueError):
        perturb.laplace_noise(df, {"n": 0.0}, ["id"], 4)


def test_columns_get_independent_noise(spark):
    df = spark.range(3000).select("id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    bounds = {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    out = perturb.laplace_noise(df, {"a": 1.0, "b": 1.0}, ["id"], 1, bounds)
    assert abs(out.agg(F.corr("a", "b")).first()[0]) < 0.06


def test_constant_column_gets_no_noise(spark):
    df = spark.createDataFrame([(1, 7.0), (2, 7.0)], "id int, x double")
    assert [r.x for r in perturb.laplace_noise(df, {"x": 1.0}, ["id"], 1).collect()] == [7.0, 7.0]


def test_release_is_gated(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 8.0, None)], "id int, x double, s string")
    assert perturb.release(df, True, ["id"], 1) is df
    locked = perturb.release(df, False, ["id"], 1).orderBy("x").collect()
    assert {r.s for r in locked} == {"***", None}
    assert {r.x for r in locked}.isdisjoint({5.0, 8.0})


def test_dates_move_together_per_subject(spark):
    day, at = datetime.date, datetime.datetime
    rows = [
        ("a", day(2020, 1, 10), at(2020, 1, 10, 8, 30), "2020-02-01 10:00:00"),
        ("a", day(2020, 1, 20), at(2020, 3, 1, 9, 0), "junk"),
        ("b", day(2020, 1, 10), None, "2020-02-01"),
        (None, day(2020, 1, 10), at(2020, 1, 10, 8, 30), "2020-02-01"),
    ]
    df = spark.createDataFrame(rows, "who string, d date, t timestamp_ntz, s string")
    out = perturb.shift_dates(df, "who", ["d", "t", "s", "none"], 30, "seed")
    got = {(r.who, n): r for n, r in enumerate(out.orderBy("who", "d", "s").collect())}
    a = [r for (who, _), r in got.items() if who == "a"]
    move = a[0].d - day(2020, 1, 10)
    assert abs(move.days) <= 30
    assert (a[1].d - a[0].d).days == 10
    assert a[0].t - at(2020, 1, 10, 8, 30) == move and a[1].t - at(2020, 3, 1, 9, 0) == move
    assert {r.s for r in a} == {None, at(2020, 2, 1, 10) + move}
    lost = [r for (who, _), r in got.items() if who is None][0]
    assert (lost.d, lost.t, lost.s) == (None, None, None)
    assert dict(out.dtypes)["d"] == "date" and dict(out.dtypes)["t"] == "timestamp_ntz"
    plain = perturb.shift_dates(df, "who", ["t"], 30, "seed", drop_time=True)
    assert dict(plain.dtypes)["t"] == "date"
    assert perturb.shift_dates(df, "who", [], 5, 1) is df
    with pytest.raises(ValueError):
        perturb.shift_dates(df, "absent", ["d"], 5, 1)


def test_shifts_cover_the_range(spark):
    df = spark.range(4000).select(F.col("id").alias("who"), F.lit("2020-01-01").cast("date").alias("d"))
    out = perturb.shift_dates(df, "who", ["d"], 3, 9)
    seen = {r[0] for r in out.select(F.datediff("d", F.lit("2020-01-01"))).distinct().collect()}
    assert seen == set(range(-3, 4))


@pytest.mark.parametrize("count", [1, 4, 37])
def test_ring(spark, partitions, count):
    partitions(count)
    values = [5.0, None, -2.5, 11.25, 0.0, 7.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(3)
    parties = secure.masked_contributions(df, "v", ["i"], "s", 10.0)
    rows = parties.orderBy("party_id").collect()
    assert [r.private_value for r in rows] == [v for v in values if v is not None]
    assert [r.party_id for r in rows] == [1, 2, 3, 4, 5]
    for one, two in zip(rows, rows[1:]):
        assert one.outgoing_mask == two.incoming_mask and two.seed == one.seed + 1
    total = secure.secure_sum(parties, "s", 10.0).first()
    assert total.recovered_sum == pytest.approx(20.75, abs=1e-9) and total.actual_sum == 20.75
    assert total.initial_mask == rows[0].incoming_mask and total.final_mask == rows[-1].outgoing_mask


def test_ring_needs_two_values_and_noise(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "i int, v double")
    with pytest.raises(ValueError):
        secure.masked_contributions(df, "v", ["i"], 1)
    with pytest.raises(ValueError):
        secure.masked_contributions(df, "v", ["i"], 1, noise_range=0)
