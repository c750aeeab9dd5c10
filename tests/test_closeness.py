"""t-closeness and the verifier on hand-made classes."""

import random
from collections import Counter

import pytest

from duskveil.operators import closeness, verify

ROWS = [
    (1, "a", "x", "flu"), (2, "a", "x", "flu"), (3, "a", "x", "flu"), (4, "a", "x", None),
    (5, "b", "x", "flu"), (6, "b", "x", "cold"), (7, "b", "x", "cold"), (8, "b", "x", "flu"),
    (9, "c", "x", "***"), (10, "c", "x", None), (11, None, "x", "cold"), (12, "b", None, "cold"),
]
SCHEMA = "id int, q1 string, q2 string, s string"


def test_distribution_leaves_out_nulls_and_stars(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = {r.value: r.p for r in closeness.distribution(df, "s").collect()}
    assert found == {"flu": 5 / 9, "cold": 4 / 9}
    assert closeness.distribution(df.where("s is null"), "s").count() == 0
    assert "***" in {r.value for r in closeness.distribution(df, "s", exclude=None).collect()}


def test_distances_and_suppression(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = {r.q1: (r.n, round(r.tvd, 12)) for r in closeness.class_distances(df, ["q1", "q2"], "s").collect()}
    assert found == {"a": (4, round(4 / 9, 12)), "b": (4, round(1 / 18, 12)), "c": (2, 0.5)}
    bad = {r.q1 for r in closeness.violating_classes(df, ["q1", "q2"], "s", 0.45).collect()}
    assert bad == {"c"}
    out = closeness.suppress_violations(df, ["q1", "q2"], "s", 0.3, ["id"]).orderBy("id").collect()
    assert [r.s for r in out] == ["***"] * 4 + ["flu", "cold", "cold", "flu", "***", "***", "cold", "cold"]
    assert out[0].asDict().keys() == df.first().asDict().keys()


def test_nothing_usable_violates_nothing(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "***")], "id int, q string, s string")
    assert closeness.violating_classes(df, ["q"], "s", 0.1).count() == 0
    out = closeness.suppress_violations(df, ["q"], "s", 0.1, ["id"]).orderBy("id").collect()
    assert [r.s for r in out] == [None, "***"]


def test_numeric_sensitive_column_becomes_text(spark):
    df = spark.createDataFrame([(i, i % 2, 5 if i % 2 else 7) for i in range(8)], "id int, q int, s int")
    out = closeness.suppress_violations(df, ["q"], "s", 0.2, ["id"])
    assert out.schema["s"].dataType.simpleString() == "string"
    assert {r.s for r in out.collect()} == {"***"}


def test_total_variation_aligns_values(spark):
    p = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, p double")
    q = spark.createDataFrame([("b", 0.25), ("c", 0.75)], "value string, p double")
    assert closeness.total_variation(p, q).first().tvd == 0.75


def test_after_suppression_no_class_is_far(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 30), rng.choice("aaabbc")) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, q int, s string")
    total = Counter(s for _, _, s in rows)
    out = closeness.suppress_violations(df, ["q"], "s", 0.2, ["id"]).collect()
    classes = {}
    for r in out:
        classes.setdefault(r.q, Counter())[r.s] += 1
    for values in classes.values():
        size = sum(values.values())
        far = sum(abs(values[v] / size - n / len(rows)) for v, n in total.items()) / 2
        assert values["***"] in (0, size) and (values["***"] == size or far <= 0.2)


def list_distance(every, own):
    """Mean difference of the sorted frequency lists over the table's values."""
    total, part = Counter(every), Counter(own)
    p = sorted(n / len(every) for n in total.values())
    q = sorted(part[v] / len(own) if own else 0.0 for v in total)
    return sum(abs(a - b) for a, b in zip(p, q)) / len(p)


@pytest.mark.parametrize("seed, variety", [(1, 4), (2, 60), (3, 500)])
def test_frequency_distance(spark, seed, variety):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(6)]), None if rng.random() < 0.1 else int(rng.triangular(0, variety, 1)))
            for _ in range(600)]
    rows += [(99, None), (99, None)]
    df = spark.createDataFrame(rows, "q int, s int")
    every = [s for _, s in rows if s is not None]
    want = {
        q: list_distance(every, [s for r, s in rows if r == q and s is not None])
        for q in {r for r, _ in rows if r is not None}
    }
    got = {r.q: r.distance for r in verify.frequency_distances(df, ["q"], "s").collect()}
    assert got.keys() == want.keys()
    for q in want:
        assert got[q] == pytest.approx(want[q], abs=1e-12)


def test_checks_and_report(spark):
    rows = [("a", 1), ("a", 2), ("a", 3), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 2), (None, 9)]
    df = spark.createDataFrame(rows, "q string, s int").toDF(" Q", "s")
    assert verify.check_k(df, [" Q"], 4).first().k_ok is True
    assert verify.check_k(df, [" Q"], 5).first().k_ok is False
    assert verify.check_k(df.limit(0), [" Q"], 1).first().k_ok is False
    assert verify.check_l(df, [" Q"], "s", 3).first().l_ok is True
    assert verify.check_l(df, [" Q"], "s", 4).first().l_ok is False
    assert verify.check_l(df.limit(0), [" Q"], "s", 4).first().l_ok is True
    assert tuple(verify.verify_release(df, ["q"], "S").first()) == (True, True, True)
    assert tuple(verify.verify_release(df, ["q"], "S", 5, 4, 0.01).first()) == (False, False, False)
    with pytest.raises(ValueError):
        verify.verify_release(df, ["none"], "s")
