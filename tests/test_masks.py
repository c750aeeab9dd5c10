"""Masks against brute force written from their rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from duskveil.operators import context, cover, masks
from duskveil.plans.release import ReleaseInfo

ALPHABET = "aAbB1 2*-éßS.çЖж"


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, v string").repartition(3)


def column(df):
    return [r.v for r in df.orderBy("id").collect()]


def random_texts(seed, count=40, longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_share_levels(spark):
    df = table(spark, ["abcdefgh", "abcdef", "ab", "", None])
    assert column(masks.mask_share(df, ["v"], "light")) == ["abcdef**", "abcd**", "a*", "*", None]
    assert column(masks.mask_share(df, ["v"], "medium")) == ["abcd****", "abc***", "a*", "*", None]
    assert column(masks.mask_share(df, ["v"], "heavy")) == ["ab******", "ab****", "**", "*", None]
    assert column(masks.mask_share(df, ["v"], "sensitive")) == ["********", "******", "**", "", None]
    with pytest.raises(ValueError):
        masks.mask_share(df, ["v"], "none")


def test_tails_and_words(spark):
    df = table(spark, ["Ann Lee  Ox", "éa", "", None])
    assert column(masks.mask_tail(df, ["v"], 3)) == ["Ann Lee ***", "**", "", None]
    assert column(masks.mask_word_tails(df, ["v", "absent"], 2)) == ["A** L**  **", "**", "", None]
    assert column(masks.suppress_text(df)) == ["***", "***", "***", None]


def test_numbers_become_plain_text(spark):
    df = spark.createDataFrame([(1, 12345678.5), (2, 1e16), (3, 0.0005), (4, 2.0)], "id int, v double")
    assert column(masks.mask_tail(df, ["v"], 0)) == ["12345678.5", "1.0E16", "0.0005", "2.0"]


def neighbours(texts, i, cyclic=False):
    if cyclic:
        return [texts[i - 1], texts[(i + 1) % len(texts)]]
    return [texts[j] for j in (i - 1, i + 1) if 0 <= j < len(texts)]


def adjacent(texts, l):
    out = []
    for i, own in enumerate(texts):
        def hidden(p):
            n = len(own) - p
            return n <= l and own[p].isalnum() and any(
                len(o) >= n and (o[-n] == "*" or o[-n].casefold() == own[p].casefold())
                for o in neighbours(texts, i)
            )
        out.append("".join("*" if hidden(p) else c for p, c in enumerate(own)))
    return out


@pytest.mark.parametrize("seed, l", [(1, 1), (2, 3), (3, 12)])
def test_adjacent(spark, seed, l):
    texts = random_texts(seed)
    assert column(context.mask_adjacent(table(spark, texts), ["v"], l, ["id"])) == adjacent(texts, l)


@pytest.mark.parametrize("count", [1, 4, 37])
def test_adjacent_under_any_partitioning(spark, partitions, count):
    partitions(count)
    texts = random_texts(9, 60)
    assert column(context.mask_adjacent(table(spark, texts), ["v"], 4, ["id"])) == adjacent(texts, 4)


def consistent(texts, l):
    masked, groups = adjacent(texts, l), {}
    for t, m in zip(texts, masked):
        groups.setdefault(t.casefold(), []).append((t, m))
    shown = {}
    for key, copies in groups.items():
        last = copies[-1][0]
        shown[key] = "".join(
            "*" if any(p >= len(m) or m[p] == "*" for _, m in copies) else c for p, c in enumerate(last)
        )
    return [shown[t.casefold()] for t in texts]


@pytest.mark.parametrize("seed, l", [(4, 2), (5, 5)])
def test_consistent(spark, seed, l):
    texts = random_texts(seed, 60, 3)
    got = column(context.mask_adjacent_consistently(table(spark, texts), ["v"], l, ["id"]))
    assert got == consistent(texts, l)


def test_consistent_with_many_places_and_folded_lengths(spark):
    long = "x" * 130
    texts = [long, long.upper(), "a", "Straße", "STRASSE", "b", "straße", long]
    got = column(context.mask_adjacent_consistently(table(spark, texts), ["v"], 125, ["id"]))
    assert got == consistent(texts, 125)


@pytest.mark.parametrize("seed", [6, 7])
def test_cyclic(spark, seed):
    texts = random_texts(seed)
    want = []
    for i, own in enumerate(texts):
        beside = neighbours(texts, i, cyclic=True)
        want.append("".join(
            "*" if c != " " and any(p < len(o) and o[p] == c for o in beside) else c
            for p, c in enumerate(own)
        ).rstrip())
    assert column(context.mask_cyclic(table(spark, texts), ["v"], 1, ["id"])) == want
    assert column(context.mask_cyclic(table(spark, texts), ["v"], 0, ["id"])) == [t.rstrip() for t in texts]


def test_cyclic_single_row_hides_itself(spark):
    assert column(context.mask_cyclic(table(spark, ["a b"]), ["v"], 2, ["id"])) == ["* *"]


def test_null_cells_stay_null(spark):
    df = table(spark, ["ab", None, "ab"])
    assert column(context.mask_adjacent(df, ["v"], 2, ["id"])) == ["ab", None, "ab"]
    assert column(context.mask_adjacent_consistently(df, ["v"], 2, ["id"])) == ["ab", None, "ab"]


def number(text):
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def reach(x, l):
    return l * 10 ** max(len(str(int(abs(x)))) - 2, 0)


def near(texts, l):
    found = [number(t) for t in texts]
    def hidden(i):
        return found[i] is not None and any(
            j != i and y is not None and abs(found[i] - y) <= max(reach(found[i], l), reach(y, l))
            for j, y in enumerate(found)
        )
    return ["*" * len(t) if hidden(i) else t for i, t in enumerate(texts)]


SPELLINGS = ["nan", "inf", "word", "", " 12 ", "1_000", "1__0", ".75", "1.", "5d", "1e3", "-0.0", "0x10", "1e999"]


@pytest.mark.parametrize("seed, l", [(1, 1), (2, 2), (3, 7), (4, 0), (5, 40)])
def test_near_numbers(spark, seed, l):
    rng = random.Random(seed)
    texts = [
        rng.choice([
            str(rng.randint(-50, 50) * 10 ** rng.randint(0, 6)),
            f"{rng.uniform(-9, 9) * 10 ** rng.randint(0, 7):.{rng.randint(0, 3)}f}",
        ])
        for _ in range(45)
    ] + SPELLINGS
    got = column(cover.mask_near_numbers(table(spark, texts), ["v"], l, ["id"]))
    assert got == near(texts, l)


def test_near_numbers_at_the_edges_of_digits_and_cells(spark):
    texts = ["999", "1000", "1010", "9.999999999999999", "10", "99.5", "100.5", "150", "-9", "9", "123456", "133456.1", "1e22", "1e23"]
    for l in (1, 2, 10):
        got = column(cover.mask_near_numbers(table(spark, texts), ["v"], l))
        assert got == near(texts, l), l


def test_digit_count_at_powers_of_ten(spark):
    values = [0.0, 0.3, 9.0, 9.999999999999998, 10.0, 99.99999999999999, 100.0, 999.9999999999999, 1e15,
              999999999999999.9, 1e22, 1e23, 9.999999999999999e22, 1.7e308, -1000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(cover.int_digits(F.col("x"))).collect()]
    assert got == [len(str(int(abs(v)))) for v in values]


def positional(texts, l):
    """Both passes as they read in the rule: offsets in turn, hiding as they go."""
    share = min(0.9, 0.35 + 0.05 * max(1, min(l, 10)))
    shown = list(texts)
    for right in (True, False):
        flip = (lambda s: s[::-1]) if right else (lambda s: s)
        edges = [flip(s) for s in shown]
        for n in range(1, l + 1):
            at = {i: e[n - 1] for i, e in enumerate(edges) if len(e) >= n}
            star = "*" in at.values()
            letters = {i: c.casefold() for i, c in at.items() if c.isalnum()}
            for i, c in letters.items():
                if star or list(letters.values()).count(c) >= 2:
                    short = texts[i].isdigit() and len(texts[i]) in (2, 3)
                    size = n if short else max(1, min(n, math.ceil(n * share)))
                    edges[i] = "*" * size + edges[i][size:]
        shown = [flip(e) for e in edges]
    return shown


@pytest.mark.parametrize("seed, l", [(1, 1), (2, 3), (3, 6), (4, 15)])
def test_positional_cover(spark, seed, l):
    texts = random_texts(seed, 25, 10) + ["12", "712", "33", "7777", "a2", "***", "q"]
    assert column(cover.cover_positions(table(spark, texts), ["v"], l)) == positional(texts, l)


def spread(texts, l):
    out = []
    for i, own in enumerate(texts):
        def hidden(p):
            if not own[p].isalnum() or not (p < l or len(own) - p <= l):
                return False
            for other in neighbours(texts, i):
                for spot in (p, len(other) - (len(own) - p)):
                    if any(0 <= spot + d < len(other) and other[spot + d] == "*" for d in (-1, 0, 1)):
                        return True
            return False
        out.append("".join("*" if hidden(p) else c for p, c in enumerate(own)))
    return out


@pytest.mark.parametrize("seed, l", [(1, 1), (2, 3), (3, 20)])
def test_spread(spark, seed, l):
    texts = random_texts(seed, 40, 12)
    assert column(cover.spread_masks(table(spark, texts), ["v"], l, ["id"])) == spread(texts, l)


@pytest.mark.parametrize("seed, l", [(1, 2), (2, 5)])
def test_whole_column_cover(spark, seed, l):
    rng = random.Random(seed)
    texts = random_texts(seed, 20, 8) + [str(rng.randint(0, 5000)) for _ in range(20)]
    want = spread(positional(near(texts, l), l), l)
    df = table(spark, texts).withColumn("other", F.col("id") + 1)
    got = cover.cover_columns(df, ["v"], l, ["id"])
    assert column(got) == want
    assert got.columns == ["id", "v", "other"]
    masked, info = cover.finalise_mask(
        df.withColumn("backup_v", F.col("v")), ["v"], l, ["id"], ReleaseInfo(k=3, backups={"v": "backup_v"})
    )
    assert column(masked) == want and masked.columns == ["id", "v", "other"]
    assert (info.k, info.l, info.l_columns, info.backups) == (3, l, ("v",), {})


def test_ldiversity_needs_a_column(spark):
    df = table(spark, ["ab", "cd"])
    with pytest.raises(ValueError):
        cover.ldiversity_columns(df, [], 2, ["id"])
    assert column(cover.ldiversity_columns(df, ["v"], 2, ["id"])) == ["a*", "c*"]


def test_masks_only_hide(spark):
    texts = random_texts(11, 50, 12)
    for got in (
        column(context.mask_adjacent(table(spark, texts), ["v"], 4, ["id"])),
        column(cover.cover_columns(table(spark, texts), ["v"], 4, ["id"])),
    ):
        for old, new in zip(texts, got):
            assert len(old) == len(new) and all(n in ("*", o) for o, n in zip(old, new))
