"""Independent checks of a released table. Rows with a null key are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskveil.functions.names import ref, require
from duskveil.operators.closeness import class_keys, class_value_counts
from duskveil.operators.shape import tidy_names
from duskveil.plans.ordering import latest, running_sums
from duskveil.plans.scratch import stash


def _counts(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    return class_value_counts(df, quasi, sensitive, exclude=None)


def _k_ok(sizes: DataFrame, k: int) -> DataFrame:
    return sizes.agg(F.coalesce(F.min("n") >= k, F.lit(False)).alias("k_ok"))


def _l_ok(variety: DataFrame, l: int) -> DataFrame:
    return variety.agg(F.coalesce(F.bool_and(F.col("n") >= l), F.lit(True)).alias("l_ok"))


def _t_ok(distances: DataFrame, t: float) -> DataFrame:
    return distances.agg(
        F.coalesce(F.bool_and(F.col("distance") <= t), F.lit(True)).alias("t_ok")
    )


def check_k(df: DataFrame, quasi: Sequence[str], k: int) -> DataFrame:
    """``k_ok``: the smallest class has at least ``k`` rows; false if there is none."""
    require(df, *quasi)
    known = df.dropna(subset=list(quasi))
    return _k_ok(known.groupBy(*[ref(q) for q in quasi]).agg(F.count("*").alias("n")), k)


def check_l(df: DataFrame, quasi: Sequence[str], sensitive: str, l: int) -> DataFrame:
    """``l_ok``: every class holds at least ``l`` distinct sensitive values."""
    require(df, *quasi, sensitive)
    variety = (
        df.dropna(subset=list(quasi))
        .groupBy(*[ref(q) for q in quasi])
        .agg(F.countDistinct(ref(sensitive)).alias("n"))
    )
    return _l_ok(variety, l)


def frequency_distances(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """Quasi-identifiers and ``distance``: the one-dimensional Wasserstein distance
    between the list of value frequencies of the class and that of the table.

    This compares how even the two lists are, not which values they hold; it
    is not the distance that suppression uses.
    """
    measured = _list_distances(_counts(df, quasi, sensitive), class_keys(quasi))
    return measured.withColumnsRenamed(dict(zip(class_keys(quasi), quasi)))


def _list_distances(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distance per class from the (class, value) counts.

    Both lists are kept as runs of equal frequencies. A class run of share q at
    ranks a to b differs from the table's shares p by q - p where p is smaller,
    from rank t on, and by p - q before. Its part of the distance therefore
    needs three numbers of the table: t and the shares that add up to t and to b.
    They are looked up among the table's runs in order, in two exchanges.
    """
    sizes = pairs.where("__s is not null").groupBy("__s").agg(F.sum("__n").alias("n"))
    runs = sizes.groupBy("n").agg(F.count("*").alias("times"))
    runs = stash(runs.withColumns({"fall": -F.col("n"), "mass_of": F.col("n") * F.col("times")}))
    # shares fall with the rank: ``first`` rank of a run and the rows before it
    runs = stash(running_sums(runs, ["fall"], {"first": "times", "mass": "mass_of"}))
    total, values = runs.agg(F.sum("mass_of"), F.sum("times")).first()
    share_of = lambda n: F.col(n) / F.lit(float(total or 1))

    # the null value counts as frequency 0: it keeps a class without values
    known = F.when(F.col("__s").isNotNull(), F.col("__n")).otherwise(0)
    counted = (
        pairs.dropna(subset=keys)
        .groupBy(*keys, known.alias("n"))
        .agg(F.count("__s").alias("times"))
    )
    inside = Window.partitionBy(*keys)
    above = inside.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    own = stash(
        counted.withColumns(
            {
                "a": F.coalesce(F.sum("times").over(above), F.lit(0)),
                "rows": F.sum(F.col("n") * F.col("times")).over(inside),
            }
        )
        .withColumn("q", F.when(F.col("rows") > 0, F.col("n") / F.col("rows")).otherwise(0.0))
        .select(*keys, "a", (F.col("a") + F.col("times")).alias("b"), "q", (-F.col("q")).alias("below"))
    )
    # t: the ranks whose share is q or more, as far as they lie between a and b
    by_share = runs.select((-share_of("n")).alias("below"), (F.col("first") + F.col("times")).alias("end"))
    turned = latest(own, by_share, "below")
    turn = F.greatest("a", F.least("b", F.coalesce(F.col("__row.end"), F.lit(0))))
    turned = stash(turned.withColumn("t", turn).drop("__row"))
    # -2 (mass(b) - mass(t)), as two lookups by rank
    ranks = turned.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("b").alias("first"), F.lit(-2.0).alias("sign")),
                F.struct(F.col("t").alias("first"), F.lit(2.0).alias("sign")),
            )
        ),
    )
    found = latest(ranks, runs.select("first", "mass", "n"), "first")
    rank, run = F.col("first"), F.col("__row")
    mass = (run["mass"] + (rank - run["first"]) * run["n"]) / F.lit(float(total or 1))
    masses = found.select(*keys, (F.col("sign") * F.coalesce(mass, F.lit(0.0))).alias("gap"))
    q, a, b, t = (F.col(c) for c in "qabt")
    gaps = turned.select(*keys, (q * (b - t) - q * (t - a)).alias("gap")).unionByName(masses)
    distance = (F.lit(1.0) + F.sum("gap")) / F.lit(float(values) if values else None)
    return gaps.groupBy(*keys).agg(distance.alias("distance"))


def check_t(df: DataFrame, quasi: Sequence[str], sensitive: str, t: float) -> DataFrame:
    """``t_ok``: no class is farther than ``t`` by ``frequency_distances``."""
    return _t_ok(frequency_distances(df, quasi, sensitive), t)


def verify_release(
    df: DataFrame,
    quasi: Sequence[str],
    sensitive: str,
    k: int = 4,
    l: int = 3,
    t: float = 0.2,
) -> DataFrame:
    """One row ``(k_ok, l_ok, t_ok)``; column names are trimmed and lower-cased first.

    All three checks read one table of (class, value) counts.
    """
    tidy = tidy_names(df)
    names = [q.strip().lower() for q in quasi if q.strip().lower() in tidy.columns]
    if not names:
        raise ValueError("no valid quasi-identifier column")
    value = sensitive.strip().lower()
    require(tidy, value)
    keys = class_keys(names)
    pairs = _counts(tidy, names, value)
    classes = pairs.dropna(subset=keys).groupBy(*keys)
    return df.sparkSession.range(1).select(
        _k_ok(classes.agg(F.sum("__n").alias("n")), k).scalar().alias("k_ok"),
        _l_ok(classes.agg(F.count("__s").alias("n")), l).scalar().alias("l_ok"),
        _t_ok(_list_distances(pairs, keys), t).scalar().alias("t_ok"),
    )
