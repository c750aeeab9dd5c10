"""t-closeness: distributions, distance, check and suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions.names import ref, replace_columns, require
from duskveil.functions.text import SUPPRESSED
from duskveil.plans.joins import lookup_join
from duskveil.plans.release import ReleaseInfo
from duskveil.plans.scratch import stash


def _usable(name: str, exclude: str | None) -> Column:
    value = ref(name)
    return value if exclude is None else F.when(value.cast("string") != exclude, value)


def distribution(df: DataFrame, column: str, exclude: str | None = SUPPRESSED) -> DataFrame:
    """``(value, p)``: share of each value, without nulls and the suppression text."""
    require(df, column)
    counts = (
        df.select(_usable(column, exclude).alias("value"))
        .where("value is not null")
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", (F.col("n") / total).alias("p"))


def total_variation(p: DataFrame, q: DataFrame) -> DataFrame:
    """Half the summed difference of two distributions ``(value, p)``, in one row."""
    both = p.select("value", ref("p").alias("a")).join(
        q.select("value", ref("p").alias("b")), "value", "full"
    )
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.agg((F.coalesce(F.sum(gap), F.lit(0.0)) / 2).alias("tvd"))


def class_value_counts(
    df: DataFrame, quasi: Sequence[str], sensitive: str, exclude: str | None
) -> DataFrame:
    """``__g0`` …, ``__s``, ``__n``: rows per class and sensitive value, written once.

    Every check starts from these counts, so the table itself is read once.
    """
    require(df, *quasi, sensitive)
    if not quasi:
        raise ValueError("quasi-identifiers must not be empty")
    keys = class_keys(quasi)
    return stash(
        df.select(
            *[ref(q).alias(g) for q, g in zip(quasi, keys)],
            _usable(sensitive, exclude).alias("__s"),
        )
        .groupBy(*keys, "__s")
        .agg(F.count("*").alias("__n"))
    )


def class_keys(quasi: Sequence[str]) -> list[str]:
    return [f"__g{i}" for i in range(len(quasi))]


def class_distances(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """Quasi-identifiers, class size ``n`` and distance ``tvd`` to the whole table.

    Classes with a null key are left out; a class without usable values has
    distance 0.5. Only values present in a class are looked at: their excess
    over the table's share adds up to the distance. Both lookups cut a
    frequent class or value in slices.
    """
    keys = class_keys(quasi)
    pairs = class_value_counts(df, quasi, sensitive, SUPPRESSED)
    used = pairs.where("__s is not null")
    shares = used.groupBy("__s").agg(
        F.sum("__n").alias("__everywhere"), F.count("*").alias("__w")
    )
    total = used.agg(F.sum("__n")).scalar()
    inside = pairs.dropna(subset=keys)
    sizes = inside.groupBy(*keys).agg(
        F.sum("__n").alias("__rows"),
        F.sum(F.when(F.col("__s").isNotNull(), F.col("__n")).otherwise(0)).alias("__usable"),
        F.count("*").alias("__w"),
    )
    known = lookup_join(inside, sizes, keys, "__w", [*keys, "__s"])
    known = lookup_join(known, shares, ["__s"], "__w", [*keys, "__s"])
    excess = F.greatest(
        F.col("__n") / F.col("__usable") - F.col("__everywhere") / total, F.lit(0.0)
    )
    measured = known.groupBy(*keys).agg(
        F.max("__rows").alias("n"),
        F.max("__usable").alias("__usable"),
        F.sum(F.when(F.col("__s").isNotNull(), excess)).alias("__excess"),
    )
    # no usable value anywhere: nothing to be close to
    return measured.where(total.isNotNull()).select(
        *[F.col(g).alias(q) for q, g in zip(quasi, keys)],
        F.col("n"),
        F.when(F.col("__usable") == 0, 0.5).otherwise(F.col("__excess")).alias("tvd"),
    )


def violating_classes(
    df: DataFrame, quasi: Sequence[str], sensitive: str, t: float
) -> DataFrame:
    return class_distances(df, quasi, sensitive).where(F.col("tvd") > t)


def suppress_violations(
    df: DataFrame, quasi: Sequence[str], sensitive: str, t: float, key: Sequence[str]
) -> DataFrame:
    """``***`` for the sensitive value in every class farther than ``t``.

    The sensitive column becomes text. To go on after another step, pass that
    step's table.
    """
    require(df, *key)
    bad = violating_classes(df, quasi, sensitive, t).select(
        *[ref(q).alias(f"__b{i}") for i, q in enumerate(quasi)],
        F.col("n").alias("__weight"),
        F.lit(True).alias("__bad"),
    )
    keyed = df.withColumns({f"__b{i}": ref(q) for i, q in enumerate(quasi)})
    joined = lookup_join(
        keyed, bad, [f"__b{i}" for i in range(len(quasi))], "__weight", key
    )
    shown = F.when(F.col("__bad"), F.lit(SUPPRESSED)).otherwise(ref(sensitive).cast("string"))
    return replace_columns(joined, {sensitive: shown}).select(*[ref(c) for c in df.columns])


def suppress_violations_with_info(
    df: DataFrame,
    quasi: Sequence[str],
    sensitive: str,
    t: float,
    key: Sequence[str],
    info: ReleaseInfo | None = None,
) -> tuple[DataFrame, ReleaseInfo]:
    """``suppress_violations`` and what was done, added to ``info``."""
    table = suppress_violations(df, quasi, sensitive, t, key)
    return table, (info or ReleaseInfo()).with_(t=t, t_columns=tuple(quasi), sensitive=sensitive)
