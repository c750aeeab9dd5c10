"""k-anonymity: metric, microaggregation, strategy choice and restore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskveil.functions.names import (
    is_numeric, is_temporal, known, ref, replace_columns, require,
)
from duskveil.operators.mondrian import mondrian
from duskveil.plans.joins import row_join, unique_rows
from duskveil.plans.ordering import NUMBER, number_rows
from duskveil.plans.release import ReleaseInfo

EN_DASH = "–"
BACKUP = "backup_"


def k_metric(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Size of the smallest class over ``quasi``; null keys form classes too."""
    if not quasi:
        raise ValueError("quasi-identifiers must not be empty")
    require(df, *quasi)
    sizes = df.groupBy(*[ref(q) for q in quasi]).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("k"))


def _rounded(df: DataFrame, name: str) -> Column:
    if is_numeric(df, name):
        return F.bround(known(df, name)).try_cast("bigint")
    if is_temporal(df, name):
        return ref(name).cast("date")
    return ref(name).cast("string")


def _position(df: DataFrame, name: str, rounded: Column) -> Column:
    """The number that places a value on its axis."""
    if is_temporal(df, name):
        return F.unix_date(rounded).cast("double")
    return rounded.cast("double")


def _number_label(low: Column, high: Column, k: int) -> Column:
    gap = max(1, k // 2)
    floor = F.when(low >= 0, F.greatest(low - gap, F.lit(0))).otherwise(low - gap)
    start = F.when(low == high, floor).otherwise(low)
    end = F.when(low == high, high + gap).otherwise(high)
    label = F.concat(start.cast("string"), F.lit(EN_DASH), end.cast("string"))
    return F.coalesce(label, F.lit(""))


def _date_label(low: Column, high: Column) -> Column:
    first, last = (F.date_format(d, "yyyy-MM-dd") for d in (low, high))
    label = F.when(low == high, first).otherwise(F.concat(first, F.lit(f" {EN_DASH} "), last))
    return F.coalesce(label, F.lit(""))


def microaggregate(
    df: DataFrame,
    quasi: Sequence[str],
    k: int,
    key: Sequence[str],
    keep_backup: bool = False,
) -> DataFrame:
    """Replace quasi-identifiers by what groups of ``k`` similar rows share.

    Rows are put in order of the sum of their standardised quasi-identifiers
    (rounded to 9 digits, missing last, then ``key``) and cut in groups of
    ``k``; a short last group joins its predecessor. Runs one aggregate for
    the moments and writes the narrow ordered table; the wide rows move once,
    in the join on the unique ``key``.
    """
    require(df, *quasi, *key)
    if not quasi:
        raise ValueError("quasi-identifiers must not be empty")
    if k <= 1:
        return df
    narrow = df.select(
        *[ref(c) for c in key],
        *[_rounded(df, q).alias(f"__q{i}") for i, q in enumerate(quasi)],
    )
    placed = {
        i: _position(df, q, F.col(f"__q{i}"))
        for i, q in enumerate(quasi)
        if is_numeric(df, q) or is_temporal(df, q)
    }
    moments = [F.count("*").alias("n")]
    for i, position in placed.items():
        moments += [F.avg(position).alias(f"m{i}"), F.stddev_pop(position).alias(f"s{i}")]
    seen = narrow.agg(*moments).first()
    if seen["n"] < k:
        raise ValueError(f"{seen['n']} rows cannot be made {k}-anonymous")

    score = F.lit(0.0)
    for i, position in placed.items():
        spread = seen[f"s{i}"] or 1.0
        score = score + (position - F.lit(seen[f"m{i}"])) / F.lit(spread)
    scored = narrow.withColumn("__score", F.round(score, 9))
    order = [F.col("__score").asc_nulls_last(), *[ref(c).asc() for c in key]]
    numbered = number_rows(scored, order)
    last_group = max(numbered.rows // k - 1, 0)
    grouped = numbered.df.withColumn(
        "__group", F.least(F.floor((F.col(NUMBER) - 1) / k), F.lit(last_group))
    )

    members = Window.partitionBy("__group")
    labels = {}
    for i, q in enumerate(quasi):
        column = F.col(f"__q{i}")
        low, high = F.min(column).over(members), F.max(column).over(members)
        if is_numeric(df, q):
            labels[q] = _number_label(low, high, k)
        elif is_temporal(df, q):
            labels[q] = _date_label(low, high)
        else:
            labels[q] = F.coalesce(F.mode(column, True).over(members), F.lit(""))
    aliases = {q: f"__label{i}" for i, q in enumerate(quasi)}
    labelled = grouped.select(
        *[ref(c) for c in key], *[c.alias(aliases[q]) for q, c in labels.items()]
    )
    return put_back(df, labelled, aliases, key, keep_backup)


def put_back(
    df: DataFrame,
    labelled: DataFrame,
    aliases: dict[str, str],
    key: Sequence[str],
    keep_backup: bool,
) -> DataFrame:
    """Join the new values to the other columns; skip the join if none is left.

    Every row keeps its place; a key that two rows hold is an error."""
    rest = [c for c in df.columns if c not in aliases and c not in key]
    if not rest and not keep_backup and not set(aliases) & set(key):
        joined = unique_rows(labelled, key).where("__own is not null")
    else:
        joined = row_join(df, labelled, key, key)
    backups = [ref(q).alias(BACKUP + q) for q in aliases] if keep_backup else []
    return joined.select(
        *[F.col(aliases[c]).alias(c) if c in aliases else ref(c) for c in df.columns],
        *backups,
    )


def restore(df: DataFrame, backups: dict[str, str] | None = None) -> DataFrame:
    """Copy backup columns over the quasi-identifiers and drop them."""
    found = backups or {
        c[len(BACKUP):]: c
        for c in df.columns
        if c.startswith(BACKUP) and c[len(BACKUP):] in df.columns
    }
    found = {q: b for q, b in found.items() if b in df.columns}
    if not found:
        raise ValueError("no backup columns to restore from")
    return replace_columns(df, {q: ref(b) for q, b in found.items()}).drop(*found.values())


def kanonymize(
    df: DataFrame,
    quasi: Sequence[str],
    k: int,
    key: Sequence[str],
    strategy: str = "micro",
    keep_backup: bool = False,
) -> DataFrame:
    """Make ``df`` k-anonymous by the strategy ``micro`` or ``mondrian``."""
    if strategy == "micro":
        return microaggregate(df, quasi, k, key, keep_backup)
    if strategy == "mondrian":
        labelled, aliases = mondrian(df, quasi, k, key)
        return put_back(df, labelled, aliases, key, keep_backup)
    raise ValueError(f"unknown strategy {strategy!r}: use 'micro' or 'mondrian'")


def kanonymize_with_info(
    df: DataFrame,
    quasi: Sequence[str],
    k: int,
    key: Sequence[str],
    strategy: str = "micro",
    keep_backup: bool = False,
    info: ReleaseInfo | None = None,
) -> tuple[DataFrame, ReleaseInfo]:
    """``kanonymize`` and what was done, added to ``info``."""
    table = kanonymize(df, quasi, k, key, strategy, keep_backup)
    backups = {q: BACKUP + q for q in quasi} if keep_backup and k > 1 else {}
    return table, (info or ReleaseInfo()).with_(k=k, k_columns=tuple(quasi), backups=backups)
