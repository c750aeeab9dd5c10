"""Projections, filters, ordering and date features."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.dates import FORMATS, ISO, as_moment, date_parts, ordinal, spellings
from duskveil.functions.names import (
    is_numeric,
    is_temporal,
    known,
    numeric_names,
    ref,
    require,
    text_names,
)
from duskveil.plans.joins import lookup_join
from duskveil.plans.scratch import stash

PREVIEW_ROWS = 100

#: Parts of a plan whose input Spark may read twice.
_SAMPLING = r"Sort \[.*\], true|RepartitionByExpression"


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        raise ValueError("no columns selected")
    require(df, *columns)
    return df.select(*[ref(c) for c in columns])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def filter_rows(df: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    """Keep rows for which the predicate is true; unknown counts as false."""
    return df.filter(F.coalesce(predicate(df), F.lit(False)))


def transform_table(
    df: DataFrame, change: Callable[[DataFrame], DataFrame], check_rows: bool = False
) -> DataFrame:
    """Apply a table function; ``check_rows`` rejects one that changes the row count.

    Both counts are observed while the result is written, in one action, and
    the written table is returned. A plan that reads the table more than once or
    samples it may observe other counts; there both tables are counted, as they
    are if the observed counts differ.
    """
    if not check_rows:
        return df.transform(change)
    before, after = Observation(), Observation()
    watched = df.observe(before, F.count(F.lit(1)).alias("n")).transform(change)
    changed = watched.observe(after, F.count(F.lit(1)).alias("n"))
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    once = plan.count("CollectMetrics") == 2 and not re.search(_SAMPLING, plan)
    written = stash(changed)
    if not once or before.get["n"] != after.get["n"]:
        if written.count() != df.count():
            raise ValueError("the transform must keep the row count; use filter_rows to drop rows")
    return written


def sort_rows(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Nulls last both ways."""
    require(df, column)
    by = ref(column).asc_nulls_last() if ascending else ref(column).desc_nulls_last()
    return df.orderBy(by)


def preview(df: DataFrame, order_by: Sequence[str] = (), rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows; with ``order_by`` a top-k that never sorts the whole table."""
    ordered = df.orderBy(*[ref(c) for c in order_by]) if order_by else df
    return ordered.limit(rows)


def numeric_columns(df: DataFrame) -> DataFrame:
    names = numeric_names(df)
    if not names:
        raise ValueError("no numeric columns")
    return df.select(*[ref(n) for n in names])


def tidy_names(df: DataFrame) -> DataFrame:
    """Trim and lower-case the column names."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after tidying: {names}")
    return df.toDF(*names)


def drop_missing_numbers(df: DataFrame, column: str, least: int = 2) -> DataFrame:
    """Rows with a number in ``column``; needs at least ``least`` of them."""
    require(df, column)
    if not is_numeric(df, column):
        raise ValueError(f"{column} is not numeric")
    present = df.where(known(df, column).isNotNull())
    if present.limit(least).count() < least:
        raise ValueError(f"{column} needs at least {least} values")
    return present


def date_like_columns(df: DataFrame, formats: Sequence[str] = FORMATS) -> DataFrame:
    """``column_name`` of date columns and of text columns all of whose known values
    read as dates in one of ``formats``. One aggregate over all values."""
    texts = _readable(df, text_names(df), True, formats)
    found = [n for n in df.columns if is_temporal(df, n) or n in texts]
    return df.sparkSession.createDataFrame([(n,) for n in found], "column_name string")


def _readable(
    df: DataFrame, names: Sequence[str], all_values: bool, formats: Sequence[str]
) -> dict[str, str]:
    """Text columns that read as dates, all known values or at least one, and the format."""
    return {
        n: spelling
        for n, (spelling, read, total) in spellings(df, names, formats).items()
        if read > 0 and (not all_values or read == total)
    }


def expand_dates(df: DataFrame, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Replace each date column by its year, month and day columns.

    A text column counts if one format reads all its known values. Numbers
    stay. A part that would take the name of another column is an error.
    """
    texts = _readable(df, text_names(df), True, formats)
    out, parts = [], {}
    for name in df.columns:
        if is_temporal(df, name) or name in texts:
            moment = as_moment(ref(name), df.schema[name].dataType, texts.get(name, ISO))
            _add_all(parts, date_parts(name, moment))
        else:
            out.append(name)
    _add_all({n: None for n in out}, parts)
    return df.select(*[ref(n) for n in out], *[c.alias(n) for n, c in parts.items()])


def _add_all(columns: dict[str, Column], new: dict[str, Column]) -> None:
    taken = sorted(set(columns) & set(new))
    if taken:
        raise ValueError(f"column names collide: {taken}")
    columns.update(new)


def feature_columns(
    df: DataFrame, date_pair: tuple[str, str] | None = None, formats: Sequence[str] = FORMATS
) -> dict[str, Column]:
    """Numeric features of a table: its numbers, and date parts of what reads as a date.

    The two columns of ``date_pair`` become the day numbers ``admit_ord`` and
    ``disch_ord`` and their difference ``los_days``.
    """
    texts = _readable(df, text_names(df), False, formats)
    features: dict[str, Column] = {}
    days: dict[str, Column] = {}
    named = dict(zip(date_pair, ("admit_ord", "disch_ord"))) if date_pair else {}
    for name in df.columns:
        if is_numeric(df, name):
            _add_all(features, {name: known(df, name).cast("double")})
        elif is_temporal(df, name) or name in texts:
            moment = as_moment(ref(name), df.schema[name].dataType, texts.get(name, ISO))
            if name in named:
                days[named[name]] = ordinal(moment).cast("double")
            else:
                parts = date_parts(name, moment)
                _add_all(features, {n: c.cast("double") for n, c in parts.items()})
    features.update({n: days[n] for n in ("admit_ord", "disch_ord") if n in days})
    if len(days) == 2:
        features["los_days"] = days["disch_ord"] - days["admit_ord"]
    return features


def sanitise_features(
    df: DataFrame,
    row_key: Sequence[str],
    group: str | None = None,
    date_pair: tuple[str, str] | None = None,
) -> DataFrame:
    """Numeric features only, missing values filled by the column mean (per group).

    ``row_key`` and ``group`` are kept as ``__key…`` and ``__group`` columns
    only while filling; the group comes back as a feature if it is numeric.
    """
    features = feature_columns(df, date_pair)
    names = list(features)
    base = df.select(
        *[ref(c).alias(f"__key{i}") for i, c in enumerate(row_key)],
        *([ref(group).alias("__group")] if group else []),
        *[c.alias(n) for n, c in features.items()],
    )
    means = [F.avg(ref(n)).alias(f"__mean{i}") for i, n in enumerate(names)]
    if group is None:
        average = base.agg(F.struct(*means)).scalar()
        return base.select(
            *[F.coalesce(ref(n), average[f"__mean{i}"]).alias(n) for i, n in enumerate(names)]
        )
    table = base.groupBy("__group").agg(F.count("*").alias("__weight"), *means)
    keys = [f"__key{i}" for i in range(len(row_key))]
    known = lookup_join(base, table, ["__group"], "__weight", keys)
    return known.select(
        *[F.coalesce(ref(n), F.col(f"__mean{i}")).alias(n) for i, n in enumerate(names)]
    )


__all__ = [
    "date_like_columns", "drop_missing_numbers", "expand_dates", "feature_columns",
    "filter_rows", "numeric_columns", "preview", "rename_columns", "sanitise_features",
    "select_columns", "sort_rows", "tidy_names", "transform_table",
]
