"""Masks that look at one cell at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskveil.functions import text
from duskveil.functions.names import ref, replace_columns, require, text_names


def _as_text(df: DataFrame, name: str):
    return text.plain_text(ref(name), df.schema[name].dataType)


def mask_share(df: DataFrame, columns: Sequence[str], level: str = "medium") -> DataFrame:
    """Hide 25, 50, 75 or 100 percent of each cell from the right."""
    if level not in text.LEVELS:
        raise ValueError(f"invalid level {level!r}: use one of {sorted(text.LEVELS)}")
    require(df, *columns)
    percent = text.LEVELS[level]
    return replace_columns(df, {c: text.hide_share(_as_text(df, c), percent) for c in columns})


def mask_tail(df: DataFrame, columns: Sequence[str], count: int) -> DataFrame:
    """Hide the last ``count`` characters of each cell."""
    if count < 0:
        raise ValueError("count must not be negative")
    require(df, *columns)
    return replace_columns(
        df, {c: text.hide_tail(_as_text(df, c), F.lit(count)) for c in columns}
    )


def mask_word_tails(df: DataFrame, columns: Sequence[str], count: int) -> DataFrame:
    """Hide the last ``count`` characters of every word; unknown columns are skipped."""
    known = [c for c in columns if c in df.columns]
    return replace_columns(df, {c: text.hide_tail_per_word(_as_text(df, c), count) for c in known})


def suppress_text(df: DataFrame) -> DataFrame:
    """Replace every non-null cell of every text column by ``***``."""
    return replace_columns(df, {c: text.suppress(ref(c)) for c in text_names(df)})
