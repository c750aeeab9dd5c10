"""Noise, gated release and date shifting. All randomness is keyed, see functions.noise."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions import noise
from duskveil.functions.dates import FORMATS, as_moment, spellings
from duskveil.functions.names import (
    is_numeric, is_text, known, numeric_names, ref, replace_columns, require,
)
from duskveil.functions.text import finite
from duskveil.operators.masks import suppress_text

log = logging.getLogger(__name__)

#: The budgets of a locked table and of an unauthorised release.
LOCK_EPSILON = 0.01
RELEASE_EPSILON = 1.0


def laplace_noise(
    df: DataFrame,
    epsilons: dict[str, float],
    key: Sequence[str],
    seed: int | str,
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Add Laplace(0, (max - min) / epsilon) to each cell of the named numeric columns.

    ``key`` identifies a row. Ranges come from the data in one aggregate unless
    ``bounds`` gives them (a range read from the data reveals its extremes).
    Unknown and non-numeric columns are ignored, nulls stay null.
    """
    if any(e <= 0 for e in epsilons.values()):
        raise ValueError("epsilon must be positive")
    require(df, *key)
    names = [c for c in epsilons if c in df.columns and is_numeric(df, c)]
    if not names:
        return df
    bounds = bounds or {}
    unknown = [c for c in names if c not in bounds]
    spread = None

    def number(name: str):
        """A cell that counts for the range; missing and infinite ones do not."""
        return finite(known(df, name).cast("double"))

    if unknown:
        spread = df.agg(
            F.struct(
                *[
                    (F.max(number(c)) - F.min(number(c))).alias(f"r{i}")
                    for i, c in enumerate(unknown)
                ]
            )
        ).scalar()
    noisy = {}
    for c in names:
        if c in bounds:
            low, high = bounds[c]
            width = F.lit(float(high) - float(low))
        else:
            width = spread[f"r{unknown.index(c)}"]
        draw = noise.laplace(seed, 1.0, F.lit(c), *[ref(k) for k in key])
        noisy[c] = ref(c).cast("double") + draw * (width / F.lit(float(epsilons[c])))
    return replace_columns(df, noisy)


def lock_down(
    df: DataFrame, key: Sequence[str], seed: int | str, epsilon: float = LOCK_EPSILON
) -> DataFrame:
    """Suppress all text and drown all numbers in noise."""
    return suppress_text(
        laplace_noise(df, {c: epsilon for c in numeric_names(df)}, key, seed)
    )


def release(df: DataFrame, authorised: bool, key: Sequence[str], seed: int | str) -> DataFrame:
    """The table itself for an authorised caller, else a suppressed and noised one."""
    return df if authorised else lock_down(df, key, seed, RELEASE_EPSILON)


def shift_dates(
    df: DataFrame,
    id_column: str,
    date_columns: Sequence[str],
    max_days: int,
    seed: int | str,
    drop_time: bool = False,
    formats: Sequence[str] = FORMATS,
) -> DataFrame:
    """Move all dates of one subject by the same number of days within ±``max_days``.

    Text that reads as no date becomes null, and so do the dates of rows
    without an identifier. Date types keep their type, text becomes a
    timestamp; ``drop_time`` gives plain dates. A text column is read in the one
    of ``formats`` that reads most of its values, found by one aggregate; of a
    stream, or if there is one format, in the first.
    """
    if not date_columns:
        return df
    require(df, id_column)
    if max_days < 0:
        raise ValueError("max_days must not be negative")
    days = noise.day_shift(seed, max_days, ref(id_column))
    texts = [c for c in dict.fromkeys(date_columns) if c in df.columns and is_text(df, c)]
    spelled = {c: formats[0] for c in texts}
    if len(formats) > 1 and not df.isStreaming:
        spelled = {c: best for c, (best, _, _) in spellings(df, texts, formats).items()}
    shifted = {}
    for name in date_columns:
        if name not in df.columns:
            log.warning("date column %r not found, skipped", name)
            continue
        kind = df.schema[name].dataType
        if isinstance(kind, T.DateType):
            shifted[name] = F.date_add(ref(name), days)
            continue
        if isinstance(kind, T.TimestampType):
            moment = ref(name)
        else:
            moment = as_moment(ref(name), kind, spelled.get(name, formats[0]))
        moved = F.timestamp_add("DAY", days, moment)
        shifted[name] = moved.cast("date") if drop_time else moved
    return replace_columns(df, shifted)
