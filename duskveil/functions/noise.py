"""Keyed randomness: a pure function of a secret seed and row values.

A retried or repartitioned task draws the same numbers, so a released table
never holds two different noises for one cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 1 << 52


def keyed_hash(seed: int | str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(str(seed)), *parts)


def uniform(seed: int | str, *parts: Column) -> Column:
    """Strictly between 0 and 1, exact in a double."""
    step = F.pmod(keyed_hash(seed, *parts), F.lit(_STEPS))
    return (step.cast("double") + 0.5) / float(_STEPS)


def laplace(seed: int | str, scale: float, *parts: Column) -> Column:
    """Zero-centred Laplace draw of the given scale."""
    centred = uniform(seed, *parts) - 0.5
    return F.signum(centred) * F.lit(-float(scale)) * F.log(1.0 - 2.0 * F.abs(centred))


def between(seed: int | str, low: float, high: float, *parts: Column) -> Column:
    return F.lit(float(low)) + uniform(seed, *parts) * float(high - low)


def day_shift(seed: int | str, max_days: int, *parts: Column) -> Column:
    """Whole days in [-max_days, max_days]; null if any part is null."""
    drawn = F.pmod(keyed_hash(seed, *parts), F.lit(2 * max_days + 1)) - max_days
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    return F.when(known, drawn.cast("int"))
