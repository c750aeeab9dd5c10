"""Lookup join that stays balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.names import ref
from duskveil.plans.scratch import stash

#: Rows of one key that a single task takes; bigger keys are cut in slices.
SLICE_ROWS = 5_000_000
#: Slices over which rows without a key are spread.
NULL_SLICES = 1024

#: Most bytes of a counted table that is sent to every task.
BROADCAST_BYTES = 64 << 20

_SLICE = "__slice"
_SLICES = "__slices"


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str,
    row_key: Sequence[str],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Left join of ``df`` to ``table`` (one row per key) on ``keys``.

    ``weight`` names a column of ``table`` with the number of ``df`` rows of
    that key. A key of more than ``slice_rows`` rows is cut in slices by the
    hash of ``row_key`` and its table row is repeated per slice. The hashes of
    such keys are broadcast, 16 bytes each; there are at most rows(df) / slice_rows.
    Rows with a null key match nothing and are spread as well. The table is
    written first, since it is read twice: for that list and for the join.
    """
    table = stash(table)
    key_hash = F.xxhash64(*[ref(k) for k in keys])
    hot = (
        table.where(ref(weight) > slice_rows)
        .groupBy(key_hash.alias("__hot"))
        .agg(F.max(F.ceil(ref(weight) / float(slice_rows))).cast("int").alias(_SLICES))
    )
    spread = F.xxhash64(*[ref(k) for k in row_key])
    keyless = ~all_of([ref(k).isNotNull() for k in keys])
    left = df.join(F.broadcast(hot), key_hash == F.col("__hot"), "left").withColumn(
        _SLICE,
        F.when(keyless, F.pmod(spread, F.lit(NULL_SLICES)))
        .when(F.col(_SLICES).isNotNull(), F.pmod(spread, F.col(_SLICES)))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    left = left.drop(_SLICES, "__hot")
    # keys that share a hash share its slices
    sliced = table.join(F.broadcast(hot), key_hash == F.col("__hot"), "left")
    right = sliced.withColumn(
        _SLICE, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SLICES), F.lit(1)) - 1))
    ).select(
        *[ref(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        F.col(_SLICE).alias("__key_slice"),
        *[ref(c) for c in table.columns if c not in keys and c != weight],
    )
    on = [ref(k) == F.col(f"__key_{i}") for i, k in enumerate(keys)]
    on.append(F.col(_SLICE) == F.col("__key_slice"))
    joined = left.join(right, all_of(on), "left")
    return joined.drop(
        _SLICE, "__key_slice", *[f"__key_{i}" for i in range(len(keys))]
    )


def row_join(df: DataFrame, table: DataFrame, keys: Sequence[str], own: Sequence[str]) -> DataFrame:
    """Every row of ``df`` with the columns of its row in ``table``.

    ``own`` names the key columns of ``table``. A key is matched as a whole, so
    parts may be null; a key that ``table`` holds twice raises an error, since
    its rows cannot be told apart. The copies are counted in the exchange that
    the join needs anyway.
    """
    checked = unique_rows(table, own)
    left = df.withColumn("__whole", F.struct(*[ref(k) for k in keys]))
    rest = [c for c in checked.columns if c not in own]
    right = checked.select(*[ref(c) for c in rest])
    return left.join(right, F.col("__whole") == F.col("__own"), "left").drop("__whole", "__own")


def unique_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with its whole key in ``__own``; a key held twice raises an error."""
    whole = F.struct(*[ref(k) for k in keys])
    copies = F.count("*").over(Window.partitionBy("__own"))
    twice = F.raise_error(F.lit(f"the key {list(keys)} is held by more than one row"))
    checked = table.withColumn("__own", whole).withColumn("__copies", copies)
    kept = F.when(F.col("__copies") > 1, twice.cast(checked.schema["__own"].dataType))
    return checked.withColumn("__own", kept.otherwise(F.col("__own"))).drop("__copies")


def _width(data_type: T.DataType) -> int:
    if isinstance(data_type, T.StructType):
        return sum(_width(f.dataType) for f in data_type.fields)
    return 16 if isinstance(data_type, (T.NumericType, T.BooleanType, T.DateType)) else 64


def counted_join(
    df: DataFrame,
    table: DataFrame,
    rows: int,
    key: str | Sequence[str],
    weight: str,
    row_key: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``lookup_join`` to a narrow table of known size ``rows``, which is broadcast
    as long as it is small: its rows times the width of its columns, which are
    numbers or short keys."""
    keys = [key] if isinstance(key, str) else list(key)
    if rows * sum(_width(f.dataType) for f in table.schema.fields) > broadcast_bytes:
        return lookup_join(df, table, keys, weight, row_key)
    return df.join(F.broadcast(table.drop(weight)), keys, "left")
