"""Array variables turned into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.names import ref


def arrays_to_rows(
    df: DataFrame, variables: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per index of the array columns, all cut to the shortest.

    Columns that are no arrays are skipped, nested arrays are flattened first.
    ``keep`` repeats other columns; the index is ``pos``.
    """
    named = variables if variables is not None else df.columns
    arrays = {
        c: _flat(df, c) for c in named if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)
    }
    if not arrays:
        raise ValueError("no array variables")
    sizes = [F.size(a) for a in arrays.values()]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    cut = [F.slice(a, F.lit(1), F.greatest(shortest, F.lit(0))).alias(c) for c, a in arrays.items()]
    rows = df.select(*[ref(c) for c in keep], F.posexplode(F.arrays_zip(*cut)).alias("pos", "__row"))
    return rows.select(
        *[ref(c) for c in keep], "pos", *[F.col("__row").getField(c).alias(c) for c in arrays]
    )


def _flat(df: DataFrame, name: str):
    column, kind = ref(name), df.schema[name].dataType.elementType
    while isinstance(kind, T.ArrayType):
        column, kind = F.flatten(column), kind.elementType
    return column
