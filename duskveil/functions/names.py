"""Column references that are safe for names holding blanks or dots."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numbers only: a boolean column is not numeric here."""
    return isinstance(df.schema[name].dataType, T.NumericType)


def known(df: DataFrame, name: str) -> Column:
    """The column; not-a-number is a missing number, everywhere in this library."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(ref(name)), ref(name))
    return ref(name)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(
        df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.CharType, T.VarcharType))


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_names(df: DataFrame) -> list[str]:
    return [n for n in df.columns if is_text(df, n)]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace or add columns in one projection, keeping the column order."""
    kept = [new[n].alias(n) if n in new else ref(n) for n in df.columns]
    added = [c.alias(n) for n, c in new.items() if n not in df.columns]
    return df.select(*kept, *added)


def literal_array(values: Sequence, element: str) -> Column:
    """A constant array as one folded expression, however long it is."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element}>")
