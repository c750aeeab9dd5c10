"""CSV and Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.dates import FORMATS, as_moment, spellings
from duskveil.functions.names import ref, replace_columns, require

# The spellings of a missing cell in a CSV file.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_TRUE_FALSE = r"\A(?i:true|false)\z"
_WHOLE = r"\A\s*[+-]?\d+\s*\z"
#: A decimal as it is written; casts also take endings such as those of ``1d`` and ``2f``.
_DECIMAL = r"\A\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*\z"
#: Whole numbers that are too long for a long.
_LONGER = T.DecimalType(38, 0)


def _settled_type(name: str, seen) -> T.DataType:
    if seen[f"{name}_n"] == 0:
        return T.DoubleType()
    kinds = ((T.LongType(), "w"), (_LONGER, "l"), (T.DoubleType(), "f"), (T.BooleanType(), "b"))
    for kind, test in kinds:
        if seen[f"{name}_{test}"] == seen[f"{name}_n"]:
            return kind
    return T.StringType()


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header line; quoted cells may hold commas.

    Many tasks share a big file. Line breaks inside cells need
    ``multi_line=True``, which gives each file to one task.

    Without ``schema`` a column becomes whole numbers (of any length), decimals
    or booleans if all its known cells spell one, else text, so identifiers such as
    ``1d`` and ``2f`` stay apart; that takes one
    extra pass over the chosen columns, which ``schema=table.schema`` saves the
    next time. The usual spellings of a missing cell read as null either way; a
    cell that does not fit a given ``schema`` is an error.
    """
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line)
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
        cells = reader.schema(texts).csv(path)
        table = cells.select(
            *[
                F.when(~ref(f.name).isin(MISSING), ref(f.name)).cast(f.dataType).alias(f.name)
                for f in wanted.fields
                if not columns or f.name in columns
            ]
        )
        return table.select(*[ref(c) for c in columns]) if columns else table
    raw = reader.csv(path)
    if columns:
        require(raw, *columns)
        raw = raw.select(*[ref(c) for c in columns])
    known = replace_columns(raw, {c: F.when(~ref(c).isin(MISSING), ref(c)) for c in raw.columns})
    tests = []
    for i, c in enumerate(raw.columns):
        cell = ref(c)
        tests += [
            F.count(cell).alias(f"{i}_n"),
            F.count_if(cell.rlike(_WHOLE) & cell.try_cast("bigint").isNotNull()).alias(f"{i}_w"),
            F.count_if(cell.rlike(_WHOLE) & cell.try_cast(_LONGER).isNotNull()).alias(f"{i}_l"),
            F.count_if(cell.rlike(_DECIMAL) & cell.try_cast("double").isNotNull()).alias(f"{i}_f"),
            F.count_if(cell.rlike(_TRUE_FALSE)).alias(f"{i}_b"),
        ]
    seen = known.agg(*tests).first()
    typed = {
        c: ref(c).try_cast(_settled_type(str(i), seen)) for i, c in enumerate(raw.columns)
    }
    return replace_columns(known, typed)


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    formats: Sequence[str] = FORMATS,
) -> DataFrame:
    """CSV; of an explicit column list, those named like a date read as timestamps,
    each in the one of ``formats`` that reads most of its values."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"unsupported file extension: {path}")
    table = read_csv(spark, path, columns)
    if columns is None:
        return table
    dated = [c for c in columns if "date" in c.lower()]
    texts = [c for c in dated if isinstance(table.schema[c].dataType, T.StringType)]
    spelled = spellings(table, texts, formats)
    return replace_columns(
        table,
        {
            c: as_moment(ref(c), table.schema[c].dataType, *spelled[c][:1] if c in spelled else ())
            for c in dated
        },
    )


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A folder of CSV parts, each with the header line."""
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path
