"""Column profiles before and after a release step, as long tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.names import is_numeric, is_text, ref, require
from duskveil.operators.kanon import k_metric
from duskveil.plans.release import ReleaseInfo
from duskveil.plans.scratch import stash

TOP_VALUES = 10
#: A longer value is exchanged as so many characters and a digest.
HEAD_CHARS = 64
#: Counters of a column in a task, and most values of a column that are counted as
#: candidates for the most frequent ones.
HELD_VALUES, MOST_CANDIDATES = 2048, 8192


def _as_text(df: DataFrame, name: str) -> Column:
    """Text of a cell; not-a-number counts as missing."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(ref(name)), ref(name)).cast("string")
    return ref(name).cast("string")


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column_name, head, digest, value)`` of the known cells: a long value is
    told by its first characters and a digest."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), _as_text(df, c).alias("value")) for c in names]
    )
    long = F.length("value") > HEAD_CHARS
    return df.select(F.inline(cells)).where("value is not null").select(
        "column_name",
        F.left("value", F.lit(HEAD_CHARS)).alias("head"),
        F.when(long, F.sha2("value", 256)).alias("digest"),
        "value",
    )


def _value_counts(df: DataFrame) -> DataFrame:
    """``(column_name, head, digest, n)`` over all columns in one pass.

    Long texts do not travel: they count under their digest.
    """
    return (
        _cells(df, df.columns).groupBy("column_name", "head", "digest").agg(F.count("*").alias("n"))
    )


def dataset_header(df: DataFrame, info: ReleaseInfo | None = None) -> DataFrame:
    """One row: size, whether k and ℓ were applied, their values."""
    info = info or ReleaseInfo()
    applied = bool(info.k_columns) or info.k is not None
    k_value = F.lit(info.k).cast("bigint")
    if info.k is None and info.k_columns:
        k_value = k_metric(df, info.k_columns).scalar()
    return df.agg(F.count("*").alias("num_rows")).select(
        "num_rows",
        F.lit(len(df.columns)).alias("num_columns"),
        F.lit(applied).alias("k_anonymized"),
        F.lit(info.l is not None).alias("l_diversity"),
        k_value.alias("k_value"),
        F.lit(info.l).cast("bigint").alias("l_value"),
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, missing, known, distinct known; mean and sample
    standard deviation of numbers, rounded half to even to 2 digits.

    Exact distinct counts exchange every distinct value once; ``approximate``
    estimates them in the same pass as the rest, without that exchange.
    """
    wide = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        if is_numeric(df, c):
            number = ref(c).cast("double")
            number = F.when(~F.isnan(number), number)
            wide += [F.avg(number).alias(f"m{i}"), F.stddev_samp(number).alias(f"s{i}")]
        if approximate:
            wide += [
                F.count(_as_text(df, c)).alias(f"n{i}"),
                F.approx_count_distinct(_as_text(df, c)).alias(f"d{i}"),
            ]
    none = F.lit(None).cast("double")
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                F.col("rows"),
                *([F.col(f"n{i}").alias("known"), F.col(f"d{i}").alias("distinct")] if approximate else []),
                (F.bround(f"m{i}", 2) if is_numeric(df, c) else none).alias("mean"),
                (F.bround(f"s{i}", 2) if is_numeric(df, c) else none).alias("std"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    figures = df.agg(*wide).select(F.inline(lines))
    if not approximate:
        # the same counts as in top_values: one shuffle serves both in a report
        values = _value_counts(df).groupBy("column_name").agg(
            F.count("*").alias("distinct"), F.sum("n").alias("known")
        )
        figures = figures.join(values, "column_name", "left")
    known = F.coalesce("known", F.lit(0))
    return figures.select(
        "column_name",
        "dtype",
        (F.col("rows") - known).alias("missing"),
        known.alias("non_null"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "mean",
        "std",
    )


def _frequent(df: DataFrame, held: int) -> DataFrame:
    """``(i, code, least, error)``: the hashes of the frequent known values of each
    column, with a count that is at most ``error`` too low; other values occur
    ``error`` times at most, a ``held``-th of the rows or less.

    A task keeps ``held`` counters per column. When there are more, the next
    largest count is taken off all of them and added to the error, so sums of
    summaries are summaries of all rows.
    """
    codes = df.select(
        *[
            F.when(_as_text(df, c).isNotNull(), F.xxhash64(_as_text(df, c))).alias(f"c{i}")
            for i, c in enumerate(df.columns)
        ]
    )
    width = len(df.columns)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(width)]
        errors = np.zeros(width, np.int64)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                own = column.drop_null().to_numpy()
                both = np.concatenate([kept[i][0], own])
                times = np.concatenate([kept[i][1], np.ones(len(own), np.int64)])
                values, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, weights=times, minlength=len(values)).astype(np.int64)
                if len(values) > held:
                    off = np.partition(counts, len(counts) - held - 1)[len(counts) - held - 1]
                    errors[i] += off
                    values, counts = values[counts > off], counts[counts > off] - off
                kept[i] = values, counts
        for i, (values, counts) in enumerate(kept):
            # a row without a value carries the error
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(values) + 1, i, np.int32)),
                    pa.array([*values.tolist(), None], pa.int64()),
                    pa.array(np.append(counts, errors[i])),
                ],
                names=["i", "code", "least"],
            )

    parts = codes.mapInArrow(summarise, "i int, code bigint, least bigint")
    sums = stash(parts.groupBy("i", "code").agg(F.sum("least").alias("least")))
    errors = sums.where("code is null").select("i", F.col("least").alias("error"))
    return sums.where("code is not null").join(F.broadcast(errors), "i")  # a row per column


def _candidates(df: DataFrame, rows: int, held: int, most: int) -> tuple[list[int], DataFrame]:
    """Columns whose first ``rows`` values are surely among few candidates, and the
    hashes of those: all that may reach the ``rows``-th certain count."""
    found = stash(_frequent(df, held))
    by_count = Window.partitionBy("i").orderBy(F.desc("least"))
    least = found.withColumn("at", F.row_number().over(by_count)).where(F.col("at") == rows)
    placed = found.join(F.broadcast(least.select("i", F.col("least").alias("edge"))), "i", "left")
    edge = F.coalesce(F.when(F.col("edge") > 2 * F.col("error"), F.col("edge")), F.lit(0))
    chosen = placed.where(F.col("least") + F.col("error") >= edge)
    told = (F.col("edge") > 2 * F.col("error")) | (F.col("error") == 0)
    summary = chosen.groupBy("i").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(told, F.lit(False))).alias("told"))
    sure = sorted(r["i"] for r in summary.where(F.col("told") & (F.col("n") <= most)).collect())
    return sure, chosen.where(F.col("i").isin(sure)).select("i", "code")


def top_values(
    df: DataFrame, rows: int = TOP_VALUES, held: int = HELD_VALUES, most: int = MOST_CANDIDATES
) -> DataFrame:
    """The most frequent known values of each column, ties by value.

    A summary of frequent values picks candidates with a proven error, and only
    those are counted. Where it cannot tell the ``rows``-th value from the rest, the
    distinct values of the column are counted. Texts longer than ``HEAD_CHARS``
    count under their digest; values that share count and first characters are one
    row until the rows are known that hold the winners, and whole texts are looked up
    for those alone.
    """
    sure, codes = _candidates(df, rows, held, most)
    named = {c: i for i, c in enumerate(df.columns)}
    counted = ["column_name", "head", "digest"]
    counts = []
    if sure:
        # ``most`` hashes per column at most
        cells = _cells(df, [df.columns[i] for i in sure])
        numbers = F.create_map(*[x for c, i in named.items() for x in (F.lit(c), F.lit(i))])
        coded = cells.withColumns({"i": numbers[F.col("column_name")], "code": F.xxhash64("value")})
        near = coded.join(F.broadcast(codes), ["i", "code"], "left_semi")
        counts.append(near.groupBy(*counted).agg(F.count("*").alias("n")))
    others = [c for c, i in named.items() if i not in sure]
    if others:
        counts.append(_cells(df, others).groupBy(*counted).agg(F.count("*").alias("n")))
    best = _leading_groups(reduce(DataFrame.unionByName, counts), rows)
    texts = [c for c in df.columns if is_text(df, c)]
    if texts:
        best = _whole_texts(df, stash(best), texts, most)
    by_value = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("head"))
    return (
        best.select("column_name", F.col("head").alias("value"), "n", F.row_number().over(by_value).alias("rank"))
        .where(F.col("rank") <= rows)
    )


def _leading_groups(counts: DataFrame, rows: int) -> DataFrame:
    """``(column_name, n, head, long, size)``: the values of one column that share count
    and first characters as one row, as many rows as it takes to hold the first
    ``rows`` values. No two rows of a column tie, so none but those reach the window."""
    groups = counts.groupBy("column_name", "n", "head", F.col("digest").isNotNull().alias("long")).agg(
        F.count("*").alias("size")
    )
    # a whole value comes before those that go on behind it
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("head"), F.asc("long"))
    before = F.sum("size").over(by_count.rowsBetween(Window.unboundedPreceding, -1))
    first = groups.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= rows)
    return first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < rows).drop("rank", "before")


def _whole_texts(df: DataFrame, best: DataFrame, texts: Sequence[str], most: int) -> DataFrame:
    """``(column_name, head, n)`` of the values of the groups ``best``, long ones in
    full. Only texts that begin as a group does are read again, and of those only
    the digests are exchanged first if the groups hold ``most`` values or fewer."""
    # ``rows`` groups of a column at most
    groups = best.where("long").select("column_name", "head", "size").collect()
    if not groups:
        return best.select("column_name", "head", "n")
    begins = [
        (F.col("column_name") == c) & (F.col("head") == h)
        for c, h in dict.fromkeys((r["column_name"], r["head"]) for r in groups)
    ]
    long = _cells(df, texts).where(F.col("digest").isNotNull() & reduce(lambda a, b: a | b, begins))
    chosen = F.broadcast(best.where("long").select("column_name", "head", "n"))
    if sum(r["size"] for r in groups) <= most:
        told = long.groupBy("column_name", "head", "digest").agg(F.count("*").alias("n"))
        told = told.join(chosen, ["column_name", "head", "n"], "left_semi").select("column_name", "digest")
        long = long.join(F.broadcast(told), ["column_name", "digest"], "left_semi")
    # equal texts meet in their task before they are exchanged
    whole = long.groupBy("column_name", "head", "digest").agg(
        F.count("*").alias("n"), F.min("value").alias("whole")
    )
    whole = whole.join(chosen, ["column_name", "head", "n"], "left_semi").select(
        "column_name", F.col("whole").alias("head"), "n"
    )
    return best.where("not long").select("column_name", "head", "n").unionByName(whole)


def changed_columns(df: DataFrame, original: DataFrame, key: Sequence[str]) -> DataFrame:
    """``column_name`` of columns of which type or any cell differs, nulls being equal."""
    require(df, *key)
    require(original, *key)
    shared = [c for c in df.columns if c in original.columns]
    retyped = {c for c in shared if df.schema[c].dataType != original.schema[c].dataType}
    left = df.select(
        *[ref(c).alias(f"k{i}") for i, c in enumerate(key)],
        *[ref(c).alias(f"a{i}") for i, c in enumerate(shared)],
        F.lit(True).alias("left"),
    )
    right = original.select(
        *[ref(c).alias(f"k{i}") for i, c in enumerate(key)],
        *[ref(c).alias(f"b{i}") for i, c in enumerate(shared)],
        F.lit(True).alias("right"),
    )
    # keys as a whole, so that null keys meet too
    names = [f"k{i}" for i in range(len(key))]
    left = left.withColumn("key", F.struct(*names)).drop(*names)
    right = right.withColumn("key", F.struct(*names)).drop(*names)
    both = left.join(right, "key", "full")
    alone = F.col("left").isNull() | F.col("right").isNull()
    tests = []
    for i, c in enumerate(shared):
        differs = F.lit(True) if c in retyped else ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
        tests.append(F.coalesce(F.max(alone | differs), F.lit(c in retyped)).alias(f"d{i}"))
    lines = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("changed"))
            for i, c in enumerate(shared)
        ]
    )
    return both.agg(*tests).select(F.inline(lines)).where("changed").select("column_name")


def summary_report(df: DataFrame, info: ReleaseInfo | None = None) -> DataFrame:
    """``(section, metric, value)``: header, column figures and top values as text."""
    header = dataset_header(df, info)
    figures = column_profile(df)

    def lines(table: DataFrame, section: Column, names: Sequence[str]) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("value"))
                for n in names
            ]
        )
        return table.select(section.alias("section"), F.inline(pairs)).where("value is not null")

    counts = top_values(df).select(
        F.col("column_name").alias("section"),
        F.concat(F.lit("count of "), "value").alias("metric"),
        F.col("n").cast("string").alias("value"),
    )
    return (
        lines(header, F.lit("dataset"), header.columns)
        .unionByName(lines(figures, F.col("column_name"), figures.columns[1:]))
        .unionByName(counts)
    )
