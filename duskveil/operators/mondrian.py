"""Multidimensional median partitioning (LeFevre et al., ICDE 2006).

Big classes are cut level by level on the executors. The cut is the exact lower
median at every size: a sketch bounds it from both sides, and only the values
between the bounds are counted one by one. The cuts of a level are a small written
table; the rows follow the cuts of several levels while they are read, and are
written again only then, without the classes that are no longer open. A class of
``local_rows`` or fewer (more in large tables) leaves the levels and is finished
inside one task, by the same rule, beside the others of its kind; a class that is too big for that but
impossible to cut (for example many equal rows) is final and never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.dates import as_moment, spellings
from duskveil.functions.names import is_numeric, is_temporal, is_text, known, ref, require
from duskveil.functions.text import number_in
from duskveil.plans.joins import counted_join, lookup_join, row_join
from duskveil.plans.ordering import NUMBER, number_rows
from duskveil.plans.scratch import stash

#: Rows of a class that one task finishes. A matter of speed: the classes are
#: the same whatever it is.
LOCAL_ROWS = 50_000
#: Of large tables a task finishes classes of one part in so many of all rows, up to
#: ``MOST_LOCAL`` rows: the number of levels does not grow with the table until then.
LOCAL_SHARE, MOST_LOCAL = 100, 1 << 19
#: Levels of cuts that rows follow before they are written again.
LEVELS = 3
_MEDIAN_ACCURACY = 10_000
#: Half the width of the band around the median, in ranks per row; the sketch errs
#: by one part in ``_MEDIAN_ACCURACY``.
_BAND = 2 / _MEDIAN_ACCURACY
#: A class: the level on which it came about, and its number there.
CLASS = ["__level", "__class"]


def _seconds(moment: Column) -> Column:
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", epoch, moment.cast("timestamp_ntz")).cast("double")


def _coded(df: DataFrame, quasi: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Key, quasi-identifiers and their numeric codes ``__c0`` …

    Text counts as number if every value spells one, else as date if every
    value spells one, else as the position among the sorted distinct values.
    """
    texts = [q for q in quasi if not is_numeric(df, q) and not is_temporal(df, q)]
    checks = []
    for i, q in enumerate(texts):
        value = ref(q).cast("string")
        checks += [
            F.count(value).alias(f"a{i}"),
            F.count(number_in(value)).alias(f"n{i}"),
        ]
    found = df.agg(*checks).first() if checks else None
    dates = spellings(df.select(*[ref(q).cast("string").alias(q) for q in texts]), texts)
    narrow = df.select(*[ref(c) for c in dict.fromkeys([*key, *quasi])])
    for i, q in enumerate(quasi):
        code, value = f"__c{i}", ref(q)
        if is_numeric(df, q):
            narrow = narrow.withColumn(code, known(narrow, q).cast("double"))
        elif is_temporal(df, q):
            narrow = narrow.withColumn(code, _seconds(value))
        else:
            spot, text = texts.index(q), value.cast("string")
            if found[f"n{spot}"] == found[f"a{spot}"]:
                narrow = narrow.withColumn(code, number_in(text))
            elif dates[q][1] == dates[q][2]:
                moment = as_moment(text, T.StringType(), dates[q][0])
                narrow = narrow.withColumn(code, _seconds(moment))
            else:
                counted = (
                    narrow.where(value.isNotNull())
                    .groupBy(value.alias(q))
                    .agg(F.count("*").alias("__weight"))
                )
                ranked = number_rows(counted, [ref(q).asc()]).df.withColumn(
                    code, F.col(NUMBER).cast("double")
                )
                narrow = lookup_join(narrow, ranked.drop(NUMBER), [q], "__weight", key)
    return narrow


def _bands(dims: int, band: float) -> list[Column]:
    """The sketch's values on both sides of the median of each dimension."""
    ends = [max(0.5 - band, 0.0), min(0.5 + band, 1.0)]
    return [
        F.percentile_approx(f"__c{i}", ends, _MEDIAN_ACCURACY).alias(f"__b{i}") for i in range(dims)
    ]


def _medians(
    opened: DataFrame, classes: DataFrame, count: int, dims: int, key: Sequence[str], band: float
) -> DataFrame:
    """``__level, __class, dim, n, cut, left`` of every open class and dimension: the
    lower median and how many rows are not above it.

    Rows below the sketch's band are one count, rows in it are counted by value.
    If a band misses the median (the sketch only promises its error with the
    odds of any estimate), the classes concerned are done again with a wider one.
    """
    bounds = classes
    if band != _BAND:
        bounds = classes.select(*CLASS, "__n").join(
            opened.groupBy(*CLASS).agg(*_bands(dims, band)), CLASS
        )
    bounds = bounds.select(
        *CLASS,
        "__n",
        *[F.get(f"__b{i}", F.lit(e)).alias(f"__{side}{i}") for i in range(dims) for e, side in enumerate(("low", "high"))],
    )
    narrow = opened.select(*[ref(c) for c in key], *CLASS, *[f"__c{i}" for i in range(dims)])
    placed = counted_join(narrow, bounds, count, CLASS, "__n", key)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("dim"),
                F.when(F.col(f"__c{i}") >= F.col(f"__low{i}"), F.col(f"__c{i}")).alias("value"),
                (F.col(f"__c{i}") <= F.col(f"__high{i}")).alias("needed"),
            )
            for i in range(dims)
        ]
    )
    counted = (
        placed.select(*CLASS, F.inline(cells))
        .where("needed")
        .groupBy(*CLASS, "dim", "value")
        .agg(F.count("*").alias("times"))
    )
    upto = F.sum("times").over(
        Window.partitionBy(*CLASS, "dim").orderBy(F.asc_nulls_first("value")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    )
    reached = counted.withColumn("upto", upto).join(classes.select(*CLASS, "__n"), CLASS)
    # 0-based rank of the lower median of n rows
    past = F.col("upto") > F.floor((F.col("__n") - 1) / 2)
    first = F.min(F.when(past, F.struct("upto", "value")))
    return (
        reached.groupBy(*CLASS, "dim", F.col("__n").alias("n"))
        .agg(first.alias("at"))
        .select(*CLASS, "dim", "n", F.col("at.value").alias("cut"), F.col("at.upto").alias("left"))
    )


def _plan(
    opened: DataFrame, count: int, dims: int, scales: list[float], k: int, key: Sequence[str], local_rows: int
) -> tuple[DataFrame, int]:
    """The cut of every open class, where it has one, and the number of children
    that are still open: two tables of a row per class are written."""
    widths = [((F.max(f"__c{i}") - F.min(f"__c{i}")) / scales[i]).alias(f"__w{i}") for i in range(dims)]
    classes = stash(
        opened.groupBy(*CLASS).agg(F.count("*").alias("__n"), *widths, *_bands(dims, _BAND))
    )
    width = reduce(
        lambda other, i: F.when(F.col("dim") == i, F.col(f"__w{i}")).otherwise(other), range(dims), F.lit(None)
    )
    fits = (F.col("left") >= k) & (F.col("n") - F.col("left") >= k)
    # of equal widths the first dimension
    best = F.max(F.when(fits, F.struct(width.alias("width"), (-F.col("dim")).alias("dim"), "cut", "left")))

    def planned(rows: DataFrame, own: DataFrame, band: float) -> DataFrame:
        return (
            _medians(rows, own, count, dims, key, band)
            .join(own.drop("__n"), CLASS)
            .groupBy(*CLASS, "n")
            .agg(best.alias("__best"), F.bool_or(F.col("cut").isNull()).alias("__missed"))
        )

    left, n = F.col("__best.left"), F.col("n")
    is_open = F.when(left > local_rows, 1).otherwise(0) + F.when(n - left > local_rows, 1).otherwise(0)
    summary = [F.coalesce(F.sum(is_open), F.lit(0)).alias("open"), F.count_if("__missed").alias("missed")]
    plan = stash(planned(opened, classes, _BAND))
    seen, band = plan.agg(*summary).first(), _BAND
    while seen["missed"] and band < 0.5:
        band *= 16
        missed = plan.where("__missed").select(*CLASS)
        again = planned(opened.join(missed, CLASS, "left_semi"), classes.join(missed, CLASS, "left_semi"), band)
        plan = stash(plan.where("NOT __missed").unionByName(again))
        seen = plan.agg(*summary).first()
    return plan, seen["open"]


def _cut(
    rows: DataFrame, plan: DataFrame, count: int, dims: int, key: Sequence[str], local_rows: int, level: int
) -> DataFrame:
    """Rows of the classes of ``plan`` go to their children, or are done; ``__state``
    says what becomes of a row. Other rows stay as they are."""
    numbered = plan.select(
        *CLASS, F.col("n").alias("__n"), F.col("n").alias("__size"), "__best",
        F.monotonically_increasing_id().alias("__id"),
    )
    moved = counted_join(rows, numbered, count, CLASS, "__n", key)
    code = F.coalesce(*[F.when(F.col("__best.dim") == -i, F.col(f"__c{i}")) for i in range(dims)])
    goes_left = code <= F.col("__best.cut")
    size = F.when(goes_left, F.col("__best.left")).otherwise(F.col("__size") - F.col("__best.left"))
    cut = F.col("__best").isNotNull()
    state = (
        F.when(F.col("__size").isNull(), F.col("__state"))
        .when(~cut, "done")
        .when(size <= local_rows, "local")
        .otherwise("open")
    )
    number = F.col("__id") * 2 + F.when(goes_left, 0).otherwise(1)
    return moved.select(
        *[c for c in rows.columns if c not in (*CLASS, "__state")],
        F.when(cut, F.lit(level)).otherwise(F.col("__level")).alias("__level"),
        F.when(cut, number).otherwise(F.col("__class")).alias("__class"),
        state.alias("__state"),
    )


def _finish_locally(dims: int, scales: list[float], k: int, key: Sequence[str]):
    names = list(key)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows[[f"__c{i}" for i in range(dims)]].to_numpy(float)
        label = np.zeros(len(rows), dtype="int64")
        open_, label_count = [np.arange(len(rows))], 0
        while open_:
            members = open_.pop()
            part = codes[members]
            middle = (len(members) - 1) // 2
            middles = np.partition(part, middle, axis=0)[middle]
            low = part <= middles
            sizes = low.sum(axis=0)
            fits = (sizes >= k) & (len(members) - sizes >= k)
            if not fits.any():
                label[members] = label_count
                label_count += 1
                continue
            widths = np.where(fits, np.ptp(part, axis=0) / np.array(scales), -1.0)
            side = low[:, int(widths.argmax())]
            open_ += [members[side], members[~side]]
        return rows[[*names, *CLASS]].assign(__part=label)

    return finish


def mondrian_classes(
    df: DataFrame, quasi: Sequence[str], k: int, key: Sequence[str], local_rows: int = LOCAL_ROWS
) -> DataFrame:
    """``key``, quasi-identifiers and the class (``__level``, ``__class``, ``__part``) of each row."""
    require(df, *quasi, *key)
    if not quasi:
        raise ValueError("quasi-identifiers must not be empty")
    dims = len(quasi)
    coded = stash(_coded(df, quasi, key))
    ranges = [F.count("*").alias("n")]
    for i in range(dims):
        ranges += [F.min(f"__c{i}").alias(f"lo{i}"), F.max(f"__c{i}").alias(f"hi{i}")]
    seen = coded.agg(*ranges).first()
    if seen["n"] < k:
        raise ValueError(f"{seen['n']} rows cannot be made {k}-anonymous")
    local_rows = max(local_rows, min(seen["n"] // LOCAL_SHARE, MOST_LOCAL))
    scales = [((seen[f"hi{i}"] or 0.0) - (seen[f"lo{i}"] or 0.0)) or 1.0 for i in range(dims)]
    codes = [f"__c{i}" for i in range(dims)]
    # a missing value is cut as if it were the column minimum
    opened = (
        coded.select(*[ref(c) for c in key], *codes)
        .fillna({f"__c{i}": seen[f"lo{i}"] or 0.0 for i in range(dims)})
        .withColumns({"__level": F.lit(0), "__class": F.lit(0).cast("bigint")})
    )
    small, done = [], []
    if seen["n"] <= local_rows:
        small.append(opened)
    else:
        rows, count, level = opened.withColumn("__state", F.lit("open")), 1, 0
        while count:
            level += 1
            plan, children = _plan(
                rows.where("__state = 'open'").drop("__state"), count, dims, scales, k, key, local_rows
            )
            rows = _cut(rows, plan, count, dims, key, local_rows, level)
            count = children
            if level % LEVELS == 0 or not count:
                rows = stash(rows)
                small.append(rows.where("__state = 'local'").drop("__state"))
                done.append(rows.where("__state = 'done'").drop("__state"))
                rows = rows.where("__state = 'open'")
    schema = T.StructType(
        [*[opened.schema[c] for c in key], T.StructField("__level", T.IntegerType()),
         T.StructField("__class", T.LongType()), T.StructField("__part", T.LongType())]
    )
    parts = [
        reduce(DataFrame.unionByName, small)
        .groupBy(*CLASS)
        .applyInPandas(_finish_locally(dims, scales, k, key), schema)
    ]
    parts += [
        rows.select(*[ref(c) for c in key], *CLASS, F.lit(-1).cast("bigint").alias("__part"))
        for rows in done
    ]
    return row_join(coded.drop(*codes), reduce(DataFrame.unionByName, parts), key, key)


def mondrian(
    df: DataFrame, quasi: Sequence[str], k: int, key: Sequence[str], local_rows: int = LOCAL_ROWS
) -> tuple[DataFrame, dict[str, str]]:
    """Label per row and quasi-identifier: the value of a class, or ``low–high``."""
    rows = stash(mondrian_classes(df, quasi, k, key, local_rows))
    ends = [F.count("*").alias("__weight")]
    for i, q in enumerate(quasi):
        value = ref(q).cast("date") if is_temporal(df, q) else known(rows, q)
        if not is_numeric(df, q) and not is_temporal(df, q) and not is_text(df, q):
            value = value.cast("string")
        low, high = F.min(value), F.max(value)
        label = F.when(low == high, low.cast("string")).otherwise(
            F.concat(low.cast("string"), F.lit("–"), high.cast("string"))
        )
        ends.append(F.coalesce(label, F.lit("")).alias(f"__label{i}"))
    own = [*CLASS, "__part"]
    labels = rows.groupBy(*own).agg(*ends)
    labelled = lookup_join(rows.select(*[ref(c) for c in key], *own), labels, own, "__weight", key)
    aliases = {q: f"__label{i}" for i, q in enumerate(quasi)}
    return labelled.drop(*own), aliases
