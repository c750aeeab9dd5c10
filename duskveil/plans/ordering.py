"""Global order without a one-task window: numbering, neighbours, quantiles.

Neighbours alone need no written order (``beside``): a row's range is a pure
function of its key, so one exchange by range puts all but the first and last
row of a range beside their neighbours, and those come from a table with one
row per range.

For numbers and quantiles the rows are range-partitioned by Spark on the whole sort key (a unique key
last, so one frequent value cannot fill a partition), sorted inside each
partition and written with their position. Everything after that needs only
one small row per partition. Write narrow tables before anything costly is
computed: Spark reads the input of a range partitioning twice.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.names import literal_array, ref
from duskveil.plans.scratch import stash

PART = "__part"
SPOT = "__spot"
NUMBER = "__number"
_MARK = "__mark"
_SPOT_BITS = 33


#: Most ranges of an order that is not written, ranges per shuffle partition, and
#: sampled keys per range.
RANGES, RANGES_EACH, SAMPLES = 4096, 4, 32
#: Narrow rows that are one range, since they are sorted faster than sampled.
FEW_ROWS = 1 << 16
_AT, _BOX, _RANGE = "__at", "__box", "__range"


def in_ranges(df: DataFrame, order: Sequence[str], few_rows: int = 0) -> DataFrame:
    """Add ``__at``, the key ``order`` of a row, and ``__range``, its place in the
    ascending order: how many of the bounds lie at or below the key.

    The bounds are keys spaced evenly in a sample, those whose hash is small, and
    become a constant of the plan: a task that is run again deals its rows the
    same way. Any bounds give right neighbours; good ones give even ranges. Up
    to ``few_rows`` rows are one range.
    """
    spark = df.sparkSession
    count = min(RANGES, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"k{i}" for i in range(len(order))]
    rows = df.select(*[ref(c).alias(k) for c, k in zip(order, keys)])
    total = rows.count()
    keyed = df.withColumn(_AT, F.struct(*[ref(c).alias(k) for c, k in zip(order, keys)]))
    if total <= few_rows:
        return keyed.withColumn(_RANGE, F.lit(0))
    one_in = max(1, total // (count * SAMPLES))
    some = rows.where(F.pmod(F.xxhash64(*keys), F.lit(one_in)) == 0).distinct()
    whole = Window.partitionBy(F.lit(0))
    placed = some.withColumns(
        {"__n": F.count("*").over(whole), "__i": F.row_number().over(whole.orderBy(*keys))}
    )
    slot = lambda i: F.floor(i * count / F.col("__n"))
    spaced = placed.where(slot(F.col("__i")) > slot(F.col("__i") - 1))
    bounds = [r[0] for r in spaced.select(F.to_json(F.struct(*keys))).collect()]  # one per range
    key_type = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    constant = F.sort_array(F.from_json(F.lit(f"[{','.join(bounds)}]"), T.ArrayType(key_type)))
    halves = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def halved(found: Column, size: Column) -> Column:
        below = F.get(constant, found + size - 1) <= F.col(_AT)
        return F.when(F.coalesce(below, F.lit(False)), found + size).otherwise(found)

    found = F.aggregate(literal_array(halves, "int"), F.lit(0), halved) if halves else F.lit(0)
    return keyed.withColumn(_RANGE, found)


def beside(
    df: DataFrame, order: Sequence[str], payload: Sequence[Column], cyclic: bool = False
) -> DataFrame:
    """Add ``__before`` and ``__after``: the payload struct of the adjacent rows in
    the ascending order of the unique key ``order``, nulls first.

    The whole rows move once, by their range. The first and last payload of
    every range are aggregated before any exchange and joined to the ranges
    beside it on the same partitioning. With ``cyclic`` the last row precedes the
    first. A key that two rows hold raises an error.
    """
    placed = in_ranges(df, order).withColumn(_BOX, F.struct(*payload))
    edges = placed.groupBy(_RANGE).agg(
        F.min_by(_BOX, _AT).alias("first"), F.max_by(_BOX, _AT).alias("last")
    )
    # one row per range, 4096 at most
    along = Window.partitionBy(F.lit(0)).orderBy(_RANGE)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier, later = F.lag("last").over(along), F.lead("first").over(along)
    if cyclic:
        earlier = F.coalesce(earlier, F.last("last").over(whole))
        later = F.coalesce(later, F.first("first").over(whole))
    around = edges.select(_RANGE, earlier.alias("__earlier"), later.alias("__later"))
    inside = Window.partitionBy(_RANGE).orderBy(*[F.col(f"{_AT}.k{i}") for i in range(len(order))])
    twice = F.raise_error(F.lit(f"the key {list(order)} is held by more than one row"))
    boxes = {
        "__before": F.coalesce(F.lag(_BOX).over(inside), F.col("__earlier")),
        "__after": F.coalesce(F.lead(_BOX).over(inside), F.col("__later")),
        "__same": F.lag(_AT).over(inside),
    }
    rows = placed.join(around, _RANGE, "left").withColumns(boxes)
    held = F.when(F.col("__same") == F.col(_AT), twice.cast(rows.schema["__before"].dataType))
    return rows.withColumn("__before", held.otherwise(F.col("__before"))).drop(
        _AT, _BOX, _RANGE, "__earlier", "__later", "__same"
    )


def running_sums(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], few_rows: int = FEW_ROWS
) -> DataFrame:
    """Add the sums of columns over all earlier rows in the order of the unique key
    ``order``; ``sums`` names the new column and the summed one.

    A running sum stays inside a range and starts from the sums of the earlier
    ranges, which are aggregated before the exchange.
    """
    placed = in_ranges(df, order, few_rows)
    totals = placed.groupBy(_RANGE).agg(*[F.sum(ref(c)).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        _RANGE, *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(_RANGE)
        .orderBy(*[F.col(f"{_AT}.k{i}") for i in range(len(order))])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = placed.join(bases, _RANGE, "left").withColumns(
        {n: F.col(f"__{n}") + F.coalesce(F.sum(ref(c)).over(inside), F.lit(0)) for n, c in sums.items()}
    )
    return rows.drop(_AT, _RANGE, *[f"__{n}" for n in sums])


def latest(df: DataFrame, table: DataFrame, at: str, few_rows: int = FEW_ROWS) -> DataFrame:
    """Each row of ``df`` with ``__row``, the row of ``table`` whose ``at`` is the
    greatest at or below its own; null if there is none. ``table`` holds an ``at`` once.

    Both lie in one order of ``at``, table rows first and equal rows of ``df``
    spread by their hash, so that a frequent value is cut in ranges like any
    other. A range starts from the last table row of the earlier ones.
    """
    rows = F.struct(*[ref(c) for c in df.columns])
    found = F.struct(*[ref(c) for c in table.columns])
    row_type = df.select(rows.alias("r")).schema["r"].dataType
    found_type = table.select(found.alias("r")).schema["r"].dataType
    both = table.select(
        ref(at).alias("__x"), F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__spread"),
        found.alias("__row"), F.lit(None).cast(row_type).alias("__own"),
    ).unionAll(
        df.select(
            ref(at).alias("__x"), F.lit(1).alias("__kind"), F.xxhash64(*[ref(c) for c in df.columns]).alias("__spread"),
            F.lit(None).cast(found_type).alias("__row"), rows.alias("__own"),
        )
    )
    placed = in_ranges(both, ["__x", "__kind", "__spread"], few_rows)
    ends = placed.where("__kind = 0").groupBy(_RANGE).agg(F.max_by("__row", "__x").alias("__end"))
    ranges = placed.select(_RANGE).distinct().join(ends, _RANGE, "left")
    earlier = Window.partitionBy(F.lit(0)).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select(_RANGE, F.last("__end", ignorenulls=True).over(earlier).alias("__base"))
    inside = (
        Window.partitionBy(_RANGE)
        .orderBy("__x", "__kind", "__spread")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    met = placed.join(bases, _RANGE, "left").withColumn(
        "__row", F.coalesce(F.last("__row", ignorenulls=True).over(inside), F.col("__base"))
    )
    return met.where("__kind = 1").select("__own.*", "__row")


@dataclass(frozen=True)
class Frozen:
    """A written table in order: ``__part`` and ``__spot`` place each row, and
    ``sizes`` holds the row count of every partition."""

    df: DataFrame
    sizes: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.sizes)

    def at_part(self, values: Sequence[int]) -> Column:
        """The entry of ``values`` that belongs to the partition of the row."""
        return F.get(literal_array(list(values), "bigint"), F.col(PART))

    def with_df(self, df: DataFrame) -> "Frozen":
        return Frozen(df, self.sizes)


def freeze_order(df: DataFrame, order: Sequence[Column]) -> Frozen:
    """Write ``df`` in the given total order (its last column unique)."""
    # no fixed count: adaptive execution may join small adjacent ranges
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id: partition in the upper bits, row in the lower 33
    written = stash(ranged.withColumn(_MARK, F.monotonically_increasing_id()))
    part = F.shiftright(_MARK, _SPOT_BITS).cast("int")
    counted = written.groupBy(part.alias(PART)).agg(F.count("*").alias("n")).collect()
    sizes = {r[PART]: r["n"] for r in counted}  # one small row per partition
    placed = written.withColumns(
        {PART: part, SPOT: F.col(_MARK).bitwiseAND(F.lit((1 << _SPOT_BITS) - 1))}
    ).drop(_MARK)
    return Frozen(placed, tuple(sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)))


def number_rows(df: DataFrame, order: Sequence[Column]) -> Frozen:
    """Dense row numbers 1..n in ``__number`` over a total order."""
    frozen = freeze_order(df, order)
    starts = [0, *accumulate(frozen.sizes)][:-1]
    number = frozen.at_part(starts) + F.col(SPOT) + 1
    return frozen.with_df(frozen.df.withColumn(NUMBER, number).drop(PART, SPOT))


def neighbours(frozen: Frozen, payload: Sequence[Column], cyclic: bool = False) -> DataFrame:
    """Add ``__before`` and ``__after``: the payload struct of the adjacent rows.

    The first and last row of each partition are copied into the partitions
    beside it, so every row finds its neighbours inside its own; the copies,
    two per partition, are dropped again. With ``cyclic`` the last row of the
    table precedes the first.
    """
    before, after = _parts_beside(frozen.sizes, cyclic)
    last_spot = frozen.at_part([n - 1 for n in frozen.sizes])
    beyond = frozen.at_part([frozen.sizes[p] for p in before])  # one past the last row there
    placed = F.array_compact(
        F.array(
            _place(F.col(PART), F.col(SPOT), False),
            F.when(
                (F.col(SPOT) == last_spot) & (frozen.at_part(after) >= 0),
                _place(frozen.at_part(after), F.lit(-1), True),
            ),
            F.when(
                (F.col(SPOT) == 0) & (frozen.at_part(before) >= 0),
                _place(frozen.at_part(before), beyond, True),
            ),
        )
    )
    rest = [ref(c) for c in frozen.df.columns if c not in (PART, SPOT)]
    copied = frozen.df.select(*rest, F.inline(placed)).withColumn("__box", F.struct(*payload))
    inside = Window.partitionBy(PART).orderBy(SPOT)
    return (
        copied.withColumns(
            {"__before": F.lag("__box").over(inside), "__after": F.lead("__box").over(inside)}
        )
        .where(~F.col("__copy"))
        .drop(PART, SPOT, "__copy", "__box")
    )


def _place(part: Column, spot: Column, copy: bool) -> Column:
    return F.struct(
        part.cast("int").alias(PART), spot.cast("bigint").alias(SPOT), F.lit(copy).alias("__copy")
    )


def _parts_beside(sizes: Sequence[int], cyclic: bool) -> tuple[list[int], list[int]]:
    """For each partition the filled one before and after it, -1 if there is none."""
    filled = [p for p, n in enumerate(sizes) if n]
    before, after = [-1] * len(sizes), [-1] * len(sizes)
    for spot, part in enumerate(filled):
        if spot > 0 or cyclic:
            before[part] = filled[spot - 1]
        if spot + 1 < len(filled) or cyclic:
            after[part] = filled[(spot + 1) % len(filled)]
    return before, after


def ordered_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Each known value of each known group with its row count ``times``, in order."""
    known = df.dropna(subset=[value, *groups])
    counted = known.groupBy(*[ref(g) for g in groups], ref(value)).agg(
        F.count("*").alias("times")
    )
    return freeze_order(counted, [*[ref(g).asc() for g in groups], ref(value).asc()]).df


def exact_quantiles(
    counts: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles per group of ``ordered_counts``, one column per
    entry of ``probs``, and the number of rows ``n``.

    The two order statistics around each rank are picked by cumulative count.
    A running sum stays inside one partition of the order and starts from the
    sums of the earlier ones, so no task ever holds a whole group.
    """
    keys = [ref(g) for g in groups]
    carried = counts.groupBy(*keys, PART).agg(F.sum("times").alias("__s"))
    by_group = Window.partitionBy(*keys) if groups else Window.partitionBy(F.lit(0))
    earlier = by_group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumns(
        {
            "__base": F.coalesce(F.sum("__s").over(earlier), F.lit(0)),
            "__total": F.sum("__s").over(by_group),
        }
    ).drop("__s")
    running = (
        Window.partitionBy(*keys, PART)
        .orderBy(SPOT)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        counts.withColumn("__to", F.sum("times").over(running))
        .join(carried, [*groups, PART])
        .withColumn("__to", F.col("__to") + F.col("__base"))
        .withColumn("__from", F.col("__to") - F.col("times"))
    )
    picks = []
    for name, prob in probs.items():
        rank = (F.col("__total") - 1) * F.lit(float(prob))
        for side, spot in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            held = (F.col("__from") <= spot) & (spot < F.col("__to"))
            picks.append(F.max(F.when(held, ref(value).cast("double"))).alias(f"{name}_{side}"))
    picked = placed.groupBy(*keys).agg(F.max("__total").alias("n"), *picks)
    out = []
    for name, prob in probs.items():
        rank = (F.col("n") - 1) * F.lit(float(prob))
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return picked.select(*keys, F.col("n"), *out)
