"""Chart data: counts, numbers read from labels, histograms, boxes and pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskveil.functions.names import numeric_names, ref, replace_columns, require
from duskveil.functions.text import chart_number
from duskveil.plans.joins import lookup_join
from duskveil.plans.ordering import PART, SPOT, exact_quantiles, ordered_counts

#: Label of a missing category, bins of a histogram.
MISSING_LABEL = "N/A"
BINS = 20
LEAST_BINS, MOST_BINS = 5, 50

QUARTILES = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """``(label, n)``; null and the empty text count as ``N/A``."""
    require(df, column)
    cell = ref(column).cast("string")
    label = F.when(cell.isNull() | (cell == ""), F.lit(MISSING_LABEL)).otherwise(cell)
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def numeric_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by the numbers behind their cells; ranges give midpoints."""
    require(df, *columns)
    return replace_columns(
        df, {c: chart_number(ref(c), df.schema[c].dataType) for c in columns}
    )


def _numbers(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    number = chart_number(ref(column), df.schema[column].dataType)
    return df.select(number.alias("x")).where("x is not null")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``(bin, low, high, n)``: equal bins from minimum to maximum, filled ones only."""
    if not LEAST_BINS <= bins <= MOST_BINS:
        raise ValueError(f"bins must be between {LEAST_BINS} and {MOST_BINS}")
    numbers = _numbers(df, column)
    ends = numbers.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    width = (high - low) / bins
    spot = F.when(
        high > low, F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
    ).otherwise(0)
    counts = numbers.groupBy((spot + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(
        "bin", (low + width * (F.col("bin") - 1)).alias("low"), (low + width * F.col("bin")).alias("high"), "n"
    )


def _boxes(numbers: DataFrame, groups: Sequence[str], accuracy: int | None) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 times the box, and outliers."""
    if accuracy:
        counts = numbers.withColumn("times", F.lit(1)).dropna(subset=[*groups, "x"])
        quartiles = sketch_quantiles(counts, groups, "x", QUARTILES, accuracy)
    else:
        counts = ordered_counts(numbers, groups, "x")
        quartiles = exact_quantiles(counts, groups, "x", QUARTILES)
        counts = counts.drop(PART, SPOT)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    boxes = quartiles.withColumns({"floor": F.col("q1") - reach, "roof": F.col("q3") + reach})
    inside = F.col("x").between(F.col("floor"), F.col("roof"))
    fenced = boxes.withColumn("__weight", F.col("n"))
    return (
        lookup_join(counts, fenced, groups, "__weight", [*groups, "x"])
        .groupBy(*groups, "n", *QUARTILES)
        .agg(
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("times"))).alias("outliers"),
        )
    )


def sketch_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], accuracy: int
) -> DataFrame:
    """Quantiles per group from one map-side aggregate of mergeable rank sketches.

    Each is a value of the group whose rank is within n / ``accuracy`` of the asked
    rank (0 and 1 are the exact ends). A sketch has some ``accuracy`` entries,
    however many rows the group has.
    """
    inner = {name: prob for name, prob in probs.items() if 0 < prob < 1}
    sketch = F.percentile_approx(ref(value), list(inner.values()), accuracy)
    ends = {name: F.min(ref(value)) if prob == 0 else F.max(ref(value)) for name, prob in probs.items() if name not in inner}
    found = df.groupBy(*[ref(g) for g in groups]).agg(
        F.count("*").alias("n"), sketch.alias("__s"), *[end.cast("double").alias(name) for name, end in ends.items()]
    )
    at = list(inner)
    return found.select(
        *[ref(g) for g in groups],
        "n",
        *[
            F.get("__s", F.lit(at.index(name))).cast("double").alias(name) if name in inner else F.col(name)
            for name in probs
        ],
    )


def box_summary(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """One box per column (all numeric columns by default), labelled ``column_name``.

    With ``accuracy`` the quartiles come from sketches: see ``sketch_quantiles``.
    """
    columns = list(columns or numeric_names(df))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                chart_number(ref(c), df.schema[c].dataType).alias("x"),
            )
            for c in columns
        ]
    )
    return _boxes(df.select(F.inline(cells)).where("x is not null"), ["column_name"], accuracy)


def grouped_boxes(
    df: DataFrame, group: str, target: str, accuracy: int | None = None
) -> DataFrame:
    """One box of ``target`` per known ``group``, labelled ``label``; ``accuracy`` as
    in ``box_summary``."""
    require(df, group, target)
    number = chart_number(ref(target), df.schema[target].dataType)
    numbers = df.select(ref(group).alias("label"), number.alias("x"))
    return _boxes(numbers, ["label"], accuracy)


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y)`` where both cells read as numbers."""
    require(df, x, y)
    pairs = df.select(
        chart_number(ref(x), df.schema[x].dataType).alias("x"),
        chart_number(ref(y), df.schema[y].dataType).alias("y"),
    )
    return pairs.dropna()


def scatter_sample(
    df: DataFrame, x: str, y: str, key: Sequence[str], per_cell: int = 5, grid: int = 20, seed: int = 0
) -> DataFrame:
    """``(x, y)`` of at most ``per_cell`` pairs of every cell of a ``grid`` by ``grid``
    net over the finite pairs, so that sparse corners of the cloud stay.

    Those with the smallest hash of seed and key are taken: the same on every run
    and every partitioning. Tasks hand on ``per_cell`` rows per cell. Pairs with a
    value that is not finite are left out.
    """
    require(df, x, y, *key)
    both = df.select(
        chart_number(ref(x), df.schema[x].dataType).alias("x"),
        chart_number(ref(y), df.schema[y].dataType).alias("y"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), *[ref(k).cast("string") for k in key])).alias("__hash"),
    ).where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    ends = both.agg(
        F.struct(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    ).scalar()

    def cell(c: str) -> Column:
        low, high = ends[f"low_{c}"], ends[f"high_{c}"]
        spot = F.least(F.floor((F.col(c) - low) / ((high - low) / grid)), F.lit(grid - 1))
        return F.when(high > low, spot).otherwise(0).cast("int")

    placed = both.withColumns({"__i": cell("x"), "__j": cell("y")})
    first = Window.partitionBy("__i", "__j").orderBy("__hash", "x", "y")
    taken = placed.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= per_cell)
    return taken.select("x", "y")


def before_after(
    original: DataFrame, working: DataFrame, chart: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The same chart data of both tables, told apart by ``version``."""
    return (
        chart(original)
        .withColumn("version", F.lit("before"))
        .unionByName(chart(working).withColumn("version", F.lit("after")))
    )
