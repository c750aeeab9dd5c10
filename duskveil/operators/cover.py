"""Column-wide masks: numeric proximity, positional cover, adjacent spread.

The first two need only small summaries of the column. Numbers are summarised
on a grid of cells half a threshold wide: at most 180 cells per power of ten
whatever the row count. Characters are summarised by (place, character). Both
summaries are combined map-side, and what reaches the driver is bounded by the
grid and by the alphabet, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions import text
from duskveil.functions.names import literal_array, ref, replace_columns, require
from duskveil.operators.context import key_and_texts, keys_of, put_beside, put_in_place, with_texts
from duskveil.operators.masks import mask_share
from duskveil.plans.joins import lookup_join
from duskveil.plans.ordering import beside
from duskveil.plans.release import ReleaseInfo
from duskveil.plans.scratch import stash


def _as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return replace_columns(
        df, {c: text.plain_text(ref(c), df.schema[c].dataType) for c in columns}
    )


def _power_steps() -> list[float]:
    """Smallest double not below each power of ten, from 10 on."""
    steps = []
    for exponent in range(1, 309):
        step = float(10**exponent)
        steps.append(step if int(step) >= 10**exponent else math.nextafter(step, math.inf))
    return steps


_STEPS = _power_steps()


def int_digits(number: Column) -> Column:
    """Digits of the integer part, at least 1."""
    size = F.abs(number)
    guess = F.floor(F.log10(F.greatest(size, F.lit(1.0)))).cast("int")
    steps = literal_array(_STEPS, "double")
    above = F.coalesce(size >= F.get(steps, guess), F.lit(False))
    below = F.coalesce((guess > 0) & (size < F.get(steps, guess - 1)), F.lit(False))
    return guess + F.when(above, 2).when(below, 0).otherwise(1)


def _reach(digits: Column, l: int) -> Column:
    return F.lit(float(l)) * F.pow(F.lit(10.0), F.greatest(digits - 2, F.lit(0)).cast("double"))


def _cell(number: Column, l: int) -> Column:
    """Grid cell: digits and half-threshold step, in one long."""
    digits = int_digits(number)
    step = F.floor(number / (_reach(digits, l) / 2.0)).cast("bigint")
    return digits.cast("bigint") * (1 << 40) + step + (1 << 39)


def _lonely_cells(cells: list, l: int) -> dict[str, list[int]]:
    """Cells of one number that has no other number in reach, per column."""
    lonely: dict[str, list[int]] = {}
    for name in {row["name"] for row in cells}:
        found = sorted((r for r in cells if r["name"] == name), key=lambda r: r["low"])
        reach = [float(l) * 10.0 ** max((r["cell"] >> 40) - 2, 0) for r in found]
        hit = [r["n"] > 1 for r in found]
        for upward in (True, False):
            # nearest number so far of every reach; cells are visited in value order
            nearest: dict[float, float] = {}
            spots = range(len(found)) if upward else reversed(range(len(found)))
            for i in spots:
                here = found[i]["low"]
                hit[i] = hit[i] or any(
                    abs(here - other) <= max(reach[i], theirs) for theirs, other in nearest.items()
                )
                nearest[reach[i]] = found[i]["high" if upward else "low"]
        lonely[name] = [r["cell"] for r, h in zip(found, hit) if not h]
    return lonely


def mask_near_numbers(
    df: DataFrame, columns: Sequence[str], l: int, row_key: Sequence[str] = ()
) -> DataFrame:
    """Hide a whole number when another number of its column lies in reach.

    The reach of x is ``l`` times ten to the power max(d - 2, 0), d being the
    integer digits of x; being in the reach of either number counts. Cells
    that spell no finite number stay. ``row_key`` is needed for ``l = 0``
    only, where equal numbers alone are in reach.
    """
    require(df, *columns)
    texts = _as_text(df, columns)
    if l < 0:
        return texts
    spots = dict(enumerate(columns))
    # one column per step: an expression used more than once is then computed once
    read = texts.withColumns({f"__r{i}": text.spelled_number(ref(c)) for i, c in spots.items()})
    read = read.withColumns({f"__x{i}": text.finite(F.col(f"__r{i}")) for i in spots})
    helpers = [f"__{p}{i}" for p in "rx" for i in spots]
    if l == 0:
        return _mask_equal_numbers(read, columns, row_key).drop(*helpers)
    celled = read.withColumns({f"__c{i}": _cell(F.col(f"__x{i}"), l) for i in spots})
    numbers = celled.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("name"),
                        F.col(f"__c{i}").alias("cell"),
                        F.col(f"__x{i}").alias("x"),
                    )
                    for i, c in spots.items()
                ]
            )
        )
    ).where("x is not null")
    grid = numbers.groupBy("name", "cell").agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    lonely = _lonely_cells(grid.collect(), l)
    masked = {}
    for i, c in spots.items():
        hidden = F.col(f"__x{i}").isNotNull()
        if lonely.get(c):
            hidden = hidden & ~F.col(f"__c{i}").isin(lonely[c])
        masked[c] = F.when(hidden, text.stars(F.length(ref(c)))).otherwise(ref(c))
    return replace_columns(celled, masked).drop(*helpers, *[f"__c{i}" for i in spots])


def _mask_equal_numbers(
    read: DataFrame, columns: Sequence[str], row_key: Sequence[str]
) -> DataFrame:
    if not row_key:
        raise ValueError("row_key is needed when l is 0")
    for i, c in enumerate(columns):
        number = f"__x{i}"
        counts = read.where(ref(number).isNotNull()).groupBy(number).agg(F.count("*").alias("__n"))
        counts = counts.withColumn("__copies", F.col("__n"))
        shown = F.when(F.col("__copies") > 1, text.stars(F.length(ref(c)))).otherwise(ref(c))
        joined = lookup_join(read, counts, [number], "__n", row_key)
        read = replace_columns(joined, {c: shown}).drop("__copies")
    return read


def _cover_lengths(l: int, limit: int) -> list[int]:
    # Share of the offset that is covered, growing with l.
    share = min(0.9, 0.35 + 0.05 * max(1, min(l, 10)))
    return [max(1, min(n, math.ceil(n * share))) for n in range(1, limit + 1)]


def _edge(seen: str, l: int, side: str) -> Column:
    """Comparable characters from the edge inwards, at most ``l``."""
    value = text.comparable(ref(seen))
    if side == "right":
        return F.reverse(text.chars(F.right(value, F.lit(l))))
    return text.chars(F.left(value, F.lit(l)))


def _rare_characters(df: DataFrame, columns: Sequence[str], l: int, side: str):
    """Per column and offset: is there a star, and which characters occur once."""
    places = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("name"), _edge(c, l, side).alias("edge")) for c in columns]
            )
        )
    ).select("name", F.posexplode("edge").alias("at", "char"))
    found = (
        places.where("char != ' '")
        .groupBy("name", "at", text.fold(F.col("char")).alias("char"))
        .agg(F.count("*").alias("n"))
        .where(f"n = 1 or char = '{text.STAR}'")
        .groupBy("name", "at")
        .agg(
            F.max(F.col("char") == text.STAR).alias("star"),
            F.array_sort(F.collect_list(F.when(F.col("char") != text.STAR, F.col("char")))).alias("rare"),
        )
    )
    return {(r["name"], r["at"]): (r["star"], r["rare"]) for r in found.collect()}


def _covered(df: DataFrame, columns: Sequence[str], l: int, side: str, short: dict[str, Column]):
    """One pass from one side: each column after covering its edge."""
    seen = _rare_characters(df, columns, l, side)
    lengths = literal_array(_cover_lengths(l, l), "int")
    sizes = {}
    for i, c in enumerate(columns):
        # a character triggers unless it occurs once at its place and no star is there
        found = [seen.get((c, at), (False, [])) for at in range(l)]
        rare = [[] if star else characters for star, characters in found]
        spared = literal_array(rare, "array<string>")

        def cover(char: Column, at: Column) -> Column:
            calls = (
                (char != " ")
                & (char != text.STAR)
                & ~F.array_contains(F.get(spared, at), text.fold(char))
            )
            size = F.when(short[c], at + 1).otherwise(F.get(lengths, at))
            return F.when(calls, size).otherwise(0)

        covers = F.array_max(F.transform(_edge(c, l, side), cover))
        sizes[f"__size{i}"] = F.coalesce(covers, F.lit(0))
    out = {}
    for i, c in enumerate(columns):
        size = F.col(f"__size{i}")
        if side == "right":
            out[c] = F.concat(F.left(ref(c), F.length(ref(c)) - size), text.stars(size))
        else:
            out[c] = F.concat(text.stars(size), F.substr(ref(c), size + 1))
    return replace_columns(df.withColumns(sizes), out).drop(*sizes)


def cover_positions(df: DataFrame, columns: Sequence[str], l: int) -> DataFrame:
    """Hide edges whose characters recur at the same place, from the right then the left.

    Numbers of two or three digits are covered up to the recurring place,
    other texts by a share of it that grows with ``l``.
    """
    require(df, *columns)
    texts = _as_text(df, columns)
    if l <= 0:
        return texts
    flags = {c: f"__short{i}" for i, c in enumerate(columns)}
    marked = texts.withColumns({f: ref(c).rlike(r"\A\p{Nd}{2,3}\z") for c, f in flags.items()})
    short = {c: F.col(f) for c, f in flags.items()}
    rightward = _covered(marked, columns, l, "right", short)
    return _covered(rightward, columns, l, "left", short).drop(*flags.values())


def spread_masks(
    df: DataFrame, columns: Sequence[str], l: int, order_by: Sequence[str]
) -> DataFrame:
    """Hide letters and digits near either end when an adjacent row has a star
    at most one place away, counted from the left or from the right."""
    if l <= 0:
        return _as_text(df, columns)
    spread = _spread(with_texts(df, columns, order_by), order_by, len(columns), l)
    return put_in_place(df, spread, columns)


def _spread(df: DataFrame, order_by: Sequence[str], width: int, l: int) -> DataFrame:
    """Adds ``__m0`` … for the texts ``__t0`` … of ``width`` columns."""
    stars = {
        f"__s{i}": F.expr(f"transform(split(__t{i}, ''), ch -> ch = '{text.STAR}')")
        for i in range(width)
    }
    starred = df.withColumns(stars)
    # near[p + 1]: is there a star at most one place from p, for p from -1 to the length
    payload = [
        F.expr(
            f"""named_struct('size', length(__t{i}), 'near', transform(sequence(-1, length(__t{i})), p ->
                coalesce(get(__s{i}, p - 1), false) or coalesce(get(__s{i}, p), false)
                or coalesce(get(__s{i}, p + 1), false)))"""
        ).alias(f"p{i}")
        for i in range(width)
    ]
    rows = beside(starred, order_by, payload).drop(*stars)
    rows = rows.withColumns({f"__n{i}": F.length(f"__t{i}") for i in range(width)})

    def star_near(i: int, place: str) -> str:
        """A star next to ``place`` in a row beside, counted from the left or the right."""
        tests = []
        for row in (f"__before.p{i}", f"__after.p{i}"):
            for at in (place, f"{row}.size - __n{i} + {place}"):
                tests.append(f"coalesce(get({row}.near, {at} + 1), false)")
        return " or ".join(tests)

    def edge(i: int, part: str, start: str) -> str:
        return rf"""array_join(transform(split({part}, ''), (ch, p) -> case
            when ch rlike r'\A[\p{{L}}\p{{N}}]\z' and ({star_near(i, f"({start} + p)")})
            then '{text.STAR}' else ch end), '')"""

    masked = {}
    for i in range(width):
        value, size = f"__t{i}", f"__n{i}"
        head, tail = f"least({l}, {size})", f"least({l}, {size} - least({l}, {size}))"
        # only both ends can change: the middle of a long text is copied as it is
        masked[f"__m{i}"] = F.expr(
            f"""concat({edge(i, f"left({value}, {head})", "0")},
                substr({value}, {head} + 1, {size} - {head} - {tail}),
                {edge(i, f"right({value}, {tail})", f"{size} - {tail}")})"""
        )
    return rows.withColumns(masked)


def cover_columns(
    df: DataFrame, columns: Sequence[str], l: int, order_by: Sequence[str]
) -> DataFrame:
    """Near numbers, then positional cover, then adjacent spread, per column.

    The key and the columns are written first, and again when they are covered;
    all three steps work on that narrow table, and the other columns move once, in
    the join back.
    """
    if l <= 0:
        return mask_near_numbers(df, columns, l, order_by)
    narrow = key_and_texts(df, columns, order_by)
    texts = [f"__t{i}" for i in range(len(columns))]
    covered = stash(cover_positions(mask_near_numbers(narrow, texts, l), texts, l))
    spread = _spread(covered, keys_of(order_by), len(columns), l)
    return put_beside(df, spread, columns, order_by)


def ldiversity_mask(
    df: DataFrame,
    sensitive: str,
    quasi: Sequence[str],
    l: int,
    order_by: Sequence[str],
    level: str = "medium",
) -> DataFrame:
    """Share mask on the sensitive column, column cover on the quasi-identifiers."""
    masked = mask_share(df, [sensitive], level)
    return cover_columns(masked, quasi, l, order_by) if quasi else masked


def ldiversity_mask_with_info(
    df: DataFrame,
    sensitive: str,
    quasi: Sequence[str],
    l: int,
    order_by: Sequence[str],
    level: str = "medium",
    info: ReleaseInfo | None = None,
) -> tuple[DataFrame, ReleaseInfo]:
    """``ldiversity_mask`` and what was done, added to ``info``."""
    masked = ldiversity_mask(df, sensitive, quasi, l, order_by, level)
    return masked, (info or ReleaseInfo()).with_(l=l, l_columns=tuple(quasi), sensitive=sensitive)


def ldiversity_columns(
    df: DataFrame, columns: Sequence[str], l: int, order_by: Sequence[str], level: str = "medium"
) -> DataFrame:
    """First column sensitive, the others quasi-identifiers."""
    if not columns:
        raise ValueError("name at least the sensitive column")
    return ldiversity_mask(df, columns[0], columns[1:], l, order_by, level)


def finalise_mask(
    df: DataFrame,
    columns: Sequence[str],
    l: int,
    order_by: Sequence[str],
    info: ReleaseInfo | None = None,
) -> tuple[DataFrame, ReleaseInfo]:
    """Column cover, backups dropped, and the record of what was done."""
    info = info or ReleaseInfo()
    masked = cover_columns(df.drop(*info.backups.values()), columns, l, order_by)
    return masked, info.with_(l=l, l_columns=tuple(columns), backups={})


