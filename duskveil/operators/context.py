"""Masks that compare a cell with the rows next to it.

The caller names a unique ``order_by``. A mask that only looks at the rows beside
moves every row once; one that also looks up values works on the key and the
compared columns and joins the others back on that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions import text
from duskveil.functions.names import ref, require
from duskveil.plans.joins import lookup_join, row_join, unique_rows
from duskveil.plans.ordering import beside
from duskveil.plans.scratch import stash

# bits of one word of a mask; a longer mask takes several words
_WORD = 60


def with_texts(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``df`` and its ``columns`` as text ``__t0`` …"""
    require(df, *columns, *order_by)
    return df.withColumns(
        {f"__t{i}": text.plain_text(ref(c), df.schema[c].dataType) for i, c in enumerate(columns)}
    )


def key_and_texts(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``order_by`` as ``__k0`` … and the columns as text ``__t0`` …, written once."""
    require(df, *columns, *order_by)
    return stash(
        df.select(
            *[ref(c).alias(f"__k{i}") for i, c in enumerate(order_by)],
            *[
                text.plain_text(ref(c), df.schema[c].dataType).alias(f"__t{i}")
                for i, c in enumerate(columns)
            ],
        )
    )


def keys_of(order_by: Sequence[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(order_by))]


def put_in_place(df: DataFrame, masked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of ``df`` from ``masked``, ``columns`` replaced by ``__m0`` …"""
    spots = {c: i for i, c in enumerate(columns)}
    return masked.select(
        *[F.col(f"__m{spots[c]}").alias(c) if c in spots else ref(c) for c in df.columns]
    )


def put_beside(
    df: DataFrame, masked: DataFrame, columns: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Replace ``columns`` of ``df`` by ``__m0`` … of ``masked``, matched on the key."""
    spots = {c: i for i, c in enumerate(columns)}
    keys = {c: i for i, c in enumerate(order_by)}
    if not [c for c in df.columns if c not in spots and c not in keys]:
        joined = unique_rows(masked, [f"__k{i}" for i in keys.values()]).where("__own is not null")
    else:
        rest = df.select(*[ref(c) for c in df.columns if c not in spots])
        if set(spots) & set(keys):
            rest = df
        own = [f"__k{i}" for i in keys.values()]
        values = masked.select(*own, *[F.col(f"__m{i}") for i in spots.values()])
        joined = row_join(rest, values, list(keys), own)
        return joined.select(
            *[F.col(f"__m{spots[c]}").alias(c) if c in spots else ref(c) for c in df.columns]
        )
    return joined.select(
        *[
            F.col(f"__m{spots[c]}").alias(c) if c in spots else F.col(f"__k{keys[c]}").alias(c)
            for c in df.columns
        ]
    )


def _agrees(char: Column, other: Column) -> Column:
    """A neighbour's star or equal letter (any case) at the same place."""
    return F.coalesce((other == text.STAR) | (text.fold(char) == text.fold(other)), F.lit(False))


def _tail_hits(own: Column, before: Column, after: Column) -> Column:
    """For each of the last characters, last one first: does a neighbour agree there?"""

    def hit(char: Column, spot: Column) -> Column:
        near = _agrees(char, F.get(before, spot)) | _agrees(char, F.get(after, spot))
        return char.rlike(r"\A[\p{L}\p{N}]\z") & near

    return F.transform(own, hit)


def _tail(value: Column, count: int) -> Column:
    return F.reverse(text.chars(F.right(value, F.lit(count))))


def _beside_tails(
    df: DataFrame, columns: Sequence[str], count: int, order_by: Sequence[str]
) -> DataFrame:
    """Adds ``__h0`` …: which of the last ``count`` characters agree with a neighbour."""
    tails = {f"p{i}": _tail(F.col(f"__t{i}"), count) for i in range(len(columns))}
    rows = beside(df, order_by, [c.alias(n) for n, c in tails.items()])
    return rows.withColumns(
        {
            f"__h{i}": _tail_hits(tail, F.col(f"__before.p{i}"), F.col(f"__after.p{i}"))
            for i, tail in enumerate(tails.values())
        }
    ).drop("__before", "__after")


def mask_adjacent(
    df: DataFrame, columns: Sequence[str], count: int, order_by: Sequence[str]
) -> DataFrame:
    """Hide each of the last ``count`` characters that a neighbour shares there."""
    if count <= 0:
        return df
    rows = _beside_tails(with_texts(df, columns, order_by), columns, count, order_by)
    for i in range(len(columns)):
        value, hits = F.col(f"__t{i}"), F.col(f"__h{i}")
        tail = F.zip_with(
            _tail(value, count), hits, lambda c, h: F.when(h, F.lit(text.STAR)).otherwise(c)
        )
        kept = F.left(value, F.greatest(F.length(value) - count, F.lit(0)))
        rows = rows.withColumn(f"__m{i}", F.concat(kept, F.array_join(F.reverse(tail), "")))
    return put_in_place(df, rows, columns)


def mask_adjacent_consistently(
    df: DataFrame, columns: Sequence[str], count: int, order_by: Sequence[str]
) -> DataFrame:
    """As ``mask_adjacent``, and every copy of a value (any case) shows the same mask.

    Places hidden for one copy are hidden for all; the letters come from the
    last copy in order. The cells of all columns make one long table of (column,
    value), whose masks are combined as bit words by a map-side aggregate: a
    value that fills a third of the table costs one row per task, and the join
    back cuts such a value in slices. The exchanges do not grow with the columns.
    """
    if count <= 0:
        return df
    narrow, keys = key_and_texts(df, columns, order_by), keys_of(order_by)
    words = [range(at, min(at + _WORD, count)) for at in range(0, count, _WORD)]
    packed = [f"w{j}" for j in range(len(words))]

    def cell(i: int, *more: Column) -> Column:
        value = F.col(f"__t{i}")
        return F.struct(F.lit(i).alias("__c"), text.fold_text(value).alias("__fold"), *more)

    def marked_cell(i: int) -> Column:
        value = F.col(f"__t{i}")
        bits = [
            bit_word(F.col(f"__h{i}"), word.start, len(word)).alias(name)
            for name, word in zip(packed, words)
        ]
        return cell(i, F.length(value).alias("__size"), value.alias("__shown"), *bits)

    spot = F.struct(*[F.col(k) for k in keys])
    marked = _beside_tails(narrow, columns, count, keys)
    per_size = (
        marked.select(spot.alias("__spot"), F.inline(F.array(*map(marked_cell, range(len(columns))))))
        .where(F.col("__fold").isNotNull())
        .groupBy("__c", "__fold", "__size")
        .agg(
            F.count("*").alias("__n"),
            F.max(F.struct(F.col("__spot").alias("at"), F.col("__shown").alias("shown"))).alias("__last"),
            *[F.bit_or(w).alias(w) for w in packed],
        )
    )
    # copies differ in length only where folding lengthens a letter: few sizes per value
    combined = per_size.groupBy("__c", "__fold").agg(
        F.sum("__n").alias("__n"),
        F.max("__last").getField("shown").alias("__shown"),
        F.min("__size").alias("__least"),
        F.collect_list(
            F.struct(F.col("__size").alias("size"), F.array(*packed).alias("bits"))
        ).alias("__masks"),
    )
    combined = combined.withColumn("__m", _rebuilt()).select("__c", "__fold", "__n", "__m")
    cells = narrow.select(spot.alias("__spot"), F.inline(F.array(*map(cell, range(len(columns))))))
    found = lookup_join(cells, combined, ["__c", "__fold"], "__n", ["__spot", "__c"])
    by_row = found.groupBy("__spot").agg(
        *[F.max(F.when(F.col("__c") == i, F.col("__m"))).alias(f"__m{i}") for i in range(len(columns))]
    )
    return put_beside(df, by_row.select("__spot.*", "*").drop("__spot"), columns, order_by)


def bit_word(hits: Column, start: int, width: int) -> Column:
    """Pack ``hits[start : start + width]`` in a long, first hit in the lowest bit."""
    return F.aggregate(
        F.transform(
            F.slice(hits, start + 1, width),
            lambda h, j: F.when(h, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(
                F.lit(0).cast("bigint")
            ),
        ),
        F.lit(0).cast("bigint"),
        lambda total, bit: total.bitwiseOR(bit),
    )


def _rebuilt() -> Column:
    shown, masks, least = F.col("__shown"), F.col("__masks"), F.col("__least")

    def hidden(place: Column) -> Column:
        def by(mask: Column) -> Column:
            offset = mask["size"] - place - 1  # 0 for the last character
            word = F.get(mask["bits"], F.floor(offset / _WORD).cast("int"))
            bit = F.call_function("shiftright", word, F.pmod(offset, F.lit(_WORD)).cast("int"))
            return F.coalesce((offset >= 0) & (bit.bitwiseAND(F.lit(1).cast("bigint")) == 1), F.lit(False))

        return F.exists(masks, by) | (place >= least)

    return F.array_join(
        F.transform(
            text.chars(shown), lambda c, p: F.when(hidden(p), F.lit(text.STAR)).otherwise(c)
        ),
        "",
    )


def mask_cyclic(
    df: DataFrame, columns: Sequence[str], count: int, order_by: Sequence[str]
) -> DataFrame:
    """Hide every non-blank character equal to the one above or below it.

    The first and last row are neighbours. ``count`` only switches the mask on.
    Trailing white space is dropped.
    """
    payload = [text.chars(F.col(f"__t{i}")).alias(f"p{i}") for i in range(len(columns))]
    rows = beside(with_texts(df, columns, order_by), order_by, payload, cyclic=True)
    for i in range(len(columns)):
        above, below = F.col(f"__before.p{i}"), F.col(f"__after.p{i}")
        on = F.lit(count >= 1)

        def shown(char: Column, place: Column) -> Column:
            same = F.coalesce(F.get(above, place) == char, F.lit(False)) | F.coalesce(
                F.get(below, place) == char, F.lit(False)
            )
            return F.when(on & same & (char != " "), F.lit(text.STAR)).otherwise(char)

        masked = F.array_join(F.transform(text.chars(F.col(f"__t{i}")), shown), "")
        rows = rows.withColumn(f"__m{i}", F.regexp_replace(masked, r"\s+\z", ""))
    return put_in_place(df, rows, columns)
