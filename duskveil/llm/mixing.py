"""Mix sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies. Pairs of documents whose
number is not whole pass words from one to the other, in a random direction
that leaves the expectation alone, until one of the two is whole. What is left
of each group of documents moves up a reduction tree; at its root at most one
document per source is rounded by itself, so a source takes its target up to a
part of one document.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskveil.llm.batches import WORD
from duskveil.plans.scratch import stash

#: Weights of the sources in code point order, repeating; a null source comes last.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix per word of the documents.
SHARE = 1.5
#: Most copies of a document.
MOST = 2.0
#: Documents that one task of the reduction tree rounds together, about.
GROUP_ROWS = 4096
#: Residuals that meet in one group on the next level.
FAN_IN = 1024

_STEP = "doc_id bigint, ident bigint, source string, size bigint, expected double, copies int, node bigint"
_WHOLE = 1e-9


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, docs, source_size, target`` from ``source, docs, source_size``.

    Each source is offered its weight's part of the mix. Who is offered more
    than ``most`` times its size stops there, and the excess is offered again
    by weight. In the order of size per weight the sources that stop come
    first, so running sums find them without a loop. One row per source passes
    through here, never documents.
    """
    everyone = Window.partitionBy(F.lit(0))
    by_name = everyone.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.get(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.row_number().over(by_name) - 1) % len(weights),
    )
    cap = F.col("source_size") * F.lit(most)
    filling = everyone.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    placed = (
        sizes.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("level", level)
        .withColumn("stops", F.col("level") * F.col("weight") >= cap)
    )
    # later levels take every earlier source for full, so the first that does not stop is the largest
    common = F.max(F.when(~F.col("stops"), F.col("level"))).over(everyone)
    target = F.when(F.col("stops"), cap).otherwise(common * F.col("weight"))
    return placed.withColumn("target", target).select("source", "docs", "source_size", "target")


def mix(docs: DataFrame, seed: int = 7, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every document.

    The size is the number of words; a null or empty text has none and is taken
    0 times. A null ``source`` is a source of its own, the last. Repeated rows
    and null ids are documents of their own; rows without an id are told apart by
    their place in the table. No documents give no rows. All randomness comes
    from the seed and the row, so reruns agree.
    """
    # rows without an id go by their number, or all of them would meet in one group
    narrow = docs.select(
        "doc_id",
        F.coalesce("doc_id", -1 - F.monotonically_increasing_id()).alias("ident"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    sized = stash(narrow)
    totals = sized.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("size").alias("source_size")
    )
    # one row per source, read again below
    targets = stash(source_targets(totals))
    rounded = round_copies(_with_targets(sized, targets, ["docs", "source_size", "target"]), seed, group_rows, fan_in)
    out = _with_targets(rounded, targets, ["source_size", "target"])
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
        "source",
    )


#: A hot source is cut into so many slices for the join with its target.
SLICES = 64


def _with_targets(df: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """Join by source. A source may hold a third of the rows, so each source's
    rows are dealt to ``SLICES`` slices and its one target row is repeated."""
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64("ident", "size"), F.lit(SLICES)).cast("int"))
    table = targets.select(
        F.col("source").alias("__source"),
        *columns,
        F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("__part"),
    )
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__slice") == F.col("__part"))
    return sliced.join(table, same).drop("__slice", "__source", "__part")


def round_copies(df: DataFrame, seed: int, group_rows: int, fan_in: int) -> DataFrame:
    """``doc_id, ident, source, size, expected, copies``: the reduction tree.

    Groups hold ``group_rows`` documents of one source on the first level and
    ``fan_in`` residuals on the others, whatever the size of the source.
    """
    per_word = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    groups = F.ceil(F.col("docs") / float(group_rows))
    spot = F.xxhash64(F.lit(seed), "ident", "size")
    level = df.select(
        "doc_id",
        "ident",
        "source",
        "size",
        F.when(F.col("size") > 0, per_word).otherwise(F.lit(0.0)).alias("expected"),
        F.pmod(spot, groups).cast("bigint").alias("node"),
        groups.cast("bigint").alias("nodes"),
    )
    most = df.agg(F.max(groups)).first()[0]
    nodes = int(most or 1)
    done = []
    while True:
        last = nodes <= 1
        pairs = _round_groups(level.drop("nodes"), seed, last)
        state = stash(pairs)
        done.append(state.where("copies is not null"))
        if last:
            break
        level = state.where("copies is null").select(
            "doc_id", "ident", "source", "size", "expected", F.floor(F.col("node") / fan_in).alias("node")
        )
        nodes = -(-nodes // fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("node")


def _round_groups(level: DataFrame, seed: int, last: bool) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # the largest first, so that what is left over at the end is small
        ties = [_draw(seed, i, s) for i, s in zip(group["ident"], group["size"])]
        group = group.assign(tie=ties).sort_values(
            ["size", "tie", "ident"], ascending=[False, True, True], kind="stable"
        )
        expected = group["expected"].to_numpy(dtype=float)
        sizes = group["size"].to_numpy(dtype=float)
        residual = pivot(expected, sizes, group["tie"].to_numpy())
        copies = pd.array(expected.round(), dtype="Int32")
        if residual is not None:
            if last:
                up = (group["tie"].iloc[residual] >> 11) / 2**53 < expected[residual] % 1
                copies[residual] = int(expected[residual] // 1 + up)
            else:
                copies[residual] = None
        return group.drop(columns="tie").assign(expected=expected, copies=copies)[
            ["doc_id", "ident", "source", "size", "expected", "copies", "node"]
        ]

    return level.groupBy("source", "node").applyInPandas(run, _STEP)


def _draw(seed: int, ident: int, size: int) -> int:
    """64 random bits of a document."""
    return xxhash.xxh64_intdigest(f"{seed}:{ident}:{size}", seed)


def pivot(expected, sizes, bits) -> int | None:
    """Make ``expected`` whole in place, apart from one entry at most, whose
    place is returned. The sum of ``expected * sizes`` does not change.

    Two entries with parts ``a`` and ``b`` above the whole numbers below them
    can pass words up to ``gain`` in one direction or ``loss`` in the other;
    the direction is drawn so that neither entry's expectation changes.
    """
    open_at = None
    for i in range(len(expected)):
        part = expected[i] % 1
        if min(part, 1 - part) < _WHOLE:
            continue
        if open_at is None:
            open_at = i
            continue
        a = expected[open_at] % 1
        b = part
        gain = min((1 - a) * sizes[open_at], b * sizes[i])
        loss = min(a * sizes[open_at], (1 - b) * sizes[i])
        draw = (int(bits[i]) ^ (int(bits[open_at]) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> 11
        words = gain if draw / 2**53 < loss / (gain + loss) else -loss
        expected[open_at] += words / sizes[open_at]
        expected[i] -= words / sizes[i]
        for at in (open_at, i):
            if abs(expected[at] - round(expected[at])) < _WHOLE:
                expected[at] = round(expected[at])
        if expected[open_at] == round(expected[open_at]):
            open_at = i if expected[i] != round(expected[i]) else None
    return open_at


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, all columns kept.

    The copies join back by a number written beside each row, so equal rows and
    null ids do not matter.
    """
    names = docs.columns
    # by place, so that no name of the caller's can clash with ours
    inner = {n: f"c{i}" for i, n in enumerate(names)}
    numbered = stash(docs.toDF(*inner.values()).withColumn("row", F.monotonically_increasing_id()))
    own = numbered.select(
        F.col("row").alias("doc_id"), F.col(inner["source"]).alias("source"), F.col(inner["text"]).alias("text")
    )
    taken = mix(own, seed=seed).select(F.col("doc_id").alias("taken_row"), "copies")
    joined = numbered.join(taken.where("copies > 0"), F.col("row") == F.col("taken_row"))
    copied = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*inner.values()).toDF(*names)
