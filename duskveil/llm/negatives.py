"""Hard negatives by exact search over blocks with zone maps.

Rows are written in the order of label and Hilbert curve and cut into blocks.
A block's zone map holds the smallest and largest number of every dimension,
which bounds the inner product of an anchor with any row of the block from both
sides. An anchor first reads one promising block; what it finds there is a
threshold, and then it reads exactly the blocks whose bounds reach into what is
still wanted. Nothing is approximate: where bounds tell nothing, all blocks are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duskveil.plans.ordering import PART, SPOT, freeze_order
from duskveil.plans.scratch import stash

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_RUN_BITS = _LENGTH_BITS = 20


@dataclass(frozen=True)
class Mining:
    """``positives`` of an anchor, ``negatives`` of a pair, whose score lies
    between ``low`` and ``high`` percent of the positive's. Components are
    multiplied by ``scale`` and rounded down. ``block_numbers``: components of a
    block of rows. ``cell_rows``: anchors, or zone maps, that one task compares
    with a block, about. The curve runs through ``curve_dims`` dimensions of the
    largest spread, cut in 2 ** ``curve_bits`` slices each."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    block_numbers: int = 1 << 17
    cell_rows: int = 2048
    curve_dims: int = 8
    curve_bits: int = 4


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (numbers below 2 ** ``bits``).

    From the coarsest bit to the finest, each axis undoes the turn of the
    quadrant it lies in; the bits that remain, as a Gray code read across the
    axes, count along the curve (Skilling, 2004).
    """
    x = cells.T.astype(np.int64).copy()
    if not len(x):
        return np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in x:
            turned = (axis >> bit) & 1 == 1
            # in a turned quadrant the first axis is mirrored, elsewhere it is swapped
            swap = np.where(turned, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(turned, below, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | ((axis >> bit) & 1)
    return place


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers held as doubles, as 64-bit integers."""
    reach = (np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    bound = int(reach[0]) * int(reach[1]) * a.shape[1]
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if bound >= 1 << 63 or max(reach) >= 1 << 63:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def product_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between
    ``low`` and ``high``, a row per box, widened by what rounding may lose."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    slack = 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _usable(embeddings: DataFrame, is_anchor: Column, mining: Mining) -> DataFrame:
    """Rows that take part: a label and a vector of finite numbers, in double precision."""
    finite = F.forall("numbers", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: x.cast("double") * float(mining.scale))
    return embeddings.select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        scaled.alias("numbers"),
    ).where(F.col("label").isNotNull() & F.col("numbers").isNotNull() & finite)


def _curve_axes(rows: DataFrame, mining: Mining) -> dict[int, tuple[list[int], list[float], list[float]]]:
    """For each vector length the dimensions of the curve, their means and
    spreads: one small row per dimension."""
    each = rows.select(F.size("numbers").alias("length"), F.posexplode("numbers").alias("axis", "x"))
    spreads = each.groupBy("length", "axis").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")
    )
    axes: dict[int, list] = {}
    for r in spreads.collect():
        axes.setdefault(r["length"], []).append((-(r["spread"] or 0.0), r["axis"], r["mean"]))
    return {
        length: tuple(map(list, zip(*[(i, m, -s or 1.0) for s, i, m in sorted(own)[: mining.curve_dims]])))
        for length, own in axes.items()
    }


_PLACED = (
    "row bigint, id bigint, nameless boolean, label string, is_anchor boolean, length int, curve bigint, "
    "vector array<double>"
)


def _with_curve(rows: DataFrame, mining: Mining) -> DataFrame:
    """Whole vectors with their place on the curve and a number of their own."""
    axes = _curve_axes(rows, mining)
    struct = StructType.fromDDL(_PLACED)
    schema = to_arrow_schema(struct)
    slices = 1 << mining.curve_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = batch.column("numbers")
            lengths = pc.list_value_length(lists).to_numpy().astype(np.int32)
            starts = np.append(0, np.cumsum(lengths))
            whole = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
            curve = np.zeros(batch.num_rows, np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                if length:
                    dims, means, spreads = axes[int(length)]
                    x = whole[starts[own][:, None] + np.array(dims)[None, :]]
                    spot = (x - means) / spreads / 4 + 0.5  # two spreads to either side
                    curve[own] = hilbert(np.clip(spot * slices, 0, slices - 1).astype(np.int64), mining.curve_bits)
            ids = batch.column("id")
            arrays = [
                pa.array(np.arange(at, at + batch.num_rows)),
                pc.fill_null(ids, MOST),
                pc.is_null(ids),
                batch.column("label"),
                batch.column("is_anchor"),
                pa.array(lengths),
                pa.array(curve),
                pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(whole)),
            ]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pc.cast(a, f.type) for a, f in zip(arrays, schema)], schema=schema
            )

    return stash(rows.mapInArrow(run, struct))


def blocks_in_order(rows: DataFrame, mining: Mining) -> DataFrame:
    """The rows in order of length, label, curve, with the number of their block."""
    order = [F.col(c).asc() for c in ("length", "label", "curve", "row")]
    held = F.greatest(F.lit(1), F.floor(F.lit(mining.block_numbers) / F.greatest("length", F.lit(1))))
    run = F.floor(F.col(SPOT) / held).cast("bigint")
    too_long = F.raise_error(F.lit("vectors of a million numbers or more"))
    length = F.when(F.col("length") < (1 << _LENGTH_BITS), F.col("length").cast("bigint")).otherwise(
        too_long.cast("bigint")
    )
    part = F.shiftleft(F.col(PART).cast("bigint"), _RUN_BITS + _LENGTH_BITS)
    block = part + F.shiftleft(run, _LENGTH_BITS) + length
    return freeze_order(rows, order).df.withColumn("block", block).drop(PART, SPOT, "curve")


_ZONES = "block bigint, length int, first string, last string, low array<double>, high array<double>"


def zone_maps(placed: DataFrame) -> DataFrame:
    """Least and greatest label and number of each dimension, per block. Parts of
    blocks are mapped where they are read; only those maps are exchanged."""
    struct = StructType.fromDDL(_ZONES)
    schema = to_arrow_schema(struct)

    def table(blocks, lengths, firsts, lasts, lows, highs):
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip((blocks, lengths, firsts, lasts, lows, highs), schema)],
            schema=schema,
        )

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)), len(blocks))
            made = []
            for a, b in zip(cuts, cuts[1:]):
                own = batch.slice(a, b - a)
                vectors = _matrix(pa.chunked_array([own.column("vector")]))
                labels = own.column("label").to_pylist()
                made.append(
                    (blocks[a], vectors.shape[1], min(labels), max(labels), vectors.min(0), vectors.max(0))
                )
            if made:
                yield table(*zip(*made))

    def merged(parts: pa.Table) -> pa.Table:
        low, high = _matrix(parts["low"]), _matrix(parts["high"])
        return pa.Table.from_batches(
            [
                table(
                    [parts["block"][0].as_py()], [parts["length"][0].as_py()],
                    [pc.min(parts["first"]).as_py()], [pc.max(parts["last"]).as_py()],
                    [low.min(0)], [high.max(0)],
                )
            ]
        )

    parts = placed.select("block", "label", "vector").mapInArrow(part, struct)
    return stash(parts.groupBy("block").applyInArrow(merged, struct))


def compare_with_zones(
    anchors: DataFrame, zones: DataFrame, choose: Callable, schema: str, mining: Mining
) -> DataFrame:
    """``choose(anchors, zones, least, greatest)`` over every anchor and zone map of
    one length: some thousand anchors and some thousand maps in a task."""
    counts = [int(df.count()) for df in (anchors, zones)]
    down, across = (max(1, -(-n // mining.cell_rows)) for n in counts)
    left = anchors.withColumns(
        {
            "line": F.pmod(F.xxhash64("row"), F.lit(down)).cast("int"),
            "column": F.explode(F.sequence(F.lit(0), F.lit(across - 1))),
        }
    )
    right = zones.withColumns(
        {
            "column": F.pmod(F.xxhash64("block"), F.lit(across)).cast("int"),
            "line": F.explode(F.sequence(F.lit(0), F.lit(down - 1))),
        }
    )
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def compare(own: pa.Table, maps: pa.Table) -> pa.Table:
        found = [[] for _ in arrow]
        if own.num_rows and maps.num_rows:
            low, high = _matrix(maps["low"]), _matrix(maps["high"])
            for start in range(0, own.num_rows, 256):
                some = own.slice(start, 256)
                bounds = product_bounds(_matrix(some["vector"]), low, high)
                for column, values in zip(found, choose(some, maps, *bounds)):
                    column.extend(values)
        return pa.table([pa.array(v, f.type) for v, f in zip(found, arrow)], schema=arrow)

    cell = ["length", "line", "column"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, struct)


_FOUND = "row bigint, pair int, other bigint, id bigint, nameless boolean, score bigint"


def read_blocks(
    asked: DataFrame, anchors: DataFrame, placed: DataFrame, pick: Callable, mining: Mining
) -> DataFrame:
    """What ``pick`` finds for the pairs ``row, block`` of ``asked``, each once.

    A block goes to as many tasks as the anchors that ask for it fill; blocks
    that nobody asks for are not moved.
    """
    asked = stash(asked.select("row", "block"))
    lines = asked.groupBy("block").agg(
        F.ceil(F.count("*") / float(mining.cell_rows)).cast("int").alias("lines")
    )
    line = F.pmod(F.xxhash64("row"), F.col("lines")).cast("int")
    left = placed.select("block", F.col("row").alias("other"), "id", "nameless", "label", "vector").join(
        lines, "block"
    ).withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines") - 1))).drop("lines")
    right = (
        asked.join(lines, "block")
        .select("row", F.col("block").alias("home"), line.alias("line"))
        .join(anchors, "row")
    )
    struct = StructType.fromDDL(_FOUND)
    arrow = to_arrow_schema(struct)

    def read(rows: pa.Table, own: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in arrow]
        if rows.num_rows and own.num_rows:
            other, ids = rows["other"].to_numpy(), rows["id"].to_numpy()
            nameless = rows["nameless"].to_numpy().astype(bool)
            labels = np.array(rows["label"].to_pylist(), dtype=object)
            matrix = _matrix(rows["vector"])
            # in the order of ties, so that equal scores keep it
            order = np.lexsort((other, nameless, ids))
            other, ids, nameless, labels, matrix = (x[order] for x in (other, ids, nameless, labels, matrix))
            for start in range(0, own.num_rows, 256):
                some = own.slice(start, 256)
                scores = inner_products(_matrix(some["vector"]), matrix)
                numbers = some["row"].to_pylist()
                for i, pair, best in pick(some, other, labels, scores):
                    n = len(best)
                    values = ([numbers[i]] * n, [pair] * n, other[best], ids[best], nameless[best], scores[i][best])
                    for column, more in zip(found, values):
                        column.extend(more)
        return pa.table([pa.array(v, f.type) for v, f in zip(found, arrow)], schema=arrow)

    cells = right.groupBy("home", "line")
    return stash(left.groupBy("block", "line").cogroup(cells).applyInArrow(read, struct))


def _first(scores: np.ndarray, within: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among ``within`` (ascending places)."""
    if len(within) > 8 * k:
        own = scores[within]
        edge = np.partition(own, len(own) - k)[len(own) - k]
        within = within[own >= edge]
    return within[np.argsort(-scores[within], kind="stable")[:k]]


def _pick_positives(k: int):
    def pick(some: pa.Table, other: np.ndarray, labels: np.ndarray, scores: np.ndarray):
        floors = some["floor"].to_numpy()
        for i, (own, label) in enumerate(zip(some["row"].to_pylist(), some["label"].to_pylist())):
            within = np.flatnonzero((labels == label) & (other != own) & (scores[i] >= floors[i]))
            yield i, 0, _first(scores[i], within, k)

    return pick


def _pick_negatives(k: int):
    def pick(some: pa.Table, other: np.ndarray, labels: np.ndarray, scores: np.ndarray):
        for i, label in enumerate(some["label"].to_pylist()):
            foreign = np.flatnonzero(labels != label)
            line = scores[i][foreign]
            floors, highs = some["floors"][i].as_py(), some["highs"][i].as_py()
            for pair, (floor, high) in enumerate(zip(floors, highs), 1):
                within = foreign[(line >= floor) & (line <= high)]
                if len(within):
                    yield i, pair, _first(scores[i], within, k)

    return pick


def _reaching_positives(some: pa.Table, maps: pa.Table, least: np.ndarray, greatest: np.ndarray):
    """Blocks that may hold a row of the anchor's label at or above its threshold."""
    first, last = (np.array(maps[c].to_pylist(), dtype=object) for c in ("first", "last"))
    blocks = maps["block"].to_numpy()
    out: tuple[list, list] = ([], [])
    floors, own = some["floor"].to_numpy(), some["own"].to_numpy()
    for i, (row, label) in enumerate(zip(some["row"].to_pylist(), some["label"].to_pylist())):
        wanted = (greatest[i] >= floors[i]) & (first <= label) & (last >= label) & (blocks != own[i])
        out[0].extend([row] * int(wanted.sum()))
        out[1].extend(blocks[wanted].tolist())
    return out


def _promising(some: pa.Table, maps: pa.Table, least: np.ndarray, greatest: np.ndarray):
    """For each pair the block whose bounds are centred nearest the window's top."""
    first, last = (np.array(maps[c].to_pylist(), dtype=object) for c in ("first", "last"))
    blocks = maps["block"].to_numpy()
    out: tuple[list, list, list, list] = ([], [], [], [])
    for i, (row, label) in enumerate(zip(some["row"].to_pylist(), some["label"].to_pylist())):
        foreign = (first != label) | (last != label)
        middle = (least[i] + greatest[i]) / 2
        for pair, (low, high) in enumerate(zip(some["floors"][i].as_py(), some["highs"][i].as_py()), 1):
            within = np.flatnonzero(foreign & (greatest[i] >= low) & (least[i] <= high)) if low <= high else []
            if len(within):
                gap = np.abs(middle[within] - high)
                best = int(np.argmin(gap))
                for column, value in zip(out, (row, pair, int(blocks[within[best]]), float(gap[best]))):
                    column.append(value)
    return out


def _reaching_negatives(some: pa.Table, maps: pa.Table, least: np.ndarray, greatest: np.ndarray):
    """Blocks not yet read that may hold a row of another label inside what is left of a window."""
    first, last = (np.array(maps[c].to_pylist(), dtype=object) for c in ("first", "last"))
    blocks = maps["block"].to_numpy()
    out: tuple[list, list] = ([], [])
    for i, (row, label) in enumerate(zip(some["row"].to_pylist(), some["label"].to_pylist())):
        wanted = np.zeros(len(blocks), bool)
        for floor, high in zip(some["floors"][i].as_py(), some["highs"][i].as_py()):
            if floor <= high:
                wanted |= (greatest[i] >= floor) & (least[i] <= high)
        wanted &= ((first != label) | (last != label)) & ~np.isin(blocks, some["seen"][i].as_py())
        out[0].extend([row] * int(wanted.sum()))
        out[1].extend(blocks[wanted].tolist())
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("id"), F.asc("nameless"), F.asc("other")]
    by = Window.partitionBy("row", "pair").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The rows that the column ``is_anchor`` selects are anchors. An anchor's
    positives are the other rows of its label with the highest scores; for each
    of them the negatives are the highest-scoring rows of other labels whose
    score lies within the window of shares of the positive's score, ends
    included. Equal scores go to the smaller id. Scores are inner products of
    whole numbers (components times ``scale``, rounded down) and exact; products
    beyond 64 bits raise an error.

    Rows with a null label, a null vector, or a null or non-finite component take
    no part. A row without an id takes part as a candidate, after the others of
    its score, and its id is null. Vectors meet those of their own length. Each
    row is one, also among repeated ones: a copy of an anchor is another row. A
    pair without negatives has no row; no rows give no rows. Other columns are not read.
    """
    rows = _with_curve(_usable(embeddings, is_anchor, mining), mining)
    placed = blocks_in_order(rows, mining)
    zones = zone_maps(placed)
    anchors = stash(placed.where("is_anchor").select("row", "id", "label", "length", "vector", "block"))
    plain = anchors.select("row", "label", "length", "vector")

    # positives: the anchor's own block gives a threshold, then all blocks that reach it
    pick = _pick_positives(mining.positives)
    near = read_blocks(
        anchors.select("row", "block"), plain.drop("length").withColumn("floor", F.lit(LEAST)), placed, pick, mining
    )
    floors = (
        _ranked(near, mining.positives).where(F.col("rank") == mining.positives)
        .select("row", F.col("score").alias("found_floor"))
    )
    with_floor = stash(
        anchors.select("row", "label", "length", "vector", F.col("block").alias("own"))
        .join(floors, "row", "left")
        .withColumn("floor", F.coalesce("found_floor", F.lit(LEAST)))
        .drop("found_floor")
    )
    asked = compare_with_zones(with_floor, zones, _reaching_positives, "row bigint, block bigint", mining)
    far = read_blocks(asked, with_floor.drop("length", "own"), placed, pick, mining)
    positives = stash(_ranked(near.unionByName(far), mining.positives))

    # negatives: one promising block per window gives a threshold, then all that reach the rest
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    windows = positives.groupBy("row").agg(scores.alias("scores"))
    low, high = _share(mining.low, True), _share(mining.high, False)
    windows = windows.select(
        "row",
        F.expr(f"transform(scores, x -> {low})").alias("lows"),
        F.expr(f"transform(scores, x -> {high})").alias("highs"),
    )
    waiting = stash(plain.join(windows, "row"))
    probes = compare_with_zones(
        waiting.withColumnRenamed("lows", "floors"), zones, _promising,
        "row bigint, pair int, block bigint, gap double", mining,
    )
    probed = stash(
        probes.groupBy("row", "pair").agg(F.min_by("block", F.struct("gap", "block")).alias("block"))
        .select("row", "block").distinct()
    )
    pick = _pick_negatives(mining.negatives)
    close = read_blocks(
        probed, waiting.drop("length").withColumnRenamed("lows", "floors"), placed, pick, mining
    )
    raised = (
        _ranked(close, mining.negatives).where(F.col("rank") == mining.negatives)
        .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pair", "score"))).alias("raised"))
    )
    seen = probed.groupBy("row").agg(F.collect_list("block").alias("seen"))  # one per window at most
    raise_floor = F.transform(
        "lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("raised", i + 1), x))
    )
    left = stash(
        waiting.join(raised, "row", "left").join(seen, "row", "left").select(
            "row", "label", "length", "vector", "highs", raise_floor.alias("floors"),
            F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"),
        )
    )
    asked = compare_with_zones(left, zones, _reaching_negatives, "row bigint, block bigint", mining)
    rest = read_blocks(asked, left.drop("length", "seen"), placed, pick, mining)
    negatives = _ranked(close.unionByName(rest), mining.negatives)

    def named(prefix: str) -> Column:
        return F.when(~F.col("nameless"), F.col("id")).alias(f"{prefix}_id")

    return (
        negatives.select(
            "row", F.col("pair").alias("at"), "rank", named("negative"), F.col("score").alias("negative_score")
        )
        .join(
            positives.select(
                "row", F.col("rank").alias("at"), named("positive"), F.col("score").alias("positive_score")
            ),
            ["row", "at"],
        )
        .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _share(percent: int, up: bool) -> str:
    """SQL of ``percent`` of the whole number ``x``, rounded up or down without
    leaving 64 bits."""
    x = "(-x)" if up else "x"
    part = f"pmod({x}, 100L)"
    whole = f"({x} - {part}) div 100L * {percent}L + {part} * {percent}L div 100L"
    return f"-({whole})" if up else whole
