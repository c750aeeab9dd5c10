"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint is a path of 64 bits in a binary trie. The join walks down pairs
of nodes together, adds up the bits in which they differ and drops a pair as
soon as more than the allowed bits differ. Of four 16-bit blocks at least one
is equal in fingerprints that differ in three bits, so four tries are walked,
each beginning with another block and with no error allowed in it. That makes
the first block the key by which Spark deals the tries to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskveil.llm.batches import map_columns
from duskveil.llm.components import connected_components
from duskveil.plans.scratch import stash

SHINGLE_WORDS = 3
BUDGET = 3
SEED = 42
BLOCK_BITS = 16
#: Node pairs that are walked down at once; the others wait on a stack.
PAIR_BLOCK = 1 << 18
#: Shingles whose bits are counted at once.
HASH_BLOCK = 1 << 14


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles with A-Z in lower case; 0 without a word."""
    # UTF-8 bytes: lower() changes A-Z alone, split() cuts at ASCII white space
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(words_each)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    set_times = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), HASH_BLOCK):
        block = hashes[start : start + HASH_BLOCK].view(np.uint8).reshape(-1, 8)
        set_times += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_times > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and ``fp``, the fingerprint as a signed long."""

    def make():
        def run(texts, *rest):
            return [*rest, [_signed(fingerprint(t)) for t in texts]]

        return run

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["fp bigint"])
    return map_columns(docs.select("text", *[f"`{c}`" for c in carry]), make, schema)


def node_pairs(keys: np.ndarray, starts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs ``i < j`` of linked keys.

    ``keys`` are sorted, distinct and unsigned; a trie node is the run of keys
    with its prefix. ``starts`` are where the runs of equal first blocks begin.
    """
    low = starts.astype(np.int64)
    high = np.append(low[1:], len(keys))
    many = high - low > 1
    low, high = low[many], high[many]
    stack = [
        (BLOCK_BITS, low[i : i + PAIR_BLOCK], high[i : i + PAIR_BLOCK], low[i : i + PAIR_BLOCK], high[i : i + PAIR_BLOCK], np.zeros(len(low[i : i + PAIR_BLOCK]), dtype=np.int8))
        for i in range(0, len(low), PAIR_BLOCK)
    ]
    while stack:
        bit, alow, ahigh, blow, bhigh, differ = stack.pop()
        single = (ahigh - alow == 1) & (bhigh - blow == 1)
        if single.any():
            i, j = alow[single], blow[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if near.any():
                yield i[near], j[near]
            rest = ~single
            alow, ahigh, blow, bhigh, differ = alow[rest], ahigh[rest], blow[rest], bhigh[rest], differ[rest]
        if not len(alow) or bit == 64:
            continue
        amid, bmid = _split(keys, alow, ahigh, bit), _split(keys, blow, bhigh, bit)
        itself = alow == blow
        other = ~itself
        parts = [
            (alow, amid, blow, bmid, differ, None),
            (amid, ahigh, bmid, bhigh, differ, None),
            (alow, amid, bmid, bhigh, differ + 1, None),
            (amid, ahigh, blow, bmid, differ + 1, other),  # a node with itself: once is enough
        ]
        kept = []
        for al, ah, bl, bh, d, where in parts:
            good = (ah > al) & (bh > bl) & (d <= budget) & ~((al == bl) & (ah - al == 1))
            if where is not None:
                good &= where
            kept.append([x[good] for x in (al, ah, bl, bh, d)])
        joined = [np.concatenate(x) for x in zip(*kept)]
        for at in range(0, len(joined[0]), PAIR_BLOCK):
            stack.append((bit + 1, *[x[at : at + PAIR_BLOCK] for x in joined]))


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys of each node begin that have the bit set."""
    place = np.uint64(63 - bit)
    above = (keys[low] >> place | np.uint64(1)) << place
    return np.clip(np.searchsorted(keys, above), low, high)


class _Forest:
    """Union-find over the places of an array; the smallest place is the root."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def roots(self, places: np.ndarray) -> np.ndarray:
        at = self.up[places]
        while True:
            further = self.up[at]
            if np.array_equal(further, at):
                return at
            at = further

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def all(self) -> np.ndarray:
        return self.roots(np.arange(len(self.up)))


def _linked(fps: np.ndarray, rotations: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within whole tries: fingerprint, smaller fingerprint."""
    found = []
    for rotation in np.unique(rotations):
        own = fps[rotations == rotation]
        turn = np.uint64(BLOCK_BITS * int(rotation))
        keys = own if not turn else own << turn | own >> (np.uint64(64) - turn)
        order = np.argsort(keys)
        keys, own = keys[order], own[order]
        starts = np.flatnonzero(np.diff(keys >> np.uint64(64 - BLOCK_BITS), prepend=np.uint64(1 << 63)))
        forest = _Forest(len(keys))
        for i, j in node_pairs(keys, starts, budget):
            forest.link(i, j)
        root = forest.all()
        member = np.flatnonzero(root != np.arange(len(keys)))
        found.append((own[member], own[root[member]]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linked_fingerprints(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges ``a, b`` that connect just the distinct ``fp`` which links connect.

    A task reads whole tries (rotation and first block) in order and keeps one
    run of them in memory. Links within a trie leave it as a forest, so a ball
    of near copies gives as many edges as it has members, not pairs. Of four
    blocks three errors leave one untouched; a larger ``budget`` is an error.
    """
    if budget > BUDGET:
        raise ValueError(f"at most {BUDGET} differing bits")
    block = 64 - BLOCK_BITS

    def first_block(turn: int):
        shifted = F.shiftleft("fp", BLOCK_BITS * turn) if turn else F.col("fp")
        return F.struct(
            F.lit(turn).alias("turn"), F.shiftrightunsigned(shifted, block).alias("block")
        )

    tries = distinct.select(
        "fp", F.inline(F.array(*[first_block(t) for t in range(64 // BLOCK_BITS)]))
    )
    dealt = tries.repartition("turn", "block").sortWithinPartitions("turn", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of fp, turn, block; the last trie may go on

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(rows[0].view(np.uint64), rows[1], budget)
            return pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in (a, b)], schema=_EDGES
            )

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held.append(rows)
            other = np.flatnonzero((rows[1:] != rows[1:, -1:]).any(axis=0))
            begun_here = len(other) > 0  # the last trie of the batch begins in it
            begun_before = len(held) > 1 and (held[-2][1:, -1] != rows[1:, 0]).any()
            if not begun_here and not begun_before:
                continue
            open_rows = batch.num_rows - (int(other[-1]) + 1 if begun_here else 0)
            rows = np.concatenate(held, axis=1)
            yield edges(rows[:, : rows.shape[1] - open_rows])
            held = [rows[:, rows.shape[1] - open_rows :]]
        if held:
            yield edges(np.concatenate(held, axis=1))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """``key, fingerprint, component_id`` for every document.

    ``component_id`` is the smallest key that links reach, itself included. A
    null or empty text has fingerprint zero and is linked like any other. A
    null key is no candidate for the smallest; a component without any key has
    a null id. Repeated rows share a fingerprint and so a component. An empty
    table gives no rows. Copies fall together in one fingerprint before
    anything is joined.
    """
    narrow = stash(fingerprints(docs, [key]))
    by_fp = stash(narrow.groupBy("fp").agg(F.min(key).alias("least")))
    groups = connected_components(linked_fingerprints(by_fp.select("fp"), budget))
    members = by_fp.join(groups, F.col("fp") == F.col("node"), "left")
    rooted = stash(members.select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    out = narrow.join(named, "fp")
    return out.select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One document of each component, all columns kept: the smallest ``doc_id``,
    nulls last; of equal ids the row written first."""
    names = docs.columns
    # by place, so that no name of the caller's can clash with ours
    inner = {n: f"c{i}" for i, n in enumerate(names)}
    numbered = stash(docs.toDF(*inner.values()).withColumn("row", F.monotonically_increasing_id()))
    texts = numbered.select("row", F.col(inner["text"]).alias("text"))
    found = near_duplicates(texts, "row", budget).withColumnRenamed("row", "found_row")
    ids = numbered.select("row", F.col(inner["doc_id"]).alias("doc_id"))
    # equal ids cannot be told apart by the operator, so it runs on row numbers
    placed = found.join(ids, F.col("found_row") == F.col("row")).select(
        "component_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("place")
    )
    first = placed.groupBy("component_id").agg(F.min("place").alias("place"))
    keep = first.select(F.col("place.row").alias("kept_row"))
    kept = numbered.join(keep, F.col("row") == F.col("kept_row"), "left_semi")
    return kept.select(*inner.values()).toDF(*names)
