"""A hashed maximum-entropy language model.

The probability of a word is that of its class times that of the word in its
class. Both are softmaxes over the corpus-wide word frequencies, tilted by
weights of the words before it: each of the last three by itself (the farther
ones skip what lies between) and the last two together. Weights lie in hashed
rows, one column per class or per word of a class.

The most frequent words make up small classes. All other words, each of them,
are leaves of a binary tree per tier of frequency, and the word in its tier is
found by the decisions on the way to its leaf. They are tilted by weights of the
same words before it, hashed together with the place in the tree. With all
weights zero the model is the add-one word distribution, but that words of a
stratum, whose counts are less than a quarter apart, count alike.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duskveil.llm.blocks import blocks
from duskveil.plans.joins import lookup_join
from duskveil.plans.scratch import scratch_path

#: Features of a word: the last three words and the last two together.
FEATURES = 4
#: Features, the first ones, that tilt the decisions between the words of a tier.
#: The others crowd the cells: with them, held-out documents score lower.
LEAF_FEATURES = 2
#: Longer words are known by their digest, behind a space that no word holds.
LONG_WORD = 64
#: Rows of weights whose updates travel together.
ROWS_TOGETHER = 64
#: Characters of a block, about: the larger, the fewer words are exchanged.
BLOCK_CHARS = 1 << 24
#: Blocks whose counts of one word a task adds up.
WORD_BLOCKS = 100_000
#: Groups of words by their hash, in which the words of a stratum are numbered.
BUCKETS = 1024
#: Strata of words by frequency, four an octave; the first holds the unknown word.
STRATA = 256
STRATUM_BITS = 8
#: Training words of a task in one update, about.
TASK_WORDS = 1 << 21
#: Parts of the weights of decisions, by the level of the decision.
LEVEL_PARTS = 16
#: Numbers that keep the features apart, and the word before a document.
SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x3C6EF372FE94F82A))
OUTSIDE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words scored at once, so that their numbers stay in the cache, and words of
#: the documents whose features are held at once (a longer document is held alone).
SLICE = 1 << 15
HELD = 1 << 18


@dataclass(frozen=True)
class Training:
    """``classes`` of ``members`` words each for the most frequent words, ``tiers``
    by powers of two of the frequency for all others. ``rows`` of class weights
    and of member weights, ``leaf_cells`` weights of decisions between the words of
    a tier. The training documents are dealt to ``steps`` updates. ``calm``: occurrences by which a weight's evidence is weakened. An update moves a
    weight by ``rate`` of its relative error, divided by 1 + ``decay`` times its number."""

    classes: int = 16
    members: int = 32
    tiers: int = 8
    class_rows: int = 1 << 14
    member_rows: int = 1 << 14
    leaf_cells: int = 1 << 19
    steps: int = 4
    calm: float = 4.0
    rate: float = 0.6
    decay: float = 0.5

    @property
    def frequent(self) -> int:
        return self.classes * self.members

    @property
    def outcomes(self) -> int:
        return self.classes + self.tiers


class Leaves:
    """The words outside the classes: ``words`` of each stratum and their ``mass``.

    Every tier has a binary tree. Its upper decisions choose the stratum, the
    others the digits of the word's number in it. A node is known by its tier
    and the decisions that lead to it.
    """

    def __init__(self, training: Training, words: np.ndarray, mass: np.ndarray):
        octave = np.maximum(np.arange(STRATA) - 1, 0) // 4
        self.tiers = np.minimum(octave, training.tiers - 1)
        self.tier_mass = np.bincount(self.tiers, mass, training.tiers)
        self.root = np.zeros(STRATA, np.int64)
        self.digits = np.array([max(int(n) - 1, 0).bit_length() for n in words])
        upper: dict[int, list[float]] = {}
        for tier in range(training.tiers):
            held = np.flatnonzero((self.tiers == tier) & (words > 0))
            self._split(held, mass, training.tiers + tier, [], upper)
        self.depth = self.digits + np.array([len(upper.get(s, ())) for s in range(STRATA)])
        self.last = (self.root << self.digits) + np.maximum(words - 1, 0)
        #: Log odds of the digit 1 on the way to the last word of the stratum;
        #: elsewhere in a stratum both branches hold equally many words.
        self.odds = np.zeros((int(self.depth.max()) + 1, STRATA), np.float32)
        for s, odds in upper.items():
            for digit in reversed(range(self.digits[s])):
                left = (int(words[s]) - 1) >> (digit + 1) << (digit + 1)
                right = int(words[s]) - left - (1 << digit)
                # -1e9 stands for impossible
                odds.append(np.log(right / (1 << digit)) if right > 0 else -1e9)
            self.odds[: len(odds), s] = odds

    def _split(self, held: np.ndarray, mass: np.ndarray, node: int, odds: list, upper: dict) -> None:
        if len(held) == 1:
            self.root[held[0]], upper[int(held[0])] = node, list(odds)
        elif len(held):
            left, right = np.split(held, [len(held) // 2])
            own = [*odds, np.log(mass[right].sum() / mass[left].sum())]
            self._split(left, mass, 2 * node, own, upper)
            self._split(right, mass, 2 * node + 1, own, upper)


class Model:
    """Weights and the reference distribution: ``counts`` of the frequent words,
    most frequent first, ``tier_mass`` of the others, and these as ``leaves``;
    without them, a tier is a word.

    A word is known by its code. That of a frequent word is its place. That of
    another one is the number of frequent words and its tier, and by ``words`` it
    is the number of frequent words, and its number in the stratum and the stratum.
    """

    def __init__(
        self, training: Training, counts: np.ndarray, tier_mass: np.ndarray, leaves: Leaves | None = None
    ):
        self.training = t = training
        self.leaves = leaves
        mass = np.zeros(t.frequent)
        mass[: len(counts)] = counts + 1
        members = mass.reshape(t.classes, t.members)
        classes = np.append(members.sum(axis=1), tier_mass)
        with np.errstate(divide="ignore", invalid="ignore"):
            # -1e9 stands for impossible, it cannot spoil sums as infinity does
            self.class_log = np.where(classes > 0, np.log(classes / classes.sum()), -1e9).astype(np.float32)
            inside = np.log(members / members.sum(axis=1, keepdims=True))
            self.member_log = np.where(members > 0, inside, -1e9).astype(np.float32)
        self.class_weights = np.zeros((t.class_rows, t.outcomes), np.float32)
        self.member_weights = np.zeros((t.member_rows, t.members), np.float32)
        self.leaf_weights = np.zeros(t.leaf_cells, np.float32)

    def codes(self, words: np.ndarray) -> np.ndarray:
        own = words - self.training.frequent
        return np.where(own < 0, words, self.training.frequent + self.leaves.tiers[own & (STRATA - 1)])

    @staticmethod
    def features(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A number per feature of each word; words before a document count as one more word."""
        spot = np.arange(len(words)) - starts
        padded = words.astype(np.uint64)
        before = []
        for back in (1, 2, 3):
            moved = np.full(len(words), OUTSIDE)
            moved[back:] = padded[:-back] if len(words) > back else padded[:0]
            before.append(np.where(spot >= back, moved, OUTSIDE))
        pair = SPREAD[0] * (np.uint64(3) + before[1]) + before[0]
        return np.stack([before[0], SPREAD[0] + before[1], SPREAD[1] + before[2], pair])

    @staticmethod
    def row_of(numbers: np.ndarray, rows: int) -> np.ndarray:
        bits = np.uint64(64 - (rows - 1).bit_length())
        mixed = (numbers + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        # short numbers sort by counting
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> bits).astype(np.uint16 if rows <= 1 << 16 else np.int64)

    def outcomes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word, the places of the frequent ones, and their places in their class."""
        t = self.training
        frequent = np.flatnonzero(codes < t.frequent)
        classes = np.where(codes < t.frequent, codes // t.members, codes - t.frequent + t.classes)
        return classes, frequent, codes[frequent] % t.members

    def slices(self, codes: np.ndarray, features: np.ndarray) -> Iterator[tuple]:
        """For some words at once: rows of class weights, the shares of the classes
        and the outcome, and the same for the frequent ones within their class."""
        t = self.training
        for at in range(0, len(codes), SLICE):
            own = features[:, at : at + SLICE]
            classes, frequent, places = self.outcomes(codes[at : at + SLICE])
            rows = self.row_of(own, t.class_rows)
            shares = _shares(self.class_weights, rows, self.class_log)
            inner = classes[frequent]
            inner_rows = self.row_of(
                own[:, frequent] * np.uint64(t.classes) + inner.astype(np.uint64) + np.uint64(1 << 40),
                t.member_rows,
            )
            inner_shares = _shares(self.member_weights, inner_rows, self.member_log[inner])
            yield at, (rows, shares, classes), frequent, (inner_rows, inner_shares, places)

    def decisions(self, words: np.ndarray, features: np.ndarray) -> Iterator[tuple]:
        """For the words of some leaves at once and one level of the trees: the places
        of the words, the digits, the chances of the digit 1, and the cells of the
        weights per feature."""
        tree, cells = self.leaves, self.training.leaf_cells
        # each level has its part of the cells, so that they stay in the cache
        parts = min(LEVEL_PARTS, cells)
        bits = np.uint32(32 - (cells // parts - 1).bit_length())
        features = ((features[:LEAF_FEATURES] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        others = np.flatnonzero(words >= self.training.frequent)
        for at in range(0, len(others), SLICE):
            spots = others[at : at + SLICE]
            own = words[spots] - self.training.frequent
            # deep leaves first, so that those that go on are the first ones
            spots = spots[np.argsort(-tree.depth[own & (STRATA - 1)].astype(np.int8), kind="stable")]
            own = words[spots] - self.training.frequent
            stratum = own & (STRATA - 1)
            leaf = (tree.root[stratum] << tree.digits[stratum]) + (own >> STRATUM_BITS)
            last, left = tree.last[stratum], tree.depth[stratum]
            before = features[:, spots]
            for level in range(int(left[0])):
                n = int(np.searchsorted(-left, -level))
                node = leaf[:n] >> (left[:n] - level)
                digits = (leaf[:n] >> (left[:n] - level - 1)) & 1
                scores = np.where(node == last[:n] >> (left[:n] - level), tree.odds[level][stratum[:n]], np.float32(0))
                place = ((node.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
                rows = (((before[:, :n] ^ place) * np.uint32(0x9E3779B1)) >> bits).astype(np.int64)
                rows += level % parts * (cells // parts)
                for own_rows in rows:
                    scores += np.take(self.leaf_weights, own_rows, mode="clip")
                with np.errstate(over="ignore"):
                    chances = 1 / (1 + np.exp(-scores))
                yield spots[:n], digits, chances, rows

    def log10(self, codes: np.ndarray, starts: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Of each word; without ``words``, of the tier of a word that is not frequent."""
        out = np.zeros(len(codes))
        features = self.features(codes if words is None else words, starts)
        for at, (_, shares, classes), frequent, (_, inner_shares, places) in self.slices(codes, features):
            own = shares[np.arange(len(classes)), classes].astype(np.float64)
            own[frequent] *= inner_shares[np.arange(len(places)), places]
            out[at : at + len(own)] = own
        # a share below the smallest number counts as that number
        out = np.log10(np.maximum(out, np.finfo(np.float32).tiny))
        if words is not None:
            inside = np.ones(len(words))
            for spots, digits, chances, _ in self.decisions(words, features):
                inside[spots] *= np.where(digits == 1, chances, 1 - chances)
            out += np.log10(np.maximum(inside, np.finfo(np.float64).tiny))
        return out

    def empty_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Observed and expected occurrences of every weight: classes, then members.
        Then, of the leaves, observed less expected ones and the variance."""
        cells = self.class_weights.size + self.member_weights.size + self.leaf_weights.size
        return np.zeros(cells), np.zeros(cells)

    def add(
        self, sums: tuple[np.ndarray, np.ndarray], codes: np.ndarray, starts: np.ndarray, words: np.ndarray | None = None
    ) -> None:
        """Add the occurrences that the words have and that the model expects."""
        first = self.class_weights.size
        second = first + self.member_weights.size
        observed = (sums[0][:first], sums[0][first:second])
        # a column after the other, so that its sums stay in the cache
        weights = (self.class_weights, self.member_weights)
        tallies = [np.zeros(_pairs(w).shape[::-1], _pairs(w).dtype) for w in weights]
        features = self.features(codes if words is None else words, starts)
        for _, classes, _, members in self.slices(codes, features):
            for seen, tally, (rows, shares, outcome) in zip(observed, tallies, (classes, members)):
                if not len(outcome):
                    continue
                columns = shares.shape[1]
                pairs = np.ascontiguousarray(_pairs(shares).T)
                for own in rows.astype(np.int64):
                    np.add.at(seen, own * columns + outcome, 1.0)
                    for total, values in zip(tally, pairs):
                        np.add.at(total, own, values)
        for a, tally in zip((0, first), tallies):
            tally = np.ascontiguousarray(tally.T).view(np.float32).reshape(-1)
            sums[1][a : a + len(tally)] += tally
        if words is None:
            return
        # both sums of a cell at once, as one complex number
        both = np.zeros(self.leaf_weights.size, np.complex64)
        for _, digits, chances, rows in self.decisions(words, features):
            own = np.empty(len(chances), np.complex64)
            own.real, own.imag = digits - chances, chances * (1 - chances)
            for cells in rows:
                np.add.at(both, cells, own)
        sums[0][second:] += both.real
        sums[1][second:] += both.imag

    def update(self, observed: np.ndarray, expected: np.ndarray, step: int) -> None:
        """Move every weight by its share of the missing occurrences, less in later steps."""
        t = self.training
        first = self.class_weights.size
        second = first + self.member_weights.size
        missing = np.append(observed[:second] - expected[:second], observed[second:])
        moved = missing / (expected + t.calm)
        moved = np.clip(moved, -1.0, 2.0) * (t.rate / (1 + t.decay * step))
        self.class_weights += moved[:first].reshape(self.class_weights.shape).astype(np.float32)
        self.member_weights += moved[first:second].reshape(self.member_weights.shape).astype(np.float32)
        self.leaf_weights += moved[second:].astype(np.float32)


def _pairs(values: np.ndarray) -> np.ndarray:
    """Two columns as a complex one, so that they are added at once."""
    return values.view(np.complex64) if values.shape[1] % 2 == 0 else values


def _shares(weights: np.ndarray, rows: np.ndarray, logs: np.ndarray) -> np.ndarray:
    scores = np.take(weights, rows[0], axis=0, mode="clip")
    for own in rows[1:]:
        scores += np.take(weights, own, axis=0, mode="clip")
    scores += logs
    with np.errstate(over="ignore"):
        shares = np.exp(scores)
        total = np.einsum("ij->i", shares)
    if len(total) and not 1e-30 < total.min() <= total.max() < 1e30:
        scores -= scores.max(axis=1, keepdims=True)
        shares = np.exp(scores)
        total = np.einsum("ij->i", shares)
    shares /= total[:, None]
    return shares


_WRITTEN = (
    "block bigint, doc_id bigint, held_out boolean, tokens array<int>, place int, word string, "
    "n_train bigint"
)
_CODED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
    "words array<bigint>, step int"
)
_SUMS = "part int, chunk int, sums array<float>"
_SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from; a null id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_key(word: bytes) -> str:
    """A word by itself, or by its digest if it is long."""
    if len(word) <= LONG_WORD:
        return word.decode()
    return " " + hashlib.sha256(word).hexdigest()


def _batch(schema: pa.Schema, rows: int, known: dict) -> pa.RecordBatch:
    arrays = [
        pa.array(known[f.name], f.type) if f.name in known else pa.nulls(rows, f.type) for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def words_of_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The written table of documents, as places of their words in their block, and
    of each block's words with their training occurrences. The end of a document
    is the empty word."""
    struct = StructType.fromDDL(_WRITTEN)
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (doc_ids, outside, texts) in blocks(batches, block_chars):
            places: defaultdict[bytes, int] = defaultdict()
            places.default_factory = places.__len__
            tokens = [
                np.array([places[w] for w in (text or "").encode().lower().split()] + [places[b""]], np.int32)
                for text in texts
            ]
            learnt = [t for t, out in zip(tokens, outside) if not out]
            flat = np.concatenate(learnt) if learnt else np.zeros(0, np.int32)
            times = np.bincount(flat, minlength=len(places))
            whole = _batch(
                schema, len(texts),
                {"block": [block] * len(texts), "doc_id": doc_ids, "held_out": outside, "tokens": tokens},
            )
            for start in range(0, len(texts), 1024):
                yield whole.slice(start, 1024)
            words = [word_key(w) for w in places]
            for start in range(0, len(words), 1 << 16):
                own = words[start : start + (1 << 16)]
                at = range(start, start + len(own))
                yield _batch(
                    schema, len(own),
                    {"block": [block] * len(own), "place": at, "word": own, "n_train": times[start : at.stop]},
                )

    return _written(
        docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, struct)
    )


def _written(df: DataFrame, *folders: str) -> DataFrame:
    """``df`` written once, packed tightly, in a folder per value of ``folders``."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stratum() -> Column:
    """Stratum of a word of ``c`` occurrences, as exact as whole numbers are: 0 for
    none, else a quarter of an octave."""
    octave = F.length(F.bin("c")) - 1
    quarter = F.expr("shiftright(c * 4, cast(length(bin(c)) - 1 as int))") - 4
    return F.when(F.col("c") > 0, 1 + 4 * octave + quarter).otherwise(0).cast("int")


def _corpus_counts(words: DataFrame, word_blocks: int) -> DataFrame:
    """``block, place, word, c, once``: each word of each block with its training
    occurrences in the corpus, ``once`` true in one row per word. ``stratum`` and
    ``bucket`` of the word, and its number among the words of both, from 1.

    A word has a row per block. While that many rows fit a task, one exchange by
    the bucket of the word adds them up and keeps them; beyond it, sums combined
    before the exchange are joined back in slices.
    """
    key = F.xxhash64("word")  # sorted faster than the words
    bucket = F.pmod("key", F.lit(BUCKETS)).cast("int")
    number = F.dense_rank().over(Window.partitionBy("bucket", "stratum").orderBy("key", "word"))
    blocks_held = words.select("block").distinct().count()
    if blocks_held <= word_blocks:
        by_word = Window.partitionBy("key", "bucket", "word").orderBy("block")
        whole = by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = words.withColumn("key", key).withColumn("bucket", bucket).repartition("bucket")
        counted = held.select(
            "block", "place", "word", "key", "bucket", F.sum("n_train").over(whole).alias("c"),
            (F.row_number().over(by_word) == 1).alias("once"),
        )
        return counted.withColumn("stratum", _stratum()).withColumn("number", number).drop("key")
    sums = words.groupBy("word").agg(
        F.sum("n_train").alias("c"), F.min("block").alias("least"), F.count("*").alias("blocks")
    )
    sums = sums.withColumn("key", key).withColumn("bucket", bucket).withColumn("stratum", _stratum())
    sums = sums.withColumn("number", number).drop("key")
    found = lookup_join(words.drop("n_train"), sums, ["word"], "blocks", ["block"])
    return found.select(
        "block", "place", "word", "bucket", "c", (F.col("block") == F.col("least")).alias("once"), "stratum", "number"
    )


def _coded(
    written: DataFrame, training: Training, word_blocks: int = WORD_BLOCKS
) -> tuple[DataFrame, Model, int]:
    """Documents as their words, known by number, the model before training, and
    the training tokens."""
    held = written.where("place IS NOT NULL").select("block", "place", "word", "n_train")
    counts = _written(_corpus_counts(held, word_blocks))
    known = counts.where("once AND c > 0").select("word", "c", "stratum", "bucket", "number")
    summed = known.groupBy("stratum", "bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    sizes, mass = np.zeros((STRATA, BUCKETS), np.int64), np.zeros(STRATA)
    for r in summed:  # a row per stratum and bucket
        sizes[r["stratum"], r["bucket"]] = r["v"]
        mass[r["stratum"]] += r["n"] + r["v"]
    tokens, distinct = sum(r["n"] for r in summed), int(sizes.sum())
    offsets = np.cumsum(sizes, axis=1) - sizes - 1
    # as many words as the classes hold, none longer than a digest
    top = known.orderBy(F.desc("c"), "word").limit(training.frequent).collect()
    totals = sizes.sum(axis=1)
    totals[0] = mass[0] = 1  # the unknown word
    for r in top:
        totals[r["stratum"]] -= 1
        mass[r["stratum"]] -= r["c"] + 1
    # of one stratum at most some words are frequent and some are not
    split = top[-1]["stratum"] if top else 0
    gaps = np.sort([offsets[split, r["bucket"]] + r["number"] for r in top if r["stratum"] == split]).astype(np.int64)
    leaves = Leaves(training, totals, mass)
    model = Model(training, np.array([r["c"] for r in top], np.int64), leaves.tier_mass, leaves)
    codes = written.sparkSession.createDataFrame(
        [(r["word"], i) for i, r in enumerate(top)], "word string, code int"
    )
    found = counts.join(F.broadcast(codes), "word", "left").select(
        F.col("block").alias("home"), "place", "c", "stratum", "bucket", "number", F.coalesce("code", F.lit(-1)).alias("code")
    )
    divisor = float(tokens + distinct + 1)
    struct = StructType.fromDDL(_CODED)
    schema = to_arrow_schema(struct)

    def coded(own: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words["place"].to_numpy())
        c, code, stratum, bucket, number = (
            words[x].to_numpy()[order] for x in ("c", "code", "stratum", "bucket", "number")
        )
        base = np.log10((c + 1) / divisor)
        number = np.where(c > 0, offsets[stratum, bucket] + number, 0)
        number -= np.where(stratum == split, np.searchsorted(gaps, number), 0)
        word = np.where(code < 0, training.frequent + (number << STRATUM_BITS) + stratum, code)
        tokens = own["tokens"].combine_chunks()
        flat, bounds = tokens.flatten().to_numpy(), tokens.offsets.to_numpy()
        bounds = bounds - bounds[0]
        starts = bounds[:-1]  # every document has its end at least
        outside = np.array(own["held_out"].to_pylist(), bool)
        return pa.table(
            {
                "doc_id": own["doc_id"],
                "held_out": own["held_out"],
                "n_tokens": pa.array(np.diff(bounds).astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((c > 0)[flat].astype(np.int64), starts)),
                "base_score": pa.array(np.add.reduceat(base[flat], starts)),
                "words": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(word[flat])),
                "step": pa.array(np.where(outside, -1, np.arange(len(starts)) % training.steps).astype(np.int32)),
            },
            schema=schema,
        )

    documents = written.where("place IS NULL").select("block", "doc_id", "held_out", "tokens")
    made = documents.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(coded, struct)
    return _written(made, "step"), model, tokens


def _held(words: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of some documents, the start of the document of each, and the starts."""
    flat, bounds = words.flatten().to_numpy(), words.offsets.to_numpy()
    bounds = bounds - bounds[0]
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + HELD, side="right")) - 1)
        own = bounds[first : last + 1] - bounds[first]
        yield flat[bounds[first] : bounds[last]], np.repeat(own[:-1], np.diff(own)), own[:-1]
        first = last


def train(coded: DataFrame, model: Model, tokens: int) -> Model:
    """One pass over the training documents in updates of all tasks together:
    each adds up what its documents have and what the model expects, Spark adds
    the tasks up in two levels, and the sums, of bounded size, move the weights."""
    t = model.training
    cuts, size = [0], 0
    for weights in (model.class_weights, model.member_weights, model.leaf_weights):
        width = ROWS_TOGETHER * (weights.shape[1] if weights.ndim > 1 else t.members)
        cuts += range(size + width, size + weights.size, width)
        size += weights.size
        cuts.append(size)
    struct = StructType.fromDDL(_SUMS)
    schema = to_arrow_schema(struct)
    # a task sends all its sums, so it should have read more than that
    tasks = 1 + tokens // t.steps // TASK_WORDS
    lane_count = math.isqrt(tasks)

    for step in range(t.steps):

        def gradient(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            sums, rows = model.empty_sums(), 0
            for batch in batches:
                for words, starts, _ in _held(batch.column("words")):
                    model.add(sums, model.codes(words), starts, words)
                rows += batch.num_rows
            if not rows:
                return
            part = TaskContext.get().partitionId()
            for chunk, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if sums[1][a:b].any():
                    both = np.concatenate([x[a:b] for x in sums]).astype(np.float32)
                    yield _batch(schema, 1, {"part": [part], "chunk": [chunk], "sums": [both]})

        def added(some: pa.Table) -> pa.Table:
            order = np.argsort(some["part"].to_numpy())  # the same sum on every run
            lists = some["sums"].combine_chunks()
            values = lists.flatten().to_numpy().reshape(some.num_rows, -1)[order].sum(axis=0, dtype=np.float64)
            return pa.Table.from_batches(
                [
                    _batch(
                        schema, 1,
                        {"part": [some["part"][int(order[0])].as_py()], "chunk": [some["chunk"][0].as_py()],
                         "sums": [values.astype(np.float32)]},
                    )
                ]
            )

        own = coded.where(F.col("step") == step).select("words").coalesce(tasks)
        parts = own.mapInArrow(gradient, struct)
        lane = F.pmod(F.col("part"), F.lit(lane_count)).alias("lane")
        lanes = parts.groupBy("chunk", lane).applyInArrow(added, struct)
        observed, expected = model.empty_sums()
        for r in lanes.groupBy("chunk").applyInArrow(added, struct).collect():
            a, b = cuts[r["chunk"]], cuts[r["chunk"] + 1]
            observed[a:b], expected[a:b] = np.array(r["sums"], np.float64).reshape(2, -1)
        model.update(observed, expected, step)
    return model


def score(
    docs: DataFrame,
    training: Training = Training(),
    block_chars: int = BLOCK_CHARS,
    word_blocks: int = WORD_BLOCKS,
) -> DataFrame:
    """Train on the documents that are not held out and score all of them.

    One row per row of ``docs``: ``doc_id``; ``held_out``; ``n_tokens``, its words
    in lower case (A-Z) and its end; ``n_known`` of them that the training
    documents hold; ``train_tokens`` of those documents; ``base_score``, the
    add-one log10 probability of the tokens one by one; ``score``, that of the model.

    The probabilities of all known words and of one unknown word add up to one
    after any words. A null or empty text has its end alone. Repeated rows and
    null ids are documents of their own, and of equally frequent words the
    smaller is the more frequent one. Without training documents every
    word is unknown; no documents give no rows. Other columns are not read.

    Word counts are corpus-wide sums, every block of documents meets those of its
    own words only, and the weights, a fixed number, learn from every training document.
    """
    coded, model, tokens = _coded(words_of_blocks(docs, block_chars), training, word_blocks)
    model = train(coded, model, tokens)
    struct = StructType.fromDDL(_SCORED)
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tilted = [
                np.add.reduceat(model.log10(model.codes(words), starts, words), firsts)
                for words, starts, firsts in _held(batch.column("words"))
            ]
            known = {c: batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
            known["score"] = np.concatenate(tilted) if tilted else []
            known["train_tokens"] = [tokens] * batch.num_rows
            yield _batch(schema, batch.num_rows, known)

    return coded.drop("step").mapInArrow(run, struct)
