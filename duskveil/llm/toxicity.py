"""Toxicity by multiple-instance learning: labels of documents teach the scores of
their sentences.

A document is a bag of sentences and toxic if at least one of them is, so its
probability is the noisy-or of theirs, 1 - prod(1 - p). The gradient of the
document's likelihood reaches each sentence in proportion to its own p, and the
trained scores then tell which sentences offend.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.llm.batches import map_columns

_sentence = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+")
_word = re.compile(r"[^\W_]+")

#: Letters of a stem.
STEM = 4

SCHEMA = (
    "doc_id bigint, held_out boolean, score double, predicted int, n_sentences bigint, "
    "offending array<struct<start:bigint,stop:bigint,score:double>>"
)


@dataclass(frozen=True)
class Training:
    """``documents`` and ``chars``: labelled documents and their characters that
    are learnt from, at most; the sample is the rows of smallest hash. ``buckets``
    of hashed features, of which those count that are in at least ``support``
    documents and lie ``deviations`` from the share of toxic documents that
    chance would give them."""

    documents: int = 20_000
    chars: int = 32_000_000
    buckets: int = 1 << 20
    support: int = 3
    deviations: float = 5.0
    epochs: int = 150
    rate: float = 0.1
    decay: float = 1e-5
    bias: float = -6.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]
    buckets: int


def features(sentence: str, buckets: int) -> list[int]:
    """Hashed words of a sentence and their stems, without regard to case."""
    return [f for w in set(_word.findall(sentence.lower())) for f in word_features(w, buckets)]


def word_features(word: str, buckets: int) -> list[int]:
    """The word, and its first letters if it is longer: endings vary."""
    parts = [word] if len(word) <= STEM else [word, word[:STEM] + "*"]
    return [zlib.crc32(part.encode()) % buckets for part in parts]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Character spans of the pieces that end at ``.``, ``!``, ``?`` or a line break
    and hold a word."""
    return [m.span() for m in _sentence.finditer(text or "") if _word.search(text, *m.span())]


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; a null id is not among them
    and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, training: Training) -> DataFrame:
    """``text, toxic`` of the sampled labelled documents. Only ids and lengths
    are ordered; the ids, ``documents`` at most, are then sent to every task."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    lengths = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    order = F.xxhash64(F.lit(training.seed), "doc_id")
    picked = (
        known.join(lengths, "doc_id")
        .where("chars > 0")
        .orderBy(order, "doc_id")
        .limit(training.documents)
        .collect()
    )
    chosen, total = [], 0
    for row in picked:
        if total + row["chars"] <= training.chars:
            total += row["chars"]
            chosen.append((row["doc_id"], row["toxic"]))
    spark = docs.sparkSession
    table = spark.createDataFrame(chosen, "doc_id bigint, toxic int")
    # equal ids are one document
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(table), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    )


def fit(sample: DataFrame, training: Training) -> Model:
    """The model from ``text, toxic``; tasks hash the words, numbers alone come back."""
    buckets = training.buckets

    def make():
        def run(texts, labels):
            bags = [[features(t[a:b], buckets) for a, b in sentences(t)] for t in texts]
            return [
                labels,
                [[f for own in bag for f in own] for bag in bags],
                [[len(own) for own in bag] for bag in bags],
            ]

        return run

    table = map_columns(
        sample.select("text", "toxic"), make, "toxic int, features array<int>, sizes array<int>"
    ).toArrow()
    label = np.array(table["toxic"].to_pylist(), dtype=np.float64)
    kept = np.array([len(s) > 0 for s in table["sizes"]], dtype=bool) if len(label) else np.zeros(0, bool)
    if not kept.any() or len(set(label[kept])) < 2:
        return Model(training.bias, {}, buckets)  # nothing to tell apart
    feature = table["features"].combine_chunks().flatten().to_numpy().astype(np.int64)
    sizes = table["sizes"].combine_chunks().flatten().to_numpy()
    counts = np.array([len(s) for s in table["sizes"]])
    document = np.repeat(np.arange(len(label)), counts)  # of each sentence
    return _descend(feature, sizes, document, label, training)


def _descend(feature, sizes, document, label, training: Training) -> Model:
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    pairs = np.unique(document[sentence] * training.buckets + feature)
    in_documents = np.bincount(pairs % training.buckets, minlength=training.buckets)
    in_toxic = np.bincount(
        pairs % training.buckets, label[pairs // training.buckets], training.buckets
    )
    share = label.mean()
    spread = np.sqrt(in_documents * share * (1 - share)) + 1e-12
    unlike = np.abs(in_toxic - in_documents * share) > training.deviations * spread
    known = (in_documents >= training.support) & unlike
    place = np.cumsum(known) - 1
    use = known[feature]
    feature, sentence = place[feature[use]], sentence[use]
    weights = np.zeros(int(known.sum()) + 1)  # the last one is the bias
    weights[-1] = training.bias
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    docs = len(label)
    for step in range(1, training.epochs + 1):
        z = weights[-1] + np.bincount(sentence, weights[feature], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), docs)
        whole = -np.expm1(none)
        slope = p * (1 - label[document] / np.maximum(whole[document], 1e-12))
        gradient = np.append(np.bincount(feature, slope[sentence], len(weights) - 1), slope.sum()) / docs
        gradient[:-1] += training.decay * weights[:-1]
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        weights -= training.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
    ids = np.flatnonzero(known)
    strong = np.abs(weights[:-1]) > 1e-3
    return Model(float(weights[-1]), dict(zip(ids[strong].tolist(), weights[:-1][strong].tolist())), training.buckets)


class Scorer:
    """Scores texts; remembers the weights of words it has met."""

    REMEMBERED = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            weights = self.model.weights
            found = self.known[word] = sum(
                weights.get(f, 0.0) for f in word_features(word, self.model.buckets)
            )
        return found

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, their number, and those with p >= 0.5."""
        text = text or ""
        places = sentences(text)
        if not places:
            return 0.0, 0, []
        weight, bias = self.weight, self.model.bias
        z = np.array([bias + sum(map(weight, set(_word.findall(text[a:b].lower())))) for a, b in places])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        bad = [(*places[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]
        return min(max(whole, 0.0), 1.0), len(places), bad


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, offending`` for every
    document: the spans and scores of offending sentences come in text order.
    A null or empty text has no sentence and scores 0."""

    def make():
        scorer = Scorer(model)

        def run(ids, outside, texts):
            found = [scorer.score(t) for t in texts]
            return [
                ids,
                outside,
                [s for s, _, _ in found],
                [int(s >= 0.5) for s, _, _ in found],
                [n for _, n, _ in found],
                [[{"start": a, "stop": b, "score": p} for a, b, p in bad] for _, _, bad in found],
            ]

        return run

    return map_columns(
        docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), make, SCHEMA
    )


def toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """Train on the labels outside the held-out fold and score every document.

    A document's score comes from its text alone. Labels that are null, of null
    ids or of unknown documents teach nothing; of several labels of an id the
    largest counts. Without labels of both kinds every sentence scores the
    bias. Repeated rows score alike; no documents give no rows.
    """
    return score_documents(docs, fit(training_sample(docs, labels, training), training))
