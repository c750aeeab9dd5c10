"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into parts of equal size with
few edges between them. A small network learns to tell a vector's part; it
deals every row to its likeliest part and sends a query to as many of its
likeliest parts as a measured recall asks for, where candidates are compared
exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskveil.llm.batches import map_columns
from duskveil.plans.scratch import stash


@dataclass(frozen=True)
class Search:
    """``sample`` and ``trial``: rows that fit the parts and rows that measure the
    recall, at most; ``numbers`` bounds the numbers in either. ``edges`` of each
    row in the neighbour graph. ``part_rows``: rows of a part, about, with
    ``fewest`` to ``most`` parts. ``recall`` to be reached on the trial rows.
    ``cell_rows``: rows and queries that one task compares at once."""

    k: int = 5
    sample: int = 4096
    trial: int = 512
    numbers: int = 1 << 23
    edges: int = 10
    part_rows: int = 25_000
    fewest: int = 16
    most: int = 256
    recall: float = 0.95
    cell_rows: int = 4096
    seed: int = 5


def cut_graph(vectors: np.ndarray, parts: int, edges: int, seed: int) -> np.ndarray:
    """Part of each vector: the neighbour graph is halved again and again along
    the second eigenvector of its random walk, at the median, so parts are equal."""
    n = len(vectors)
    near = np.empty((n, min(edges, n - 1)), dtype=np.int64)
    for start in range(0, n, 1024):
        scores = vectors[start : start + 1024] @ vectors.T
        scores[np.arange(len(scores)), start + np.arange(len(scores))] = -np.inf
        near[start : start + 1024] = np.argpartition(-scores, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    a = np.repeat(np.arange(n), near.shape[1])
    b = near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, dtype=np.int64)
    random = np.random.default_rng(seed)
    count = 1
    while count < parts:
        inside = part[a] == part[b]
        x, y = a[inside], b[inside]
        degree = np.maximum(np.bincount(x, minlength=n), 1)
        spot = random.standard_normal(n)
        for _ in range(60):
            # the walk's first eigenvector is constant in each part: take it out
            mean = np.bincount(part, spot * degree, count) / np.bincount(part, degree, count)
            spot = spot - mean[part]
            spot = 0.5 * spot + 0.5 * np.bincount(x, spot[y], n) / degree
            size = np.sqrt(np.bincount(part, spot**2, count)) + 1e-300
            spot = spot / size[part]
        order = np.lexsort((spot, part))
        starts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=count))[:-1]])
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - starts[part[order]]
        half = (np.bincount(part, minlength=count) + 1) // 2
        part = 2 * part + (place >= half[part])
        count *= 2
    return part


class Router:
    """A network with one hidden layer: log-odds of the parts of unit vectors."""

    def __init__(self, vectors: np.ndarray, part: np.ndarray, parts: int, seed: int, hidden: int = 64, epochs: int = 40):
        random = np.random.default_rng(seed)
        d = vectors.shape[1]
        self.weights = [
            random.standard_normal((d, hidden)) * np.sqrt(2 / d) * np.sqrt(d) / 2,
            np.zeros(hidden),
            random.standard_normal((hidden, parts)) * np.sqrt(1 / hidden),
            np.zeros(parts),
        ]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for epoch in range(epochs):
            order = random.permutation(len(vectors))
            for start in range(0, len(order), 256):
                rows = order[start : start + 256]
                x = vectors[rows]
                inner = np.maximum(x @ self.weights[0] + self.weights[1], 0)
                z = inner @ self.weights[2] + self.weights[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                error = z / z.sum(axis=1, keepdims=True)
                error[np.arange(len(rows)), part[rows]] -= 1
                error /= len(rows)
                back = (error @ self.weights[2].T) * (inner > 0)
                slopes = [x.T @ back, back.sum(axis=0), inner.T @ error, error.sum(axis=0)]
                step += 1
                for w, slope, (m, v) in zip(self.weights, slopes, moments):
                    slope = slope + 1e-4 * w
                    m += 0.1 * (slope - m)
                    v += 0.001 * (slope**2 - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def log_odds(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(vectors @ w[0] + w[1], 0) @ w[2] + w[3]


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def probes_needed(router: Router, sample: np.ndarray, trial: np.ndarray, k: int, recall: float) -> int:
    """Fewest parts that hold ``recall`` of the trial rows' nearest sample rows."""
    home = router.log_odds(sample).argmax(axis=1)
    odds = router.log_odds(trial)
    rank = np.empty_like(odds, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-odds, axis=1), np.arange(odds.shape[1])[None, :], axis=1)
    scores = trial @ sample.T
    k = min(k, len(sample))
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    asked = np.take_along_axis(rank, home[near], axis=1) + 1
    return int(np.quantile(asked, recall, method="higher")) if asked.size else odds.shape[1]


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles): rows with an id and a vector that is neither
    zero nor holds null or non-finite numbers. Equal rows are one."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.select("vec_id", doubles.alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable & F.exists("vector", lambda x: x != 0))
        .distinct()
    )


def _matrix(rows) -> np.ndarray:
    return np.array([r["vector"] for r in rows], dtype=np.float64)


def fit(vectors: DataFrame, search: Search) -> tuple[Router | None, int, int]:
    """Router, number of parts and parts to probe, from a bounded sample."""
    first = vectors.select(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    most = min(search.sample, search.numbers // max(first["d"] or 1, 1))
    picked = (
        vectors.orderBy(F.xxhash64(F.lit(search.seed), "vec_id"), "vec_id")
        .limit(most + search.trial)
        .collect()
    )
    parts = 1 << int(np.ceil(np.log2(np.clip(first["n"] / search.part_rows, search.fewest, search.most))))
    if len(picked) < 8 * parts:  # too few rows to learn from: all of them are candidates
        return None, 1, 1
    rows = _units(_matrix(picked))
    trial_rows = min(search.trial, len(rows) // 5)
    sample, trial = rows[trial_rows:], rows[:trial_rows]
    part = cut_graph(sample, parts, search.edges, search.seed)
    router = Router(sample, part, parts, search.seed)
    return router, parts, probes_needed(router, sample, trial, search.k, search.recall)


def nearest(embeddings: DataFrame, is_query, search: Search = Search()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that the column ``is_query``
    selects, the ``k`` rows found nearest by cosine, ties to the smaller id.

    A query's own id is no candidate. Vectors that are null, zero, or hold null or
    non-finite numbers take no part, as queries neither. A vector meets those of its
    own length; each length has parts and a router of its own. Rows that are equal
    count once. No rows give no rows.

    A task compares one cell: some thousand rows of a part and some thousand
    queries sent there; larger parts have more cells. Rows are dealt to cells
    by the hash of their id, so many equal vectors do not share one.
    """
    kept = stash(valid_vectors(embeddings))
    lengths = [r[0] for r in kept.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = [_nearest(kept.where(F.size("vector") == n), is_query, search) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest(vectors: DataFrame, is_query, search: Search) -> DataFrame:
    """``nearest`` among vectors of one length."""
    router, parts, probes = fit(vectors, search)
    probes = max(1, min(probes, parts))

    def make():
        def run(ids, flags, vectors):
            if router is None:
                return [ids, flags, vectors, [[0]] * len(ids)]
            odds = router.log_odds(_units(np.array(vectors, dtype=np.float64)))
            order = np.argsort(-odds, axis=1, kind="stable")[:, :probes]
            return [ids, flags, vectors, order.astype(np.int32).tolist()]

        return run

    indexed = stash(
        map_columns(
            vectors.select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), "vector"),
            make,
            "vec_id bigint, is_query boolean, vector array<double>, parts array<int>",
            2048,
        )
    )
    rows = indexed.select("vec_id", "vector", F.col("parts")[0].alias("part"))
    queries = indexed.where("is_query").select(
        F.col("vec_id").alias("query_id"), "vector", F.explode("parts").alias("part")
    )
    # one row per part: how many cells its rows and its queries are dealt to
    held = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    across = [-(-held.get(p, 0) // search.cell_rows) or 1 for p in range(parts)]
    down = [-(-asked.get(p, 0) // search.cell_rows) or 1 for p in range(parts)]

    def of(values: list[int]):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("part"))

    def slot(key: str, values: list[int]):
        return F.pmod(F.xxhash64(key), of(values)).cast("int")

    def every(values: list[int]):
        return F.explode(F.sequence(F.lit(0), of(values) - 1))

    left = rows.withColumn("column", slot("vec_id", across)).withColumn("line", every(down))
    right = queries.withColumn("line", slot("query_id", down)).withColumn("column", every(across))
    k = search.k

    def compare(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        ids = candidates["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        matrix = np.stack(candidates["vector"].to_numpy())[order]
        found = best(ids, matrix, asked["query_id"].to_numpy(), np.stack(asked["vector"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    cell = ["part", "column", "line"]
    found = (
        left.groupBy(*cell)
        .cogroup(right.groupBy(*cell))
        .applyInPandas(compare, "query_id bigint, vec_id bigint, score double")
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best(ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Query, id and cosine of the ``k`` best rows of each query. A matrix product
    picks them with some room; the cosine itself is summed row by row, so equal
    vectors score equally wherever they stand. ``ids`` ascend."""
    units, asked = _units(matrix), _units(queries)
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), 256):
        scores = asked[start : start + 256] @ units.T
        for own, query, line in zip(query_ids[start:], queries[start:], scores):
            line[ids == own] = -np.inf
            many = min(k, int((line > -np.inf).sum()))
            if not many:
                continue
            edge = np.partition(line, len(line) - many)[len(line) - many]
            near = np.flatnonzero(line >= edge - 1e-9)
            exact = (matrix[near] * query).sum(axis=1) / (lengths[near] * np.sqrt((query * query).sum()))
            first = np.lexsort((ids[near], -exact))[:many]
            out.append((np.full(len(first), own), ids[near][first], exact[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))
