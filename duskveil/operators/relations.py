"""Correlations and R² of columns on each other, from one table of moments.

Pairs of columns are summed as matrix products of the values and of their
presence, so gaps cost nothing. Models of more columns sum the rows by which
columns they have, once, around the column means; every statistic on the complete
rows of some columns is a sum over these patterns. Where gaps make too many
patterns, the asked-for sets of columns are summed instead. Column combinations
are generated by exploding indices, and the small systems are solved in the
tasks that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskveil.functions.names import known, numeric_names, ref, require
from duskveil.operators.federated import apply_model, fit_average
from duskveil.operators.shape import numeric_columns
from duskveil.plans.scratch import stash

#: a column whose spread is this small a part of its sum of squares is constant
_FLAT = 1e-12
#: Sets of present columns that are summed one by one; beyond it, sets of columns are.
PATTERNS = 512
#: Most models that a full search fits, and columns that a best-subset search takes.
MODELS = 1_000_000
MOST_COLUMNS = 200
#: Values this near are equal when a search decides what to leave out.
_NEAR = 1e-9


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per set of present columns: ``present``, ``n``, ``sums`` and ``products``
    of the deviations from the column means (products as a flat p × p array).

    Two scans, one for the means and one for the sums; the small result is
    written, so whatever is derived from it never reads the table again.
    Each task multiplies its batches, so the plan does not grow with the columns.
    """
    return stash(_multiplied(_centred(df, columns), len(columns)))


def _centred(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as ``d0`` …, less their means."""
    p = len(columns)
    values = df.select(*[known(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    middle = values.agg(F.struct(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)])).scalar()
    return values.select(*[(F.col(f"x{i}") - middle[f"m{i}"]).alias(f"d{i}") for i in range(p)])


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments of every two columns over the rows that have both, ``members``, ``n``,
    ``s0``, ``s1``, ``q0_0`` …, also of a column with itself, and ``rows`` of the
    table: four matrix products per task, whatever the gaps."""
    p = len(columns)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((4, p, p)), 0
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += [there.T @ there, x.T @ there, x.T @ x, (x * x).T @ there]
            rows += len(x)
        a, b = np.triu_indices(p)
        yield pd.DataFrame(
            {
                "a": a, "b": b, "n": total[0][a, b].astype("int64"), "s0": total[1][a, b], "s1": total[1][b, a],
                "q0_0": total[3][a, b], "q0_1": total[2][a, b], "q1_1": total[3][b, a], "rows": rows,
            }
        )

    schema = "a int, b int, n bigint, s0 double, s1 double, q0_0 double, q0_1 double, q1_1 double, rows bigint"
    numbers = ["n", "s0", "s1", "q0_0", "q0_1", "q1_1", "rows"]
    summed = (
        _centred(df, columns).mapInPandas(multiply, schema)
        .groupBy("a", "b")
        .agg(*[F.sum(c).alias(c) for c in numbers])
    )
    return stash(summed.select(F.array("a", "b").alias("members"), *numbers))


def set_moments(df: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """Moments of every ``size`` columns over the rows that have all of them, as
    ``_subsets`` gives them, but summed set by set in the tasks that read the rows."""
    p = len(columns)
    held = 256  # sets that are multiplied at once

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = np.array(list(combinations(range(p), size)), dtype=int).reshape(-1, size)
        n, sums = np.zeros(len(sets)), np.zeros((len(sets), size))
        products = np.zeros((len(sets), size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            for top in range(0, len(x), 1024):
                part = x[top : top + 1024]
                there, filled = ~np.isnan(part), np.nan_to_num(part)
                for at in range(0, len(sets), held):
                    own = sets[at : at + held]
                    whole = there[:, own].all(axis=2)
                    values = (filled[:, own] * whole[:, :, None]).transpose(1, 2, 0)
                    n[at : at + held] += whole.sum(axis=0)
                    sums[at : at + held] += values.sum(axis=2)
                    products[at : at + held] += values @ values.transpose(0, 2, 1)
        if n.any():
            filled_sets = np.flatnonzero(n)
            yield pd.DataFrame(
                {"members": list(sets[filled_sets]), "n": n[filled_sets].astype("int64")}
                | {f"s{a}": sums[filled_sets, a] for a in range(size)}
                | {f"q{a}_{b}": products[filled_sets, a, b] for a in range(size) for b in range(a, size)}
            )

    numbers = [f"s{a}" for a in range(size)] + [f"q{a}_{b}" for a in range(size) for b in range(a, size)]
    schema = "members array<int>, n bigint, " + ", ".join(f"{c} double" for c in numbers)
    found = _centred(df, columns).mapInPandas(multiply, schema)
    return found.groupBy("members").agg(*[F.sum(c).alias(c) for c in ("n", *numbers)])


def _patterns(df: DataFrame, columns: Sequence[str]) -> int:
    """About how many sets of present columns the rows have."""
    there = F.array(*[known(df, c).isNotNull() for c in columns])
    return df.agg(F.approx_count_distinct(F.xxhash64(there))).first()[0]


def _multiplied(centred: DataFrame, p: int) -> DataFrame:
    """Matrix products per task and set of present columns, added up entry by entry."""
    held = 64  # patterns a task keeps before it hands on their sums

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[bytes, np.ndarray] = {}

        def lines() -> pd.DataFrame:
            out = []
            for bits, total in totals.items():
                known = np.unpackbits(np.frombuffer(bits, "uint8"), count=p)
                out.append((np.flatnonzero(known).tolist(), total.ravel().tolist()))
            totals.clear()
            return pd.DataFrame(out, columns=["present", "entries"])

        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            known = ~np.isnan(x)
            packed = np.packbits(known, axis=1)
            patterns, which = np.unique(packed, axis=0, return_inverse=True)
            which = which.ravel()
            for spot, bits in enumerate(patterns):
                # a column of ones in front gives the count and the sums as well
                part = np.column_stack([np.ones((which == spot).sum()), x[which == spot]])
                part = np.nan_to_num(part)
                key = bits.tobytes()
                totals[key] = totals.get(key, 0.0) + part.T @ part
                if len(totals) >= held:
                    yield lines()
        yield lines()

    entries = (
        centred.mapInPandas(multiply, "present array<int>, entries array<double>")
        .select("present", F.posexplode("entries").alias("at", "value"))
        .groupBy("present", "at")
        .agg(F.sum("value").alias("value"))
    )
    # (p + 1)² entries per pattern
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"]
    )
    square = entries.groupBy("present").agg(listed.alias("e"))
    width = p + 1
    spread = F.filter("e", lambda v, at: (at >= width) & (at % width > 0))
    return square.select(
        "present",
        F.get("e", F.lit(0)).cast("bigint").alias("n"),
        F.slice("e", 2, p).alias("sums"),
        spread.alias("products"),
    )


def _subsets(table: DataFrame, p: int, size: int) -> DataFrame:
    """Moments of every ``size`` columns over the rows that have all of them:
    ``members``, ``n``, ``s0`` …, ``q0_0`` …"""
    picked = table.withColumn("members", F.array().cast("array<int>"))
    for taken in range(size):
        last = F.get("members", F.lit(taken - 1)) if taken else F.lit(-1)
        picked = (
            picked.withColumn("next", F.explode("present"))
            .where(F.col("next") > last)
            .withColumn("members", F.concat("members", F.array("next")))
            .drop("next")
        )
    member = [F.get("members", F.lit(a)) for a in range(size)]
    chosen = picked.select(
        "members",
        "n",
        *[F.get("sums", member[a]).alias(f"s{a}") for a in range(size)],
        *[
            F.get("products", member[a] * p + member[b]).alias(f"q{a}_{b}")
            for a in range(size)
            for b in range(a, size)
        ],
    )
    numbers = [c for c in chosen.columns if c != "members"]
    return chosen.groupBy("members").agg(*[F.sum(c).alias(c) for c in numbers])


def _inner(a: int, b: int) -> Column:
    return F.col(f"q{a}_{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")


def _varies(a: int) -> Column:
    return _inner(a, a) > F.col(f"q{a}_{a}") * _FLAT


def _pair_correlations(pairs: DataFrame) -> DataFrame:
    """``(a, b, value)`` for a < b; null if one of the two does not vary."""
    value = _inner(0, 1) / F.sqrt(_inner(0, 0) * _inner(1, 1))
    return pairs.where("members[0] < members[1] AND n > 0").select(
        F.get("members", F.lit(0)).alias("a"),
        F.get("members", F.lit(1)).alias("b"),
        "n",
        F.when(_varies(0) & _varies(1), value).alias("value"),
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "value"))


def _packed(subsets: DataFrame, size: int) -> DataFrame:
    square = [f"q{min(a, b)}_{max(a, b)}" for a in range(size) for b in range(size)]
    return subsets.select(
        "members",
        "n",
        F.array(*[F.col(f"s{a}") for a in range(size)]).alias("sums"),
        F.array(*[F.col(q) for q in square]).alias("products"),
    )


def _fits(packed: DataFrame, size: int) -> DataFrame:
    """``(target, predictors, n, value)``: R² of each of ``size`` members on the others."""
    flat_limit = _FLAT

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            members = np.stack(batch["members"])
            n = batch["n"].to_numpy("int64")
            sums = np.stack(batch["sums"])
            raw = np.stack(batch["products"]).reshape(-1, size, size)
            inner = raw - sums[:, :, None] * sums[:, None, :] / n[:, None, None]
            own = np.einsum("raa->ra", inner)
            varies = own > flat_limit * np.einsum("raa->ra", raw)
            # a column that does not vary explains nothing: unit variance, no correlation
            scale = np.sqrt(np.where(varies, own, 1.0))
            both = varies[:, :, None] & varies[:, None, :]
            corr = np.where(both, inner / (scale[:, :, None] * scale[:, None, :]), 0.0)
            corr[:, range(size), range(size)] = 1.0
            for a in range(size):
                others = [b for b in range(size) if b != a]
                right = corr[:, others, a]
                matrix = corr[:, others][:, :, others]
                weight = np.linalg.pinv(matrix, rcond=1e-10, hermitian=True) @ right[:, :, None]
                value = (right[:, None, :] @ weight)[:, 0, 0]
                yield pd.DataFrame(
                    {
                        "target": members[:, a],
                        "predictors": list(members[:, others]),
                        "n": n,
                        "value": np.where(varies[:, a], value, np.nan),
                    }
                )

    found = packed.mapInPandas(solve, "target int, predictors array<int>, n bigint, value double")
    return found.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _named(columns: Sequence[str], spot: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), spot)


def _named_list(columns: Sequence[str], spots: Column) -> Column:
    return F.array_join(F.transform(spots, lambda s: _named(columns, s)), ", ")


def _numbers(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = list(columns or numeric_names(df))
    if not names:
        raise ValueError("no numeric columns")
    require(df, *names)
    return names


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_a, column_b, corr)``: pairwise-complete Pearson, undefined as 0."""
    names = _numbers(df, columns)
    return _matrix(pair_moments(df, names), names)


def _matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    p = len(columns)
    alone = pairs.where("members[0] = members[1] AND n > 0").select(
        F.get("members", F.lit(0)).alias("a"),
        F.get("members", F.lit(0)).alias("b"),
        F.when(_varies(0), 1.0).alias("value"),
    )
    known = _both_ways(_pair_correlations(pairs)).drop("n").unionByName(alone)
    grid = pairs.sparkSession.range(p).select(
        F.col("id").cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("b"),
    )
    return grid.join(known, ["a", "b"], "left").select(
        _named(columns, F.col("a")).alias("column_a"),
        _named(columns, F.col("b")).alias("column_b"),
        F.coalesce("value", F.lit(0.0)).alias("corr"),
    )


def r2_on_all_others(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(target, features, r2)``: least squares of each column on all others,
    rounded to 4 digits. A table with a missing value anywhere gives no rows."""
    names = _numbers(df, columns)
    return _r2(pair_moments(df, names), names)


def _whole(pairs: DataFrame, columns: Sequence[int]) -> DataFrame:
    """The moments of some columns as one row: no gaps, so pairs have them all."""
    spots = F.array(*[F.lit(c) for c in columns]).cast("array<int>")
    inside = F.array_contains(spots, F.col("members")[0]) & F.array_contains(spots, F.col("members")[1])
    both = pairs.where(inside).select(
        "n", F.inline(F.array(
            F.struct(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"), "q0_1", "s0"),
            F.struct(F.col("members")[1].alias("a"), F.col("members")[0].alias("b"), "q0_1", F.col("s1").alias("s0")),
        ))
    ).distinct()

    def in_order(value: str, rows: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(rows, F.struct("a", "b", value))))
        return F.transform(listed, lambda e: e[value])

    return both.agg(
        F.max("n").alias("n"),
        in_order("s0", F.col("a") == F.col("b")).alias("sums"),
        in_order("q0_1", F.lit(True)).alias("products"),
    ).select(spots.alias("members"), "n", "sums", "products")


def _r2(pairs: DataFrame, columns: list[str]) -> DataFrame:
    p = len(columns)
    least = pairs.agg(F.min(F.col("n") == F.col("rows")) & (F.max("n") > 0)).scalar()
    complete = _whole(pairs, range(p)).where(least & (F.lit(p) > 1))
    # a constant target is met exactly by the intercept
    return _fits(complete, p).select(
        _named(columns, F.col("target")).alias("target"),
        _named_list(columns, F.col("predictors")).alias("features"),
        F.bround(F.coalesce("value", F.lit(1.0)), 4).alias("r2"),
    )


def _relations(pairs: DataFrame, sets: Sequence[DataFrame]) -> DataFrame:
    """``(target, predictors, metric, n, value)``: correlations of pairs, and R² in
    the moments of three columns, of four, …"""
    found = _both_ways(_pair_correlations(pairs)).select(
        F.col("a").alias("target"),
        F.array("b").alias("predictors"),
        F.lit("corr").alias("metric"),
        "n",
        "value",
    )
    for size, subsets in enumerate(sets, 3):
        fits = _fits(_packed(subsets, size), size)
        found = found.unionByName(fits.withColumn("metric", F.lit("R2")))
    return found


def top_relationships(
    df: DataFrame, columns: Sequence[str] | None = None, rows: int = 10
) -> DataFrame:
    """Strongest correlations and R² on two predictors, to 3 decimals.

    Two-predictor models need columns without missing values. Ties keep the
    column order, correlations first.
    """
    names = _numbers(df, columns)
    return _top(pair_moments(df, names), names, rows)


def _top(pairs: DataFrame, columns: list[str], rows: int) -> DataFrame:
    # columns without gaps make one pattern
    filled = [
        r[0] for r in pairs.where("members[0] = members[1] AND n = rows").select("members").collect()
    ]
    filled = sorted(members[0] for members in filled)
    whole = _whole(pairs, filled).withColumn("present", F.sequence(F.lit(0), F.lit(len(filled) - 1)))
    own = F.array(*[F.lit(c) for c in filled])
    sets = []
    if len(filled) > 2:
        among = _subsets(whole.drop("members"), len(filled), 3)
        sets = [among.withColumn("members", F.transform("members", lambda i: F.get(own, i)))]
    shown = F.round("value", 3)
    return (
        _relations(pairs, sets)
        .where(F.col("value").isNotNull())
        .orderBy(F.abs(shown).desc(), "target", F.size("predictors"), "predictors")
        .limit(rows)
        .select(
            F.col("metric"),
            _named(columns, F.col("target")).alias("target"),
            _named_list(columns, F.col("predictors")).alias("predictors"),
            shown.alias("value"),
        )
    )


def search_relationships(
    df: DataFrame, columns: Sequence[str] | None = None, predictors: int = 3, most_models: int = MODELS
) -> DataFrame:
    """``(target, predictors, metric, value)`` for every target and 1 to
    ``predictors`` predictors on their complete rows, strongest first.

    The models grow with the power ``predictors + 1`` of the columns; more than
    ``most_models`` are an error. ``best_relationships`` finds the strongest without
    fitting all.
    """
    names = _numbers(df, columns)
    p = len(names)
    sizes = range(3, min(predictors, p - 1) + 2)
    models = sum(size * comb(p, size) for size in sizes)
    if models > most_models:
        raise ValueError(f"{models} models, more than {most_models}: use best_relationships or fewer columns")
    pairs = pair_moments(df, names)
    sets = []
    if sizes:
        gaps = not pairs.where("n < rows").isEmpty()
        if gaps and _patterns(df, names) > PATTERNS:
            sets = [set_moments(df, names, size) for size in sizes]
        else:
            table = moments(df, names)
            sets = [_subsets(table, p, size) for size in sizes]
    return _by_strength(_relations(pairs, sets), names)


def _by_strength(found: DataFrame, names: list[str]) -> DataFrame:
    return found.orderBy(
        F.abs("value").desc_nulls_last(), "target", F.size("predictors"), "predictors"
    ).select(
        _named(names, F.col("target")).alias("target"),
        _named_list(names, F.col("predictors")).alias("predictors"),
        "metric",
        "value",
    )


class _Lattice:
    """The sets of predictors of each target, as a tree: a set grows by predictors
    behind its last one, the strongest correlations first."""

    def __init__(self, corr: np.ndarray):
        self.corr = corr
        strength = np.abs(corr)
        self.order = [
            sorted((b for b in range(len(corr)) if b != a), key=lambda b: (-strength[a, b], b))
            for a in range(len(corr))
        ]

    def r2(self, target: int, spots: Sequence[int], cutoff: float = 1e-10) -> float:
        own = [self.order[target][s] for s in spots]
        right = self.corr[own, target]
        inverse = np.linalg.pinv(self.corr[np.ix_(own, own)], rcond=cutoff, hermitian=True)
        return float(right @ inverse @ right)

    def floor(self, target: int, size: int, rows: int) -> float:
        """The value of the ``rows``-th best of some models of ``size`` predictors: those
        on the way of a greedy choice, and those that differ from it by one."""
        count = len(self.order[target])
        chosen: list[int] = []
        seen: dict[frozenset, float] = {}

        def tried(spots: list[int]) -> float:
            whole = frozenset(spots)
            if whole not in seen:
                seen[whole] = self.r2(target, sorted(spots))
            return seen[whole]

        for _ in range(size):
            seen.clear()
            chosen.append(max((s for s in range(count) if s not in chosen), key=lambda s: tried([*chosen, s])))
        for out in chosen:
            kept = [s for s in chosen if s != out]
            for s in range(count):
                if s not in chosen:
                    tried([*kept, s])
        best = sorted(seen.values(), reverse=True)
        return best[rows - 1] if len(best) >= rows else -1.0

    def grown(self, target: int, chosen: Sequence[int], size: int, floor: float) -> Iterator[tuple[list[int], float]]:
        """Sets with one more predictor that are, or may become, models at or above
        ``floor``, with their value or bound. No set is better than the whole of
        what it may still take, which shrinks along the order: the first miss ends it."""
        count = len(self.order[target])
        missing = size - len(chosen) - 1
        for spot in range(chosen[-1] + 1 if len(chosen) else 0, count - missing):
            own = [*map(int, chosen), spot]
            if not missing:
                value = self.r2(target, own)
                if value >= floor - _NEAR:
                    yield own, value
                continue
            bound = self.r2(target, [*own, *range(spot + 1, count)], 1e-13)
            if bound < floor - _NEAR:
                return
            yield own, bound


def best_relationships(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    predictors: int = 3,
    rows: int = 10,
    most_columns: int = MOST_COLUMNS,
) -> DataFrame:
    """``(target, predictors, metric, value)``: for each target and each number of
    predictors up to ``predictors``, the ``rows`` strongest models, strongest first.

    All models are fitted on the rows that have all columns; then a model is never
    better than one with more predictors, and whole branches of the lattice
    of sets are left out. Constant columns are no targets. Equal values go to the
    earlier columns. More than ``most_columns`` columns are an error.
    """
    names = _numbers(df, columns)
    p = len(names)
    if p > most_columns:
        raise ValueError(f"{p} columns, more than {most_columns}")
    whole = df.where(F.forall(F.array(*[known(df, c).isNotNull() for c in names]), lambda x: x))
    inner, raw = np.zeros((p, p)), np.zeros(p)
    for r in pair_moments(whole, names).where("n > 0").collect():  # p² numbers
        a, b = r["members"]
        inner[a, b] = inner[b, a] = r["q0_1"] - r["s0"] * r["s1"] / r["n"]
        if a == b:
            raw[a] = r["q0_0"]
    varies = np.diag(inner) > raw * _FLAT
    scale = np.sqrt(np.where(varies, np.diag(inner), 1.0))
    corr = np.where(np.outer(varies, varies), inner / np.outer(scale, scale), 0.0)
    np.fill_diagonal(corr, 1.0)
    lattice = _Lattice(corr)
    targets = [a for a in range(p) if varies[a]]
    node = "target int, size int, chosen array<int>, floor double, value double"

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floors = [lattice.floor(t, s, rows) for t, s in zip(batch["target"], batch["size"])]
            yield batch.assign(chosen=[[] for _ in floors], floor=floors, value=np.nan)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, size, chosen, floor, value in batch.itertuples(index=False):
                if len(chosen) == size:
                    out.append((t, size, list(chosen), floor, value))
                else:
                    out += [(t, size, own, floor, v) for own, v in lattice.grown(t, list(chosen), size, floor)]
            yield pd.DataFrame(out, columns=["target", "size", "chosen", "floor", "value"])

    spark = df.sparkSession
    sizes = range(1, min(predictors, p - 1) + 1)
    roots = spark.createDataFrame([(t, s) for t in targets for s in sizes], "target int, size int")
    nodes = roots.repartition("target", "size").mapInPandas(seeded, node)
    for _ in sizes:
        nodes = nodes.repartition("target", "size", "chosen").mapInPandas(grow, node)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [sorted(lattice.order[t][s] for s in c) for t, c in zip(batch["target"], batch["chosen"])]
            alone = [corr[s[0], t] if len(s) == 1 else v for t, s, v in zip(batch["target"], sets, batch["value"])]
            yield pd.DataFrame({"target": batch["target"], "predictors": sets, "value": alone})

    found = nodes.mapInPandas(members, "target int, predictors array<int>, value double")
    size = F.size("predictors")
    by = Window.partitionBy("target", size).orderBy(F.round(F.abs("value"), 9).desc(), "predictors")
    best = found.withColumn("at", F.row_number().over(by)).where(F.col("at") <= rows)
    return _by_strength(best.withColumn("metric", F.when(size == 1, "corr").otherwise("R2")), names)


class Analysis(NamedTuple):
    predictions: DataFrame
    correlations: DataFrame
    r2: DataFrame
    top: DataFrame


def analyse(
    df: DataFrame, group: str, target: str, order_by: Sequence[str], clients: int = 4
) -> Analysis:
    """Federated predictions, and the relations of the unmodified numeric columns."""
    table = numeric_columns(df)
    require(table, group, target, *order_by)
    _, model = fit_average(table, group, target, order_by, clients)
    names = table.columns
    sums = pair_moments(table, names)
    return Analysis(
        apply_model(table, model, target), _matrix(sums, names), _r2(sums, names), _top(sums, names, 10)
    )
