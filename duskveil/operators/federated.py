"""Ridge models fitted per client, averaged and applied."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions.names import known, ref, replace_columns, require
from duskveil.operators.shape import expand_dates, feature_columns, numeric_columns
from duskveil.plans.scratch import stash

#: Products of pairs of columns that a task holds at once.
_PRODUCTS = 2_000_000
_MODEL = "client int, intercept double, coefficients map<string,double>"


def _chosen_clients(
    df: DataFrame, group: str, features: dict[str, Column], order_by: Sequence[str], clients: int
) -> DataFrame:
    """``client``, ``__group``, ``rows`` and feature ``means`` of the first groups.

    One aggregate over the table, then a top-k: at most ``clients`` rows, which
    is the bound of what the caller broadcasts.
    """
    seen = (
        df.where(ref(group).isNotNull())
        .groupBy(ref(group).alias("__group"))
        .agg(
            F.min(F.struct(*[ref(c) for c in order_by])).alias("__first"),
            F.count("*").alias("rows"),
            F.array(*[F.avg(c) for c in features.values()]).alias("means"),
        )
    )
    listed = F.array_sort(F.collect_list(F.struct("__first", "__group", "rows", "means")))
    return (
        seen.orderBy("__first")
        .limit(clients)
        .agg(listed.alias("all"))
        .select(F.posexplode("all").alias("spot", "c"))
        .select((F.col("spot") + 1).alias("client"), "c.__group", "c.rows", "c.means")
    )


def client_rows(
    df: DataFrame,
    group: str,
    target: str,
    order_by: Sequence[str],
    clients: int = 4,
    date_pair: tuple[str, str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Feature rows of the first ``clients`` groups in ``order_by``, target last,
    and the feature names.

    Adds ``client`` (1, 2, … by first appearance) and ``rows``. The group
    stays a feature if it is numeric. Missing values are not filled here:
    ``fit_clients`` takes them at the mean of the client.
    """
    rows, names = _client_rows(df, group, target, order_by, clients, date_pair)
    return rows.drop("means"), names


def _client_rows(
    df: DataFrame,
    group: str,
    target: str,
    order_by: Sequence[str],
    clients: int,
    date_pair: tuple[str, str] | None,
) -> tuple[DataFrame, list[str]]:
    require(df, group, target, *order_by)
    features = feature_columns(df, date_pair)
    if target not in features:
        raise ValueError(f"target column {target!r} is not numeric")
    names = [n for n in features if n != target]
    ordered = {n: features[n] for n in [*names, target]}
    chosen = _chosen_clients(df, group, ordered, order_by, clients)
    rows = df.select(ref(group).alias("__mine"), *[c.alias(n) for n, c in ordered.items()]).join(
        F.broadcast(chosen), F.col("__mine") == F.col("__group")
    )
    return rows.select("client", "rows", "means", *[ref(n) for n in ordered]), names


def fit_clients(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One ridge model (alpha 1, standardised features) per ``client``.

    Missing values count as the mean of the client; a feature or a client
    without any value is left out.
    """
    names = [*features, target]
    means = rows.groupBy("client").agg(
        F.array(*[F.avg(known(rows, c)) for c in names]).alias("means")
    )
    joined = rows.join(F.broadcast(means), "client")  # one row per client
    return _fit(joined, features, target)


def _fit(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Models from rows that carry the ``means`` of their client.

    Each task multiplies its batches of deviations from the means, client by
    client; the p² entries are added up in one aggregate, and one row of them
    per client reaches the solver.
    """
    names = [*features, target]
    p = len(features)
    columns = [known(rows, c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
    sums = summed_products(rows.select("client", "means", *columns), p + 1)
    labels = list(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for client, n, mean, cross in zip(
                batch["client"], batch["n"], batch["means"], batch["products"]
            ):
                mean = np.array([np.nan if m is None else m for m in mean], float)
                if np.isnan(mean[p]):
                    continue
                gram = np.array(cross, float).reshape(p + 1, p + 1)
                seen = np.flatnonzero(~np.isnan(mean[:p]))
                spread = np.sqrt(np.diag(gram)[seen] / n)
                scale = np.where(spread > 0, spread, 1.0)
                inner = gram[np.ix_(seen, seen)] / np.outer(scale, scale)
                weight = np.linalg.solve(inner + np.eye(len(seen)), gram[seen, p] / scale)
                slope = weight / scale
                out.append(
                    (
                        int(client),
                        float(mean[p] - slope @ mean[seen]),
                        {labels[f]: float(s) for f, s in zip(seen, slope)},
                    )
                )
            yield pd.DataFrame(out, columns=["client", "intercept", "coefficients"])

    return sums.select("client", "n", "means", "products").mapInPandas(solve, _MODEL)


def summed_products(rows: DataFrame, width: int) -> DataFrame:
    """``client, n, means, products``: products of the deviations of ``x0`` … from ``means``,
    a flat ``width`` × ``width`` array per client; missing values deviate by 0."""

    chunk = max(1, _PRODUCTS // width**2)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values("client", kind="stable")
            clients = batch["client"].to_numpy()
            x = batch[[f"x{i}" for i in range(width)]].to_numpy(dtype=float, na_value=np.nan)
            means = np.stack(batch["means"].to_numpy()).astype(float)
            apart = np.nan_to_num(x - means)
            for at in range(0, len(batch), chunk):
                own, part = clients[at : at + chunk], apart[at : at + chunk]
                starts = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
                each = (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
                sums = np.add.reduceat(each, starts, axis=0)
                counts = np.diff(np.append(starts, len(own)))
                for spot, total, count in zip(starts, sums, counts):
                    known_so_far = totals.setdefault(int(own[spot]), [0, means[at + spot], 0.0])
                    known_so_far[0] += int(count)
                    known_so_far[2] = known_so_far[2] + total
        out = [(c, n, mean.tolist(), t.tolist()) for c, (n, mean, t) in totals.items()]
        yield pd.DataFrame(out, columns=["client", "rows", "means", "entries"])

    # one row per task and client
    parts = stash(
        rows.mapInPandas(
            multiply, "client int, rows bigint, means array<double>, entries array<double>"
        )
    )
    counts = parts.groupBy("client").agg(
        F.sum("rows").alias("n"), F.first("means").alias("means")
    )
    entries = (
        parts.select("client", F.posexplode("entries").alias("at", "value"))
        .groupBy("client", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("client")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"]
            ).alias("products")
        )
    )
    return counts.join(entries, "client")


def average_models(models: DataFrame) -> DataFrame:
    """One row ``(intercept, coefficients)``: unweighted means over the models
    that have the feature; no row if there is no model."""
    features = (
        models.select(F.explode("coefficients").alias("feature", "weight"))
        .groupBy("feature")
        .agg(F.avg("weight").alias("weight"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "weight")))))
    )
    return models.agg(
        F.avg("intercept").alias("intercept"), features.scalar().alias("coefficients")
    ).where("intercept is not null")


def apply_model(df: DataFrame, model: DataFrame, target: str) -> DataFrame:
    """Target becomes the prediction from the features present in ``df``.

    The averaged model (one row, one number per feature) becomes literals of
    one projection. A missing feature value gives a missing prediction; without
    any present feature the table is unchanged.
    """
    found = model.first()
    if found is None:
        raise ValueError("no local models")
    present = [n for n in found["coefficients"] if n in df.columns]
    if not present:
        return df
    guess = F.lit(found["intercept"])
    for name in sorted(present):
        guess = guess + F.lit(found["coefficients"][name]) * ref(name)
    return replace_columns(df, {target: guess})


def coefficient_matrix(models: DataFrame, clients: int = 4) -> DataFrame:
    """One row per feature, one column ``client_i`` per client."""
    long = models.select("client", F.explode("coefficients").alias("feature", "weight"))
    wide = long.groupBy("feature").pivot("client", list(range(1, clients + 1)))
    table = wide.agg(F.first("weight"))
    return table.toDF("feature", *[f"client_{i}" for i in range(1, clients + 1)])


def fit_average(
    df: DataFrame,
    group: str,
    target: str,
    order_by: Sequence[str],
    clients: int = 4,
    date_pair: tuple[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The local models and their average, from two scans of the table."""
    rows, features = _client_rows(df, group, target, order_by, clients, date_pair)
    models = _fit(rows, features, target)
    return models, average_models(models)


def federated_regression(
    df: DataFrame,
    mode: str,
    group: str,
    target: str,
    order_by: Sequence[str],
    clients: int = 4,
    date_pair: tuple[str, str] | None = None,
) -> DataFrame:
    """Prepare by ``mode`` (``numeric`` keeps numbers, ``date`` expands dates),
    fit per client, average, and put the predictions in the target column."""
    if mode == "numeric":
        table = numeric_columns(df)
    elif mode == "date":
        table = expand_dates(df)
    else:
        raise ValueError(f"invalid mode {mode!r}: use 'numeric' or 'date'")
    require(table, group, target, *order_by)
    _, model = fit_average(table, group, target, order_by, clients, date_pair)
    return apply_model(table, model, target)
