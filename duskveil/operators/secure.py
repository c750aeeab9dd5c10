"""Ring-masked contributions and the sum recovered from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.functions import noise
from duskveil.functions.names import ref, require
from duskveil.operators.shape import drop_missing_numbers
from duskveil.plans.ordering import NUMBER, number_rows


def masked_contributions(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    seed: int | str,
    noise_range: float = 50.0,
    groups: Sequence[str] = (),
) -> DataFrame:
    """One row per party: what it holds, both masks and what it publishes.

    The mask of party i is a pure function of the seed and i, so the mask it
    receives from party i - 1 is drawn again instead of passed along. The
    columns ``groups`` come first in the order and are kept, so the parties of a
    group are neighbours in the ring.
    """
    if noise_range <= 0:
        raise ValueError("noise_range must be positive")
    require(df, value, *order_by, *groups)
    present = drop_missing_numbers(df, value).select(
        *[ref(c) for c in groups],
        *[ref(c).alias(f"__k{i}") for i, c in enumerate(order_by)],
        ref(value).cast("double").alias("private_value"),
    )
    order = [ref(c).asc() for c in groups]
    order += [F.col(f"__k{i}").asc() for i in range(len(order_by))]
    party = F.col(NUMBER)

    def mask(i: Column) -> Column:
        return noise.between(seed, -noise_range, noise_range, F.lit("ring"), i)

    incoming, outgoing = mask(party - 1), mask(party)
    first_seed = F.pmod(noise.keyed_hash(seed, F.lit("party")), F.lit(999_999_999)) + 1
    return number_rows(present, order).df.select(
        *[ref(c) for c in groups],
        party.alias("party_id"),
        "private_value",
        incoming.alias("incoming_mask"),
        outgoing.alias("outgoing_mask"),
        (F.col("private_value") + outgoing - incoming).alias("masked_contribution"),
        (first_seed + party).alias("seed"),
    )


def secure_sum(parties: DataFrame, seed: int | str, noise_range: float = 50.0) -> DataFrame:
    """Masked sum, the sum recovered by removing the open ends, and the true sum."""
    return _recovered(parties, [], seed, noise_range)


def grouped_secure_sums(
    df: DataFrame,
    value: str,
    groups: Sequence[str],
    order_by: Sequence[str],
    seed: int | str,
    noise_range: float = 50.0,
) -> DataFrame:
    """One secure sum per group. The sum of a single party would be its value,
    so groups of one are left out; a null group is a group."""
    parties = masked_contributions(df, value, order_by, seed, noise_range, groups)
    return _recovered(parties, groups, seed, noise_range).where(F.col("parties") > 1)


def _recovered(
    parties: DataFrame, groups: Sequence[str], seed: int | str, noise_range: float
) -> DataFrame:
    sums = parties.groupBy(*[ref(c) for c in groups]).agg(
        F.count("*").alias("parties"),
        F.sum("masked_contribution").alias("masked_sum"),
        F.sum("private_value").alias("actual_sum"),
        F.min_by("incoming_mask", "party_id").alias("initial_mask"),
        F.max_by("outgoing_mask", "party_id").alias("final_mask"),
    )
    recovered = F.col("masked_sum") - F.col("final_mask") + F.col("initial_mask")
    return sums.select(
        *[ref(c) for c in groups],
        "parties",
        "masked_sum",
        recovered.alias("recovered_sum"),
        "actual_sum",
        "initial_mask",
        "final_mask",
        F.lit(float(noise_range)).alias("noise_range"),
        F.lit(str(seed)).alias("seed"),
    )
