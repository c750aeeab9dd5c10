from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    spark = session("8")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    # keep small ranges apart, so that the tests cross partition borders
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark


@pytest.fixture
def partitions(spark):
    """Set the shuffle partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def change(count: int) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", str(count))

    yield change
    spark.conf.set("spark.sql.shuffle.partitions", before)
