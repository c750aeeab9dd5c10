import math

import numpy as np
import pytest
from helpers import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskveil.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    made = [
        (i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows
    ]
    return spark.createDataFrame(made, SCHEMA)


def brute(rows, positives=5, negatives=3):
    """Every anchor with every row, in whole numbers."""
    kept = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for a, (i, u, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = [
            (-sum(x * y for x, y in zip(u, v)), j is None, j or 0, b, k)
            for b, (j, v, k) in enumerate(kept)
            if b != a and len(v) == len(u)
        ]
        scored.sort()
        same = [s for s in scored if s[4] == label][:positives]
        for p, nameless, pid, _, _ in same:
            found = [s for s in scored if s[4] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            for rank, (n, none, nid, _, _) in enumerate(found, 1):
                out.append((i, None if nameless else pid, rank, None if none else nid, -p, -n))
    return sorted(out, key=repr)


def mined(df, mining=N.Mining()):
    return sorted((tuple(r) for r in N.mine(df, F.col("vec_id") % 50 == 0, mining).collect()), key=repr)


def test_against_all_pairs(spark):
    random = np.random.default_rng(3)
    centres = random.standard_normal((6, 12))
    vectors = (centres[random.integers(0, 6, 700)] + 0.4 * random.standard_normal((700, 12))).tolist()
    vectors[100:160] = [vectors[0]] * 60  # ties
    rows = [(i, v, i % 4) for i, v in enumerate(vectors)]
    rows += [
        (1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 12, 1), (1150, [1.0] * 12, None),
        (1200, [float("inf")] * 12, 2), (1250, [], 1), (1300, [], 2), (1350, [], 1), (1400, [0.0] * 12, 1),
        (None, vectors[3], 3), (None, vectors[3], 2), (50, vectors[50], 50 % 4), (1450, [1.0, 2.0, 3.0], 0),
        (1451, [1.0, 2.0, 2.0], 0), (1452, [1.0, 1.0, 1.5], 1),
    ]
    df = table(spark, rows).withColumns({"row": F.lit("x"), "score": F.lit(1), "block": F.lit(None)})
    want = brute(rows)
    assert want and mined(df) == want
    # many small blocks and cells
    assert mined(df.repartition(5), N.Mining(block_numbers=200, cell_rows=3, curve_dims=3)) == want
    assert mined(df.limit(0)) == []
    assert mined(table(spark, [(0, [1.0], 1)])) == []


def test_clusters_are_read_in_part(spark, partitions):
    random = np.random.default_rng(4)
    centres = 4 * random.standard_normal((40, 8))
    home = random.integers(0, 40, 4000)
    vectors = centres[home] + 0.05 * random.standard_normal((4000, 8))
    rows = [(i, v, int(h) % 5) for i, (v, h) in enumerate(zip(vectors.tolist(), home))]
    mining = N.Mining(block_numbers=8 * 25)
    df = table(spark, rows)
    assert mined(df, mining) == brute(rows)
    placed = N.blocks_in_order(N._with_curve(N._usable(df, F.col("vec_id") % 50 == 0, mining), mining), mining)
    zones = N.zone_maps(placed)
    anchors = placed.where("is_anchor").withColumnRenamed("block", "own")
    asked = N.compare_with_zones(
        anchors.withColumn("floor", F.lit(65536 * 60).cast("bigint")), zones, N._reaching_positives,
        "row bigint, block bigint", mining,
    ).count()
    assert asked < 0.1 * anchors.count() * zones.count()


def test_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in df.collect()]
    from duskveil.llm.queries import op12_hard_negatives

    found = sorted((tuple(r) for r in op12_hard_negatives(spark, SMALL).collect()), key=repr)
    assert found == brute(rows)


@pytest.mark.parametrize("dims, bits", [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = N.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6))
def test_bounds_hold(seed, dims):
    random = np.random.default_rng(seed)
    rows = random.integers(-500, 500, (20, dims)).astype(float)
    anchors = random.integers(-500, 500, (5, dims)).astype(float)
    least, greatest = N.product_bounds(anchors, rows.min(0)[None], rows.max(0)[None])
    scores = N.inner_products(anchors, rows)
    assert (scores >= least).all() and (scores <= greatest).all()


def test_large_numbers_stay_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0]])
    assert N.inner_products(a, b)[0, 0] == 2**60 + 3
    with pytest.raises(ValueError):
        N.inner_products(a, a)
