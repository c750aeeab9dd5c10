import numpy as np
import pytest
from pyspark.sql import functions as F

from duskveil.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def is_query():
    return F.col("vec_id") % 50 == 0


def table(spark, ids, vectors):
    made = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(made, SCHEMA)


def brute(ids, vectors, k=5):
    vectors = np.array(vectors, dtype=np.float32).astype(float)
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for i, own in enumerate(ids):
        if own % 50 == 0:
            score = (vectors * vectors[i]).sum(axis=1) / (lengths * lengths[i])
            order = sorted((j for j in range(len(ids)) if ids[j] != own), key=lambda j: (-score[j], ids[j]))
            out[own] = [(ids[j], score[j]) for j in order[:k]]
    return out


def test_few_rows_are_searched_whole(spark):
    random = np.random.default_rng(1)
    vectors = random.standard_normal((120, 8))
    vectors[40:60] = vectors[0]  # ties
    ids = list(range(120))
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [], [1.0, 2.0]]
    df = table(spark, ids + [200 + i for i in range(7)] + [None, 5], [*vectors, *odd, vectors[3], vectors[5]])
    df = df.withColumn("part", F.lit("x")).withColumn("score", F.lit(1))
    found = {}
    for r in N.nearest(df, is_query()).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(ids, vectors)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    for q, x in want.items():
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in x], abs=1e-12)
    assert N.nearest(df.limit(0), is_query()).count() == 0
    # every length is searched by itself, the rarer ones too
    short = table(spark, range(300, 340), random.standard_normal((40, 3)))
    both = N.nearest(df.select("vec_id", "embedding", "label").unionByName(short), is_query())
    alone = N.nearest(short, is_query())
    assert alone.count() == 5 and both.count() == sum(map(len, want.values())) + 5
    assert both.where("query_id = 300").exceptAll(alone).count() == 0
    assert N.nearest(table(spark, [0, 1], [[1.0], [2.0]]), is_query()).count() == 1


def test_parts_are_equal_and_cells_split(spark, partitions):
    random = np.random.default_rng(2)
    centres = random.standard_normal((30, 16)) * 3
    vectors = centres[random.integers(0, 30, 3000)] + random.standard_normal((3000, 16))
    part = N.cut_graph(N._units(vectors[:640]), 16, 8, 1)
    assert np.ptp(np.bincount(part)) <= 1
    search = N.Search(sample=1024, trial=200, cell_rows=100)
    df = table(spark, range(3000), vectors)
    want = brute(list(range(3000)), vectors)
    results = []
    for n in (2, 6):
        partitions(n)
        found = {}
        for r in N.nearest(df, is_query(), search).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        results.append(found)
    assert results[0] == results[1]
    hits = sum(len(results[0][q] & {i for i, _ in x}) for q, x in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_recall_on_the_tables(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables are absent")
    df = spark.read.parquet(path)
    data = df.toPandas().sort_values("vec_id")
    want = brute(data["vec_id"].tolist(), np.stack(data["embedding"].to_numpy()))
    found = {}
    for r in N.nearest(df, is_query()).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(found[q]) == 5 for q in want)
    assert sum(len(found[q] & {i for i, _ in x}) for q, x in want.items()) >= 0.9 * 5 * len(want)
