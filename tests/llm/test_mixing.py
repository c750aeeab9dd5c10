import numpy as np
import pytest
from helpers import AWKWARD, clashing, documents, rows

from duskveil.llm import mixing as M


def filled(sizes, weights, share, most):
    """Targets by resharing the excess until nobody is above the cap."""
    target = {s: 0.0 for s in sizes}
    rest, open_ = share * sum(sizes.values()), set(sizes)
    while open_:
        per = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if per * weights[s] >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = per * weights[s]
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    random = np.random.default_rng(seed)
    names = [None, "", "Z", "a", "b", "é"][: 2 + seed]
    sizes = {n: int(random.integers(0, 1000)) for n in names}
    order = sorted(sizes, key=lambda n: (n is None, n or ""))
    weights = {n: M.WEIGHTS[i % 3] for i, n in enumerate(order)}
    df = spark.createDataFrame([(n, 1, s) for n, s in sizes.items()], "source string, docs bigint, source_size bigint")
    found = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    assert found == pytest.approx(filled(sizes, weights, M.SHARE, M.MOST))


def test_pivot_keeps_words_and_expectation():
    random = np.random.default_rng(0)
    sizes = np.sort(random.integers(1, 60, 40).astype(float))[::-1]
    total = np.zeros(40)
    for _ in range(4000):
        expected = np.full(40, 1.3)
        left = M.pivot(expected, sizes, random.integers(0, 2**64, 40, dtype=np.uint64))
        assert (expected * sizes).sum() == pytest.approx(1.3 * sizes.sum())
        whole = np.delete(expected, [] if left is None else [left])
        assert set(np.round(whole, 6)) <= {1.0, 2.0}
        total += expected
    assert total / 4000 == pytest.approx(np.full(40, 1.3), abs=0.05)


def test_sources_meet_targets(spark, partitions):
    random = np.random.default_rng(3)
    texts = ["w " * int(n) for n in random.integers(0, 200, 3000)]
    sources = ["hot" if i % 3 == 0 else f"s{i % 7}" for i in range(3000)]
    docs = documents(spark, texts, sources)
    want = None
    for n in (2, 7):
        partitions(n)
        mixed = M.mix(docs, group_rows=64, fan_in=4)  # three levels
        found = rows(mixed)
        want = want or found
        assert found == want
    taken, target = {}, {}
    for _, size, _, goal, copies, words, source in want:
        assert words == copies * size and 0 <= copies <= 2
        taken[source] = taken.get(source, 0) + words
        target[source] = goal
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 200, source


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD, [None, "a", "a", "b", "b", None, "c", "c", ""], [None, None, 2, 3, 3, 5, 6, 7, 8])
    found = rows(M.mix(docs))
    assert found == rows(M.mix(clashing(docs))) and len(found) == len(AWKWARD)
    assert all(r[5] == 0 for r in found if r[1] == 0)
    assert M.mix(docs.limit(0)).count() == 0
    assert M.mix(documents(spark, [None, ""])).count() == 2


def test_documents_repeat(spark):
    docs = clashing(documents(spark, [f"w{i} " * 50 for i in range(90)], ["a", "b", "c"] * 30))
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg({"doc_id": "count"}).toDF("source", "n").collect()}
    # 30 documents each; weights 3, 1, 2 of 135: a is capped at 60, then b 25, c 50
    assert words["a"] == 60 and words["b"] == 25 and words["c"] == 50
