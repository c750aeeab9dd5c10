import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, SMALL, clashing, documents

from duskveil.llm import maxent as M

TINY = M.Training(classes=3, members=4, tiers=3, class_rows=64, member_rows=128, steps=2)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [""]


def outside(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    counts = Counter(w for i, t in rows if not outside(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {
        i: (
            outside(i), len(words(t)), sum(w in counts for w in words(t)), n,
            sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)),
        )
        for i, t in rows
    }


def compare(found, rows):
    want = base(rows)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)


TEXTS = [*AWKWARD, "Ärger A B b a", "x" * 500, "x" * 500 + " y", "the cat sat on the mat . " * 40]


@pytest.mark.parametrize("block_chars, word_blocks", [(1, 100), (1, 2), (300, 2), (1 << 21, 100)])
def test_counts_against_plain_python(spark, block_chars, word_blocks):
    ids = [*range(len(TEXTS) - 1), None]
    docs = clashing(documents(spark, TEXTS, ids=ids)).repartition(3)
    found = M.score(docs, TINY, block_chars, word_blocks).collect()
    compare(found, list(zip(ids, TEXTS)))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_empty_and_held_out_tables(spark):
    ids = [i for i in range(60) if outside(i)][:4]
    assert M.score(documents(spark, []), TINY).count() == 0
    found = M.score(documents(spark, ["a b", None, "", "c"], ids=ids), TINY).collect()
    assert {r.train_tokens for r in found} == {0} and {r.n_known for r in found} == {0}
    assert all(r.base_score == 0 and r.score == pytest.approx(0, abs=1e-6) for r in found)


def small_model(seed=1):
    random = np.random.default_rng(seed)
    model = M.Model(TINY, np.sort(random.integers(1, 50, 10))[::-1], np.array([7.0, 12.0, 0.0]))
    model.class_weights[:] = random.normal(0, 0.5, model.class_weights.shape)
    model.member_weights[:] = random.normal(0, 0.5, model.member_weights.shape)
    return model


def test_probabilities_add_up():
    model = small_model()
    codes = np.array([0, 5, 13, 2, 9, 12, 1])
    for at in range(len(codes)):
        total = 0.0
        for code in [*range(10), 12, 13]:
            changed = np.append(codes[:at], code)
            total += 10 ** model.log10(changed, np.zeros(len(changed), int))[at]
        assert total == pytest.approx(1, abs=1e-5)


def test_documents_do_not_see_each_other():
    model = small_model()
    first, second = np.array([0, 5, 13]), np.array([2, 9, 12, 1])
    both = model.log10(np.append(first, second), np.array([0] * 3 + [3] * 4))
    alone = [model.log10(x, np.zeros(len(x), int)) for x in (first, second)]
    assert both == pytest.approx(np.concatenate(alone))


def test_sums_are_the_gradient():
    """Observed less expected occurrences against differences of the log probability."""
    model = small_model()
    random = np.random.default_rng(2)
    codes, starts = random.choice([*range(10), 12, 13], 60), np.repeat([0, 25], [25, 35])
    sums = model.empty_sums()
    model.add(sums, codes, starts)
    slope = sums[0] - sums[1]
    first = model.class_weights.size
    for cell in [*random.choice(np.flatnonzero(sums[1][:first]), 15), *(first + random.choice(np.flatnonzero(sums[1][first:]), 15))]:
        weights, at = (model.class_weights, cell) if cell < first else (model.member_weights, cell - first)
        held = weights.flat[at]
        values = []
        for step in (0.05, -0.05):
            weights.flat[at] = held + step
            values.append(model.log10(codes, starts).sum() * math.log(10))
        weights.flat[at] = held
        assert (values[0] - values[1]) / 0.1 == pytest.approx(slope[cell], abs=0.02)


def test_the_model_predicts_held_out_documents_better(spark, partitions):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    partitions(3)
    found = M.score(docs).collect()
    compare(found, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in found if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.03
    again = {r.doc_id: r.score for r in M.score(docs).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-5) for r in found)


@pytest.mark.parametrize("block_chars, word_blocks", [(1, 100), (300, 1), (1 << 21, 100)])
def test_every_word_has_a_leaf_of_its_own(spark, block_chars, word_blocks):
    """Words of many frequencies: the probabilities of all of them and of the unknown one."""
    random = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in random.zipf(1.3, 60) % 400) for _ in range(40)] + [None, "", "w0 w0"]
    known = Counter(w for i, t in enumerate(texts) if not outside(i) for w in words(t))
    asked = [*sorted(known), "never", "seen"]
    ids = [*range(len(texts)), next(i for i in range(1000, 2000) if outside(i))]
    docs = documents(spark, [*texts, " ".join(asked)], ids=ids).repartition(3)
    coded, model, tokens = M._coded(M.words_of_blocks(docs, block_chars), TINY, word_blocks)
    assert tokens == sum(known.values())
    found = coded.where(coded.doc_id == ids[-1]).first().words
    code = dict(zip(words(" ".join(asked)), found))
    assert code["never"] == code["seen"]
    assert len({code[w] for w in known}) == len(known) and code["never"] not in {code[w] for w in known}
    each = np.array([*(code[w] for w in known), code["never"]])
    # no weights: the add-one distribution, but within a stratum
    plain = 10 ** model.log10(model.codes(each), np.arange(len(each)), each)
    expected = np.array([*(n + 1 for n in known.values()), 1]) / (tokens + len(known) + 1)
    assert plain == pytest.approx(expected, rel=0.25) and plain.sum() == pytest.approx(1, abs=1e-5)
    model.class_weights[:] = random.normal(0, 0.5, model.class_weights.shape)
    model.member_weights[:] = random.normal(0, 0.5, model.member_weights.shape)
    model.leaf_weights[:] = random.normal(0, 0.5, model.leaf_weights.shape)
    for before in (each[:0], each[:1], each[[5, -1, 17]]):
        size = len(before) + 1
        texts = np.concatenate([np.append(before, w) for w in each])
        starts = np.repeat(np.arange(len(each)) * size, size)
        chances = 10 ** model.log10(model.codes(texts), starts, texts)[size - 1 :: size]
        assert chances.sum() == pytest.approx(1, abs=1e-5)


def test_rare_words_are_learnt(spark):
    """What follows a word outside the classes: before, the words of a tier scored alike."""
    many = " ".join(f"often{i}" for i in range(TINY.frequent)) + " "
    # an odd number of pairs, so that each is dealt to both updates
    inside = [i for i in range(3000) if not outside(i)][:820]
    held = [i for i in range(3000, 6000) if outside(i)][:78]
    pairs = [f"left{i % 39} right{i % 39}" for i in range(780)]
    right = [f"left{i} right{i}" for i in range(39)]
    wrong = [f"left{i} right{(i + 7) % 39}" for i in range(39)]
    docs = documents(spark, [*pairs, *[many * 20] * 40, *right, *wrong], ids=[*inside, *held])
    found = {r.doc_id: r for r in M.score(docs, TINY).collect()}
    gains = [found[a].score - found[b].score for a, b in zip(held[:39], held[39:])]
    assert found[held[0]].base_score == pytest.approx(found[held[39]].base_score)
    assert sum(g > 0 for g in gains) >= 35 and sum(gains) / 39 > 0.2


def test_sums_of_leaves_are_the_gradient():
    random = np.random.default_rng(4)
    sizes, mass = np.zeros(M.STRATA, np.int64), np.zeros(M.STRATA)
    for stratum, size in ((0, 1), (1, 37), (5, 5), (7, 16), (9, 1), (14, 3), (20, 9)):
        sizes[stratum] = size
        mass[stratum] = size * (1 + stratum)
    leaves = M.Leaves(TINY, sizes, mass)
    model = M.Model(TINY, np.arange(20, 8, -1), leaves.tier_mass, leaves)
    each = np.array([*range(TINY.frequent), *(TINY.frequent + (n << M.STRATUM_BITS) + s for s in range(M.STRATA) for n in range(sizes[s]))])
    words, starts = random.choice(each, 80), np.repeat([0, 25], [25, 55])
    model.leaf_weights[:] = random.normal(0, 0.5, model.leaf_weights.shape)
    sums = model.empty_sums()
    model.add(sums, model.codes(words), starts, words)
    first = model.class_weights.size + model.member_weights.size
    for cell in random.choice(np.flatnonzero(sums[1][first:]), 25):
        held, values = model.leaf_weights.flat[cell], []
        for step in (0.05, -0.05):
            model.leaf_weights.flat[cell] = held + step
            values.append(model.log10(model.codes(words), starts, words).sum() * math.log(10))
        model.leaf_weights.flat[cell] = held
        assert (values[0] - values[1]) / 0.1 == pytest.approx(sums[0][first + cell], abs=0.02)
