import random

import numpy as np
import xxhash
from helpers import AWKWARD, clashing, documents, rows

from duskveil.llm import simhash as S
from duskveil.llm.components import connected_components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", lowered)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints():
    for text in [*AWKWARD, "A b C d E", "a b c a b c a b c", "É é ÉA"]:
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_trie_join_finds_every_pair():
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(40)]
    keys = set(base)
    for b in base:
        for _ in range(30):
            k = b
            for bit in random.sample(range(64), random.randint(1, 4)):
                k ^= 1 << bit
            keys.add(k)
    keys = list(keys)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 3}
    found = set()
    for turn in range(4):
        turned = np.array(sorted((k << 16 * turn | k >> (64 - 16 * turn)) & (2**64 - 1) for k in keys), dtype=np.uint64)
        starts = np.flatnonzero(np.diff(turned >> np.uint64(48), prepend=np.uint64(1 << 63)))
        for i, j in S.node_pairs(turned, starts, 3):
            for a, b in zip(turned[i].tolist(), turned[j].tolist()):
                back = [(x >> 16 * turn | x << (64 - 16 * turn)) & (2**64 - 1) for x in (a, b)]
                found.add((min(back), max(back)))
    assert found == want


def test_components_of_a_long_path(spark, partitions):
    partitions(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(df.limit(0)).count() == 0


def test_near_duplicates(spark, partitions):
    random.seed(4)
    words = ["w%d" % i for i in range(400)]
    texts, ids = list(AWKWARD), [None, 70, 71, 72, 72, 73, 74, 75, 76]
    for i in range(25):
        text = [random.choice(words) for _ in range(150)]
        for j in range(4):
            near = list(text)
            near[random.randrange(150)] = random.choice(words)
            texts.append(" ".join(near))
            ids.append(1000 - len(texts))
    fps = [S.fingerprint(t) for t in texts]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], brute_components(fps, ids)), key=repr)
    docs = documents(spark, texts, ids=ids)
    for n in (1, 6):
        partitions(n)
        assert rows(S.near_duplicates(clashing(docs))) == want
    assert len({r[2] for r in want}) < len(texts) - 20
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    docs = clashing(documents(spark, ["a b c d", "a b c d", "A B c d", None, "", "z y x w v"], ids=[7, 3, 3, None, None, 9]))
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
    assert len(found) == 3 and found[1][0] == 3 and found[2][0] == 9 and found[0][0] == -1
