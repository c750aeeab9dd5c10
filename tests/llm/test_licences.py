import random
import re

import duckdb
from helpers import AWKWARD, clashing, documents, rows
from oracle import differences

from duskveil.llm import licences as L
from duskveil.llm.sql import licence_sql

MIT = L.NOTICES["mit"]
TEXTS = [
    "Licensed under CC BY-NC 4.0. All rights reserved.", "cc by cc by cc by", "all  rights\nRESERVED; general public license",
    "This work is licensed under the GNU General Public License, version 3.", "ccby cc-by x", "general public the license",
    "x " * 50 + MIT + " y" * 30, MIT.replace("granted", "granted kindly").replace("person", "person or persons"), MIT[: len(MIT) // 2],
    "of the software of any of the person obtaining", *AWKWARD,
]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label) for label, phrase in L.BASE.items() for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in places})),
    )


def test_base_phrases_and_rows(spark, partitions):
    docs = documents(spark, TEXTS)
    for n in (1, 5):
        partitions(n)
        found = L.scan(clashing(docs)).collect()
        assert len(found) == len(TEXTS)
        for r in found:
            got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
            assert got == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]][:60]
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert L.scan(docs.limit(0)).count() == 0


def sql_differences(spark, texts):
    docs = documents(spark, texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in docs.collect()])
    return differences(L.scan(docs).drop("matches"), con, licence_sql())


def chain_cover(words, notice, shift):
    """Most template words on one chain, over all hits of a text: the plain rule."""
    spots = notice.split()
    pairs = list(zip(spots, spots[1:]))
    hits = [(p, s) for p, pair in enumerate(zip(words, words[1:])) for s, q in enumerate(pairs) if q == pair]
    best = {}
    for p, s in hits:
        best[p, s] = max(
            [2] + [
                n + (1 if t == s - 1 else 2) for (q, t), n in best.items()
                if q < p and t < s and abs((p - s) - (q - t)) <= shift
            ]
        )
    return max(best.values(), default=0) / len(spots)


WHOLE = L.NOTICES["mit text"]


def test_notices(spark):
    found = {r["doc_id"]: r for r in L.scan(documents(spark, TEXTS)).collect()}
    assert found[0]["labels"] == "cc-by,cc-by-nc-4.0,reserved"
    assert found[3]["labels"] == "gpl,gpl-3.0"
    assert found[6]["labels"] == "mit" and found[6]["score"] == 1.0
    (match,) = found[6]["matches"]
    assert (match["first"], match["last"]) == (50, 50 + len(MIT.split()) - 1)
    assert found[7]["labels"] == "mit"  # two words put in shift the diagonal
    assert found[8]["labels"] == "" and found[9]["labels"] == "" and found[9]["score"] == 0.0


def test_repeated_rows(spark):
    docs = documents(spark, [TEXTS[0]] * 50 + [None], ids=[None] * 50 + [1])
    assert len(set(rows(L.scan(docs).drop("matches")))) == 2


def test_single_pairs_on_neighbouring_diagonals(spark):
    texts = [
        "licensed under a CC BY-NC 4.0 license", "creative commons by attribution sharealike",
        "Released under the MIT License.", "creative commons here and creative commons there",
        "licensed under a contract, as the others, and sealed", "under the tree",
    ]
    found = {r["doc_id"]: r for r in L.scan(documents(spark, texts)).collect()}
    assert found[0]["labels"] == "cc-by,cc-by-nc-4.0" and found[0]["score"] == 1.0
    assert found[1]["labels"] == "cc-by-sa"
    assert found[2]["labels"] == "mit short"
    assert [found[i]["labels"] for i in (3, 4, 5)] == ["", "", ""]
    assert sql_differences(spark, texts) == []


def edited(text, rng, cut=0.02, put=0.02):
    """Words left out and put in at random, at least ten words apart."""
    out, last = [], 0
    for i, word in enumerate(text.split()):
        draw = rng.random()
        if i - last >= 10 and draw < cut + put:
            last = i
            out += [] if draw < cut else ["very", word]
        else:
            out.append(word)
    return " ".join(out)


def test_whole_licences(spark):
    rng = random.Random(9)
    shuffled = WHOLE.split()
    rng.shuffle(shuffled)
    halves = " ".join(WHOLE.split()[80:] + WHOLE.split()[:80])
    texts = [
        f"Copyright 2020 X. {WHOLE.capitalize()} more words here", *[edited(WHOLE, rng) for _ in range(5)], " ".join(shuffled),
        halves, " ".join(WHOLE.split()[:60]), f"{WHOLE} {' filler' * 40} {L.NOTICES['isc text']}",
    ]
    found = {r["doc_id"]: r for r in L.scan(documents(spark, texts)).collect()}
    (whole,) = [m for m in found[0]["matches"] if m["label"] == "mit text"]
    assert (whole["first"], whole["last"], whole["covered"]) == (3, 2 + len(WHOLE.split()), 1.0)
    shift = len(WHOLE.split()) // 10
    for i, text in enumerate(texts):
        spans = [m for m in found[i]["matches"] or [] if m["label"] == "mit text"]
        cover = chain_cover(text.lower().replace(".", "").split(), WHOLE, shift)
        assert bool(spans) == (cover >= L.COVER), (i, cover)
        assert len(spans) <= 1 and all(m["covered"] == cover for m in spans)
    assert all(any(m["label"] == "mit text" for m in found[i]["matches"] or []) for i in (0, 1, 2, 3, 4, 5, 9))
    assert all("mit text" not in found[i]["labels"].split(",") for i in (6, 7, 8))
    assert "isc text" in found[9]["labels"].split(",")
    assert sql_differences(spark, texts) == []


def test_order_and_letters(spark):
    notice = L.NOTICES["isc"].split()
    backwards = " ".join(w for i in range(len(notice) - 2, -1, -2) for w in notice[i : i + 2])
    texts = [
        backwards, "general publi\u00e7 license", "RELEASED UNDER THE MIT LICENSE", "all rights re\u017ferved",
        "thi\u017f wor\u212a is licensed under the gnu general public license version 3", *TEXTS, *["general public license"] * 30,
    ]
    found = {r["doc_id"]: r for r in L.scan(documents(spark, texts)).collect()}
    assert found[0]["labels"] == "" and found[1]["labels"] == "" and found[3]["labels"] == ""
    assert found[2]["labels"] == "mit short"
    assert sql_differences(spark, texts) == []


def test_texts_are_cut_once(spark):
    texts = ["", None, "one", "a  b", "-Über STRASSE\u212a- É.é 1\ufffd2 ", "𝒳 YZ"]
    grams = L._grams(documents(spark, texts))
    plan = grams._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Filter" not in plan, plan
    found = sorted((r["key"], r["place"], r["gram"]) for r in grams.where("gram is not null").collect())
    wanted = []
    for text in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        wanted += [(text, i, pair) for i, pair in enumerate(zip(words, words[1:]))]
    pairs = spark.createDataFrame([(t, i, *p) for t, i, p in wanted], "t string, i int, a string, b string")
    hashed = pairs.selectExpr("md5(t) AS key", "i", "xxhash64(a, b) AS gram").collect()
    assert found == sorted(tuple(r) for r in hashed)
