import random
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, SMALL, clashing, documents, rows

from duskveil.llm import toxicity as T


def corpus(spark, n=400):
    random.seed(5)
    words = ["word%d" % i for i in range(300)]
    texts, toxic = [], []
    for i in range(n):
        sentences = [" ".join(random.choices(words, k=8)) + "." for _ in range(random.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            at = random.randrange(len(sentences))
            sentences[at] = "you " + random.choice(["zork", "blarg"]) + " " + sentences[at]
        texts.append(" ".join(sentences))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    return documents(spark, texts), labels, texts, toxic


def test_learns_sentences_from_documents(spark):
    docs, labels, texts, toxic = corpus(spark)
    found = T.toxicity(clashing(docs), labels).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    outside = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in outside]) > 0.97
    for r in found:
        for span in r["offending"]:
            sentence = texts[r["doc_id"]][span["start"] : span["stop"]]
            assert "zork" in sentence or "blarg" in sentence


def test_held_out_labels_are_not_read(spark):
    docs, labels, _, _ = corpus(spark, 120)
    flipped = labels.selectExpr(
        "doc_id", "quality", "cast(if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as int) as toxic"
    )
    assert rows(T.toxicity(docs, labels)) == rows(T.toxicity(docs, flipped))


def test_awkward_rows(spark):
    docs, labels, _, _ = corpus(spark, 60)
    odd = documents(spark, AWKWARD, ids=[None, 0, 0, 1, 1, 2, 3, 4, 5])
    none = spark.createDataFrame([(None, 1, 1), (1, 0, None), (999, 1, 1)], labels.schema)
    for table in (labels, none, labels.limit(0)):
        found = T.toxicity(odd, table).collect()
        assert len(found) == len(AWKWARD)
        assert all(r["score"] == 0 for r in found if r["n_sentences"] == 0)
    assert T.toxicity(docs.limit(0), labels).count() == 0


def test_sentences():
    text = "One. Two! \n\n Three? four"
    assert [text[a:b].strip() for a, b in T.sentences(text)] == ["One.", "Two!", "Three?", "four"]
    assert T.sentences(None) == T.sentences(" .. \n") == []


def test_held_out_accuracy_on_the_tables(spark):
    import os

    if not os.path.isdir(SMALL):
        pytest.skip("driver tables are absent")
    sf = SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = T.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    ranks = scored["score"].rank()
    bad = scored["toxic"] == 1
    area = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert area > 0.97
