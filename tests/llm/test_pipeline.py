import os

import pytest
from helpers import SMALL, documents
from pyspark.sql import functions as F

import corpus_pipeline as C
from duskveil.llm.simhash import fingerprint

PROSE = "Sentence{0} of text{1} speaks{0} about item{2} near place {0}{1} with words{1}x{0} enough."


def made(spark):
    def text(k):
        return "\n".join(PROSE.format(i, k, i * k + k + 3) for i in range(8))

    texts = [text(k) for k in range(30)] + [text(4), text(4), "too short", None, "", "HOME | NEWS | BUY\n" * 40]
    texts[7] += "\nWrite to jo@corp.example or call now."
    return documents(spark, texts, ["a", "b", "c", None] * 9), texts


def stages(spark, docs):
    out = []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, "").cache()
        out.append(docs)
    return out


def test_every_stage(spark):
    docs, texts = made(spark)
    clean, single, private, mixed, encoded = stages(spark, docs)
    for df in (clean, single, private, mixed):
        assert df.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(32))
    kept = [r["text"] for r in single.collect()]
    marks = [fingerprint(t) for t in kept]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(marks) for b in marks[:i])
    assert {r["doc_id"] for r in single.collect()} & {30, 31} == set()
    (seven,) = [r["text"] for r in private.collect() if r["doc_id"] == 7]
    assert "jo@corp" not in seven and "[EMAIL]" in seven
    assert private.count() == single.count()
    copies = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 2 and encoded.count() == mixed.count()


def test_no_documents(spark):
    docs, _ = made(spark)
    assert all(df.count() == 0 for df in stages(spark, docs.limit(0)))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are absent")
def test_reruns_agree(spark):
    first, second = (sorted(map(tuple, C.run(spark, SMALL).collect())) for _ in range(2))
    assert first == second and first
