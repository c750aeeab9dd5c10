"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def documents(spark, texts, sources=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    sources = ["a"] * len(texts) if sources is None else sources
    rows = [
        (i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(docs):
    """The same documents beside columns named like inner ones."""
    from pyspark.sql import functions as F

    names = ["key", "size", "words", "fp", "node", "copies", "base", "place", "kept", "score", "n_words", "__row", "row", "__copies", "__copy", "c0", "block", "home"]
    return docs.select(F.lit("x").alias("__extra"), *docs.columns, *[F.lit(1).alias(n) for n in names])


LONG = "word another. " * 20_000
AWKWARD = [None, "", " \n\t ", "one", "one", "One two", LONG, "é ü ß 日本語 \U0001f600.", "a\x00b\x1cc d"]


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)
