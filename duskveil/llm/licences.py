"""Licence scans by diagonal voting, in DataFrame expressions only.

Every pair of neighbouring words of every text is hashed and joined to the
places of the same pair in the templates. A hit votes for the diagonal "place in
the text minus place in the template"; neighbouring diagonals are merged, so
inserted or missing words do not break a match. A merged run is verified by its
longest chain of pairs that stand in the same order in text and template: it must
cover most of the template's words.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskveil.plans.scratch import stash

#: What stands between words: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that must stand word by word, and their labels.
BASE = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

#: Notices, any wording close to which counts, and their labels.
NOTICES = {
    "agpl": "gnu affero general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0 grant": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-nc-sa": "creative commons attribution noncommercial sharealike",
    "cc-by-sa": "creative commons attribution sharealike",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-later": "either version 3 of the license or at your option any later version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit short": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "no-copying": "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# The wording of whole licences, in lower case and without punctuation.
NOTICES |= {
    "bsd-2 text": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met 1 redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution this software is provided by the copyright holders and contributors as is and any express
        or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct
        indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any
        theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any
        way out of the use of this software even if advised of the possibility of such damage""",
    "isc text": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect
        or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an
        action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "mit text": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the software the software
        is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
        holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
}

#: Diagonals at most so far apart belong together; in long templates, a tenth of their words.
SHIFT = 3
#: Share of a notice's words that a span must cover.
COVER = 0.8


def template_pairs(base: dict = BASE, notices: dict = NOTICES) -> list[tuple]:
    """``first, second, label, exact, size, shift, spot`` of every word pair."""
    rows = []
    for exact, texts in ((True, base), (False, notices)):
        for label, text in texts.items():
            words = text.split()
            shift = max(SHIFT, len(words) // 10)
            rows += [
                (a, b, label, exact, len(words), shift, spot)
                for spot, (a, b) in enumerate(zip(words, words[1:]))
            ]
    return rows


def templates(spark: SparkSession, base: dict = BASE, notices: dict = NOTICES) -> DataFrame:
    """``gram, label, exact, size, shift, spot``: one row per word pair of a template.
    Some hundreds of rows, whatever the corpus."""
    made = spark.createDataFrame(
        template_pairs(base, notices),
        "first string, second string, label string, exact boolean, size int, shift int, spot int",
    )
    gram = F.xxhash64("first", "second").alias("gram")
    return made.select(gram, "label", "exact", "size", "shift", "spot")


def _lowered(text: Column) -> Column:
    """The text with A-Z in lower case, all other letters as they are."""
    plain = F.length(text) == F.octet_length(text)
    # the same for ASCII alone, at a fraction of the time
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _words_in(text: Column) -> Column:
    """The words in order, cut at what is between them: several times as fast as
    a search for the words themselves. No words for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _longest_chain(hits: Column, size: Column, shift: Column) -> Column:
    """``words, first, last`` of the chain of hits that covers most words of the template.

    ``hits`` are ``place, spot``, sorted. Places and spots grow along a chain, and its
    diagonals move by at most ``shift`` from pair to pair, so only hits within
    ``size + shift`` places can be continued and no others are kept.
    """

    def step(state: Column, hit: Column) -> Column:
        place, spot = hit["place"], hit["spot"]
        before = F.filter(
            state["recent"],
            lambda h: (h["place"] < place)
            & (h["spot"] < spot)
            & (F.abs((place - spot) - (h["place"] - h["spot"])) <= shift),
        )
        longer = F.transform(
            before,
            lambda h: F.struct(
                (h["words"] + F.when(h["spot"] == spot - 1, 1).otherwise(2)).alias("words"),
                h["first"].alias("first"),
            ),
        )
        alone = F.struct(F.lit(2).alias("words"), place.alias("first"))
        best = F.coalesce(F.array_max(longer), alone)
        here = F.struct(
            place.alias("place"), spot.alias("spot"), best["words"].alias("words"), best["first"].alias("first")
        )
        ends = F.struct(
            best["words"].alias("words"), best["first"].alias("first"), (place + 1).alias("last")
        )
        kept = F.filter(state["recent"], lambda h: h["place"] >= place - size - shift)
        return F.struct(
            F.concat(kept, F.array(here)).alias("recent"),
            F.greatest(state["best"], ends).alias("best"),
        )

    start = F.expr(
        "named_struct('recent', cast(array() as array<struct<place:int,spot:int,words:int,first:int>>),"
        " 'best', named_struct('words', 0, 'first', 0, 'last', 0))"
    )
    return F.aggregate(hits, start, step, lambda state: state["best"])


def _grams(docs: DataFrame) -> DataFrame:
    """``key, place, gram``: the hash of every two neighbouring words of every text,
    null for a text without such."""
    words = docs.select(
        F.md5(F.coalesce("text", F.lit(""))).alias("key"),
        _words_in(_lowered(F.col("text"))).alias("words"),
    )
    pairs = F.greatest(F.size("words") - 1, F.lit(0))
    # a filter on the words, such as Spark adds to an inner posexplode, would cut every
    # text once more
    return words.select(
        "key",
        F.posexplode_outer(
            F.zip_with(
                F.slice("words", F.lit(1), pairs),
                F.slice("words", F.lit(2), pairs),
                lambda a, b: F.xxhash64(a, b),
            )
        ).alias("place", "gram"),
    )


def found_spans(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES) -> DataFrame:
    """``key, label, exact, first, last, covered``: verified spans of every distinct
    text; ``key`` is the digest of the text, places count words from 0. ``last`` is the
    place of a span's last word."""
    hits = (
        _grams(docs).join(F.broadcast(templates(docs.sparkSession, base, notices)), "gram")
        .select("key", "label", "exact", "size", "shift", "spot", "place")
        .distinct()  # of equal texts
        .withColumn("diagonal", F.col("place") - F.col("spot"))
    )
    # written, since both kinds of templates read the votes
    votes = stash(
        hits.groupBy("key", "label", "exact", "size", "shift", "diagonal").agg(
            F.collect_list("spot").alias("spots"),
            F.min("place").alias("first"),
            (F.max("place") + 1).alias("last"),
        )
    )
    # a phrase needs all its pairs on one diagonal
    phrases = votes.where("exact and size(spots) = size - 1").select(
        "key", "label", "exact", "first", "last", F.lit(1.0).alias("covered")
    )
    # neighbouring diagonals, those of a single pair too; a single pair in all is chance
    along = Window.partitionBy("key", "label").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.coalesce(step > F.col("shift"), F.lit(True))
    on_diagonal = F.transform(
        "spots", lambda s: F.struct((F.col("diagonal") + s).alias("place"), s.alias("spot"))
    )
    merged = (
        votes.where("not exact")
        .withColumn("apart", apart.cast("int"))
        .withColumn("run", F.sum("apart").over(along))
        .groupBy("key", "label", "exact", "size", "shift", "run")
        .agg(F.array_sort(F.flatten(F.collect_list(on_diagonal))).alias("hits"))
        .where(F.size("hits") > 1)
    )
    # no chain covers more than all hits do, so few runs are left to verify
    words_met = F.size(
        F.array_distinct(F.flatten(F.transform("hits", lambda h: F.array(h["spot"], h["spot"] + 1))))
    )
    verified = merged.where(words_met >= F.col("size") * F.lit(COVER)).withColumn(
        "chain", _longest_chain(F.col("hits"), F.col("size"), F.col("shift"))
    )
    spans = verified.select(
        "key",
        "label",
        "exact",
        F.col("chain.first").alias("first"),
        F.col("chain.last").alias("last"),
        (F.col("chain.words") / F.col("size")).alias("covered"),
    ).where(F.col("covered") >= COVER)
    return phrases.unionByName(spans)


def scan(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES) -> DataFrame:
    """One row per document.

    ``n_words``; ``n_base``, ``first_word`` and ``last_word``: places of the exact
    phrases, the smallest and largest start; ``base_labels`` and ``labels`` (with
    the notices), distinct, sorted, comma-joined, empty if there are none;
    ``score``, the largest verified cover, 0 without a span; ``matches``, all
    verified spans, the best of each run of diagonals, null if there are none. A null text is an empty one. Equal texts share a scan, and
    each repeated row or null id gets its own result. No documents, no rows.
    """
    by_text = found_spans(docs, base, notices).groupBy("key").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("bigint").alias("last_word"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ","
        ).alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "covered"))).alias("matches"),
    )
    counted = docs.select(
        "doc_id",
        F.md5(F.coalesce("text", F.lit(""))).alias("key"),
        F.size(_words_in(F.col("text"))).cast("bigint").alias("n_words"),
    )
    # a written table right under the join lets Spark split the rows of a hot text
    joined = counted.join(stash(by_text), "key", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "matches",
    )
