"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Patterns find the protected entities (mail and IP addresses, card and phone
numbers) and the groups they belong to (domain, network, issuer, phone range).
The co-occurrence of terms and entities in whole texts tells how strongly a term
reveals one. It discloses the entity if who reads the term can guess it, that is
P(entity | term) >= 2 ** -slack_bits, and learns it from the term: their pointwise
mutual information, log2(P(entity | term) / P(entity)), is at least ``lift_bits``.
Such terms are generalised in all documents, and removed if they occur with the
entity alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskveil.plans.scratch import stash

#: Kind and pattern of the protected entities, in the order of the output.
#: They match what the plain patterns match, but never scan a run of characters
#: twice and never recurse, however long the run: look-behinds let a match begin
#: only at the start of a run (or where the last match ended), and repetitions
#: that cannot give way are possessive.
#:   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#:   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
#:   card   [0-9]([\x20-]?[0-9])+ of 16 to 19 digits, Luhn
#:   phone  \+[0-9][\x20().0-9-]+[0-9] of 8 to 15 digits
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What may become a term, once the entities are blanked out.
TERM = r"[\p{L}\p{N}]+"

_SPAN = "struct<kind:string,start:bigint,stop:bigint,value:string>"


@dataclass(frozen=True)
class Disclosure:
    """``support``: distinct texts with term and entity from which their share is taken
    as it is; with fewer, n, it is shrunk by n / (n + 2).
    ``slack_bits``: whole bits of the entity's information that may stay hidden.
    ``lift_bits``: whole bits that the term must tell about the entity.
    ``shortest``: characters of a term."""

    support: int = 3
    slack_bits: int = 1
    lift_bits: int = 2
    shortest: int = 4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")

    def part(digit: Column, place: Column) -> Column:
        one = digit.cast("int")
        twice = F.when(one > 4, one * 2 - 9).otherwise(one * 2)
        return F.when(place % 2 == 1, twice).otherwise(one)

    total = F.aggregate(F.transform(digits, part), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        byte = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(byte))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind with their places in code points.

    ``split`` gives what lies between the matches, so running lengths give
    their places.
    """
    pieces = F.arrays_zip(
        F.split(text, KINDS[kind], -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0)).alias("found"),
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        stop = start + F.coalesce(F.length(piece["found"]), F.lit(0))
        span = F.struct(
            F.lit(kind).alias("kind"),
            start.cast("bigint").alias("start"),
            stop.cast("bigint").alias("stop"),
            piece["found"].alias("value"),
        )
        more = F.when(piece["found"].isNull(), state["out"]).otherwise(
            F.concat(state["out"], F.array(span))
        )
        return F.struct(stop.cast("bigint").alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    found = F.aggregate(pieces, start, step, lambda state: state["out"])
    hint = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]
    return F.when(hint, F.filter(found, lambda s: _valid(kind, s["value"]))).otherwise(none)


def base_spans(text: Column) -> Column:
    """All spans of the four kinds, by kind and then by start; null reads as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_spans(text, kind) for kind in KINDS])


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    each = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    )
    return F.array_join(each, ",")


def _entity(span: Column) -> Column:
    """What makes two mentions the same entity: its kind and bare value."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(
        F.lower(span["value"])
    )
    return F.concat_ws(":", span["kind"], value)


def find_entities(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, text``: written once. ``key`` is a digest of the text
    (equal texts are one text below); ``text`` is kept where there are spans."""
    spans = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.md5("text").alias("key"), base_spans(F.col("text")).alias("base")
    )
    return stash(
        spans.select(
            "doc_id", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")
        )
    )


def _terms(text: Column, shortest: int) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(words, lambda w: F.length(w) >= shortest)


def _blanked(text: Column, base: Column) -> Column:
    """The text with spaces in place of its entities, as long as before."""

    def blank(now: Column, span: Column) -> Column:
        size = (span["stop"] - span["start"]).cast("int")
        return F.concat(
            F.substr(now, F.lit(1), span["start"].cast("int")),
            F.repeat(F.lit(" "), size),
            F.substr(now, span["stop"].cast("int") + 1),
        )

    return F.aggregate(base, text, blank)


def _group(span: Column) -> Column:
    """What entities share: the domain of an address, the network, the issuer of a
    card, the number of a phone without its last four digits."""
    value, digits = span["value"], _digits(span["value"])
    shared = (
        F.when(span["kind"] == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(span["kind"] == "ip", F.substring_index(value, ".", 3))
        .when(span["kind"] == "card", F.substr(digits, F.lit(1), F.lit(6)))
        .otherwise(F.substr(digits, F.lit(1), F.length(digits) - 4))
    )
    return F.concat_ws(":", F.lit("group"), span["kind"], shared)


def _posting() -> list[Column]:
    """128 bits of the set of texts (``key``) that a group of rows names, each once."""
    return [
        F.bit_xor(F.xxhash64("key")).alias("p0"),
        F.bit_xor(F.xxhash64(F.lit("posting"), "key")).alias("p1"),
    ]


def telltale_terms(docs: DataFrame, found: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """``term, alone``: terms that disclose an entity or group, judged by whole texts.

    P(entity | term) is the share of the term's documents that name the entity, shrunk
    below ``support`` distinct texts; one text alone never reaches a half. Entities that
    the same texts name are one row, and so are terms that stand in the same of these
    texts and in equally many documents, so a long directory and its copies do not pair
    each address with each word. Terms too frequent to tell are left out before the join.
    """
    everyone = found.count()
    copies = found.where(F.size("base") > 0).groupBy("key").agg(
        F.count("*").alias("copies"), F.first("base").alias("base"), F.first("text").alias("text")
    )
    named = F.array_distinct(F.concat(F.transform("base", _entity), F.transform("base", _group)))
    mentions = stash(copies.select("key", "copies", F.explode(named).alias("entity")))
    # what a single text names cannot reach the estimate with any term
    entities = stash(
        mentions.groupBy("entity")
        .agg(F.count("*").alias("texts"), F.sum("copies").alias("named"), *_posting())
        .where("texts > 1")
        .groupBy("p0", "p1", "texts", "named")
        .agg(F.min("entity").alias("entity"))
        .select("entity", "named")
    )
    mentions = stash(mentions.join(entities, "entity"))
    words = stash(
        copies.join(mentions.select("key").distinct(), "key", "left_semi").select(
            "key",
            "copies",
            F.explode(
                F.array_distinct(_terms(_blanked(F.col("text"), F.col("base")), rules.shortest))
            ).alias("term"),
        )
    )
    near = (
        words.groupBy("term")
        .agg(F.count("*").alias("texts"), F.sum("copies").alias("with_any"), *_posting())
        .where("texts > 1")
    )
    everywhere = (
        docs.select(F.explode(F.array_distinct(_terms(F.col("text"), rules.shortest))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("documents"))
    )
    guess, lift = F.lit(2**rules.slack_bits), F.lit(2**rules.lift_bits)
    able = stash(near.join(everywhere, "term").where(F.col("with_any") * guess >= F.col("documents")))
    alike = ["p0", "p1", "documents"]
    first_terms = stash(able.groupBy(*alike).agg(F.min("term").alias("first_term")))
    by_text = words.join(first_terms, F.col("term") == F.col("first_term")).select(
        F.col("key").alias("word_key"), "first_term", "documents"
    )
    # no more documents hold both than name the entity
    meet = (F.col("key") == F.col("word_key")) & (F.col("named") * guess >= F.col("documents"))
    joint = (
        mentions.join(by_text, meet)
        .groupBy("entity", "named", "first_term", "documents")
        .agg(F.count("*").alias("texts"), F.sum("copies").alias("with_entity"))
        .where("texts > 1")
    )
    scaled = F.col("with_entity") * guess
    enough = (F.col("texts") >= rules.support) & (scaled >= F.col("documents"))
    shrunk = scaled * F.col("texts") >= F.col("documents") * (F.col("texts") + 2)
    telling = F.col("with_entity") * F.lit(float(everyone)) >= (
        F.col("documents").cast("double") * F.col("named") * lift
    )
    verdicts = (
        joint.where((enough | shrunk) & telling)
        .groupBy("first_term")
        .agg(F.max(F.col("with_entity") >= F.col("documents")).alias("alone"))
    )
    return first_terms.join(verdicts, "first_term").join(able, alike).select("term", "alone")


def disclosing_terms(docs: DataFrame, found: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """``key, removed, generalised``: the disclosing terms of each text that has any."""
    telltale = stash(telltale_terms(docs, found, rules))
    # equal texts give equal rows, so the set of a key holds each term once
    words = docs.select(
        F.md5("text").alias("key"),
        F.explode(F.array_distinct(_terms(F.col("text"), rules.shortest))).alias("term"),
    )
    return stash(
        words.join(telltale, "term")
        .groupBy("key")
        .agg(
            F.collect_set(F.when(F.col("alone"), F.col("term"))).alias("removed"),
            F.collect_set(F.when(~F.col("alone"), F.col("term"))).alias("generalised"),
        )
    )


_TERMS = "array<struct<start:bigint,stop:bigint,how:string>>"


def _term_spans(text: Column, removed: Column, generalised: Column) -> Column:
    """Spans of the given terms in a text whose entities are blanked out, by start."""
    pieces = F.arrays_zip(
        F.split(text, TERM, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("found"),
    )

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        stop = start + F.coalesce(F.length(piece["found"]), F.lit(0))
        term = F.lower(piece["found"])
        how = F.when(F.array_contains(removed, term), "removed").when(
            F.array_contains(generalised, term), "generalised"
        )
        span = F.struct(
            start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), how.alias("how")
        )
        more = F.when(how.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span)))
        return F.struct(stop.cast("bigint").alias("at"), more.alias("out"))

    none = F.expr(f"cast(array() as {_TERMS})")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    return F.aggregate(pieces, start, step, lambda state: state["out"])


def disclosing_spans(docs: DataFrame, found: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """``key, terms``: for each text with disclosing terms, their spans by start."""
    extra = disclosing_terms(docs, found, rules)
    texts = docs.select(F.md5("text").alias("key"), "text").join(extra, "key")
    once = texts.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("text", "removed", "generalised")]
    )
    blanked = _blanked(F.col("text"), base_spans(F.col("text")))
    spans = once.withColumn("text", blanked).select(
        "key", _term_spans(F.col("text"), F.col("removed"), F.col("generalised")).alias("terms")
    )
    return stash(spans)


def personal_spans(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: ``doc_id``, the count of each kind, ``n_term``,
    ``base_sha256`` of the written base spans and ``spans``, all written spans.

    A disclosing term is marked in all documents. A null text is an empty one, with
    no spans. Equal texts get equal spans and count once for ``support``; repeated
    rows and null ids are documents of their own. No documents give no rows. Other
    columns are not read.
    """
    found = find_entities(docs)
    extra = disclosing_spans(docs, found, rules)
    # a written table right under the join lets Spark split the rows of a hot text
    joined = found.select("doc_id", "key", "base").join(extra, "key", "left")
    both = joined.withColumn("terms", F.coalesce("terms", F.expr(f"cast(array() as {_TERMS})")))
    as_spans = F.transform(
        "terms",
        lambda s: F.struct(
            F.lit("term").alias("kind"),
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            F.lit(None).cast("string").alias("value"),
        ),
    )

    def number_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return both.select(
        "doc_id",
        *[number_of(kind) for kind in KINDS],
        F.size("terms").cast("bigint").alias("n_term"),
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.concat("base", as_spans)).alias("spans"),
    )


def sanitise_documents(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """The documents with entities replaced by their kind, disclosing terms by
    ``[TERM]`` or nothing, in all documents; the spans are those of ``personal_spans``.

    All columns stay, whatever their names; ``n_chars`` follows a new text. A text
    without entities and such terms, empty or null, is left as it is. Repeated rows and
    null ids stay rows of their own. No documents give no rows.
    """
    names = docs.columns
    found = find_entities(docs.select("doc_id", "text"))
    extra = disclosing_terms(docs.select("text"), found, rules)
    renamed = docs.toDF(*[f"__{i}" for i in range(len(names))])
    text = f"__{names.index('text')}"
    joined = (
        renamed.withColumn("key", F.md5(text))
        .join(extra, "key", "left")
        .withColumn("base", base_spans(F.col(text)))
    )

    # the text as pieces: what stands before each entity, and its label
    def step(state: Column, span: Column) -> Column:
        gap = F.substr(
            F.col(text),
            (state["at"] + 1).cast("int"),
            F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"),
        )
        label = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        piece = F.struct(gap.alias("gap"), label.alias("label"))
        return F.struct(
            F.greatest(state["at"], span["stop"]).alias("at"),
            F.when(span["stop"] > state["at"], F.concat(state["out"], F.array(piece)))
            .otherwise(state["out"])
            .alias("out"),
        )

    none = F.expr("cast(array() as array<struct<gap:string,label:string>>)")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    by_place = F.array_sort(
        F.transform("base", lambda s: F.struct(s["start"], s["stop"], s["kind"].alias("kind")))
    )

    def last(state: Column) -> Column:
        rest = F.substr(F.col(text), (state["at"] + 1).cast("int"))
        return F.concat(state["out"], F.array(F.struct(rest.alias("gap"), F.lit("").alias("label"))))

    def word(found: Column) -> Column:
        term = F.lower(found)
        return (
            F.when(F.array_contains("removed", term), "")
            .when(F.array_contains("generalised", term), "[TERM]")
            .otherwise(found)
        )

    def without_terms(gap: Column) -> Column:
        between = F.split(gap, TERM, -1)
        kept = F.transform(F.regexp_extract_all(gap, F.lit(TERM), F.lit(0)), word)
        both = F.zip_with(between, kept, lambda b, k: F.concat(b, F.coalesce(k, F.lit(""))))
        return F.when(F.col("removed").isNull(), gap).otherwise(F.array_join(both, ""))

    rebuilt = F.array_join(
        F.transform(
            F.aggregate(by_place, start, step, last),
            lambda p: F.concat(without_terms(p["gap"]), p["label"]),
        ),
        "",
    )
    plain = F.col(text).isNull() | ((F.size("base") == 0) & F.col("removed").isNull())
    changed = joined.withColumn("plain", plain).withColumn(
        text, F.when(F.col("plain"), F.col(text)).otherwise(rebuilt)
    )
    if "n_chars" in names:
        count = f"__{names.index('n_chars')}"
        changed = changed.withColumn(
            count, F.when(F.col("plain"), F.col(count)).otherwise(F.length(text).cast("bigint"))
        )
    return changed.select(*renamed.columns).toDF(*names)
