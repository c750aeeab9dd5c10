import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from helpers import AWKWARD, clashing, documents, rows
from oracle import differences

from duskveil.llm import disclosure as D
from duskveil.llm.sql import personal_sql

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def brute_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span(), m[0]))
    return found


def digits_of(value):
    return re.sub("[^0-9]", "", value)


def named(kind, value):
    """The entity of a mention and the group it belongs to."""
    if kind == "email":
        return {(kind, value.lower()), ("group", kind, value.lower().split("@")[1])}
    if kind == "ip":
        return {(kind, value), ("group", kind, tuple(value.split(".")[:3]))}
    digits = digits_of(value)
    return {(kind, digits), ("group", kind, digits[:6] if kind == "card" else digits[:-4])}


def brute_words(text, own):
    blank = text or ""
    for _, a, b, _ in own:
        blank = blank[:a] + " " * (b - a) + blank[b:]
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", blank)]


def brute_telltale(texts, rules=D.Disclosure()):
    """Disclosing terms, the whole rule over all pairs: term to whether it is alone."""
    base = [brute_spans(t) for t in texts]
    who = [set().union(*[named(k, v) for k, _, _, v in own]) for own in base]
    docs_with = Counter(w for t in texts for w in set(re.findall(r"[^\W_]+", (t or "").lower())))
    docs_naming = Counter(e for entities in who for e in entities)
    where, together = defaultdict(set), Counter()
    for text, own, entities in zip(texts, base, who):
        for term in {w for _, _, w in brute_words(text, own) if len(w) >= rules.shortest}:
            for e in entities:
                where[e, term].add(text)
                together[e, term] += 1
    telltale = {}
    for (e, term), found in where.items():
        n, both = len(found), together[e, term]
        share = Fraction(both, docs_with[term]) * (1 if n >= rules.support else Fraction(n, n + 2))
        lift = Fraction(both, docs_with[term]) / Fraction(docs_naming[e], len(texts))
        if n > 1 and share * 2**rules.slack_bits >= 1 and lift >= 2**rules.lift_bits:
            telltale[term] = telltale.get(term, False) or both >= docs_with[term]
    return telltale


def brute(texts, rules=D.Disclosure()):
    """Spans of every text, the whole method."""
    telltale = brute_telltale(texts, rules)
    out = []
    for text in texts:
        own = brute_spans(text)
        terms = [f"term:{a}:{b}" for a, b, w in brute_words(text, own) if w in telltale]
        out.append(([f"{k}:{a}:{b}" for k, a, b, _ in own], terms))
    return out


def sql_differences(spark, texts):
    docs = documents(spark, texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    return differences(D.personal_spans(docs).drop("n_term"), con, personal_sql())


ODD = [
    "a@b.c_d@e.f x@y x@y.z. a.b+c%d@E-f.g.h@i.j", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111 4111111111111111", "41111111111111110000000 4111  1111 1111 1111", "+1 (736) 555-2678, +49.30.1234567 +1 2 +12345678901234567 + 1",
    "+1 555 1234567 +1 555 7654321", "é ü +1 (555) 555-1234 日本 x@y.zz \U0001f600 9.9.9.9", "1 " * 9000, "7" * 30_000, "a" * 30_000 + "@", "a@b" + ".c" * 9000,
]


def test_base_spans(spark):
    texts = [*AWKWARD, *ODD]
    random.seed(6)
    texts += ["".join(random.choice("0123456789 -.+()@ab") for _ in range(60)) for _ in range(300)]
    found = D.find_entities(documents(spark, texts)).collect()
    for r in found:
        got = [(s["kind"], s["start"], s["stop"], s["value"]) for s in r["base"]]
        assert got == brute_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:80]


@pytest.fixture
def corpus():
    random.seed(8)
    filler = ["filler%d" % i for i in range(60)]
    texts = []
    for i in range(12):
        around = " ".join(random.choices(filler, k=40))
        texts.append(f"{around} Zanzibarian contact bob@corp.example or 10.0.0.9 nickname Rumpel, {around}")
    for i in range(50):
        texts.append(" ".join(random.choices(filler, k=50)) + (" contact" if i % 2 else ""))
    texts += ["carol@corp.example meets Oncely", "carol@corp.example meets Oncely", texts[0], None, "", "+1 555 123 4567"]
    return texts


def test_whole_method(spark, corpus, partitions):
    want = brute(corpus)
    assert any(terms for _, terms in want)
    docs = documents(spark, corpus)
    for n in (1, 5):
        partitions(n)
        for r in D.personal_spans(clashing(docs)).collect():
            base, terms = want[r["doc_id"]]
            assert r["spans"] == ",".join([*base, *terms])
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in base) for k in PLAIN]
    assert D.personal_spans(docs.limit(0)).count() == 0
    assert sql_differences(spark, corpus) == []


def test_sanitised_texts(spark, corpus):
    docs = clashing(documents(spark, corpus))
    out = D.sanitise_documents(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert len(texts) == len(corpus)
    assert "bob@" not in texts[0][0] and "[EMAIL]" in texts[0][0] and "[IP]" in texts[0][0]
    assert "zanzibarian" not in texts[0][0].lower() and "rumpel" not in texts[0][0].lower()
    assert texts[0][1] == len(texts[0][0]) and texts[20][0] == corpus[20]
    none = corpus.index(None)
    assert texts[none] == (None, None) and texts[none + 1][0] == ""
    # a pair of texts is too little to tell
    assert texts[62][0] == "[EMAIL] meets Oncely"
    assert not any(brute_spans(t) for t, _ in texts.values())


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD, ids=[None] * 4 + list(range(5)))
    assert D.personal_spans(docs).count() == len(AWKWARD) == D.sanitise_documents(docs).count()
    assert all(r[-1] == "" for r in rows(D.personal_spans(docs)))


def test_sanitised_by_whole_texts_everywhere(spark):
    far = " ".join(f"word{i}" for i in range(200))
    texts = [f"Farawayname {far} own{i} x{i}x@y.example" for i in range(3)]  # more than 30 terms apart
    texts += [f"pair@z{i}.example, pair@rare.example Rarename own{i}own" for i in range(2)]  # two texts
    texts += [f"user{i}@group.example about Groupname mine{i}" for i in range(4)]  # one domain, four values
    texts += ["Groupname and nothing else", "Farawayname was here", *[f"{far} plain{i}" for i in range(9)]]
    out = {r["doc_id"]: r for r in D.sanitise_documents(documents(spark, texts)).collect()}
    said = [out[i]["text"].lower() for i in range(len(texts))]
    assert not any("farawayname" in s or "rarename" in s or "groupname" in s for s in said)
    assert said[9] == "[term] and nothing else" and said[11] == texts[11] and out[9]["n_chars"] == len(said[9])
    assert "own0own" in said[3] and "mine2" in said[7] and "word7" in said[0]
    telling = [terms for _, terms in brute(texts)]
    for r in D.personal_spans(documents(spark, texts)).collect():
        assert [x for x in r["spans"].split(",") if x.startswith("term")] == telling[r["doc_id"]]
    assert sql_differences(spark, texts) == []


def test_names_are_marked_and_common_words_stay(spark):
    # one address in some texts with a name; one sentence around all addresses of a domain
    texts = [f"please contact our office today at user{i}@firm.example" for i in range(40)]
    texts += [f"Ask Rumpelstilz {i} please, at rump@firm.example" for i in range(6)]
    texts += [f"please come to the office today number {i}" for i in range(30)]
    found = D.find_entities(documents(spark, texts))
    got = {r["term"]: r["alone"] for r in D.telltale_terms(documents(spark, texts), found).collect()}
    assert got == brute_telltale(texts)
    assert "rumpelstilz" in got and not {"please", "contact", "office", "today"} & set(got)
    # nothing else in the corpus: whom all texts name is no secret
    own = texts[:40]
    assert D.telltale_terms(documents(spark, own), D.find_entities(documents(spark, own))).count() == 0
    out = {r["doc_id"]: r["text"] for r in D.sanitise_documents(documents(spark, own)).collect()}
    assert out[0] == "please contact our office today at [EMAIL]"
    assert sql_differences(spark, texts) == []


def test_directories_do_not_pair_addresses_with_words(spark):
    page = " ".join(f"person{i}@mail{i}.example surname{i}" for i in range(3000))
    texts = [page, page + " second print", page + " third print", *[f"plain text {i}" for i in range(40)]]
    docs = documents(spark, texts)
    found = D.find_entities(docs)
    assert {r["term"] for r in D.telltale_terms(docs, found).collect()} >= {"surname0", "surname2999"}
    assert D.personal_spans(docs).where("n_term >= 3000").count() == 3


def test_random_corpora(spark):
    rng = random.Random(31)
    for _ in range(3):
        names = [f"p{i}@h{i % 3}.example" for i in range(5)] + ["10.0.0.7", "10.0.0.8", "+1 555 123 4567"]
        words = [f"word{i}" for i in range(25)]
        texts = [
            " ".join(rng.sample(words, rng.randint(1, 6)) + rng.sample(names, rng.choice([0, 0, 0, 1, 2])))
            for _ in range(60)
        ]
        texts += rng.choices(texts, k=15) + [None, ""]
        docs = documents(spark, texts)
        got = {r["term"]: r["alone"] for r in D.telltale_terms(docs, D.find_entities(docs)).collect()}
        assert got == brute_telltale(texts)
