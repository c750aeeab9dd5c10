import hashlib
from collections import Counter

import public_tokenizers
import pytest
from helpers import AWKWARD, SMALL, clashing, documents
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from duskveil.llm import alignment as A

FIRST = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
SECOND = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    *AWKWARD, "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "Grüße, 東京! 😀😀", "  two  spaces\t\n", "the cat",
    "the cat", "naïve café " * 30,
]


@pytest.fixture(scope="module")
def sides():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=SECOND)


def plain(sides, texts):
    """Tokens one by one, every pair of a document compared."""
    first, second = sides
    letters = A.byte_letters()
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        whole = b" " + text.encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        raw_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        raw_b = [
            bytes([int(second.id_to_piece(i)[1:-1], 16)]) if second.is_byte(i)
            else second.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append(None)
            continue

        def spans(raw):
            at = 0
            for piece in raw:
                yield at, at + len(piece)
                at += len(piece)

        spans_a, spans_b = list(spans(raw_a)), list(spans(raw_b))
        links = [
            (x, y)
            for x, (s, e) in zip(a, spans_a)
            for y, (u, v) in zip(b, spans_b)
            if s < v and u < e
        ] if len(a) < 3000 else None
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, i, j = [], 0, 0
        for cut in cuts:
            mine, other = [], []
            while i < len(a) and spans_a[i][1] <= cut:
                mine.append(str(a[i]))
                i += 1
            while j < len(b) and spans_b[j][1] <= cut:
                other.append(str(b[j]))
                j += 1
            groups.append(",".join(mine) + "|" + ",".join(other))
        if links is None:  # a very long text: walk both sides
            links, i, j = [], 0, 0
            while i < len(a):
                links.append((a[i], b[j]))
                e, v = spans_a[i][1], spans_b[j][1]
                i, j = i + (e <= v), j + (v <= e)
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(link for d in docs if d for link in d[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        best = sum(counts[x] == most[x[1]] for x in d[3])
        total = sum(counts[x] for x in d[3])
        digest = hashlib.sha256(d[4].encode()).hexdigest()
        out.append((d[0], d[1], d[2], len(d[3]), best, total, digest, d[4]))
    return out, counts, most


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("block_chars", [1, 200, 1 << 22])
def test_against_pairs_one_by_one(spark, sides, block_chars):
    docs = clashing(documents(spark, TEXTS, ids=[*range(len(TEXTS) - 1), None])).repartition(3)
    want, _, _ = plain(sides, TEXTS)
    found = A.align(docs, FIRST, SECOND, PATTERN, True, block_chars).select("doc_id", *COLUMNS).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {
        **dict(enumerate(want[:-1])), None: want[-1],
    }
    # a text that the second side can't spell has no tokens
    assert want[TEXTS.index("a▁b")][0] == 0 < want[TEXTS.index("the cat")][0]


def test_pair_counts_and_empty_tables(spark, sides):
    docs = documents(spark, TEXTS)
    _, counts, most = plain(sides, TEXTS)
    found = A.pair_counts(docs, FIRST, SECOND, PATTERN).collect()
    assert {(r.a, r.b): (r.n, r.best) for r in found} == {
        (a, b): (n, n == most[b]) for (a, b), n in counts.items()
    }
    assert A.align(docs.limit(0), FIRST, SECOND, PATTERN).count() == 0
    assert A.align(documents(spark, [None, ""]), FIRST, SECOND, PATTERN).select("n_links").collect() == [(0,), (0,)]


def test_both_encoders_of_the_byte_level_file_agree():
    side, slow = A.byte_level(FIRST, PATTERN), A._by_file(FIRST)
    texts = [t for t in TEXTS if t]
    assert side.encode(texts) == slow(texts)
    assert side.encode.__name__ == "<lambda>"  # the ranks of the file are its ids


def test_a_whole_table(spark, sides):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want, _, _ = plain(sides, [r.text for r in rows])
    found = {r[0]: tuple(r)[1:] for r in A.align(docs, FIRST, SECOND, PATTERN).select("doc_id", *COLUMNS[:-1]).collect()}
    assert found == {r.doc_id: w[:-1] for r, w in zip(rows, want)}
