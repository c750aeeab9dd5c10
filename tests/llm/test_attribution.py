import bisect

import public_tokenizers
import pytest
from helpers import AWKWARD, clashing, documents
from tokenizers import Tokenizer

from duskveil.llm import attribution as A

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["one line\nand another\n\n\nlast", "\n\n", "a", "é日本\nü \n x", "The end.\n", None, ""]


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@pytest.mark.parametrize("text", [t for t in [*TEXTS, *AWKWARD] if t])
def test_sections_against_offsets(text, tokenizer):
    encoder, sizes = A.encoding(RANKS, public_tokenizers.PATTERN)
    _, sections = A.sections_of([text], ["text"])
    assert sections[0][1] == 0 and sections[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(sections, sections[1:]))
    starts = [s[1] for s in sections]
    import numpy as np

    own, crossing, total = A.attribute(text, np.array([*starts, len(text)]), encoder, sizes)
    spans = tokenizer.encode(text, add_special_tokens=False).offsets
    want, over = [0] * len(sections), [0] * len(sections)
    for a, b in spans:
        at = bisect.bisect_right(starts, a) - 1
        want[at] += 1
        over[at] += b > sections[at][2]
    assert list(own) == want and total == len(spans)
    if text.isascii():
        assert list(crossing) == over


def test_fields_and_rows(spark):
    docs = documents(spark, TEXTS, ["s"] * 6 + [None])
    out = A.section_tokens(clashing(docs), RANKS, public_tokenizers.PATTERN, ("source", "text"))
    by_doc = {}
    for r in out.collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc) == len(TEXTS)
    for own in by_doc.values():
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"]
    assert [r["field"] for r in by_doc[2]] == ["source", "text"]
    assert [(r["field"], r["n_tokens"]) for r in by_doc[6]] == [(None, 0)]
    assert A.section_tokens(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
