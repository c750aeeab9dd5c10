import re

import pytest
from helpers import AWKWARD, clashing, documents, rows

from duskveil.llm.quality import LineRules, clean_documents, judge, judge_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The{0} quick{0} brown fox number {0} jumps{0} over{0} lazy{0} dogs{0} tonight{0}."


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


@pytest.mark.parametrize(
    "text", [None, "", "a b a b a b a", "x\nx\n\ny | z & q\nx", "a b c d a b c", "é  ü\x1c k\x0bz"]
)
def test_base_measures(text):
    assert judge(text, LineRules())[0][:5] == brute_base(text)


def test_line_rules():
    prose = "\n".join(PROSE.format(i) for i in range(10))
    bad = {
        "menu": "Home | News | About | Contact",
        "no sentence": "just a heading without an end",
        "shouting": "BUY THIS THING NOW PLEASE.",
        "symbols": "a*** b$$$ c%%% d&&& e.",
        "stutter": "ha ha ha ha ha ha.",
        "furniture": "Click here to read more.",
        "repeated": PROSE.format(3),
    }
    for line in bad.values():
        measures, cleaned = judge(prose + "\n" + line, LineRules())
        assert measures[8] == 1 and measures[6], line
        assert cleaned == prose
    many = "\n".join("Home | News | About | Contact us | %d |" % i for i in range(60))
    assert not judge(prose + "\n" + many, LineRules())[0][6]


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD, ids=[None, None, 2, 3, 3, 5, 6, 7, 8])
    found = rows(judge_documents(clashing(docs)))
    assert found == rows(judge_documents(docs)) and len(found) == len(AWKWARD)
    assert all(not r[7] for r in found if r[1] == 0)
    assert judge_documents(docs.limit(0)).count() == 0


def test_cleaning_keeps_columns(spark):
    prose = "\n".join(PROSE.format(i) for i in range(10))
    docs = clashing(documents(spark, [prose + "\nHome | News | Us", "short", None]))
    cleaned = clean_documents(docs)
    assert cleaned.columns == docs.columns
    (row,) = cleaned.collect()
    assert row["text"] == prose and row["n_chars"] == len(prose)
