"""Line-first cleaning: rules judge every line, failing lines go, and a document
that loses too much of its text is rejected."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from duskveil.llm.batches import WORD, map_columns

#: Words that part the entries of a menu.
SEPARATORS = ["|", ">", "»", "›", "•", "·", "/", "-", "–", "::"]

#: Phrases of site furniture (lower case), looked for in short lines.
BOILERPLATE = (
    r"cookie policy|accept cookies|use cookies|enable javascript|javascript is disabled|"
    r"privacy policy|terms of use|terms of service|all rights reserved|subscribe to our|"
    r"sign up for|click here|read more|share this|follow us on|log in to|back to top|lorem ipsum"
)

#: The end of a sentence at the end of a word.
SENTENCE_END = r"[.!?…。！？:;][\"'”’»)\]]*$"

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
_word = re.compile(WORD)
_sentence_end = re.compile(SENTENCE_END)
_boilerplate = re.compile(BOILERPLATE)

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, "
    "n_failed_lines bigint, lost_chars bigint"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds, all in whole numbers so that SQL can repeat them exactly."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 20
    max_separator_percent: int = 20
    max_stutter_percent: int = 30
    caps_words: int = 5
    boilerplate_words: int = 30
    max_lost_percent: int = 50


def line_fails(line: str, words: list[str], rules: LineRules) -> bool:
    """The rules of one line, apart from "equal to an earlier line"."""
    n = len(words)
    if 100 * sum(line.count(c) for c in _SYMBOLS) > rules.max_symbol_percent * n:
        return True
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and 100 * separators > rules.max_separator_percent * n:
        return True
    if not any(map(_sentence_end.search, reversed(words))):
        return True
    if n >= rules.caps_words and line == line.upper() and line != line.lower():
        return True
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    if 100 * stutter > rules.max_stutter_percent * n:
        return True
    return n <= rules.boilerplate_words and bool(_boilerplate.search(line.lower()))


def repeat_words(words: list[str]) -> int:
    """Words in windows of three that stand in the text more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def judge(text: str | None, rules: LineRules) -> tuple[tuple, str]:
    """The measures of a text after ``doc_id`` in ``SCHEMA``, and the cleaned text."""
    text = text or ""
    words: list[str] = []
    seen: set[str] = set()
    keep: list[str] = []
    lines = failed = duplicates = lost = 0
    for line in text.split("\n"):
        own = _word.findall(line)
        if not own:
            keep.append(line)
            continue
        lines += 1
        words += own
        repeated = line in seen
        seen.add(line)
        duplicates += repeated
        if repeated or line_fails(line, own, rules):
            failed += 1
            lost += sum(map(len, own))
        else:
            keep.append(line)
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    repeats = repeat_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not base_failed and 100 * lost <= rules.max_lost_percent * chars
    symbols = sum(map(text.count, _SYMBOLS))
    measures = (n, chars, symbols, duplicates, repeats, base_failed, kept, lines, failed, lost)
    return measures, text if failed == 0 else "\n".join(keep)


def judge_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document with its measures and ``kept``.

    A null or empty text has no words, so it fails and is not kept. Repeated
    rows are judged alike, each on its own; a null ``doc_id`` stays null. Other
    columns of ``docs`` are not read. No shuffle: a task holds one text at a time.
    """

    def make():
        def run(ids, texts):
            rows = [(i, *judge(t, rules)[0]) for i, t in zip(ids, texts)]
            return list(zip(*rows))

        return run

    return map_columns(docs.select("doc_id", "text"), make, SCHEMA)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with their failing lines taken out.

    All columns of ``docs`` stay, under their names and in their order;
    ``n_chars``, if there is one, follows the new text.
    """
    columns = docs.columns
    text_at = columns.index("text")
    count_at = columns.index("n_chars") if "n_chars" in columns else None

    def make():
        def run(*values):
            values = [list(v) for v in values]
            keep = []
            for i, text in enumerate(values[text_at]):
                measures, cleaned = judge(text, rules)
                if not measures[6]:
                    continue
                keep.append(i)
                values[text_at][i] = cleaned
                if count_at is not None:
                    values[count_at][i] = len(cleaned)
            return [[v[i] for i in keep] for v in values]

        return run

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return map_columns(docs, make, schema)
