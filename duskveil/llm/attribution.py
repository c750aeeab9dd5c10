"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The characters that each token spans
are then joined with the intervals of its sections, and a token that reaches
over a boundary goes to the section that holds its first byte.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame

from duskveil.llm.batches import map_columns

SCHEMA = (
    "doc_id bigint, section int, field string, start bigint, stop bigint, n_tokens bigint, "
    "n_crossing bigint, doc_tokens bigint"
)
#: Between the fields of a document.
JOINT = "\n"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file and the bytes of each token, once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def sections_of(values: list[str | None], names: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """The document that the fields make up, and its sections as half-open
    intervals of characters: one per line, a line keeping its newline. They
    cover the document without gaps; a null or empty field has no section."""
    parts, sections, at = [], [], 0
    for name, value in zip(names, values):
        if not value:
            continue
        if parts:
            parts.append(JOINT)
            sections[-1] = (*sections[-1][:2], at + len(JOINT))
            at += len(JOINT)
        parts.append(value)
        for line in value.split("\n"):
            sections.append((name, at, at + len(line) + 1))
            at += len(line) + 1
        at -= 1  # the last line of a field has no newline of its own
        sections[-1] = (*sections[-1][:2], at)
    # a field that ends in a newline leaves an empty last line, which is no section
    return "".join(parts), [s for s in sections if s[1] < s[2]]


def attribute(text: str, bounds: np.ndarray, encoder: tiktoken.Encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and crossing tokens of each section, and the tokens of the text.

    ``bounds`` are the starts of the sections in characters and the end of the last.
    """
    ids = np.array(encoder.encode_ordinary(text), dtype=np.int64)
    stops = np.cumsum(sizes[ids])  # in bytes
    starts = stops - sizes[ids]
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    # byte at which each character begins, so that bounds can be found in bytes
    begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    in_bytes = begins[bounds]
    home = np.searchsorted(in_bytes, starts, side="right") - 1
    crossing = stops > in_bytes[home + 1]
    count = len(bounds) - 1
    return (
        np.bincount(home, minlength=count),
        np.bincount(home[crossing], minlength=count),
        len(ids),
    )


def section_tokens(docs: DataFrame, path: str, pattern: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per section of every document: the ``field`` it lies in, its
    characters ``start`` to ``stop`` of the whole document, ``n_tokens`` that
    begin in it, ``n_crossing`` of them that end beyond it, and ``doc_tokens``
    of the whole document. The sections' tokens add up to the document's.

    A document without text has one row with section 0, no field and zeros.
    Repeated rows and null ids are documents of their own; no documents give no
    rows; columns other than ``doc_id`` and ``fields`` are not read. No shuffle.
    """

    def make():
        encoder, sizes = encoding(path, pattern)

        def run(ids, *columns):
            rows = []
            for doc, values in zip(ids, zip(*columns)):
                text, sections = sections_of(list(values), list(fields))
                if not sections:
                    rows.append((doc, 0, None, 0, 0, 0, 0, 0))
                    continue
                bounds = np.array([s[1] for s in sections] + [sections[-1][2]])
                own, crossing, total = attribute(text, bounds, encoder, sizes)
                rows += [
                    (doc, i, name, start, stop, int(own[i]), int(crossing[i]), total)
                    for i, (name, start, stop) in enumerate(sections)
                ]
            return list(zip(*rows))

        return run

    return map_columns(docs.select("doc_id", *fields), make, SCHEMA)
