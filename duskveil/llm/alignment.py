"""Alignment of two tokenizers over a corpus, on Arrow arrays.

A block of documents is one flat array of token ids per tokenizer, with the
document of each token as its parent index. Running sums of token widths,
restarted in every document, give the byte at which each token ends. A hash
join of both sides on (document, end) finds the places where both end, and the
outer rows of the same join are all overlaps of two tokens. Each block counts
its id pairs; Spark adds the counts up over the corpus and hands every block
the sums of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duskveil.llm.blocks import BLOCK_CHARS, blocks
from duskveil.plans.joins import lookup_join
from duskveil.plans.scratch import stash

#: Texts encoded at once.
ENCODE_ROWS = 64
#: The space that the second tokenizer writes, and the form of its byte pieces.
#: Fixed values of the file format.
PIECE_SPACE = "▁"

_DOCUMENT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "groups string"
)
#: Rows of documents, with the place of each link's pair in the block, and rows of the block's pairs.
_WRITTEN = f"block bigint, {_DOCUMENT}, links array<int>, place int, a int, b int, times bigint"
_RESULT = f"{_DOCUMENT}, n_best bigint, count_sum bigint"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1
    characters stand for themselves, the others are numbered from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Side:
    """A tokenizer: ``encode`` gives the ids of texts, ``pieces`` the bytes of each id."""

    encode: object
    pieces: pa.Array

    @property
    def names(self) -> pa.Array:
        return pc.cast(pa.array(np.arange(len(self.pieces))), pa.string())


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> Side:
    """A byte-level vocabulary file. It encodes the text behind a space.

    Where merge number i makes token 256 + i, as in the usual files, ranks and ids
    are the same, and the faster rank encoder gives the ids of the file.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()
    vocabulary = model["vocab"]
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        if all(c in letters for c in piece):
            pieces[i] = bytes(letters[c] for c in piece)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ranked = all(vocabulary.get(piece) == 256 + i for i, piece in enumerate(merged))
    encode = _by_ranks(pieces[: 256 + len(merged)], pattern) if ranked else _by_file(path)
    return Side(encode, pa.array(pieces, pa.large_binary()))


def _by_ranks(pieces: list[bytes], pattern: str):
    import tiktoken

    ranks = {piece: i for i, piece in enumerate(pieces)}
    encoder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [encoder.encode_ordinary(" " + t) for t in texts]


def _by_file(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        return [e.ids for e in tokenizer.encode_batch(spaced, add_special_tokens=False)]

    return encode


@lru_cache(maxsize=2)
def piece_level(path: str) -> Side:
    """A piece vocabulary file with byte pieces. It adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            pieces.append(bytes([int(piece[1:-1], 16)]))
        else:
            pieces.append(piece.replace(PIECE_SPACE, " ").encode())

    def encode(texts: list[str]) -> list[list[int]]:
        return processor.encode(texts, out_type=int, num_threads=1)

    return Side(encode, pa.array(pieces, pa.large_binary()))


def id_lists(side: Side, texts: list[str | None]) -> pa.ListArray:
    """Ids of each text; a null or empty text has none."""
    offsets, values = [0], []
    for start in range(0, len(texts), ENCODE_ROWS):
        part = texts[start : start + ENCODE_ROWS]
        ids = iter(side.encode([t for t in part if t]))
        for text in part:
            own = np.array(next(ids) if text else [], dtype=np.int32)
            offsets.append(offsets[-1] + len(own))
            values.append(own)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat))


def spelt(side: Side, ids: pa.LargeListArray, texts: list[str | None]) -> np.ndarray:
    """Whether the bytes of a text's tokens are a space and the text."""
    joined = side.pieces.take(ids.flatten())
    bounds = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
    data = joined.buffers()[2]
    raw = memoryview(data).cast("B") if data is not None else memoryview(b"")
    cuts = bounds[ids.offsets.to_numpy()]
    return np.array(
        [bool(t) and raw[a:b] == b" " + t.encode() for t, a, b in zip(texts, cuts, cuts[1:])], bool
    )


def emptied(ids: pa.LargeListArray, kept: np.ndarray) -> pa.LargeListArray:
    """The lists of the documents that are kept, empty ones for the others."""
    sizes = np.where(kept, np.diff(ids.offsets.to_numpy()), 0)
    flat = ids.flatten().filter(pa.array(kept).take(pc.list_parent_indices(ids)))
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), flat)


def token_ends(side: Side, ids: pa.LargeListArray, name: str) -> pa.Table:
    """``doc``, ``end`` and the id of every token: the byte of its document at
    which it ends, a running sum of widths that restarts in each document."""
    flat, doc = ids.flatten(), pc.list_parent_indices(ids)
    widths = pc.binary_length(side.pieces).take(flat)
    running = pc.cumulative_sum(pc.cast(widths, pa.int64())).to_numpy()
    before = np.append(0, running)[ids.offsets.to_numpy()[:-1]]
    end = running - before[doc.to_numpy()]
    return pa.table({"doc": doc, "end": pa.array(end), name: flat})


def overlaps(left: pa.Table, right: pa.Table) -> pa.Table:
    """One row per overlap of a token of each side, in order: ``doc``, ``a``, ``b``
    and whether the overlap ends where both tokens end (``cut``).

    Both sides cover the same bytes, so every byte at which a token of either
    side ends closes exactly one overlap: that of the token which ends there
    and of the next one to end on the other side.
    """
    # one number for (document, end): documents are laid one behind the other
    last = left.group_by("doc").aggregate([("end", "max")])
    sizes = np.zeros(1 + (pc.max(left["doc"]).as_py() or 0), dtype=np.int64)
    sizes[last["doc"].to_numpy()] = last["end_max"].to_numpy()
    bases = pa.array(np.append(0, np.cumsum(sizes)[:-1]))

    def keyed(side: pa.Table, name: str) -> pa.Table:
        key = pc.add(bases.take(side["doc"]), side["end"])
        return pa.table({"key": key, "doc": side["doc"], name: side[name]})

    a, b = keyed(left, "a"), keyed(right, "b")
    joined = a.join(b.rename_columns(["key", "doc_b", "b"]), "key", join_type="full outer", use_threads=False)
    joined = joined.take(pc.sort_indices(joined["key"])).combine_chunks()
    return pa.table(
        {
            "doc": pc.coalesce(joined["doc"], joined["doc_b"]),
            "a": pc.fill_null_backward(joined["a"]),
            "b": pc.fill_null_backward(joined["b"]),
            "a_ends": pc.is_valid(joined["a"]),
            "b_ends": pc.is_valid(joined["b"]),
        }
    )


def group_texts(names: pa.Array, ids: pa.ChunkedArray, ends: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The ids of one side, comma-joined within each group."""
    tokens = np.cumsum(ends)  # tokens that end up to each overlap
    offsets = np.append(0, tokens[cut]).astype(np.int32)
    own = pc.filter(ids, pa.array(ends))
    flat = names.take(own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat), ",")


def align_block(
    first: Side, second: Side, texts: list[str | None]
) -> tuple[dict[str, np.ndarray], pa.Array, pa.LargeListArray, pa.Table]:
    """Numbers of each document, its groups as text, the places of its links'
    pairs, and the block's pairs ``place, a, b, times``."""
    ids_a, ids_b = id_lists(first, texts), id_lists(second, texts)
    kept = spelt(first, ids_a, texts) & spelt(second, ids_b, texts)
    ids_a, ids_b = emptied(ids_a, kept), emptied(ids_b, kept)
    table = overlaps(token_ends(first, ids_a, "a"), token_ends(second, ids_b, "b"))
    doc = table["doc"].to_numpy()
    a_ends, b_ends = table["a_ends"].to_numpy(), table["b_ends"].to_numpy()
    cut = a_ends & b_ends
    count = len(texts)
    numbers = {
        "n_a": np.diff(ids_a.offsets.to_numpy()),
        "n_b": np.diff(ids_b.offsets.to_numpy()),
        "n_groups": np.bincount(doc[cut], minlength=count),
        "n_links": np.bincount(doc, minlength=count),
    }
    each = pc.binary_join_element_wise(
        group_texts(first.names, table["a"], a_ends, cut),
        group_texts(second.names, table["b"], b_ends, cut),
        "|",
    )
    by_doc = np.append(0, np.cumsum(numbers["n_groups"])).astype(np.int32)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(by_doc), each), ";")

    codes = pc.add(
        pc.multiply(pc.cast(table["a"], pa.int64()), len(second.pieces)), pc.cast(table["b"], pa.int64())
    )
    coded = codes.combine_chunks().dictionary_encode()
    places = coded.indices
    counted = pa.table({"place": places}).group_by("place", use_threads=False).aggregate([([], "count_all")])
    pairs = coded.dictionary.take(counted["place"].combine_chunks()).to_numpy()
    pair_table = pa.table(
        {
            "place": counted["place"],
            "a": pa.array((pairs // len(second.pieces)).astype(np.int32)),
            "b": pa.array((pairs % len(second.pieces)).astype(np.int32)),
            "times": counted["count_all"],
        }
    )
    links = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(numbers["n_links"]))), places)
    return numbers, groups, links, pair_table


def _columns(schema: pa.Schema, rows: int, known: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = known.get(field.name)
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        arrays.append(pa.nulls(rows, field.type) if values is None else pc.cast(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def aligned_blocks(
    docs: DataFrame,
    first: str,
    second: str,
    pattern: str,
    with_groups: bool = False,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The written table of documents and of the pairs of each block."""
    struct = StructType.fromDDL(_WRITTEN)
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_level(first, pattern), piece_level(second)
        for block, (doc_ids, texts) in blocks(batches, block_chars):
            numbers, groups, links, pairs = align_block(*sides, texts)
            digests = [
                hashlib.sha256(groups[i].as_buffer()).hexdigest() if n else ""
                for i, n in enumerate(numbers["n_a"])
            ]
            known = {k: pa.array(v) for k, v in numbers.items()} | {
                "block": pa.array([block] * len(texts), pa.int64()),
                "doc_id": pa.array(doc_ids, pa.int64()),
                "groups_sha256": pa.array(digests, pa.string()),
                "links": links,
            }
            if with_groups:
                known["groups"] = groups
            whole = _columns(schema, len(texts), known)
            for start in range(0, len(texts), 1024):
                yield whole.slice(start, 1024)
            mine = pa.array([block] * pairs.num_rows, pa.int64())
            yield _columns(schema, pairs.num_rows, {"block": mine} | {c: pairs[c] for c in pairs.column_names})
            del groups, links, pairs, known, whole
            pa.default_memory_pool().release_unused()

    return stash(docs.select("doc_id", "text").mapInArrow(run, struct))


def _pairs(written: DataFrame) -> DataFrame:
    return written.where("place IS NOT NULL").select("block", "place", "a", "b", "times")


def _corpus_counts(written: DataFrame) -> DataFrame:
    """``a, b, n, best, blocks``: links of each id pair in the corpus, whether no other
    ``a`` has more links with the ``b``, and the blocks that hold the pair.

    The highest counts have a row per id of the second vocabulary, which bounds
    what is broadcast.
    """
    counts = stash(
        _pairs(written).groupBy("a", "b").agg(F.sum("times").alias("n"), F.count("*").alias("blocks"))
    )
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), "b").select(
        "a", "b", "n", (F.col("n") == F.col("most")).alias("best"), "blocks"
    )


def pair_counts(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """``a, b, n, best``: how many links of the corpus hold each id pair, and
    whether that is the highest count of ``b``. No documents give no rows."""
    return _corpus_counts(aligned_blocks(docs, first, second, pattern)).drop("blocks")


def align(
    docs: DataFrame,
    first: str,
    second: str,
    pattern: str,
    with_groups: bool = False,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Align the tokens of a byte-level vocabulary file ``first`` (of a space and
    the text, cut by ``pattern``) with those of a piece vocabulary file ``second``.

    One row per row of ``docs``: ``doc_id``; ``n_a`` and ``n_b`` tokens;
    ``n_groups`` between bytes at which both sides end a token; ``n_links``,
    token pairs whose bytes overlap; ``n_best`` links whose id pair is the most
    frequent of its second id in the corpus; ``count_sum`` of the links' corpus
    counts; ``groups_sha256`` of the groups, and with ``with_groups`` the
    ``groups`` as text ``a,a|b;a|b,b``.

    A text that is null, empty, or that either side doesn't spell byte by byte has
    no tokens: zeros and an empty digest. Repeated rows and null ids are documents
    of their own, of equal counts both are the highest, no documents give no
    rows, and columns other than ``doc_id`` and ``text`` are not read.

    Documents stay in their block. Only the places of links move, to meet the
    sums of the block's pairs.
    """
    written = aligned_blocks(docs, first, second, pattern, with_groups, block_chars)
    sums = lookup_join(
        _pairs(written).select("block", "place", "a", "b"),
        _corpus_counts(written), ["a", "b"], "blocks", ["block"],
    ).select(F.col("block").alias("home"), "place", "n", "best")
    struct = StructType.fromDDL(_RESULT)
    schema = to_arrow_schema(struct)

    def gathered(own: pa.Table, counted: pa.Table) -> pa.Table:
        links = own["links"].combine_chunks()
        order = np.argsort(counted["place"].to_numpy())
        places = links.flatten().to_numpy()
        bounds = links.offsets.to_numpy()

        def summed(values: np.ndarray) -> pa.Array:
            running = np.append(0, np.cumsum(values[order][places] if len(places) else []))
            return pa.array((running[bounds[1:]] - running[bounds[:-1]]).astype(np.int64))

        known = {c: own[c] for c in own.column_names} | {
            "n_best": summed(counted["best"].to_numpy().astype(np.int64)),
            "count_sum": summed(counted["n"].to_numpy()),
        }
        return pa.Table.from_batches([_columns(schema, own.num_rows, known)])

    documents = written.where("place IS NULL").drop("place", "a", "b", "times")
    found = documents.groupBy("block").cogroup(sums.groupBy("home")).applyInArrow(gathered, struct)
    return found if with_groups else found.drop("groups")
