"""Byte-level BPE by merge replay over a block of the corpus.

The distinct words of a block are laid out in one array of symbols. An inverted
index gives, for each rank, the places where a pair of that rank begins; the
replay takes the lowest rank, merges it at all its places and touches only the
neighbours of those places. Words do not act on each other, so replaying block
by block gives what one replay over the whole corpus would, and a word is
replayed once per block however often it occurs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from duskveil.llm.batches import map_columns

#: Rows of one replay.
BLOCK_ROWS = 1024
#: Words whose ids a task remembers between blocks; beyond that it forgets those
#: that the last so many did not need.
REMEMBERED = 200_000
#: Symbols of one replay, about; a word beyond that is a replay of its own.
REPLAY_SYMBOLS = 4_000_000

_NONE = np.int32(2**31 - 1)

#: Of this pattern ``PLAIN_PATTERN`` is a faster equal on texts of plain characters:
#: ASCII and the Latin letters up to U+024F, where classes can be written out.
LETTERS_FIRST_OF = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_PATTERN = (
    rf" ?[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r {_LATIN}0-9]+| ?[0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_not_plain = re.compile(rf"[^\t-\r -~{_LATIN}]")


class Merges:
    """The ranks of a vocabulary file: lines of a base64 token and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pair = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(self.pair), dtype=np.int64)
        self.pair_ranks = np.array([self.pair[k] for k in self.pair_keys.tolist()], dtype=np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``_NONE`` if it is no token."""
        if not len(self.pair_keys):
            return np.full(len(left), _NONE, dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (no word is empty), four bytes each."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        if not len(sizes):
            return []
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        symbols = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        total = len(symbols)
        after = np.arange(1, total + 1)
        before = np.arange(-1, total - 1)
        after[starts + sizes - 1] = -1
        before[starts] = -1
        alive = np.ones(total, dtype=bool)
        mark = np.zeros(total + 1, dtype=bool)  # scratch; the last entry stands for -1
        rank = np.full(total, _NONE, dtype=np.int32)  # of the pair that begins here
        inside = np.flatnonzero(after >= 0)
        rank[inside] = self.ranks_of(symbols[inside], symbols[inside + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        alone: set[int] = set()  # words in which a merge brought forth a lower rank

        def note(places: np.ndarray) -> None:
            ranks = rank[places]
            known = ranks != _NONE
            places, ranks = places[known], ranks[known]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        note(inside)
        while heap:
            now = heapq.heappop(heap)
            parts = index.pop(now)
            places = np.concatenate(parts) if len(parts) > 1 else parts[0]
            places = _apart(_sorted_set(places[rank[places] == now]), after, mark)
            if not len(places):
                continue
            gone = after[places]
            beyond = after[gone]
            symbols[places] = now
            alive[gone] = False
            rank[gone] = _NONE
            after[places] = beyond
            follows = beyond >= 0
            before[beyond[follows]] = places[follows]
            ahead = before[places]
            changed = _sorted_set(np.concatenate([places, ahead[ahead >= 0]]))
            paired = after[changed] >= 0
            rank[changed] = _NONE
            changed = changed[paired]
            rank[changed] = self.ranks_of(symbols[changed], symbols[after[changed]])
            early = changed[rank[changed] < now]
            if len(early):
                alone.update((np.searchsorted(starts, early, side="right") - 1).tolist())
            note(changed)
        ids = symbols[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64))).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        for word in alone:
            out[word] = np.array(self.merge_one(words[word]), dtype="<u4").tobytes()
        return out

    def merge_one(self, word: bytes) -> list[int]:
        """One word by itself: always the leftmost pair of the lowest rank, by a heap."""
        symbols: list[int | None] = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                rank = self.pair.get(symbols[i] << 32 | symbols[after[i]])
                if rank is not None:
                    heap.append((rank, i, symbols[i], symbols[after[i]], after[i]))

        for i in range(n):
            push(i)
        heapq.heapify(heap)
        while heap:
            rank, i, left, right, j = heapq.heappop(heap)
            if symbols[i] != left or after[i] != j or symbols[j] != right:
                continue
            symbols[i], symbols[j] = rank, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            fresh, heap[:] = list(heap), []
            push(before[i])
            push(i)
            added, heap[:] = list(heap), fresh
            for entry in added:
                heapq.heappush(heap, entry)
        return [s for s in symbols if s is not None]


def _sorted_set(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    if len(places) < 2:
        return places
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def _apart(places: np.ndarray, after: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Leave out places that begin where a merge further left ends ("aaa")."""
    mark[places] = True
    clash = mark[after[places]].any()
    mark[places] = False
    if not clash:
        return places
    taken, kept = set(), []
    for place, end in zip(places.tolist(), after[places].tolist()):
        if place not in taken:
            kept.append(place)
            taken.add(end)
    return np.array(kept, dtype=places.dtype)


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    """The merges of a file, once per Python worker."""
    return Merges(path)


class Encoder:
    """Texts to ids and back; ``pattern`` cuts a text into words.

    The words of one block are replayed together; a worker keeps what it has
    learnt for the blocks and tasks to come.
    """

    def __init__(self, path: str, pattern: str):
        self.merges = load(path)
        self.pattern = regex.compile(pattern)
        self.plain = re.compile(PLAIN_PATTERN) if pattern == LETTERS_FIRST_OF else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if self.plain and not _not_plain.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def _learn(self, words: list[str]) -> None:
        """Replay words that no block before has had."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, rank = self.known, self.older, self.merges.rank
        fresh, raws = [], []
        for word in words:
            if word in older:
                known[word] = older[word]
                continue
            raw = word.encode()
            whole = rank.get(raw)
            if whole is None:
                fresh.append(word)
                raws.append(raw)
            else:
                known[word] = whole.to_bytes(4, "little")
        at = 0
        while at < len(raws):
            size, end = 0, at
            while end < len(raws) and (end == at or size + len(raws[end]) <= REPLAY_SYMBOLS):
                size += len(raws[end])
                end += 1
            known.update(zip(fresh[at:end], self.merges.replay(raws[at:end])))
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) if t else [] for t in texts]
        words = set().union(*cut)
        fresh = words - self.known.keys()
        if fresh:
            if len(self.known) > REMEMBERED:
                fresh = words  # what is known now becomes the older half
            self._learn(list(fresh))
        known = self.known
        return [b"".join([known[w] for w in own]) for own in cut]

    def decode(self, ids: bytes) -> bytes:
        token = self.merges.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (an array of ids) for every document; null and empty texts have none."""

    def make():
        encoder = encoder_of(path, pattern)

        def run(ids, texts):
            return [ids, [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in encoder.encode(texts)]]

        return run

    return map_columns(docs.select("doc_id", "text"), make, "doc_id bigint, ids array<int>", BLOCK_ROWS)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def make():
        token = load(path).token

        def run(keys, ids):
            raw = [b"".join([token[i] for i in own or []]) for own in ids]
            return [keys, [r.decode("utf-8", errors="replace") for r in raw]]

        return run

    return map_columns(encoded.select("doc_id", "ids"), make, "doc_id bigint, text string", BLOCK_ROWS)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every document.

    A null text is an empty one: no ids, and the digests of no bytes. Repeated
    rows, null ids and other columns change nothing. No shuffle; a task holds
    the words of one block.
    """

    def make():
        encoder = encoder_of(path, pattern)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()

        def run(ids, texts):
            encoded = encoder.encode(texts)
            return [
                ids,
                [len(e) // 4 for e in encoded],
                [sha(e) for e in encoded],
                [sha(encoder.decode(e)) for e in encoded],
            ]

        return run

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_columns(docs.select("doc_id", "text"), make, schema, BLOCK_ROWS)
