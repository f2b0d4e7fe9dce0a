"""Byte-level byte-pair encoding and decoding over a published rank file.

Each match of the split pattern is encoded separately. Within a match, a segment tree
over byte positions holds, for every live token start, the rank of the pair that starts there, and in each
inner node the least of its leaves; the root is the leftmost pair of minimum rank. A merge retires one position and renews
the pairs of the two live neighbours, three logarithmic point updates, so that a match of n
bytes costs O(n log n) however long it is. The trees of short matches of about equal length are the rows of one array and
are worked on side by side, a merge of each at a time; a long match has a tree of its own.

Null texts are empty texts: no ids, and they decode to no bytes. Each row is encoded by itself, so rows that repeat an id or a
text are all returned; of equal ranks the leftmost pair merges first.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import add_columns

NONE = 1 << 62
#: Matches of up to so many bytes are encoded side by side.
SHORT = 64
#: Entries in each of the two generations of chunks met before; a full one replaces the older, so memory is bounded.
CACHE = 100_000
#: Longer chunks are encoded each time.
CACHED_CHARS = 48
#: Texts are taken in groups of about so many characters.
GROUP = 1_000_000


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks by token bytes from the lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the split pattern, by a segment tree of its own."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    shift = n.bit_length()
    position = (1 << shift) - 1
    get = ranks.get
    size = 1 << shift
    tree = [NONE] * (2 * size)  # leaves from ``size`` on, of the pair that starts at a byte: rank, then position
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after = list(range(1, n + 1))  # end of the token that starts here
    before = list(range(-1, n))  # start of the token to the left

    def renew(place: int, value: int) -> None:
        node = size + place
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            value = value if value < other else other
            if tree[node] == value:
                break
            tree[node] = value

    while n > 1 and (least := tree[1]) < NONE:
        i = least & position
        middle = after[i]
        end = after[i] = after[middle]
        left = before[i]
        before[end] = i
        renew(middle, NONE)
        rank = get(piece[i : after[end]]) if end < n else None
        renew(i, NONE if rank is None else rank << shift | i)
        if left >= 0:
            rank = get(piece[left:end])
            renew(left, NONE if rank is None else rank << shift | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PairTable:
    """The rank of what two neighbouring tokens make, by their ids: every way to cut a token into two tokens, hashed."""

    SLOTS = 1 << 20
    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        while self.SLOTS < 4 * len(keys):
            self.SLOTS *= 2
        self.keys = np.full(self.SLOTS, self.EMPTY, dtype=np.uint64)
        self.values = np.zeros(self.SLOTS, dtype=np.int64)
        left_keys, left_values = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int64)
        at = self._slot(left_keys)
        while len(left_keys):  # linear probing, a step of all at a time; of several in a slot one stays
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            self.keys[at[free]] = left_keys[free]
            self.values[at[free]] = left_values[free]
            rest = self.keys[at] != left_keys
            self.values[at[~rest]] = left_values[~rest]
            left_keys, left_values, at = left_keys[rest], left_values[rest], (at[rest] + 1) % self.SLOTS

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.SLOTS

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair makes no token."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        rest = np.flatnonzero((found != keys) & (found != self.EMPTY))
        while len(rest):
            at[rest] = (at[rest] + 1) % self.SLOTS
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found != self.EMPTY)]
        return out


def merge_rows(pieces: list[bytes], size: int, pairs: PairTable, byte_ids: np.ndarray) -> list[bytes]:
    """Packed ids of matches of 1 to ``size`` bytes, a power of two: one segment tree a row, one merge of every row at a time."""
    rows = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
    data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, size)
    width = size + 1
    token = np.zeros((rows, width), dtype=np.int64)
    token[:, :size] = byte_ids[data]
    places = np.arange(size)
    # Levels of the trees, leaves first: rank of the pair that starts at a place, then the place.
    key = np.full((rows, size), NONE, dtype=np.int64)
    start = np.flatnonzero((places[None, :] + 1 < lengths[:, None]).ravel())
    row, place = start // size, start % size
    rank = pairs(token[row, place], token[row, place + 1])
    key.ravel()[start] = np.where(rank == NONE, NONE, rank * size + place)
    levels = [key]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, 0::2], levels[-1][:, 1::2]))
    flat = [level.ravel() for level in levels]
    token, live = token.ravel(), (places[None, :] < lengths[:, None])
    alive = live.ravel()
    after = (np.arange(width) + 1)[None, :].repeat(rows, 0).ravel()
    before = (np.arange(width) - 1)[None, :].repeat(rows, 0).ravel()
    root = flat[-1]

    def renew(rows_: np.ndarray, places_: np.ndarray, values: np.ndarray) -> None:
        flat[0][rows_ * size + places_] = values

    def climb(rows_: np.ndarray, places_: np.ndarray) -> None:
        for k in range(1, len(flat)):
            node = rows_ * (size >> k) + (places_ >> k)
            below = flat[k - 1]
            flat[k][node] = np.minimum(below[2 * node], below[2 * node + 1])

    active = np.flatnonzero(root < NONE)
    while len(active):
        least = root[active]
        i = least % size
        base = active * width
        middle = after[base + i]
        end = after[base + middle]
        left = before[base + i]
        made = least // size
        token[base + i] = made
        after[base + i] = end
        before[base + end] = i
        alive[active * size + middle] = False
        renew(active, middle, np.full(len(active), NONE))
        inner = end < lengths[active]
        rank = np.full(len(active), NONE)
        rank[inner] = pairs(made[inner], token[base[inner] + end[inner]])
        renew(active, i, np.where(rank == NONE, NONE, rank * size + i))
        has = np.flatnonzero(left >= 0)
        to, at = active[has], left[has]
        rank = pairs(token[base[has] + at], made[has])
        renew(to, at, np.where(rank == NONE, NONE, rank * size + at))
        climb(active, middle)
        climb(active, i)
        climb(to, at)
        active = active[root[active] < NONE]
    ids = token.reshape(rows, width)[:, :size][live].astype("<u4").tobytes()
    ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks.get(bytes([b]), 0) for b in range(256)], dtype=np.int64)
        self.find = regex.compile(pattern).findall
        # A space beside other white space is where a cut could change the matches.
        self.runs = regex.compile(r"\s \s|^ \s|\s $").search
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of all these matches; short ones are kept for later groups."""
        if len(self.pieces) > CACHE:
            self.older_pieces, self.pieces = self.pieces, {}
        known, older, get = self.pieces, self.older_pieces.get, self.ranks.get
        made: dict[str, bytes] = {}
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            packed = known.get(piece) or older(piece)
            if packed is None:
                data = piece.encode()
                whole = get(data)
                if whole is not None:
                    packed = whole.to_bytes(4, "little")
                elif len(data) > SHORT:
                    packed = array("I", merge(data, self.ranks)).tobytes()
                else:
                    said, rows = by_size.setdefault(1 << (len(data) - 1).bit_length(), ([], []))
                    said.append(piece)
                    rows.append(data)
                    continue
            made[piece] = packed
        for size, (said, rows) in by_size.items():
            for low in range(0, len(rows), 1 << 13):
                made.update(zip(said[low : low + (1 << 13)], merge_rows(rows[low : low + (1 << 13)], size, self.pairs, self.byte_ids), strict=True))
        known.update((piece, packed) for piece, packed in made.items() if len(piece) <= CACHED_CHARS)
        return made

    def __call__(self, texts: list[str]) -> list[bytes]:
        # Any match that holds a single space between other characters starts with it, so most texts may be cut before
        # each such space. Chunks are kept with the space that stands before them; a first chunk has none.
        odd = [bool(self.runs(t)) for t in texts]
        split = []
        for text, whole in zip(texts, odd, strict=True):
            if whole:
                split.append(self.find(text))
            else:
                split.append(text.replace(" ", "\0 ").split("\0") if "\0" not in text else self._cut(text))
        if len(self.chunks) > CACHE:
            self.older_chunks, self.chunks = self.chunks, {}
        chunks, older = self.chunks, self.older_chunks.get
        new: dict[str, list[str]] = {}
        needed: set[str] = set()
        for chunk in set().union(*split).difference(chunks):
            packed = older(chunk)
            if packed is None:
                new[chunk] = found = self.find(chunk)
                needed.update(found)
            else:
                chunks[chunk] = packed
        ids = self._learn(needed)
        long = []
        for chunk, found in new.items():
            chunks[chunk] = ids[found[0]] if len(found) == 1 else b"".join(map(ids.__getitem__, found))
            if len(chunk) > CACHED_CHARS:
                long.append(chunk)
        out = [b"".join(map(chunks.__getitem__, parts)) for parts in split]
        for chunk in long:
            del chunks[chunk]
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        head, *tails = text.split(" ")
        return [head, *(" " + t for t in tails)]


def groups(texts: list[str], chars: int = GROUP) -> Iterator[list[str]]:
    """Neighbouring texts, in groups of about so many characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def decode_packed(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=1)
def _encoder(content: bytes, pattern: str) -> Encoder:
    """One for a Python worker, which keeps its chunks from task to task."""
    return Encoder(parse_ranks(content), pattern)


def _content(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # about 1 MB, however large the corpus


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def encode(
    df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """Add ``ids_col``: the ids of the whole text as little-endian unsigned 32-bit integers.

    ``rank_file`` is a driver-side path of the published ranks, ``pattern`` the split pattern. With ``decoded_col``, the
    bytes that the ids decode to are added in the same pass. A column that already has such a name is replaced;
    all others are kept.
    """
    content = _content(df, rank_file)
    names = [ids_col, decoded_col] if decoded_col else [ids_col]

    def start():
        encoder = _encoder(content.value, pattern)
        tokens = _tokens(encoder.ranks) if decoded_col else []

        def apply(texts: pa.Array) -> list:
            parts: list[list[pa.Array]] = [[pa.array([], pa.binary())] for _ in names]
            for low in range(0, len(texts), 512):  # no more of a batch than this is held as Python objects
                for group in groups([t or "" for t in texts.slice(low, 512).to_pylist()]):
                    ids = encoder(group)
                    parts[0].append(pa.array(ids, pa.binary()))
                    if decoded_col:
                        parts[1].append(pa.array([decode_packed(x, tokens) for x in ids], pa.binary()))
            return [pa.concat_arrays(part) for part in parts]

        return apply

    return add_columns(df, [text_col], [T.StructField(name, T.BinaryType()) for name in names], start)


def decode(df: DataFrame, rank_file: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col``: the bytes that the packed ids in ``ids_col`` stand for; null ids give no bytes."""
    content = _content(df, rank_file)

    def start():
        tokens = _tokens(parse_ranks(content.value))
        return lambda ids: [pa.array([decode_packed(x, tokens) if x else b"" for x in ids.to_pylist()], pa.binary())]

    return add_columns(df, [ids_col], [T.StructField(bytes_col, T.BinaryType())], start)


def encode_all(texts: Iterable[str | None], ranks: dict[bytes, int], pattern: str) -> list[list[int]]:
    """The same encoding of a few texts on the driver."""
    encoder = Encoder(ranks, pattern)
    return [list(array("I", x)) for x in encoder([t or "" for t in texts])]
