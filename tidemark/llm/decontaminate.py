"""Benchmark decontamination with one Aho-Corasick automaton.

A window is ``WINDOW`` consecutive words of a benchmark item (questions and answers alike; an item of fewer words is one
window), over normalised text. The automaton reads words, not letters: each word of the benchmark is a symbol. Every window of an item holds
one of its blocks of ``SEED`` words that start at multiples of ``SEED``, so the automaton holds these blocks only, about one node for each word
of the benchmark. Where a block occurs in a document, the words before and after it are compared with the
item's: a common stretch of a window's length or more is a run of occurring windows. A short item, and each window of an item that
repeats a block often, is held whole. Each document is scanned once; hits are word numbers, which ``word_spans`` maps
to characters of the original text.

Defined cases: a null or empty document has no words and no hits; a null or empty item has
no window; repeated items count once for each item_id; a null item_id is ignored; rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns, remove, shared_dir, utf8, written
from tidemark.llm.words import words

WINDOW = 13
SEED = 7  # the longest of which every window holds a whole block
#: An item in which a block occurs more often is held by its windows.
REPEATS = 4
#: Bytes of benchmark text in one automaton. A larger benchmark is scanned in so many blocks, one after the other.
BLOCK_BYTES = 8_000_000
#: A word is written in as many of so many letters as the vocabulary needs: a node of the automaton has few children.
LETTERS = 64


class Matcher:
    """The automaton over word symbols, all of ``width`` letters, and the items' words."""

    def __init__(self, items: tuple[tuple[str, bytes], ...]):
        said = [(item_id, words(text)) for item_id, text in items]
        vocabulary = dict.fromkeys(w for _, found in said for w in found)
        self.width = 1
        while LETTERS**self.width < len(vocabulary):
            self.width += 1
        self.other = chr(0) * self.width
        self.symbols = {w: self._symbol(k) for k, w in enumerate(vocabulary)}
        held: dict[str, list[tuple[int, int]]] = {}  # (item, place of a block), or (item, -1) of what is held whole
        self.ids = [item_id for item_id, _ in said]
        self.lines: list[str] = []
        for number, (_, found) in enumerate(said):
            line = self._line(found)
            blocks: dict[str, list[int]] = {}
            for at in range(0, len(found) - SEED + 1, SEED):
                blocks.setdefault(self._part(line, at, SEED), []).append(at)
            whole = len(found) < WINDOW or max(map(len, blocks.values())) > REPEATS
            self.lines.append("" if whole else line)
            if not whole:
                for block, places in blocks.items():
                    held.setdefault(block, []).extend((number, at) for at in places)
            elif found:
                size = min(WINDOW, len(found))
                for window in {self._part(line, at, size) for at in range(len(found) - size + 1)}:
                    held.setdefault(window, []).append((number, -1))
        self.automaton = ahocorasick.Automaton()
        for key, places in held.items():
            self.automaton.add_word(key, (len(key) // self.width, places))
        if held:
            self.automaton.make_automaton()

    def __len__(self) -> int:
        return len(self.automaton)

    def _symbol(self, k: int) -> str:
        made = []
        for _ in range(self.width):
            k, c = divmod(k, LETTERS)
            made.append(chr(c + 1))
        return "".join(made)

    def _line(self, found: list[bytes]) -> str:
        get, other = self.symbols.get, self.other
        return "".join([get(w, other) for w in found])

    def _part(self, line: str, at: int, size: int) -> str:
        return line[at * self.width : (at + size) * self.width]

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open ranges of hit words, and the items with an occurring window."""
        line, width, n = self._line(found), self.width, len(found)
        if not line.strip(self.other[0]):
            return [], set()
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        done: dict[tuple[int, int], int] = {}  # how far a diagonal of an item has been followed
        for last, (size, places) in self.automaton.iter(line):
            if (last + 1) % width:
                continue  # it ends within a word's symbols
            end = (last + 1) // width
            for number, place in places:
                if place < 0:
                    hits.append((end - size, end))
                    items.add(self.ids[number])
                    continue
                start = end - size
                if done.get((number, start - place), -1) >= end:
                    continue
                own = self.lines[number]
                m = len(own) // width
                low, high, behind, ahead = start, end, place, place + size
                while low and behind and line[(low - 1) * width : low * width] == own[(behind - 1) * width : behind * width]:
                    low, behind = low - 1, behind - 1
                while high < n and ahead < m and line[high * width : (high + 1) * width] == own[ahead * width : (ahead + 1) * width]:
                    high, ahead = high + 1, ahead + 1
                done[number, start - place] = high
                if high - low >= WINDOW:
                    hits.append((low, high))
                    items.add(self.ids[number])
        ranges: list[list[int]] = []
        for low, high in sorted(hits):
            if ranges and low <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], high)
            else:
                ranges.append([low, high])
        return [(a, b) for a, b in ranges], items


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[str, bytes], ...]) -> Matcher:
    return Matcher(items)


def scan(text: bytes, built: Matcher) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Word count, merged half-open ranges of hit words, and the items with an occurring window."""
    found = words(text)
    return (len(found), *built.scan(found)) if found and len(built) else (len(found), [], set())


RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_ranges", RANGES),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def _scan_block(docs: DataFrame, items: tuple[tuple[str, bytes], ...], text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)  # at most about BLOCK_BYTES

    def start():
        built = _matcher(sent.value)

        def apply(texts: pa.Array) -> list:
            found = [scan(t, built) for t in utf8(texts)]
            return [
                [f[0] for f in found],
                [[{"first": a, "end": b} for a, b in f[1]] for f in found],
                [sorted(f[2]) for f in found],
            ]

        return apply

    return add_columns(docs, [text_col], FIELDS, start)


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``hit_ranges`` (of word numbers, merged) and ``hit_items`` to each document.

    The size of the benchmark is measured first. Up to ``block_bytes`` it is one automaton; beyond, its
    items are dealt into blocks by hash, each of them an automaton, and the documents are scanned by
    one after the other, written in between, without a shuffle: one automaton is in memory at a time.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("said"))
    items = items.where("item IS NOT NULL AND said IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("said")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    folder = shared_dir(docs.sparkSession) if blocks > 1 else ""
    marked = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # one block's bytes
        held = tuple(sorted((r.item, r.said.encode()) for r in rows))
        if marked is None:
            marked = _scan_block(docs, held, text_col)
            continue
        before = written(marked, f"{folder}/{block}")
        if block > 1:
            remove(docs.sparkSession, f"{folder}/{block - 1}")
        ranges, found = (f"{c}_before_" + "_".join(docs.columns) for c in ("ranges", "items"))  # the names of no other column
        before = before.withColumnsRenamed({"hit_ranges": ranges, "hit_items": found})
        marked = _scan_block(before, held, text_col).withColumns({
            "hit_ranges": _merged(F.concat(ranges, "hit_ranges")),
            "hit_items": F.array_sort(F.array_distinct(F.concat(found, "hit_items"))),
        }).drop(ranges, found)
    return marked


def _merged(ranges):
    """Sorted and merged ranges of an array of them."""
    return F.aggregate(
        F.array_sort(ranges),
        F.array().cast(RANGES),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(
                    F.element_at(acc, -1)["first"].alias("first"),
                    F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def verdicts(marked: DataFrame) -> DataFrame:
    """Add ``n_hit`` (distinct hit words) and ``contaminated``: hit at all, and at least one word in twenty."""
    hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["first"]))
    return marked.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def word_spans(text: str) -> list[tuple[int, int]]:
    """Offsets, in code points of the original text, of its words by number."""
    spans, start = [], None
    for i, c in enumerate(text):
        inside = ord(c) >= 128 or c.isascii() and c.isalnum()
        if inside and start is None:
            start = i
        if not inside and start is not None:
            spans.append((start, i))
            start = None
    return spans if start is None else [*spans, (start, len(text))]


def items_digest(ids: list[str]) -> str:
    """What the digest column holds for these items."""
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()
