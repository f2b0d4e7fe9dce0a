"""Token ids in a word-aligned binary file format, Simple-8b.

A file is a Parquet table of blocks. A block holds whole consecutive documents: their ids, and how
many ids each has; its payload is a run of 64-bit little-endian words. The upper four bits of a word
select how many values of how many bits fill the lower sixty; selector 15 is an escape, whose
lower bits number a value kept in full in ``escapes``. Words are decoded by selector, all words of a selector
at a time, to places given by a running sum of their counts.

``encode_documents`` writes, ``decode_blocks`` reads. Documents are ordered by id, then a hash of the text, then the text;
a null id sorts first; a null or empty text has the end id alone; repeated rows are all written.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: How many values a word holds, and of how many bits, by selector from 1 on.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 17
#: Chunks whose ids a worker keeps, in each of two generations.
CACHE = 350_000
#: Bits of each small value.
BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
BLOCKS = "shard int, block int, doc_ids array<bigint>, counts array<int>, words binary, escapes binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Words and escapes of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return b"", b""
    most = int(values.max())
    if most < len(BITS):
        width = BITS[values]
    elif most < 1 << 52:
        width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    else:  # beyond what a double holds exactly
        width = np.zeros(n, dtype=np.uint8)
        for k in range(64):
            width += (values >> np.uint64(k) != 0).astype(np.uint8)
    step = np.ones(n, dtype=np.int64)
    selector = np.where(width > 60, ESCAPE, 14).astype(np.uint64)
    done = width > 60
    for k, (count, bits) in enumerate(PACKS[:-1], 1):
        # Where so many narrow values follow each other: the last of them is as far off as their number says.
        narrow = np.flatnonzero(width <= bits)
        if len(narrow) < count:
            continue
        fits = narrow[: len(narrow) - count + 1]
        fits = fits[narrow[count - 1 :] - fits == count - 1]
        fits = fits[~done[fits]]
        step[fits], selector[fits], done[fits] = count, k, True
    following = (np.arange(n) + step).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = following[i]
    at = np.array(starts)
    chosen = selector[at]
    words = chosen << np.uint64(60)
    for k, (count, bits) in enumerate(PACKS, 1):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            first = at[mine]
            filled = values[first].copy()
            for j in range(1, count):
                filled |= values[first + j] << np.uint64(bits * j)
            words[mine] |= filled
    out = np.flatnonzero(chosen == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    return words.astype("<u8").tobytes(), values[at[out]].astype("<u8").tobytes()


def unpack(words: bytes, escapes: bytes = b"") -> np.ndarray:
    """The values of ``pack``."""
    words = np.frombuffer(words, dtype="<u8")
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([0] + [c for c, _ in PACKS] + [1])[chosen]
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint64)
    at = ends - counts
    for k, (count, bits) in enumerate(PACKS, 1):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            shifts = (np.arange(count) * bits).astype(np.uint64)
            out[at[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    mine = np.flatnonzero(chosen == ESCAPE)
    if len(mine):
        out[at[mine]] = np.frombuffer(escapes, dtype="<u8")[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


#: A chunk of letters and then of signs, all of which lower-case and normalise one by one: two words for the vocabulary.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([-.,;:!?\"#$%&()*+/<=>@\[\]_|]*)")


class WordTokenizer:
    """The tokenizers library, asked once for each chunk between spaces and line ends.

    The vocabulary drops white space, and no step before the merges looks past it, so the
    ids of a text are those of its chunks in order. For plain chunks only the library's merges are
    asked, once for each lower-cased word; any other chunk takes the whole way.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(content.decode())
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256) if chr(c).isprintable()}
        self.words = _Words(self)
        self.chunks = _Chunks(self)

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.library.model.tokenize(word.translate(self.bytes_as))]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        m = PLAIN.fullmatch(chunk) if len(chunk) <= 64 else None
        if m is None:
            return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        letters, signs = m.groups()
        words = self.words
        return words[letters.lower()] + words[signs] if signs else words[letters.lower()]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        get = self.chunks.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


class _Words(dict):
    """Ids by word, asked for once; all are forgotten when there are too many."""

    def __init__(self, tokenizer: WordTokenizer):
        self.ask = tokenizer.word
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 2 * CACHE:
            self.clear()
            self[""] = b""
        packed = self[word] = self.ask(word)
        return packed


class _Chunks(dict):
    """Ids by chunk in two generations; a full one replaces the older."""

    def __init__(self, tokenizer: WordTokenizer):
        self.ask, self.older = tokenizer.chunk, {}
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        packed = self.older.get(chunk)
        if packed is None:
            packed = self.ask(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
                self[""] = b""
            self[chunk] = packed
        return packed


@lru_cache(maxsize=1)
def _tokenizer(content: bytes) -> WordTokenizer:
    return WordTokenizer(content)


def encode_documents(
    docs: DataFrame, vocabulary: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None,
) -> None:
    """Write the ids of every document, each followed by ``end_id``, as blocks in ascending order of ids to ``path``.

    Shards are ranges of ids and, where many rows share one, of a hash of the text, so the order holds across them; only these
    two numbers are sampled for the bounds.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, shard, block = _tokenizer(content.value), TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            words, escapes = pack(np.frombuffer(b"".join(parts), dtype="<u4"))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int32())), pa.array([words], pa.binary()), pa.array([escapes], pa.binary()),
            ], names=["shard", "block", "doc_ids", "counts", "words", "escapes"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low in range(0, len(doc_ids), 256):
                texts = [t or "" for t in batch.column(1).slice(low, 256).to_pylist()]
                for doc_id, packed in zip(doc_ids[low : low + 256], encode(texts), strict=True):
                    ids.append(doc_id)
                    parts.append(packed + end)
                    size += len(packed) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield closed()
                        block, ids, parts, size = block + 1, [], [], 0
        if ids:
            yield closed()

    sorted_ = (
        docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("said"))
        .withColumn("mixed", F.xxhash64("said"))
        .repartitionByRange(shards, "id", "mixed")
        .sortWithinPartitions("id", "mixed", "said")
    )
    sorted_.select("id", "said").mapInArrow(run, BLOCKS).write.parquet(path)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """One row per document, from the blocks: ``shard``, ``block``, ``place`` in it, ``doc_id``, ``ids`` (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, doc_ids, counts, words, escapes = (batch.column(c)[row].as_py() for c in range(6))
                values = unpack(words, escapes).astype("<u4").tobytes()
                ends = (np.cumsum(counts) * 4).tolist()
                n = len(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()),
                    pa.array(doc_ids, pa.int64()), pa.array([values[e - 4 * c : e] for e, c in zip(ends, counts, strict=True)], pa.binary()),
                ], names=["shard", "block", "place", "doc_id", "ids"])

    return blocks.mapInArrow(run, "shard int, block int, place int, doc_id bigint, ids binary")


def index(blocks: DataFrame) -> DataFrame:
    """``shard``, ``block``, ``base``: the ids of all blocks before. Reads no payload; one row for each block.

    Blocks are summed by shard first; only those sums, a row for each shard, stand in one window.
    """
    sizes = blocks.select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    inside = sizes.withColumn("inside", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n"))
    totals = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return inside.join(bases, "shard").select("shard", "block", (F.col("inside") + F.col("before")).alias("base"))


def read_documents(docs_of: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` of every document in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, words, escapes, base = (batch.column(c)[row].as_py() for c in range(5))
                values = unpack(words, escapes).astype("<u4").tobytes()
                ends = np.cumsum(counts, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(base + ends - np.array(counts)), pa.array(np.array(counts, dtype=np.int64)),
                    pa.array([zlib.crc32(values[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts, strict=True)], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = docs_of.join(index(docs_of), ["shard", "block"]).select("doc_ids", "counts", "words", "escapes", "base")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
