"""Ranked lexical search by Block-Max MaxScore over sharded inverted lists.

A pass over the texts gives the corpus counts: documents with a term, and all terms with repeats. A second pass writes the index:
each task closes a shard after about ``SHARD_BYTES`` of text and returns a row for each of its terms. Such a row holds the list of the
term's documents, in order of their ids within the shard, cut into blocks of ``BLOCK`` entries; a block is byte-aligned gaps and counts, and a small head
for each block stands beside it: the last document, the greatest impact, and where its bytes begin. An impact is the score's part that doesn't hang on the term,
(1000000000 tf) div (1000 tf + 8 m). All terms are indexed; a search reads the rows of its own terms only.

A search goes through the items in blocks of bounded size. In each shard the lists of an item are ordered by their greatest possible score. As soon as ten
documents are known, the lists that together can't reach the tenth are not essential: only the others propose candidates. A candidate then meets
the remaining lists from the greatest bound down, and goes as soon as its score, the maximum of the block that it would stand in, and the
bounds of the lists behind can't beat the tenth; only blocks that still have a candidate are decoded. Candidates are worked through as
arrays, a window of documents at a time. What the shards find meets by item.

Defined cases: a null or empty text has no terms and is in no count. Rows are documents, also where ids repeat; a row without an id counts, and is listed behind
others of its score. Items that share an id are one, with the terms of all; an item without an id, a text or terms has no results. Equal scores go by the smaller id.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import slices, utf8, written

SHARD_BYTES = 16 << 20
BLOCK = 128
WINDOW = 4096
#: Bytes of the terms of a block of items: bounds what is sent to a task.
ITEM_BYTES = 8 << 20
RESULTS = 10

#: Bytes that end a term become blanks, A to Z small letters; all else stays.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_TABLE).split()


def corpus_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms there are with repeats."""

    def task(batches):
        n = total = 0
        for batch in batches:
            for part in slices(batch):
                for text in utf8(part.column(0)):
                    k = len(terms(text))
                    n += k > 0
                    total += k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "l"])

    row = docs.select(text_col).mapInArrow(task, "n bigint, l bigint").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row["n"] or 0, row["l"] or 0


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


#: Of each block: last document, greatest impact, where its bytes begin, entries, bytes of a gap and of a count.
HEAD = np.dtype([("last", "<u4"), ("most", "<u4"), ("start", "<u4"), ("size", "<u2"), ("gap", "u1"), ("tf", "u1")])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow column of the parts of ``data`` that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def pack(starts: np.ndarray, places: np.ndarray, tfs: np.ndarray, worth: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(heads, blocks) of lists that stand one behind the other from ``starts``: rising places, how often, and impacts."""
    sizes = np.diff(np.append(starts, len(places)))
    inside = np.arange(len(places)) - np.repeat(starts, sizes)
    gaps = places - np.where(inside == 0, -1, np.roll(places, 1)) - 1
    first = np.flatnonzero(inside % BLOCK == 0)
    heads = np.zeros(len(first), dtype=HEAD)
    heads["size"] = size = np.diff(np.append(first, len(places)))
    heads["last"], heads["most"] = places[first + size - 1], np.maximum.reduceat(worth, first)
    for name, values in (("gap", gaps), ("tf", tfs)):
        most = np.maximum.reduceat(values, first)
        heads[name] = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    ends = np.cumsum(size * (heads["gap"].astype(np.int64) + heads["tf"]))
    begins = np.concatenate([[0], ends[:-1]])
    data = np.zeros(int(ends[-1]), dtype=np.uint8)
    block, within = np.repeat(np.arange(len(first)), size), np.arange(len(places)) - np.repeat(first, size)
    for values, width, at in ((gaps, heads["gap"], begins), (tfs, heads["tf"], begins + size * heads["gap"])):
        place = at[block] + within * width[block]
        for byte in range(int(width.max())):
            has = width[block] > byte
            data[place[has] + byte] = (values[has] >> 8 * byte) & 255
    own = np.searchsorted(first, starts)  # the first block of each list
    blocks = np.diff(np.append(own, len(first)))
    heads["start"] = begins - np.repeat(begins[own], blocks)
    last = own + blocks - 1
    return _binary(heads, (last + 1) * HEAD.itemsize), _binary(data, ends[last])


def unpack(heads: np.ndarray, data: bytes, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, how often) of one block."""
    h = heads[b]
    size, start = int(h["size"]), int(h["start"])
    gaps = np.frombuffer(data, f"<u{h['gap']}", size, start).astype(np.int64)
    tfs = np.frombuffer(data, f"<u{h['tf']}", size, start + size * int(h["gap"])).astype(np.int64)
    before = int(heads[b - 1]["last"]) if b else -1
    return before + np.cumsum(gaps + 1), tfs


INDEX = "shard string, term binary, docs int, heads binary, blocks binary"


def _shard(name: str, ids: list, texts: list[bytes], n: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard; the row of the empty term holds its documents' ids (blocks) and their m (heads), null ids in ``docs``."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    said, lengths = array("I"), np.zeros(len(order), dtype=np.int64)
    for place, i in enumerate(order):
        found = terms(texts[i])
        lengths[place] = len(found)
        said.extend(map(numbers.__getitem__, found))
    m = 10 + np.array([90 * int(k) * n // total for k in lengths], dtype=np.int64)
    names = sorted(numbers)
    rank = np.empty(len(names), dtype=np.int64)
    rank[[numbers[t] for t in names]] = np.arange(len(names))
    pairs, tfs = np.unique(rank[np.frombuffer(said, dtype=np.uint32)] << 32 | np.repeat(np.arange(len(order)), lengths), return_counts=True)
    places, term = pairs & 0xFFFFFFFF, pairs >> 32
    starts = np.searchsorted(term, np.arange(len(names)))
    heads, blocks = pack(starts, places, tfs, impacts(tfs, m[places]))
    ends = np.cumsum([len(t) for t in names])
    listed = [
        _binary(np.frombuffer(b"".join(names), dtype=np.uint8), ends), pa.array(np.diff(np.append(starts, len(places))), pa.int32()), heads, blocks,
    ]
    own = np.array([ids[i] or 0 for i in order], dtype="<i8").tobytes()
    first = [pa.array([b""], pa.binary()), pa.array([sum(x is None for x in ids)], pa.int32()), pa.array([m.astype("<i8").tobytes()], pa.binary()), pa.array([own], pa.binary())]
    for columns in (first, listed):
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *columns], names=["shard", "term", "docs", "heads", "blocks"])


def index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """The index below ``folder``, and both corpus counts."""
    n, total = corpus_counts(docs, text_col)

    def task(batches):
        from pyspark import TaskContext

        part, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for some in slices(batch):
                for i, text in zip(some.column(0).to_pylist(), utf8(some.column(1)), strict=True):
                    if not terms(text[:64]) and not terms(text):
                        continue
                    ids.append(i)
                    texts.append(text)
                    held += len(text) + 64
                    if held >= shard_bytes:
                        yield from _shard(f"{part}-{made}", ids, texts, n, total)
                        made, ids, texts, held = made + 1, [], [], 0
        if ids:
            yield from _shard(f"{part}-{made}", ids, texts, n, total)

    named = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc"), docs[f"`{text_col}`"].alias("text"))
    return written(named.mapInArrow(task, INDEX), f"{folder}/index"), n, total


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """The lists of one shard that some items ask for; blocks are decoded when first needed, and kept."""

    def __init__(self, m: np.ndarray, lists: dict[bytes, tuple[np.ndarray, bytes]]):
        self.m, self.lists = m, lists
        self.kept: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}
        self.decoded = 0

    def block(self, term: bytes, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of a block."""
        got = self.kept.get((term, b))
        if got is None:
            places, tfs = unpack(*self.lists[term], b)
            got = self.kept[term, b] = (places, impacts(tfs, self.m[places]))
            self.decoded += 1
        return got

    def best(self, asked: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``k`` best documents with a score above 0, the smaller place first where scores are equal."""
        held = [(w * int(self.lists[t][0]["most"].max()), t, w) for t, w in asked if w > 0 and t in self.lists]
        held.sort()
        bounds = np.cumsum([0] + [h[0] for h in held])  # the most that the first i lists can give together
        top_p, top_s, least = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        for low in range(0, len(self.m), WINDOW):
            high = min(low + WINDOW, len(self.m))
            # A later document must beat the tenth, as it comes after it in order.
            first = int(np.searchsorted(bounds, least, side="right")) - 1 if least else 0
            if first >= len(held):
                break
            scores = np.zeros(high - low, dtype=np.int64)
            for _, term, w in held[first:]:
                heads = self.lists[term][0]
                b = int(np.searchsorted(heads["last"], low))
                while b < len(heads) and (b == 0 or heads["last"][b - 1] + 1 < high):
                    places, worth = self.block(term, b)
                    i, j = np.searchsorted(places, (low, high))
                    scores[places[i:j] - low] += w * worth[i:j]
                    b += 1
            found = np.flatnonzero(scores)
            for i in range(first - 1, -1, -1):
                found = found[scores[found] + bounds[i + 1] > least]
                if not len(found):
                    break
                _, term, w = held[i]
                heads = self.lists[term][0]
                at = np.searchsorted(heads["last"], found + low)
                inside = at < len(heads)
                most = np.zeros(len(found), dtype=np.int64)
                most[inside] = heads["most"][at[inside]].astype(np.int64) * w
                stays = scores[found] + most + bounds[i] > least
                found, at = found[stays], at[stays]
                for b in np.unique(at[at < len(heads)]):
                    own = found[at == b]
                    places, worth = self.block(term, int(b))
                    i_ = np.minimum(np.searchsorted(places, own + low), len(places) - 1)
                    hit = places[i_] == own + low
                    scores[own[hit]] += w * worth[i_[hit]]
            found = found[scores[found] > least]
            if len(found):
                top_p, top_s = np.concatenate([top_p, found + low]), np.concatenate([top_s, scores[found]])
                order = np.lexsort((top_p, -top_s))[:k]
                top_p, top_s = top_p[order], top_s[order]
                least = int(top_s[-1]) if len(top_p) == k else 0
        return top_p, top_s


def _item_blocks(items: DataFrame, id_col: str, text_col: str, folder: str, item_bytes: int) -> tuple[DataFrame, int]:
    """``item`` and its distinct ``terms``, dealt into blocks of about ``item_bytes``."""

    def task(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([sorted(set(terms(t))) for t in utf8(part.column(1))], pa.list_(pa.binary()))], names=["item", "terms"]
                )

    kind = items.schema[id_col].dataType.simpleString()
    named = items.select(items[f"`{id_col}`"].alias("item"), items[f"`{text_col}`"].alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    each = named.mapInArrow(task, f"item {kind}, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()
    held = written(each, f"{folder}/items")
    size = held.agg(F.sum(F.octet_length("term") + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // item_bytes))
    return held.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), blocks


def search(
    index_: DataFrame, n: int, items: DataFrame, folder: str, k: int = RESULTS, id_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``id_col``, ``rank``, ``doc_id``, ``score`` of the ``k`` best documents of each item."""
    spark = index_.sparkSession
    dealt, blocks = _item_blocks(items, id_col, text_col, folder, item_bytes)
    kind, item_type = dealt.schema["item"].dataType.simpleString(), to_arrow_type(dealt.schema["item"].dataType)
    schema, path = f"item {kind}, doc_id bigint, score bigint", f"{folder}/found"
    for block in range(blocks):
        asked: dict[object, list[bytes]] = {}
        for r in dealt.where(F.col("block") == block).select("item", "term").toLocalIterator():  # about ``item_bytes``
            asked.setdefault(r["item"], []).append(bytes(r["term"]))
        wanted = sorted({t for own in asked.values() for t in own})
        some = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in [b"", *wanted]], "term binary"))
        lists = index_.join(some, "term")
        counts = lists.where(F.octet_length("term") > 0).groupBy("term").agg(F.sum("docs").alias("df")).collect()  # a row for each wanted term
        worth = {bytes(r["term"]): weight(n, r["df"]) for r in counts}
        sent = spark.sparkContext.broadcast([(item, [(t, worth[t]) for t in own if t in worth]) for item, own in asked.items()])

        def task(group):
            terms_, heads, data = (group[c].to_pylist() for c in ("term", "heads", "blocks"))
            at = terms_.index(b"")
            m, ids, nulls = np.frombuffer(heads[at], "<i8"), np.frombuffer(data[at], "<i8"), group["docs"][at].as_py()
            shard = Shard(m, {t: (np.frombuffer(h, HEAD), d) for t, h, d in zip(terms_, heads, data, strict=True) if t})
            items_, docs, scores = [], [], []
            for item, own in sent.value:
                places, s = shard.best(own, k)
                items_ += [item] * len(places)
                docs += [int(ids[p]) if p < len(ids) - nulls else None for p in places]
                scores += s.tolist()
            return pa.table({"item": pa.array(items_, item_type), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

        lists.groupBy("shard").applyInArrow(task, schema).write.mode("append").parquet(path)
        sent.destroy()
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = spark.read.schema(schema).parquet(path).withColumn("rank", place).where(F.col("rank") <= k)
    return found.select(F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
