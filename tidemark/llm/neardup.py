"""Near-duplicate classes of texts by Order MinHash.

A text is the sequence of its overlapping runs of ``SHINGLE`` words (a text of fewer words is one run). Each run
is labelled with its occurrence number; each of ``SKETCHES`` hash functions picks the ``PICKS`` least labelled
runs and keeps them in the order of the text, so that equal sketches speak for a small edit distance
and not just for shared words. Two texts with an equal sketch are candidates. A candidate
is verified by a banded alignment of the two sequences of runs: with L aligned runs of n and m, they are near
duplicates if L / (n + m - L) is at least ``SIMILARITY``.

Within a bucket of equal sketches every other text is compared with the most central one, that which meets most texts over all
its buckets: of a family of near copies this is the one from which the others are made, so that most links are found with few pairs. If
that leaves a bucket with texts of several classes, all its texts go to an exact join:
a pair that can reach the similarity has a labelled run in common among the rarest runs of both, as many as its lengths let differ.
Each pair of different classes that has is verified, so that no pair of a bucket is left undecided. A class
is a connected component of verified links.

Defined cases: equal word sequences are copies, whatever stands between the words; texts without words are copies if they
are equal as they stand; a null text is a class of its own. Rows that share an id are one document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns, remove, written
from tidemark.llm.components import components
from tidemark.llm.words import WordHashes, words

SHINGLE = 5
SIMILARITY = (8, 10)
SKETCHES = 24
PICKS = 3
#: Slots in which the runs of left-over texts are counted; the counts only order the runs, any order gives the same pairs.
SLOTS = 1 << 20
#: Texts with one run in common are compared in blocks of about this many.
BLOCK = 4096

MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)
_SEEDS = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _SEEDS.integers(0, 1 << 63, (SKETCHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _SEEDS.integers(0, 1 << 63, (SKETCHES, 1), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """64-bit values of the runs of words of a text, in order."""
    x = _mixed(hashes.astype(np.uint64) + np.uint64(1))
    n = len(x)
    if n < SHINGLE:
        return _mixed(np.array([(x * POWERS[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64)) if n else x
    out = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        out += x[k : n - SHINGLE + 1 + k] * POWERS[k]
    return _mixed(out)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Runs combined with the number of equal ones before."""
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    place = np.arange(len(runs))
    times = np.empty(len(runs), dtype=np.uint64)
    times[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mixed(runs + times * FACTORS[0, 0])


def sketches(runs: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """One value for each hash function: the picked runs, in text order."""
    if not len(runs):
        return np.zeros(0, dtype=np.int64)
    marks = labelled(runs)
    best_keys = best_at = None
    for low in range(0, len(runs), block):  # long texts in blocks, so that memory stays bounded
        keys = _mixed(marks[None, low : low + block] * FACTORS + OFFSETS)
        at = np.arange(low, low + keys.shape[1])[None, :].repeat(SKETCHES, 0) if best_keys is not None else None
        if best_keys is not None:
            keys, at = np.concatenate((best_keys, keys), 1), np.concatenate((best_at, at), 1)
        k = min(PICKS, keys.shape[1])
        chosen = np.argpartition(keys, k - 1, axis=1)[:, :k] if keys.shape[1] > k else np.arange(k)[None, :].repeat(SKETCHES, 0)
        best_keys = np.take_along_axis(keys, chosen, 1)
        best_at = chosen + low if at is None else np.take_along_axis(at, chosen, 1)
    picked = runs[np.sort(best_at, axis=1)]
    value = OFFSETS[:, 0].copy()
    for k in range(picked.shape[1]):
        value = _mixed(value * MIX + picked[:, k])
    return value.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    """Whether the banded alignment of two sequences of runs reaches the similarity."""
    n, m = len(a), len(b)
    p, q = similarity
    need = -(-p * (n + m) // (p + q))
    if min(n, m) < need or not n:
        return False
    short = min(n, m)
    unequal = np.flatnonzero(a[:short] != b[:short])
    head = int(unequal[0]) if len(unequal) else short
    rest = short - head
    unequal = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else ()
    tail = int(unequal[0]) if len(unequal) else rest
    need -= head + tail
    if need <= 0:
        return True
    a, b = a[head : n - tail], b[head : m - tail]
    n, m = len(a), len(b)
    if min(n, m) < need:
        return False
    x, times_x = np.unique(a, return_counts=True)
    y, times_y = np.unique(b, return_counts=True)
    _, in_x, in_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if np.minimum(times_x[in_x], times_y[in_y]).sum() < need:
        return False
    # Row by row, a bit for each column of the band; a cleared bit is an aligned run more than to its left.
    places: dict[int, list[int]] = {}
    for j, run in enumerate(b.tolist()):
        places.setdefault(run, []).append(j)
    masks = {run: sum(1 << j for j in js) for run, js in places.items() if len(js) > 4}
    left, right = n - need, m - need
    low = width = base = 0
    row = 0
    for i, run in enumerate(a.tolist()):
        if i - left > low:
            base += 1 - (row & 1)
            row >>= 1
            low += 1
            width -= 1
        wide = min(m, i + right + 1) - low
        if wide > width:
            row |= ((1 << wide) - 1) ^ ((1 << width) - 1)
            width = wide
        if run not in places:
            continue
        if run in masks:
            hits = masks[run] >> low & ((1 << width) - 1)
        else:
            hits = 0
            for j in places[run]:
                if low <= j < low + width:
                    hits |= 1 << (j - low)
        x = row & hits
        row = ((row + x) | (row - x)) & ((1 << width) - 1)
    return base + width - row.bit_count() >= need


FIELDS = [
    T.StructField("print", T.BinaryType()), T.StructField("n_runs", T.IntegerType()),
    T.StructField("sketches", T.ArrayType(T.LongType())), T.StructField("hashes", T.BinaryType()),
]


def fingerprints(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``print`` (equal for copies, null for a null text), ``n_runs``, ``sketches`` and the packed word hashes; drop the text."""

    def start():
        held = WordHashes()

        def one(text: bytes | None) -> tuple:
            if text is None:
                return None, 0, [], b""
            found = words(text)
            if not found:
                return hashlib.blake2b(text, digest_size=16, person=b"raw").digest(), 0, [], b""
            hashes = held.array(found)
            runs = shingles(hashes)
            said = hashlib.blake2b(b" ".join(found), digest_size=16).digest()
            return said, len(runs), sketches(runs), zlib.compress(hashes.tobytes(), 1)

        def apply(texts: pa.Array) -> list:
            rows = [one(t) for t in texts.cast(pa.binary()).to_pylist()]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

        return apply

    return add_columns(docs, [text_col], FIELDS, start, drop=(text_col,))


def _verified(pairs: DataFrame, said: DataFrame, folder: str) -> DataFrame:
    """The pairs (``doc``, ``leader``) whose alignment reaches the similarity, as a written table; ``said`` has id and hashes."""
    both = pairs.join(said.select(F.col("id").alias("doc"), F.col("hashes").alias("of_doc")), "doc").join(
        said.select(F.col("id").alias("leader"), F.col("hashes").alias("of_leader")), "leader"
    )

    def run(batches):
        last, runs = None, None
        for batch in batches:
            keep = []
            leaders, of_docs, of_leaders = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for i, leader in enumerate(leaders):
                if leader != last or runs is None:
                    last, runs = leader, shingles(np.frombuffer(zlib.decompress(of_leaders[i].as_py()), dtype=np.uint32))
                keep.append(aligned(shingles(np.frombuffer(zlib.decompress(of_docs[i].as_py()), dtype=np.uint32)), runs))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["doc", "leader"])

    checked = both.select("doc", "leader", "of_doc", "of_leader").mapInArrow(run, "doc bigint, leader bigint")
    return written(checked, f"{folder}/links")


def _of(packed: pa.Array) -> Iterator[np.ndarray]:
    """The labelled runs of each text of a column of packed word hashes."""
    for x in packed:
        yield labelled(shingles(np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32)))


def _slot(marks: np.ndarray) -> np.ndarray:
    return (marks % np.uint64(SLOTS)).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """A byte for each slot that grows with the number of runs in it; ``texts`` has hashes."""

    def run(batches):
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for marks in _of(batch.column(0)):
                np.add.at(counts, _slot(marks), 1)
        at = np.flatnonzero(counts)
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"])

    often = texts.select("hashes").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    found = often.select("slot", F.floor(4 * F.log2("n")).cast("int").alias("n")).toArrow()
    made = np.zeros(SLOTS, dtype=np.uint8)
    made[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return made


def _rarest(texts: DataFrame, often: np.ndarray) -> DataFrame:
    """``mark``, ``place`` of the rarest labelled runs of each text, of which a near duplicate must have one; ``texts`` has id, label, hashes."""
    p, q = SIMILARITY

    def run(batches):
        for batch in batches:
            marks, places, sizes, runs = [], [], [], []
            for all_marks in _of(batch.column(2)):
                n = len(all_marks)
                least = all_marks[np.lexsort((all_marks, often[_slot(all_marks)]))[: n - -(-p * n // q) + 1]]
                marks.append(least)
                places.append(np.arange(len(least), dtype=np.int32))
                sizes.append(len(least))
                runs.append(n)
            if not sizes:
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            columns = [*(batch.column(i).take(pa.array(row)) for i in range(2)), pa.array(np.array(runs, dtype=np.int32)[row])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(marks).view(np.int64)), pa.array(np.concatenate(places)), *columns], names=["mark", "place", "doc", "label", "n_runs"]
            )

    return texts.select("id", "label", "hashes").mapInArrow(run, "mark bigint, place int, doc bigint, label bigint, n_runs int")


def _met(mark, low, high, block, place, doc, label, n) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels within each (mark, low, high) that can reach the similarity; rows are sorted by these and label."""
    p, q = SIMILARITY
    n = n.astype(np.int64)
    new = np.concatenate(([True], (mark[1:] != mark[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    other = new | np.concatenate(([True], label[1:] != label[:-1]))
    ends = np.append(np.flatnonzero(new), len(mark))[np.cumsum(new)]
    i = np.arange(len(mark))
    j = np.append(np.flatnonzero(other), len(mark))[np.cumsum(other)]  # the first row of the next label
    left, right, room = [], [], n - place
    while True:
        on = j < ends[i]
        i, j = i[on], j[on]
        if not len(i):
            break
        fits = (p + q) * np.minimum(room[i], room[j]) >= p * (n[i] + n[j])
        fits &= (low[i] == high[i]) | (block[i] != block[j])
        left.append(doc[i[fits]])
        right.append(doc[j[fits]])
        j = j + 1
    return (np.concatenate(left), np.concatenate(right)) if left else (doc[:0], doc[:0])


def _candidates(texts: DataFrame, folder: str) -> DataFrame:
    """All pairs (``doc``, ``leader``) of texts of different labels that can reach the similarity, and some that can't, as a written table."""
    rare = written(_rarest(texts, _frequencies(texts)), f"{folder}/rarest")
    shared = rare.groupBy("mark").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = shared.where("low <> high").select("mark", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # A frequent run is spread over tasks: a row meets each block of the run's texts in a cell of its own.
    rows = rare.join(shared, "mark").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "k"), "high": F.greatest("block", "k")})
    order = ["mark", "low", "high", "label"]
    rows = rows.repartition("mark", "low", "high").sortWithinPartitions(*order).select("mark", "low", "high", "block", "place", "doc", "label", "n_runs")

    def run(batches):
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(8)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            whole = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1])) if len(columns[0]) else ()
            cut = int(whole[-1]) + 1 if len(whole) else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield from out([c[:cut] for c in columns])
        if held is not None and len(held[0]):
            yield from out(held)

    def out(columns):
        a, b = _met(*columns)
        for low in range(0, len(a), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a[part], b[part])), pa.array(np.minimum(a[part], b[part]))], names=["doc", "leader"])

    pairs = written(rows.mapInArrow(run, "doc bigint, leader bigint").distinct(), f"{folder}/pairs")
    remove(texts.sparkSession, f"{folder}/rarest")
    return pairs


def classes(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``class_id`` (least id of the class), ``kept`` (whether the row's id is that) of every row.

    Intermediate tables go below ``folder``, which driver and executors must share.
    """
    spark = docs.sparkSession
    made = fingerprints(docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("said")), "said")
    made = written(made, f"{folder}/prints")
    # One text for each group of copies: summed up before the shuffle, however large a group is.
    least = made.where("print IS NOT NULL AND id IS NOT NULL").groupBy("print").agg(F.min(F.struct("id", "n_runs", "sketches")).alias("x"))
    texts = written(least.select("print", "x.*"), f"{folder}/texts")
    hashes = made.where("n_runs > 0").select("id", "hashes")

    members = texts.where("n_runs > 0").select(F.col("id").alias("doc"), "n_runs", F.explode("sketches").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Most texts meet none; all that follows is over those that do.
    shared = written(members.join(sizes, "bucket"), f"{folder}/shared")
    central = shared.groupBy("doc").agg(F.sum("n").alias("meets"))
    leaders = shared.join(central, "doc").groupBy("bucket").agg(F.max(F.struct("meets", -F.col("n_runs"), -F.col("doc"))).alias("x"))
    leaders = leaders.select("bucket", (-F.col("x.col3")).alias("leader"), (-F.col("x.col2")).alias("leader_runs"))
    met = written(shared.select("bucket", "doc", "n_runs").join(leaders, "bucket").where("doc <> leader"), f"{folder}/met")
    remove(spark, f"{folder}/shared")
    p, q = SIMILARITY
    near = q * F.least("n_runs", "leader_runs") >= p * F.greatest("n_runs", "leader_runs")
    pairs = written(met.where(near).select("doc", "leader").distinct(), f"{folder}/first-pairs")
    # All that may still be compared; the whole table of hashes is shuffled this once.
    needed = met.select(F.explode(F.array("doc", "leader")).alias("id")).distinct()
    hashes = written(hashes.join(needed, "id", "left_semi"), f"{folder}/hashes")
    made = written(made.select("id", "print"), f"{folder}/ids")
    remove(spark, f"{folder}/prints")
    links = _verified(pairs, hashes, f"{folder}/first")
    labels = written(components(links, f"{folder}/first-components", "doc", "leader"), f"{folder}/first-labels")
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    known = met.join(of("doc", "found"), "doc", "left").join(of("leader", "leads"), "leader", "left")
    undecided = known.where(F.coalesce("found", "doc") != F.coalesce("leads", "leader")).select("bucket").distinct()
    rest = met.join(undecided, "bucket", "left_semi").select(F.explode(F.array("doc", "leader")).alias("id")).distinct()
    rest = hashes.join(rest, "id", "left_semi").distinct().join(of("id", "label"), "id", "left")
    rest = written(rest.withColumn("label", F.coalesce("label", "id")), f"{folder}/rest")
    for name in ("met", "first-pairs", "hashes"):
        remove(spark, f"{folder}/{name}")
    more = _verified(_candidates(rest, folder), rest, f"{folder}/second")
    for name in ("rest", "pairs", "first-components"):
        remove(spark, f"{folder}/{name}")
    # The links found last join whole classes of the first labels.
    ends = more.join(of("doc", "of_doc"), "doc", "left").join(of("leader", "of_leader"), "leader", "left")
    ends = ends.select(F.coalesce("of_doc", "doc").alias("a"), F.coalesce("of_leader", "leader").alias("b"))
    joined = components(ends, f"{folder}/components", "a", "b").select(F.col("node").alias("found"), F.col("label").alias("final"))
    found = texts.select("id", "print").join(of("id", "found"), "id", "left").withColumn("found", F.coalesce("found", "id"))
    whole = found.join(joined, "found", "left").select("print", F.coalesce("final", "found").alias("class_id"))
    whole = written(whole, f"{folder}/classes")
    for name in ("texts", "first", "first-labels", "second", "components"):
        remove(spark, f"{folder}/{name}")
    return made.select("id", "print").join(whole, "print", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept"),
    )
