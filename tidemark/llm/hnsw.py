"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

The distinct vectors are dealt into shards of about ``SHARD`` by a hash. A task builds the graph of a shard and returns it
as one row: the vectors, and for each layer a flat array of neighbour places with ``-1`` where there is none. Within a
shard nodes stand by falling level, so that layer l is about the first nodes only and needs no map of its own.
The largest inner product becomes the largest cosine by one more component, which brings all vectors to one length.

Nodes enter in batches: each batch walks the graph of those before it side by side, as arrays, and also looks at its own members.
A node keeps the nearest neighbours that aren't nearer to one another than to it, then the nearest of the rest; a full list
is chosen anew in the same way and keeps some room.

Queries go in blocks of bounded size. For each block every task walks the graphs of its shards and holds the best ``k`` of each
query over all of them; these meet by query. Scores are then those of the original vectors, in double precision.

Copies of a vector are one node, with its ``k + 1`` least ids: no more of them can be among the ``k`` nearest.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no
part; of rows that share an id one stays, the one with the least bytes. Vectors of unequal length don't meet. Equal scores go by the
smaller id. Inner products beyond the range of doubles are infinite, as in double arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns, remove, written

SHARD = 4096
#: Neighbours of a node in upper layers; twice as many in the lowest.
DEGREE = 16
BUILD_WIDTH, SEARCH_WIDTH = 100, 160
BATCH = 256
#: Bytes of the queries of a block: bounds what is sent to a task and what it holds.
BLOCK_BYTES = 16 << 20


def levels(n: int, degree: int, seed: int = 7) -> np.ndarray:
    """Falling levels of ``n`` nodes: each level has about 1 / degree of the nodes below it."""
    drawn = np.random.default_rng(seed).random(n)
    return np.sort((-np.log(1.0 - drawn) / np.log(degree)).astype(np.int64))[::-1]


def lifted(x: np.ndarray) -> np.ndarray:
    """Rows of one length, as float32: scaled, with one more component for what each lacks to the longest."""
    y = x / np.abs(x).max()
    lengths = (y**2).sum(axis=1)
    rest = np.sqrt(np.maximum(lengths.max() - lengths, 0.0))
    return (np.column_stack([y, rest]) / np.sqrt(lengths.max())).astype(np.float32)


def walk(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities), best first, -1 where there are fewer: the ``width`` best that each query meets from its entries.

    All queries walk side by side; in a round each opens up to ``step`` of its best nodes that aren't open yet, until none is left.
    """
    b, n = len(queries), len(vectors)
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column is place -1
    seen[:, n] = True
    places = np.full((b, width), -1, dtype=np.int32)
    sims = np.full((b, width), -np.inf, dtype=np.float32)
    entry = entry[:, :width]
    first = np.where(entry >= 0, np.einsum("ijk,ik->ij", vectors[entry], queries), -np.inf)
    order = np.argsort(-first, axis=1, kind="stable")
    places[:, : entry.shape[1]] = np.take_along_axis(entry, order, 1)
    sims[:, : entry.shape[1]] = np.take_along_axis(first, order, 1)
    seen[np.arange(b)[:, None], entry] = True
    opened = places < 0
    live = np.arange(b)
    while len(live):
        own, closed = places[live], ~opened[live]
        count = np.cumsum(closed, axis=1)
        row, col = np.nonzero(closed & (count <= step))
        has = np.zeros(len(live), dtype=bool)
        has[row] = True
        if not has.all():  # those with nothing left to open have ended
            live = live[has]
            continue
        chosen = np.full((len(live), step), -1, dtype=np.int32)
        chosen[row, count[row, col] - 1] = own[row, col]
        opened[live[row], col] = True
        near = links[chosen].reshape(len(live), -1)
        near[np.repeat(chosen < 0, links.shape[1], axis=1)] = -1
        near.sort(axis=1)
        new = ~seen[live[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        if not len(row):
            continue
        found, at = near[row, col], live[row]
        seen[at, found] = True
        s = np.einsum("ij,ij->i", vectors[found], queries[at])
        better = s > sims[at, -1]
        row, found, s = row[better], found[better], s[better]
        if not len(row):
            continue
        start = np.searchsorted(row, np.arange(len(live)))
        place = np.arange(len(row)) - start[row]
        more = int(place.max()) + 1
        all_s = np.full((len(live), width + more), -np.inf, dtype=np.float32)
        all_p = np.full((len(live), width + more), -1, dtype=np.int32)
        all_o = np.ones((len(live), width + more), dtype=bool)
        all_s[:, :width], all_p[:, :width], all_o[:, :width] = sims[live], places[live], opened[live]
        all_s[row, width + place], all_p[row, width + place], all_o[row, width + place] = s, found, False
        order = np.argsort(-all_s, axis=1)[:, :width]
        sims[live], places[live], opened[live] = (np.take_along_axis(x, order, 1) for x in (all_s, all_p, all_o))
    return places, sims


def apart(vectors: np.ndarray, places: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, up to ``most``: first those that no earlier chosen one is nearer to than the row's own node."""
    t, c = places.shape
    v = vectors[places]
    mutual = np.matmul(v, v.transpose(0, 2, 1))
    valid = places >= 0
    chosen = np.zeros((t, c), dtype=bool)
    for j in range(c):
        near = ((mutual[:, j, :] > sims[:, j, None]) & chosen).any(axis=1)
        chosen[:, j] = valid[:, j] & ~near
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(places, order, 1), -1).astype(np.int32)


def best_first(places: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(places, order, 1), np.take_along_axis(sims, order, 1)


def _link_back(vectors: np.ndarray, links: np.ndarray, sources: np.ndarray, chosen: np.ndarray) -> None:
    """Enter each new node with its neighbours, too; a list without room is chosen anew and filled to three quarters."""
    cap = links.shape[1]
    row, col = np.nonzero(chosen >= 0)
    target, source = chosen[row, col], sources[row]
    sim = np.einsum("ij,ij->i", vectors[target], vectors[source])
    order = np.lexsort((-sim, target))
    target, source, sim = target[order], source[order], sim[order]
    ends, start, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(start, count)
    held = (links[ends] >= 0).sum(axis=1)
    fits = np.repeat(held + count <= cap, count)
    links[target[fits], (np.repeat(held, count) + place)[fits]] = source[fits]
    full = np.flatnonzero(held + count > cap)
    for low in range(0, len(full), 1024):
        some = full[low : low + 1024]
        old = links[ends[some]]
        new = np.full((len(some), min(cap, int(count[some].max()))), -1, dtype=np.int32)
        for_row = np.repeat(np.arange(len(some)), count[some])
        at = np.concatenate([np.arange(start[i], start[i] + count[i]) for i in some])
        within = place[at] < new.shape[1]
        new[for_row[within], place[at][within]] = source[at][within]
        both = np.concatenate([old, new], axis=1)
        s = np.where(both >= 0, np.einsum("ijk,ik->ij", vectors[both], vectors[ends[some]]), -np.inf)
        both, s = best_first(both, s, 2 * cap)
        links[ends[some]] = -1
        links[ends[some], : cap * 3 // 4] = apart(vectors, both, s, cap * 3 // 4)


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, batch: int = BATCH) -> list[np.ndarray]:
    """The layers of the graph of ``lifted`` vectors, the lowest first: an array of neighbours for each node of the layer."""
    n = len(vectors)
    level = levels(n, degree)
    sizes = [int((level >= at).sum()) for at in range(int(level[0]) + 1)]
    layers = [np.full((size, degree if at else 2 * degree), -1, dtype=np.int32) for at, size in enumerate(sizes)]
    low = 0
    while low < n:
        top = int(level[low])
        high = min(low + max(16, min(batch, low)), sizes[top])  # one level in a batch
        own, q = np.arange(low, high, dtype=np.int32), vectors[low:high]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        mates = min(len(own), width)
        nearest = np.argsort(-among, axis=1)[:, :mates]
        mate_p = np.where(nearest == np.arange(len(own))[:, None], -1, own[nearest])
        mate_s = np.where(mate_p >= 0, np.take_along_axis(among, nearest, 1), -np.inf)
        entry = np.zeros((len(own), 1), dtype=np.int32)
        if low:
            for at in range(int(level[0]), top, -1):
                entry = walk(vectors, layers[at], q, entry, 4)[0]
        for at in range(top, -1, -1):
            places, sims = mate_p, mate_s
            if low:
                entry, known = walk(vectors, layers[at], q, entry, width)
                places, sims = np.concatenate([entry, mate_p], axis=1), np.concatenate([known, mate_s], axis=1)
            places, sims = best_first(places, sims, width)
            chosen = apart(vectors, places[:, : 4 * degree], sims[:, : 4 * degree], degree)
            layers[at][low:high, : chosen.shape[1]] = chosen
            _link_back(vectors, layers[at], own, chosen)
        low = high
    return layers


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int, batch: int = BATCH) -> np.ndarray:
    """Places of the ``width`` best nodes met by each query, best first, -1 where there are fewer."""
    out = []
    for low in range(0, len(queries), batch):
        q = queries[low : low + batch]
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for links in layers[:0:-1]:
            entry = walk(vectors, links, q, entry, 4)[0]
        out.append(walk(vectors, layers[0], q, entry, width)[0])
    return np.concatenate(out)


FIELDS = [T.StructField("dim", T.IntegerType()), T.StructField("packed", T.BinaryType())]


def vectors_of(rows: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec``, ``dim`` and ``packed`` doubles of each id that takes part, one row an id, written below ``folder``."""

    def start():
        def apply(column: pa.Array) -> list:
            dims, packed = [], []
            for x in column:
                v = x.values if x.is_valid else None
                a = None if v is None or v.null_count or not len(v) else np.asarray(v, dtype="<f8")
                good = a is not None and bool(np.isfinite(a).all()) and bool(a.any())
                dims.append(len(a) if good else None)
                packed.append(a.tobytes() if good else None)
            return [dims, packed]

        return apply

    named = rows.select(rows[f"`{id_col}`"].cast("long").alias("vec"), rows[f"`{vector_col}`"].alias("embedding"))
    valid = add_columns(named, ["embedding"], FIELDS, start, drop=("embedding",)).where("vec IS NOT NULL AND packed IS NOT NULL")
    return written(valid.groupBy("vec").agg(F.min(F.struct("packed", "dim")).alias("x")).select("vec", "x.dim", "x.packed"), f"{folder}/vectors")


#: Most tasks of a stage over shards; with more shards a task takes several.
MOST_TASKS = 20_000


def _tasks(n: int) -> int:
    return max(1, min(n, MOST_TASKS))


GRAPH = "dim int, shard int, ids binary, counts binary, packed binary, layers array<binary>"


def index(vectors: DataFrame, folder: str, k: int, shard: int = SHARD, degree: int = DEGREE, width: int = BUILD_WIDTH) -> DataFrame:
    """A row for each shard of ``vectors_of``: its nodes' vectors, the ids of each, and the layers as flat arrays."""
    place = F.row_number().over(Window.partitionBy("dim", "packed").orderBy("vec"))
    nodes = written(
        vectors.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("dim", "packed").agg(F.sort_array(F.collect_list("vec")).alias("vecs")),
        f"{folder}/nodes",
    )
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(shard))).cast("int").alias("shards"))
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("packed", F.lit(7)), F.col("shards")).cast("int"))

    def make(key, group):
        dim = key[0].as_py()
        group = group.sort_by([("mix", "ascending"), ("packed", "ascending")])
        packed = b"".join(group["packed"].to_pylist())
        layers = build(lifted(np.frombuffer(packed, dtype="<f8").reshape(-1, dim)), degree, width)
        vecs = group["vecs"].to_pylist()
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([np.array([i for v in vecs for i in v], dtype="<i8").tobytes()], pa.binary()),
            "counts": pa.array([np.array([len(v) for v in vecs], dtype="<i4").tobytes()], pa.binary()),
            "packed": pa.array([packed], pa.binary()),
            "layers": pa.array([[x.astype("<i4").tobytes() for x in layers]], pa.list_(pa.binary())),
        })

    # A graph is much work for few bytes, so shards are spread over tasks by their number and not by their size.
    parts = _tasks(2 * (sizes.agg(F.sum("shards").alias("n")).first()["n"] or 1))
    some = dealt.select("dim", "shard", F.xxhash64("packed", F.lit(11)).alias("mix"), "packed", "vecs").repartition(parts, "dim", "shard")
    graphs = written(some.groupBy("dim", "shard").applyInArrow(make, GRAPH), f"{folder}/graphs")
    remove(vectors.sparkSession, f"{folder}/nodes")
    return graphs


def nearest_first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ``k`` highest scores, equal ones by id; absent ones have a score of NaN and come last."""
    order = np.lexsort((ids, -scores, np.isnan(scores)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def meet(graph: dict, degree: int, own: np.ndarray, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` nearest that each query finds in one shard, its own id left out."""
    x = np.frombuffer(graph["packed"], dtype="<f8").reshape(-1, graph["dim"])
    layers = [np.frombuffer(b, dtype="<i4").reshape(-1, degree if at else 2 * degree) for at, b in enumerate(graph["layers"])]
    counts, flat = np.frombuffer(graph["counts"], dtype="<i4"), np.frombuffer(graph["ids"], dtype="<i8")
    copies = np.zeros((len(counts), int(counts.max())), dtype=np.int64)
    held = np.arange(copies.shape[1]) < counts[:, None]
    copies[held] = flat
    vectors = lifted(x)
    found_ids, found_scores = [], []
    for low in range(0, len(queries), BATCH):
        q, mine = queries[low : low + BATCH], own[low : low + BATCH]
        scaled = q / np.abs(q).max(axis=1)[:, None]
        turned = np.column_stack([scaled / np.sqrt((scaled**2).sum(axis=1))[:, None], np.zeros(len(q))]).astype(np.float32)
        places = search(vectors, layers, turned, max(width, k + 1))
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.stack([(x[p] * v).sum(axis=1) for p, v in zip(places, q, strict=True)])
        ids = copies[places].reshape(len(q), -1)
        there = (held[places] & (places >= 0)[:, :, None]).reshape(len(q), -1) & (ids != mine[:, None])
        i, s = nearest_first(ids, np.where(there, np.repeat(scores, copies.shape[1], axis=1), np.nan), k)
        found_ids.append(i)
        found_scores.append(s)
    return np.concatenate(found_ids), np.concatenate(found_scores)


def nearest(
    graphs: DataFrame, queries: DataFrame, folder: str, k: int, degree: int = DEGREE, width: int = SEARCH_WIDTH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found for each row of ``queries`` (as from ``vectors_of``)."""
    spark = graphs.sparkSession
    total = queries.agg(F.sum(F.octet_length("packed")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = written(queries.withColumn("block", F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(blocks))), f"{folder}/queries")
    schema = "query_id bigint, vec_id bigint, score double"
    parts = _tasks(graphs.count())
    path = f"{folder}/found"
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("vec", "dim", "packed").toArrow()  # about ``block_bytes``
        by_dim: dict[int, tuple[list, list]] = {}
        for vec, dim, packed in zip(rows["vec"].to_pylist(), rows["dim"].to_pylist(), rows["packed"].to_pylist(), strict=True):
            own, data = by_dim.setdefault(dim, ([], []))
            own.append(vec)
            data.append(packed)
        sent = spark.sparkContext.broadcast({dim: (np.array(own, dtype=np.int64), b"".join(data)) for dim, (own, data) in by_dim.items()})

        def task(batches, sent=sent):
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    graph = {c: batch.column(c)[at].as_py() for c in ("dim", "ids", "counts", "packed", "layers")}
                    dim = graph["dim"]
                    if dim not in sent.value:
                        continue
                    own, data = sent.value[dim]
                    met = meet(graph, degree, own, np.frombuffer(data, dtype="<f8").reshape(-1, dim), k, width)
                    if dim in best:
                        met = nearest_first(*[np.concatenate(x, axis=1) for x in zip(best[dim], met, strict=True)], k)
                    best[dim] = met
            for dim, (ids, scores) in best.items():
                own = np.repeat(sent.value[dim][0], ids.shape[1])
                there = ~np.isnan(scores.ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[there]), pa.array(ids.ravel()[there]), pa.array(scores.ravel()[there])], names=["query_id", "vec_id", "score"]
                )

        graphs.drop("shard").repartition(parts).mapInArrow(task, schema).write.mode("append").parquet(path)
        sent.destroy()
    remove(spark, f"{folder}/queries")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = spark.read.schema(schema).parquet(path).withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
