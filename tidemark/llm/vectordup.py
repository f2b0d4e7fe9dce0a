"""Near-duplicate vectors within a label by int8 tile products with error bounds.

Copies of a vector are one row from the start. The distinct vectors of a label are dealt into tiles of about
``TILE`` rows by hash; every two tiles of a label meet once, in a task of bounded size. There the unit
vectors are quantised to int8 with one scale each, and their products, which are exact whole numbers,
approximate the cosines. With x = s q + d, the error of a product is at most
|s q||d'| + |s' q'||d| + |d||d'|, and |d| is measured for each vector. Only pairs that may reach the threshold
within that bound are computed again in double precision, and only these decide.

A task returns, for each vector with links, how many it has in this tile pair and the least vector that it reaches
in it: rows grow with vectors, not with links, also where thousands of vectors are all alike.

Defined cases: a null label, a null, empty or zero vector, or one with a null or non-finite component links with nothing;
vectors of unequal length don't link; rows are scaled by powers of two, so components of any size are compared; a row with a null id links with nothing and is its own class, without an id. Rows that repeat an id and vector count as further copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns, written
from tidemark.llm.components import components, reached

TILE = 1024
THRESHOLD = 0.98
#: For the rounding of the double-precision sums themselves, far above 64-bit and far below int8 steps.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales, the lengths of the rows that they stand for, and the lengths of what they miss."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    stood = q * scale[:, None]
    return q, scale, np.sqrt((stood**2).sum(axis=1)), np.sqrt(((unit - stood) ** 2).sum(axis=1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine and no digit, so that squares of very small or large components stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def linked(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of a row of ``x`` and a row of ``y`` with a cosine of at least ``threshold``."""
    x, y = scaled(x), scaled(y)
    nx, ny = np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))
    (qx, sx, lx, ex), (qy, sy, ly, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    product = (qx.astype(exact) @ qy.astype(exact).T).astype(np.float64)
    product *= sx[:, None]
    product *= sy[None, :]
    product += lx[:, None] * ey[None, :] + ex[:, None] * (ly + ey)[None, :]
    i, j = np.nonzero(product >= threshold - SLACK)
    sure = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 1 << 15):
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        sure[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return i[sure], j[sure]


def tile_links(vecs: list[np.ndarray], weights: list[np.ndarray], values: list[np.ndarray], threshold: float):
    """Links of one tile pair, or within one tile: (vec, number of linked rows, least vec reached) of each vec that has any."""
    if len(values) == 1:
        i, j = linked(values[0], values[0], threshold)
        i, j = i[i != j], j[i != j]
        ids, weight = vecs[0], weights[0]
        counts = np.bincount(i, weight[j], len(ids))
    else:
        i, j = linked(values[0], values[1], threshold)
        ids, weight = np.concatenate(vecs), np.concatenate(weights)
        j = j + len(vecs[0])
        counts = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    least = ids[order][reached(len(ids), rank[i], rank[j])[rank]]
    has = counts > 0
    return ids[has], counts[has].astype(np.int64), least[has]


FIELDS = [T.StructField("print", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("packed", T.BinaryType())]
KEY = ["label", "dim"]


def _prepared(vectors: DataFrame, kind: str) -> DataFrame:
    """Add ``print`` (null if the vector can't link), ``dim`` and the packed components."""

    def start():
        def apply(column: pa.Array) -> list:
            rows = []
            for x in column:
                v = None if not x.is_valid else x.values
                a = None if v is None or v.null_count or not len(v) else np.asarray(v, dtype=kind)
                if a is None or not np.isfinite(a).all() or not a.any():
                    rows.append((None, 0, None))
                else:
                    data = a.tobytes()
                    rows.append((hashlib.blake2b(data, digest_size=16).digest(), len(a), data))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

        return apply

    return add_columns(vectors, ["embedding"], FIELDS, start, drop=("embedding",))


def classes(
    vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, tile: int = TILE,
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row; intermediate tables go below ``folder``."""
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    rows = vectors.select(
        vectors[f"`{id_col}`"].cast("long").alias("vec"), vectors[f"`{label_col}`"].alias("label"), vectors[f"`{vector_col}`"].alias("embedding")
    )
    rows = written(_prepared(rows, kind), f"{folder}/rows")
    valid = rows.where("print IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    distinct = written(
        valid.groupBy("label", "print").agg(F.min(F.struct("vec", "dim", "packed")).alias("x"), F.count("*").alias("copies"))
        .select("label", "print", "x.*", "copies"),
        f"{folder}/distinct",
    )
    sizes = distinct.groupBy(*KEY).agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("tiles"))
    sizes = written(sizes, f"{folder}/sizes")
    dealt = distinct.join(sizes, KEY).withColumn("tile", F.pmod(F.xxhash64("vec", F.lit(7)), F.col("tiles")).cast("int"))

    def pack(key, group):
        return pa.table({
            "label": group["label"][:1], "dim": group["dim"][:1], "tile": group["tile"][:1], "tiles": group["tiles"][:1],
            "vecs": pa.array([group["vec"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "copies": pa.array([group["copies"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "packed": pa.array([b"".join(group["packed"].to_pylist())], pa.binary()),
        })

    label_type = distinct.schema["label"].dataType.simpleString()
    tiles = written(
        dealt.select("label", "dim", "tile", "tiles", "vec", "copies", "packed").groupBy("label", "dim", "tile")
        .applyInArrow(pack, f"label {label_type}, dim int, tile int, tiles int, vecs binary, copies binary, packed binary"),
        f"{folder}/tiles",
    )

    def meet(key, group):
        dim = key[1].as_py()
        parts = sorted(zip(group["tile"].to_pylist(), group["vecs"].to_pylist(), group["copies"].to_pylist(), group["packed"].to_pylist(), strict=True))
        ids, counts, least = tile_links(
            [np.frombuffer(p[1], dtype="<i8") for p in parts],
            [np.frombuffer(p[2], dtype="<i8") for p in parts],
            [np.frombuffer(p[3], dtype=kind).reshape(-1, dim).astype(np.float64) for p in parts],
            threshold,
        )
        return pa.table({"vec": pa.array(ids, pa.int64()), "n": pa.array(counts, pa.int64()), "least": pa.array(least, pa.int64())})

    met = tiles.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumns({
        "low": F.least("tile", "other"), "high": F.greatest("tile", "other"),
    }).select("label", "dim", "low", "high", "tile", "vecs", "copies", "packed")
    found = written(
        met.groupBy("label", "dim", "low", "high").applyInArrow(meet, "vec bigint, n bigint, least bigint"), f"{folder}/found"
    )
    links = found.groupBy("vec").agg(F.sum("n").alias("n"))
    labels = components(found, f"{folder}/components", "vec", "least")
    whole = written(
        distinct.select("label", "print", "vec", "copies").join(links, "vec", "left")
        .join(labels.select(F.col("node").alias("vec"), F.col("label").alias("reached")), "vec", "left")
        .select("label", "print", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("reached", "vec").alias("component_id")),
        f"{folder}/whole",
    )
    ends = rows.select("vec", "label", F.expr("CASE WHEN vec IS NOT NULL THEN print END").alias("print"))
    return ends.join(whole, ["label", "print"], "left").select(
        F.col("vec").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec"), F.lit(True)).alias("kept"),
    )
