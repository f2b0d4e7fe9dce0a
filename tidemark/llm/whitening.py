"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

An entry c becomes x = floor(64 c) + 1000000. With the sums S over the n vectors, the rows of A are x - S / n, centred in whole
numbers before the one division. From a random unit vector v the steps alternate

    a u = A v - b u'        (u' the u before)        b v" = Aᵀ u - a v        (v" the v after)

with u made orthogonal to all earlier u, and v to all earlier v, twice: u first by the kept Aᵀ u', then by sums over the rows. A step is a pass of Spark
over the written rows, which forms A v and from it Aᵀ u, and sends back sums of a length that the dimension bounds. A u is as long as the table, so it
isn't kept: each is A c for a short c, and tasks form it from their rows again. Where a or b vanishes the walk goes on from a new random vector; it ends when the space is used up, or when
the wanted deviations stand, also after a walk from a new vector, which would find a deviation that occurs twice. The singular values
and right vectors of the small bidiagonal matrix give the deviations and, with the v, the components.

Defined cases: rows whose vector is null or empty, or holds null, non-finite or huge (2^40 and beyond) entries are dropped, as are vectors that don't have the most
common length (of several, the greatest). Rows that repeat an id count each; a null id stays. Directions in which the vectors don't
vary give no component, so a table of equal vectors, or none, gives no rows. A component's sign is that of its largest entry, made positive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns, slices, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
HUGE = float(1 << 40)
#: Deviations below this share of the largest are none.
LEAST = 1e-8
SETTLED = 1e-14


def whole(rows: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec`` and ``packed`` whole numbers of each row that stays, written below ``folder``, and the dimension."""

    def start():
        def apply(column: pa.Array) -> list:
            dims, packed = [], []
            for x in column:
                v = x.values if x.is_valid else None
                a = None if v is None or v.null_count or not len(v) else np.asarray(v, dtype=np.float64)
                good = a is not None and bool((np.abs(a) < HUGE).all())
                dims.append(len(a) if good else None)
                packed.append((np.floor(SCALE * a).astype("<i8") + OFFSET).tobytes() if good else None)
            return [dims, packed]

        return apply

    fields = [T.StructField("dim", T.IntegerType()), T.StructField("packed", T.BinaryType())]
    named = rows.select(rows[f"`{id_col}`"].cast("long").alias("vec"), rows[f"`{vector_col}`"].alias("embedding"))
    kept = written(add_columns(named, ["embedding"], fields, start, drop=("embedding",)).where("packed IS NOT NULL"), f"{folder}/whole")
    common = kept.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    return kept.where(F.col("dim") == dim), dim


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many rows, and the sum of each dimension."""

    def task(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            x = _numbers(batch.column("packed"), dim)
            n += len(x)
            high, low = (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)
            total = [t + (int(h) << 24) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in [n, *total]], pa.string())], names=["place", "said"]
            )

    sums = rows.select("packed").mapInArrow(task, "place int, said string").groupBy("place").agg(F.sum(F.col("said").cast("decimal(38,0)")).alias("v"))
    found = {r["place"]: int(r["v"]) for r in sums.collect()}  # a row for each dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dim)


class Centre:
    """Centres rows of whole numbers: n x - S exactly, and x - S / n in double precision."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.near = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n

    def squares(self, x: np.ndarray) -> list[int]:
        """Of each row the sum of (n x - S)^2."""
        y = x - self.near
        most = float(np.abs(y).max(initial=0) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            z = self.n * y - self.rest
            return (z * z).sum(axis=1).tolist()
        return [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in y]


def summed(rows: DataFrame, dim: int, centre: Centre, size: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all centred rows of ``make``, which gives ``size`` numbers for some rows; one row a number reaches the driver."""

    def task(batches):
        total = np.zeros(size)
        for batch in batches:
            for part in slices(batch):
                total += make(centre.rows(_numbers(part.column("packed"), dim)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "v"])

    out = np.zeros(size)
    for r in rows.select("packed").mapInArrow(task, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r["place"]] = r["v"]
    return out


def bidiagonalise(
    both: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], dim: int, wanted: int, seed: int = 11,
) -> tuple[np.ndarray, np.ndarray]:
    """(deviations, components as rows), the largest first: singular values of A and its right vectors, ``wanted`` at most.

    ``both(c, C)`` gives Uᵀ p, |p|², Aᵀ p for p = A c and U = A C.
    """
    rng = np.random.default_rng(seed)
    vs, cs, ws = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))  # the v, the c of each u = A c, and Aᵀ u
    small = np.zeros((0, 0))

    def fresh() -> np.ndarray:
        while True:
            v = rng.standard_normal(dim)
            for _ in range(3):
                v -= vs @ (vs.T @ v)
            if np.linalg.norm(v) > 1e-6:
                return v / np.linalg.norm(v)

    v, beta, largest, stood, since = fresh(), 0.0, 0.0, None, 0
    while True:
        j = vs.shape[1]
        vs = np.column_stack([vs, v])
        c = v - (beta * cs[:, j - 1] if j else 0.0)
        if j:
            c = c - cs @ (ws.T @ v - beta * np.eye(j)[j - 1])  # A v against all earlier u
        again, square, back = both(c, cs)
        alpha = float(np.sqrt(max(square - again @ again, 0.0)))
        largest = max(largest, alpha, beta)
        grown = np.zeros((j + 1, j + 1))
        grown[:j, :j] = small
        if j:
            grown[j - 1, j] = beta
        if alpha > LEAST / 100 * largest:
            c = (c - cs @ again) / alpha
            grown[j, j] = alpha
            w = (back - ws @ again) / alpha
        else:
            c, w = np.zeros(dim), np.zeros(dim)
        q = w - alpha * v
        cs, ws, small = np.column_stack([cs, c]), np.column_stack([ws, w]), grown
        left, values, right = np.linalg.svd(small)
        if j + 1 == dim:
            break
        for _ in range(2):
            q = q - vs @ (vs.T @ q)
        beta, since = float(np.linalg.norm(q)), since + 1
        asked = min(wanted, dim)
        done = j + 1 >= asked and bool((beta * np.abs(left[-1, :asked]) <= SETTLED * values[0]).all())
        if done and since > min(10, dim - j - 2):  # else the walk from a new vector has only begun
            now = values[:asked]
            if stood is not None and np.allclose(now, stood, rtol=1e-13, atol=1e-13 * values[0]):
                break
            stood, since, beta = now, 0, 0.0
        if beta > LEAST / 100 * largest:
            v = q / beta
        else:
            v, beta = fresh(), 0.0
    kept = int((values > LEAST * values[0]).sum()) if values[0] > 0 else 0
    kept = min(kept, wanted)
    components = (vs @ right[:kept].T).T
    turn = np.sign(components[np.arange(kept), np.abs(components).argmax(axis=1)]) if kept else np.zeros(0)
    return values[:kept], components * turn[:, None]


SCHEMA = "vec long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, folder: str, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``component``, ``n``, ``deviation`` (a decimal), ``whitened``, ``explained``, ``identity_error`` of each vector and component."""
    spark = rows.sparkSession
    kept, dim = whole(rows, folder, id_col, vector_col)
    n, sums = exact_sums(kept, dim) if dim else (0, [])
    if not n:
        return spark.createDataFrame([], SCHEMA).withColumnRenamed("vec", id_col)
    centre = Centre(n, sums)

    def both(c, cs):
        k = cs.shape[1]

        def make(x):
            p = x @ c
            return np.concatenate([(x @ cs).T @ p, [p @ p], x.T @ p])

        got = summed(kept, dim, centre, k + 1 + dim, make)
        return got[:k], float(got[k]), got[k + 1 :]

    trace = float(summed(kept, dim, centre, 1, lambda x: np.array([(x * x).sum()]))[0])
    values, found = bidiagonalise(both, dim, components) if trace > 0 else (np.zeros(0), np.zeros((0, dim)))
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA).withColumnRenamed("vec", id_col)
    onto = found.T / (values / np.sqrt(n))
    moments = summed(kept, dim, centre, k * k + k, lambda x: np.concatenate([((x @ onto).T @ (x @ onto)).ravel(), (x @ onto).sum(axis=0)])) / n
    mean = moments[k * k :]
    error = float(np.abs(moments[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = values**2 / trace

    def task(batches):
        from decimal import Decimal

        for batch in batches:
            for part in slices(batch, 1 << 20):
                x = _numbers(part.column("packed"), dim)
                squares = pa.array([Decimal(v) for v in centre.squares(x)], pa.decimal128(38, 0))
                m, each = len(x), np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                        squares.take(pa.array(each)), pa.array((centre.rows(x) @ onto).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.select("vec", "packed").mapInArrow(task, SCHEMA).withColumnRenamed("vec", id_col)
