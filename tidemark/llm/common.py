"""Helpers that the corpus operators share: table access, Arrow column maps, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, as in tests, it lies in the warehouse; a cluster whose warehouse is a folder of one machine needs the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-tables"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here and survives lost executors.

    A written table carries no partitioning, so joins on it shuffle both sides and
    adaptive execution may split a skewed key.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: A batch is handed to Python functions in slices of about so many bytes, so that what a worker holds doesn't grow with batches.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of about ``size`` bytes, if they are of like length; none for a batch without rows."""
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    start: Callable[[], Callable[..., list]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append columns that an Arrow-batch function computes from ``inputs``.

    ``start`` runs once for each task and returns a function from the input columns
    (Arrow arrays) to one list or Arrow array for each of ``fields``. Every other column passes
    through untouched; an existing column with the name of a new one is replaced.
    """
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in names and c not in drop]
    fed = {c: f"__in_{i}" for i, c in enumerate(inputs) if c not in keep}  # a kept column is sent once
    source = df.select(*[df[f"`{c}`"] for c in keep], *[df[f"`{c}`"].alias(a) for c, a in fed.items()])
    sent = [*keep, *fed]
    places = [sent.index(c) for c in inputs]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        apply = start()
        for batch in batches:
            for part in slices(batch):
                made = apply(*[part.column(i) for i in places])
                made = [m if isinstance(m, pa.Array) else pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=keep + names)
                del part, made
            del batch
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string of an Arrow column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
