"""Scans and sinks: all-string CSV, pruned Parquet scans, compressed, ordered and write-once tables, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_KEYS = ["model", "fold", "split"]
PREDICTION = "record_id string, opening_date date, target_resolved int, score double, prediction int, model string, fold int"


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Where that is unset, as in tests, it lies in the warehouse; a cluster whose warehouse is a folder of one machine needs the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-tables"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """The table written to a new shared folder and read from there, for plans that use it several times; in folders ``by`` columns of few values."""
    path = shared(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_corpus_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column a string; nothing is inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def scan(df: DataFrame, columns: list[str], start: str | None = None, end: str | None = None, date_col: str = "opening_date") -> DataFrame:
    """Chosen columns within inclusive date bounds; both reach the Parquet reader."""
    if start:
        df = df.where(F.col(date_col) >= F.lit(start).cast(df.schema[date_col].dataType))
    if end:
        df = df.where(F.col(date_col) < F.date_add(F.lit(end).cast("date"), 1).cast(df.schema[date_col].dataType))
    return df.select(*columns)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, once: bool = False) -> None:
    """Parquet with Zstandard; ``once`` leaves an existing table as it is. The committer makes a write all or nothing."""
    writer = df.write.mode("ignore" if once else "overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_once(spark: SparkSession, folder: str, outputs: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The named tables below ``folder``; those that its manifest lists are read, the others are made, and then all of them count at once.

    Missing tables are written below ``_staging``, where a run that was cut off finds those that it had finished, and moved into place; the rename of
    the manifest, the last step, makes the set valid. Without a manifest that has all names nothing below ``folder`` is taken for a table.
    """
    system, path = _file_system(spark, folder)
    manifest = f"{folder}/_manifest"
    listed = set(spark.read.text(manifest).toPandas()["value"]) if system.exists(path(manifest)) else set()  # a row for each table
    missing = [name for name in outputs if name not in listed]
    for name in missing:
        staged, placed = f"{folder}/_staging/{name}", f"{folder}/{name}"
        if system.exists(path(f"{placed}/_SUCCESS")) and not system.exists(path(staged)):
            continue  # moved into place before the run was cut off
        if not system.exists(path(f"{staged}/_SUCCESS")):
            write_table(outputs[name](), staged)
    for name in missing:
        staged, placed = path(f"{folder}/_staging/{name}"), path(f"{folder}/{name}")
        if system.exists(staged):
            system.delete(placed, True)
            if not system.rename(staged, placed):
                raise OSError(f"{staged} can't be moved")
    if missing:
        new = f"{folder}/_staging_manifest"
        spark.createDataFrame([(name,) for name in sorted(listed | set(missing))], "value string").coalesce(1).write.mode("overwrite").text(new)
        system.delete(path(manifest), True)
        if not system.rename(path(new), path(manifest)):
            raise OSError(f"{new} can't be moved")
        system.delete(path(f"{folder}/_staging"), True)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in outputs}


def _file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and the maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def write_ordered(df: DataFrame, path: str, order: list) -> None:
    """A totally ordered table: range partitioned, each file sorted, file names in order."""
    df.orderBy(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_ordered`` with ``position``: rows of the files before, in order of their names, and within the file."""
    read = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    before = Window.orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = read.groupBy("file_").agg(F.count("*").alias("rows_")).select("file_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("start_"))
    return read.join(F.broadcast(files), "file_").withColumn("position", F.col("start_") + F.col("row_") + 1).drop("file_", "row_", "start_")


def bucketed(df: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """The table stored in buckets by ``key``, each a sorted file: joins and groups on the key, of tables with as many buckets, need no shuffle.

    The files lie in a new shared folder, under a table name of the session's catalog (``drop_bucketed`` takes the name out again). Pay the one shuffle here
    where a table is joined more than once, as features, history and predictions are by record.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").option("path", shared(spark)).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def drop_bucketed(spark: SparkSession) -> None:
    """Take all names of ``bucketed`` out of the catalog; the files stay."""
    for table in spark.catalog.listTables():
        if table.name.startswith("bucketed_"):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")


def write_predictions(df: DataFrame, path: str) -> None:
    """Long predictions with declared types, in folders by model and fold; large groups are spread over several files."""
    typed = df.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(PREDICTION)])
    write_table(typed.hint("rebalance", "model", "fold"), path, ["model", "fold"])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions below a folder; types are declared, so that ids that look like numbers stay strings."""
    return spark.read.schema(PREDICTION).parquet(path)


@contextmanager
def registered(df: DataFrame) -> Iterator[str]:
    """A name under which SQL finds the frame while the block lasts; plans made within it stay valid."""
    name = f"frame_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_reports(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The rows of all report files of one kind, with declared types: ids stay strings."""
    return spark.read.csv(paths, schema=schema, header=True)


def predictions_long(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One long table from each model's (table, score column, prediction column)."""
    shaped = [
        df.select(
            F.lit(model).alias("model"), "fold", "split", "record_id", "opening_date", "target_resolved",
            F.col(score).cast("double").alias("score"), F.col(prediction).cast("int").alias("prediction"),
        )
        for model, (df, score, prediction) in tables.items()
    ]
    return reduce(DataFrame.unionByName, shaped)


def missing_columns(df: DataFrame, required: set[str]) -> list[str]:
    """Required columns that the table lacks."""
    return sorted(required - set(df.columns))
