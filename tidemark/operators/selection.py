"""Places and exact quantiles in a total order without a task that holds a group.

A table is written range by range in order, so a file holds one range of bounded size; places come from the rows before a file
and the place within it. One value or key may hold any share of the rows: it only makes several files or a larger count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import files


def running(df: DataFrame, order: list[Column], weight: str | None = None) -> DataFrame:
    """Add ``before_``: the sum of ``weight`` (or the count) of all rows before, in a total order; ties go by all columns.

    The table is written once, below the shared folder, and read from there.
    """
    path = files.shared(df.sparkSession)
    files.write_ordered(df, path, [*order, *[F.col(f"`{c}`") for c in df.columns]])
    read = df.sparkSession.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    one = F.col(weight) if weight else F.lit(1)
    earlier = Window.orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = read.groupBy("file_").agg(F.sum(one).alias("sum_")).select("file_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("start_"))
    inside = Window.partitionBy("file_").orderBy("row_").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(one).over(inside), F.lit(0)) if weight else F.col("row_")
    return read.withColumn("inside_", held).join(F.broadcast(starts), "file_").withColumn("before_", F.col("start_") + F.col("inside_")).drop("file_", "row_", "start_", "inside_")


def placed(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the place of each row, from 1."""
    return running(df, order).withColumn(name, (F.col("before_") + 1).cast("long")).drop("before_")


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys, n, and the exact interpolated quantiles of ``value`` by keys, each under its name; nulls don't count.

    With n values the quantile q lies at place q (n - 1), from 0, between its two neighbours. Equal values are counted first, on both
    sides of the shuffle; the counts are put in order, and of each key the few rows that hold a wanted place are kept. Nulls are a key like any other.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value_")).agg(F.count("*").alias("n_"))
    return quantiles_of(counts, keys, wanted)


def quantiles_of(counts: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """``quantiles`` from keys, value_ and how often each value occurs, n_."""
    named = counts.withColumnsRenamed({k: f"key_{i}_" for i, k in enumerate(keys)})
    own = [f"key_{i}_" for i in range(len(keys))]
    ordered = running(named, [*[F.col(k) for k in own], F.col("value_")], "n_")
    totals = ordered.groupBy(*own).agg(F.min("before_").alias("first_"), F.sum("n_").alias("total_"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in own]
    joined = ordered.alias("o").join(totals.alias("t"), same) if own else ordered.alias("o").join(F.broadcast(totals.alias("t")), F.lit(True))  # one row
    rows = joined.select(*[F.col(f"o.{k}").alias(k) for k in own], "value_", "n_", "total_", (F.col("before_") - F.col("first_")).alias("low_"))
    out, near = [], []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total_") - 1)
        here = lambda p: (F.col("low_") <= p) & (p < F.col("low_") + F.col("n_"))
        near += [here(F.floor(place)), here(F.ceil(place))]
        # Both neighbours of each place; the upper one counts by how far the place lies beyond the lower.
        out.append((F.max(F.when(here(F.floor(place)), F.col("value_"))), F.max(F.when(here(F.ceil(place)), F.col("value_"))), F.max(place - F.floor(place)), name))
    some = rows.where(F.array_contains(F.array(*near), True))
    found = some.groupBy(*own).agg(F.max("total_").alias("n"), *[c.alias(f"{kind}_{name}") for a, b, c_, name in out for kind, c in (("low", a), ("high", b), ("part", c_))])
    return found.select(
        *[F.col(k).alias(name) for k, name in zip(own, keys, strict=True)], "n",
        *[(F.col(f"low_{name}") + F.col(f"part_{name}") * (F.col(f"high_{name}") - F.col(f"low_{name}"))).alias(name) for name in wanted],
    )
