"""Profiles, summaries and consolidated reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import selection


def overview(cases: DataFrame) -> DataFrame:
    """One row: counts, distinct companies and ids, date bounds, positives and rate."""
    return cases.agg(
        F.count("*").alias("records"), F.countDistinct("record_id").alias("records_distinct"), F.countDistinct("company").alias("companies"),
        F.min("opening_date").alias("first_date"), F.max("opening_date").alias("last_date"),
        F.avg(F.col("target_resolved").cast("double")).alias("rate"), C.count_if(F.col("target_resolved") == 1).alias("positives"),
    )


def shares(cases: DataFrame, key: str) -> DataFrame:
    """Count and share of all rows by one key."""
    counts = cases.groupBy(key).agg(F.count("*").alias("records"))
    return counts.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy()))


def group_rates(cases: DataFrame, key, name: str) -> DataFrame:
    """Rows, observed rows, observation rate and outcome rate by a key; unobserved rows have a null target."""
    seen = F.col("target_resolved").isNotNull()
    return cases.groupBy(key.alias(name)).agg(
        F.count("*").alias("records"), C.count_if(seen).alias("observed"), F.avg(seen.cast("double")).alias("observed_rate"),
        F.avg(F.col("target_resolved").cast("double")).alias("rate"), F.min("opening_date").alias("first_date"), F.max("opening_date").alias("last_date"),
    )


def long_values(cases: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, value: a row for each column."""
    return cases.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("x")).select(*keys, "x.*")


def distribution(cases: DataFrame, columns: list[str], keys: list[str], approximate: bool = False) -> DataFrame:
    """feature, mean, median, p90, p95, max by keys; exact interpolated percentiles unless ``approximate``.

    The exact ones come from places in a total order (``selection``), so that no task holds the values of a group.
    """
    long = long_values(cases, columns, keys)
    plain = [F.avg("value").alias("mean"), F.max("value").alias("max")]
    wanted = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    if approximate:
        return long.groupBy(*keys, "feature").agg(*plain, *[F.percentile_approx("value", q, 10_000).alias(name) for name, q in wanted.items()])
    means = long.groupBy(*keys, "feature").agg(*plain).withColumnsRenamed({k: f"mean_{k}" for k in keys})
    found = selection.quantiles(long, [*keys, "feature"], "value", wanted).drop("n").withColumnRenamed("feature", "feature_")
    same = [F.col("feature") == F.col("feature_"), *[F.col(f"mean_{k}").eqNullSafe(F.col(k)) for k in keys]]
    return means.join(found, same, "left").select(*[F.col(f"mean_{k}").alias(k) for k in keys], "feature", "mean", *wanted, "max")


def metric_summary(metrics: DataFrame, keys: list[str], values: list[str], single: float | None = 0.0) -> DataFrame:
    """Mean, sample deviation, least and greatest of each value by keys; ``single`` is the deviation of one row."""
    out = [F.countDistinct("fold").alias("folds")]
    for v in values:
        spread = F.stddev_samp(v)
        out += [
            F.avg(v).alias(f"{v}_mean"), (F.coalesce(spread, F.lit(single)) if single is not None else spread).alias(f"{v}_std"),
            F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"),
        ]
    return metrics.groupBy(*keys).agg(*out)


def fold_pivot(metrics: DataFrame, models: list[str], value: str = "macro_f1") -> DataFrame:
    return metrics.groupBy("fold").pivot("model", models).agg(F.first(value))


def weighted_mean(values: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return values.groupBy(*keys).agg(C.ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight), None).alias("weighted_mean"))


def segment_summary(metrics: DataFrame, keys: list[str], values: list[str], weighted: str) -> DataFrame:
    """``metric_summary`` by segment, its records, and one value weighted by records."""
    total = metrics.groupBy(*keys).agg(
        F.sum("records").cast("long").alias("records"), C.ratio(F.sum(F.col(weighted) * F.col("records")), F.sum("records"), None).alias("weighted_mean")
    )
    return metric_summary(metrics, keys, values).join(total, keys)


def monthly_trend(monthly: DataFrame, keys: list[str], value: str = "macro_f1") -> DataFrame:
    """Least-squares slope of a monthly value on the month's number, 0 for one month; with mean and bounds."""
    placed = monthly.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy("month")) - 1).cast("double"))
    return placed.groupBy(*keys).agg(
        F.coalesce(F.regr_slope(value, "i"), F.lit(0.0)).alias("slope"), F.count("*").alias("months"), F.avg(value).alias("mean"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    )


def ablations(metrics: DataFrame, pairs: list[tuple[str, str]], value: str = "macro_f1") -> DataFrame:
    """base, extended, mean, deviation, bounds and improved folds of the extended model's gain over the base."""
    spark = metrics.sparkSession
    named = F.broadcast(spark.createDataFrame(pairs, "base string, extended string"))
    a = metrics.select("fold", F.col("model").alias("base"), F.col(value).alias("x"))
    b = metrics.select("fold", F.col("model").alias("extended"), F.col(value).alias("y"))
    gain = named.join(a, "base").join(b, ["extended", "fold"]).withColumn("gain", F.col("y") - F.col("x"))
    return gain.groupBy("base", "extended").agg(
        F.count("*").alias("folds"), F.avg("gain").alias("mean"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("std"), F.min("gain").alias("least"),
        F.max("gain").alias("most"), C.count_if(F.col("gain") > 0).alias("improved"),
    )


def seed_stability(metrics: DataFrame, value: str = "macro_f1") -> DataFrame:
    """Mean over folds by model and seed, then mean, sample deviation and bounds over seeds."""
    each = metrics.groupBy("model", "seed").agg(F.avg(value).alias("v"))
    return each.groupBy("model").agg(
        F.count("*").alias("seeds"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most")
    )


def union_padded(tables: list[DataFrame]) -> DataFrame:
    """All rows under all columns, null where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def best_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group under a lexicographic order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where("place = 1").drop("place")


def in_order(df: DataFrame, key: str, order: list[str], then: list[str]) -> DataFrame:
    """Sorted by the position of ``key`` in a given list, then by columns; adds ``position``."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(key))
    return df.withColumn("position", place).orderBy("position", *then)


def grid(tables: list[DataFrame], limit: int = 10_000) -> DataFrame:
    """Every combination of hyper-parameter candidates, which are the result; a table of up to ``limit`` rows is sent to the others, a longer one isn't."""

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        small = b.limit(limit + 1).count() <= limit
        return a.crossJoin(F.broadcast(b) if small else b)

    return reduce(beside, tables)


def totals(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and total of each value by keys, as for recorded seconds."""
    return df.groupBy(*keys).agg(*[f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("total", F.sum))])


def shuffled(df: DataFrame, key: str) -> DataFrame:
    """A deterministic order that looks random: by ``order_hash``, the MD5 digest of a key, then the key."""
    return df.withColumn("order_hash", F.md5(F.col(key).cast("string"))).orderBy("order_hash", key)


def by_count(df: DataFrame, key: str) -> DataFrame:
    """key, n and ``position``, the most frequent first, ties by key; the table has a row for each value of the key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return ranked(counts, "n", key).orderBy("position")


def ranked(counts: DataFrame, n: str, key: str) -> DataFrame:
    """Add ``position`` by descending ``n``, then key; ties of any number stay spread, as places come from a table in order."""
    return selection.placed(counts, [F.desc(n), F.col(key)])


def significant(tests: DataFrame, p: str, size: str, level: float = 0.05) -> DataFrame:
    """Tests below ``level``, the smallest p-value first, then the largest effect either way."""
    return tests.where(F.col(p) < level).orderBy(p, F.desc(F.abs(size)))
