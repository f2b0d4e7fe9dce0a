"""Expanding-window temporal folds as a small table, and the assignment of cases to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def fold_candidates(spark: SparkSession, first_validation: str, observation_end: str, validation: int = 3, test: int = 3, step: int = 3) -> DataFrame:
    """Contiguous windows of whole months up to and including the first whose test window isn't complete."""
    starts = spark.sql(
        f"SELECT posexplode(sequence(DATE '{first_validation}', DATE '{observation_end}', INTERVAL {int(step)} MONTH)) AS (i, validation_start)"
    )
    made = starts.select(
        (F.col("i") + 1).cast("int").alias("fold"),
        F.date_sub("validation_start", 1).alias("train_end"),
        "validation_start",
        F.date_sub(F.add_months("validation_start", validation), 1).alias("validation_end"),
        F.add_months("validation_start", validation).alias("test_start"),
        F.date_sub(F.add_months("validation_start", validation + test), 1).alias("test_end"),
    ).withColumn("complete", F.col("test_end") <= F.lit(observation_end).cast("date"))
    before = F.lag("complete", 1, True).over(Window.orderBy("fold"))  # a row for each window
    return made.withColumn("before", before).where("complete OR before").drop("before")


def temporal_folds(spark: SparkSession, first_validation: str, observation_end: str, validation: int = 3, test: int = 3, step: int = 3) -> DataFrame:
    """fold, train_end, validation_start, validation_end, test_start, test_end of the complete windows."""
    return fold_candidates(spark, first_validation, observation_end, validation, test, step).where("complete").drop("complete")


def fold_faults(folds: DataFrame) -> DataFrame:
    """Folds that are misnumbered, overlap inside, or don't follow each other; empty if all is well."""
    w = Window.orderBy("fold")
    checked = folds.withColumns({"place": F.row_number().over(w), "previous": F.lag("validation_start").over(w)})
    return checked.where(
        "fold <> place OR train_end >= validation_start OR date_add(train_end, 1) <> validation_start"
        " OR date_add(validation_end, 1) <> test_start OR validation_end < validation_start OR test_end < test_start"
        " OR validation_start <= previous"
    ).select("fold")


def splits(folds: DataFrame, train_start: str) -> DataFrame:
    """One row for each fold and split, with its first and last day."""
    return folds.select("fold", F.explode(F.array(
        F.struct(F.lit("train").alias("split"), F.lit(train_start).cast("date").alias("low"), F.col("train_end").alias("high")),
        F.struct(F.lit("validation").alias("split"), F.col("validation_start").alias("low"), F.col("validation_end").alias("high")),
        F.struct(F.lit("test").alias("split"), F.col("test_start").alias("low"), F.col("test_end").alias("high")),
    )).alias("s")).select("fold", "s.*")


def assign(cases: DataFrame, windows: DataFrame, date_col: str = "opening_date") -> DataFrame:
    """Each case once for each window that holds its date; the windows are a handful of rows and are broadcast."""
    return cases.join(F.broadcast(windows), (F.col(date_col) >= F.col("low")) & (F.col(date_col) <= F.col("high"))).drop("low", "high")


def split_summary(cases: DataFrame, windows: DataFrame, target: str = "target_resolved") -> DataFrame:
    """Counts, rate and date bounds by fold and split, from daily sums, so that cases aren't multiplied by folds."""
    daily = cases.groupBy("opening_date").agg(F.count("*").alias("n"), F.sum(target).alias("p"))
    return assign(daily, windows).groupBy("fold", "split").agg(
        F.sum("n").cast("long").alias("records"), F.sum("p").cast("long").alias("positives"),
        (F.sum("n") - F.sum("p")).cast("long").alias("negatives"), C.ratio(F.sum("p"), F.sum("n"), None).alias("rate"),
        F.min("opening_date").alias("first_date"), F.max("opening_date").alias("last_date"),
    )
