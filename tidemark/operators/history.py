"""Causal history of a company: only strictly earlier days count.

Everything starts from one row for each company and day, so windows run over days, not over cases, and
statistics for many folds come from the same small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.folds import assign

WINDOWS = (30, 90, 180, 365)
PRIOR = 0.5


def daily(cases: DataFrame, keys: list[str], target: str = "target_resolved") -> DataFrame:
    """Count and positives by keys and day."""
    return cases.groupBy(*keys, "opening_date").agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("p"))


def _rate(p: Column, n: Column, otherwise: Column) -> Column:
    return F.when(n > 0, p.cast("double") / n.cast("double")).otherwise(otherwise)


def train_history(cases: DataFrame, windows: tuple[int, ...] = WINDOWS, target: str = "target_resolved") -> DataFrame:
    """Every case with what was known the day before: all earlier days, and the trailing windows ``[d - n, d - 1]``.

    Rates fall back from window to company to all companies to one half. Looks back only, so it serves
    every fold alike. Company and day are the only keys shuffled.
    """
    by_company = daily(cases, ["company"], target)
    earlier = Window.partitionBy("company").orderBy("opening_date").rowsBetween(Window.unboundedPreceding, -1)
    days = Window.partitionBy("company").orderBy(F.unix_date("opening_date"))
    sums = {"company_n": F.sum("n").over(earlier), "company_p": F.sum("p").over(earlier)}
    for k in windows:
        sums |= {f"n_{k}": F.sum("n").over(days.rangeBetween(-k, -1)), f"p_{k}": F.sum("p").over(days.rangeBetween(-k, -1))}
    held = by_company.withColumns({name: F.coalesce(value, F.lit(0)) for name, value in sums.items()}).drop("n", "p")
    all_earlier = Window.orderBy("opening_date").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    overall = daily(cases, [], target).withColumns({
        "all_n": F.coalesce(F.sum("n").over(all_earlier), F.lit(0)), "all_p": F.coalesce(F.sum("p").over(all_earlier), F.lit(0)),
    }).select("opening_date", "all_n", "all_p")
    joined = cases.join(held, ["company", "opening_date"]).join(overall, "opening_date")
    return _named(joined, windows, cases.columns)


def future_history(train: DataFrame, future: DataFrame, folds: DataFrame, windows: tuple[int, ...] = WINDOWS, target: str = "target_resolved") -> DataFrame:
    """``future`` (with ``fold``) with what was known at each fold's ``train_end``; trailing windows are ``(train_end - n, train_end]``."""
    ends = folds.select("fold", "train_end")
    by_day = daily(train, ["company"], target).join(F.broadcast(ends), F.col("opening_date") <= F.col("train_end"))
    sums = [F.sum("n").alias("company_n"), F.sum("p").alias("company_p")]
    for k in windows:
        recent = F.col("opening_date") > F.date_sub("train_end", k)
        sums += [F.sum(F.when(recent, F.col("n")).otherwise(0)).alias(f"n_{k}"), F.sum(F.when(recent, F.col("p")).otherwise(0)).alias(f"p_{k}")]
    held = by_day.groupBy("fold", "company").agg(*sums)
    overall = held.groupBy("fold").agg(F.sum("company_n").alias("all_n"), F.sum("company_p").alias("all_p"))
    joined = future.join(held, ["fold", "company"], "left").join(F.broadcast(overall), "fold", "left")
    filled = joined.fillna(0, ["company_n", "company_p", "all_n", "all_p"] + [f"{c}_{k}" for k in windows for c in "np"])
    return _named(filled, windows, future.columns)


def _named(joined: DataFrame, windows: tuple[int, ...], columns: list[str]) -> DataFrame:
    overall = _rate(F.col("all_p"), F.col("all_n"), F.lit(PRIOR))
    company = _rate(F.col("company_p"), F.col("company_n"), overall)
    out = [
        F.col("company_n").cast("long").alias("company_history_count"), C.ln1(F.col("company_n")).alias("log_company_history_count"),
        company.alias("company_history_rate"), F.when(F.col("company_n") > 0, 1).otherwise(0).alias("company_seen_before"),
        overall.alias("global_history_rate"),
    ]
    for k in windows:
        out += [
            F.col(f"n_{k}").cast("long").alias(f"company_history_count_{k}d"), C.ln1(F.col(f"n_{k}")).alias(f"log_company_history_count_{k}d"),
            _rate(F.col(f"p_{k}"), F.col(f"n_{k}"), company).alias(f"company_history_rate_{k}d"),
        ]
    return joined.select(*columns, *out)


def history_summary(history: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, share of known companies and mean history by keys."""
    return history.groupBy(*keys).agg(
        F.count("*").alias("records"), F.avg(F.col("company_seen_before").cast("double")).alias("seen_rate"),
        F.avg(F.col("company_history_count").cast("double")).alias("mean_count"), F.max("company_history_count").alias("max_count"),
        F.avg("company_history_rate").alias("mean_rate"), F.avg("global_history_rate").alias("mean_global_rate"),
    )


def frozen_rates(train: DataFrame, windows: DataFrame, target: str = "target_resolved") -> tuple[DataFrame, DataFrame]:
    """Train count and rate by fold and company, and by fold; daily sums meet the folds, not cases."""
    days = assign(daily(train, ["company"], target), windows.where("split = 'train'"))
    by_company = days.groupBy("fold", "company").agg(F.sum("n").cast("long").alias("company_n"), F.sum("p").cast("long").alias("company_p"))
    by_fold = by_company.groupBy("fold").agg(F.sum("company_n").alias("all_n"), F.sum("company_p").alias("all_p"), F.count("*").alias("companies"))
    return by_company, by_fold
