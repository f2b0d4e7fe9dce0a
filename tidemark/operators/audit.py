"""Audits: reports of (criterion, value, passed), each from one pass over its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import folds as _folds


def as_report(one_row: DataFrame, criteria: list[str]) -> DataFrame:
    """A row for each counter of a one-row table; it passes at zero."""
    made = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("long").alias("value")) for c in criteria]))
    return one_row.select(made.alias("x")).select("x.*").withColumn("passed", F.col("value") == 0)


def conflicting(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: for each column, how many keys have more than one value of it; and the surplus rows of repeated keys."""
    grouped = df.groupBy(key).agg(F.count("*").alias("n"), *[(F.min(v).eqNullSafe(F.max(v))).alias(f"one_{v}") for v in values])
    return grouped.agg(
        *[C.count_if(~F.col(f"one_{v}")).alias(f"conflicting_{v}") for v in values], F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias(f"repeated_{key}")
    )


def dataset_integrity(features: DataFrame, counts: list[str], flags: list[str], text_cols: tuple[str, ...] = ("company", "complaint_text")) -> DataFrame:
    """Null and domain counters of the feature table, and conflicts of its ids."""
    checks: dict[str, Column] = {f"null_{c}": F.col(c).isNull() for c in ("record_id", "complaint_id", "company", "opening_date", "target_resolved")}
    checks |= {f"blank_{c}": F.trim(F.col(c)) == "" for c in text_cols}
    checks["bad_target"] = ~F.col("target_resolved").isin(0, 1)
    checks |= {f"negative_{c}": F.col(c) < 0 for c in counts}
    checks |= {f"bad_{c}": ~F.col(c).isin(0, 1) for c in flags}
    checks |= {"bad_month": ~F.col("opening_month").between(1, 12), "bad_weekday": ~F.col("opening_weekday").between(0, 6)}
    counted = features.agg(*[C.count_if(v).alias(k) for k, v in checks.items()])
    ids = conflicting(features, "record_id", ["opening_date", "target_resolved"])
    return as_report(counted.crossJoin(ids), [*counted.columns, *ids.columns])  # one row each


def prediction_integrity(predictions: DataFrame, expected: DataFrame, models: list[str]) -> DataFrame:
    """Counters by model, fold and split: nulls, bounds, surplus, missing and unexpected rows, other targets.

    Faults are counted by row, before rows of a record meet, so that one row can't hide another's. ``expected`` has fold, split, record_id,
    target_resolved, a row for each record. One outer join serves all models.
    """
    keys = ["model", "fold", "split"]
    wanted = expected.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    score, prediction, said = F.col("score"), F.col("prediction"), F.col("target_resolved")
    faults = {
        "null_scores": score.isNull(), "bad_scores": (score < 0) | (score > 1) | F.isnan(score), "null_predictions": prediction.isNull(),
        "bad_predictions": ~prediction.isin(0, 1), "zeros_": said == 0, "ones_": said == 1,
    }
    p = predictions.groupBy(*keys, "record_id").agg(F.count("*").alias("n"), *[C.count_if(v).alias(k) for k, v in faults.items()])
    joined = p.join(wanted.select(*keys, "record_id", F.col("target_resolved").alias("target"), F.lit(1).alias("wanted")), [*keys, "record_id"], "full_outer")
    here, asked = F.col("n").isNotNull(), F.col("wanted").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    alike = F.when(F.col("target") == 1, F.col("ones_")).when(F.col("target") == 0, F.col("zeros_")).otherwise(F.lit(0))
    counted = joined.groupBy(*keys).agg(
        total(F.col("n")).alias("predictions"), C.count_if(asked).alias("expected"), total(F.col("n") - 1).alias("repeated"), C.count_if(asked & ~here).alias("missing"),
        total(F.when(~asked, F.col("n"))).alias("unexpected"), *[total(F.col(c)).alias(c) for c in faults if not c.endswith("_")],
        total(F.when(here & asked, F.col("n") - alike)).alias("other_targets"),
    )
    names = ["repeated", "missing", "unexpected", *[c for c in faults if not c.endswith("_")], "other_targets"]
    return counted.withColumn("passed", (sum((F.col(c) for c in names[1:]), F.col(names[0])) == 0) & (F.col("predictions") > 0))


def missing_ids(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected records that a model and fold don't predict."""
    models = predictions.select("model").distinct()
    wanted = expected.select("fold", "split", "record_id").crossJoin(F.broadcast(models))  # a row for each model
    return wanted.join(predictions, ["model", "fold", "split", "record_id"], "left_anti")


def names_apart(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Names on one side only, with the side."""
    a, b = found.select(key).distinct(), wanted.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("unexpected")))


def metric_validation(metrics: DataFrame, models: list[str], folds: int, bounded: list[str]) -> DataFrame:
    """Counters over a metric table: repeated pairs, unknown models, incomplete models, values outside [0, 1]."""
    by = metrics.groupBy("model", "fold").agg(F.count("*").alias("n"))
    outside = None
    for c in bounded:
        bad = (F.col(c) < 0) | (F.col(c) > 1)
        outside = bad if outside is None else outside | bad
    row = by.agg(C.count_if(F.col("n") > 1).alias("repeated_pairs"), C.count_if(~F.col("model").isin(*models)).alias("unexpected_models"))
    known = by.groupBy("model").agg(F.countDistinct("fold").alias("folds")).where(F.col("model").isin(*models)).agg(
        F.count("*").alias("models"), C.count_if(F.col("folds") != folds).alias("incomplete_models")
    ).select((F.lit(len(models)) - F.col("models")).cast("long").alias("missing_models"), "incomplete_models")
    values = metrics.agg(C.count_if(outside).alias("out_of_bounds"))
    return as_report(row.crossJoin(known).crossJoin(values), [*row.columns, *known.columns, *values.columns])


def temporal_audit(cases: DataFrame, folds: DataFrame, train_start: str, observation_end: str) -> DataFrame:
    """Criteria over folds and splits: order, contiguity, bounds, non-empty splits with both outcomes."""
    windows = _folds.splits(folds, train_start)
    summary = windows.join(_folds.split_summary(cases, windows), ["fold", "split"], "left")
    per = summary.agg(
        C.count_if(F.col("records").isNull()).alias("empty_splits"), C.count_if((F.col("positives") == 0) | (F.col("negatives") == 0)).alias("one_outcome"),
        C.count_if((F.col("first_date") < F.col("low")) | (F.col("last_date") > F.col("high"))).alias("dates_outside"),
        C.count_if(F.col("high") > F.lit(observation_end).cast("date")).alias("beyond_observation"),
    )
    order = folds.agg(
        C.count_if(F.col("train_end") >= F.col("validation_start")).alias("train_overlaps"), C.count_if(F.col("validation_end") >= F.col("test_start")).alias("validation_overlaps"),
        C.count_if(F.date_add("train_end", 1) != F.col("validation_start")).alias("gaps_after_train"), C.count_if(F.date_add("validation_end", 1) != F.col("test_start")).alias("gaps_after_validation"),
    )
    faults = _folds.fold_faults(folds).agg(F.count("*").alias("misnumbered"))
    return as_report(per.crossJoin(order).crossJoin(faults), [*per.columns, *order.columns, *faults.columns])


def observed_write(df: DataFrame, write: Callable[[DataFrame], None], counters: dict[str, Column]) -> dict:
    """Writes a table and returns ``counters`` (aggregate columns) taken from the rows as they went by, without a second pass."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in counters.items()]))
    return seen.get


def bounds_audit(bounds: dict, folds: DataFrame, design: DataFrame, start: str, end: str) -> DataFrame:
    """Whether a table's own first and last day are those of the design, and its folds those that the design has.

    ``bounds`` has first_date and last_date, as from ``observed_write``; an empty table has neither, and fails.
    """
    spark = folds.sparkSession
    held = spark.createDataFrame([(bounds["first_date"], bounds["last_date"])], "first_date date, last_date date")
    apart = folds.exceptAll(design.select(*folds.columns)).count() + design.select(*folds.columns).exceptAll(folds).count()  # a row for each fold
    odd = lambda c: F.when(c, 0).otherwise(1)
    row = held.select(
        odd(F.col("first_date").isNotNull()).alias("empty_table"), odd(F.col("first_date") == F.lit(start).cast("date")).alias("other_start"),
        odd(F.col("last_date") == F.lit(end).cast("date")).alias("other_end"), F.lit(apart).alias("other_folds"),
    )
    return as_report(row, row.columns)


def enforced(report: DataFrame) -> DataFrame:
    """The report, as long as all of it passed: reading a row of a criterion that failed is an error that names it."""
    told = F.concat(F.lit("criterion failed: "), F.col("criterion"), F.lit(" = "), F.col("value").cast("string"))
    return report.withColumn("passed", F.when(F.col("passed"), F.col("passed")).otherwise(F.raise_error(told).cast("boolean")))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and two sums of row hashes that don't depend on order or partitions."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("hash_sum"), F.bit_xor(row).alias("hash_xor"))
