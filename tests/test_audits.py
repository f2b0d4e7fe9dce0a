"""Faults that hide behind repeated rows, audits that stop, bounds seen while writing, and sets of tables written once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, compare, folds
from tidemark.plans import models as plans
from tidemark.sources import files

PREDICTED = "model string, fold int, split string, record_id string, target_resolved int, score double, prediction int"


def test_masks_of_repeated_and_contradicting_rows(spark):
    rows = [
        ("a", 1, "test", "both", 1, 0.9, 1), ("b", 1, "test", "both", 1, 0.1, 0),
        ("a", 1, "test", "only a, twice", 1, 0.9, 1), ("a", 1, "test", "only a, twice", 1, 0.2, 0),
        ("a", 1, "test", "agrees", 0, 0.9, 1), ("a", 1, "test", "agrees", 0, 0.8, 1), ("b", 1, "test", "agrees", 0, 0.9, 1),
        ("a", 1, "test", "differs", 0, 0.9, 1), ("a", 1, "test", "differs", 0, 0.1, 0), ("b", 1, "test", "differs", 0, 0.9, 1),
        ("a", 1, "test", "null", 0, 0.9, 1), ("b", 1, "test", "null", 0, 0.9, None),
        ("a", 1, "test", "targets", 0, 0.9, 1), ("b", 1, "test", "targets", 1, 0.9, 1), ("c", 1, "test", "both", 1, 0.5, 1),
    ]
    df = spark.createDataFrame(rows, PREDICTED)
    masks = {r["record_id"]: (r["target_resolved"], r["mask"]) for r in compare.complete_masks(df, ["a", "b"], ["fold"]).collect()}
    assert masks == {"both": (1, 1), "agrees": (0, 3)}
    faults = compare.mask_faults(df, ["a", "b"], ["fold"]).collect()[0].asDict()
    assert faults == {"fold": 1, "records": 6, "incomplete": 1, "surplus": 3, "contradicting": 3, "unusable": 1}


def test_integrity_counts_rows_not_records(spark):
    rows = [
        ("a", 1, "test", "x", 1, -3.0, 1), ("a", 1, "test", "x", 1, 0.5, 1), ("a", 1, "test", "y", 0, None, 0), ("a", 1, "test", "y", 1, 0.4, 7),
        ("a", 1, "test", "z", 1, float("nan"), None), ("a", 1, "test", "other", 1, 0.5, 1), ("a", 1, "test", "other", 1, 0.5, 1),
    ]
    expected = spark.createDataFrame([(1, "test", "x", 1), (1, "test", "y", 0), (1, "test", "z", 1), (1, "test", "w", 1)], "fold int, split string, record_id string, target_resolved int")
    found = audit.prediction_integrity(spark.createDataFrame(rows, PREDICTED), expected, ["a"]).collect()
    assert len(found) == 1
    got = found[0].asDict()
    assert got.pop("passed") is False
    assert {k: v for k, v in got.items() if k not in ("model", "fold", "split")} == {
        "predictions": 7, "expected": 4, "repeated": 3, "missing": 1, "unexpected": 2, "null_scores": 1, "bad_scores": 2, "null_predictions": 1, "bad_predictions": 1, "other_targets": 1,
    }
    clean = audit.prediction_integrity(spark.createDataFrame([("a", 1, "test", "x", 1, 0.5, 1)], PREDICTED), expected.where("record_id = 'x'"), ["a"]).collect()[0]
    assert clean["passed"] and clean["missing"] == 0


def test_bounds_are_seen_while_the_table_is_written(spark):
    path = files.shared(spark)
    cases = spark.createDataFrame([("a", dt.date(1999, 1, 1)), ("b", dt.date(2000, 2, 3))], "record_id string, opening_date date")
    seen = audit.observed_write(cases, lambda df: files.write_table(df, path), {"first_date": F.min("opening_date"), "last_date": F.max("opening_date"), "n": F.count("*")})
    assert seen == {"first_date": dt.date(1999, 1, 1), "last_date": dt.date(2000, 2, 3), "n": 2} and spark.read.parquet(path).count() == 2
    made = folds.temporal_folds(spark, *plans.FOLD_ARGS)
    good = audit.bounds_audit(seen, made, made, "1999-01-01", "2000-02-03")
    assert all(r["passed"] for r in audit.enforced(good).collect())
    bad = audit.bounds_audit(seen, made, made.where("fold > 1"), "1999-01-01", "2000-02-04")
    assert {r["criterion"]: r["value"] for r in bad.collect()} == {"empty_table": 0, "other_start": 0, "other_end": 1, "other_folds": 1}
    with pytest.raises(Exception, match="criterion failed: other_end = 1"):
        audit.enforced(bad.where("criterion <> 'other_folds'")).collect()
    none = audit.observed_write(cases.where("false"), lambda df: files.write_table(df, path), {"first_date": F.min("opening_date"), "last_date": F.max("opening_date")})
    assert audit.bounds_audit(none, made, made, "1999-01-01", "2000-02-03").where("NOT passed").count() == 3


def test_a_set_of_tables_is_written_once(spark):
    folder, calls = files.shared(spark), []

    def table(name, n, fail=False):
        def make():
            calls.append(name)
            if fail:
                raise RuntimeError("cut off")
            return spark.range(n).toDF(name)
        return make

    with pytest.raises(RuntimeError):
        files.write_once(spark, folder, {"one": table("one", 1), "two": table("two", 2, fail=True)})
    assert calls == ["one", "two"]
    found = files.write_once(spark, folder, {"one": table("one", 9), "two": table("two", 2)})
    assert calls == ["one", "two", "two"] and found["one"].count() == 1 and found["two"].count() == 2  # the finished one was taken up
    assert files.write_once(spark, folder, {"one": table("one", 9), "two": table("two", 9)})["two"].count() == 2 and len(calls) == 3
    more = files.write_once(spark, folder, {"one": table("one", 9), "two": table("two", 9), "three": table("three", 3)})
    assert calls[3:] == ["three"] and [more[k].count() for k in ("one", "two", "three")] == [1, 2, 3]


def test_a_set_cut_off_between_moving_and_its_manifest(spark):
    folder, calls = files.shared(spark), []
    make = lambda: calls.append(1) or spark.range(4)
    files.write_once(spark, folder, {"one": make})
    system, path = files._file_system(spark, folder)
    system.delete(path(f"{folder}/_manifest"), True)  # one output is in place, the manifest is not
    assert files.write_once(spark, folder, {"one": make, "two": make})["two"].count() == 4 and len(calls) == 2
    system.delete(path(f"{folder}/_manifest"), True)
    system.delete(path(f"{folder}/two"), True)  # one output missing
    assert files.write_once(spark, folder, {"one": make, "two": make})["two"].count() == 4 and len(calls) == 3


def test_bucketed_tables_join_without_a_shuffle(spark):
    features = files.bucketed(spark.range(1000).select(F.col("id").cast("string").alias("record_id"), F.col("id").alias("x")), "record_id", 8)
    past = files.bucketed(spark.range(1000).select(F.col("id").cast("string").alias("record_id"), (F.col("id") * 2).alias("y")), "record_id", 8)
    said = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("model"), F.lit(1).alias("fold"), F.floor(F.col("id") / 3).cast("string").alias("record_id"),
        F.lit(1).alias("target_resolved"), (F.col("id") % 2).cast("int").alias("prediction"),
    )
    predictions = files.bucketed(said, "record_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = features.join(past, "record_id").join(predictions.groupBy("record_id").agg(F.count("*").alias("n")), "record_id")
        masks = compare.complete_masks(predictions, ["a", "b"], ["fold"])
        for df in (joined, masks):
            assert df.count() == 1000
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
        assert joined.where("y = 2 * x AND n = 3").count() == 1000
        assert "Exchange" in said.groupBy("record_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    files.drop_bucketed(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
