"""Queries of profiles, audits, report tables and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.operators import audit, clean, compare, evaluation, folds, report
from tidemark.plans import sql as Q
from tidemark.plans.core import CLEAN, FEATURES, FOLD_ARGS, IDS, TRAIN_START, clean_cases, feature_table, query, rounded, scored, shared, windows
from tidemark.plans.metrics import _MASK_MODELS, _TEST_F1, test_f1
from tidemark.sources import cases as S
from tidemark.sources import files


@query("overview", f"""SELECT count(*) AS records, count(DISTINCT record_id) AS records_distinct, count(DISTINCT company) AS companies, min(opening_date) AS first_date, max(opening_date) AS last_date,
 round(avg(target_resolved), 6) AS rate, count(*) FILTER (WHERE target_resolved = 1) AS positives FROM ({Q.CASES})""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.overview(S.order_cases(spark, sf_dir, observed_only=False)))


@query("status_shares", f"SELECT status, count(*) AS records, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM ({Q.CASES}) GROUP BY 1")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.shares(S.order_cases(spark, sf_dir, observed_only=False), "status"))


def _rates(name: str, key: str) -> str:
    return f"""SELECT {key} AS {name}, count(*) AS records, count(target_resolved) AS observed, round(avg(CAST(target_resolved IS NOT NULL AS INTEGER)), 6) AS observed_rate, round(avg(target_resolved), 6) AS rate,
 min(opening_date) AS first_date, max(opening_date) AS last_date FROM ({Q.CASES}) GROUP BY 1"""


@query("monthly_rates", _rates("month", "CAST(date_trunc('month', opening_date) AS DATE)"))
def monthly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.group_rates(S.order_cases(spark, sf_dir, False), C.first_of_month(F.col("opening_date")), "month"))


@query("company_rates", _rates("company", "company"))
def company_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.group_rates(S.order_cases(spark, sf_dir, False), F.col("company"), "company"))


@query("location_rates", _rates("location", "location"))
def location_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.group_rates(S.order_cases(spark, sf_dir, False), C.or_unknown(F.col("location")), "location"))


_LONG_FEATURES = f"""SELECT target_resolved, feature, value FROM (SELECT target_resolved, CAST(text_char_count AS DOUBLE) AS text_char_count, CAST(text_word_count AS DOUBLE) AS text_word_count FROM ({FEATURES}))
 UNPIVOT (value FOR feature IN (text_char_count, text_word_count))"""


@query("feature_distribution", f"""SELECT target_resolved, feature, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max
 FROM ({_LONG_FEATURES}) GROUP BY 1, 2""")
def feature_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.distribution(feature_table(spark, sf_dir), ["text_char_count", "text_word_count"], ["target_resolved"]))


_BY_COMPANY = f"SELECT company, count(*) AS records FROM ({Q.OBSERVED}) WHERE opening_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1"


@query("bounded_scan", _BY_COMPANY)
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = S.order_cases(spark, sf_dir)
    return files.scan(cases, ["company"], "1996-01-01", "1997-12-31").groupBy("company").agg(F.count("*").alias("records"))


_COUNTS, _FLAGS = ["text_char_count", "text_word_count", "exclamation_count", "question_count"], ["has_exclamation", "has_question", "has_anonymization_marker"]
_CHECKS = {f"null_{c}": f"{c} IS NULL" for c in ("record_id", "complaint_id", "company", "opening_date", "target_resolved")}
_CHECKS |= {f"blank_{c}": f"trim({c}) = ''" for c in ("company", "complaint_text")} | {"bad_target": "target_resolved NOT IN (0, 1)"}
_CHECKS |= {f"negative_{c}": f"{c} < 0" for c in _COUNTS} | {f"bad_{c}": f"{c} NOT IN (0, 1)" for c in _FLAGS}
_CHECKS |= {"bad_month": "opening_month NOT BETWEEN 1 AND 12", "bad_weekday": "opening_weekday NOT BETWEEN 0 AND 6"}
_INTEGRITY = " UNION ALL ".join([
    *(f"SELECT '{k}' AS criterion, count(*) FILTER (WHERE {v}) AS value FROM f" for k, v in _CHECKS.items()),
    *(f"SELECT 'conflicting_{c}', count(*) FILTER (WHERE a IS DISTINCT FROM b) FROM (SELECT min({c}) AS a, max({c}) AS b FROM f GROUP BY record_id)" for c in ("opening_date", "target_resolved")),
    "SELECT 'repeated_record_id', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM f GROUP BY record_id)",
])


@query("dataset_integrity", f"WITH f AS ({FEATURES}) SELECT criterion, CAST(value AS BIGINT) AS value, value = 0 AS passed FROM ({_INTEGRITY})")
def dataset_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dataset_integrity(feature_table(spark, sf_dir), _COUNTS, _FLAGS)


_CONFLICTS = """SELECT CAST(sum(a) AS BIGINT) AS conflicting_l_shipdate, CAST(sum(b) AS BIGINT) AS conflicting_l_returnflag, CAST(sum(n - 1) AS BIGINT) AS repeated_l_orderkey
 FROM (SELECT l_orderkey, count(*) AS n, CAST(min(l_shipdate) <> max(l_shipdate) AS INTEGER) AS a, CAST(min(l_returnflag) <> max(l_returnflag) AS INTEGER) AS b FROM lineitem GROUP BY 1)"""


@query("conflicting_keys", _CONFLICTS)
def conflicting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.conflicting(S.table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_shipdate", "l_returnflag"])


# Faults put in: m1 lacks every seventh record, repeats every eleventh, and has a score above one for every thirteenth.
_FAULTY = f"""SELECT model, fold, split, record_id, target_resolved, CASE WHEN model = 'm1' AND CAST(record_id AS BIGINT) % 13 = 0 THEN 1.5 ELSE score END AS score, prediction FROM ({Q.SCORED}) WHERE NOT (model = 'm1' AND CAST(record_id AS BIGINT) % 7 = 0)
 UNION ALL SELECT model, fold, split, record_id, target_resolved, CASE WHEN CAST(record_id AS BIGINT) % 13 = 0 THEN 1.5 ELSE score END, prediction FROM ({Q.SCORED}) WHERE model = 'm1' AND CAST(record_id AS BIGINT) % 11 = 0 AND CAST(record_id AS BIGINT) % 7 <> 0"""
_EXPECTED = f"SELECT model, fold, split, record_id, target_resolved AS target FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high CROSS JOIN ({Q.MODELS}) WHERE split <> 'train'"


_FAULT_COUNTS = {
    "null_scores": "score IS NULL", "bad_scores": "score < 0 OR score > 1", "null_predictions": "prediction IS NULL", "bad_predictions": "prediction NOT IN (0, 1)",
}


def _integrity_sql(source: str) -> str:
    names = ["repeated", "missing", "unexpected", *_FAULT_COUNTS, "other_targets"]
    return f"""SELECT *, {' + '.join(names)} = 0 AND predictions > 0 AS passed FROM (SELECT model, fold, split, predictions, coalesce(expected, 0) AS expected, repeated, coalesce(expected, 0) - found AS missing, unexpected, {', '.join(_FAULT_COUNTS)}, other_targets
 FROM (SELECT model, fold, split, count(*) AS predictions, count(*) - count(DISTINCT record_id) AS repeated, count(DISTINCT record_id) FILTER (WHERE target IS NOT NULL) AS found, count(*) FILTER (WHERE target IS NULL) AS unexpected,
 {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in _FAULT_COUNTS.items())}, count(*) FILTER (WHERE target_resolved IS DISTINCT FROM target AND target IS NOT NULL) AS other_targets
 FROM ({source}) LEFT JOIN ({_EXPECTED}) USING (model, fold, split, record_id) GROUP BY 1, 2, 3) FULL JOIN (SELECT model, fold, split, count(*) AS expected FROM ({_EXPECTED}) GROUP BY 1, 2, 3) USING (model, fold, split))"""


@query("prediction_integrity", _integrity_sql(_FAULTY))
def prediction_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("record_id").cast("long")
    one = F.col("model") == "m1"
    # The third fault of the stand-in predictions, then the first, then the second.
    long = scored(spark, sf_dir).withColumn("score", F.when(one & (k % 13 == 0), 1.5).otherwise(F.col("score")))
    long = long.where(~(one & (k % 7 == 0)))
    faulty = long.unionByName(long.where(one & (k % 11 == 0)))
    expected = folds.assign(S.order_cases(spark, sf_dir).select(*IDS), windows(spark).where("split <> 'train'"))
    return audit.prediction_integrity(faulty, expected, ["m1", "m2", "m3", "good"])


# Further faults: of m2 a second row with a score below 0 for every fifth record and one without score, prediction or target for every eleventh; of m3 ids that nobody expects.
_HIDDEN = f"""SELECT model, fold, split, record_id, target_resolved, score, prediction FROM ({Q.SCORED})
 UNION ALL SELECT model, fold, split, record_id, 1 - target_resolved, -3.0, 2 FROM ({Q.SCORED}) WHERE model = 'm2' AND CAST(record_id AS BIGINT) % 5 = 0
 UNION ALL SELECT model, fold, split, record_id, NULL, NULL, NULL FROM ({Q.SCORED}) WHERE model = 'm2' AND CAST(record_id AS BIGINT) % 11 = 0
 UNION ALL SELECT model, fold, split, 'x' || record_id, target_resolved, score, prediction FROM ({Q.SCORED}) WHERE model = 'm3' AND CAST(record_id AS BIGINT) % 17 = 0"""


@query("prediction_integrity_rows", _integrity_sql(_HIDDEN))
def prediction_integrity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults in repeated rows, behind a good row of the same record."""
    k, long = F.col("record_id").cast("long"), scored(spark, sf_dir).select("model", "fold", "split", "record_id", "target_resolved", "score", "prediction")
    two, three = long.where("model = 'm2'"), long.where("model = 'm3'")
    low = two.where(k % 5 == 0).withColumns({"target_resolved": 1 - F.col("target_resolved"), "score": F.lit(-3.0), "prediction": F.lit(2)})
    none = two.where(k % 11 == 0).withColumns({"target_resolved": F.lit(None).cast("int"), "score": F.lit(None).cast("double"), "prediction": F.lit(None).cast("int")})
    strange = three.where(k % 17 == 0).withColumn("record_id", F.concat(F.lit("x"), "record_id"))
    expected = folds.assign(S.order_cases(spark, sf_dir).select(*IDS), windows(spark).where("split <> 'train'"))
    return audit.prediction_integrity(long.unionByName(low).unionByName(none).unionByName(strange), expected, ["m1", "m2", "m3", "good"])


@query("missing_ids", f"SELECT model, fold, split, record_id FROM ({_EXPECTED}) WHERE model = 'm1' AND CAST(record_id AS BIGINT) % 7 = 0")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("record_id").cast("long")
    faulty = scored(spark, sf_dir).where(~((F.col("model") == "m1") & (k % 7 == 0)))
    expected = folds.assign(S.order_cases(spark, sf_dir).select(*IDS), windows(spark).where("split <> 'train'"))
    return audit.missing_ids(faulty, expected).select("model", "fold", "split", "record_id")


_SIDES = f"SELECT DISTINCT opening_date, target_resolved AS y FROM ({Q.OBSERVED}) WHERE amount > 300000"


@query("names_apart", f"""WITH s AS ({_SIDES}) SELECT opening_date, CASE max(y) WHEN 1 THEN 'missing' ELSE 'unexpected' END AS side FROM s GROUP BY 1 HAVING min(y) = max(y)""")
def names_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with large cases of one outcome only."""
    large = S.order_cases(spark, sf_dir).where("amount > 300000")
    return audit.names_apart(large.where("target_resolved = 0"), large.where("target_resolved = 1"), "opening_date")


@query("metric_validation", f"""WITH m AS (SELECT model, fold, count(*) AS n FROM ({_TEST_F1}) GROUP BY ALL) SELECT criterion, CAST(value AS BIGINT) AS value, value = 0 AS passed FROM (
 SELECT 'repeated_pairs' AS criterion, count(*) FILTER (WHERE n > 1) AS value FROM m UNION ALL SELECT 'unexpected_models', count(*) FILTER (WHERE model NOT IN ('good', 'm1', 'm2', 'mx')) FROM m
 UNION ALL SELECT 'missing_models', 4 - count(DISTINCT model) FROM m WHERE model IN ('good', 'm1', 'm2', 'mx') UNION ALL SELECT 'incomplete_models', count(*) FROM (SELECT model FROM m WHERE model IN ('good', 'm1', 'm2', 'mx') GROUP BY 1 HAVING count(DISTINCT fold) <> 9)
 UNION ALL SELECT 'out_of_bounds', count(*) FILTER (WHERE macro_f1 < 0 OR macro_f1 > 1) FROM ({_TEST_F1}))""")
def metric_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.metric_validation(test_f1(spark, sf_dir), ["good", "m1", "m2", "mx"], 9, ["macro_f1"])


_AUDITED = f"""SELECT f.*, records, positives, negatives, first_date, last_date FROM ({Q.SPLITS}) f LEFT JOIN (SELECT fold, split, count(*) AS records, sum(target_resolved) AS positives, sum(1 - target_resolved) AS negatives,
 min(opening_date) AS first_date, max(opening_date) AS last_date FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high GROUP BY 1, 2) s ON s.fold = f.fold AND s.split = f.split"""
_AUDIT = {
    "empty_splits": f"SELECT count(*) FROM ({_AUDITED}) WHERE records IS NULL",
    "one_outcome": f"SELECT count(*) FROM ({_AUDITED}) WHERE positives = 0 OR negatives = 0",
    "dates_outside": f"SELECT count(*) FROM ({_AUDITED}) WHERE first_date < low OR last_date > high",
    "beyond_observation": f"SELECT count(*) FROM ({_AUDITED}) WHERE high > DATE '{FOLD_ARGS[1]}'",
    "train_overlaps": f"SELECT count(*) FROM ({Q.FOLDS}) WHERE train_end >= validation_start",
    "validation_overlaps": f"SELECT count(*) FROM ({Q.FOLDS}) WHERE validation_end >= test_start",
    "gaps_after_train": f"SELECT count(*) FROM ({Q.FOLDS}) WHERE train_end + 1 <> validation_start",
    "gaps_after_validation": f"SELECT count(*) FROM ({Q.FOLDS}) WHERE validation_end + 1 <> test_start",
    "misnumbered": f"""SELECT count(*) FROM (SELECT *, row_number() OVER (ORDER BY fold) AS place, lag(validation_start) OVER (ORDER BY fold) AS previous FROM ({Q.FOLDS})) WHERE fold <> place OR train_end >= validation_start
 OR train_end + 1 <> validation_start OR validation_end + 1 <> test_start OR validation_end < validation_start OR test_end < test_start OR validation_start <= previous""",
}


@query("temporal_audit", "SELECT criterion, value, value = 0 AS passed FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS criterion, ({q}) AS value" for c, q in _AUDIT.items()) + ")")
def temporal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.temporal_audit(S.order_cases(spark, sf_dir), folds.temporal_folds(spark, *FOLD_ARGS), TRAIN_START, FOLD_ARGS[1])


# The design expects one day more than the table has, and one fold fewer.
_DESIGN_END = "2001-08-02"


@query("bounds_audit", f"""WITH b AS (SELECT min(opening_date) AS first_date, max(opening_date) AS last_date FROM ({Q.OBSERVED})),
 d AS (SELECT * FROM ({Q.FOLDS}) WHERE fold < (SELECT max(fold) FROM ({Q.FOLDS})))
 SELECT criterion, CAST(value AS BIGINT) AS value, value = 0 AS passed FROM (SELECT 'empty_table' AS criterion, CAST(first_date IS NULL AS INTEGER) AS value FROM b UNION ALL SELECT 'other_start', CAST(first_date IS DISTINCT FROM DATE '{TRAIN_START}' AS INTEGER) FROM b
 UNION ALL SELECT 'other_end', CAST(last_date IS DISTINCT FROM DATE '{_DESIGN_END}' AS INTEGER) FROM b UNION ALL SELECT 'other_folds', (SELECT count(*) FROM (SELECT * FROM ({Q.FOLDS}) EXCEPT ALL SELECT * FROM d)) + (SELECT count(*) FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM ({Q.FOLDS}))))""")
def bounds_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases are written, and their own bounds, seen in that pass, are held against a design that is out by a day and a fold."""
    path = shared(spark)
    bounds = audit.observed_write(S.order_cases(spark, sf_dir).select(*IDS), lambda df: files.write_table(df, path), {"first_date": F.min("opening_date"), "last_date": F.max("opening_date")})
    made = folds.temporal_folds(spark, *FOLD_ARGS)
    last = made.agg(F.max("fold").alias("fold")).first()["fold"]
    return audit.bounds_audit(bounds, made, made.where(F.col("fold") < last), TRAIN_START, _DESIGN_END)


@query("fingerprint")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fingerprint(feature_table(spark, sf_dir))


_PADDED = f"SELECT model, fold, round(macro_f1, 6) AS macro_f1, CAST(NULL AS DOUBLE) AS records FROM ({_TEST_F1}) UNION ALL SELECT 'split', fold, NULL, CAST(count(*) AS DOUBLE) FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high WHERE split = 'test' GROUP BY fold"


@query("union_padded", _PADDED)
def union_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = folds.split_summary(S.order_cases(spark, sf_dir), windows(spark).where("split = 'test'")).select(F.lit("split").alias("model"), "fold", F.col("records").cast("double"))
    return rounded(report.union_padded([test_f1(spark, sf_dir), counts]))


@query("best_folds", f"SELECT model, fold, round(macro_f1, 6) AS macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, fold) AS place FROM ({_TEST_F1})) WHERE place = 1")
def best_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.best_by(test_f1(spark, sf_dir), ["model"], [F.desc("macro_f1"), "fold"]))


@query("model_order", f"SELECT model, fold, round(macro_f1, 6) AS macro_f1, CAST(list_position(['m3', 'good', 'm1', 'm2'], model) AS BIGINT) AS position FROM ({_TEST_F1})")
def model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.in_order(test_f1(spark, sf_dir), "model", ["m3", "good", "m1", "m2"], ["fold"]))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.duplicates(S.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("parameter_grid", f"SELECT a.model, b.fold, c.split, d.company FROM ({Q.MODELS}) a, (SELECT DISTINCT fold FROM ({Q.FOLDS})) b, (VALUES ('validation'), ('test')) c(split), (SELECT DISTINCT company FROM ({Q.OBSERVED})) d")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model, fold, split and company: candidate tables of a handful of rows."""
    models = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("good",)], "model string")
    names = spark.createDataFrame([("validation",), ("test",)], "split string")
    return report.grid([models, folds.temporal_folds(spark, *FOLD_ARGS).select("fold"), names, S.order_cases(spark, sf_dir).select("company").distinct()])


@query("read_back", CLEAN)
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw strings through CSV, cleaned, written ordered as Parquet, and read again."""
    path = shared(spark)
    raw = S.raw_corpus(spark, sf_dir)
    raw.write.csv(f"{path}/raw", header=True, escape='"')
    again = files.read_corpus_csv(spark, f"{path}/raw", raw.columns)
    cleaned = clean.clean_cases(clean.binary_outcome(again, "status", "Resolved", "Unresolved"))
    files.write_ordered(cleaned, f"{path}/clean", ["opening_date", "complaint_id", "record_id"])
    files.write_table(cleaned, f"{path}/clean", once=True)  # leaves what is there
    return spark.read.parquet(f"{path}/clean")


@query("report_files", f"SELECT model, fold, round(macro_f1, 6) AS macro_f1 FROM ({_TEST_F1})")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV report for each model, read together with declared types."""
    path, metrics = shared(spark), rounded(test_f1(spark, sf_dir))
    for model in _MASK_MODELS:
        files.write_report(metrics.where(F.col("model") == model), f"{path}/{model}")
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("macro_f1", T.DoubleType())])
    return files.read_reports(spark, [f"{path}/{m}" for m in _MASK_MODELS], schema)


@query("prediction_registry", f"""SELECT model, fold, split, record_id, opening_date, target_resolved, score, CAST(score >= CASE model WHEN 'good' THEN 0.5 ELSE 0.4 END AS INTEGER) AS prediction
 FROM ({Q.SCORED}) WHERE model IN ('good', 'm2')""")
def prediction_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' tables, each with its own column names, as one long table."""
    long = scored(spark, sf_dir)
    a = long.where("model = 'good'").withColumnsRenamed({"score": "p_good", "prediction": "said"})
    b = long.where("model = 'm2'").withColumn("flag", F.col("score") >= 0.4)
    return files.predictions_long({"good": (a, "p_good", "said"), "m2": (b, "score", "flag")})


@query("efficiency_summary", "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(sum(l_quantity), 6) AS l_quantity_total, round(avg(l_tax), 6) AS l_tax_mean, round(sum(l_tax), 4) AS l_tax_total FROM lineitem GROUP BY 1")
def efficiency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and total, here of two line-item columns in place of recorded seconds."""
    return rounded(report.totals(S.table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"])).withColumn("l_tax_total", F.round("l_tax_total", 4))


@query("prediction_files", f"SELECT model, fold, record_id, opening_date, target_resolved, score, prediction FROM ({Q.SCORED}) WHERE split = 'test'")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed predictions as Parquet by model and fold, and read again: ids stay strings."""
    path = shared(spark)
    files.write_predictions(scored(spark, sf_dir, ("test",)).drop("split", "company"), path)
    return files.read_predictions(spark, path)


@query("registered_frame", f"SELECT company, count(*) AS records, round(avg(amount), 4) AS mean_amount FROM ({Q.OBSERVED}) GROUP BY 1")
def registered_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame under a name that SQL can use, and the result of SQL on it exported."""
    with files.registered(S.order_cases(spark, sf_dir)) as name:
        found = spark.sql(f"SELECT company, count(*) AS records, round(avg(amount), 4) AS mean_amount FROM {name} GROUP BY company")
    path = shared(spark)
    files.write_table(found, path)
    return spark.read.parquet(path)


@query("source_report", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS position FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by how many documents they have, ties by name."""
    return report.by_count(S.table(spark, sf_dir, "documents"), "source")


@query("ordered_parts", f"SELECT record_id, company, opening_date, target_resolved, row_number() OVER (ORDER BY opening_date, record_id) AS position FROM ({Q.OBSERVED})")
def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written in order, and each with its place in the files as read again, one file after the other."""
    path = shared(spark)
    files.write_ordered(S.order_cases(spark, sf_dir).select(*IDS), path, ["opening_date", "record_id"])
    return files.read_placed(spark, path)


@query("hash_order", f"SELECT {', '.join(IDS)}, md5(record_id) AS order_hash FROM ({Q.OBSERVED})")
def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.shuffled(S.order_cases(spark, sf_dir).select(*IDS), "record_id")


_EFFECTS = f"""SELECT company, round(avg(target_resolved) - 0.5, 6) AS effect, round(least(1.0, exp(-200 * power(avg(target_resolved) - 0.5, 2) * count(*) / 100)), 6) AS p_value FROM ({Q.OBSERVED}) GROUP BY 1"""


@query("significant_tests", f"SELECT company, effect, p_value FROM ({_EFFECTS}) WHERE p_value < 0.4")
def significant_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies whose outcome rate is far from one half, by a Hoeffding bound."""
    effect = F.avg("target_resolved") - 0.5
    tests = S.order_cases(spark, sf_dir).groupBy("company").agg(
        F.round(effect, 6).alias("effect"), F.round(F.least(F.lit(1.0), F.exp(-200 * F.pow(effect, F.lit(2.0)) * F.count("*") / 100)), 6).alias("p_value")
    )
    return report.significant(tests, "p_value", "effect", 0.4)


@query("final_summary")
def final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model summary with bootstrap bounds."""
    cells = evaluation.confusion(scored(spark, sf_dir, ("test",)), ["model", "fold"])
    summary = report.metric_summary(test_f1(spark, sf_dir), ["model"], ["macro_f1"])
    return rounded(summary.join(compare.bootstrap(cells).select("model", "low", "high"), "model", "left"))


@query("final_summary_observed", f"""SELECT model, count(DISTINCT fold) AS folds, round(avg(macro_f1), 6) AS macro_f1_mean, round(coalesce(stddev_samp(macro_f1), 0), 6) AS macro_f1_std,
 round(min(macro_f1), 6) AS macro_f1_min, round(max(macro_f1), 6) AS macro_f1_max, true AS inside FROM ({_TEST_F1}) GROUP BY 1""")
def final_summary_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary without its bounds, which hold the mean."""
    inside = (F.col("low") <= F.col("macro_f1_mean")) & (F.col("macro_f1_mean") <= F.col("high"))
    return final_summary(spark, sf_dir).withColumn("inside", inside).drop("low", "high")
