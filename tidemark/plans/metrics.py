"""Queries of the evaluation family over stand-in predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compare, evaluation, folds, history, report
from tidemark.plans import sql as Q
from tidemark.plans.core import IDS, query, rounded, scored, windows, written
from tidemark.sources import cases as S
from tidemark.sources import files

GROUP = ["model", "fold", "split"]
KEYS = ", ".join(GROUP)
TRAIN = f"""SELECT fold, company, count(*) AS company_n FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high WHERE split = 'train' GROUP BY 1, 2"""
SET = f"""tp, fp, fn, tn, {Q.CLASS_METRICS}, tp + fp + fn + tn AS records, round(CAST(tp + fn AS DOUBLE) / (tp + fp + fn + tn), 6) AS positive_rate, roc_auc, pr_auc, brier_score"""


def metric_set_sql(source: str, keys: str) -> str:
    return f"SELECT {keys}, {SET} FROM ({Q.confusion(source, keys)}) JOIN ({Q.ranks(source, keys)}) USING ({keys})"


@query("metric_set", metric_set_sql(Q.SCORED, KEYS))
def metric_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.metric_set(scored(spark, sf_dir), GROUP))


@query("best_thresholds", f"SELECT {KEYS}, round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1 FROM ({Q.threshold(Q.SCORED, KEYS)})")
def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.best_threshold(scored(spark, sf_dir), GROUP))


@query("running_counts", f"SELECT {KEYS}, score, n, p, cn, cp FROM ({Q.swept(Q.SCORED, KEYS)})")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.running_counts(evaluation.score_counts(scored(spark, sf_dir), GROUP), GROUP).drop("total", "positives")


_SEGMENTED = f"""SELECT s.*, segment FROM (SELECT p.*, CASE WHEN company_n IS NULL THEN 'unseen' WHEN company_n < 220 THEN 'rare' ELSE 'frequent' END AS own
 FROM ({Q.SCORED}) p LEFT JOIN ({TRAIN}) USING (fold, company) WHERE split = 'test') s, (VALUES ('all'), ('own')) v(tag), LATERAL (SELECT CASE tag WHEN 'all' THEN 'all' ELSE own END AS segment)"""


@query("segment_metrics", metric_set_sql(_SEGMENTED, "model, fold, segment"))
def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_company, _ = history.frozen_rates(S.order_cases(spark, sf_dir).select(*IDS), windows(spark))
    tagged = compare.with_segments(scored(spark, sf_dir, ("test",)), by_company, 220)
    return rounded(evaluation.metric_set(tagged, ["model", "fold", "segment"]))


_MONTHLY = f"SELECT *, strftime(opening_date, '%Y-%m') AS month FROM ({Q.SCORED}) WHERE split = 'test'"


@query("monthly_metrics", metric_set_sql(_MONTHLY, "model, fold, month"))
def monthly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = scored(spark, sf_dir, ("test",)).withColumn("month", F.date_format("opening_date", "yyyy-MM"))
    return rounded(evaluation.metric_set(dated, ["model", "fold", "month"]))


_BINS = f"""SELECT {KEYS}, CAST(least(greatest(floor(score * 10), 0), 9) AS BIGINT) + 1 AS bin, count(*) AS records, avg(score) AS mean_score, avg(target_resolved) AS observed_rate FROM ({Q.SCORED}) GROUP BY ALL"""


@query("calibration_bins", f"SELECT {KEYS}, bin, records, round(mean_score, 9) AS mean_score, round(observed_rate, 9) AS observed_rate FROM ({_BINS})")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.calibration_bins(scored(spark, sf_dir), GROUP), 9)  # means of few scores end in a 5 at the seventh place


@query("calibration_error", f"SELECT {KEYS}, round(sum(abs(mean_score - observed_rate) * records) / sum(records), 6) AS ece, round(max(abs(mean_score - observed_rate)), 6) AS max_gap FROM ({_BINS}) GROUP BY ALL")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.calibration_error(scored(spark, sf_dir), GROUP))


_RISK = f"SELECT {KEYS}, 1 - score AS risk, 1 - target_resolved AS bad FROM ({Q.SCORED})"


@query("risk_ranking", f"""SELECT {KEYS}, fraction, k, round(hits, 6) AS hits, round(hits / k, 6) AS precision, round({Q.div('hits', 'positives')}, 6) AS recall, round(hits / k / {Q.div('positives', 'total', 'NULL')}, 6) AS lift
 FROM (SELECT *, (cp - p) + (k - (cn - n)) * CAST(p AS DOUBLE) / n AS hits FROM (SELECT *, CAST(greatest(1, ceil(total * fraction)) AS BIGINT) AS k
 FROM ({Q.swept(_RISK, KEYS, 'risk', 'bad')}) CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) f(fraction)) WHERE cn >= k AND cn - n < k)""")
def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.risk_ranking(scored(spark, sf_dir), GROUP))


WEIGHTS = [k / 20 for k in range(21)]
_PAIRS = f"""SELECT fold, split, record_id, target_resolved, max(score) FILTER (WHERE model = 'good') AS a, max(score) FILTER (WHERE model = 'm2') AS b FROM ({Q.SCORED}) GROUP BY ALL"""
_TRIED = f"SELECT fold, split, record_id, target_resolved, CAST(i AS DOUBLE) / 20 AS weight, CAST(i AS DOUBLE) / 20 * a + (1 - CAST(i AS DOUBLE) / 20) * b AS score FROM ({_PAIRS}) CROSS JOIN range(0, 21) t(i)"
_CHOSEN = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY macro_f1 DESC, abs(weight - 0.5), abs(threshold - 0.5), weight) AS place
 FROM ({Q.threshold(f"SELECT * FROM ({_TRIED}) WHERE split = 'validation'", 'fold, weight')})) WHERE place = 1"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("model IN ('good', 'm2')").groupBy("fold", "split", "record_id", "target_resolved").agg(
        F.max(F.when(F.col("model") == "good", F.col("score"))).alias("a"), F.max(F.when(F.col("model") == "m2", F.col("score"))).alias("b")
    )


def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and threshold chosen on validation, applied to test."""
    pairs = _pairs(spark, sf_dir)
    chosen = compare.choose_fusion(pairs.where("split = 'validation'"), WEIGHTS, ["fold"])
    test = pairs.where("split = 'test'").join(F.broadcast(chosen.select("fold", "weight", "threshold")), "fold")
    fused = test.withColumn("score", F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b")).withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))
    return rounded(evaluation.metric_set(fused, ["fold", "weight", "threshold"]))


_FUSED = f"""SELECT fold, weight, threshold, target_resolved, weight * a + (1 - weight) * b AS score, CAST(weight * a + (1 - weight) * b >= threshold AS INTEGER) AS prediction
 FROM ({_PAIRS}) JOIN ({_CHOSEN}) USING (fold) WHERE split = 'test'"""
query("fusion", f"SELECT fold, weight, round(threshold, 6) AS threshold, {SET} FROM ({Q.confusion(_FUSED, 'fold, weight, threshold')}) JOIN ({Q.ranks(_FUSED, 'fold, weight, threshold')}) USING (fold, weight, threshold)")(fusion)


PLATT_STEPS = 12


def _platt_sql() -> str:
    """Counts, then Newton's steps one after the other, then both stages with their metrics: tables of a WITH clause."""
    x = "ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6)))"
    steps = [f"""pc AS MATERIALIZED (SELECT model, fold, split, score, count(*) AS n, CAST(sum(target_resolved) AS BIGINT) AS p, {x} AS x FROM ({Q.SCORED}) GROUP BY ALL)""",
             "q0 AS (SELECT model, fold, CAST(0 AS DOUBLE) AS slope, ln((sum(p) + 0.5) / (sum(n) - sum(p) + 0.5)) AS intercept FROM pc WHERE split = 'validation' GROUP BY 1, 2)"]
    for i in range(PLATT_STEPS):
        steps.append(f"""q{i + 1} AS MATERIALIZED (SELECT model, fold, slope + CASE WHEN abs(det) > 1e-12 THEN (h * gx - hx * g) / det ELSE 0 END AS slope, intercept + CASE WHEN abs(det) > 1e-12 THEN (hxx * g - hx * gx) / det ELSE 0 END AS intercept
 FROM (SELECT *, hxx * h - hx * hx AS det FROM (SELECT model, fold, slope, intercept, sum(v * x * x) + 1e-6 AS hxx, sum(v * x) AS hx, sum(v) AS h, sum(r * x) - 1e-6 * slope AS gx, sum(r) AS g
 FROM (SELECT *, n * q * (1 - q) AS v, p - n * q AS r FROM (SELECT *, 1 / (1 + exp(-least(greatest(slope * x + intercept, -35), 35))) AS q FROM pc JOIN q{i} USING (model, fold) WHERE split = 'validation')) GROUP BY model, fold, slope, intercept)))""")
    last = f"q{PLATT_STEPS}"
    rows = "SELECT model, fold, stage, score, unnest(range(0, n)) < p AS hit FROM ps WHERE split = "  # a row for each case, as the shared SQL takes rows
    source = lambda split: f"SELECT model, fold, stage, score, CAST(hit AS INTEGER) AS target_resolved FROM ({rows}'{split}')"
    steps += [
        f"""ps AS MATERIALIZED (SELECT model, fold, split, stage, CASE stage WHEN 'before' THEN score ELSE 1 / (1 + exp(-(slope * x + intercept))) END AS score, n, p FROM pc JOIN {last} USING (model, fold) CROSS JOIN (VALUES ('before'), ('after')) t(stage))""",
        f"pt AS MATERIALIZED ({Q.threshold(source('validation'), 'model, fold, stage')})",
        f"pj AS MATERIALIZED (SELECT s.*, threshold, CAST(score >= threshold AS INTEGER) AS prediction FROM ({source('test')}) s JOIN pt USING (model, fold, stage))",
        f"pf AS (SELECT model, fold, stage, threshold, {Q.macro('tp', 'fp', 'fn', 'tn')} AS macro_f1 FROM ({Q.confusion('SELECT * FROM pj', 'model, fold, stage, threshold')}))",
        """pe AS (SELECT model, fold, stage, sum(abs(s - r) * n) / sum(n) AS ece, max(abs(s - r)) AS max_gap FROM (SELECT model, fold, stage, least(greatest(floor(score * 10), 0), 9) AS bin, count(*) AS n, avg(score) AS s, avg(target_resolved) AS r FROM pj GROUP BY ALL) GROUP BY 1, 2, 3)""",
        f"pr AS ({Q.ranks('SELECT * FROM pj', 'model, fold, stage')})",
    ]
    return "WITH " + ", ".join(steps) + f", px AS (SELECT * FROM pf JOIN pe USING (model, fold, stage) JOIN pr USING (model, fold, stage) JOIN {last} USING (model, fold)) "


def _calibration_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["model", "fold"]
    counts = written(evaluation.score_counts(scored(spark, sf_dir), [*keys, "split"]))
    model = compare.platt_of(counts.where("split = 'validation'").drop("split"), keys, steps=PLATT_STEPS)
    return compare.calibration_change(counts, model, keys)


@query("platt_calibration", _platt_sql() + """SELECT model, fold, stage, round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1, roc_auc, pr_auc, brier_score,
 round(ece, 9) AS ece, round(max_gap, 9) AS max_gap, round(slope, 6) AS slope, round(intercept, 6) AS intercept, slope > 0 AS usable FROM px""")
def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures on test before and after; curves and both thresholds are fitted on validation."""
    change = _calibration_change(spark, sf_dir)
    fine = ("ece", "max_gap")  # gaps of means of few scores end in a 5 at the seventh place
    return change.select(*[F.round(c, 9 if c in fine else 6).alias(c) if kind == "double" else F.col(c) for c, kind in change.dtypes])


_MASK_MODELS = ["good", "m1", "m2", "m3"]
_BITS = ", ".join(f"max(prediction) FILTER (WHERE model = '{m}') AS p{i}" for i, m in enumerate(_MASK_MODELS))
_TESTED = f"SELECT * FROM ({Q.SCORED}) WHERE split = 'test'"
# Faults put in: m1 repeats every fifth record, with the other prediction where it is a fifteenth; m2 lacks every seventh and m3 says nothing of every eleventh; m1 has another target in the repeats of every fortieth.
_FAULTS = f"""SELECT model, fold, record_id, target_resolved, CASE WHEN model = 'm3' AND CAST(record_id AS BIGINT) % 11 = 0 THEN NULL ELSE prediction END AS prediction FROM ({_TESTED}) WHERE NOT (model = 'm2' AND CAST(record_id AS BIGINT) % 7 = 0)
 UNION ALL SELECT model, fold, record_id, CASE WHEN CAST(record_id AS BIGINT) % 40 = 0 THEN 1 - target_resolved ELSE target_resolved END, CASE WHEN CAST(record_id AS BIGINT) % 15 = 0 THEN 1 - prediction ELSE prediction END FROM ({_TESTED}) WHERE model = 'm1' AND CAST(record_id AS BIGINT) % 5 = 0"""


def _cells_sql(source: str) -> str:
    wide = f"""SELECT fold, record_id, max(target_resolved) AS target_resolved, {_BITS} FROM ({source}) GROUP BY 1, 2 HAVING min(target_resolved) = max(target_resolved)
 AND {' AND '.join(f"min(prediction) FILTER (WHERE model = '{m}') = max(prediction) FILTER (WHERE model = '{m}')" for m in _MASK_MODELS)}"""
    return " UNION ALL ".join(
        f"SELECT fold, '{a}' AS first, '{b}' AS second, target_resolved, p{i} AS first_prediction, p{j} AS second_prediction, count(*) AS n FROM ({wide}) GROUP BY ALL"
        for i, a in enumerate(_MASK_MODELS) for j, b in enumerate(_MASK_MODELS) if i < j
    )


_CELLS = _cells_sql(_TESTED)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = compare.complete_masks(scored(spark, sf_dir, ("test",)), _MASK_MODELS, ["fold"])
    return compare.pair_cells(masks, _MASK_MODELS, ["fold"])


@query("pair_cells", _CELLS)
def pair_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query("pair_cells_bucketed", _CELLS)
def pair_cells_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from predictions that are stored in buckets by record: the masks need no shuffle."""
    long = scored(spark, sf_dir, ("test",)).select("model", "fold", "record_id", "target_resolved", "prediction")
    return compare.pair_cells(compare.complete_masks(files.bucketed(long, "record_id", 16), _MASK_MODELS, ["fold"]), _MASK_MODELS, ["fold"])


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in predictions of test with the faults of ``_FAULTS``."""
    k, model = F.col("record_id").cast("long"), F.col("model")
    long = scored(spark, sf_dir, ("test",)).select("model", "fold", "record_id", "target_resolved", "prediction")
    again = long.where((model == "m1") & (k % 5 == 0)).withColumns({
        "target_resolved": F.when(k % 40 == 0, 1 - F.col("target_resolved")).otherwise(F.col("target_resolved")),
        "prediction": F.when(k % 15 == 0, 1 - F.col("prediction")).otherwise(F.col("prediction")),
    })
    some = long.where(~((model == "m2") & (k % 7 == 0))).withColumn("prediction", F.when(~((model == "m3") & (k % 11 == 0)), F.col("prediction")))
    return some.unionByName(again)


@query("pair_cells_faulty", _cells_sql(_FAULTS))
def pair_cells_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the records that stay when rows are repeated, lacking, empty or contradict each other."""
    return compare.pair_cells(compare.complete_masks(_faulty(spark, sf_dir), _MASK_MODELS, ["fold"]), _MASK_MODELS, ["fold"])


@query("mask_faults", f"""SELECT fold, count(*) AS records, count(*) FILTER (WHERE models < 4) AS incomplete, CAST(sum(n - models) AS BIGINT) AS surplus, count(*) FILTER (WHERE differ) AS contradicting, count(*) FILTER (WHERE usable < models) AS unusable
 FROM (SELECT fold, record_id, count(DISTINCT model) AS models, count(*) AS n, count(DISTINCT model) FILTER (WHERE prediction IN (0, 1)) AS usable, min(target_resolved) <> max(target_resolved) OR {' OR '.join(f"coalesce(min(prediction) FILTER (WHERE model = '{m}') <> max(prediction) FILTER (WHERE model = '{m}'), false)" for m in _MASK_MODELS)} AS differ
 FROM ({_FAULTS}) GROUP BY 1, 2) GROUP BY 1""")
def mask_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.mask_faults(_faulty(spark, sf_dir), _MASK_MODELS, ["fold"])


@query("bootstrap_intervals")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluation.confusion(scored(spark, sf_dir, ("test",)), ["model", "fold"])
    return rounded(compare.bootstrap(cells))


@query("pair_tests")
def pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap and permutation of all pairs, with Holm's adjustment."""
    return rounded(compare.holm(compare.compare_pairs(_cells(spark, sf_dir)), order=["first", "second"]))


_TEST_F1 = f"SELECT model, fold, {Q.macro('tp', 'fp', 'fn', 'tn')} AS macro_f1 FROM ({Q.confusion(f'''SELECT * FROM ({Q.SCORED}) WHERE split = 'test' ''', 'model, fold')})"


def test_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluation.confusion(scored(spark, sf_dir, ("test",)), ["model", "fold"])
    return cells.select("model", "fold", evaluation.macro_f1(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).alias("macro_f1"))


# What doesn't hang on the draws: the observed values, how many draws there are, and that the bounds hold the observed value.
@query("bootstrap_observed", f"SELECT model, round(avg(macro_f1), 6) AS macro_f1, CAST(10000 AS BIGINT) AS replicates, true AS inside FROM ({_TEST_F1}) GROUP BY 1")
def bootstrap_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("low") <= F.col("macro_f1")) & (F.col("macro_f1") <= F.col("high"))
    return rounded(bootstrap_intervals(spark, sf_dir).select("model", "macro_f1", "replicates", inside.alias("inside")))


@query("pair_observed", f"""SELECT a.model AS first, b.model AS second, round(avg(a.macro_f1 - b.macro_f1), 6) AS difference, true AS inside, true AS adjusted
 FROM ({_TEST_F1}) a JOIN ({_TEST_F1}) b ON a.fold = b.fold AND a.model < b.model GROUP BY 1, 2""")
def pair_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("low") <= F.col("difference")) & (F.col("difference") <= F.col("high"))
    adjusted = (F.col("p_value") > 0) & (F.col("p_value") <= F.col("p_holm")) & (F.col("p_holm") <= 1)
    return rounded(pair_tests(spark, sf_dir).select("first", "second", "difference", inside.alias("inside"), adjusted.alias("adjusted")))


@query("fold_wins", f"""SELECT a.model AS first, b.model AS second, count(*) FILTER (WHERE a.macro_f1 > b.macro_f1) AS wins, count(*) FILTER (WHERE a.macro_f1 < b.macro_f1) AS losses,
 count(*) FILTER (WHERE a.macro_f1 = b.macro_f1) AS ties, round(avg(a.macro_f1 - b.macro_f1), 6) AS mean_difference FROM ({_TEST_F1}) a JOIN ({_TEST_F1}) b ON a.fold = b.fold AND a.model < b.model GROUP BY 1, 2""")
def fold_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.fold_wins(test_f1(spark, sf_dir)))


# A p-value for each pair of months, to adjust: the share of records of a month that are positive, by nation.
_P = f"""SELECT company, round(least(1.0, abs(avg(target_resolved) - 0.5) * 10), 6) AS p_value FROM ({Q.OBSERVED}) GROUP BY 1"""


@query("holm_adjustment", f"""SELECT company, p_value, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS significant FROM (SELECT company, p_value, max(least(1.0, p_value * (m - rank + 1))) OVER (ORDER BY rank) AS p_holm
 FROM (SELECT *, row_number() OVER (ORDER BY p_value, company) AS rank, count(*) OVER () AS m FROM ({_P})))""")
def holm_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = S.order_cases(spark, sf_dir).groupBy("company").agg(F.round(F.least(F.lit(1.0), F.abs(F.avg("target_resolved") - 0.5) * 10), 6).alias("p_value"))
    return rounded(compare.holm(tests, order=["company"]))


@query("model_summary", f"""SELECT model, count(DISTINCT fold) AS folds, round(avg(macro_f1), 6) AS macro_f1_mean, round(coalesce(stddev_samp(macro_f1), 0), 6) AS macro_f1_std,
 round(min(macro_f1), 6) AS macro_f1_min, round(max(macro_f1), 6) AS macro_f1_max FROM ({_TEST_F1}) GROUP BY 1""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.metric_summary(test_f1(spark, sf_dir), ["model"], ["macro_f1"]))


@query("fold_pivot", "SELECT fold, " + ", ".join(f"round(max(macro_f1) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in _MASK_MODELS) + f" FROM ({_TEST_F1}) GROUP BY 1")
def fold_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.fold_pivot(test_f1(spark, sf_dir), _MASK_MODELS))


@query("ablations", f"""SELECT base, extended, count(*) AS folds, round(avg(gain), 6) AS mean, round(coalesce(stddev_samp(gain), 0), 6) AS std, round(min(gain), 6) AS least, round(max(gain), 6) AS most,
 count(*) FILTER (WHERE gain > 0) AS improved FROM (SELECT base, extended, y.macro_f1 - x.macro_f1 AS gain FROM (VALUES ('m1', 'good'), ('m2', 'm1'), ('m3', 'm2')) p(base, extended)
 JOIN ({_TEST_F1}) x ON x.model = base JOIN ({_TEST_F1}) y ON y.model = extended AND y.fold = x.fold) GROUP BY 1, 2""")
def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.ablations(test_f1(spark, sf_dir), [("m1", "good"), ("m2", "m1"), ("m3", "m2")]))


@query("seed_stability", f"""SELECT model, count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most
 FROM (SELECT CASE WHEN model = 'good' THEN 'good' ELSE 'plain' END AS model, model AS seed, avg(macro_f1) AS v FROM ({_TEST_F1}) GROUP BY ALL) GROUP BY 1""")
def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three uninformed stand-ins are taken as seeds of one model."""
    seeds = test_f1(spark, sf_dir).withColumns({"seed": F.col("model"), "model": F.when(F.col("model") == "good", "good").otherwise("plain")})
    return rounded(report.seed_stability(seeds))


@query("temporal_stability", f"""SELECT model, round(coalesce(regr_slope(macro_f1, i), 0), 6) AS slope, count(*) AS months, round(avg(macro_f1), 6) AS mean, round(min(macro_f1), 6) AS least, round(max(macro_f1), 6) AS most
 FROM (SELECT model, macro_f1, row_number() OVER (PARTITION BY model ORDER BY month) - 1 AS i FROM (SELECT model, month, {Q.macro('tp', 'fp', 'fn', 'tn')} AS macro_f1 FROM ({Q.confusion(_MONTHLY, 'model, month')}))) GROUP BY 1""")
def temporal_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluation.confusion(scored(spark, sf_dir, ("test",)).withColumn("month", F.date_format("opening_date", "yyyy-MM")), ["model", "month"])
    monthly = cells.select("model", "month", evaluation.macro_f1(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).alias("macro_f1"))
    return rounded(report.monthly_trend(monthly, ["model"]))


_SPREAD = ", ".join(
    f"round(avg({v}), 9) AS {v}_mean, round(coalesce(stddev_samp({v}), 0), 9) AS {v}_std, round(min({v}), 6) AS {v}_min, round(max({v}), 6) AS {v}_max" for v in ("accuracy", "macro_f1")
)


@query("company_generalisation", f"""SELECT model, segment, count(DISTINCT fold) AS folds, {_SPREAD}, CAST(sum(records) AS BIGINT) AS records, round(sum(accuracy * records) / sum(records), 9) AS weighted_mean
 FROM ({metric_set_sql(_SEGMENTED, 'model, fold, segment')}) GROUP BY 1, 2""")
def company_generalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread over folds by segment, and accuracy weighted by the records of a fold."""
    return rounded(report.segment_summary(segment_metrics(spark, sf_dir), ["model", "segment"], ["accuracy", "macro_f1"], "accuracy"), 9)  # means of values of six places end in a 5


_CHANGES = ", ".join(
    f"round(avg({m}) FILTER (WHERE stage = 'before'), 6) AS {m}_before, round(avg({m}) FILTER (WHERE stage = 'after'), 6) AS {m}_after,"
    f" round(avg({m}) FILTER (WHERE stage = 'after') - avg({m}) FILTER (WHERE stage = 'before'), 6) AS {m}_change" for m in ("brier_score", "ece", "macro_f1")
)
_BETTER = ", ".join(f"count(*) FILTER (WHERE {gain} > {compare.GAIN}) AS {m}_improved" for m, gain in (("brier_score", "b.brier_score - a.brier_score"), ("ece", "b.ece - a.ece"), ("macro_f1", "a.macro_f1 - b.macro_f1")))


@query("calibration_summary", _platt_sql() + f""", pb AS (SELECT model, fold, stage, avg((score - target_resolved) * (score - target_resolved)) AS brier_score FROM pj GROUP BY ALL),
 py AS (SELECT pf.model, pf.fold, pf.stage, pb.brier_score, ece, macro_f1 FROM pf JOIN pe USING (model, fold, stage) JOIN pb USING (model, fold, stage))
 SELECT * FROM (SELECT model, count(DISTINCT fold) AS folds, {_CHANGES} FROM py GROUP BY 1) JOIN (SELECT a.model, {_BETTER} FROM py a JOIN py b ON a.model = b.model AND a.fold = b.fold AND a.stage = 'after' AND b.stage = 'before' GROUP BY 1) USING (model)""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score, calibration error and macro-F1 before and after calibration, over folds."""
    return rounded(compare.calibration_summary(_calibration_change(spark, sf_dir)))
