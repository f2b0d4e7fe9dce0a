"""Ranking and threshold metrics of long predictions, by any group keys.

All of them start from the counts of each distinct score. Running counts over descending scores are taken in
two steps, within equal-width score bands and over the few band totals, so that even a single
group with very many distinct scores is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C

BANDS = 256
TIE = 1e-12


def score_counts(predictions: DataFrame, keys: list[str], score: str = "score", target: str = "target_resolved") -> DataFrame:
    """keys, score, n, p: how many rows and positives share a score."""
    return predictions.groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("p"))


def running_counts(counts: DataFrame, keys: list[str], bands: int = BANDS) -> DataFrame:
    """Add ``cn`` and ``cp`` (rows and positives with this score or a higher one), ``total`` and ``positives`` of the group."""
    return _swept(counts, keys, bands).drop("band")


def _swept(counts: DataFrame, keys: list[str], bands: int = BANDS) -> DataFrame:
    """``running_counts`` with the ``band`` of each score, by which the rows lie together."""
    band = F.least(F.greatest(F.floor(F.col("score") * bands), F.lit(0)), F.lit(bands - 1)).cast("int")
    held = counts.withColumn("band", band)
    above = Window.partitionBy(*keys).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = held.groupBy(*keys, "band").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp")).select(
        *keys, "band",
        F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"),
        F.sum("bn").over(whole).alias("total"), F.sum("bp").over(whole).alias("positives"),
    )
    inside = Window.partitionBy(*keys, "band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    joined = held.withColumns({"cn": F.sum("n").over(inside), "cp": F.sum("p").over(inside)}).join(sums, [*keys, "band"])
    return joined.select(
        *keys, "band", "score", "n", "p", (F.col("cn") + F.col("an")).alias("cn"), (F.col("cp") + F.col("ap")).alias("cp"), "total", "positives"
    )


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean F1 of both classes; 0 for an empty denominator."""
    return (C.ratio(2 * tp, 2 * tp + fp + fn) + C.ratio(2 * tn, 2 * tn + fp + fn)) / 2


def best_threshold(predictions: DataFrame, keys: list[str], score: str = "score", target: str = "target_resolved") -> DataFrame:
    """keys, threshold, macro_f1: of the thresholds within ``TIE`` of the best, the nearest to one half, then the higher.

    Candidates are the distinct scores and a value just above the highest, which predicts no positive.
    """
    return threshold_of(score_counts(predictions, keys, score, target), keys)


def threshold_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``best_threshold`` from keys, score, n, p.

    In each band, where the rows lie together anyway, only those within ``TIE`` of the band's best stay; of these few the group's best are taken.
    """
    tp, fp = F.col("cp"), F.col("cn") - F.col("cp")
    fn = F.col("positives") - F.col("cp")
    tn = F.col("total") - F.col("cn") - fn
    scored = _swept(counts, keys).select(*keys, "band", F.col("score").alias("threshold"), macro_f1(tp, fp, fn, tn).alias("macro_f1"))
    near = lambda by: F.col("macro_f1") >= F.max("macro_f1").over(Window.partitionBy(*by)) - TIE
    in_band = scored.withColumn("near", near([*keys, "band"])).where("near").select(*keys, "threshold", "macro_f1")
    top = counts.groupBy(*keys).agg(F.max("score").alias("top"), F.sum("n").alias("total"), F.sum("p").alias("positives"))
    none = top.select(
        *keys, F.java_method(F.lit("java.lang.Math"), F.lit("nextUp"), F.col("top")).cast("double").alias("threshold"),
        macro_f1(F.lit(0), F.lit(0), F.col("positives"), F.col("total") - F.col("positives")).alias("macro_f1"),
    )
    kept = in_band.unionByName(none).withColumn("near", near(keys)).where("near")
    chosen = F.max_by(F.struct("threshold", "macro_f1"), F.struct(-F.abs(F.col("threshold") - 0.5), "threshold"))
    return kept.groupBy(*keys).agg(chosen.alias("x")).select(*keys, "x.*")


def confusion(predictions: DataFrame, keys: list[str], prediction: str = "prediction", target: str = "target_resolved") -> DataFrame:
    """keys, tp, fp, fn, tn."""
    y, z = F.col(target) == 1, F.col(prediction) == 1
    return predictions.groupBy(*keys).agg(
        C.count_if(y & z).alias("tp"), C.count_if(~y & z).alias("fp"), C.count_if(y & ~z).alias("fn"), C.count_if(~y & ~z).alias("tn")
    )


def class_metrics() -> dict[str, Column]:
    """Accuracy, balanced accuracy, precision, recall and F1 of both classes, macro-F1 from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    here, there = (tp + fn > 0).cast("int"), (tn + fp > 0).cast("int")
    return {
        "accuracy": C.ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": C.ratio(C.ratio(tp, tp + fn) + C.ratio(tn, tn + fp), here + there),
        "precision_resolved": C.ratio(tp, tp + fp), "recall_resolved": C.ratio(tp, tp + fn), "f1_resolved": C.ratio(2 * tp, 2 * tp + fp + fn),
        "precision_unresolved": C.ratio(tn, tn + fn), "recall_unresolved": C.ratio(tn, tn + fp), "f1_unresolved": C.ratio(2 * tn, 2 * tn + fp + fn),
        "macro_f1": macro_f1(tp, fp, fn, tn),
    }


def rank_metrics(predictions: DataFrame, keys: list[str], score: str = "score", target: str = "target_resolved") -> DataFrame:
    """keys, roc_auc (NaN with one class), pr_auc (average precision, 0 without positives), brier_score."""
    return ranks_of(score_counts(predictions, keys, score, target), keys)


def ranks_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``rank_metrics`` from keys, score, n, p."""
    swept = running_counts(counts, keys)
    p, cp, cn = F.col("p"), F.col("cp"), F.col("cn")
    negatives = F.col("total") - F.col("positives")
    tied = F.col("n") - p
    below = negatives - (cn - cp)
    summed = swept.groupBy(*keys).agg(
        F.sum(p * (below + tied / F.lit(2.0))).alias("wins"), F.max("positives").alias("positives"), F.max("total").alias("total"),
        F.sum(p.cast("double") * cp / cn).alias("steps"),
        F.sum((F.col("n") - p) * F.col("score") * F.col("score") + p * (1 - F.col("score")) * (1 - F.col("score"))).alias("squares"),
    )
    pairs = F.col("positives").cast("double") * (F.col("total") - F.col("positives"))
    return summed.select(
        *keys,
        F.when(pairs > 0, F.col("wins") / pairs).otherwise(F.lit(float("nan"))).alias("roc_auc"),
        C.ratio(F.col("steps"), F.col("positives")).alias("pr_auc"),
        (F.col("squares") / F.col("total")).alias("brier_score"),
    )


def metric_set(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics of stored scores and predictions by keys, with row count and rate."""
    return _all_metrics(confusion(predictions, keys)).join(rank_metrics(predictions, keys), keys)


def _all_metrics(cells: DataFrame) -> DataFrame:
    sized = cells.withColumns(class_metrics()).withColumn("records", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("long"))
    return sized.withColumn("positive_rate", C.ratio(F.col("tp") + F.col("fn"), F.col("records")))


def confusion_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn, tn from keys, score, n, p and the ``threshold`` of each row's keys."""
    said, p, q = F.col("score") >= F.col("threshold"), F.col("p"), F.col("n") - F.col("p")
    cells = {"tp": (said, p), "fp": (said, q), "fn": (~said, p), "tn": (~said, q)}
    return counts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long").alias(c) for c, (where, n) in cells.items()])


def metric_set_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``metric_set`` from keys, score, n, p and ``threshold``."""
    return _all_metrics(confusion_of(counts, keys)).join(ranks_of(counts, keys), keys)


def at_threshold(predictions: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Add ``prediction``: 1 from the keys' threshold on; the table of thresholds has a row for each model and fold."""
    return predictions.join(F.broadcast(thresholds.select(*keys, "threshold")), keys).withColumn(
        "prediction", (F.col(score) >= F.col("threshold")).cast("int")
    )


def calibration_bins(predictions: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, bin (from 1), records, mean_score, observed_rate of the non-empty equal-width bins; the last is closed."""
    place = F.least(F.greatest(F.floor(F.col("score") * bins), F.lit(0)), F.lit(bins - 1)).cast("long") + 1
    return predictions.groupBy(*keys, place.alias("bin")).agg(
        F.count("*").alias("records"), F.avg("score").alias("mean_score"), F.avg(F.col("target_resolved").cast("double")).alias("observed_rate")
    )


def calibration_error(predictions: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, ece, max_gap: the gaps between score and rate over the bins, weighted and largest."""
    return _gaps(calibration_bins(predictions, keys, bins), keys)


def calibration_error_of(counts: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``calibration_error`` from keys, score, n, p."""
    place = F.least(F.greatest(F.floor(F.col("score") * bins), F.lit(0)), F.lit(bins - 1)).cast("long") + 1
    return _gaps(counts.groupBy(*keys, place.alias("bin")).agg(
        F.sum("n").alias("records"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean_score"), (F.sum("p") / F.sum("n")).alias("observed_rate")
    ), keys)


def _gaps(bins: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("mean_score") - F.col("observed_rate"))
    return bins.groupBy(*keys).agg(
        (F.sum(gap * F.col("records")) / F.sum("records")).alias("ece"), F.max(gap).alias("max_gap")
    )


def risk_ranking(predictions: DataFrame, keys: list[str], fractions: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """Precision, recall and lift of unresolved cases in the riskiest shares; ties at the edge count by their expected hits."""
    risky = predictions.select(*keys, (1 - F.col("score")).alias("score"), (1 - F.col("target_resolved")).alias("bad"))
    swept = running_counts(score_counts(risky, keys, "score", "bad"), keys)
    share = F.explode(F.array(*[F.lit(f) for f in fractions]))
    asked = swept.withColumn("fraction", share).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("fraction"))).cast("long"))
    edge = asked.where((F.col("cn") >= F.col("k")) & (F.col("cn") - F.col("n") < F.col("k")))
    hits = (F.col("cp") - F.col("p")) + (F.col("k") - (F.col("cn") - F.col("n"))) * F.col("p").cast("double") / F.col("n")
    base = C.ratio(F.col("positives"), F.col("total"))
    return edge.select(*keys, "fraction", "k", hits.alias("hits"), "total", "positives").select(
        *keys, "fraction", "k", "hits", (F.col("hits") / F.col("k")).alias("precision"), C.ratio(F.col("hits"), F.col("positives")).alias("recall"),
        C.ratio(F.col("hits") / F.col("k"), base).alias("lift"),
    )
