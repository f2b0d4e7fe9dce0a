"""Baselines, fusion, calibration, segments, and the comparison of models."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import evaluation as E


def baseline_scores(cases: DataFrame, by_company: DataFrame, by_fold: DataFrame) -> DataFrame:
    """Global prior and company rate for assigned cases (with ``fold``, ``split``); unseen companies get the prior."""
    joined = cases.join(F.broadcast(by_fold.select("fold", "all_n", "all_p")), "fold").join(by_company, ["fold", "company"], "left")
    prior = C.ratio(F.col("all_p"), F.col("all_n"), 0.5)
    seen = F.col("company_n").isNotNull()
    return joined.withColumns({
        "global_score": prior, "company_score": F.when(seen, F.col("company_p").cast("double") / F.col("company_n")).otherwise(prior),
        "company_seen": F.when(seen, 1).otherwise(0),
    }).drop("all_n", "all_p", "company_n", "company_p")


def unpivoted(scores: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """Long form: a row for each model with its score."""
    made = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in models.items()]))
    return scores.select(*keep, made.alias("x")).select(*keep, "x.*")


def company_segment(count, frequent: int = 100):
    return F.when(F.coalesce(count, F.lit(0)) == 0, "unseen").when(count < frequent, "rare").otherwise("frequent")


def with_segments(predictions: DataFrame, by_company: DataFrame, frequent: int = 100) -> DataFrame:
    """Each prediction under ``all`` and under its company's segment; by_company has fold, company, company_n."""
    joined = predictions.join(by_company.select("fold", "company", "company_n"), ["fold", "company"], "left")
    tags = F.array(F.lit("all"), company_segment(F.col("company_n"), frequent))
    return joined.withColumn("segment", F.explode(tags)).drop("company_n")


def fusion_candidates(pairs: DataFrame, weights: list[float], keys: list[str]) -> DataFrame:
    """Both scores of a record combined under each weight; pairs has a, b and the keys."""
    return pairs.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights]))).withColumn(
        "score", F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b")
    )


def choose_fusion(validation: DataFrame, weights: list[float], keys: list[str]) -> DataFrame:
    """keys, weight, threshold, macro_f1: best macro-F1, then weight and threshold nearest one half, then the lower weight."""
    pairs = validation.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"), F.sum("target_resolved").cast("long").alias("p"))  # weights meet distinct pairs
    counts = fusion_candidates(pairs, weights, keys).groupBy(*keys, "weight", "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    tried = E.threshold_of(counts, [*keys, "weight"])
    order = Window.partitionBy(*keys).orderBy(
        F.desc("macro_f1"), F.abs(F.col("weight") - 0.5), F.abs(F.col("threshold") - 0.5), "weight"
    )
    return tried.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def fit_platt(validation: DataFrame, keys: list[str], ridge: float = 1e-6, steps: int = 12) -> DataFrame:
    """keys, slope, intercept of target on logit(score) for all groups at once.

    """
    return platt_of(E.score_counts(validation, keys), keys, ridge, steps)


def platt_of(counts: DataFrame, keys: list[str], ridge: float = 1e-6, steps: int = 12) -> DataFrame:
    """``fit_platt`` from keys, score, n, p. Pass a written table of counts: each step reads it once.

    Newton steps on sums by group: each is one aggregation of score counts, joined with a row of coefficients for each group.
    """
    counts = counts.withColumn("x", C.logit(F.col("score")))
    # From a flat curve at the group's rate on; from a steep one Newton's steps can run away.
    model = counts.groupBy(*keys).agg(F.lit(0.0).alias("slope"), F.ln((F.sum("p") + 0.5) / (F.sum("n") - F.sum("p") + 0.5)).alias("intercept"))
    for _ in range(steps):
        z = F.col("slope") * F.col("x") + F.col("intercept")
        q = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))
        held = counts.join(F.broadcast(model), keys).withColumns({"q": q, "v": F.col("n") * q * (1 - q), "r": F.col("p") - F.col("n") * q})
        sums = held.groupBy(*keys, "slope", "intercept").agg(
            F.sum(F.col("v") * F.col("x") * F.col("x")).alias("hxx"), F.sum(F.col("v") * F.col("x")).alias("hx"), F.sum("v").alias("h"),
            F.sum(F.col("r") * F.col("x")).alias("gx"), F.sum("r").alias("g"),
        )
        hxx = F.col("hxx") + ridge
        gx = F.col("gx") - ridge * F.col("slope")
        det = hxx * F.col("h") - F.col("hx") * F.col("hx")
        safe = F.when(F.abs(det) > 1e-12, det)
        model = sums.select(
            *keys,
            (F.col("slope") + F.coalesce((F.col("h") * gx - F.col("hx") * F.col("g")) / safe, F.lit(0.0))).alias("slope"),
            (F.col("intercept") + F.coalesce((hxx * F.col("g") - F.col("hx") * gx) / safe, F.lit(0.0))).alias("intercept"),
        )
        # A row for each group, as literals of the next step's plan: all steps have the same short plan, compiled once.
        model = model.sparkSession.createDataFrame(model.collect(), model.schema)
    return model


def calibration_change(counts: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stage, slope, intercept, usable, threshold, macro_f1, roc_auc, pr_auc, brier_score, ece, max_gap on test, before and after.

    ``counts`` has keys, split (validation, test), score, n, p. Thresholds are tuned on validation before and again after; a
    curve is usable if its slope is positive, as another one turns the ranking round.
    """
    curves = model.select(*keys, "slope", "intercept", (F.col("slope") > 0).alias("usable"))
    after = F.when(F.col("stage") == "before", F.col("score")).otherwise(1 / (1 + F.exp(-(F.col("slope") * C.logit(F.col("score")) + F.col("intercept")))))
    staged = counts.withColumn("stage", F.explode(F.array(F.lit("before"), F.lit("after")))).join(F.broadcast(curves), keys).withColumn("score", after)
    by = [*keys, "stage"]
    # Scores that one curve rounds to the same value meet again.
    held = staged.groupBy(*by, "split", "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    tuned = E.threshold_of(held.where("split = 'validation'"), by).select(*by, "threshold")
    test = held.where("split = 'test'").join(F.broadcast(tuned), by)
    cells = E.confusion_of(test, [*by, "threshold"]).select(*by, "threshold", E.macro_f1(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).alias("macro_f1"))
    return cells.join(E.ranks_of(test, by), by).join(E.calibration_error_of(test, by), by).join(F.broadcast(curves), keys)


#: A gain counts from here on: sums of doubles in another order differ by less.
GAIN = 1e-12


def calibration_summary(change: DataFrame) -> DataFrame:
    """By model: means over folds of each measure before and after, the mean change, and in how many folds it got better."""
    wide = change.groupBy("model", "fold").agg(*[
        F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"{m}_{s}") for m in ("brier_score", "ece", "macro_f1") for s in ("before", "after")
    ])
    out = [F.count("*").alias("folds")]
    for m, better in (("brier_score", -1), ("ece", -1), ("macro_f1", 1)):
        gain = F.col(f"{m}_after") - F.col(f"{m}_before")
        out += [F.avg(f"{m}_before").alias(f"{m}_before"), F.avg(f"{m}_after").alias(f"{m}_after"), F.avg(gain).alias(f"{m}_change"), C.count_if(gain * better > GAIN).alias(f"{m}_improved")]
    return wide.groupBy("model").agg(*out)


def calibrated(predictions: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Scores through each group's fitted curve, as ``score``; the raw one stays as ``raw_score``."""
    joined = predictions.join(F.broadcast(model), keys).withColumnRenamed("score", "raw_score")
    z = F.col("slope") * C.logit(F.col("raw_score")) + F.col("intercept")
    return joined.withColumn("score", 1 / (1 + F.exp(-z))).drop("slope", "intercept")


def _bits(predictions: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """A row for each record: rows, models seen, models that say 1, models that say 0, least and greatest target; one shuffle for all models."""
    place = F.element_at(F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))]), F.col("model"))
    bits = predictions.where(F.col("model").isin(*models)).withColumn("bit", F.pow(F.lit(2.0), place).cast("long"))
    held = lambda said: F.coalesce(F.bit_or(F.when(F.col("prediction") == said, F.col("bit"))), F.lit(0).cast("long"))
    return bits.groupBy(*keys, "record_id").agg(
        F.count("*").alias("rows_"), F.bit_or("bit").alias("seen"), held(1).alias("ones"), held(0).alias("zeros"),
        F.min("target_resolved").alias("target_resolved"), F.max("target_resolved").alias("other_target"),
    )


def complete_masks(predictions: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """One row for each record that every model predicts: target and a bit for each model that says 1.

    Rows of a model that repeat a record and agree count once. A record whose rows disagree, in a model's prediction or in the target, is left out, as is
    one that a model lacks or only predicts as null or something other than 0 and 1; ``mask_faults`` counts these.
    """
    whole = F.lit((1 << len(models)) - 1)
    return _bits(predictions, models, keys).where(
        (F.col("ones").bitwiseOR(F.col("zeros")) == whole) & (F.col("ones").bitwiseAND(F.col("zeros")) == 0) & (F.col("target_resolved") == F.col("other_target"))
    ).select(*keys, "record_id", "target_resolved", F.col("ones").alias("mask"))


def mask_faults(predictions: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """By keys: records, those that a model lacks, surplus rows, and records with rows that disagree or with no usable prediction of a model that has rows."""
    seen, ones, zeros = (F.col(c) for c in ("seen", "ones", "zeros"))
    disagree = (ones.bitwiseAND(zeros) != 0) | (F.col("target_resolved") != F.col("other_target"))
    return _bits(predictions, models, keys).groupBy(*keys).agg(
        F.count("*").alias("records"), C.count_if(F.bit_count(seen) < len(models)).alias("incomplete"),
        F.sum(F.col("rows_") - F.bit_count(seen)).cast("long").alias("surplus"), C.count_if(disagree).alias("contradicting"),
        C.count_if(F.bit_count(ones.bitwiseOR(zeros)) < F.bit_count(seen)).alias("unusable"),
    )


def pair_cells(masks: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """keys, first, second, target_resolved, first_prediction, second_prediction, n for every pair of models."""
    small = masks.groupBy(*keys, "target_resolved", "mask").agg(F.count("*").alias("n"))
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    bit = lambda i: F.shiftright(F.col("mask"), i).bitwiseAND(F.lit(1)).cast("int")
    made = F.explode(F.array(*[
        F.struct(F.lit(models[i]).alias("first"), F.lit(models[j]).alias("second"), bit(i).alias("a"), bit(j).alias("b")) for i, j in pairs
    ]))
    return small.select(*keys, "target_resolved", "n", made.alias("x")).groupBy(
        *keys, "x.first", "x.second", "target_resolved", F.col("x.a").alias("first_prediction"), F.col("x.b").alias("second_prediction")
    ).agg(F.sum("n").cast("long").alias("n"))


def _macro_f1(tp, fp, fn, tn):
    import numpy as np

    def ratio(a, b):
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)

    return (ratio(2.0 * tp, 2.0 * tp + fp + fn) + ratio(2.0 * tn, 2.0 * tn + fp + fn)) / 2


def _replicated(groups: DataFrame, replicates: int, chunk: int, seed: int) -> DataFrame:
    """Each group once for each chunk of replicates; the seed of a chunk depends on group and chunk alone."""
    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // chunk) - 1)))
    return groups.withColumn("chunk", chunks).withColumn("seed", F.abs(F.xxhash64(F.lit(seed), "name", "chunk"))).repartition("name", "chunk")


def bootstrap(cells: DataFrame, replicates: int = 10_000, chunk: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean over folds of macro-F1 by model, with percentile bounds over multinomial draws of the four cells of each fold.

    ``cells`` has model, fold, tp, fp, fn, tn: sufficient for any number of rows.
    """
    groups = cells.groupBy(F.col("model").alias("name")).agg(F.sort_array(F.collect_list(F.struct("fold", "tp", "fp", "fn", "tn"))).alias("folds"))

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rng = np.random.default_rng(row.seed)
                total = np.zeros(chunk)
                for f in row.folds:
                    cell = np.array([f["tp"], f["fp"], f["fn"], f["tn"]], dtype=np.int64)
                    total += _macro_f1(*rng.multinomial(cell.sum(), cell / cell.sum(), chunk).T)
                yield pd.DataFrame({"name": row.name, "place": row.chunk * chunk + np.arange(chunk), "value": total / len(row.folds)})

    drawn = _replicated(groups, replicates, chunk, seed).select("name", "folds", "chunk", "seed").mapInPandas(draw, "name string, place long, value double")
    low, high = (1 - level) / 2, (1 + level) / 2
    bounds = drawn.where(F.col("place") < replicates).groupBy(F.col("name").alias("model")).agg(
        F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"), F.count("*").alias("replicates")
    )
    seen = cells.groupBy("model").agg(F.avg(E.macro_f1(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])).alias("macro_f1"))
    return seen.join(bounds, "model")


def _pair_groups(cells: DataFrame) -> DataFrame:
    held = F.struct("fold", "target_resolved", "first_prediction", "second_prediction", "n")
    return cells.groupBy("first", "second").agg(F.sort_array(F.collect_list(held)).alias("cells")).withColumn("name", F.concat_ws("|", "first", "second"))


def _eight(cells) -> dict:
    """By fold: counts[target, first, second]."""
    import numpy as np

    found: dict = {}
    for c in cells:
        found.setdefault(c["fold"], np.zeros((2, 2, 2), dtype=np.int64))[c["target_resolved"], c["first_prediction"], c["second_prediction"]] += c["n"]
    return found


def _difference(n):
    """First minus second model's macro-F1 from counts[..., target, first, second]."""
    a, b = n.sum(axis=-1), n.sum(axis=-2)
    return _macro_f1(a[..., 1, 1], a[..., 0, 1], a[..., 1, 0], a[..., 0, 0]) - _macro_f1(b[..., 1, 1], b[..., 0, 1], b[..., 1, 0], b[..., 0, 0])


def compare_pairs(cells: DataFrame, replicates: int = 10_000, chunk: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """For each pair: mean difference of macro-F1, paired bootstrap bounds, and the permutation p-value.

    Both draw from the eight joint cells of each fold: multinomially, and by swapping discordant predictions with
    chance one half within each class. Folds are averaged within a replicate.
    """

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rng = np.random.default_rng(row.seed)
                folds = _eight(row.cells)
                seen = np.mean([_difference(n) for n in folds.values()])
                boot, swap = np.zeros(chunk), np.zeros(chunk)
                for n in folds.values():
                    boot += _difference(rng.multinomial(n.sum(), n.ravel() / n.sum(), chunk).reshape(-1, 2, 2, 2))
                    swapped = np.repeat(n[None], chunk, axis=0)
                    for t in (0, 1):
                        m = n[t, 0, 1] + n[t, 1, 0]
                        swapped[:, t, 0, 1] = rng.binomial(m, 0.5, chunk)
                        swapped[:, t, 1, 0] = m - swapped[:, t, 0, 1]
                    swap += _difference(swapped)
                far = np.abs(swap / len(folds)) >= abs(seen) - 1e-15
                yield pd.DataFrame({
                    "first": row.first, "second": row.second, "difference": seen, "place": row.chunk * chunk + np.arange(chunk),
                    "value": boot / len(folds), "far": far,
                })

    groups = _replicated(_pair_groups(cells), replicates, chunk, seed).select("first", "second", "cells", "chunk", "seed")
    drawn = groups.mapInPandas(draw, "first string, second string, difference double, place long, value double, far boolean")
    drawn = drawn.where(F.col("place") < replicates)
    low, high = (1 - level) / 2, (1 + level) / 2
    return drawn.groupBy("first", "second").agg(
        F.first("difference").alias("difference"), F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"),
        ((C.count_if(F.col("far")) + 1) / (F.count("*") + 1)).alias("p_value"),
    )


def holm(tests: DataFrame, p: str = "p_value", order: list[str] | None = None, level: float = 0.05) -> DataFrame:
    """Add ``p_holm``, step-down adjusted over all rows, and ``significant``. The table has a row for each test."""
    w = Window.orderBy(p, *(order or []))
    ranked = tests.withColumns({"rank": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy())})
    stepped = ranked.withColumn("raw", F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("rank") + 1)))
    adjusted = stepped.withColumn("p_holm", F.max("raw").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return adjusted.withColumn("significant", F.col("p_holm") < level).drop("rank", "m", "raw")


def fold_wins(metrics: DataFrame, value: str = "macro_f1") -> DataFrame:
    """first, second, wins, losses, ties, mean_difference over folds for every pair of models (a row for each model and fold)."""
    a = metrics.select("fold", F.col("model").alias("first"), F.col(value).alias("x"))
    b = metrics.select("fold", F.col("model").alias("second"), F.col(value).alias("y"))
    both = a.join(b, "fold").where("first < second")
    return both.groupBy("first", "second").agg(
        C.count_if(F.col("x") > F.col("y")).alias("wins"), C.count_if(F.col("x") < F.col("y")).alias("losses"),
        C.count_if(F.col("x") == F.col("y")).alias("ties"), F.avg(F.col("x") - F.col("y")).alias("mean_difference"),
    )
