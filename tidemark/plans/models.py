"""Queries of the fitted models: feature sets, tuning, folds, seeds, rounds and epochs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, history, models, report, tuning, vectorize
from tidemark.plans.core import FOLD_ARGS, IDS, TRAIN_START, query, rounded, shared, written
from tidemark.plans.text import _LONG_HISTORY, METADATA, NUMBERS, TERMS, ends, text_blocks, text_rows, text_vocabulary, tuning_split
from tidemark.sources import cases as S

#: Feature sets of the linear model, as blocks of one matrix.
FEATURE_SETS = {
    "word": ["word"], "char": ["char"], "word_char": ["word", "char"], "metadata": ["metadata"], "metadata_company": ["metadata", "company"],
    "text_metadata": ["word", "metadata", "company"], "text_metadata_history": ["word", "metadata", "company", "history"],
    "text_metadata_recent_history": ["word", "metadata", "company", "history", "recent"],
}
PERIODS = {"train": "opening_date <= DATE '2024-06-30'", "validation": "opening_date BETWEEN DATE '2024-07-01' AND DATE '2024-09-30'", "test": "opening_date > DATE '2024-09-30'"}
LATER = ("validation", "test")


def parts_of(table: DataFrame, features: str = "features") -> dict[str, DataFrame]:
    """Train, validation and test of a table with opening_date, and one vector column as ``features``."""
    own = table.select("record_id", "opening_date", "target_resolved", F.col(features).alias("features"))
    return {split: own.where(period) for split, period in PERIODS.items()}


def text_vectors(spark: SparkSession, sf_dir: str, sets: dict[str, list[str]]) -> DataFrame:
    """Labelled cases with a vector column for each feature set. A block is written once, whatever sets have it; sets are put together where they are read."""
    needed = {b for own in sets.values() for b in own}
    texts, rows = text_rows(spark, sf_dir)
    kinds = {name: text_vocabulary(spark, texts, name) for name in TERMS if name in needed}
    sizes = {f"{name}_block": max(known.count(), 1) for name, known in kinds.items()}
    if numbers := needed - set(kinds):
        rows, blocks, _ = text_blocks(spark, sf_dir, numbers, (texts, rows))
        matrix, index = models.feature_matrix(blocks, ["record_id"], write=written)
        size = index.count()
        sizes |= {f"{b}_block": size for b in blocks}
        rows = written(rows.join(models.feature_sets(matrix, {f"{b}_block": [b] for b in blocks}, ["record_id"], size, shared(spark)), "record_id"))
    if kinds:
        # Texts are cut in a fixed number of partitions, which adaptive execution doesn't join to a few large ones.
        placed = texts.select("record_id", "complaint_text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record_id").join(rows, "record_id")
        terms = {f"{name}_block": TERMS[name][0](F.col("complaint_text")) for name in kinds}
        rows = models.term_vectors(placed, terms, {f"{name}_block": known for name, known in kinds.items()}, shared(spark))
    return models.joined_sets(rows, {name: [f"{b}_block" for b in own] for name, own in sets.items()}, sizes)


def fit_judged(parts: dict[str, DataFrame], fit, name: str) -> DataFrame:
    """Threshold tuned on validation, metrics of validation and test."""
    return models.judged(models.scored_sets(fit(parts["train"]), {k: parts[k] for k in LATER}, model=name), ["model"])


@query("feature_set_models")
def feature_set_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear model on each feature set: threshold tuned on the quarter after training, metrics of it and of what comes later."""
    table = text_vectors(spark, sf_dir, FEATURE_SETS)

    def scored(name):
        parts = parts_of(table, name)
        return models.scored_sets(models.fit_logistic(parts["train"], 1e-3, 20), {k: parts[k] for k in LATER}, model=name)

    scores = written(reduce(DataFrame.unionByName, models.side_by_side(scored, FEATURE_SETS)))
    return rounded(models.judged(scores, ["model"]))


@query("text_bayes_model")
def text_bayes_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complement naive Bayes on TF-IDF weights of labelled documents, judged on later ones."""
    docs = S.text_cases(spark, sf_dir).where("target_resolved IS NOT NULL")
    counts = vectorize.term_counts(docs, vectorize.word_ngrams(F.col("complaint_text")), ["record_id", "opening_date"])
    vocabulary = vectorize.vocabulary_of(counts, docs, ends(spark).where("fold = 1"), 5, 0.9, 100_000)
    vocabulary = written(vocabulary)
    weights = vectorize.tfidf(counts, vectorize.measured(vocabulary, "term"), ["record_id"]).withColumnsRenamed({"term": "feature", "weight": "value"})
    matrix, index = models.feature_matrix({"word": weights}, ["record_id"], {"word": vocabulary.select(F.col("term").alias("feature"))}, written)
    vectors = models.feature_sets(matrix, {"features": ["word"]}, ["record_id"], index.count(), shared(spark))
    rows = written(docs.select("record_id", "opening_date", "target_resolved").join(vectors, "record_id"))
    return rounded(fit_judged(parts_of(rows), models.fit_complement_bayes, "bayes"))


@query("sgd_epochs")
def sgd_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five epochs of mini-batch descent on words and metadata: the loss over all train rows after each, and what the last model reaches on validation and test."""
    parts = {k: written(v) for k, v in parts_of(text_vectors(spark, sf_dir, {"features": FEATURE_SETS["text_metadata"]})).items()}  # an epoch reads the train rows as they are fitted
    model, losses = models.fit_sgd(parts["train"], 1e-3, 5)
    found = models.judged(models.scored_sets(model, {k: parts[k] for k in LATER}, model="sgd"), ["model"])
    wide = found.groupBy("model", "threshold").pivot("split", list(LATER)).agg(F.first("macro_f1").alias("macro_f1"), F.first("pr_auc").alias("pr_auc"))
    epochs = spark.createDataFrame([("sgd", i, loss) for i, loss in enumerate(losses, 1)], "model string, epoch int, loss double")
    return rounded(epochs.join(wide, "model"))


def split_vectors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {k: models.assembled(v, NUMBERS) for k, v in tuning_split(spark, sf_dir).items()}


@query("logistic_model")
def logistic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit_judged(split_vectors(spark, sf_dir), lambda t: models.fit_logistic(t, 1e-4), "logistic"))


def tree_parts(parts: dict[str, DataFrame], categories: list[str], numbers: list[str]) -> dict[str, DataFrame]:
    """The splits with tree features, encoded as the train split has it, written."""
    encoder, columns = models.encode_trees(parts["train"], categories, numbers)
    keep = ["record_id", "opening_date", "target_resolved"]
    return {k: written(models.assembled(encoder.transform(v.select(*keep, *categories, *numbers)), columns).select(*keep, "features")) for k, v in parts.items()}


@query("tree_rounds")
def tree_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation loss after each boosting round, and which round is kept."""
    parts = tree_parts(tuning_split(spark, sf_dir), ["company"], NUMBERS)
    losses = models.round_losses(models.fit_trees(parts["train"], 20, rate=0.3), parts["validation"])
    kept = models.best_round(losses)
    return rounded(spark.createDataFrame([(i, loss, i == kept) for i, loss in enumerate(losses, 1)], "round int, loss double, kept boolean"), 12)


@query("tree_model")
def tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees cut at the round with the least validation loss."""
    parts = tree_parts(tuning_split(spark, sf_dir), ["company"], NUMBERS)
    whole = models.fit_trees(parts["train"], 20, rate=0.3)
    kept = models.best_round(models.round_losses(whole, parts["validation"]))
    return rounded(fit_judged(parts, lambda _: models.cut_trees(whole, kept), "trees").withColumn("best_round", F.lit(kept)))


@query("logistic_tuning")
def logistic_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strength of the linear model, fitted side by side and judged on validation."""
    parts = {k: written(v.select("record_id", "target_resolved", "features")) for k, v in split_vectors(spark, sf_dir).items() if k != "test"}
    tried = tuning.candidates("logistic", ["features"], models.fit_logistic, alpha=(1e-5, 1e-4, 1e-3))
    return rounded(tuning.successive_halving(parts["train"], parts["validation"], tried, written, rungs=1))


@query("tuning_grid")
def tuning_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear models, complement Bayes and trees on the same cases: a row for each candidate; bad ones are dropped on a third of the train rows."""
    table = text_vectors(spark, sf_dir, {"word": ["word"], "word_char": ["word", "char"]})
    categories, numbers = ["company", "uf"], [*METADATA, *_LONG_HISTORY]
    encoder, columns = models.encode_trees(table.where(PERIODS["train"]), categories, numbers)
    table = models.assembled(encoder.transform(table), columns).withColumnRenamed("features", "tabular")
    # Read in every pass of every fit: rows of one split, with vectors as they are fitted, and nothing that is worked out anew each time.
    train, validation = (written(table.where(PERIODS[split]).select("record_id", "target_resolved", "word", "word_char", "tabular")) for split in ("train", "validation"))

    def trees(some, depth, rate):
        whole = models.fit_trees(some, 10, int(depth), rate)
        return models.cut_trees(whole, models.best_round(models.round_losses(whole, validation.withColumnRenamed("tabular", "features"))))

    tried = [
        *tuning.candidates("linear", ["word", "word_char"], lambda some, alpha: models.fit_sgd(some, alpha)[0], alpha=(1e-5, 1e-4, 1e-3)),
        *tuning.candidates("bayes", ["word", "word_char"], models.fit_complement_bayes, smoothing=(0.1, 0.5, 1.0)),
        *tuning.candidates("trees", ["tabular"], trees, depth=(3, 5), rate=(0.1, 0.3)),
    ]
    return rounded(tuning.successive_halving(train, validation, tried, written))


def fold_tables(spark: SparkSession, sf_dir: str, step: int = 3, placed=lambda cases: cases, shaped=lambda rows: rows) -> tuple[list, DataFrame, DataFrame]:
    """(folds, train rows, later rows with fold and split): look-back history serves the train rows of all folds, frozen history the later ones.

    ``placed`` may write the cases first, ``shaped`` has the last word on the columns of both tables.
    """
    ranges = folds.temporal_folds(spark, *FOLD_ARGS, step=step)
    cases = placed(S.order_cases(spark, sf_dir).select(*IDS, "amount").where(F.col("opening_date") >= F.lit(TRAIN_START).cast("date")))
    later = folds.assign(cases, folds.splits(ranges, TRAIN_START).where("split <> 'train'"))
    angle = 2 * F.pi() * F.month("opening_date") / 12
    more = {"amount_log": F.ln(1 + F.col("amount")), "month_sin": F.sin(angle), "month_cos": F.cos(angle)}
    past = written(shaped(history.train_history(cases).withColumns(more)))
    return ranges.collect(), past, written(shaped(history.future_history(cases, later, ranges).withColumns(more)), "fold", "split")


def fold_parts(fold, past: DataFrame, later: DataFrame) -> dict[str, DataFrame]:
    own = later.where(F.col("fold") == fold["fold"])
    return {"train": past.where(F.col("opening_date") <= F.lit(fold["train_end"]))} | {k: own.where(F.col("split") == k) for k in LATER}


def scaled_parts(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    made = Pipeline(stages=[VectorAssembler(inputCols=NUMBERS, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(parts["train"])
    return {k: made.transform(v).select("record_id", "opening_date", "target_resolved", "features") for k, v in parts.items()}


def by_day(cases: DataFrame) -> DataFrame:
    """The cases without ids, written with those of a company and day side by side, as these share their history."""
    return written(cases.drop("record_id").repartition("company", "opening_date").sortWithinPartitions("company", "opening_date"))


def tree_cells(parts: dict[str, DataFrame], bounds: list[float]) -> dict[str, DataFrame]:
    """``tree_parts`` by company and numbers, with one row for all cases of equal features and outcome, their number ``n`` as its weight.

    All numbers but the amount are those of the company's day, and the amount goes by its bin, as trees take it: however many cases there are, a split has at
    most a row for each company, day, bin and outcome.
    """
    cells = {k: models.counted(v.withColumn("amount_log", models.bin_of("amount_log", bounds)), ["company", *NUMBERS]) for k, v in parts.items()}
    cells["train"] = written(cells["train"])
    rates, other = models.target_rates(cells["train"], "company")
    columns = ["company_coded", *NUMBERS]
    coded = {k: models.assembled(v.join(rates, "company", "left").fillna(other, ["company_coded"]), columns) for k, v in cells.items()}
    return {k: written(v.select("target_resolved", "n", "features")) for k, v in coded.items()}


@query("fold_models")
def fold_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear model and trees fitted to each fold side by side: thresholds by fold, metrics of validation and test."""
    vectors = VectorAssembler(inputCols=NUMBERS, outputCol="features")  # made once, not in each pass of each fold

    def shaped(rows):
        keep = [c for c in rows.columns if c in ("fold", "split", "company", "opening_date", "target_resolved", *NUMBERS)]
        return vectors.transform(rows.select(*keep))

    ranges, past, later = fold_tables(spark, sf_dir, placed=by_day, shaped=shaped)
    bounds = models.inner_bounds(past, "amount_log", {f["fold"]: F.col("opening_date") <= F.lit(f["train_end"]) for f in ranges})

    def scored(job):
        fold, name = job
        parts = fold_parts(fold, past, later)
        if name == "trees":
            parts, weight = tree_cells(parts, bounds[fold["fold"]]), F.col("n")
            whole = models.fit_trees(parts["train"], 8, 3, 0.3, weight="n")
            model = models.cut_trees(whole, models.best_round(models.round_losses(whole, parts["validation"])))
        else:
            model, weight = models.fit_logistic(parts["train"], scaled=True), F.lit(1)
        return models.weighed_sets(model, {k: parts[k] for k in LATER}, weight, model=name, fold=fold["fold"])

    scores = reduce(DataFrame.unionByName, models.side_by_side(scored, [(f, m) for f in ranges for m in ("logistic", "trees")]))
    return rounded(models.judged_counts(written(models.counts_of(scores, ["model", "fold"])), ["model", "fold"]))


SEEDS = (13, 42, 2024)


@query("seed_refits")
def seed_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear descent and trees refitted by fold and seed: each fit's test macro-F1, its seed's mean over folds, and the spread over seeds."""
    ranges, past, later = fold_tables(spark, sf_dir, 12)
    shaped = {f["fold"]: tree_parts(fold_parts(f, past, later), ["company"], NUMBERS) for f in ranges}
    scaled = {f["fold"]: {k: written(v) for k, v in scaled_parts(fold_parts(f, past, later)).items()} for f in ranges}

    def scored(job):
        fold, seed, name = job
        parts = (shaped if name == "trees" else scaled)[fold]
        model = models.fit_trees(parts["train"], 5, 3, seed=seed, share=0.6) if name == "trees" else models.fit_sgd(parts["train"], 1e-3, 2, seed)[0]
        return models.scored_sets(model, {k: parts[k] for k in LATER}, model=name, seed=seed, fold=fold)

    jobs = [(f["fold"], seed, name) for f in ranges for seed in SEEDS for name in ("linear", "trees")]
    scores = written(reduce(DataFrame.unionByName, models.side_by_side(scored, jobs)))
    fits = written(models.judged(scores, ["model", "seed", "fold"]).where("split = 'test'").select("model", "seed", "fold", "threshold", "macro_f1"))
    means = fits.groupBy("model", "seed").agg(F.avg("macro_f1").alias("seed_mean"))
    return rounded(fits.join(means, ["model", "seed"]).join(report.seed_stability(fits), "model"), 9)
