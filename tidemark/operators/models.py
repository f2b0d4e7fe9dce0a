"""Classifiers per fold on Spark ML, scored to long predictions."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, NaiveBayes
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer, TargetEncoder, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import evaluation as E
from tidemark.operators import vectorize


def feature_matrix(
    blocks: dict[str, DataFrame], keys: list[str], known: dict[str, DataFrame] | None = None, write: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(keys, block, index, weight) and (block, feature, index): named blocks of long (keys, feature, value) side by side.

    Blocks follow each other by name, features within a block by the hash of their name; indices count through all blocks.
    Features are numbered within 256 parts, so that no task holds all of them. ``known`` has the features of blocks for which a table of
    them is at hand, such as a vocabulary of which each term occurs; of the others they are found by a pass over the block. With ``write``, which writes a table and reads
    it again, the index is made once and, if small, broadcast: the blocks aren't shuffled.
    """
    known = known or {}
    long = reduce(DataFrame.unionByName, [block.select(*keys, F.lit(name).alias("block"), "feature", "value") for name, block in blocks.items()])
    names = reduce(DataFrame.unionByName, [known.get(name, block).select(F.lit(name).alias("block"), "feature").distinct() for name, block in blocks.items()])
    names = names.withColumn("part", F.pmod(F.xxhash64("feature"), F.lit(256)))
    first = Window.orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows for each block
    starts = names.groupBy("block", "part").agg(F.count("*").alias("k")).select("block", "part", F.coalesce(F.sum("k").over(first), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("block", "part").orderBy("feature")) - 1
    index = names.withColumn("inside", inside).join(F.broadcast(starts), ["block", "part"]).select("block", "feature", (F.col("start") + F.col("inside")).cast("int").alias("index"))
    index = write(index) if write else index
    found = long.join(vectorize.measured(index, "feature") if write else index, ["block", "feature"])
    return found.select(*keys, "block", "index", F.col("value").alias("weight")), index


def feature_sets(matrix: DataFrame, sets: dict[str, list[str]], keys: list[str], size: int, path: str) -> DataFrame:
    """keys and a sparse vector column for each named set of blocks of a ``feature_matrix`` of ``size`` features.

    One shuffle by document serves all sets. The vectors are written as the structs that they consist of and read as vectors, so the JVM
    makes them. A document without entries in a set has an empty vector; one without any entry isn't in the table.
    """
    held = matrix.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("index", "weight", "block"))).alias("x"))  # a document's entries

    def vector(blocks):
        own = F.filter("x", lambda e: e["block"].isin(*blocks))
        return F.struct(
            F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform(own, lambda e: e["index"]).alias("indices"),
            F.transform(own, lambda e: e["weight"]).alias("values"),
        )

    held.select(*keys, *[vector(blocks).alias(name) for name, blocks in sets.items()]).write.parquet(path)
    fields = [matrix.schema[k] for k in keys] + [T.StructField(name, VectorUDT()) for name in sets]
    return matrix.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def term_counter(terms: list[str], source: str, name: str) -> CountVectorizerModel:
    """What counts a row's terms by their places in the list. The list goes to the JVM as one text, as a call for each term would take a minute; no term has a line's end."""
    sc = SparkContext._active_spark_context
    cut = sc._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(terms))
    return CountVectorizerModel(sc._jvm.org.apache.spark.ml.feature.CountVectorizerModel(f"counter_{name}", cut)).setInputCol(source).setOutputCol(name)


def term_vectors(docs: DataFrame, terms: dict[str, Column], vocabularies: dict[str, DataFrame], path: str) -> DataFrame:
    """``docs`` without their texts, which the terms are cut from, and a sparse vector of TF-IDF weights for each name in ``terms``, of unit length; without a known term it is empty.

    A row's terms are counted within the row, by a vocabulary with term, tf and idf. It goes through the driver, as the weights of a model on it do: bound its size. The most frequent
    terms come first. Written is 1 + ln tf, of which there are few values, so that an entry takes three to five bytes; idf and length are put in where the table is read.
    """
    held, scales = docs, {}
    for name, cut in terms.items():
        known = vocabularies[name].select("term", "tf", "idf").toPandas().sort_values(["tf", "term"], ascending=[False, True])
        scales[name] = DenseVector(known["idf"] if len(known) else [1.0])
        counter = term_counter(list(known["term"]) or [""], f"{name}_terms", f"{name}_counts")  # no term is empty
        held = counter.transform(held.withColumn(f"{name}_terms", cut)).drop(f"{name}_terms")
    kept = [c for c in docs.columns if c != "complaint_text"]
    counts = {name: F.unwrap_udt(f"{name}_counts") for name in terms}
    logs = [x.withField("values", F.transform(x["values"], lambda tf: 1 + F.ln(tf))).alias(name) for name, x in counts.items()]
    held.select(*kept, *logs).write.parquet(path)
    found = docs.sparkSession.read.schema(T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, VectorUDT()) for name in terms])).parquet(path)
    for name, scale in scales.items():
        found = ElementwiseProduct(scalingVec=scale, inputCol=name, outputCol=f"{name}_scaled").transform(found)
        found = Normalizer(p=2.0, inputCol=f"{name}_scaled", outputCol=f"{name}_unit").transform(found)
    return found.select(*kept, *[F.col(f"{name}_unit").alias(name) for name in terms])


def joined_sets(blocks: DataFrame, sets: dict[str, list[str]], sizes: dict[str, int]) -> DataFrame:
    """``blocks`` with a vector column for each set of its vector columns, put together where it is read: a block is stored once, however many sets have it. ``sizes`` are those of the blocks."""
    for block, size in sizes.items():
        blocks = VectorSizeHint(inputCol=block, size=size, handleInvalid="optimistic").transform(blocks)
    for name, own in sets.items():
        # The assembler names every feature, which slows down plans and tasks: a set of one block does without, and a table that is written from these doesn't keep the names.
        made = VectorAssembler(inputCols=own, outputCol=name).transform(blocks) if len(own) > 1 else blocks.withColumn(name, F.col(own[0]))
        blocks = made.withMetadata(name, {"ml_attr": {"num_attrs": sum(sizes[b] for b in own)}})
    return blocks


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``features`` from numeric and vector columns, side by side."""
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def fit_logistic(train: DataFrame, alpha: float = 1e-4, epochs: int = 100, scaled: bool = False):
    """L2 logistic model: mean loss plus alpha / 2 times the squared weights.

    With ``scaled`` the weights count as those of standardised features: the model of a ``StandardScaler`` before it, without a pass for the
    scales and without a second copy of the rows. The model comes without its summary, which holds the train table.
    """
    found = LogisticRegression(labelCol="target_resolved", regParam=alpha, elasticNetParam=0.0, standardization=scaled, maxIter=epochs).fit(train)
    return logistic_of(found.coefficients, found.intercept, found.uid)


def logistic_of(weights, intercept: float, uid: str) -> LogisticRegressionModel:
    """The binary model of these weights."""
    sc = SparkContext._active_spark_context
    return LogisticRegressionModel(sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, _py2java(sc, weights), float(intercept)))


def fit_complement_bayes(train: DataFrame, smoothing: float = 1.0):
    """Complement naive Bayes on non-negative weights."""
    return NaiveBayes(labelCol="target_resolved", modelType="complement", smoothing=smoothing).fit(train)


def fit_sgd(train: DataFrame, alpha: float = 1e-4, epochs: int = 5, seed: int = 42, batch: int = 16) -> tuple[LogisticRegressionModel, list[float]]:
    """L2 logistic model by mini-batch descent over a number of epochs, and the loss over all rows after each epoch.

    ``train`` has record_id, target_resolved and ``features``. Each partition goes through its rows in an order that seed, epoch and record_id
    decide, from the common weights on; at the end of an epoch the partitions' weights are averaged by their rows, in a tree.
    Steps fall as 1 / (alpha (t0 + t)), from at most 2 over the mean squared length of a row on. Pass a written table: it is read once an epoch, and once for the last loss.
    """
    import numpy as np
    import pyarrow as pa

    raw = train.select("record_id", F.col("target_resolved").cast("int").alias("y"), F.unwrap_udt("features").alias("x"))
    dense = F.sequence(F.lit(0), F.greatest(F.size("x.values"), F.lit(1)) - 1)  # a dense vector has neither places nor size
    rows = raw.select("record_id", "y", F.coalesce("x.size", F.size("x.values")).alias("size"), F.coalesce("x.indices", dense).alias("indices"), F.col("x.values").alias("values"))
    known = rows.agg(F.max("size").alias("size"), F.avg(F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)).alias("square")).first()
    if known["size"] is None:
        raise ValueError("no rows to fit")
    size = known["size"]
    start = min(math.sqrt(1 / math.sqrt(alpha)), 2 / max(known["square"], 1e-12))  # long rows would overshoot
    t0 = 1 / (alpha * start)
    weights, steps, losses = np.zeros(size + 1), 0, []  # the intercept stands last
    for epoch in range(epochs + 1):
        learn = epoch < epochs

        def task(batches, weights=weights, steps=steps, learn=learn):
            w, n, t, loss = weights.copy(), 0, steps, 0.0
            for part in batches:
                starts = part.column("indices").offsets.to_numpy()
                places, values = (part.column(c).values.to_numpy()[starts[0] : starts[-1]] for c in ("indices", "values"))
                starts, y = starts - starts[0], part.column("y").to_numpy().astype(np.float64)
                for low in range(0, len(y), 64 * batch):  # the loss is that of the epoch's first weights
                    high = min(low + 64 * batch, len(y))
                    at, v = places[starts[low] : starts[high]], values[starts[low] : starts[high]]
                    z = np.bincount(np.repeat(np.arange(high - low), np.diff(starts[low : high + 1])), v * weights[at], high - low) + weights[-1]
                    loss += float(np.logaddexp(0, np.where(y[low:high] > 0, -z, z)).sum())
                n += len(y)
                if not learn:
                    continue
                full = (np.diff(starts) == size).all()  # rows without gaps are a matrix; its last column is the intercept's
                whole = np.column_stack([values.reshape(len(y), size), np.ones(len(y))]) if full else None
                for low in range(0, len(y), batch):
                    high = min(low + batch, len(y))
                    rate = 1 / (alpha * (t0 + t))
                    t += 1
                    if full:
                        own = whole[low:high]
                        miss = 1 / (1 + np.exp(-np.minimum(np.maximum(own @ w, -35), 35))) - y[low:high]
                        w[:-1] *= 1 - rate * alpha
                        w -= rate / (high - low) * (miss @ own)
                        continue
                    at, v = places[starts[low] : starts[high]], values[starts[low] : starts[high]]
                    row = np.repeat(np.arange(high - low), np.diff(starts[low : high + 1]))
                    z = np.bincount(row, v * w[at], high - low) + w[-1]
                    miss = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[low:high]
                    w[:-1] *= 1 - rate * alpha
                    np.subtract.at(w, at, rate / (high - low) * v * miss[row])
                    w[-1] -= rate * miss.mean()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(w * n).tobytes()], pa.binary()), pa.array([n]), pa.array([t - steps]), pa.array([loss])], names=["w", "n", "t", "loss"])

        turn = rows.select("y", "indices", "values", F.xxhash64(F.lit(seed), F.lit(epoch), "record_id").alias("turn")).sortWithinPartitions("turn")
        made = turn.drop("turn").mapInArrow(task, "w binary, n bigint, t bigint, loss double").rdd.map(lambda r: (np.frombuffer(r.w), r.n, r.t, r.loss))
        total, n, took, loss = made.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2]), a[3] + b[3]))
        if epoch:
            losses.append(loss / n + alpha / 2 * float(weights[:-1] @ weights[:-1]))
        if learn:
            weights, steps = total / n, steps + took
    return logistic_of(DenseVector(weights[:-1]), weights[-1], f"sgd_{seed}"), losses


def encode_trees(train: DataFrame, categories: list[str], numbers: list[str]):
    """(encoder, columns) of target-encoded categories and numbers; the encoder sees only ``train``."""
    coded, placed = [f"{c}_coded" for c in categories], [f"{c}_place" for c in categories]
    encoder = Pipeline(stages=[
        StringIndexer(inputCols=categories, outputCols=placed, handleInvalid="keep"),
        TargetEncoder(inputCols=placed, outputCols=coded, labelCol="target_resolved", targetType="binary", handleInvalid="keep", smoothing=10.0),
    ]).fit(train)
    return encoder, [*coded, *numbers]


def inner_bounds(df: DataFrame, column: str, groups: dict[int, Column], bins: int = 32) -> dict[int, list[float]]:
    """The bounds between ``bins`` bins of about as many rows each, for the rows of every named condition.

    One pass serves all conditions; a bound is off by at most one ten-thousandth of the rows.
    """
    ranks = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.when(where, F.col(column)), ranks, 10_000).alias(str(name)) for name, where in groups.items()]).first()
    return {name: sorted(set(row[str(name)] or [])) for name in groups}


def bin_of(column: str, bounds: list[float]) -> Column:
    """How many of the bounds a value exceeds: a split between two bins is one at the bound between them."""
    return reduce(Column.__add__, [(F.col(column) > bound).cast("int") for bound in bounds], (F.col(column) - F.col(column)).cast("int"))


def counted(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target_resolved, ``n``: one row for all that are equal in these, and their number."""
    return df.groupBy(*keys, "target_resolved").agg(F.count("*").alias("n"))


def target_rates(train: DataFrame, category: str, smoothing: float = 10.0) -> tuple[DataFrame, float]:
    """(category, ``{category}_coded``) with the values of ``encode_trees``, and the code of a category that ``train`` lacks; from rows with their number ``n``.

    The codes are numbers; those of Spark's encoder are marked as names of categories, and trees then can't split on them.
    """
    sums = train.groupBy(category).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("target_resolved")).alias("p"))
    n, p = sums.agg(F.sum("n"), F.sum("p")).first()
    overall = p / n if n else 0.0
    share = F.col("n") / (F.col("n") + F.lit(smoothing))
    return sums.select(category, (share * F.col("p") / F.col("n") + (1 - share) * F.lit(overall)).alias(f"{category}_coded")), overall


def fit_trees(
    train: DataFrame, rounds: int = 30, depth: int = 4, rate: float = 0.1, seed: int = 42, share: float = 1.0, weight: str | None = None,
) -> GBTClassificationModel:
    """Boosted trees on ``features``, all rounds of them; with a ``share`` below 1 each tree sees that share of the rows and a third of the features.

    ``weight`` names the column that says how many equal rows one stands for.
    """
    trees = GBTClassifier(
        labelCol="target_resolved", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=rate, subsamplingRate=share,
        featureSubsetStrategy="all" if share == 1.0 else "onethird",
    )
    return (trees.setWeightCol(weight) if weight else trees).fit(train)


def round_losses(model: GBTClassificationModel, validation: DataFrame) -> list[float]:
    """Log loss on ``validation`` after each round, of all rounds in one pass."""
    return [loss / 2 for loss in model.evaluateEachIteration(validation)]  # Spark's loss is twice that


def cut_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first rounds only."""
    java = model._java_obj
    sc = SparkContext._active_spark_context
    kind = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = sc._gateway.new_array(kind, rounds), sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    return GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{java.uid()}_{rounds}", trees, weights))


def best_round(losses: list[float]) -> int:
    """The number of the first round with the least loss, from 1."""
    return 1 + min(range(len(losses)), key=lambda i: (losses[i], i))


def judged(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, split, threshold and all metrics of validation and test, at the threshold that is best on validation.

    ``scores`` has keys, split, score, target_resolved, of as many models as there are: one plan judges all.
    """
    return judged_counts(E.score_counts(scores, [*keys, "split"]), keys)


def judged_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``judged`` from keys, split, score, n, p: how many rows and positives share a score."""
    tuned = E.threshold_of(counts.where("split = 'validation'"), keys).select(*keys, "threshold")
    return E.metric_set_of(counts.join(F.broadcast(tuned), keys), [*keys, "split", "threshold"])  # a row for each model


def side_by_side(task, items, parallelism: int = 4) -> list:
    """``task`` of each item, several at a time; each submits Spark jobs of its own.

    Each runs in a scheduler pool of its own: with spark.scheduler.mode FAIR in the cluster's settings all get their turn, else the first comes first.
    """
    def pooled(numbered):
        place, item = numbered
        sc = SparkContext._active_spark_context
        sc.setLocalProperty("spark.scheduler.pool", f"fit-{place % parallelism}")
        return task(item)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(pooled), enumerate(items)))


def scored_sets(fitted, parts: dict[str, DataFrame], **names) -> DataFrame:
    """Long scores of a model on each split, with ``names`` as columns."""
    tables = [
        fitted.transform(df).select(
            *[F.lit(v).alias(k) for k, v in names.items()], F.lit(split).alias("split"), "record_id", "target_resolved", vector_to_array("probability")[1].alias("score")
        )
        for split, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def weighed_sets(fitted, parts: dict[str, DataFrame], weight: Column, **names) -> DataFrame:
    """``scored_sets`` without ids, for ``counts_of``: names, split, score, and of how many rows and positives it is the score."""
    tables = [
        fitted.transform(df).select(
            *[F.lit(v).alias(k) for k, v in names.items()], F.lit(split).alias("split"), vector_to_array("probability")[1].alias("score"),
            weight.cast("long").alias("n"), (weight * F.col("target_resolved")).cast("long").alias("p"),
        )
        for split, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def counts_of(weighed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, split, score, n, p of ``weighed_sets``, one row for each score."""
    return weighed.groupBy(*keys, "split", "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
