"""Fitted models: vectors made in the JVM, epochs, rounds, folds and seeds, and the search over candidates."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import models, tuning
from tidemark.plans import models as plans
from tidemark.plans.core import written


@pytest.fixture(scope="module")
def parts(spark):
    """Rows whose outcome follows a few of twenty sparse features, with noise."""
    rng = np.random.default_rng(1)
    weights = np.zeros(20)
    weights[:4] = [2.5, -2.0, 1.5, -1.0]
    rows = []
    for i in range(1200):
        places = np.sort(rng.choice(20, 6, replace=False))
        values = rng.random(6)
        y = int(rng.random() < 1 / (1 + np.exp(-(values @ weights[places] * 2))))
        rows.append((f"r{i}", y, Vectors.sparse(20, places.tolist(), values.tolist())))
    table = written(spark.createDataFrame(rows, ["record_id", "target_resolved", "features"]).withColumn("target_resolved", F.col("target_resolved").cast("int")).repartition(4, "record_id"))
    turn = F.pmod(F.xxhash64("record_id"), F.lit(4))
    return {"train": written(table.where(turn < 2)), "validation": written(table.where(turn == 2)), "test": written(table.where(turn == 3))}


def later(parts):
    return {k: parts[k] for k in ("validation", "test")}


def test_vectors_of_feature_sets_are_made_without_python(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 3.0)], "record_id string, feature string, value double")
    other = spark.createDataFrame([("b", "x", 5.0)], "record_id string, feature string, value double")
    matrix, index = models.feature_matrix({"one": long, "two": other}, ["record_id"])
    place = {(r["block"], r["feature"]): r["index"] for r in index.collect()}
    assert sorted(place.values()) == [0, 1, 2] and place["two", "x"] == 2
    made = models.feature_sets(matrix, {"all": ["one", "two"], "second": ["two"]}, ["record_id"], 3, plans.shared(spark))
    plan = made._jdf.queryExecution().toString() + matrix._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r["record_id"]: r for r in made.collect()}
    wanted = np.zeros(3)
    wanted[[place["one", "y"], 2]] = [3.0, 5.0]
    assert got["b"]["all"].toArray().tolist() == wanted.tolist() and got["b"]["second"].toArray().tolist() == [0.0, 0.0, 5.0]
    assert got["a"]["second"] == Vectors.sparse(3, [], []) and got["a"]["all"].numNonzeros() == 2


def test_no_python_before_the_fit_of_feature_set_models(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(plans, "written", lambda df: seen.append(df._jdf.queryExecution().toString()) or written(df))
    table = plans.text_vectors(spark, sf, {"text": ["word", "metadata"]})
    text = "".join(seen) + table._jdf.queryExecution().toString()
    assert len(seen) == 2 and "Python" not in text and "InArrow" not in text
    assert table.select("text").first()["text"].size > 0


def test_epochs_of_descent_come_near_the_full_solver(parts):
    fitted, losses = models.fit_sgd(parts["train"], 1e-3, 5)
    full = models.fit_logistic(parts["train"], 1e-3)
    assert len(losses) == 5 and losses[-1] < losses[0] and losses[-1] < 0.69
    scores = models.scored_sets(fitted, later(parts), model="sgd").unionByName(models.scored_sets(full, later(parts), model="full"))
    found = {(r["model"], r["split"]): r["macro_f1"] for r in models.judged(scores, ["model"]).collect()}
    assert len(found) == 4
    assert abs(found["sgd", "validation"] - found["full", "validation"]) < 0.01
    objective = lambda m: parts["train"].count() and float(np.mean([
        np.logaddexp(0, -(2 * r["target_resolved"] - 1) * (r["features"].dot(m.coefficients) + m.intercept)) for r in parts["train"].collect()
    ])) + 1e-3 / 2 * float(m.coefficients.dot(m.coefficients))
    assert abs(losses[-1] - objective(fitted)) < 1e-9  # the last loss is that of the model returned
    assert 0 < objective(models.fit_sgd(parts["train"], 1e-3, 20)[0]) - objective(full) < min(0.02, objective(fitted) - objective(full))


def test_descent_is_seeded_and_takes_dense_vectors(spark, parts):
    dense = written(parts["train"].select("record_id", "target_resolved", vector_to_array("features").alias("a")).withColumn("features", F.col("a")).drop("a"))
    from pyspark.ml.functions import array_to_vector

    dense = written(dense.withColumn("features", array_to_vector("features")))
    one, two, other = (models.fit_sgd(t, 1e-3, 1, seed)[0] for t, seed in ((parts["train"], 5), (parts["train"], 5), (parts["train"], 6)))
    assert one.coefficients == two.coefficients and one.coefficients != other.coefficients
    assert models.fit_sgd(dense, 1e-3, 2)[1][-1] < 0.7
    with pytest.raises(ValueError):
        models.fit_sgd(parts["train"].where("false"))


def test_dense_rows_take_the_steps_of_sparse_ones_as_matrices(spark):
    rng = np.random.default_rng(2)
    made = [(f"r{i}", int(i % 3 == 0), rng.random(3).tolist()) for i in range(200)]
    table = lambda more, size: written(spark.createDataFrame([(r, y, Vectors.sparse(size, list(range(3)), x) if more else Vectors.dense(x)) for r, y, x in made], ["record_id", "target_resolved", "features"]).coalesce(1))
    dense, gaps = models.fit_sgd(table(False, 3), 1e-2, 2), models.fit_sgd(table(True, 4), 1e-2, 2)  # the fourth feature never occurs
    assert np.allclose(dense[0].coefficients.toArray(), gaps[0].coefficients.toArray()[:3], atol=1e-12) and gaps[0].coefficients[3] == 0
    assert np.allclose(dense[1], gaps[1], atol=1e-12) and abs(dense[0].intercept - gaps[0].intercept) < 1e-12


def log_loss(model, rows):
    p = [(r["p"], r["target_resolved"]) for r in model.transform(rows).select(vector_to_array("probability")[1].alias("p"), "target_resolved").collect()]
    return -float(np.mean([np.log(p if y else 1 - p) for p, y in p]))


def test_the_cut_trees_have_the_least_loss(parts):
    whole = models.fit_trees(parts["train"], 12, 4, 0.5)
    losses = models.round_losses(whole, parts["validation"])
    kept = models.best_round(losses)
    cut = models.cut_trees(whole, kept)
    assert len(losses) == 12 and cut.getNumTrees == kept < 12
    assert abs(log_loss(cut, parts["validation"]) - min(losses)) < 1e-9
    assert abs(log_loss(whole, parts["validation"]) - losses[-1]) < 1e-9


def grid(parts):
    return [
        *tuning.candidates("linear", ["features"], lambda t, alpha: models.fit_sgd(t, alpha)[0], alpha=(1e-3, 0.3)),
        *tuning.candidates("bayes", ["features"], models.fit_complement_bayes, smoothing=(0.1, 1.0)),
        *tuning.candidates("trees", ["features"], lambda t, depth, rounds: models.fit_trees(t, int(rounds), int(depth)), depth=(1, 3), rounds=(2, 6)),
    ]


def test_halving_finds_the_best_of_the_full_grid(parts):
    tried = grid(parts)
    full = {r["candidate"]: r for r in tuning.successive_halving(parts["train"], parts["validation"], tried, written, rungs=1).collect()}
    halved = {r["candidate"]: r for r in tuning.successive_halving(parts["train"], parts["validation"], tried, written, factor=2, rungs=2).collect()}
    assert set(full) == set(halved) == {c.name for c in tried} and len(tried) == 8
    assert sum(r["best"] for r in full.values()) == sum(r["best"] for r in halved.values()) == 1
    assert [n for n, r in full.items() if r["best"]] == [n for n, r in halved.items() if r["best"]]
    best = max(full.values(), key=lambda r: (r["macro_f1"], r["pr_auc"], -r["brier_score"]))
    assert best["best"] and best["best_of_family"]
    assert sum(r["dropped"] for r in halved.values()) == 4 and all(r["share"] == (0.5 if r["dropped"] else 1.0) for r in halved.values())
    for name, r in halved.items():  # those that stayed saw all rows: the same fit as in the full grid
        if not r["dropped"]:
            assert abs(r["macro_f1"] - full[name]["macro_f1"]) < 1e-12


def test_refits_by_fold_and_seed_differ(spark):
    rows = plans.seed_refits(spark, "/root/testdata/sf0.001").collect()
    folds = {r["fold"] for r in rows}
    assert len(rows) == len(folds) * len(plans.SEEDS) * 2 and len(folds) > 1
    for model in ("linear", "trees"):
        own = [r for r in rows if r["model"] == model]
        means = {r["seed"]: np.mean([x["macro_f1"] for x in own if x["seed"] == r["seed"]]) for r in own}
        assert all(abs(means[r["seed"]] - r["seed_mean"]) < 1e-6 for r in own)
        assert own[0]["seeds"] == 3 and abs(own[0]["std"] - np.std(list(means.values()), ddof=1)) < 1e-6
    assert any(r["std"] > 0 for r in rows if r["model"] == "trees") and any(r["std"] > 0 for r in rows if r["model"] == "linear")


def test_models_of_every_fold(spark):
    rows = plans.fold_models(spark, "/root/testdata/sf0.001").collect()
    keys = {(r["model"], r["fold"], r["split"]) for r in rows}
    assert len(keys) == len(rows) and {k[0] for k in keys} == {"logistic", "trees"} and {k[2] for k in keys} == {"validation", "test"}
    assert {k[1] for k in keys} == {f["fold"] for f in plans.folds.temporal_folds(spark, *plans.FOLD_ARGS).collect()}


def test_counted_rows_give_the_same_trees_codes_and_losses(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        c, a, b = int(rng.integers(6)), float(rng.integers(5)), float(rng.integers(4))
        rows.append((f"c{c}", a, b, int(rng.random() < 0.2 + 0.1 * (c % 3) + 0.1 * a)))
    table = written(spark.createDataFrame(rows, "company string, a double, b double, target_resolved int"))
    turn = F.pmod(F.xxhash64("company", "a", "b", "target_resolved"), F.lit(5))  # equal rows stay together
    encoder, columns = models.encode_trees(table.where(turn > 0), ["company"], ["a", "b"])
    code = F.col("company_coded") + 0.0  # Spark's encoder names the codes as categories, and trees would take them all for category 0
    every = {k: written(models.assembled(encoder.transform(table.where(where)).withColumn("company_coded", code), columns)) for k, where in (("train", turn > 0), ("later", turn == 0))}
    cells = written(models.counted(table, ["company", "a", "b"]))
    rates, other = models.target_rates(cells.where(turn > 0), "company")
    coded = cells.join(rates, "company", "left").fillna(other, ["company_coded"])
    few = {k: written(models.assembled(coded.where(where), columns)) for k, where in (("train", turn > 0), ("later", turn == 0))}
    assert few["train"].count() < every["train"].count() / 5
    codes = {r["company"]: r["company_coded"] for r in every["train"].select("company", "company_coded").distinct().collect()}
    assert codes and all(abs(codes[r["company"]] - r["company_coded"]) < 1e-12 for r in rates.collect())
    one, two = models.fit_trees(every["train"], 6, 3, 0.3), models.fit_trees(few["train"], 6, 3, 0.3, weight="n")
    assert np.allclose(models.round_losses(one, every["later"]), models.round_losses(two, few["later"]), atol=1e-9)
    assert len(set(models.round_losses(two, few["later"]))) == 6
    scores = {(r["company"], r["a"], r["b"]): r["p"] for r in one.transform(every["later"]).select("company", "a", "b", vector_to_array("probability")[1].alias("p")).collect()}
    for r in two.transform(few["later"]).select("company", "a", "b", vector_to_array("probability")[1].alias("p")).collect():
        assert abs(scores[r["company"], r["a"], r["b"]] - r["p"]) < 1e-9
    judged = [models.judged(models.scored_sets(one, {k: every["later"].withColumn("record_id", F.lit("")) for k in plans.LATER}, model="m"), ["model"])]
    judged.append(models.judged_counts(models.counts_of(models.weighed_sets(two, {k: few["later"] for k in plans.LATER}, F.col("n"), model="m"), ["model"]), ["model"]))
    assert plans.rounded(judged[0], 9).collect() == plans.rounded(judged[1], 9).select(*judged[0].columns).collect()


def test_amounts_go_by_bins_of_equal_size(spark):
    table = spark.range(1000).select((F.col("id") * 1.0).alias("x"))
    bounds = models.inner_bounds(table, "x", {1: F.lit(True), 2: F.col("x") < 100, 3: F.lit(False)}, 4)
    assert bounds[1] == [249.0, 499.0, 749.0] and bounds[2] == [24.0, 49.0, 74.0] and bounds[3] == []
    sizes = {r["b"]: r["count"] for r in table.groupBy(models.bin_of("x", bounds[1]).alias("b")).count().collect()}
    assert sizes == {0: 250, 1: 250, 2: 250, 3: 250}
    assert [r["b"] for r in table.select(models.bin_of("x", []).alias("b")).distinct().collect()] == [0]


def test_scaled_weights_are_those_of_standardised_features(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(100 * b + 7), 3.0, int(rng.random() < 1 / (1 + np.exp(-a - b)))) for a, b in rng.normal(size=(800, 2))]
    table = written(spark.createDataFrame(rows, "a double, b double, c double, target_resolved int"))
    raw = models.assembled(table, ["a", "b", "c"])
    from pyspark.ml.feature import StandardScaler

    scaler = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(raw)
    scaled = scaler.transform(raw).select("a", "b", "target_resolved", F.col("z").alias("features"))
    p = lambda model, rows: np.array([r["p"] for r in model.transform(rows).orderBy("a", "b").select(vector_to_array("probability")[1].alias("p")).collect()])
    one, two = models.fit_logistic(scaled, 1e-2), models.fit_logistic(raw, 1e-2, scaled=True)
    assert np.allclose(p(one, scaled), p(two, raw), atol=1e-9) and not two.hasSummary


def test_trees_of_the_folds_learn_from_no_more_rows_when_cases_are_doubled(spark, sf, monkeypatch, tmp_path):
    for name in ("nation", "region", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(plans, "FOLD_ARGS", ("2001-01-01", "2001-08-01"))
    fit, seen = models.fit_trees, []
    monkeypatch.setattr(models, "fit_trees", lambda train, *a, **k: seen.append(train.count()) or fit(train, *a, **k))
    found = [{(r["model"], r["split"]): r for r in plans.fold_models(spark, path).collect()} for path in (sf, str(tmp_path))]
    assert len(seen) == 2 and seen[0] == seen[1] > 0
    assert len(found[0]) == 4 and all(found[1][k]["records"] == 2 * r["records"] for k, r in found[0].items())
    assert all(abs(found[1][k]["brier_score"] - r["brier_score"]) < 1e-5 for k, r in found[0].items())
