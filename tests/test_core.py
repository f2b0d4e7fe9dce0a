"""Edge frames, brute force and invariants of the case operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import audit, clean, compare, evaluation, folds, history, models, report, vectorize
from tidemark.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [
    ("2021-05-01", dt.date(2021, 5, 1)), ("01/05/2021", dt.date(2021, 5, 1)), ("1/5/2021", dt.date(2021, 5, 1)), ("2021/05/01", dt.date(2021, 5, 1)),
    ("2021-05", None), ("31/02/2021", None), ("", None), (None, None), ("2021-02-30", None),
])
def test_dates(spark, text, want):
    assert one(spark, C.parsed_date, text) == want


def test_cleaning(spark):
    assert one(spark, C.cleaned, " a\t\n b  c ") == "a b c" and one(spark, C.cleaned, None) == ""
    assert one(spark, C.word_count, "") == 1 and one(spark, lambda x: C.times(x, "!"), "!!a!") == 3
    assert one(spark, C.markers, "[NOME] [ÇÃO] [a]") == 2
    assert [one(spark, C.unit, v) for v in ("São Paulo - SP", "x sp", "XX", None, "RJ  ")] == ["SP", "UNKNOWN", "UNKNOWN", "UNKNOWN", "RJ"]
    assert one(spark, C.weekday, dt.date(2024, 3, 3), "date") == 0
    assert [one(spark, C.or_unknown, v) for v in ("", " ", None, "a")] == ["UNKNOWN", "UNKNOWN", "UNKNOWN", "a"]


def test_folds(spark):
    made = folds.temporal_folds(spark, "2023-07-01", "2025-04-03").collect()
    assert len(made) == 6 and made[0].train_end == dt.date(2023, 6, 30) and made[-1].test_end == dt.date(2025, 3, 31)
    assert folds.fold_candidates(spark, "2023-07-01", "2025-04-03").where("NOT complete").count() == 1
    assert folds.temporal_folds(spark, "2023-07-01", "2023-12-31").count() == 1 and folds.temporal_folds(spark, "2023-07-01", "2023-12-30").count() == 0
    good = folds.temporal_folds(spark, "2023-07-01", "2025-04-03")
    assert folds.fold_faults(good).count() == 0 and folds.fold_faults(good.where("fold <> 2")).count() > 0


def cases(spark, rows):
    return spark.createDataFrame([(str(i), c, d, y) for i, (c, d, y) in enumerate(rows)], "record_id string, company string, opening_date date, target_resolved int")


def test_history_against_brute_force(spark):
    rnd, day = random.Random(1), dt.date(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", ""]), day + dt.timedelta(rnd.randrange(60)), rnd.randrange(2)) for _ in range(120)]
    for r in history.train_history(cases(spark, rows), (7, 30)).collect():
        before = [x for x in rows if x[0] == r.company and x[1] < r.opening_date]
        every = [x for x in rows if x[1] < r.opening_date]
        overall = sum(x[2] for x in every) / len(every) if every else 0.5
        own = sum(x[2] for x in before) / len(before) if before else overall
        week = [x for x in before if x[1] >= r.opening_date - dt.timedelta(7)]
        assert (r.company_history_count, r.company_history_count_7d) == (len(before), len(week))
        assert math.isclose(r.company_history_rate, own) and math.isclose(r.global_history_rate, overall)
        assert math.isclose(r.company_history_rate_7d, sum(x[2] for x in week) / len(week) if week else own)


def test_history_does_not_leak(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(i % 20), i % 3 == 0) for i in range(60)]
    rows = [(c, d, int(y)) for c, d, y in rows]
    turned = [(c, d, 1 - y if d >= day + dt.timedelta(10) else y) for c, d, y in rows]
    a, b = ({r.record_id: r[4:] for r in history.train_history(cases(spark, x)).where("opening_date <= DATE '2024-01-11'").collect()} for x in (rows, turned))
    assert a == b


def test_future_history_window(spark):
    end = dt.date(2024, 3, 31)
    train = cases(spark, [("a", end, 1), ("a", end - dt.timedelta(29), 0), ("a", end - dt.timedelta(30), 0)])
    later = cases(spark, [("a", dt.date(2024, 4, 2), 1), ("new", dt.date(2024, 4, 2), 0)]).withColumn("fold", F.lit(1))
    made = {r.company: r for r in history.future_history(train, later, spark.createDataFrame([(1, end)], "fold int, train_end date"), (30,)).collect()}
    assert made["a"].company_history_count == 3 and made["a"].company_history_count_30d == 2 and made["a"].company_history_rate_30d == 0.5
    assert made["new"].company_seen_before == 0 and math.isclose(made["new"].company_history_rate_30d, 1 / 3)


def predictions(spark, rows):
    return spark.createDataFrame([("m", float(s), y, int(s >= 0.5)) for s, y in rows], "model string, score double, target_resolved int, prediction int")


def plain_macro(rows, t):
    tp = sum(s >= t and y == 1 for s, y in rows)
    fp = sum(s >= t and y == 0 for s, y in rows)
    fn = sum(s < t and y == 1 for s, y in rows)
    tn = len(rows) - tp - fp - fn
    f = lambda a: 2 * a / (2 * a + fp + fn) if 2 * a + fp + fn else 0.0
    return (f(tp) + f(tn)) / 2


@pytest.mark.parametrize("seed", range(4))
def test_threshold_is_the_best(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(20) / 20, rnd.randrange(2)) for _ in range(40)] if seed else [(0.4, 1)] * 3
    tried = sorted({s for s, _ in rows} | {math.nextafter(max(s for s, _ in rows), 2)})
    best = max(plain_macro(rows, t) for t in tried)
    want = min((t for t in tried if plain_macro(rows, t) >= best - 1e-12), key=lambda t: (abs(t - 0.5), -t))
    assert evaluation.best_threshold(predictions(spark, rows), ["model"]).first().threshold == want


def test_rank_metrics(spark):
    made = lambda rows: evaluation.rank_metrics(predictions(spark, rows), ["model"]).first()
    assert math.isnan(made([(0.2, 1), (0.8, 1)]).roc_auc) and made([(0.5, 1), (0.5, 0)]).roc_auc == 0.5
    assert (made([(0.9, 1), (0.1, 0)]).roc_auc, made([(0.9, 1), (0.1, 0)]).pr_auc) == (1.0, 1.0)
    rnd = random.Random(3)
    rows = [(rnd.randrange(30) / 30, rnd.randrange(2)) for _ in range(80)]
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert math.isclose(made(rows).roc_auc, sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n))
    assert math.isclose(made(rows).brier_score, sum((s - y) ** 2 for s, y in rows) / len(rows))


def test_bins_and_risk(spark):
    bins = evaluation.calibration_bins(predictions(spark, [(0.0, 0), (1.0, 1), (0.3, 1), (0.95, 0)]), ["model"]).collect()
    assert sorted((r.bin, r.records) for r in bins) == [(1, 1), (4, 1), (10, 2)]
    tied = predictions(spark, [(0.2, 0), (0.2, 1), (0.2, 1), (0.2, 0)])  # three fall into the first half by ties
    r = {x.fraction: x for x in evaluation.risk_ranking(tied, ["model"], (0.01, 0.5)).collect()}
    assert (r[0.01].k, r[0.01].hits, r[0.5].k, r[0.5].hits) == (1, 0.5, 2, 1.0)
    none = evaluation.risk_ranking(predictions(spark, [(0.3, 1)]), ["model"]).collect()
    assert all(x.hits == 0 and x.recall == 0 for x in none)


def test_holm(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "t string, p_value double")
    made = {r.t: (round(r.p_holm, 6), r.significant) for r in compare.holm(tests, order=["t"]).collect()}
    assert made == {"a": (0.04, True), "c": (0.09, False), "b": (0.09, False), "d": (0.9, False)}


def test_fusion_prefers_even_weights(spark):
    pairs = spark.createDataFrame([(1, 0.9, 0.9, 1), (1, 0.1, 0.1, 0)], "fold int, a double, b double, target_resolved int")
    assert compare.choose_fusion(pairs, [k / 20 for k in range(21)], ["fold"]).first().weight == 0.5


def test_platt_recovers_the_curve(spark):
    rnd, rows = random.Random(5), []
    for _ in range(4000):
        s = rnd.randrange(1, 100) / 100
        z = 0.5 * math.log(s / (1 - s)) - 0.7
        rows.append((s, int(rnd.random() < 1 / (1 + math.exp(-z)))))
    fit = compare.fit_platt(predictions(spark, rows), ["model"]).first()
    assert abs(fit.slope - 0.5) < 0.1 and abs(fit.intercept + 0.7) < 0.1


def test_bootstrap_and_pairs(spark):
    cells = spark.createDataFrame([("a", 1, 40, 10, 10, 40), ("a", 2, 30, 10, 5, 55), ("b", 1, 0, 0, 50, 50)], "model string, fold int, tp long, fp long, fn long, tn long")
    made = {r.model: r for r in compare.bootstrap(cells, 2000, 500).collect()}
    assert made["a"].low < made["a"].macro_f1 < made["a"].high and made["a"].replicates == 2000
    again = {r.model: r for r in compare.bootstrap(cells.repartition(3), 2000, 500).collect()}
    assert made["a"].low == again["a"].low  # seeds depend on group and chunk only
    joint = [("x", "y", 1, t, p, q, n) for t, p, q, n in [(1, 1, 1, 50), (1, 1, 0, 30), (0, 0, 0, 60), (0, 0, 1, 30)]] + [("x", "z", 1, t, p, p, 50) for t, p in [(1, 1), (0, 0)]]
    frame = spark.createDataFrame(joint, "first string, second string, fold int, target_resolved int, first_prediction int, second_prediction int, n long")
    r = {x.second: x for x in compare.compare_pairs(frame, 1000, 500).collect()}
    assert r["y"].p_value < 0.05 and r["y"].low > 0 and r["z"].p_value == 1.0 and r["z"].difference == 0


def test_audits(spark):
    p = spark.createDataFrame([("m", 1, "test", "1", 0.5, 1, 1), ("m", 1, "test", "1", 0.5, 1, 1), ("m", 1, "test", "3", 1.2, 2, 0)], "model string, fold int, split string, record_id string, score double, prediction int, target_resolved int")
    wanted = spark.createDataFrame([(1, "test", "1", 0), (1, "test", "2", 1)], "fold int, split string, record_id string, target_resolved int")
    r = audit.prediction_integrity(p, wanted, ["m"]).first()
    assert (r.repeated, r.missing, r.unexpected, r.bad_scores, r.bad_predictions, r.other_targets, r.passed) == (1, 1, 1, 1, 1, 2, False)  # rows count, not records
    a, b = (audit.fingerprint(p.repartition(k)).first() for k in (1, 3))
    assert a == b
    assert files.missing_columns(p, {"score", "other"}) == ["other"]


def test_summaries(spark):
    m = spark.createDataFrame([("a", 1, 0.5)], "model string, fold int, macro_f1 double")
    assert report.metric_summary(m, ["model"], ["macro_f1"]).first().macro_f1_std == 0.0
    assert report.metric_summary(m, ["model"], ["macro_f1"], None).first().macro_f1_std is None
    assert report.monthly_trend(m.withColumn("month", F.lit("2024-01")), ["model"]).first().slope == 0.0


def test_grams_and_budgets(spark):
    grams = spark.createDataFrame([("É um",)], "x string").select(vectorize.char_ngrams(F.col("x")).alias("g"), vectorize.word_ngrams(F.col("x")).alias("w")).first()
    assert sorted(grams.g) == sorted([" e ", " um", "um ", " um "]) and grams.w == ["um"]
    for size, head, tail in ((3, 5, 5), (6, 8, 8), (9, 8, 8)):
        r = spark.createDataFrame([(list(range(10, 10 + size)),)], "x array<int>").select(
            vectorize.truncated(F.col("x"), 8).alias("h"), vectorize.truncated(F.col("x"), 8, "head_tail").alias("t")).first()
        assert len(r.h) == head and len(r.t) == tail and r.t[-2] == 9 + size


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("1", "a\nb", None)], "ID string, text string, status string")
    frame.write.csv(f"{tmp_path}/c", header=True, escape='"')
    assert files.read_corpus_csv(spark, f"{tmp_path}/c", frame.columns).collect() == frame.collect()
    files.write_table(frame, f"{tmp_path}/t")
    files.write_table(frame.limit(0), f"{tmp_path}/t", once=True)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_plans_stay_in_the_jvm(spark, sf):
    from tidemark.plans import registry

    for name in ("train_history", "metric_set", "word_vocabulary", "prediction_integrity"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_platt_curves_are_at_their_optimum(spark):
    """Scores that say little, with some at 0: a steep start made Newton's steps run away."""
    rows = [("a", i / 40, 10, 3 + i % 5) for i in range(41)] + [("b", i / 40, 10, i // 5) for i in range(41)]
    counts = spark.createDataFrame(rows, "model string, score double, n long, p long")
    held = compare.platt_of(counts, ["model"]).collect()
    assert len(held) == 2
    for m in held:
        g = gx = 0.0
        for _, score, n, p in (r for r in rows if r[0] == m["model"]):
            s = min(max(score, 1e-6), 1 - 1e-6)
            x = math.log(s / (1 - s))
            q = 1 / (1 + math.exp(-(m["slope"] * x + m["intercept"])))
            g, gx = g + p - n * q, gx + (p - n * q) * x
        assert abs(g) < 1e-5 and abs(gx - 1e-6 * m["slope"]) < 1e-4
    assert {m["model"]: m["slope"] > 0 for m in held}["b"]


def test_metrics_of_counts_equal_those_of_rows(spark):
    rows = [("m", float((i * 7) % 10) / 10, i % 3 == 0) for i in range(100)]
    long = spark.createDataFrame([(m, s, int(y)) for m, s, y in rows], "model string, score double, target_resolved int")
    counts = evaluation.score_counts(long, ["model"]).withColumn("threshold", F.lit(0.4))
    said = long.withColumns({"threshold": F.lit(0.4), "prediction": (F.col("score") >= 0.4).cast("int")})
    a, b = (df.toPandas().round(9).to_dict("records") for df in (evaluation.metric_set_of(counts, ["model", "threshold"]), evaluation.metric_set(said, ["model", "threshold"])))
    assert a == b
    assert evaluation.calibration_error_of(counts, ["model"]).toPandas().round(9).equals(evaluation.calibration_error(long, ["model"]).toPandas().round(9))
    assert evaluation.metric_set_of(counts.where("false"), ["model", "threshold"]).count() == 0


def test_positions_by_count_and_in_files(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "k string")
    assert [(r.k, r.n, r.position) for r in report.by_count(df.where("k is not null"), "k").collect()] == [("c", 2, 1), ("a", 1, 2), ("b", 1, 3)]
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    files.write_ordered(many, f"{tmp_path}/o", ["v"])
    assert all(r.v + 1 == r.position for r in files.read_placed(spark, f"{tmp_path}/o").collect())
    hashed = [r.order_hash for r in report.shuffled(df, "k").collect() if r.order_hash]
    assert hashed == sorted(hashed)


def test_predictions_keep_types_and_names_are_dropped(spark, tmp_path):
    rows = spark.sql("SELECT '007' AS record_id, DATE '2024-01-02' AS opening_date, 1 AS target_resolved, 0.5D AS score, 1 AS prediction, '12' AS model, 3 AS fold")
    files.write_predictions(rows, f"{tmp_path}/p")
    back = files.read_predictions(spark, f"{tmp_path}/p").collect()
    assert [(r.record_id, r.model, r.fold) for r in back] == [("007", "12", 3)]
    with files.registered(rows) as name:
        found = spark.table(name)
    assert found.count() == 1 and not spark.catalog.tableExists(name)


def test_vocabulary_by_spans_and_feature_matrix(spark):
    docs = spark.createDataFrame(
        [("1", "ab cd ab", "2024-01-01"), ("2", "ab ef", "2024-03-01"), ("3", "cd ab", "2024-05-01"), ("4", "late", "2025-01-01"), ("5", None, "2024-01-01")],
        "record_id string, t string, d string",
    ).withColumn("opening_date", F.col("d").cast("date"))
    ends = spark.sql("SELECT fold, train_end FROM VALUES (1, DATE '2024-02-01'), (2, DATE '2024-06-01'), (3, DATE '2024-06-01') f(fold, train_end)")
    got = {(r.fold, r.term): (r.df, r.tf, r.n) for r in vectorize.vocabulary(docs, vectorize.word_ngrams(F.col("t")), ends, 1, 1.0, 100).collect()}
    assert got[(1, "ab")] == (1, 2, 2) and got[(2, "ab")] == (3, 4, 4) and got[(3, "ab")] == got[(2, "ab")] and (2, "late") not in got
    counts = vectorize.term_counts(docs, vectorize.word_ngrams(F.col("t")), ["record_id"])
    kept = vectorize.vocabulary(docs, vectorize.word_ngrams(F.col("t")), ends.where("fold = 2"), 1, 1.0, 100)
    weights = vectorize.tfidf(counts, vectorize.measured(kept, "term"), ["record_id"])
    assert all(abs(r.s - 1) < 1e-9 for r in weights.groupBy("record_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect())
    words = weights.select("record_id", F.col("term").alias("feature"), F.col("weight").alias("value"))
    numbers = spark.createDataFrame([("1", "x", 2.0), ("2", "x", 3.0)], "record_id string, feature string, value double")
    matrix, index = models.feature_matrix({"word": words, "number": numbers}, ["record_id"])
    size = index.count()
    assert sorted(r["index"] for r in index.collect()) == list(range(size)) and size == kept.count() + 1
    vectors = {r.record_id: r.features for r in models.feature_sets(matrix, {"features": ["number"]}, ["record_id"], size, files.shared(spark)).collect()}
    assert set(vectors) == {"1", "2", "3"} and vectors["1"].size == size and list(vectors["1"].values) == [2.0] and vectors["3"].numNonzeros() == 0
