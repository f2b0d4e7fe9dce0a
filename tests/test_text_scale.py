"""Text features on large tables: what is worked out once, what is shuffled, and that no task holds the terms of many documents."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import models, vectorize
from tidemark.plans import models as plans
from tidemark.plans import text
from tidemark.sources import files


def plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def documents(spark):
    return spark.createDataFrame([("a", "2024-01-01", "uma Ação de uma ação"), ("b", "2024-02-01", "ação ½ x"), ("c", "2024-02-02", None)], "record_id string, d string, t string").select(
        "record_id", F.to_date("d").alias("opening_date"), "t"
    )


def test_a_text_is_folded_and_cut_once_and_counted_in_its_row(spark):
    docs = documents(spark)
    counts = vectorize.term_counts(docs, vectorize.word_ngrams(F.col("t")), ["record_id", "opening_date"])
    made = plan(counts)
    assert made.count("regexp_extract_all(") == 1 and len(re.findall(r"\blower\(", made)) == 1 and "Aggregate" not in made and "RLIKE" not in made
    assert {(r.record_id, r.term): r.tf for r in counts.collect()} == {
        ("a", "uma"): 2, ("a", "acao"): 2, ("a", "de"): 1, ("a", "uma acao"): 2, ("a", "acao de"): 1, ("a", "de uma"): 1, ("b", "acao"): 1,
    }


def test_rows_of_the_same_keys_are_one_document(spark):
    docs = documents(spark)
    counts = vectorize.term_counts(docs.unionByName(docs), vectorize.char_ngrams(F.col("t")), ["record_id", "opening_date"])
    got = {(r.record_id, r.term): r.tf for r in counts.collect()}
    wanted = Counter()
    for key, t in (("a", "uma acao de uma acao"), ("b", "acao 1⁄2 x")):
        for word in t.split():
            padded = f" {word} "
            for n in (3, 4, 5):
                for i in range(len(padded) - n + 1):
                    wanted[key, padded[i : i + n]] += 2
    assert got == dict(wanted)


def test_a_vocabulary_of_several_folds_takes_one_shuffle_of_terms(spark):
    docs = documents(spark)
    counts = vectorize.term_counts(docs, vectorize.word_ngrams(F.col("t")), ["record_id", "opening_date"])
    ends = spark.sql("SELECT fold, d AS train_end FROM VALUES (1, DATE '2024-01-31'), (2, DATE '2024-03-31') f(fold, d)")
    made = vectorize.vocabulary_of(counts, docs, ends, 1, 1.0, 100)
    keys = set(re.findall(r"hashpartitioning\(([^)]*)\)", plan(made, "executedPlan")))
    assert {k.split("#")[0] for k in keys if "term" in k} == {"term"}
    got = {(r.fold, r.term): (r.df, r.tf, r.n) for r in made.collect()}
    assert got[1, "acao"] == (1, 2, 1) and got[2, "acao"] == (2, 3, 3) and got[2, "uma"] == (1, 2, 3)


def test_only_the_needed_blocks_are_made(spark, sf, monkeypatch):
    def unwanted(*_):
        raise AssertionError("no characters are asked for")

    monkeypatch.setattr(vectorize, "char_ngrams", unwanted)
    rows, blocks, known = text.text_blocks(spark, sf, {"word", "history"})
    assert set(blocks) == {"word", "history"} and set(known) == {"word"}


def test_blocks_meet_a_small_index_without_a_shuffle(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 3.0)], "record_id string, feature string, value double")
    matrix, index = models.feature_matrix({"one": long}, ["record_id"], {"one": long.select("feature").distinct()}, files.written)
    assert "BroadcastHashJoin" in plan(matrix, "executedPlan") and "Exchange hashpartitioning" not in plan(matrix, "executedPlan")
    place = {r["feature"]: r["index"] for r in index.collect()}
    assert sorted(place.values()) == [0, 1] and {(r.record_id, r["index"], r.weight) for r in matrix.collect()} == {("a", place["x"], 1.0), ("a", place["y"], 2.0), ("b", place["y"], 3.0)}


def test_tfidf_weights_cut_the_texts_once_and_are_summed_without_a_window(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(text, "written", lambda df: seen.append(plan(df)) or files.written(df))
    made = text.tfidf_weights(spark, sf)
    assert sum("regexp_extract_all(" in p for p in [*seen, plan(made)]) == 1 and "Window" not in plan(made)


def test_weight_summary_sums_up_tfidf(spark):
    docs = documents(spark)
    counts = vectorize.term_counts(docs, vectorize.word_ngrams(F.col("t")), ["record_id", "opening_date"])
    ends = spark.sql("SELECT fold, d AS train_end FROM VALUES (1, DATE '2024-01-31'), (2, DATE '2024-03-31') f(fold, d)")
    kept = files.written(vectorize.vocabulary_of(counts, docs, ends, 1, 1.0, 100))
    long = vectorize.tfidf(counts, kept, ["record_id"]).groupBy("fold", "record_id").agg(F.count("*"), F.sum("weight"), F.max("weight"))
    shown = lambda df: {(r[0], r[1]): (r[2], round(r[3], 9), round(r[4], 9)) for r in df.collect()}
    assert shown(vectorize.weight_summary(counts, kept, ["record_id"])) == shown(long) and len(shown(long)) == 4


def test_numbers_of_the_texts_are_made_once_for_all_encoders(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(text, "written", lambda df: seen.append(plan(df)) or files.written(df))
    made = text.text_metadata(spark, sf)
    assert len(seen) == 1 and "regexp_extract_all(" not in plan(made) and made.count() > 0


def test_texts_stay_out_of_the_buckets(spark, sf, monkeypatch):
    seen, own = [], files.bucketed
    monkeypatch.setattr(files, "bucketed", lambda df, *more: seen.append((df.columns, plan(df))) or own(df, *more))
    made = text.tree_matrix_bucketed(spark, sf)
    assert len(seen) == 2 and all("complaint_text" not in columns for columns, _ in seen)
    assert sum("regexp_extract_all(" in p for _, p in seen) == 1 and "Exchange hashpartitioning" not in plan(made, "executedPlan")
    files.drop_bucketed(spark)


def test_term_vectors_are_the_weights_of_tfidf(spark):
    docs = documents(spark)
    grams = vectorize.word_ngrams(F.col("complaint_text"))
    texts = docs.withColumnRenamed("t", "complaint_text")
    counts = vectorize.term_counts(texts, grams, ["record_id", "opening_date"])
    ends = spark.sql("SELECT 1 AS fold, DATE '2024-03-31' AS train_end")
    kept = files.written(vectorize.vocabulary_of(counts, texts, ends, 1, 1.0, 4))
    made = models.term_vectors(texts, {"word": grams}, {"word": kept}, files.shared(spark))
    place = {r.term: i for i, r in enumerate(sorted(kept.collect(), key=lambda r: (-r.tf, r.term)))}
    wanted = {(r.record_id, place[r.term]): round(r.weight, 12) for r in vectorize.tfidf(counts, kept, ["record_id"]).collect()}
    rows = made.collect()
    assert made.columns == ["record_id", "opening_date", "word"] and len(place) == 4
    assert {(r.record_id, int(i)): round(float(v), 12) for r in rows for i, v in zip(r.word.indices, r.word.values, strict=True)} == wanted
    assert {r.record_id: r.word.numNonzeros() for r in rows}["c"] == 0  # a row without terms stays, with an empty vector


def test_a_block_is_stored_once_however_many_sets_have_it(spark, sf):
    table = plans.text_vectors(spark, sf, {"alone": ["word"], "more": ["word", "metadata"], "most": ["word", "metadata", "history"]})
    stored = spark.read.parquet(*table.inputFiles())
    assert {c for c in stored.columns if c.endswith("_block")} == {"word_block", "metadata_block", "history_block"}
    assert not {"alone", "more", "most", "complaint_text"} & set(stored.columns)
    row = table.first()
    assert row["alone"].numNonzeros() < row["more"].numNonzeros() < row["most"].numNonzeros()


def test_the_search_reads_rows_of_one_split_that_are_made_once(spark, sf, monkeypatch):
    seen = {}

    def search(train, validation, tried, write, **_):
        seen.update(train=train, validation=validation)
        return spark.range(1).toDF("n")

    monkeypatch.setattr(plans.tuning, "successive_halving", search)
    plans.tuning_grid(spark, sf)
    assert set(seen["train"].inputFiles()).isdisjoint(seen["validation"].inputFiles())
    for table in seen.values():
        assert "UDF(" not in plan(table) and len(table.schema.json()) < 10_000  # the features' names stay away
        row = table.first()
        assert row["word"].size < row["word_char"].size and row["word"].numNonzeros() < row["word_char"].numNonzeros() and row["tabular"].size == 21
