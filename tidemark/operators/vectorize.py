"""Text and tabular features keyed by fold: n-gram vocabularies, TF-IDF weights, metadata encoders, token budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import accents
from tidemark.functions import columns as C
from tidemark.operators import selection
from tidemark.sources import files


def folded(text: Column) -> Column:
    """Lower-cased, marks of all scripts stripped."""
    return accents.unaccented(F.lower(F.coalesce(text, F.lit(""))))


def words_of(text: Column) -> Column:
    """Words of two letters or digits at least."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def word_ngrams(text: Column) -> Column:
    """Words of two letters or digits at least, and pairs of neighbours."""
    def grams(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)

    return C.once(words_of(text), grams)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of ``low`` to ``high`` characters within words padded by a blank on either side; a shorter word gives itself once."""
    padded = F.transform(F.filter(F.split(folded(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(word: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, made).otherwise(F.array().cast("array<string>"))

    def grams(word: Column) -> Column:
        return F.when(F.length(word) < low, F.array(word)).otherwise(F.concat(*[runs(word, n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(padded, grams))


def runs_of(terms: Column) -> Column:
    """(term, at) where each run of equal terms begins in the sorted array, in order, and a last one behind the end, without a term."""
    def begins(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), ordered)
        placed = F.arrays_zip(ordered.alias("term"), before.alias("before"), F.sequence(F.lit(1), F.size(ordered) + 1).alias("at"))
        return F.filter(placed, lambda x: ~x["term"].eqNullSafe(x["before"]))

    return F.when(F.size(terms) > 0, C.once(F.sort_array(terms), begins))


def term_counts(docs: DataFrame, terms: Column, keys: list[str]) -> DataFrame:
    """keys, term, tf of each document; the first key is the document's id.

    Texts are shuffled by id before they are cut up, which is far less than their terms; the counts then need no shuffle. The terms of a row are
    counted within the row, so that no task holds those of many documents; only if keys occur more than once, which a pass over them
    alone tells, are the counts of their rows added up.
    """
    # A fixed number of partitions, which adaptive execution doesn't join to a few large ones: a text's cutting takes far longer than its reading.
    held = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys[0]).select(*keys, terms.alias("terms"))
    runs = held.select(*keys, runs_of(F.col("terms")).alias("runs"))
    ends = F.arrays_zip(F.col("runs").alias("run"), F.slice("runs", 2, F.size("runs")).alias("next"))
    counts = runs.select(*keys, F.inline(ends).alias("run", "next")).where("next IS NOT NULL").select(
        *keys, F.col("run.term").alias("term"), (F.col("next.at") - F.col("run.at")).cast("long").alias("tf")
    )
    if docs.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        return counts
    return counts.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def vocabulary(docs: DataFrame, terms: Column, ends: DataFrame, min_df: int, max_df: float, size: int) -> DataFrame:
    """``vocabulary_of`` the terms of documents with record_id and opening_date."""
    return vocabulary_of(term_counts(docs, terms, ["record_id", "opening_date"]), docs, ends, min_df, max_df, size)


def vocabulary_of(counts: DataFrame, docs: DataFrame, ends: DataFrame, min_df: int, max_df: float, size: int) -> DataFrame:
    """fold, term, df, tf, n, idf of the terms kept for each fold, fitted on documents dated up to its ``train_end``.

    Terms are counted once for each span between two ends, by one shuffle; folds add up these sums of a term. Of terms within the
    document frequency bounds the ``size`` most frequent stay; ties go by term. Documents after the last end aren't counted.
    """
    folds = F.broadcast(ends.select("fold", "train_end"))
    named = ends.select("fold", "train_end").where("train_end IS NOT NULL").collect()  # a row for each fold
    until = sorted({r["train_end"] for r in named})
    if not until:
        raise ValueError("no fold to fit a vocabulary for")
    span = F.lit(0)
    for end in until[:-1]:
        span = span + (F.col("opening_date") > F.lit(end)).cast("int")
    inside = [F.col("span") == i for i in range(len(until))]
    summed = counts.where(F.col("opening_date") <= F.lit(until[-1])).select("term", "tf", span.alias("span")).groupBy("term").agg(
        *[F.count(F.when(here, 1)).alias(f"df_{i}") for i, here in enumerate(inside)], *[F.coalesce(F.sum(F.when(here, F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for i, here in enumerate(inside)],
    )
    upto = lambda kind, end: reduce(lambda a, b: a + b, [F.col(f"{kind}_{i}") for i, own in enumerate(until) if own <= end]).alias(kind)
    sums = [F.struct(F.lit(r["fold"]).cast(ends.schema["fold"].dataType).alias("fold"), upto("df", r["train_end"]), upto("tf", r["train_end"])) for r in named]
    fitted = summed.select("term", F.inline(F.array(*sums))).where("df > 0")
    sizes = docs.groupBy("opening_date").agg(F.count("*").alias("n")).join(folds, F.col("opening_date") <= F.col("train_end")).groupBy("fold").agg(F.sum("n").alias("n"))
    bounded = fitted.join(F.broadcast(sizes), "fold").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    # The frequency at which the size is reached, from how many terms have each: only terms from there on are ranked.
    above = Window.partitionBy("fold").orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, -1)
    often = bounded.groupBy("fold", "tf").agg(F.count("*").alias("terms")).withColumn("before", F.coalesce(F.sum("terms").over(above), F.lit(0)))
    cut = often.where(F.col("before") < size).groupBy("fold").agg(F.min("tf").alias("cut"))
    some = bounded.join(F.broadcast(cut), "fold").where("tf >= cut").drop("cut")
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("tf"), "term"))).where(F.col("place") <= size)
    return ranked.select("fold", "term", "df", "tf", "n", (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def measured(table: DataFrame, text: str, limit: int = 1 << 27) -> DataFrame:
    """The table, marked for broadcast if its texts and 64 bytes a row stay below ``limit`` bytes. Pass a written table."""
    size = table.agg(F.sum(F.octet_length(text) + 64).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(table) if size <= limit else table


def tfidf(counts: DataFrame, vocabulary_: DataFrame, keys: list[str]) -> DataFrame:
    """fold, keys, term, weight: 1 + ln tf, times idf, rows of unit length; the length is taken over a document's own terms.

    With counts from ``term_counts`` and a ``measured`` vocabulary nothing is shuffled.
    """
    weighed = counts.join(vocabulary_, "term").withColumn("w", (1 + F.ln(counts["tf"])) * F.col("idf")).select("fold", *keys, "term", "w")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("fold", *keys)))
    return weighed.select("fold", *keys, "term", (F.col("w") / length).alias("weight"))


def weight_summary(counts: DataFrame, vocabulary_: DataFrame, keys: list[str]) -> DataFrame:
    """fold, keys, terms, weight_sum, weight_max: number, sum and maximum of a document's ``tfidf`` weights, summed up before its length divides them: no window and no sort."""
    w = (1 + F.ln(counts["tf"])) * F.col("idf")
    weighed = counts.join(vocabulary_, "term").select("fold", *keys, w.alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")))
    return weighed.groupBy("fold", *keys).agg(F.count("*").alias("terms"), (F.sum("w") / length).alias("weight_sum"), (F.max("w") / length).alias("weight_max"))


def scaling(cases: DataFrame, numbers: list[str]) -> DataFrame:
    """fold, feature, mean, std (population; 1 where it is 0 or missing) from train rows with ``fold``."""
    long = cases.select("fold", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("x"))
    spread = F.stddev_pop("x.v")
    return long.groupBy("fold", F.col("x.feature").alias("feature")).agg(
        F.avg("x.v").alias("mean"), F.when(F.coalesce(spread, F.lit(0.0)) == 0, 1.0).otherwise(spread).alias("std")
    )


def frequent_levels(cases: DataFrame, column: str, least: int) -> DataFrame:
    """fold and level of the non-blank values seen at least so often in train rows."""
    return cases.where(F.trim(column) != "").groupBy("fold", F.col(column).alias("level")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def collapsed(cases: DataFrame, levels: DataFrame, column: str) -> DataFrame:
    """``column`` with levels that aren't frequent in the fold as one."""
    known = levels.select("fold", F.col("level").alias(column), F.lit(1).alias("known"))
    return cases.join(known, ["fold", column], "left").withColumn(column, F.when(F.col("known") == 1, F.col(column)).otherwise(C.RARE)).drop("known")


def encoded(cases: DataFrame, scales: DataFrame, numbers: list[str], levels: dict[str, DataFrame], fixed: list[str] | None = None) -> DataFrame:
    """fold, record_id, feature, value: standardised numbers and one-hot levels, long and sparse.

    ``levels`` has the frequent levels by fold of each category to collapse; the values of ``fixed`` columns, such as units from a
    closed list, are levels as they are. A missing number gives no row.
    """
    long = cases.select("fold", "record_id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("x"))
    out = long.select("fold", "record_id", "x.*").where("v IS NOT NULL").join(F.broadcast(scales), ["fold", "feature"]).select(
        "fold", "record_id", "feature", ((F.col("v") - F.col("mean")) / F.col("std")).alias("value")
    )
    hot = {c: collapsed(cases.select("fold", "record_id", c), known, c) for c, known in levels.items()} | {c: cases for c in fixed or []}
    for c, table in hot.items():
        out = out.unionByName(table.select("fold", "record_id", F.concat(F.lit(f"{c}="), c).alias("feature"), F.lit(1.0).alias("value")))
    return out


def feature_counts(numbers: list[str], levels: DataFrame, folds: DataFrame, units: int) -> DataFrame:
    """fold, numbers, companies, units, total: the features an encoder gives; companies with the level of all others."""
    counted = folds.select("fold").join(levels.groupBy("fold").agg(F.count("*").alias("k")), "fold", "left")
    made = counted.select("fold", F.lit(len(numbers)).cast("long").alias("numbers"), (F.coalesce("k", F.lit(0)) + 1).cast("long").alias("companies"), F.lit(units).cast("long").alias("units"))
    return made.withColumn("total", F.col("numbers") + F.col("companies") + F.col("units"))


def truncated(ids: Column, budget: int, strategy: str = "head", first: int = 1, last: int = 2) -> Column:
    """Token ids within ``budget`` places including the two special ids: the head, or the head and the tail."""
    room = budget - 2
    head = room // 2
    kept = {
        "head": F.slice(ids, 1, room),
        "head_tail": F.when(F.size(ids) <= room, ids).otherwise(F.concat(F.slice(ids, 1, head), F.slice(ids, F.size(ids) - (room - head) + 1, room - head))),
    }[strategy]
    return F.concat(F.array(F.lit(first)), kept, F.array(F.lit(last)))


def token_profile(lengths: DataFrame, variants: dict[str, int], limits: tuple[int, ...] = (128, 256, 384, 512)) -> DataFrame:
    """Length statistics, and what each variant's budget cuts; ``lengths`` has n_tokens without special ids.

    Everything starts from how many records have each length; the percentiles are the same for all variants and are taken once.
    """
    named = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    counts = files.written(lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("k")))
    made = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(b - 2).alias("room")) for v, b in variants.items()]))
    long = counts.select("n_tokens", "k", made.alias("x")).select("n_tokens", "k", "x.*")
    cut, mean = F.col("n_tokens") > F.col("room"), lambda c: F.sum(c * F.col("k")) / F.sum("k")
    held = long.groupBy("variant").agg(
        F.sum("k").cast("long").alias("records"), mean(F.col("n_tokens")).alias("mean"), F.max("n_tokens").cast("long").alias("max"),
        *[mean((F.col("n_tokens") > limit).cast("double")).alias(f"over_{limit}") for limit in limits],
        F.coalesce(F.sum(F.when(cut, F.col("k"))), F.lit(0)).cast("long").alias("truncated"), mean(F.least("n_tokens", "room")).alias("retained_mean"),
        mean(F.greatest(F.col("n_tokens") - F.col("room"), F.lit(0))).alias("discarded_mean"),
    )
    found = selection.quantiles_of(counts.select(F.col("n_tokens").cast("double").alias("value_"), F.col("k").alias("n_")), [], named).drop("n")
    return held.join(F.broadcast(found), F.lit(True)).select("variant", "records", "mean", *named, "max", *[f"over_{k}" for k in limits], "truncated", "retained_mean", "discarded_mean")  # one row
