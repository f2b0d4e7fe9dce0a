"""Raw strings to clean cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def binary_outcome(df: DataFrame, status_col: str, positive: str, negative: str, keep_unobserved: bool = False, out: str = "target_resolved") -> DataFrame:
    """1 and 0 for the two statuses; rows of other statuses go, or stay with null."""
    df = df.withColumn(out, F.when(F.col(status_col) == positive, 1).when(F.col(status_col) == negative, 0))
    return df if keep_unobserved else df.where(F.col(status_col).isin(positive, negative))


def clean_cases(raw: DataFrame, min_chars: int = 10, min_words: int = 2) -> DataFrame:
    """Typed, trimmed cases: the date parses, the text has enough characters and words.

    Reads ID, id_case, company, text, opened, location, status and the outcome made from it.
    """
    shaped = raw.select(
        F.trim("ID").alias("record_id"),
        F.trim("id_case").alias("complaint_id"),
        C.cleaned(F.col("company")).alias("company"),
        C.cleaned(F.col("text")).alias("complaint_text"),
        C.trimmed(F.coalesce("location", F.lit(""))).alias("location"),
        C.parsed_date(F.trim("opened")).alias("opening_date"),
        F.col("target_resolved").cast("int").alias("target_resolved"),
    )
    text = F.col("complaint_text")
    return shaped.where(F.col("opening_date").isNotNull() & (C.char_count(text) >= min_chars) & (C.word_count(text) >= min_words))


def add_features(cases: DataFrame) -> DataFrame:
    """The feature table of 24 columns, in one projection."""
    text, day = F.col("complaint_text"), F.col("opening_date")
    chars, words, marks = C.char_count(text), C.word_count(text), C.markers(text)
    month, dow = F.month(day).cast("long"), C.weekday(day)
    return cases.select(
        "record_id", "complaint_id", "company", "complaint_text", "location", C.unit(F.col("location")).alias("uf"), "opening_date", "target_resolved",
        chars.alias("text_char_count"), words.alias("text_word_count"),
        C.ln1(chars).alias("log_text_char_count"), C.ln1(words).alias("log_text_word_count"),
        C.times(text, "!").alias("exclamation_count"), C.times(text, "?").alias("question_count"), marks.alias("anonymization_marker_count"),
        C.flag(F.contains(text, F.lit("!"))).alias("has_exclamation"), C.flag(F.contains(text, F.lit("?"))).alias("has_question"),
        C.flag(marks > 0).alias("has_anonymization_marker"),
        month.alias("opening_month"), dow.alias("opening_weekday"),
        C.turn(month, 12, F.sin).alias("opening_month_sin"), C.turn(month, 12, F.cos).alias("opening_month_cos"),
        C.turn(dow, 7, F.sin).alias("opening_weekday_sin"), C.turn(dow, 7, F.cos).alias("opening_weekday_cos"),
    )
