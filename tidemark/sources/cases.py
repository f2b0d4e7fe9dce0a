"""Case tables from the given tables: one record with a company, a date and a binary outcome for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clean import binary_outcome


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cases(spark: SparkSession, sf_dir: str, observed_only: bool = True) -> DataFrame:
    """Orders as cases: the customer's nation is the company, F and O are the outcomes, P is unobserved."""
    nations = F.broadcast(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    joined = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nations.select("n_nationkey", "r_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    cases = joined.select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.col("o_orderkey").cast("string").alias("complaint_id"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("company"),
        F.col("r_name").alias("location"),
        F.col("o_orderdate").cast("date").alias("opening_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("k"),
        F.col("o_totalprice").alias("amount"),
    )
    return binary_outcome(cases, "status", "F", "O", keep_unobserved=not observed_only)


def event_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases: the user is the company, a purchase the positive outcome."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("user_id").cast("string").alias("company"),
        F.col("ts").cast("date").alias("opening_date"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("target_resolved"),
    )


def line_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cases without ids: the supplier is the company, a return the positive outcome."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("company"),
        F.col("l_shipdate").cast("date").alias("opening_date"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target_resolved"),
    )


def text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases: source, language, and the label, null if not observed."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.col("source").alias("company"),
        F.col("text").alias("complaint_text"),
        F.upper("lang").alias("location"),
        F.expr("date_add(DATE '2024-01-01', CAST(doc_id % 365 AS INT))").alias("opening_date"),
        F.col("quality").cast("int").alias("target_resolved"),
    )


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw strings: two date formats, doubled blanks and tabs, statuses as words."""
    cases = text_cases(spark, sf_dir)
    odd = F.col("record_id").cast("long") % 2 == 1
    return cases.select(
        F.col("record_id").alias("ID"),
        F.concat(F.lit("C"), "record_id").alias("id_case"),
        F.concat(F.lit(" "), "company", F.lit("  x ")).alias("company"),
        F.concat(F.lit("\t "), "complaint_text", F.lit("  \t!")).alias("text"),
        F.when(odd, F.date_format("opening_date", "dd/MM/yyyy")).otherwise(F.date_format("opening_date", "yyyy-MM-dd")).alias("opened"),
        F.concat(F.lit("City - "), F.when(odd, F.lit("SP ")).otherwise(F.col("location"))).alias("location"),
        F.when(F.col("target_resolved") == 1, "Resolved").when(F.col("target_resolved") == 0, "Unresolved").otherwise("Open").alias("status"),
    )
