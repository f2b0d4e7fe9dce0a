"""The contract queries of the corpus operators: thin digests of what each operator returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, hnsw, htmltext, lexical, neardup, pii, quality, secrets, tokenfile, urls, vectordup, whitening
from tidemark.llm.common import shared_dir, table
from tidemark.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the bytes that they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="decoded").select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_dir(spark))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole document."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of(kind) for kind in secrets.BASE],
        F.sha2(secrets.listed("secrets", secrets.BASE), 256).alias("base_sha256"),
        secrets.listed("secrets").alias("spans"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows that occur in each whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return decontaminate.verdicts(marked).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as Simple-8b blocks in order of doc_id and read back."""
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenfile.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, path)
    return tokenfile.read_documents(spark.read.parquet(path))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document by the co-trained views; ``keep`` unless little doubt is left that it is bad."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), shared_dir(spark))
    scored = quality.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), model)
    return scored.select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= quality.REJECT_BELOW).alias("keep"))


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels."""
    return vectordup.classes(table(spark, sf_dir, "embeddings"), shared_dir(spark))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.size(F.filter("personal", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of(kind) for kind in pii.KINDS],
        F.sha2(pii.listed("personal", base_only=True), 256).alias("base_sha256"),
        pii.listed("personal").alias("spans"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    made = whitening.whitened(table(spark, sf_dir, "embeddings"), shared_dir(spark))
    return made.withColumn("deviation", F.col("deviation").cast("long"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    folder = shared_dir(spark)
    index, n, _ = lexical.index(table(spark, sf_dir, "documents"), folder)
    return lexical.search(index, n, table(spark, sf_dir, "benchmark"), folder)


#: Results of a query of the nearest vectors.
NEAREST = 20


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for each vector whose id is divisible by twenty."""
    folder = shared_dir(spark)
    vectors = hnsw.vectors_of(table(spark, sf_dir, "embeddings"), folder)
    graphs = hnsw.index(vectors, folder, NEAREST)
    return hnsw.nearest(graphs, vectors.where(F.col("vec") % 20 == 0), folder, NEAREST)


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_token_file": op5_token_file,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_embedding_duplicates": op8_embedding_duplicates,
    "op9_html_text": op9_html_text,
    "op10_personal_data": op10_personal_data,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_nearest_vectors": op13_nearest_vectors,
}
