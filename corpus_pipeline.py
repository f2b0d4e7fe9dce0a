"""The corpus pipeline: judge quality, remove near-duplicates and benchmark copies, blank out secrets, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the table is written as Parquet and
read again. All but the last return the columns of ``documents`` (and any further ones that the table has).

Defined cases: rows that share an id are one document, of which the row with the least text stays; null texts are kept, as nothing speaks against them; a table without rows passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, neardup, quality, secrets
from tidemark.llm.common import remove, shared_dir, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the co-trained classifier takes for bad ones."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), shared_dir(spark))
    # All columns pass through beside the scores, under other names where they could clash, so that no join is needed.
    order, fed = docs.columns, ("text", "source", "lang", "n_chars")
    scored = quality.score(docs.withColumnsRenamed({c: f"__{c}" for c in order if c not in fed}), model)
    kept = scored.where((F.col("score") >= quality.REJECT_BELOW) | F.col("text").isNull())
    return kept.select(*[F.col(c if c in fed else f"__{c}").alias(c) for c in order])


#: Classes of ids by hash; those in which some document goes are broadcast: at most so many numbers, however large the corpus.
SLOTS = 1 << 20


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each near-duplicate class; of rows that share an id the one with the least text.

    A row in a slot of ids in which none goes stays where it is; only the others are shuffled to be compared with the ids that go.
    """
    folder = shared_dir(spark)
    found = written(neardup.classes(docs, folder), f"{folder}/found")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    # Of each id: whether it goes, or stays but has several rows. Rows without an id stay.
    ids = written(ids.where("NOT kept OR n > 1"), f"{folder}/odd-ids")
    remove(spark, f"{folder}/found")
    slot = lambda: F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SLOTS))
    slots = F.broadcast(ids.select(slot().alias("slot")).distinct())
    order = docs.columns
    at = "slot_" + "_".join(order)  # the name of no other column
    placed = docs.withColumn(at, F.coalesce(slot(), F.lit(-1)))
    near = placed[at] == slots["slot"]
    still = placed.join(slots, near, "left_anti").select(*[f"`{c}`" for c in order])
    rest = placed.join(slots, near, "left_semi").select(*[f"`{c}`" for c in order])
    kept = still.unionByName(rest.join(ids.select("doc_id"), "doc_id", "left_anti").select(*[f"`{c}`" for c in order]))
    several = ids.where("kept").select("doc_id")
    if several.isEmpty():
        return kept
    # One row each, summed up before the shuffle however many rows share an id.
    least = rest.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*[f"`{c}`" for c in order]), F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(*[f"`{c}`" for c in order]))).alias("row")
    )
    return kept.unionByName(least.select(*[F.col("row")[c].alias(c) for c in order]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents of which at least one word in twenty lies in a benchmark window."""
    order = docs.columns
    held = docs.withColumnsRenamed({c: f"__{c}" for c in order if c != "text"})
    marked = decontaminate.verdicts(decontaminate.mark(held, table(spark, sf_dir, "benchmark")))
    return marked.where("NOT contaminated").select(*[F.col(c if c == "text" else f"__{c}").alias(c) for c in order])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; no document goes. ``n_chars`` follows where a text changed."""
    order = docs.columns
    at = "length_" + "_".join(order)  # the name of no other column
    cleaned = secrets.redact(docs.withColumn(at, F.length("text")))
    sized = F.when(F.col(at) != F.length("text"), F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return cleaned.withColumn("n_chars", sized).select(*[f"`{c}`" for c in order])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, packed as little-endian unsigned 32-bit integers, and whether they decode to the same bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return made.select(
        "doc_id", "lang", "source", "ids",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]
#: SQL can't express the classifier, the sketches or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
