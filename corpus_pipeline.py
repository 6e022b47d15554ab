"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterbook.llm._common import read_table, staged
from quarterbook.llm.jaccard_join import similar_components
from quarterbook.llm.packing import best_fit_pack
from quarterbook.llm.quality import score_quality
from quarterbook.llm.queries import RANKS, tokenizer_path
from quarterbook.llm.secret_scan import redact_secrets
from quarterbook.llm.substring_dedup import remove_passages

#: Passages that repeat across documents are removed from this many words on.
PASSAGE_WORDS = 50

#: Documents that are likelier bad than good are rejected. op7 reports against a threshold of its own; a score of 0.5, which
#: every document has where no model could be fitted, rejects nothing.
REJECT_BELOW = 0.5


def keyed(docs: DataFrame) -> DataFrame:
    """Rows in one column, so that no name of theirs can clash, with _key, never null: a SHA-256 of a row's id and text together. What a
    stage finds out about a text holds for its rows alone."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(F.concat(told("doc_id"), F.lit("\0"), told("text")), 256)).alias("_key"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, each row by its own text."""
    rows = keyed(docs)
    scored = score_quality(rows.select("row.doc_id", "row.text", "_key"), read_table(spark, sf_dir, "labels"), keep=("_key",))
    return rows.join(scored.where(F.col("score") < REJECT_BELOW).select("_key").distinct(), "_key", "left_anti").select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (a null one comes last), and one row of it.

    Each pair of id and text is a document of its own, so a text neither leaves nor stays for another one of its id. Of rows that
    repeat both, the one with the least columns in their order stands for all.
    """
    one = keyed(docs).groupBy("_key").agg(F.min("row").alias("row"))
    one = staged(one.withColumn("_number", F.monotonically_increasing_id()), "rows")  # numbers stay what they were written as
    classes = similar_components(one.select("_number", "row.text"), "_number")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "_number")).alias("first")
    kept = one.select("_key", "_number", "row.doc_id").join(classes, "_number").groupBy("component_id").agg(first).select("first._number")
    return one.join(kept, "_number", "left_semi").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too; those left without a word go."""
    return remove_passages(docs, PASSAGE_WORDS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a note of the kind in place of each secret."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place, as op4 has them, and the ids themselves."""
    return best_fit_pack(docs, tokenizer_path(RANKS), length=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("ngram jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The quality classifier is a trained model and the packing plan is a loop, so SQL can't give run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
