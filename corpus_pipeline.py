"""From raw documents to packed training sequences: each stage applies one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import settle, table
from quillspark.llm.decontaminate import contamination
from quillspark.llm.langid import keep_identified
from quillspark.llm.packing import pack, token_pieces
from quillspark.llm.sentences import drop_repeated_sentences
from quillspark.llm.simhash import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, null and empty texts among them, go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of sentences that came before; n_chars counts what is left.

    All rows stay, whatever their id; null texts stay null, and other columns as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_other{i}") for i, c in enumerate(others)])
    left = drop_repeated_sentences(plain).select("doc_id", "text", *[F.col(f"_other{i}").alias(c) for i, c in enumerate(others)]).select(*[f"`{c}`" for c in docs.columns])
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages.

    Rows of one id are judged together; rows of null ids stay.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return docs.join(found.select(F.col("doc_id").alias("_hit")), docs["doc_id"] == F.col("_hit"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, their ids included, with their sequence and place; null texts are empty."""
    return pack(token_pieces(docs)).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Language models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
