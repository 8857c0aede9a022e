"""The corpus pipeline: documents to packed training sequences.

STAGES are (name, function) in order. Each function takes (spark, docs, sf_dir) and returns
a DataFrame; run() writes each result as Parquet to the shared folder and hands the reread
rows to the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import lines, ngram_join, packing, quality, toxicity
from firmlens.llm.common import stored, table
from firmlens.llm.queries import vocabulary

#: Five words and 0.8, as near-duplicate stages take them.
NEAR_WORDS, NEAR_BOUND = 5, (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's shrunken failure rate let pass."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below the threshold; fitted on labelled documents that came this far."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxicity.score") < toxicity.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that stay elsewhere; documents that lose every line with a word go. n_chars follows the text."""
    kept = lines.dedup(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; where that id repeats, its rows stay. Rows without an id stay."""
    groups = ngram_join.join(docs, words=NEAR_WORDS, bound=NEAR_BOUND)
    firsts = groups.where("doc_id = component_id").select("doc_id")
    named = docs.join(firsts.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: SQL cannot express the fitted classifier, MinHash or the packing program. Tests hold the stages' operators against brute force or labels, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
