"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet and
reads it again as the next one's documents. All stages but the last keep the columns of ``documents``. What a stage wrote
is dropped once the next one is written, so that a run holds two stages at most.

Defined results, for each stage as for the operator it calls: nulls in any column pass through unless a stage says otherwise, and
rows without text end in the first; an empty table gives an empty table; rows that repeat are rows of their own until a
deduplicating stage meets them; ties go to the smallest id; texts are whole whatever their length; further columns, whatever
their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import exact_dedup, langid, mixing, ngram_join, packing
from keyfold.llm.queries import table, tokenizer_path
from keyfold.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose best language has a mean probability below
    0.35. Without any labelled row no language can be told and every document goes."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (runs of white space as one space; null as empty) one row with the smallest id stays; a
    null id counts as the largest."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 75 % of their word 5-grams the one with the smallest id stays. Documents
    without a word or an id link with nothing and stay; rows that repeat the id that stays all stay."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them, null being a source too; a source without words takes none."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096 tokens; a document without text is one piece with the end id."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: Training a network, links of shingle sets and best-fit packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.keep(f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
