"""A training corpus from raw documents: five stages, each one of the operators of ``llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``, with n_chars as the length of the text that is left. Rows:

* ``language_id`` drops documents without letters or without any known n-gram; learned from the
  rows outside the held-out fold of its own input.
* ``jaccard_join`` keeps one document (the smallest id) of each group of near duplicates.
* ``suffix_array_dedup`` cuts passages of 50 words and more that a document with a smaller id holds;
  documents of which nothing is left go.
* ``decontaminate`` cuts the words inside benchmark passages; documents of which nothing is left go.
* ``pack`` returns the pieces of all documents with their sequence and offset.

Null and empty texts go in the first stage, as they have no letters. Rows without an id stay, as
nothing can be said to repeat them. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkevidence.llm.decontaminate import remove_contamination
from sparkevidence.llm.jaccard import keep_first
from sparkevidence.llm.langid import keep_identified
from sparkevidence.llm.packing import pack, placed_pieces
from sparkevidence.llm.suffixes import drop_passages
from sparkevidence.llm.tables import small_batches, stored, table

#: SQL has no way to tokenise or to learn profiles; the tests compare with brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _counted(drop_passages(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _counted(remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return placed_pieces(pack(docs)).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontaminate", decontaminate),
    ("pack", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as a table for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
