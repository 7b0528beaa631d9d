"""Corpus, vectors, benchmark items, stored payloads and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators.bm25 import ROW_GROUP_BYTES, Index, open_index

METADATA_SCHEMA = """
  struct<title:string,paper_title:string,link:string,url:string,source:string,date:string,
    snippet:string,key_genes:array<string>,key_methods:array<string>,is_web:boolean,
    is_synthetic:boolean>
"""
CORPUS_SCHEMA = f"doc_id long, text string, metadata {METADATA_SCHEMA}"
BENCHMARK_SCHEMA = """
  input string, target string,
  metadata struct<gene_a:string,gene_b:string,label:int,negation_type:string>
"""


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, metadata columns) from JSON lines ``{text, metadata}``.

    A row without ``doc_id`` gets an id from its text and metadata, so a file read again, in other
    splits, gives the same ids. Equal rows get equal ids.
    """
    raw = spark.read.schema(CORPUS_SCHEMA).json(path)
    return flatten_corpus(raw)


def flatten_corpus(raw: DataFrame) -> DataFrame:
    m = F.col("metadata")
    fields = (
        "title", "paper_title", "link", "url", "date", "snippet", "key_genes", "key_methods",
        "is_web", "is_synthetic",
    )
    return raw.select(
        F.coalesce("doc_id", F.xxhash64("text", F.to_json("metadata"))).alias("doc_id"),
        F.col("text").alias("content"),
        *[m[f].alias(f) for f in fields],
        m["source"].alias("source_name"),
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding); vectors belong to chunks by key, not by position."""
    return spark.read.parquet(path).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )


def write_vectors(vectors: DataFrame, path: str, mode: str = "error") -> None:
    vectors.select("vec_id", "embedding").write.mode(mode).parquet(path)


def write_index(index: Index, folder: str, mode: str = "error") -> None:
    """Keep a word index beyond the session that built it."""
    base = folder.rstrip("/")
    postings = index.postings.sortWithinPartitions("term", "bucket")
    postings.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{base}/postings")
    index.buckets.write.mode(mode).parquet(f"{base}/buckets")
    index.words.write.mode(mode).parquet(f"{base}/words")


def read_index(spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> Index:
    """An index from ``write_index``; ``settings`` must have the k1 and b it was built with."""
    base = folder.rstrip("/")
    return open_index(*[spark.read.parquet(f"{base}/{x}") for x in ("postings", "buckets", "words")], settings)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK_SCHEMA).json(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(payload): stored registry answers, one JSON document in each line."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def write_results(results: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object for each row, NULL fields left out."""
    results.write.mode(mode).json(path)
