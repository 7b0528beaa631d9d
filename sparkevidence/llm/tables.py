"""Small helpers shared by the operators: reading and storing tables, naming columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import ensure_checkpoint_dir

BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in small batches: texts are long, and several workers share an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """Write rows as a compact table in the shared checkpoint folder and read them from there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """The table with all columns but the used ones under names of their own, and the way back.

    Columns that an operator adds can then not clash with those that the caller has.
    """
    names = {c: c if c in used else f"kept_{i}__" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, [F.col(n).alias(c) for c, n in names.items()]


def pieces(total: int, each: int) -> int:
    return max(1, -(-int(total) // each))
