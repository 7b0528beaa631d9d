"""Size checks, lineage cuts and other means that keep the jobs safe on large inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a narrow table (keys and numbers only) may be broadcast.
BROADCAST_ROWS = 1_000_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows; never counts further than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table after checking its size; beyond the bound leave it to a shuffle."""
    return F.broadcast(df) if at_most(df, rows) else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; where it is unset, a folder inside the warehouse directory.

    Both are shared by the driver and all executors on a cluster.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that this session's jobs have written to the checkpoint folder."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/tables")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A path for a new table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from there.

    Iterative jobs call this once per round, so that neither the plan nor the work to redo after a
    lost executor grows with the number of rounds. It also serves rows that several later steps
    read. Being a table, it is read by column and its size is known to the optimizer.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table to all cores.

    A file is read by as many tasks as it has row groups, often by one. A table smaller than one
    split for each core is dealt out row by row, which moves no more than that; a larger one is read
    as it lies, since its row groups keep all cores busy.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df if int(size) > cores * split else df.repartition(cores)
