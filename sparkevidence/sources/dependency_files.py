"""CSV inputs of the gene dependency knowledge base."""

from __future__ import annotations

import csv
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File and column names that may hold the same thing, first choice first.
PAIR_FILES = ("SL_Benchmark_Final.csv", "sl_benchmark.csv", "SL_pairs.csv")
PAIR_COLUMNS = {
    "gene_a": (("gene_a", "Gene_A"), ""),
    "gene_b": (("gene_b", "Gene_B"), ""),
    "evidence_source": (("evidence_source", "Source"), "Unknown"),
    "cell_line": (("cell_line", "Cell_Line"), "N/A"),
    "pubmed_id": (("pubmed_id", "PubMed_ID"), ""),
    "cancer_type": (("cancer_type", "Cancer_Type"), ""),
    "benchmark_level": (("benchmark_level", "Level"), ""),
}
CELL_LINE_COLUMNS = {
    "cell_line": (("ModelID", "DepMap_ID"), ""),
    "name": (("CellLineName", "StrippedCellLineName"), ""),
    "cancer_type": (("OncotreeLineage", "PrimaryOrMetastasis"), ""),
    "subtype": (("OncotreeSubtype",), ""),
    "tissue": (("Tissue", "OncotreePrimaryDisease"), ""),
}


_COMMA_OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _first_existing(df: DataFrame, spec: dict[str, tuple[tuple[str, ...], str]]) -> list[Column]:
    """One column for each name, from the first header that exists; its blanks stay blank."""
    out = []
    for name, (choices, default) in spec.items():
        present = [c for c in choices if c in df.columns]
        value = F.coalesce(F.col(f"`{present[0]}`"), F.lit("")) if present else F.lit(default)
        out.append(value.alias(name))
    return out


def read_dependency_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cell_line, score) from a wide CSV with a ``SYMBOL (ID)`` column for each gene.

    Lines are split and exploded against the header, so the width of the matrix is data and not
    plan size. Commas inside quotes part nothing. Values that are no numbers are dropped. For a symbol that heads several columns the
    last one with a value wins.
    """
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "gene string, cell_line string, score double")
    header = [h.strip() for h in next(csv.reader([first["value"]], skipinitialspace=True))]
    id_pos = header.index("DepMap_ID") if "DepMap_ID" in header else header.index("")
    columns = [
        (i, h.split(" ")[0].strip()) for i, h in enumerate(header) if h not in ("DepMap_ID", "")
    ]
    genes = spark.createDataFrame(columns, "pos int, gene string")
    values = F.when(
        F.contains("value", F.lit('"')), F.split(F.col("value"), _COMMA_OUTSIDE_QUOTES, -1)
    ).otherwise(F.split(F.col("value"), ",", -1))
    cells = (
        lines.where((F.col("value") != first["value"]) & (F.trim("value") != ""))
        .select(
            F.trim(F.get(values, F.lit(id_pos)), F.lit('" ')).alias("cell_line"),
            F.posexplode(values).alias("pos", "raw"),
        )
        .withColumn("score", F.trim(F.trim("raw"), F.lit('"')).try_cast("double"))
        .where(F.col("score").isNotNull())
        # at most one row for each column of the file
        .join(F.broadcast(genes), "pos")
    )
    repeated = [g for g, n in Counter(g for _, g in columns).items() if n > 1]
    plain = cells.where(~F.col("gene").isin(repeated)) if repeated else cells
    out = plain.select("gene", "cell_line", "score")
    if repeated:
        last = cells.where(F.col("gene").isin(repeated)).groupBy("gene", "cell_line").agg(
            F.max_by("score", "pos").alias("score")
        )
        out = out.unionByName(last)
    return out


def read_cell_lines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.select(*_first_existing(df, CELL_LINE_COLUMNS)).where(F.col("cell_line") != "")


def read_pairs(spark: SparkSession, folder: str) -> DataFrame | None:
    """Known pairs from the first of the usual files in a folder; None when there is none."""
    for name in PAIR_FILES:
        try:
            df = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}")
        except AnalysisException:
            continue
        rows = df.select(*_first_existing(df, PAIR_COLUMNS))
        return rows.where(
            (F.trim("gene_a") != "") & (F.trim("gene_b") != "")
        ).withColumn("pair_pos", F.monotonically_increasing_id())
    return None


def write_knowledge_base(
    matrix: DataFrame, cell_lines: DataFrame, pairs: DataFrame, folder: str, mode: str = "error"
) -> None:
    """Store the three tables for later jobs."""
    for name, df in (("matrix", matrix), ("cell_lines", cell_lines), ("pairs", pairs)):
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")
