"""The driver's tables seen as domain inputs: corpus, questions, scores, pairs and triples.

The comparison side builds the same inputs in SQL, see ``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_genes
from ..operators.scale import spread

PRIORITY = ("ordered", "located_in")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, spread over all cores when its file has too few splits."""
    return spread(table(spark, sf_dir, name))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: (query_id, group_id, query_pos, query)."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("conv_id").alias("group_id"),
        F.col("turn").cast("int").alias("query_pos"),
        F.col("text").alias("query"),
    )


def corpus(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """The documents as a corpus; ``read`` is ``texts`` where all of them are worked through."""
    none = F.lit(None).cast("string")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("content"),
        F.substring_index("text", "\n", 1).alias("title"),
        none.alias("paper_title"),
        none.alias("link"),
        none.alias("url"),
        F.col("source").alias("source_name"),
        F.slice(extract_genes("text"), 1, 3).alias("key_genes"),
        F.array().cast("array<string>").alias("key_methods"),
        (F.col("lang") != "en").alias("is_web"),
        F.lit(False).alias("is_synthetic"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return vectors(spark, sf_dir).join(items, "vec_id").withColumnRenamed("vec_id", "query_id")


def gene_of(column: str):
    return F.concat(F.lit("G"), (F.col(column) % 100).cast("string"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            gene_of("l_partkey").alias("gene"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("cell_line"),
            ((0.05 - F.col("l_discount")) / 0.05).alias("value"),
        )
        .groupBy("gene", "cell_line")
        .agg(F.round(F.avg("value"), 6).alias("score"))
    )


def cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cell lines; those with a negative balance have no profile."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .where(F.col("s_acctbal") >= 0)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("cell_line"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("cancer_type"),
            F.col("n_name").alias("tissue"),
        )
    )


def order_genes(spark: SparkSession, sf_dir: str, back: int, gene: str) -> DataFrame:
    """The gene of each order line, under the number of the line ``back`` before it."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") - back).alias("line"), gene_of("l_partkey").alias(gene)
    )


def pairs(spark: SparkSession, sf_dir: str, apart: int = 1) -> DataFrame:
    """Known pairs: the genes of any two lines of one order that are ``apart`` numbers apart.

    ``pair_pos`` is ten times the order plus the number of the first line.
    """
    none = F.lit("")
    a = order_genes(spark, sf_dir, 0, "gene_a")
    b = order_genes(spark, sf_dir, apart, "gene_b")
    orders = table(spark, sf_dir, "orders")
    return (
        a.join(b, ["l_orderkey", "line"])
        .where(F.col("gene_a") != F.col("gene_b"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "gene_a",
            "gene_b",
            F.col("o_orderpriority").alias("evidence_source"),
            none.alias("cell_line"),
            F.col("o_orderkey").cast("string").alias("pubmed_id"),
            none.alias("cancer_type"),
            F.when(F.col("o_orderstatus") == "F", "Gold").otherwise("Silver").alias(
                "benchmark_level"
            ),
            (F.col("o_orderkey") * 10 + F.col("line")).alias("pair_pos"),
        )
    )


def order_of_pair():
    """The order that a pair comes from."""
    return F.floor(F.col("pair_pos") / 10)


def part_name(column: str):
    return F.concat(F.lit("PART#"), F.col(column).cast("string"))


def place_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where suppliers, customers and nations are."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").select(
        F.upper("s_name").alias("x_name"), F.lit("Supplier").alias("x_type"),
        F.col("s_nationkey").alias("k"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.upper("c_name").alias("x_name"), F.lit("Customer").alias("x_type"),
        F.col("c_nationkey").alias("k"),
    )
    located = supplier.unionByName(customer).join(nation, F.col("k") == F.col("n_nationkey"))
    region = table(spark, sf_dir, "region")
    within = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return located.select(
        "x_name", "x_type", F.lit("located_in").alias("relation"),
        F.lit("located in").alias("display_relation"), F.upper("n_name").alias("y_name"),
        F.lit("Nation").alias("y_type"), F.lit("registry").alias("rel_source"),
    ).unionByName(
        within.select(
            F.upper("n_name").alias("x_name"), F.lit("Nation").alias("x_type"),
            F.lit("part_of").alias("relation"), F.lit("part of").alias("display_relation"),
            F.upper("r_name").alias("y_name"), F.lit("Region").alias("y_type"),
            F.lit("atlas").alias("rel_source"),
        )
    )


def trade_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers ordered and who supplied it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    ordered = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "l_partkey")
        .distinct()
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.upper("c_name").alias("x_name"), F.lit("Customer").alias("x_type"),
            F.lit("ordered").alias("relation"), F.lit("ordered").alias("display_relation"),
            part_name("l_partkey").alias("y_name"), F.lit("Part").alias("y_type"),
            F.lit("orders").alias("rel_source"),
        )
    )
    supplied = (
        lines.select("l_partkey", "l_suppkey")
        .distinct()
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            part_name("l_partkey").alias("x_name"), F.lit("Part").alias("x_type"),
            F.lit("supplied_by").alias("relation"), F.lit("supplied by").alias("display_relation"),
            F.upper("s_name").alias("y_name"), F.lit("Supplier").alias("y_type"),
            F.lit("lineitem").alias("rel_source"),
        )
    )
    return ordered.unionByName(supplied)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_triples(spark, sf_dir).unionByName(place_triples(spark, sf_dir))


def triple_edges(triples: DataFrame) -> DataFrame:
    return triples.select(
        F.col("x_name").alias("src"), F.col("y_name").alias("dst"),
        F.col("display_relation").alias("relationship"),
    )


def triple_nodes(triples: DataFrame) -> DataFrame:
    ends = triples.select(F.col("x_name").alias("id"), F.col("x_type").alias("type")).unionByName(
        triples.select(F.col("y_name").alias("id"), F.col("y_type").alias("type"))
    )
    return ends.distinct().withColumn("name", F.lower("id"))
