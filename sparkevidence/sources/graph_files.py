"""Triple tables and property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE_COLUMNS = (
    "x_name", "x_type", "relation", "display_relation", "y_name", "y_type", "rel_source",
)
#: Lines of one file of a stored graph.
FILE_ROWS = 1_000_000
SIDE_TABLES = ("synthetic_lethality", "genes", "drug_gene_interactions", "kg_fts")


def read_triples(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The triple table from files, or from a database with ``fmt='jdbc'`` and its options."""
    reader = spark.read.format(fmt).options(**options)
    df = reader.load() if fmt == "jdbc" else reader.load(path)
    return df.select(*TRIPLE_COLUMNS)


def write_triples(triples: DataFrame, table: str, buckets: int, mode: str = "error") -> None:
    """Store the triples twice, bucketed by subject and by object, for lookups from either end."""
    for side, key in (("by_x", "x_name"), ("by_y", "y_name")):
        triples.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(f"{table}_{side}")


def read_side_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in SIDE_TABLES:
        raise ValueError(f"unknown table {name}, expected one of {SIDE_TABLES}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def _one_edge_each(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(
        F.max_by(F.struct("relationship", "attrs"), "pos").alias("last")
    ).select("src", "dst", "last.relationship", "last.attrs")


_ATTRS = "map<string,string>"


def load_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, attrs) and edges (src, dst, relationship, attrs) of one JSON file.

    For exchange files, which are read as one document. Large graphs are kept as tables, see
    ``save_graph``.
    """
    doc = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"nodes array<{_ATTRS}>, edges array<{_ATTRS}>").alias("g")
    )
    nodes = doc.select(F.posexplode("g.nodes").alias("pos", "n"))
    edges = doc.select(F.posexplode("g.edges").alias("pos", "e"))
    return _nodes(nodes), _edges(edges)


def _nodes(rows: DataFrame) -> DataFrame:
    n = F.col("n")
    last = rows.groupBy(n["id"].alias("id")).agg(F.max_by("n", "pos").alias("n"))
    rest = F.map_filter("n", lambda k, v: ~k.isin("id", "type", "name"))
    return last.select("id", n["type"].alias("type"), n["name"].alias("name"), rest.alias("attrs"))


def _edges(rows: DataFrame) -> DataFrame:
    e = F.col("e")
    rest = F.map_filter("e", lambda k, v: ~k.isin("source", "target", "relationship", "type"))
    flat = rows.select(
        "pos", e["source"].alias("src"), e["target"].alias("dst"),
        F.coalesce(e["relationship"], e["type"], F.lit("related_to")).alias("relationship"),
        rest.alias("attrs"),
    )
    return _one_edge_each(flat)


def load_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file, read in splits by the XML source."""
    keys = (
        spark.read.format("xml").option("rowTag", "key")
        .schema("_id string, `_attr.name` string, _for string").load(path)
    )
    data = "data array<struct<_key:string,_VALUE:string>>"
    nodes = (
        spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    )
    edges = (
        spark.read.format("xml").option("rowTag", "edge")
        .schema(f"_source string, _target string, {data}").load(path)
    )
    names = {r["_id"]: r["_attr.name"] for r in keys.collect()}  # a handful of declared fields
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None

    def attrs():
        rows = F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>"))
        label = (lambda d: F.coalesce(F.try_element_at(table, d["_key"]), d["_key"])) if names else (
            lambda d: d["_key"]
        )
        return F.map_from_entries(F.transform(rows, lambda d: F.struct(label(d), d["_VALUE"])))

    node_rows = nodes.withColumn("a", attrs()).select(
        F.col("_id").alias("id"), F.col("a")["type"].alias("type"), F.col("a")["name"].alias("name"),
        F.map_filter("a", lambda k, v: ~k.isin("type", "name")).alias("attrs"),
    )
    edge_rows = edges.withColumn("a", attrs()).select(
        F.monotonically_increasing_id().alias("pos"),
        F.col("_source").alias("src"), F.col("_target").alias("dst"),
        F.coalesce(F.col("a")["relationship"], F.col("a")["type"], F.lit("related_to")).alias(
            "relationship"
        ),
        F.map_filter("a", lambda k, v: ~k.isin("relationship", "type")).alias("attrs"),
    )
    return node_rows, _one_edge_each(edge_rows)


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, mode: str = "error") -> None:
    """Store a graph as compressed JSON lines, nodes and edges apart.

    Names and keys repeat in every line. A compressed file is read as a whole by one task, so files
    hold ``FILE_ROWS`` lines at most.
    """
    base = folder.rstrip("/")
    named = edges.withColumnsRenamed({"src": "source", "dst": "target"})
    for name, rows in (("nodes", nodes), ("edges", named)):
        rows.write.mode(mode).options(compression="gzip", maxRecordsPerFile=FILE_ROWS).json(f"{base}/{name}")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A graph stored by ``save_graph``."""
    base = folder.rstrip("/")
    nodes = spark.read.schema(f"id string, type string, name string, attrs {_ATTRS}").json(
        f"{base}/nodes"
    )
    edges = spark.read.schema(
        f"source string, target string, relationship string, attrs {_ATTRS}"
    ).json(f"{base}/edges")
    return nodes, edges.withColumnsRenamed({"source": "src", "target": "dst"})
