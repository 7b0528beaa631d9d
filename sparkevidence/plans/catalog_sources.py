"""Catalogue: sources and sinks. Each query writes a whole table in the format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scale import cut_lineage, new_folder
from ..sources import corpus, dependency_files, graph_files
from . import sql, testbed
from .catalog_knowledge import _lethality, _triples
from .registry import query


@query("source_corpus", """
    select doc_id, md5(text) as digest, split_part(text, chr(10), 1) as title, source as source_name,
      'https://example.org/' || source || '/' || doc_id as link, lang <> 'en' as is_web, lang as key_gene
    from documents""")
def source_corpus(spark, sf_dir):
    """Documents as JSON lines ``{doc_id, text, metadata}``."""
    link = F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    rows = testbed.texts(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.struct(
            F.substring_index("text", "\n", 1).alias("title"), link.alias("link"), "source",
            F.array("lang").alias("key_genes"), (F.col("lang") != "en").alias("is_web"),
        ).alias("metadata"),
    )
    folder = new_folder(spark)
    corpus.write_results(rows, folder)
    return corpus.read_corpus(spark, folder).select(
        "doc_id", F.md5("content").alias("digest"), "title", "source_name", "link", "is_web",
        F.get("key_genes", F.lit(0)).alias("key_gene"),
    )


@query("source_vectors", """
    select vec_id, len(embedding) as n, p as pos, embedding[p]::double as x
    from (select *, unnest(generate_series(1, len(embedding))) as p from embeddings)""")
def source_vectors(spark, sf_dir):
    folder = new_folder(spark)
    corpus.write_vectors(testbed.vectors(spark, sf_dir), folder)
    return corpus.read_vectors(spark, folder).select(
        "vec_id", F.size("embedding").cast("long").alias("n"), F.posexplode("embedding").alias("pos", "x")
    ).select("vec_id", "n", (F.col("pos") + 1).cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query("source_matrix", f"with {sql.MATRIX} select gene, cell_line, score from matrix")
def source_matrix(spark, sf_dir):
    """The score matrix as a wide CSV: a row for each cell line, ``SYMBOL (ID)`` heads a gene's column."""
    matrix = cut_lineage(testbed.matrix(spark, sf_dir))
    heads = F.concat("gene", F.lit(" ("), F.xxhash64("gene").cast("string"), F.lit(")"))
    wide = matrix.withColumn("head", heads).groupBy(F.col("cell_line").alias("DepMap_ID")).pivot("head").agg(
        F.max("score")
    )
    folder = new_folder(spark)
    wide.write.option("header", True).csv(folder)
    return dependency_files.read_dependency_matrix(spark, folder).select("gene", "cell_line", "score")


@query("source_cell_lines", """
    select 'S' || s_suppkey as cell_line, s_name as name, r_name as cancer_type, '' as subtype, n_name as tissue
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where s_acctbal >= 0""")
def source_cell_lines(spark, sf_dir):
    folder = new_folder(spark)
    testbed.cell_lines(spark, sf_dir).toDF(
        "ModelID", "StrippedCellLineName", "OncotreeLineage", "OncotreePrimaryDisease"
    ).write.option("header", True).csv(folder)
    return dependency_files.read_cell_lines(spark, folder)


@query("source_pairs", f"""
    with {sql.pairs()}
    select gene_a, gene_b, evidence_source, '' as cell_line, pubmed_id, '' as cancer_type, benchmark_level from pairs""")
def source_pairs(spark, sf_dir):
    """Known pairs under the second choice of file and column names."""
    named = {"gene_a": "Gene_A", "gene_b": "Gene_B", "evidence_source": "Source", "pubmed_id": "PubMed_ID",
             "benchmark_level": "Level"}
    folder = new_folder(spark)
    rows = testbed.pairs(spark, sf_dir).withColumnsRenamed(named)
    rows.drop("pair_pos").write.option("header", True).csv(f"{folder}/SL_pairs.csv")
    return dependency_files.read_pairs(spark, folder).drop("pair_pos")


@query("source_triples", f"with {sql.TRIPLES} select * from triples")
def source_triples(spark, sf_dir):
    folder = new_folder(spark)
    _triples(spark, sf_dir).withColumn("comment", F.lit("not read")).write.parquet(folder)
    return graph_files.read_triples(spark, folder)


@query("source_side_tables", f"""
    with {sql.pairs()}
    select gene_a, gene_b, round(o_totalprice / 500000, 4) as sl_score, evidence_source as evidence_type,
      pubmed_id as pmid, benchmark_level as source
    from pairs join orders on o_orderkey = pair_pos // 10""")
def source_side_tables(spark, sf_dir):
    folder = new_folder(spark)
    _lethality(spark, sf_dir).write.parquet(f"{folder}/synthetic_lethality")
    return graph_files.read_side_table(spark, folder, "synthetic_lethality")


@query("source_benchmark", """
    select md5(text) as digest, case when item_id % 2 = 0 then 'yes' else 'no' end as target,
      'G' || (item_id % 100) as gene_a, (item_id % 2)::integer as label
    from benchmark""")
def source_benchmark(spark, sf_dir):
    odd = F.col("item_id") % 2
    rows = testbed.table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("input"), F.when(odd == 0, "yes").otherwise("no").alias("target"),
        F.struct(testbed.gene_of("item_id").alias("gene_a"), odd.cast("int").alias("label")).alias("metadata"),
    )
    folder = new_folder(spark)
    corpus.write_results(rows, folder)
    return corpus.read_benchmark(spark, folder).select(
        F.md5("input").alias("digest"), "target", "metadata.gene_a", "metadata.label"
    )


@query("sink_results", """
    select doc_id, md5(text) as digest, case when lang = 'en' then null else lang end as lang,
      lang is null or lang = 'en' as left_out
    from documents""")
def sink_results(spark, sf_dir):
    """Result lines of all documents; a null field is left out of its line."""
    rows = testbed.texts(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), F.when(F.col("lang") != "en", F.col("lang")).alias("lang")
    )
    folder = new_folder(spark)
    corpus.write_results(rows, folder)
    line = spark.read.text(folder).select(
        F.from_json("value", "doc_id long, content string, lang string").alias("r"),
        F.json_object_keys("value").alias("fields"),
    )
    return line.select(
        "r.doc_id", F.md5("r.content").alias("digest"), "r.lang",
        (~F.array_contains("fields", "lang")).alias("left_out"),
    )


@query("source_payloads", """
    select page_id, md5(html) as digest, url from pages""")
def source_payloads(spark, sf_dir):
    """Stored payloads of all pages, one JSON document in each line."""
    folder = new_folder(spark)
    corpus.write_results(testbed.texts(spark, sf_dir, "pages"), folder)
    page = F.from_json("payload", "page_id long, url string, html string").alias("page")
    return corpus.read_payloads(spark, folder).select(page).select(
        "page.page_id", F.md5("page.html").alias("digest"), "page.url"
    )


@query("graph_files", f"""
    with {sql.TRIPLES},
    n as (select distinct x_name as id, x_type as type from triples union select y_name, y_type from triples)
    select x_name as src, y_name as dst, display_relation as relationship, a.type as src_type, b.type as dst_type
    from triples join n a on x_name = a.id join n b on y_name = b.id""")
def graph_files_round_trip(spark, sf_dir):
    """The triple table as a graph in JSON lines, edges joined with their nodes after reading."""
    triples = _triples(spark, sf_dir)
    empty = F.create_map().cast("map<string,string>").alias("attrs")
    folder = new_folder(spark)
    graph_files.save_graph(
        testbed.triple_nodes(triples).select("*", empty), testbed.triple_edges(triples).select("*", empty), folder
    )
    nodes, edges = graph_files.load_graph(spark, folder)
    for side in ("src", "dst"):
        ends = nodes.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type"))
        edges = edges.join(ends, side)
    return edges.drop("attrs")
