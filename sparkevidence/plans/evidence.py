"""From questions to packed evidence: search, rank, expand, select and pack, for all at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, DEPMAP_KB, PRIORITY_RELATIONS, Settings
from ..functions.text import content_key
from ..functions.trim import truncate_graph
from ..operators import (
    bm25,
    budget,
    compress,
    entities,
    expansion,
    fusion,
    graph,
    kg,
    pairs,
    ranking,
)
from ..operators.scale import cut_lineage

METADATA = (
    "content", "title", "paper_title", "link", "url", "source_name", "key_genes", "key_methods",
    "is_web", "is_synthetic",
)


@dataclass(frozen=True)
class Inputs:
    """Tables of one evidence run. Optional parts are left out of the run when missing."""

    queries: DataFrame  # query_id, query
    corpus: DataFrame  # doc_id, content, metadata columns
    index: bm25.Index
    vectors: DataFrame  # vec_id, embedding
    query_vectors: DataFrame  # query_id, embedding
    expansion_vectors: DataFrame | None = None  # query_id, embedding
    spans: DataFrame | None = None  # query_id, word, entity_group, score
    web_hits: DataFrame | None = None  # query_id, doc_id, metadata columns, source
    known_pairs: DataFrame | None = None
    gene_summary: DataFrame | None = None
    cancer_histogram: DataFrame | None = None
    triples: DataFrame | None = None
    raw_triplets: DataFrame | None = None  # doc_id, raw
    alias_table: DataFrame | None = None
    interactions: DataFrame | None = None
    associations: DataFrame | None = None


@dataclass(frozen=True)
class Evidence:
    entities: DataFrame
    selected: DataFrame
    gate: DataFrame
    packed: DataFrame


def inject_kb_docs(results: DataFrame, asked: DataFrame, inputs: Inputs) -> DataFrame:
    """Add the generated documents of each question's genes at their fixed score."""
    genes = asked.select("query_id", F.explode("genes").alias("gene"))
    docs = pairs.kb_documents(
        genes.select("gene").distinct(), inputs.known_pairs, inputs.gene_summary,
        inputs.cancer_histogram,
    )
    # generated documents get negative ids of their own
    doc_id = -1 - F.pmod(F.xxhash64("link"), F.lit(2**61))
    rows = genes.join(docs, "gene").select(
        "query_id", doc_id.alias("doc_id"), "content", "paper_title", "link", "source_name",
        "key_genes", "key_methods", "is_web", "is_synthetic", "score",
        F.lit(DEPMAP_KB).alias("source"),
    )
    return results.unionByName(rows, allowMissingColumns=True)


def graph_texts(selected: DataFrame, asked: DataFrame, inputs: Inputs, s: Settings) -> DataFrame:
    """Graph text of each question from the stored triplets of its first results."""
    chunks = selected.where(
        (F.col("rank") <= s.max_triplet_chunks) & (F.length("content") >= s.min_triplet_text)
    ).select("query_id", "doc_id", "rank")
    raw = chunks.join(inputs.raw_triplets, "doc_id").select(
        "query_id", F.col("rank").cast("long").alias("doc_id"), "raw"
    )
    normal = cut_lineage(graph.normalize_triplets(graph.triplets_of(raw), inputs.alias_table))
    edges = graph.last_edges(normal, "relation", ("query_id",), ["doc_id", "pos"])
    names = asked.select(
        "query_id", F.concat("genes", F.slice("keywords", 1, 3)).alias("names")
    )
    wanted = names.select("query_id", F.explode("names").alias("name"))
    nodes = edges.select("query_id", F.col("src").alias("node")).unionByName(
        edges.select("query_id", F.col("dst").alias("node"))
    ).distinct()
    upper = wanted.select("query_id", F.upper("name").alias("node"))
    lower = wanted.select("query_id", F.lower("name").alias("node"))
    seeds = nodes.join(upper.unionByName(lower).distinct(), ["query_id", "node"], "left_semi")
    gold = None
    if inputs.interactions is not None and inputs.associations is not None:
        checked = graph.validate_triplets(normal, inputs.interactions, inputs.associations, s)
        gold = graph.gold_lines(checked)
    texts = graph.graph_context(seeds, edges, names, gold)
    return texts.withColumn(
        "content", truncate_graph("content", s.graph_context_tokens)
    )


def collect_evidence(
    inputs: Inputs,
    scorer: Callable | None = None,
    encoder: Callable | None = None,
    compress_first: bool = False,
    hops: int | None = None,
    priority: tuple[str, ...] = PRIORITY_RELATIONS,
    today: str = "1970-01-01",
    settings: Settings = DEFAULTS,
) -> Evidence:
    """Run all steps for a table of questions."""
    s = settings
    asked = cut_lineage(entities.extract_entities(inputs.queries, inputs.spans))
    depth = s.hybrid_top_k

    def scored(rows: DataFrame) -> DataFrame:
        return ranking.pair_score(rows, scorer)

    def with_metadata(hits: DataFrame, n_queries: int) -> DataFrame:
        return fusion.fetch(hits, inputs.corpus, n_queries * depth)

    found = fusion.hybrid_search(
        inputs.queries, inputs.corpus, inputs.index, inputs.vectors, inputs.query_vectors, depth,
        inputs.expansion_vectors, settings=s,
    ).select("query_id", "doc_id", "score", "source", "key", "rank")
    rows = with_metadata(found, inputs.queries.count())
    if inputs.web_hits is not None:
        web = inputs.web_hits.withColumn("key", content_key("content"))
        rows = fusion.dedupe_first(
            rows.withColumn("leg", F.lit(0)).unionByName(
                web.withColumn("leg", F.lit(1)), allowMissingColumns=True
            ),
            ["query_id"], ["leg", "rank", "doc_id"],
        ).drop("leg")
    first = ranking.rerank(scored(rows.join(inputs.queries, "query_id"))).drop("query")

    def search(questions: DataFrame) -> DataFrame:
        # broader questions have no vectors of their own; they are matched by words
        hits = bm25.search(questions, inputs.index, s.merge_top_k, s)
        ids = hits.withColumn("source", F.lit("bm25"))
        n = questions.count() * s.merge_top_k
        return fusion.fetch(ids, inputs.corpus.withColumn("key", content_key("content")), n)

    ranked = expansion.multi_hop_expand(inputs.queries, first, search, scored, s)
    if inputs.known_pairs is not None:
        ranked = inject_kb_docs(ranked, asked, inputs)
    boosted = ranking.entity_boost(ranked.join(asked.drop("query", "drugs"), "query_id"))
    selected = cut_lineage(
        ranking.diversify(ranking.with_fingerprint(boosted), s).drop("genes", "keywords")
    )
    gate = ranking.fallback_gate(inputs.queries, selected, s)
    usable = selected.join(gate.where(~F.col("no_evidence")).select("query_id"), "query_id")
    if compress_first:
        usable = cut_lineage(
            compress.compress_sentence_filter(
                usable.join(inputs.queries, "query_id"), encoder, s
            ).drop("query", "original_length", "compressed_length")
        )
    kg_texts = None
    if inputs.triples is not None:
        named = kg.query_entities(asked, s)
        facts = kg.kg_subgraph(named, inputs.triples, hops, priority, s)
        kg_texts = cut_lineage(kg.kg_context(named, facts))
    graph_rows = None
    if inputs.raw_triplets is not None:
        graph_rows = cut_lineage(graph_texts(usable, asked, inputs, s))
    packed = budget.pack_context(
        usable.select("query_id").distinct(), usable, kg_texts, graph_rows, today, s
    )
    return Evidence(asked, selected, gate, packed)
