"""Typed settings with the default limits and thresholds of the evidence jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # retrieval and fusion
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    hybrid_top_k: int = 40
    merge_top_k: int = 20

    # ranking and selection
    score_threshold: float = 0.3
    max_chunks_per_paper: int = 2
    max_results: int = 15
    plain_top_k: int = 8
    kb_doc_score: float = 0.95

    # gene dependency knowledge base
    essentiality_threshold: float = -0.5
    min_common_lines: int = 10

    # knowledge graph
    kg_fanout: int = 50
    kg_second_hop_fanout: int = 10
    kg_max_paths: int = 20
    kg_hops: int = 1
    kg_max_entities: int = 5

    # graph validation
    interaction_threshold: float = 0.7
    association_threshold: float = 0.1
    association_high: float = 0.5
    min_triplet_text: int = 50

    # aliases
    max_aliases: int = 3

    # token budget
    max_context_tokens: int = 12000
    system_tokens: int = 1000
    p0_tokens: int = 1500
    p1_tokens: int = 3000
    p2_tokens: int = 1500
    graph_context_tokens: int = 800
    eval_mode: bool = True
    eval_content_length: int = 10000

    # compression
    compression_ratio: float = 0.6
    context_window: int = 1

    # multi-hop expansion
    weak_threshold: float = 0.4
    max_hops: int = 2
    step_back_queries: int = 3

    # web pages
    min_content_length: int = 200
    max_web_hits: int = 20
    max_triplet_chunks: int = 3
    max_graph_hops: int = 2


# Relations listed before all other facts of the knowledge graph.
PRIORITY_RELATIONS = (
    "CelllinedependOnGene",
    "Drug_Drug_Interaction",
    "Gene_LowExpress_Anatomy",
)

# Words that make an object name look like a disease.
DISEASE_KEYWORDS = (
    "CANCER", "TUMOR", "CARCINOMA", "SARCOMA", "LEUKEMIA",
    "LYMPHOMA", "MELANOMA", "SYNDROME", "DISEASE", "DISORDER",
    "GLIOBLASTOMA", "ADENOCARCINOMA", "MYELOMA", "NEUROBLASTOMA",
)

# The kinds of evidence source a result can carry.
LOCAL_DENSE = "local_dense"
BM25 = "bm25"
EXTERNAL_KG = "external_kg"
DEPMAP_KB = "depmap_kb"
GRAPH_RAG = "graph_rag"
WEB_SEARCH = "web_search"
PUBMED = "pubmed"
SOURCE_KINDS = (LOCAL_DENSE, BM25, EXTERNAL_KG, DEPMAP_KB, GRAPH_RAG, WEB_SEARCH, PUBMED)

DEFAULTS = Settings()
