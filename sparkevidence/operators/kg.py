"""Search in a large triple table and its side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EXTERNAL_KG, PRIORITY_RELATIONS, Settings
from ..functions.render import format_drug, format_gene, format_pair
from ..functions.text import raw_symbols
from . import bm25
from .grams import substring_join
from .pairs import oriented
from .scale import BROADCAST_ROWS, cut_lineage
from .topk import limited_rows, top_k


#: Entities whose facts one task puts together.
TASK_ENTITIES = 5_000


def kg_stats(triples: DataFrame) -> DataFrame:
    return triples.agg(
        F.count("*").alias("total_rows"), F.count_distinct("relation").alias("unique_relations")
    )


def limited_neighbours(
    triples: DataFrame, keys: DataFrame, key: str, order: list[Column], cap: int
) -> DataFrame:
    """The first ``cap`` triples of each wanted node."""
    return limited_rows(triples, keys, key, [key], order, cap, "_n", BROADCAST_ROWS).drop("_n")


def _priority(relation: str, relations: tuple[str, ...]) -> Column:
    return F.upper(relation).isin(*[r.upper() for r in relations])


def kg_paths(
    entities: DataFrame,
    triples: DataFrame,
    hops: int | None = None,
    priority: tuple[str, ...] = PRIORITY_RELATIONS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, path, is_priority): distinct facts around the entities of each question.

    ``entities`` is (query_id, entity). Facts run forward, one step further with two hops, and
    backward; each node gives at most 50 facts (10 on the second step) in a fixed order.
    """
    hops = settings.kg_hops if hops is None else hops
    asked = entities.select("query_id", F.upper(F.trim("entity")).alias("entity")).where(
        F.col("entity") != ""
    ).distinct()
    order_out = [F.asc(c) for c in ("relation", "y_name", "rel_source")]
    order_in = [F.asc(c) for c in ("relation", "x_name", "rel_source")]

    # the limits sort whole rows, so each side carries only the columns of its texts
    out = limited_neighbours(
        triples.drop("x_type"), asked.withColumnRenamed("entity", "x_name"), "x_name", order_out,
        settings.kg_fanout,
    )
    if hops > 1:
        out = cut_lineage(out)  # read twice below
    forward = asked.join(out, asked["entity"] == out["x_name"])
    arrow = F.lit(" → ")
    facts = [
        forward.select(
            "query_id",
            F.concat(
                F.lit("- "), "x_name", arrow, "display_relation", arrow, "y_name",
                F.lit(" (Type: "), "y_type", F.lit(", Source: "), "rel_source", F.lit(")"),
            ).alias("path"),
            _priority("relation", priority).alias("is_priority"),
        )
    ]
    if hops > 1:
        middle = out.select(F.col("y_name").alias("x_name")).distinct()
        further = limited_neighbours(
            triples.drop("x_type", "y_type"), middle, "x_name", order_out, settings.kg_second_hop_fanout
        ).select(
            F.col("x_name").alias("y_name"),
            F.col("relation").alias("relation_2"),
            F.col("display_relation").alias("display_2"),
            F.col("y_name").alias("z_name"),
        )
        facts.append(
            forward.join(further, "y_name")
            .where(F.col("z_name") != F.col("entity"))
            .select(
                "query_id",
                F.concat(
                    F.lit("- "), "x_name", arrow, "display_relation", arrow, "y_name", arrow,
                    "display_2", arrow, "z_name",
                ).alias("path"),
                _priority("relation_2", priority).alias("is_priority"),
            )
        )
    into = limited_neighbours(
        triples.drop("y_type"), asked.withColumnRenamed("entity", "y_name"), "y_name", order_in,
        settings.kg_fanout,
    )
    facts.append(
        asked.join(into, asked["entity"] == into["y_name"]).select(
            "query_id",
            F.concat(
                F.lit("- "), "x_name", F.lit(" ("), "x_type", F.lit(") → "), "display_relation",
                arrow, "y_name", F.lit(" (Source: "), "rel_source", F.lit(")"),
            ).alias("path"),
            _priority("relation", priority).alias("is_priority"),
        )
    )
    merged = facts[0]
    for more in facts[1:]:
        merged = merged.unionByName(more)
    # an entity gives a bounded number of facts, which move once and serve what follows by question
    n = asked.count()
    tasks = max(min(n, triples.sparkSession.sparkContext.defaultParallelism), -(-n // TASK_ENTITIES), 1)
    return merged.repartition(tasks, "query_id").groupBy("query_id", "path").agg(F.max("is_priority").alias("is_priority"))


def kg_subgraph(
    entities: DataFrame,
    triples: DataFrame,
    hops: int | None = None,
    priority: tuple[str, ...] = PRIORITY_RELATIONS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The best facts of each question: priority relations first, twenty in all."""
    return top_k(
        kg_paths(entities, triples, hops, priority, settings),
        settings.kg_max_paths,
        ["query_id"],
        [F.desc("is_priority"), F.asc("path")],
    )


def kg_context(entities: DataFrame, subgraph: DataFrame) -> DataFrame:
    """(query_id, content): the facts of each question as one text."""
    facts = subgraph.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("rows")
    )
    names = entities.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            F.col("pos") if "pos" in entities.columns else F.lit(0).alias("pos"),
                            F.upper(F.trim("entity")).alias("entity"),
                        )
                    )
                ),
                lambda e: e["entity"],
            ),
            ", ",
        ).alias("names")
    )
    count = F.size("rows").cast("string")
    content = F.concat(
        F.lit("=== [External Knowledge Graph - "), count, F.lit(" Facts] ===\n"),
        F.lit("Data Source: DepMap, DrugBank, Bgee (Anatomical Expression)\n"),
        F.lit("Confidence Level: P0 (Highest - Structured Data)\nQuery: "), "names", F.lit("\n\n"),
        F.array_join(F.transform("rows", lambda r: r["path"]), "\n"),
    )
    return facts.join(names, "query_id").select("query_id", content.alias("content"))


def query_entities(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, pos, entity): given genes and drugs, else the first symbols of the question."""
    given = F.array().cast("array<string>")
    for c in ("genes", "drugs"):
        if c in queries.columns:
            given = F.concat(given, F.coalesce(c, F.array().cast("array<string>")))
    found = F.slice(raw_symbols("query"), 1, settings.kg_max_entities)
    chosen = F.when(F.size(given) > 0, given).otherwise(found)
    return queries.select("query_id", F.posexplode(chosen).alias("pos", "entity"))


def kg_search(
    queries: DataFrame, triples: DataFrame, hops: int | None = None,
    priority: tuple[str, ...] = PRIORITY_RELATIONS, settings: Settings = DEFAULTS,
) -> DataFrame:
    """One knowledge-graph result for each question that has any fact."""
    entities = query_entities(queries, settings)
    found = kg_context(entities, kg_subgraph(entities, triples, hops, priority, settings))
    return found.withColumns({"score": F.lit(0.95), "source": F.lit(EXTERNAL_KG)})


def node_info(names: DataFrame, triples: DataFrame) -> DataFrame:
    """Existence, type and degrees of each name. Both degrees are counted before they meet."""
    asked = names.select(F.upper(F.trim("name")).alias("name")).distinct()
    out = triples.groupBy(F.col("x_name").alias("name")).agg(
        F.count("*").alias("out_degree"), F.min("x_type").alias("type")
    )
    into = triples.groupBy(F.col("y_name").alias("name")).agg(F.count("*").alias("in_degree"))
    zero = F.lit(0).cast("long")
    return (
        asked.join(out, "name", "left")
        .join(into, "name", "left")
        .withColumn("out_degree", F.coalesce("out_degree", zero))
        .withColumn("in_degree", F.coalesce("in_degree", zero))
        .withColumn("total_relations", F.col("out_degree") + F.col("in_degree"))
        .withColumn("exists", F.col("total_relations") > 0)
        .withColumn(
            "type", F.when(F.col("exists"), F.coalesce("type", F.lit("Unknown")))
        )
    )


def gene_evidence(
    query_genes: DataFrame, lethality: DataFrame, genes: DataFrame, k: int = 10,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Stored pairs (best first) and gene records of the first genes of each question."""
    asked = query_genes.where(F.col("pos") < settings.kg_max_entities).select(
        "query_id", "pos", F.upper("gene").alias("gene")
    )
    rows = oriented(lethality.withColumns({"a": F.col("gene_a"), "b": F.col("gene_b")}))
    best = limited_rows(
        rows, asked, "gene", ["gene"],
        [F.desc_nulls_last("sl_score"), F.asc("partner"), F.asc("source")], k, "n",
    )
    score = F.coalesce(F.nullif("sl_score", F.lit(0.0)), F.lit(0.8))
    pair_rows = asked.join(best, "gene").select(
        "query_id", "pos", "n", "gene",
        format_pair({
            "gene_a": "a", "gene_b": "b", "sl_score": "sl_score",
            "evidence_type": "evidence_type", "pmid": "pmid", "source": "source",
        }).alias("content"),
        score.alias("score"),
    )
    # one whole record for each symbol, the first in order of its fields
    record = F.struct("name", "function", "pathway", "essentiality_score")
    one = genes.groupBy(F.col("symbol").alias("gene")).agg(F.min(record).alias("r")).select(
        "gene", "r.*"
    )
    info_rows = asked.join(one, "gene").select(
        "query_id", "pos", F.lit(10_000).alias("n"), "gene",
        format_gene({
            "symbol": "gene", "name": "name", "function": "function", "pathway": "pathway",
            "essentiality_score": "essentiality_score",
        }).alias("content"),
        F.lit(0.9).alias("score"),
    )
    return pair_rows.unionByName(info_rows).withColumn("source", F.lit(EXTERNAL_KG))


def lethality_partners(genes: DataFrame, lethality: DataFrame) -> DataFrame:
    """All partners of each gene with score and evidence."""
    asked = genes.select(F.upper("gene").alias("gene")).distinct()
    return (
        oriented(lethality)
        .join(asked, "gene")
        .select("gene", "partner", "sl_score", "evidence_type", "source")
    )


def drug_targets(drugs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Interactions of every drug whose name contains the asked name, case ignored."""
    asked = drugs.select("drug", F.lower("drug").alias("needle")).distinct()
    stored = interactions.withColumn("low_name", F.lower("drug_name"))
    hits = substring_join(asked, "needle", stored, "low_name")
    return asked.join(hits, "needle").join(stored, "low_name").drop("needle", "low_name")


def drug_evidence(
    query_drugs: DataFrame, interactions: DataFrame, k: int = 10, settings: Settings = DEFAULTS
) -> DataFrame:
    """Interaction records of the first drugs of each question."""
    asked = query_drugs.where(F.col("pos") < settings.kg_max_entities)
    found = drug_targets(asked.select("drug"), interactions)
    best = top_k(
        found, k, ["drug"],
        [
            F.asc(c)
            for c in ("drug_name", "target_gene", "interaction_type", "mechanism", "source")
        ],
        "n",
    )
    return asked.join(best, "drug").select(
        "query_id", "pos", "n", "drug", "target_gene",
        format_drug({
            c: c for c in (
                "drug_name", "target_gene", "interaction_type", "mechanism", "clinical_status",
                "source",
            )
        }).alias("content"),
        F.lit(0.85).alias("score"),
        F.lit(EXTERNAL_KG).alias("source"),
    )


def kg_text_search(queries: DataFrame, facts: DataFrame | bm25.Index, k: int = 10) -> DataFrame:
    """Word search over rendered facts (doc_id, content) or their index; hits carry a fixed score."""
    index = facts if isinstance(facts, bm25.Index) else bm25.build_index(facts)
    hits = bm25.search(queries, index, k)
    return hits.withColumnRenamed("score", "match_score").withColumn("score", F.lit(0.7))
