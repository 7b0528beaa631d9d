"""Entities of questions: symbols, phrases, tagged spans and alias lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import extract_genes, match_keywords
from .topk import top_k

# Span labels that name genes and drugs.
GENE_LABELS = (
    "Gene_or_gene_product", "Gene", "Protein", "Coreference", "Diagnostic_procedure",
)
DRUG_LABELS = ("Drug", "Chemical", "Medication", "Pharmacologic_substance")

# Common names that are not official symbols.
COMMON_ALIASES = {
    "p53": "TP53",
    "her2": "ERBB2",
    "neu": "ERBB2",
    "ras": "KRAS",
    "k-ras": "KRAS",
    "arf": "CDKN2A",
    "p14arf": "CDKN2A",
    "p16": "CDKN2A",
    "myc": "MYC",
    "c-myc": "MYC",
    "egfr": "EGFR",
    "her1": "EGFR",
}


def spans_to_entities(spans: DataFrame, key: str = "query_id", strict: bool = False) -> DataFrame:
    """(key, genes, drugs, keywords) from tagged spans (key, word, entity_group, score).

    ``strict`` wants a confidence over 0.6 and three characters, and files everything that is not
    a gene under keywords.
    """
    word = F.replace(F.trim("word"), F.lit("##"), F.lit(""))
    usable = spans.withColumn("word", word).where(F.length("word") > 1)
    gene = F.col("entity_group").isin(*GENE_LABELS)
    drug = F.col("entity_group").isin(*DRUG_LABELS)
    if strict:
        usable = usable.where((F.col("score") > 0.6) & (F.length("word") >= 3))
        drugs, keywords = F.lit(False), ~gene
    else:
        drugs, keywords = drug, F.lit(False)
    return usable.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(gene, F.upper("word")))).alias("genes"),
        F.array_sort(F.collect_set(F.when(drugs, F.col("word")))).alias("drugs"),
        F.array_sort(F.collect_set(F.when(keywords, F.col("word")))).alias("keywords"),
    )


def _empty() -> Column:
    return F.array().cast("array<string>")


def extract_entities(queries: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Questions with sorted ``genes``, ``drugs`` and ``keywords``."""
    out = queries.withColumns({
        "genes": extract_genes("query"), "drugs": _empty(), "keywords": match_keywords("query"),
    })
    if spans is not None:
        tagged = spans_to_entities(spans).select(
            "query_id", F.col("genes").alias("_genes"), F.col("drugs").alias("_drugs")
        )
        out = (
            out.join(tagged, "query_id", "left")
            .withColumn("genes", F.array_union("genes", F.coalesce("_genes", _empty())))
            .withColumn("drugs", F.array_union("drugs", F.coalesce("_drugs", _empty())))
            .drop("_genes", "_drugs")
        )
    return out.withColumns({
        c: F.array_sort(F.array_distinct(c)) for c in ("genes", "drugs", "keywords")
    })


def gene_names(alias_table: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query, names): official symbol first, then up to three aliases, one-letter names dropped."""
    symbol = F.coalesce("symbol", "query")
    names = F.concat(
        F.array(symbol), F.slice(F.coalesce("alias", _empty()), 1, settings.max_aliases)
    )
    listed = alias_table.select(
        "query", F.array_distinct(F.filter(names, lambda n: F.length(n) > 1)).alias("names")
    )
    # one entry for a symbol that the table lists more than once
    return top_k(listed, 1, ["query"], [F.asc(F.array_join("names", "|"))], "_n").drop("_n")


def expand_aliases(
    genes: DataFrame, alias_table: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Genes (key columns, gene) with ``names``; an unknown gene keeps its own name."""
    names = gene_names(alias_table, settings).withColumnRenamed("query", "gene")
    return genes.join(names, "gene", "left").withColumn(
        "names", F.coalesce("names", F.array("gene"))
    )


def common_alias(name: Column | str) -> Column:
    """Official symbol of a common name; NULL when it is not one."""
    table = F.create_map(*[F.lit(x) for pair in COMMON_ALIASES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.col(name) if isinstance(name, str) else name))


def normalize_names(
    names: DataFrame, alias_table: DataFrame | None = None, name: str = "name"
) -> DataFrame:
    """Add ``normal``: fixed names, then the alias table, then upper case.

    ``alias_table`` is (query, symbol). It is reduced to one symbol for each name before the join,
    so a name repeated in it cannot multiply rows.
    """
    fixed = common_alias(name)
    if alias_table is None:
        return names.withColumn("normal", F.coalesce(fixed, F.upper(name)))
    table = alias_table.groupBy(F.col("query").alias(name)).agg(F.min("symbol").alias("_symbol"))
    return (
        names.join(table, name, "left")
        .withColumn("normal", F.coalesce(fixed, "_symbol", F.upper(name)))
        .drop("_symbol")
    )
