"""Known gene pairs: partners, validation, generated documents and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, DEPMAP_KB, Settings
from ..functions.common import line
from ..functions.text import raw_symbols
from .dependency import top_cancers
from .topk import limited_rows, top_k

DETAIL = ("evidence_source", "cell_line", "pubmed_id", "cancer_type", "benchmark_level")


def oriented(pairs: DataFrame) -> DataFrame:
    """Each stored pair seen from both genes: (gene, partner, details).

    A union of two projections instead of an either-side join condition, so that lookups by gene
    stay equality joins.
    """
    rest = [c for c in pairs.columns if c not in ("gene_a", "gene_b")]
    a, b = F.upper("gene_a"), F.upper("gene_b")
    forward = pairs.select(a.alias("gene"), F.col("gene_b").alias("partner"), *rest)
    backward = pairs.where(~F.equal_null(a, b)).select(
        b.alias("gene"), F.col("gene_a").alias("partner"), *rest
    )
    return forward.unionByName(backward).where(F.col("gene").isNotNull())


def symmetric_closure(pairs: DataFrame) -> DataFrame:
    """Distinct (gene_a, gene_b) in both orientations, upper-cased, blanks dropped."""
    a, b = F.upper(F.trim("gene_a")), F.upper(F.trim("gene_b"))
    good = pairs.select(a.alias("gene_a"), b.alias("gene_b")).where(
        (F.col("gene_a") != "") & (F.col("gene_b") != "")
    )
    flipped = good.select(F.col("gene_b").alias("gene_a"), F.col("gene_a").alias("gene_b"))
    return good.union(flipped).distinct()


def sl_partners(genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """All stored partners of each gene of ``genes`` (gene)."""
    asked = genes.select(F.upper("gene").alias("gene")).distinct()
    return oriented(pairs).join(asked, "gene")


def _order(pairs: DataFrame) -> list[Column]:
    """Order of a gene's partners: the stored row number if there is one, else by name."""
    names = ["pair_pos"] if "pair_pos" in pairs.columns else []
    return [F.asc(c) for c in (*names, "partner", *DETAIL)]


def validate_pairs(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether each (gene_a, gene_b) is stored in either orientation, with evidence and confidence."""
    want = asked.select(F.upper("gene_a").alias("gene"), F.upper("gene_b").alias("other")).distinct()
    stored = oriented(pairs).withColumn("other", F.upper("partner"))
    # one row for each stored pair, however often it was reported
    first = top_k(stored, 1, ["gene", "other"], _order(pairs), "_first").join(
        want, ["gene", "other"], "left_semi"
    )
    level = F.coalesce("benchmark_level", F.lit(""))
    known = first.select(
        "gene", "other",
        F.lit(True).alias("found"),
        F.concat(
            F.coalesce("evidence_source", F.lit("Unknown")), F.lit(" ("), level, F.lit(")")
        ).alias("evidence"),
        F.when(level.contains("Gold"), 0.9).otherwise(0.7).alias("confidence"),
        F.coalesce("pubmed_id", F.lit("")).alias("pubmed_id"),
    )
    return want.join(known, ["gene", "other"], "left").select(
        F.col("gene").alias("gene_a"),
        F.col("other").alias("gene_b"),
        F.coalesce("found", F.lit(False)).alias("is_validated"),
        "evidence",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "pubmed_id",
    )


def fixed(value: Column | str, digits: int) -> Column:
    """Number with a fixed count of decimals and no grouping."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c, digits).cast(f"decimal(20,{digits})").cast("string")


def partner_documents(genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gene, content, metadata): a document on the known partners of each gene.

    Only the first five partners of a gene are brought together; totals and the set of sources
    are counted in the tasks before they meet the genes, so a gene with very many partners costs
    no more than others.
    """
    asked = genes.select(F.upper("gene").alias("gene")).distinct()
    rows = oriented(pairs)
    first = limited_rows(rows, asked, "gene", ["gene"], _order(pairs), 5, "pos")
    detail = F.concat(
        F.lit("- "), F.col("gene"), F.lit(" is synthetic lethal with "), F.col("partner"),
        F.lit("\n  Evidence Source: "), F.coalesce("evidence_source", F.lit("Unknown")), F.lit("\n"),
        F.when(
            F.coalesce("cell_line", F.lit("")).isin("", "N/A"), ""
        ).otherwise(F.concat(F.lit("  Cell Line: "), "cell_line", F.lit("\n"))),
        F.coalesce(F.concat(line("  PubMed ID: ", "pubmed_id"), F.lit("\n")), F.lit("")),
        F.lit("\n"),
    )
    listed = first.groupBy("gene").agg(
        F.array_sort(F.collect_list(F.struct("pos", "partner", detail.alias("detail")))).alias("rows")
    )
    label = F.nullif("evidence_source", F.lit(""))
    counts = rows.groupBy("gene", label.alias("label")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("gene").agg(
        F.sum("n").alias("total"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("label")), ", "), F.lit("")).alias("sources"),
    )
    partners = F.transform("rows", lambda r: r["partner"])
    content = F.concat(
        F.lit("[DepMap Knowledge Base - Synthetic Lethality]\n\nGene: "), "gene",
        F.lit("\nKnown Synthetic Lethal Partners: "), F.array_join(partners, ", "), F.lit("\n\n"),
        F.array_join(F.slice(F.transform("rows", lambda r: r["detail"]), 1, 3), ""),
        F.lit("Total validated SL interactions: "), F.col("total").cast("string"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("Data sources: "), F.col("sources")), F.lit("")),
    )
    return (
        listed.join(totals, "gene").select(
            "gene",
            F.lit("partners").alias("kind"),
            content.alias("content"),
            F.concat(F.lit("DepMap SL Database: "), "gene", F.lit(" Interactions")).alias("paper_title"),
            F.concat(F.lit("depmap://sl_benchmark/"), "gene").alias("link"),
            F.concat(F.array("gene"), F.slice(partners, 1, 3)).alias("key_genes"),
            F.array(F.lit("synthetic_lethality"), F.lit("depmap")).alias("key_methods"),
        )
    )


def _cancer_lines(histogram: DataFrame) -> DataFrame:
    top = top_cancers(histogram, 5)
    entry = F.concat(
        F.lit("  - "), F.col("cancer_type"), F.lit(": "), F.col("n").cast("string"),
        F.lit(" cell lines"),
    )
    return top.groupBy("gene").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", entry.alias("text")))),
                lambda r: r["text"],
            ),
            "\n",
        ).alias("cancer_lines")
    )


def _essential_share() -> Column:
    return F.concat(
        F.col("essential_count").cast("string"), F.lit("/"),
        F.col("total_cell_lines").cast("string"), F.lit(" cell lines ("),
        fixed("essential_pct", 1), F.lit("%)"),
    )


def _score_range() -> Column:
    return F.concat(fixed("min_score", 3), F.lit(" to "), fixed("max_score", 3))


def essentiality_documents(
    genes: DataFrame, summary: DataFrame, histogram: DataFrame
) -> DataFrame:
    asked = genes.select(F.upper("gene").alias("gene")).distinct()
    content = F.concat(
        F.lit("[DepMap Knowledge Base - Gene Essentiality]\n\nGene: "), "gene",
        F.lit("\nMean CRISPR Effect Score: "), fixed("mean_score", 3),
        F.lit("\nRange: "), _score_range(),
        F.lit("\nEssential in: "), _essential_share(), F.lit("\n\n"),
        F.coalesce(
            F.concat(
                F.lit("Cancer types with highest essentiality:\n"), "cancer_lines", F.lit("\n")
            ),
            F.lit(""),
        ),
        F.lit("\n[Source: DepMap CRISPR Gene Effect]"),
    )
    return (
        summary.join(asked, "gene", "left_semi")
        .join(_cancer_lines(histogram), "gene", "left")
        .select(
            "gene",
            F.lit("essentiality").alias("kind"),
            content.alias("content"),
            F.concat(F.lit("DepMap Gene Essentiality: "), "gene").alias("paper_title"),
            F.concat(F.lit("depmap://essentiality/"), "gene").alias("link"),
            F.array("gene").alias("key_genes"),
            F.array(F.lit("crispr"), F.lit("essentiality"), F.lit("depmap")).alias("key_methods"),
        )
    )


def kb_documents(
    genes: DataFrame, pairs: DataFrame, summary: DataFrame, histogram: DataFrame
) -> DataFrame:
    """Generated documents of each gene, marked synthetic and carrying the fixed score."""
    return (
        partner_documents(genes, pairs)
        .unionByName(essentiality_documents(genes, summary, histogram))
        .withColumns({
            "source_name": F.lit("DepMap_KB"),
            "date": F.lit("2024"),
            "is_synthetic": F.lit(True),
            "is_web": F.lit(False),
            "score": F.lit(DEFAULTS.kb_doc_score),
            "source": F.lit(DEPMAP_KB),
        })
    )


def gene_summary_text(summary: DataFrame, histogram: DataFrame) -> DataFrame:
    """(gene, content): readable summary of each gene."""
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("DepMap Gene Essentiality: "), "gene"),
        F.concat(F.lit("Mean CRISPR Effect: "), fixed("mean_score", 3)),
        F.concat(F.lit("Range: "), _score_range()),
        F.concat(F.lit("Essential in: "), _essential_share()),
        F.concat(F.lit("\nEssential in cancer types:\n"), "cancer_lines"),
        F.lit("\n[Source: DepMap CRISPR Gene Effect]"),
    )
    return summary.join(_cancer_lines(histogram), "gene", "left").select("gene", content.alias("content"))


def query_symbols(queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, pos, gene): the first symbols of the question as written."""
    found = F.slice(raw_symbols("query"), 1, limit)
    return queries.select("query_id", F.posexplode(found).alias("pos", "gene"))


def gene_lookup(
    queries: DataFrame, summary: DataFrame, histogram: DataFrame, k: int = 10
) -> DataFrame:
    """Summaries of the symbols of each question, scored by the size of the mean effect."""
    asked = query_symbols(queries, k)
    texts = gene_summary_text(summary, histogram)
    return (
        asked.join(summary.select("gene", "mean_score", "essential_pct"), "gene")
        .join(texts, "gene")
        .select(
            "query_id", "pos", "gene", F.abs("mean_score").alias("score"), "essential_pct", "content",
            F.lit(DEPMAP_KB).alias("source"),
        )
    )


def kb_context(
    query_genes: DataFrame, pairs: DataFrame, summary: DataFrame, max_tokens: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, content): digest of partners and essentiality of the genes of each question.

    ``query_genes`` is (query_id, pos, gene). Genes are listed until the text passes four
    characters for each token of the budget.
    """
    limit = 4 * (settings.p1_tokens if max_tokens is None else max_tokens)
    wanted = query_genes.withColumn("gene", F.upper("gene"))
    rows = oriented(pairs)
    first = (
        limited_rows(rows, wanted, "gene", ["gene"], _order(pairs), 5, "n")
        .groupBy("gene")
        .agg(F.array_sort(F.collect_list(F.struct("n", "partner"))).alias("rows"))
        .select(
            "gene", F.array_join(F.transform("rows", lambda r: r["partner"]), ", ").alias("partners")
        )
    )
    totals = rows.groupBy("gene").agg(F.count("*").alias("total"))
    partner_line = F.concat(
        F.lit("SL Partners for "), F.col("gene"), F.lit(": "), F.col("partners"),
        F.when(
            F.col("total") > 5,
            F.concat(F.lit(" (+"), (F.col("total") - 5).cast("string"), F.lit(" more)")),
        ).otherwise(""),
    )
    essential_line = F.concat(
        F.col("gene"), F.lit(" Essentiality: Mean="), fixed("mean_score", 2),
        F.lit(", Essential in "), fixed("essential_pct", 0), F.lit("% of cell lines"),
    )
    facts = (
        wanted.join(first, "gene", "left")
        .join(totals, "gene", "left")
        .join(summary.select("gene", "mean_score", "essential_pct"), "gene", "left")
        .withColumn("lines", F.array_compact(F.array(partner_line, essential_line)))
        .where(F.size("lines") > 0)
        .withColumn(
            "chars", F.aggregate("lines", F.lit(0), lambda acc, s: acc + F.length(s)).cast("long")
        )
    )
    running = Window.partitionBy("query_id").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    listed = facts.withColumn("used", F.sum("chars").over(running))
    kept = listed.where(F.col("used") - F.col("chars") <= limit)
    body = kept.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "lines"))).alias("rows"),
        F.max("used").alias("used"),
    )
    lines = F.concat(
        F.array(
            F.lit("=== [DepMap Structured Knowledge (P1)] ==="),
            F.lit("Confidence Level: P1 (High - Validated Database)"),
            F.lit(""),
        ),
        F.flatten(F.transform("rows", lambda r: r["lines"])),
        F.when(F.col("used") > limit, F.array(F.lit("[...truncated]"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.array(F.lit(""), F.lit("[Source: DepMap Knowledge Base]")),
    )
    return body.select("query_id", F.array_join(lines, "\n").alias("content"))
