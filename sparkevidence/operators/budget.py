"""Packing evidence into a token budget for each question, most trusted sources first.

Only entries that can still fit are brought together for a question: every entry costs at least a
known number of tokens, which bounds how many of them a budget can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BM25, DEFAULTS, DEPMAP_KB, EXTERNAL_KG, GRAPH_RAG, LOCAL_DENSE, PUBMED
from ..config import WEB_SEARCH, Settings
from ..functions.text import count_tokens
from ..functions.trim import fit_lines, truncate_graph
from .pairs import fixed
from .topk import top_k

# Section headers of the packed text.
HEADER_P0 = "=== [PRIORITY 0] External Knowledge Graph (Highest Confidence) ===\n"
HEADER_P1 = "=== [PRIORITY 1] DepMap Knowledge Base (Known SL Pairs) ===\n"
HEADER_P2 = "=== [PRIORITY 2] Dynamic Knowledge Graph ===\n"
HEADER_P3 = "=== [PRIORITY 3] Retrieved Scientific Literature ===\n"
LEAD_P0 = "**External Knowledge Graph (Highest Confidence):**\n"
LEAD_P1 = "**DepMap Knowledge Base:**\n"
LEAD_P2 = "**Extracted Knowledge Graph:**\n"
LEAD_P3 = "**Literature Evidence:**\n"

LITERATURE = (LOCAL_DENSE, BM25, PUBMED, WEB_SEARCH, DEPMAP_KB)
NO_RANK = 1_000_000_000
# Shortest literature entry: its fixed wording alone is over 52 characters.
LITERATURE_MIN_TOKENS = 13


def list_order() -> list[Column]:
    return [
        F.asc(F.coalesce(F.col("rank"), F.lit(NO_RANK))), F.desc("score"), F.asc("doc_id"),
    ]


def prefix_budget(
    rows: DataFrame, order: list[Column], cost: str, limit: Column | int,
    by: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Leading rows of each group whose running cost stays within the limit."""
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cap = F.lit(limit) if isinstance(limit, int) else limit
    return rows.withColumn("used", F.sum(cost).over(running)).where(F.col("used") <= cap)


def literature_text(position: Column) -> Column:
    """Entry of a literature result in the packed text."""
    title = F.coalesce("title", "paper_title", F.lit("Unknown"))
    web = F.coalesce("is_web", F.lit(False)) | (F.col("source") == WEB_SEARCH)
    link = F.coalesce("link", F.lit(""))
    genes = F.array_join(F.slice("key_genes", 1, 3), ", ")
    where = F.when(web, F.concat(F.lit("🌐 [WEB] ("), link, F.lit(")"))).otherwise("📄 [LOCAL]")
    gene_line = F.when(
        ~web & (F.coalesce(genes, F.lit("")) != ""),
        F.concat(F.lit("Key Genes: "), genes, F.lit("\n")),
    ).otherwise("")
    return F.concat(
        F.lit("\nSource ["), position.cast("string"), F.lit("] "), where, F.lit(" [Rel: "),
        fixed("score", 3), F.lit("]\nTitle: "), title, F.lit("\n"), gene_line,
        F.lit("Content: "), "content", F.lit("\n"),
    )


def reference_content(settings: Settings = DEFAULTS, content: str = "content") -> Column:
    if not settings.eval_mode:
        return F.concat(F.substring(content, 1, 200), F.lit("..."))
    cap = settings.eval_content_length
    if cap <= 0:
        return F.col(content)
    return F.when(
        F.length(content) > cap, F.concat(F.substring(content, 1, cap), F.lit("..."))
    ).otherwise(F.col(content))


def format_references(results: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, id, title, score, content, link) of ranked results."""
    return results.select(
        "query_id",
        F.col("rank").alias("id"),
        F.coalesce("title", "paper_title", F.lit("")).alias("title"),
        F.round("score", 3).alias("score"),
        reference_content(settings).alias("content"),
        F.coalesce("link", "url", F.lit("")).alias("link"),
    )


def _segment(s: Settings) -> Column:
    """Section of a result: 0 triple facts, 1 generated documents, 2 graph, 3 literature."""
    synthetic = F.coalesce("is_synthetic", F.lit(False))
    return (
        F.when(F.col("source") == EXTERNAL_KG, 0)
        .when((F.col("source") == DEPMAP_KB) & synthetic, 1)
        .when(F.col("source") == GRAPH_RAG, 2)
        .when(F.col("source").isin(*LITERATURE) & ~synthetic, 3)
    )


def _by_segment(values: tuple[int, int, int, int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("segment") + 1)


def _priced_entries(results: DataFrame, s: Settings) -> DataFrame:
    """Entries of all sections, numbered, written out and with their running cost.

    One shuffle by question serves every window. A section looks at no more entries than its
    budget can hold.
    """
    relation = F.col("relation") if "relation" in results.columns else F.lit(None).cast("string")
    most = s.max_context_tokens // LITERATURE_MIN_TOKENS + 1
    caps = (s.p0_tokens + 1, s.p1_tokens + 1, s.p2_tokens + 1, most)
    section = Window.partitionBy("query_id", "segment")
    ordered = section.orderBy(*list_order())
    rows = (
        results.drop("n")
        .withColumn("segment", _segment(s))
        .where(F.col("segment").isNotNull())
        .repartition("query_id")
        .withColumn("n", F.row_number().over(ordered))
        .withColumn("total", F.count("*").over(section))
        .where(F.col("n") <= _by_segment(caps))
    )
    fact = F.concat(
        F.lit(" (relation: "), F.coalesce(relation, F.lit("unknown")), F.lit(", score: "),
        fixed("score", 2), F.lit(")"),
    )
    line = F.concat(
        F.col("n").cast("string"), F.lit(". "), "content",
        F.when(F.col("segment") == 0, fact).otherwise(""), F.lit("\n"),
    )
    entry = F.when(F.col("segment") == 3, literature_text(F.col("n"))).otherwise(line)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("entry", entry)
        .withColumn("cost", count_tokens("entry"))
        .withColumn("used", F.sum("cost").over(running))
    )


def pack_context(
    queries: DataFrame,
    results: DataFrame,
    kg_texts: DataFrame | None = None,
    graph_texts: DataFrame | None = None,
    today: str = "1970-01-01",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, context, p0_tokens .. p3_tokens, total_tokens, references) for each question.

    ``results`` are selected results with metadata; ``kg_texts`` and ``graph_texts`` are ready
    texts (query_id, content). Without a ready text, results of those sources fill the section.
    ``today`` is the date written in the head.
    """
    s = settings
    zero = F.lit(0).cast("long")
    heads = queries.select("query_id").distinct()
    for name, texts, cut in (
        ("ready0", kg_texts, lambda c: fit_lines(c, s.p0_tokens)),
        ("ready2", graph_texts, lambda c: truncate_graph(c, s.p2_tokens)),
    ):
        if texts is None:
            heads = heads.withColumn(name, F.lit(None).cast("string"))
        else:
            given = texts.where(F.coalesce("content", F.lit("")) != "")
            heads = heads.join(
                given.select("query_id", cut("content").alias(name)), "query_id", "left"
            )

    question = Window.partitionBy("query_id")
    limits = (s.p0_tokens, s.p1_tokens, s.p2_tokens, 0)
    fits = F.col("used") <= _by_segment(limits)

    def used_by(segment: int) -> Column:
        mine = (F.col("segment") == segment) & fits
        return F.coalesce(F.max(F.when(mine, F.col("used"))).over(question), zero)

    given0, given2 = F.col("ready0").isNotNull(), F.col("ready2").isNotNull()
    rows = (
        heads.join(_priced_entries(results, s), "query_id", "left")
        .withColumn("p0_tokens", F.when(given0, count_tokens("ready0")).otherwise(used_by(0)))
        .withColumn("p1_tokens", used_by(1))
        .withColumn("p2_rows", used_by(2))
        .withColumn("before_p2", F.lit(s.system_tokens) + F.col("p0_tokens") + F.col("p1_tokens"))
    )
    ready2_tokens = count_tokens("ready2")
    room = F.greatest(F.lit(500), F.lit(s.max_context_tokens - 500) - F.col("before_p2"))
    tight = F.col("before_p2") + ready2_tokens > s.max_context_tokens - 500
    rows = (
        rows.withColumn(
            "ready2",
            F.when(tight & (room < ready2_tokens), truncate_graph("ready2", room)).otherwise(
                F.col("ready2")
            ),
        )
        .withColumn("p2_tokens", F.when(given2, count_tokens("ready2")).otherwise(F.col("p2_rows")))
        .withColumn("before_p3", F.col("before_p2") + F.col("p2_tokens"))
    )
    kept = fits | (
        (F.col("segment") == 3)
        & (F.col("used") <= F.lit(s.max_context_tokens) - F.col("before_p3"))
    )
    reference = F.struct(
        F.col("n").alias("id"),
        F.coalesce("title", "paper_title", F.lit("Unknown")).alias("title"),
        "score",
        reference_content(s).alias("content"),
        F.coalesce("link", F.lit("")).alias("link"),
    )
    entry = F.struct(
        "segment", "n", "entry", F.when(F.col("segment") == 3, reference).alias("ref")
    )
    per_query = ["query_id", "ready0", "ready2", "p0_tokens", "p1_tokens", "p2_tokens", "before_p3"]
    packed = rows.groupBy(*per_query).agg(
        F.array_sort(F.collect_list(F.when(kept, entry))).alias("entries"),
        *[
            F.coalesce(F.max(F.when(F.col("segment") == i, F.col("total"))), zero).alias(f"total_{i}")
            for i in range(4)
        ],
        F.coalesce(F.max(F.when(kept & (F.col("segment") == 3), F.col("used"))), zero).alias(
            "p3_tokens"
        ),
    )

    def written(i: int) -> Column:
        return F.filter("entries", lambda e: e["segment"] == i)

    def listed(i: int, lead: str, count_rest: bool = False) -> Column:
        """Numbered lines of a section with its lead and a mark when it was cut."""
        left = F.col(f"total_{i}") - F.size(written(i))
        mark = F.lit("\n...(truncated)")
        if count_rest:
            mark = F.concat(
                F.lit("\n...(truncated, "), left.cast("string"), F.lit(" more entries)")
            )
        body = F.array_join(F.transform(written(i), lambda e: e["entry"]), "")
        return F.when(
            F.col(f"total_{i}") > 0,
            F.concat(F.lit(lead), body, F.when(left > 0, mark).otherwise("")),
        )

    def section(header: str, ready: Column | None, lines: Column) -> Column:
        text = lines
        if ready is not None:
            # a ready text that was cut to nothing leaves the section out
            text = F.when(ready.isNotNull(), F.nullif(ready, F.lit(""))).otherwise(lines)
        return F.coalesce(F.concat(F.lit(header), text, F.lit("\n\n")), F.lit(""))

    head = f"**Current Date:** {today} (Use this to judge 'recent' evidence)\n\n"
    context = F.concat(
        F.lit(head),
        section(HEADER_P0, F.col("ready0"), listed(0, LEAD_P0, True)),
        section(HEADER_P1, None, listed(1, LEAD_P1)),
        section(HEADER_P2, F.col("ready2"), listed(2, LEAD_P2)),
        F.when(F.col("total_3") > 0, HEADER_P3).otherwise(""),
        F.array_join(F.transform(written(3), lambda e: e["entry"]), ""),
    )
    return packed.select(
        "query_id",
        context.alias("context"),
        "p0_tokens", "p1_tokens", "p2_tokens", "p3_tokens",
        (F.col("before_p3") + F.col("p3_tokens")).alias("total_tokens"),
        F.transform(written(3), lambda e: e["ref"]).alias("references"),
    )


def token_stats(segments: DataFrame) -> DataFrame:
    """Tokens of each priority and in all, from segments (query_id, priority, tokens)."""
    wide = segments.groupBy("query_id").pivot("priority", [0, 1, 2, 3]).agg(F.sum("tokens"))
    named = wide.select(
        "query_id",
        *[F.coalesce(F.col(str(p)), F.lit(0)).alias(f"p{p}_tokens") for p in range(4)],
    )
    total = sum((F.col(f"p{p}_tokens") for p in range(1, 4)), F.col("p0_tokens"))
    return named.withColumn("total_tokens", total)


def literature_segment(results: DataFrame, limit: int) -> DataFrame:
    """(query_id, content, tokens): long-form literature list with authors and article id."""
    column = {c: F.col(c) if c in results.columns else F.lit(None).cast("string")
              for c in ("authors", "pmid", "source_name")}
    numbered = top_k(results.drop("n"), limit + 1, ["query_id"], list_order(), "n")
    line = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("] **Title:** "),
        F.coalesce("title", F.lit("N/A")),
        F.lit("\n   **Authors:** "), F.coalesce(column["authors"], F.lit("N/A")), F.lit("\n"),
        F.coalesce(
            F.concat(F.lit("   **PMID:** "), F.nullif(column["pmid"], F.lit("")), F.lit("\n")),
            F.lit(""),
        ),
        F.lit("   **Source:** "), F.coalesce(column["source_name"], "source"),
        F.lit("\n   **Content:** "), F.substring("content", 1, 500), F.lit("...\n\n"),
    )
    rows = numbered.select("query_id", "n", line.alias("line")).withColumn(
        "cost", count_tokens("line")
    )
    packed = prefix_budget(rows, [F.asc("n")], "cost", limit).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows"),
        F.max("used").alias("tokens"),
    )
    totals = results.groupBy("query_id").agg(F.count("*").alias("total"))
    left = F.col("total") - F.coalesce(F.size("rows"), F.lit(0))
    mark = F.concat(F.lit("\n...(truncated, "), left.cast("string"), F.lit(" more references)"))
    body = F.coalesce(F.array_join(F.transform("rows", lambda r: r["line"]), ""), F.lit(""))
    return totals.join(packed, "query_id", "left").select(
        "query_id",
        F.concat(F.lit(LEAD_P3), body, F.when(left > 0, mark).otherwise("")).alias("content"),
        F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"),
    )
