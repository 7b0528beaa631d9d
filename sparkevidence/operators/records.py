"""Resolving and filtering stored records: articles, preprints, trials and web hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.render import format_web_chunk, web_chunk_source
from ..functions.urls import archive_id, article_id, clean_title, doi_of, loose_title
from .scale import broadcast_if_small
from .topk import top_k

# Ways of finding an article, most trusted first.
METHODS = ("URL_EXTRACTION", "TITLE_EXACT", "TITLE_FUZZY", "DOI_SEARCH", "RESEARCHGATE_CLEANUP")


def _attempt(step: int, kind: str, key: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.lower(key).alias("lookup")
    )


def resolve_records(
    requests: DataFrame, articles: DataFrame, archive: DataFrame | None = None
) -> DataFrame:
    """(request_id, pmid, method): the article each request (request_id, url, title) stands for.

    All attempts of a request become rows and meet one lookup table in a single join; the most
    trusted hit wins. The lookup table has one row for each key, so copies of an article cannot
    multiply requests. ``archive`` maps (pmc_id, pmid).
    """
    title = F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit(""))
    cleaned = clean_title(title)
    shared_site = F.lower("url").contains("researchgate")
    attempts = requests.select(
        "request_id",
        F.explode(
            F.array(
                _attempt(1, "pmid", article_id("url")),
                _attempt(1, "pmc", archive_id("url")),
                _attempt(2, "title", title),
                _attempt(3, "clean", F.when(cleaned != title, cleaned)),
                _attempt(4, "doi", doi_of("url")),
                _attempt(5, "loose", F.when(shared_site, loose_title(title))),
            )
        ).alias("a"),
    ).select("request_id", "a.step", "a.kind", "a.lookup").where(F.col("lookup").isNotNull())
    keys = articles.select(
        "pmid",
        F.explode(
            F.array(
                _attempt(0, "title", F.trim("title")),
                _attempt(0, "clean", clean_title("title")),
                _attempt(0, "doi", F.col("doi")),
                _attempt(0, "loose", loose_title("title")),
            )
        ).alias("a"),
    ).select("pmid", "a.kind", "a.lookup")
    if archive is not None:
        keys = keys.unionByName(
            archive.select("pmid", F.lit("pmc").alias("kind"), F.lower("pmc_id").alias("lookup"))
        )
    table = (
        keys.where(F.coalesce("lookup", F.lit("")) != "")
        .groupBy("kind", "lookup")
        .agg(F.min("pmid").alias("pmid"))
    )
    by_url = attempts.where(F.col("kind") == "pmid").select(
        "request_id", "step", F.col("lookup").alias("pmid")
    )
    by_table = attempts.where(F.col("kind") != "pmid").join(table, ["kind", "lookup"]).select(
        "request_id", "step", "pmid"
    )
    best = by_url.unionByName(by_table).groupBy("request_id").agg(
        F.min(F.struct("step", "pmid")).alias("best")
    )
    names = F.array(*[F.lit(m) for m in METHODS])
    return requests.select("request_id").join(best, "request_id", "left").select(
        "request_id",
        F.col("best.pmid").alias("pmid"),
        F.when(F.col("best").isNotNull(), F.element_at(names, F.col("best.step"))).alias("method"),
    )


def latest_versions(preprints: DataFrame) -> DataFrame:
    """The newest version of each preprint."""
    number = F.col("version").try_cast("int")
    return top_k(preprints, 1, ["doi"], [F.desc(number), F.desc("date")], "_n").drop("_n")


def published_versions(preprints: DataFrame, articles: DataFrame) -> DataFrame:
    """(doi, pmid) of preprints that have an article under their DOI."""
    known = articles.where(F.col("doi").isNotNull()).groupBy(F.lower("doi").alias("_doi")).agg(
        F.min("pmid").alias("pmid")
    )
    dois = preprints.select("doi").distinct().withColumn("_doi", F.lower("doi"))
    return dois.join(known, "_doi", "left").select("doi", "pmid")


def has_all_terms(text: Column, query: str) -> Column:
    """Whether every blank-separated word of the question occurs in the text, case ignored."""
    low = F.lower(text)
    out = F.lit(True)
    for term in query.lower().split():
        out = out & low.contains(term)
    return out


def search_preprints(
    preprints: DataFrame, query: str, start: str | None = None, end: str | None = None,
    limit: int = 10,
) -> DataFrame:
    """Preprints in a date range that hold all words in title or abstract, in date order."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    rows = preprints.where(has_all_terms(text, query))
    if start is not None:
        rows = rows.where(F.col("date") >= start)
    if end is not None:
        rows = rows.where(F.col("date") <= end)
    return rows.orderBy("date", "doi").limit(limit)


def filter_trials(
    trials: DataFrame, query: str | None = None, condition: str | None = None,
    intervention: str | None = None, status: str | None = None, phase: str | None = None,
    limit: int = 10,
) -> DataFrame:
    """Trials (a ``trial`` struct) that meet all given facets."""
    t = F.col("trial")

    def mentions(values: Column, wanted: str) -> Column:
        return F.exists(values, lambda v: F.lower(v).contains(wanted.lower()))

    rows = trials
    if query:
        rows = rows.where(
            has_all_terms(F.concat_ws(" ", t["title"], t["brief_summary"]), query)
        )
    if condition:
        rows = rows.where(mentions(t["conditions"], condition))
    if intervention:
        rows = rows.where(
            mentions(F.transform(t["interventions"], lambda i: i["name"]), intervention)
        )
    if status:
        rows = rows.where(F.upper(t["status"]) == status.upper())
    if phase:
        rows = rows.where(F.array_contains(F.split(F.upper(t["phase"]), ", "), phase.upper()))
    return rows.orderBy(t["nct_id"]).limit(limit)


def web_candidates(hits: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Web hits of each question as results, with the stored page text when there is one.

    ``hits`` is (query_id, pos, title, link, snippet, date), ``pages`` is (link, text). A link
    counts once for a question and at most twenty links are used.
    """
    usable = hits.where(F.coalesce(F.trim("link"), F.lit("")) != "").withColumn(
        "link", F.trim("link")
    )
    first = top_k(usable, 1, ["query_id", "link"], [F.asc("pos")], "_n").drop("_n")
    kept = top_k(first, settings.max_web_hits, ["query_id"], [F.asc("pos")], "_n").drop("_n")
    # only pages that were hit are read on; there are at most twenty for each question
    links = broadcast_if_small(kept.select("link").distinct())
    texts = pages.join(links, "link", "left_semi").groupBy("link").agg(F.max("text").alias("text"))
    content = format_web_chunk("title", "date", "link", "text", "snippet")
    return (
        kept.join(texts, "link", "left")
        .withColumn("content", content)
        .where(F.col("content").isNotNull())
        .select(
            "query_id", "pos", "content", "title", F.col("title").alias("paper_title"), "link",
            F.col("link").alias("url"), "snippet",
            F.coalesce(F.nullif(F.trim("date"), F.lit("")), F.lit("Unknown Date")).alias("date"),
            F.lit("web_search").alias("source_name"),
            F.lit(True).alias("is_web"),
            F.array().cast("array<string>").alias("key_genes"),
            F.lit(0.0).alias("score"),
            web_chunk_source("content").alias("source"),
        )
    )
