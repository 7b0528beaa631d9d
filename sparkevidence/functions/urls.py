"""Identifiers, routing and link handling for URLs and raw pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, contains_any, first_match, squeeze

# Identifier patterns.
TRIAL_PATTERN = r"(?i)(NCT\d{8})"
PREPRINT_PATTERN = r"(10\.1101/(?:\d{4}\.\d{2}\.\d{2}\.)?\d+)"
ARTICLE_ID_PATTERNS = (
    r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)",
    r"(?i)ncbi\.nlm\.nih\.gov/pubmed/(\d+)",
    r"(?i)/pubmed/(\d+)",
    r"(?i)PMID[:\s]+(\d+)",
)
DOI_PATTERNS = (
    r'doi\.org/([\d\.]+/[^\s"<>]+)',
    r'/doi/([\d\.]+/[^\s"<>]+)',
    r'doi:([\d\.]+/[^\s"<>]+)',
)
NATURE_PATTERN = r"/articles/([sd]\d+)"
NATURE_PREFIX = "10.1038/"
ARCHIVE_PATTERN = r"(?i)(PMC\d+)"
HREF_PATTERN = "href=[\"']([^\"']+)[\"']"

# Phrases that mark a page behind a paywall.
PAYWALL_PHRASES = (
    "subscription required", "access denied", "login required", "purchase access",
    "institutional access", "paywall", "this article is part of the", "subscribe to view",
)


def trial_id(url: Column | str) -> Column:
    return F.upper(first_match(url, TRIAL_PATTERN))


def preprint_doi(url: Column | str) -> Column:
    c = as_col(url)
    on_server = contains_any(c, ("biorxiv.org", "medrxiv.org"))
    return F.when(on_server, first_match(c, PREPRINT_PATTERN))


def article_id(url: Column | str) -> Column:
    return F.coalesce(*[first_match(url, p) for p in ARTICLE_ID_PATTERNS])


def archive_id(url: Column | str) -> Column:
    return F.upper(first_match(url, ARCHIVE_PATTERN))


def doi_of(url: Column | str) -> Column:
    nature = F.concat(F.lit(NATURE_PREFIX), first_match(url, NATURE_PATTERN))
    return F.coalesce(preprint_doi(url), *[first_match(url, p) for p in DOI_PATTERNS], nature)


def extract_ids(url: Column | str) -> Column:
    """All identifiers of a URL as one struct."""
    return F.struct(
        trial_id(url).alias("nct_id"),
        preprint_doi(url).alias("preprint_doi"),
        article_id(url).alias("pmid"),
        doi_of(url).alias("doi"),
        archive_id(url).alias("pmc_id"),
    )


def is_pdf_url(url: Column | str) -> Column:
    low = F.lower(as_col(url))
    return low.endswith(".pdf") | contains_any(low, ("/pdf/", "pdf.php"))


def is_pubmed_url(url: Column | str) -> Column:
    return contains_any(as_col(url), ("pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov/pubmed"))


def is_pmc_url(url: Column | str) -> Column:
    return contains_any(as_col(url), ("ncbi.nlm.nih.gov/pmc", "pmc.ncbi.nlm.nih.gov"))


def is_preprint_url(url: Column | str) -> Column:
    return contains_any(F.lower(as_col(url)), ("biorxiv.org", "medrxiv.org"))


def is_trial_url(url: Column | str) -> Column:
    return F.lower(as_col(url)).contains("clinicaltrials.gov")


def url_route(url: Column | str) -> Column:
    """Which kind of handling a URL gets: trial before preprint before pdf before web."""
    return (
        F.when(trial_id(url).isNotNull(), "trial")
        .when(preprint_doi(url).isNotNull(), "preprint")
        .when(is_pdf_url(url), "pdf")
        .otherwise("web")
    )


def preprint_pdf_url(url: Column | str) -> Column:
    bare = F.regexp_replace(F.rtrim(as_col(url), F.lit("/")), r"v\d+$", "")
    return F.when(
        bare.contains("/content/"),
        F.when(bare.endswith(".pdf"), bare).otherwise(F.concat(bare, F.lit(".full.pdf"))),
    )


def detect_paywall(html: Column | str) -> Column:
    return contains_any(F.lower(as_col(html)), PAYWALL_PHRASES)


def _drop_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    directory = last.isin(".", "..")
    kept = F.aggregate(
        F.filter(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: p != "."),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(
        directory & ~joined.endswith("/"), F.concat(joined, F.lit("/"))
    ).otherwise(joined)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on the page ``base``."""
    b, h = as_col(base), as_col(href)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(b, r"^([^#]*)", 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path = F.regexp_extract(h, r"^([^?#]*)", 1)
    tail = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("#"), F.concat(base_query, h))
        .when(h.startswith("?"), F.concat(root, base_path, h))
        .when(h.startswith("/"), F.concat(root, _drop_dot_segments(path), tail))
        .otherwise(F.concat(root, _drop_dot_segments(F.concat(folder, path)), tail))
    )


def page_links(html: Column | str, base: Column | str, pattern: str | None = None) -> Column:
    """Distinct absolute http links of a page."""
    found = F.array_distinct(F.regexp_extract_all(as_col(html), F.lit(HREF_PATTERN), F.lit(1)))
    absolute = F.transform(found, lambda h: resolve_url(base, h))
    kept = F.filter(absolute, lambda u: u.startswith("http"))
    if pattern is not None:
        kept = F.filter(kept, lambda u: u.rlike(pattern))
    return F.array_distinct(kept)


# Page parts that are not body text.
BOILERPLATE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")


def main_text(html: Column | str) -> Column:
    """Body text of a page: boilerplate parts and tags removed, whitespace squeezed."""
    out = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", " ")
    for tag in (*BOILERPLATE_TAGS, "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, plain in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return squeeze(out)


def page_outcome(html: Column | str, text: Column | str, min_length: int = 200) -> Column:
    """NULL when the page is kept, else the reason it is not."""
    return F.when(detect_paywall(html), "paywall").when(
        F.length(as_col(text)) < min_length, "content_too_short"
    )


def clean_title(title: Column | str) -> Column:
    return squeeze(F.regexp_replace(as_col(title), r"[:\[\](){}]", " "))


def loose_title(title: Column | str) -> Column:
    """Strong clean-up for titles from sharing sites: article, verb tail and small words go."""
    out = F.regexp_replace(as_col(title), r"(?i)^(The|A|An)\s+", "")
    out = F.regexp_replace(out, r"(?i)\s+(is|are|reveals?|shows?)\s+.+$", "")
    out = F.regexp_replace(out, r"(?i)\s+(via|through|by|in|of|and)\s+", " ")
    return squeeze(F.substring(out, 1, 100))


def extract_date(text: Column | str) -> Column:
    """First date found, by five patterns in order of trust."""
    c = as_col(text)
    months = (
        "January|February|March|April|May|June|July|August|September|October|November|December"
    )

    def groups(pattern: str, n: int) -> Column:
        parts = [F.regexp_extract(c, pattern, i) for i in range(1, n + 1)]
        return F.nullif(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " "), F.lit(""))

    return F.coalesce(
        groups(rf"(?iU)\b({months})\s+(\d{{1,2}}),?\s+(20\d{{2}})\b", 3),
        groups(rf"(?iU)\b(\d{{1,2}})\s+({months})\s+(20\d{{2}})\b", 3),
        groups(r"(?U)\b(20\d{2})[-/](0?\d|1[0-2])[-/](0?\d|[12]\d|3[01])\b", 3),
        groups(r"(?i)Published:\s*(20\d{2})", 1),
        groups(r"(?U)\b(20\d{2})\b", 1),
    )
