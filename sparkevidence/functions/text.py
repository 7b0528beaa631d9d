"""Entity, token and sentence functions over free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, strip, text_array

# Symbol pattern and words that are never taken for a gene symbol.
GENE_PATTERN = r"(?:^|[^A-Z0-9])([A-Z][A-Z0-9]{1,9})(?=$|[^A-Z0-9])"
SYMBOL_PATTERN = r"(?U)\b[A-Z][A-Z0-9]{1,9}\b"
NOT_GENES = ("AND", "NOT", "THE", "FOR", "WITH", "FROM", "OR")
NOT_GENE_TOKENS = ("AND", "NOT", "THE", "FOR", "WITH", "FROM")
NOT_GENES_SHORT = ("AND", "NOT", "THE", "FOR")

# Topic phrases looked up in a question.
KEYWORDS = (
    "synthetic lethal", "synthetic lethality", "collateral lethality", "pathway",
    "inhibitor", "mutation", "expression", "screening", "crispr", "rnai", "knockdown",
    "cancer", "tumor", "therapy", "drug", "mechanism", "合成致死", "缺失", "抑制剂",
)

WORD_PATTERN = r"(?U)\w+"
HYPHEN_WORD_PATTERN = r"(?U)\b[\w-]+\b"
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def extract_genes(
    text: Column | str, blacklist: tuple[str, ...] = NOT_GENES, case_sensitive: bool = False
) -> Column:
    """Distinct symbol-like words. The text is upper-cased first unless ``case_sensitive``."""
    source = as_col(text) if case_sensitive else F.upper(as_col(text))
    found = F.regexp_extract_all(source, F.lit(GENE_PATTERN), F.lit(1))
    return F.array_except(found, text_array(blacklist))


def raw_symbols(text: Column | str) -> Column:
    """Symbol-like words in the text as written, in reading order, repeats kept."""
    return F.regexp_extract_all(as_col(text), F.lit(SYMBOL_PATTERN), F.lit(0))


def match_keywords(text: Column | str, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    lowered = F.lower(as_col(text))
    return F.filter(text_array(keywords), lambda k: F.contains(lowered, F.lower(k)))


def tokenize(text: Column | str, extra: Column | None = None) -> Column:
    """Distinct tokens: upper-case symbols and lower-case words (plus optional tagged spans)."""
    parts = [
        extract_genes(text, NOT_GENE_TOKENS),
        F.regexp_extract_all(F.lower(as_col(text)), F.lit(WORD_PATTERN), F.lit(0)),
    ]
    if extra is not None:
        parts.insert(1, F.coalesce(extra, F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def tokenize_hyphen(text: Column | str) -> Column:
    """Hyphen-aware tokens with repeats; all-capital symbols are kept in both cases."""
    words = F.regexp_extract_all(as_col(text), F.lit(HYPHEN_WORD_PATTERN), F.lit(0))
    return F.flatten(
        F.transform(
            words,
            lambda w: F.when(
                w.rlike(r"^[A-Z][A-Z0-9-]{1,10}$"), F.array(w, F.lower(w))
            ).otherwise(F.array(F.lower(w))),
        )
    )


def split_sentences(text: Column | str, min_length: int = 5) -> Column:
    pieces = F.transform(F.split(as_col(text), SENTENCE_BREAK), strip)
    return F.filter(pieces, lambda s: F.length(s) > min_length)


def count_words(text: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(as_col(text), F.lit(r"(?U)\S+"))


def first_words(text: Column | str, n: Column | int) -> Column:
    """The first n whitespace-separated words joined by one blank."""
    limit = F.lit(n) if isinstance(n, int) else n
    words = F.regexp_extract_all(as_col(text), F.lit(r"(?U)\S+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), limit), " ")


def count_tokens(text: Column | str) -> Column:
    """Token estimate: one token for four characters, rounded down."""
    return F.floor(F.length(as_col(text)) / 4).cast("long")


def truncate_tokens(text: Column | str, n: int, from_end: bool = False) -> Column:
    chars = n * 4
    return F.right(as_col(text), F.lit(chars)) if from_end else F.substring(as_col(text), 1, chars)


def title_of(title: Column | str, paper_title: Column | str) -> Column:
    """A present but empty title hides the paper title; only a missing one falls through."""
    return F.coalesce(as_col(title), as_col(paper_title), F.lit(""))


def title_fingerprint(
    title: Column, link: Column, source: Column, content: Column
) -> Column:
    """Key shared by copies of one paper: cleaned title, else link, source or content digest."""
    clean = F.lower(F.regexp_replace(strip(title), r"(?U)[^\w\s]", ""))
    digest = F.substring(F.md5(F.substring(F.coalesce(content, F.lit("")), 1, 200)), 1, 16)
    return (
        F.when(F.length(clean) > 15, F.substring(clean, 1, 60))
        .when(F.coalesce(link, F.lit("")) != "", link)
        .when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("local_"), source))
        .otherwise(F.concat(F.lit("hash_"), digest))
    )


def content_key(content: Column | str) -> Column:
    """Key under which equal texts meet."""
    return F.sha2(as_col(content), 256)


def is_gene_like(name: Column | str) -> Column:
    """2 to 10 characters with at least one letter and no lower-case letter."""
    c = as_col(name)
    cased = (F.upper(c) == c) & (F.lower(c) != c)
    return F.length(c).between(2, 10) & cased
