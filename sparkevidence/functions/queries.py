"""Building search questions and reading lists of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, strip
from .text import raw_symbols

# Recency words, and the sites a literature search is restricted to.
RECENT_PATTERN = (
    r"(?iU)\b(latest|recent|newest|current|up[-\s]?to[-\s]?date|202[0-9])\b|最新|近期|最近"
)
LITERATURE_SITES = (
    "ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "nature.com", "cell.com",
    "sciencedirect.com", "biorxiv.org", "medrxiv.org",
)
LETHALITY_PHRASES = '"synthetic lethality" OR "synthetic lethal"'


def is_recent_query(query: Column | str) -> Column:
    return F.coalesce(as_col(query).rlike(RECENT_PATTERN), F.lit(False))


def _any_of(names: Column | str, limit: int = 3) -> Column:
    """``("a" OR "b")`` over the first names; NULL for an empty list."""
    quoted = F.transform(
        F.slice(as_col(names), 1, limit), lambda n: F.concat(F.lit('"'), n, F.lit('"'))
    )
    return F.when(
        F.size(as_col(names)) > 0,
        F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")),
    )


def compose_search(
    query: Column | str, genes: Column | str | None = None, drugs: Column | str | None = None
) -> Column:
    """Literature search string: question, gene group, drug group, site restriction."""
    sites = " OR ".join(f"site:{s}" for s in LITERATURE_SITES)
    parts = [as_col(query)]
    parts += [_any_of(names) for names in (genes, drugs) if names is not None]
    return F.concat_ws(" ", *parts, F.lit(f"({sites})"))


def _quoted(value: Column | str) -> Column:
    c = F.nullif(as_col(value), F.lit(""))
    return F.concat(F.lit('"'), c, F.lit('"'))


def compose_lethality_search(
    gene: Column | str, partner: Column | str, context: Column | str
) -> Column:
    text = F.concat_ws(
        " ", _quoted(gene), _quoted(partner), F.lit(LETHALITY_PHRASES), _quoted(context)
    )
    return compose_search(text)


def compose_drug_gene_search(drug: Column | str, gene: Column | str) -> Column:
    text = F.concat_ws(
        " ",
        _quoted(drug),
        _quoted(gene),
        F.lit("(inhibitor OR resistance OR sensitivity OR treatment)"),
    )
    return compose_search(text)


def boolean_expand(query: Column | str, alias_lists: Column | str) -> Column:
    """OR group over at most three names of each gene, AND the lethality phrases."""
    names = F.flatten(F.transform(as_col(alias_lists), lambda a: F.slice(a, 1, 3)))
    quoted = F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"')))
    expanded = F.concat(
        F.lit("("), F.array_join(quoted, " OR "), F.lit(f") AND ({LETHALITY_PHRASES})")
    )
    return F.when(F.size(names) > 0, expanded).otherwise(as_col(query))


def step_back_queries(query: Column | str) -> Column:
    """Three broader questions about the first symbol of the question."""
    found = F.get(raw_symbols(query), F.lit(0))
    gene = F.coalesce(found, F.lit("gene"))
    return F.array(
        F.concat(gene, F.lit(" pathway function mechanism")),
        F.concat(gene, F.lit(" paralog redundancy backup")),
        F.concat(gene, F.lit(" loss cellular stress phenotype")),
    )


def parse_query_lines(raw: Column | str) -> Column:
    """Questions of a stored list: numbering and bullets removed, headers dropped."""
    lines = F.transform(
        F.split(as_col(raw), "\n"),
        lambda s: F.regexp_replace(strip(s), r"(?U)^[\d.\-*\s]+", ""),
    )
    return F.filter(
        lines,
        lambda s: (s != "")
        & ~(s.startswith("#") | s.startswith("Example") | s.startswith("Output")),
    )
