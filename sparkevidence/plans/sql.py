"""SQL building blocks for the comparison queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import KEYWORDS, NOT_GENE_TOKENS, NOT_GENES

WORD = r"[\p{L}\p{M}\p{N}_]"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def symbols(text: str, blacklist=NOT_GENES) -> str:
    """Symbol-like words of the upper-cased text, repeats kept."""
    return (
        f"list_filter(string_split_regex(upper(replace({text}, 'ß', 'ss')), '[^A-Z0-9]+'), "
        f"lambda t: regexp_full_match(t, '[A-Z][A-Z0-9]{{1,9}}') "
        f"and not list_contains({_list(blacklist)}, t))"
    )


def genes(text: str) -> str:
    return f"list_distinct({symbols(text)})"


def first_genes(text: str, n: int) -> str:
    """First distinct symbols in reading order, as a subquery over positions."""
    return (
        f"(select list(g order by p) from (select g, min(p) as p from (select unnest(gs) as g, "
        f"generate_subscripts(gs, 1) as p from (select {symbols(text)} as gs)) group by g "
        f"order by min(p) limit {n}))"
    )


def tokens(text: str) -> str:
    return (
        f"list_distinct(list_concat({symbols(text, NOT_GENE_TOKENS)}, "
        f"regexp_extract_all(lower({text}), '{WORD}+')))"
    )


def hyphen_tokens(text: str) -> str:
    inner = r"\p{L}\p{M}\p{N}_"
    return (
        f"flatten(list_transform(regexp_extract_all({text}, "
        f"'[{inner}](?:[{inner}-]*[{inner}])?'), "
        f"lambda w: case when regexp_full_match(w, '[A-Z][A-Z0-9-]{{1,10}}') "
        f"then [w, lower(w)] else [lower(w)] end))"
    )


def keywords(text: str) -> str:
    return f"list_filter({_list(KEYWORDS)}, lambda k: contains(lower({text}), k))"


def sentences(text: str) -> str:
    """Sentences of more than five characters."""
    return (
        f"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\\s+', "
        f"'\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), "
        f"lambda s: length(s) > 5)"
    )


BENCHMARK = "select item_id as query_id, text as query from benchmark"
TURNS = (
    "select conv_id * 1000 + turn as query_id, conv_id as group_id, turn as query_pos, "
    "text as query from conversations where role = 'user'"
)
DOCUMENTS = "select doc_id, text as content from documents"


def bm25(queries: str, docs: str = DOCUMENTS, k: int = 10, tokenizer=tokens, name: str = "hits") -> str:
    """CTEs ending in ``name`` (query_id, doc_id, score, rank)."""
    return f"""
    b_q as ({queries}), b_d as ({docs}),
    b_toks as (select doc_id, {tokenizer('content')} as toks from b_d),
    b_len as (select doc_id, len(toks) as n from b_toks),
    b_tf as (select doc_id, term, count(*) as tf
             from (select doc_id, unnest(toks) as term from b_toks) group by all),
    b_n as (select count(*) as n_docs, avg(n) as avg_len from b_len),
    b_df as (select term, count(*) as df from b_tf group by term),
    b_raw as (select term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) as idf from b_df, b_n),
    b_idf as (select term, case when idf < 0 then 0.25 * (select avg(idf) from b_raw)
              else idf end as idf from b_raw),
    b_qt as (select query_id, term, count(*) as qtf
             from (select query_id, unnest({tokenizer('query')}) as term from b_q) group by all),
    b_s as (select query_id, doc_id, round(sum(idf * qtf * tf * 2.5
              / (tf + 1.5 * (0.25 + 0.75 * n / avg_len))), 6) as score
            from b_qt join b_idf using (term) join b_tf using (term)
              join b_len using (doc_id), b_n group by all),
    {name} as (select * from (select query_id, doc_id, score, row_number() over
              (partition by query_id order by score desc, doc_id) as rank
            from b_s where score > 0) where rank <= {k})"""


def dense(k: int, name: str = "near") -> str:
    """CTEs ending in ``name`` for the questions that have a vector."""
    return f"""
    v_s as (select q.vec_id as query_id, d.vec_id as doc_id,
              round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) as score
            from embeddings q join benchmark b on q.vec_id = b.item_id, embeddings d),
    {name} as (select * from (select query_id, doc_id, score, row_number() over
              (partition by query_id order by score desc, doc_id) as rank from v_s)
            where rank <= {k})"""


def hybrid(k: int, name: str = "fused") -> str:
    """CTEs ending in ``name`` (query_id, key, doc_id, source, score, rank)."""
    return f"""{dense(2 * k)}, {bm25(BENCHMARK, k=2 * k)},
    f_legs as (
      select query_id, doc_id, rank, rank as pos, 'local_dense' as source from near
      union all
      select query_id, doc_id, rank, 10000000 + rank, 'bm25' from hits),
    f_keys as (select l.*, sha256(d.text) as key from f_legs l join documents d using (doc_id)),
    f_sum as (select query_id, key, round(sum(1.0::double / (60 + rank)), 10) as score,
                arg_min(doc_id, pos) as doc_id, arg_min(source, pos) as source
              from f_keys group by query_id, key),
    {name} as (select * from (select *, row_number() over
                 (partition by query_id order by score desc, doc_id) as rank from f_sum)
               where rank <= {k})"""


MATRIX = """
    matrix as (select 'G' || (l_partkey % 100) as gene, 'S' || l_suppkey as cell_line,
                 round(avg((0.05 - l_discount) / 0.05), 6) as score
               from lineitem group by all)"""
CELL_LINES = """
    cell_lines as (select 'S' || s_suppkey as cell_line, r_name as cancer_type
                   from supplier join nation on s_nationkey = n_nationkey
                     join region on n_regionkey = r_regionkey where s_acctbal >= 0)"""
SUMMARY = """
    summary as (select gene, avg(score) as mean_score, min(score) as min_score,
                  max(score) as max_score, count(*) filter (score < -0.5) as essential_count,
                  count(*) filter (score < -0.5) / count(*) * 100 as essential_pct,
                  count(*) as total_cell_lines
                from matrix group by gene)"""
HISTOGRAM = """
    histogram as (select gene, coalesce(cancer_type, 'Unknown') as cancer_type, count(*) as n
                  from matrix left join cell_lines using (cell_line)
                  where score < -0.5 group by all)"""


def pairs(apart: int = 1, name: str = "pairs") -> str:
    return f"""
    {name} as (select 'G' || (a.l_partkey % 100) as gene_a, 'G' || (b.l_partkey % 100) as gene_b,
                 o_orderpriority as evidence_source, o_orderkey::varchar as pubmed_id,
                 case when o_orderstatus = 'F' then 'Gold' else 'Silver' end as benchmark_level,
                 o_orderkey * 10 + a.l_linenumber as pair_pos
               from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
                 join orders on a.l_orderkey = o_orderkey
               where b.l_linenumber = a.l_linenumber + {apart}
                 and a.l_partkey % 100 <> b.l_partkey % 100)"""


CLOSURE = """
    closure as (select gene_a, gene_b from pairs union select gene_b, gene_a from pairs)"""
ORIENTED = """
    oriented as (select gene_a as gene, gene_b as partner, * exclude (gene_a, gene_b) from pairs
                 union all
                 select gene_b, gene_a, * exclude (gene_a, gene_b) from pairs)"""

PLACES = """
    places as (
      select upper(s_name) as x_name, 'Supplier' as x_type, 'located_in' as relation,
        'located in' as display_relation, upper(n_name) as y_name, 'Nation' as y_type,
        'registry' as rel_source
      from supplier join nation on s_nationkey = n_nationkey
      union all
      select upper(c_name), 'Customer', 'located_in', 'located in', upper(n_name), 'Nation',
        'registry'
      from customer join nation on c_nationkey = n_nationkey
      union all
      select upper(n_name), 'Nation', 'part_of', 'part of', upper(r_name), 'Region', 'atlas'
      from nation join region on n_regionkey = r_regionkey)"""
TRIPLES = PLACES + """,
    triples as (
      select upper(c_name) as x_name, 'Customer' as x_type, 'ordered' as relation,
        'ordered' as display_relation, 'PART#' || l_partkey as y_name, 'Part' as y_type,
        'orders' as rel_source
      from (select distinct o_custkey, l_partkey from lineitem join orders
            on l_orderkey = o_orderkey) join customer on o_custkey = c_custkey
      union all
      select 'PART#' || l_partkey, 'Part', 'supplied_by', 'supplied by', upper(s_name),
        'Supplier', 'lineitem'
      from (select distinct l_partkey, l_suppkey from lineitem) join supplier
        on l_suppkey = s_suppkey
      union all select * from places)"""


def decimals(x: str, digits: int) -> str:
    """Text with fixed decimals, from a number known to nine places."""
    return f"(round({x}::decimal(20,9), {digits})::decimal(20,{digits}))::varchar"
