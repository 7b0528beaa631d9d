"""Catalogue: entities, tokens, ranking, fusion, selection and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import (
    count_tokens,
    extract_genes,
    match_keywords,
    split_sentences,
    tokenize,
    tokenize_hyphen,
)
from ..operators import bm25, budget, compress, dense, entities, fusion, ranking
from ..operators.scale import cut_lineage
from . import sql, testbed
from .registry import query, shared

HYBRID_K = 20


def _index(spark, sf_dir, tokens=tokenize):
    return shared(
        spark, sf_dir, f"index:{tokens.__name__}",
        lambda: bm25.build_index(testbed.corpus(spark, sf_dir), tokens),
    )


def _keys(spark, sf_dir):
    """Content keys, stored beside the index."""
    return shared(
        spark, sf_dir, "content_keys",
        lambda: cut_lineage(fusion.content_keys(testbed.corpus(spark, sf_dir, testbed.texts))),
    )


def _sorted_text(column):
    return F.array_join(F.array_sort(column), " ")


@query("gene_extract", f"""
    select doc_id, len(g) as n_genes, array_to_string(list_sort(g), ' ') as genes
    from (select doc_id, {sql.genes('text')} as g from documents)""")
def gene_extract(spark, sf_dir):
    docs = testbed.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", extract_genes("text").alias("g")).select(
        "doc_id", F.size("g").cast("long").alias("n_genes"), _sorted_text("g").alias("genes")
    )


@query("keyword_match", f"""
    select doc_id, array_to_string({sql.keywords('text')}, '|') as keywords from documents""")
def keyword_match(spark, sf_dir):
    docs = testbed.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(match_keywords("text"), "|").alias("keywords"))


@query("query_entities", f"""
    select query_id, array_to_string(list_sort({sql.genes('query')}), ' ') as genes,
      '' as drugs, array_to_string(list_sort({sql.keywords('query')}), '|') as keywords
    from ({sql.TURNS})""")
def query_entities(spark, sf_dir):
    asked = entities.extract_entities(testbed.turns(spark, sf_dir))
    return asked.select(
        "query_id",
        F.array_join("genes", " ").alias("genes"),
        F.array_join("drugs", " ").alias("drugs"),
        F.array_join("keywords", "|").alias("keywords"),
    )


@query("span_entities", """
    with w as (select conv_id as query_id, unnest(string_split(text, ' ')) as word,
                 case when role = 'user' then 'Gene' else 'Drug' end as entity_group,
                 from conversations),
    u as (select query_id, replace(trim(word), '##', '') as word, entity_group from w)
    select query_id,
      coalesce(array_to_string(list_sort(list(distinct upper(replace(word, 'ß', 'ss')))
        filter (entity_group = 'Gene')), ' '), '') as genes,
      coalesce(array_to_string(list_sort(list(distinct word)
        filter (entity_group = 'Drug')), ' '), '') as drugs
    from u where length(word) > 1 group by query_id""")
def span_entities(spark, sf_dir):
    turns = testbed.table(spark, sf_dir, "conversations")
    spans = turns.select(
        F.col("conv_id").alias("query_id"),
        F.explode(F.split("text", " ")).alias("word"),
        F.when(F.col("role") == "user", "Gene").otherwise("Drug").alias("entity_group"),
        F.lit(1.0).alias("score"),
    )
    out = entities.spans_to_entities(spans)
    return out.select(
        "query_id", F.array_join("genes", " ").alias("genes"),
        F.array_join("drugs", " ").alias("drugs"),
    )


@query("token_stats", f"""
    select doc_id, len({sql.tokens('text')}) as n_terms, len({sql.hyphen_tokens('text')}) as n_words,
      len({sql.sentences('text')}) as n_sentences, length(text) // 4 as n_tokens
    from documents""")
def token_stats(spark, sf_dir):
    docs = testbed.texts(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.size(tokenize("text")).cast("long").alias("n_terms"),
        F.size(tokenize_hyphen("text")).cast("long").alias("n_words"),
        F.size(split_sentences("text")).cast("long").alias("n_sentences"),
        count_tokens("text").alias("n_tokens"),
    )


@query("bm25_index_stats", f"""
    with t as (select doc_id, {sql.tokens('text')} as toks from documents),
    df as (select term, count(*) as df from (select unnest(toks) as term from t) group by term),
    n as (select count(*) as n_docs, avg(len(toks)) as avg_length from t)
    select n_docs, count(*) as n_terms, max(df) as max_df, round(any_value(avg_length), 6) as avg_length,
      round(avg(ln(n_docs - df + 0.5) - ln(df + 0.5)), 6) as mean_idf
    from df, n group by n_docs""")
def bm25_index_stats(spark, sf_dir):
    stats = bm25.index_stats(bm25.build_index(testbed.corpus(spark, sf_dir)))
    return stats.select(
        "n_docs", "n_terms", "max_df", F.round("avg_length", 6).alias("avg_length"),
        F.round("mean_idf", 6).alias("mean_idf"),
    )


@query("bm25_topk", f"""
    with {sql.bm25(sql.BENCHMARK)} select query_id, doc_id, score, rank from hits""")
def bm25_topk(spark, sf_dir):
    return bm25.search(testbed.questions(spark, sf_dir), _index(spark, sf_dir), 10)


@query("bm25_hyphen_topk", f"""
    with {sql.bm25(sql.BENCHMARK, tokenizer=sql.hyphen_tokens)}
    select query_id, doc_id, score, rank from hits""")
def bm25_hyphen_topk(spark, sf_dir):
    index = _index(spark, sf_dir, tokenize_hyphen)
    return bm25.search(testbed.questions(spark, sf_dir), index, 10, tokens=tokenize_hyphen)


@query("dense_topk", f"""
    with {sql.dense(10)} select query_id, doc_id, score, rank from near""")
def dense_topk(spark, sf_dir):
    return dense.search(testbed.query_vectors(spark, sf_dir), testbed.vectors(spark, sf_dir), 10)


@query("dense_all_pairs", """
    with s as (select q.vec_id as query_id, d.vec_id as doc_id,
        round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) as score
      from embeddings q, embeddings d)
    select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)
      as rank from s) where rank <= 5""")
def dense_all_pairs(spark, sf_dir):
    """Every stored vector asked against all stored vectors."""
    stored = testbed.vectors(spark, sf_dir)
    return dense.search(stored.withColumnRenamed("vec_id", "query_id"), stored, 5)


def _hybrid(spark, sf_dir, k=HYBRID_K):
    return fusion.hybrid_search(
        testbed.questions(spark, sf_dir), testbed.corpus(spark, sf_dir), _index(spark, sf_dir),
        testbed.vectors(spark, sf_dir), testbed.query_vectors(spark, sf_dir), k,
        keys=_keys(spark, sf_dir),
    )


@query("rrf_hybrid", f"""
    with {sql.hybrid(HYBRID_K)}
    select query_id, doc_id, source, round(score, 6) as score, rank from fused""")
def rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir).select(
        "query_id", "doc_id", "source", F.round("score", 6).alias("score"), "rank"
    )


@query("multi_query_merge", f"""
    with {sql.bm25(sql.TURNS)},
    k as (select h.*, t.group_id, t.query_pos, sha256(d.text) as key
          from hits h join ({sql.TURNS}) t using (query_id) join documents d using (doc_id)),
    f as (select * from (select *, row_number() over (partition by group_id, key
            order by query_pos, rank, doc_id) as seen from k) where seen = 1)
    select group_id, doc_id, query_pos, score, pos as rank from (
      select *, row_number() over (partition by group_id
        order by score desc, query_pos, doc_id) as pos from f) where pos <= 20""")
def multi_query_merge(spark, sf_dir):
    """User turns of a conversation asked one by one and merged for the conversation."""
    turns = testbed.turns(spark, sf_dir)
    hits = bm25.search(turns.select("query_id", "query"), _index(spark, sf_dir), 10)
    keyed = fusion.with_content_keys(hits, _keys(spark, sf_dir))
    merged = fusion.merge_queries(
        keyed, turns.select("query_id", "group_id", F.col("query_pos").cast("long").alias("query_pos")),
        20,
    )
    return merged.select("group_id", "doc_id", "query_pos", "score", "rank")


def _hybrid_rows(spark, sf_dir):
    found = _hybrid(spark, sf_dir)
    asked = testbed.questions(spark, sf_dir)
    rows = fusion.fetch(found, testbed.corpus(spark, sf_dir), asked.count() * HYBRID_K)
    return rows.join(entities.extract_entities(asked), "query_id")


@query("entity_boost", f"""
    with {sql.hybrid(HYBRID_K)},
    q as (select query_id, {sql.genes('query')} as genes, {sql.keywords('query')} as kw
          from ({sql.BENCHMARK})),
    r as (select f.query_id, f.doc_id, f.score, q.genes, q.kw, d.lang, split_part(d.text, chr(10), 1) as title,
            {sql.first_genes('d.text', 3)} as key_genes
          from fused f join q using (query_id) join documents d using (doc_id)),
    b as (select query_id, doc_id, score, round(case when len(genes) = 0 and len(kw) = 0 then 0 else
            (case when contains(lower(title), 'collateral lethality')
               or contains(lower(title), 'synthetic lethal') then 0.3 else 0 end)
            + (case when coalesce(list_has_any(genes, key_genes), false) then 0.15 else 0 end)
            + (case when lang <> 'en' then 0.05 else 0 end) end, 6)::double as boost from r),
    s as (select query_id, doc_id, boost, round(score * (1 + boost), 10) as score from b)
    select query_id, doc_id, boost as entity_boost, round(score, 6) as score,
      row_number() over (partition by query_id order by s.score desc, doc_id) as rank from s""")
def entity_boost(spark, sf_dir):
    boosted = ranking.entity_boost(_hybrid_rows(spark, sf_dir))
    return boosted.select(
        "query_id", "doc_id", "entity_boost", F.round("score", 6).alias("score"), "rank"
    )


_FINGERPRINT = """
    case when length(clean) > 15 then left(clean, 60)
         when source <> '' then 'local_' || source
         else 'hash_' || left(md5(left(text, 200)), 16) end"""
_CLEAN = (
    "lower(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g'), "
    "'[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'))"
)


@query("title_fingerprint", f"""
    select doc_id, {_FINGERPRINT} as fingerprint
    from (select *, {_CLEAN} as clean from documents)""")
def title_fingerprint(spark, sf_dir):
    return ranking.with_fingerprint(testbed.corpus(spark, sf_dir, testbed.texts)).select("doc_id", "fingerprint")


_SCORED = f"""
    with {sql.hybrid(HYBRID_K)},
    c as (select f.query_id, f.doc_id, f.source as leg, d.source, d.text, q.query,
            {sql.tokens('q.query')} as qt, {sql.tokens('d.text')} as dt, {_CLEAN.replace('text', 'd.text')} as clean
          from fused f join documents d using (doc_id) join ({sql.BENCHMARK}) q using (query_id)),
    s as (select query_id, doc_id, {_FINGERPRINT} as fp, text,
            round(case when len(qt) > 0 then len(list_intersect(qt, dt)) / len(qt) else 0 end, 6) as score
          from c)"""


def _scored(spark, sf_dir):
    return ranking.pair_score(_hybrid_rows(spark, sf_dir))


@query("pair_scores", f"{_SCORED} select query_id, doc_id, score from s")
def pair_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", "doc_id", "score")


_DIVERSE = f"""{_SCORED},
    r as (select *, row_number() over (partition by query_id, fp order by score desc, doc_id) as rnd
          from s where score >= 0.3),
    g as (select *, first_value(score) over w as ps, first_value(doc_id) over w as pd from r
          where rnd <= 2 window w as (partition by query_id, fp order by rnd)),
    d as (select * from (select *, row_number() over (partition by query_id
            order by rnd, ps desc, pd) as rank from g) where rank <= 15)"""


def _diverse(spark, sf_dir):
    return ranking.diversify(ranking.with_fingerprint(_scored(spark, sf_dir)))


@query("diversify", f"{_DIVERSE} select query_id, doc_id, score, rank from d")
def diversify(spark, sf_dir):
    return _diverse(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


@query("unique_papers", f"""{_DIVERSE}
    select query_id, count(*) as chunks, count(distinct fp) as papers from d group by query_id""")
def unique_papers(spark, sf_dir):
    return ranking.unique_papers(_diverse(spark, sf_dir))


@query("evidence_gates", f"""{_DIVERSE},
    t as (select query_id, max(score) filter (rank <= 3) as quality,
            max(score) filter (rank = 1) as first_score from d group by query_id)
    select query_id, quality, coalesce(quality, 0) < 0.4 as is_weak,
      coalesce(first_score < 0.3, true) as no_evidence
    from ({sql.BENCHMARK}) left join t using (query_id)""")
def evidence_gates(spark, sf_dir):
    asked = testbed.questions(spark, sf_dir)
    chosen = cut_lineage(_diverse(spark, sf_dir))
    weak = ranking.weak_queries(asked, chosen).select("query_id", F.lit(True).alias("is_weak"))
    return (
        ranking.fallback_gate(asked, chosen)
        .join(ranking.quality(chosen), "query_id", "left")
        .join(weak, "query_id", "left")
        .select("query_id", "quality", F.coalesce("is_weak", F.lit(False)).alias("is_weak"), "no_evidence")
    )


@query("dedupe_first", """
    select min(doc_id) as doc_id, sha256(text) as key from documents group by text""")
def dedupe_first(spark, sf_dir):
    docs = testbed.corpus(spark, sf_dir).select("doc_id", "content")
    return fusion.dedupe_first(docs, [], ["doc_id"]).select(
        "doc_id", F.sha2("content", 256).alias("key")
    )


@query("logit_scores", """
    select event_id, round(exp(value / 100) / (exp(value / 100) + exp(user_id / 100)), 6) as score
    from events""")
def logit_scores(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        F.round(ranking.two_logit_score(F.col("value") / 100, F.col("user_id") / 100), 6).alias("score"),
    )


_CHUNKS = f"""
    with {sql.bm25(sql.BENCHMARK, k=5)},
    c as (select h.query_id, h.doc_id, q.query, d.text from hits h
          join ({sql.BENCHMARK}) q using (query_id) join documents d using (doc_id))"""


def _chunks(spark, sf_dir, k=5):
    asked = testbed.questions(spark, sf_dir)
    hits = bm25.search(asked, _index(spark, sf_dir), k)
    rows = fusion.fetch(hits, testbed.corpus(spark, sf_dir), asked.count() * k)
    return rows.join(asked, "query_id")


@query("sentence_filter", f"""{_CHUNKS},
    e as (select query_id, doc_id, text, {sql.tokens('query')} as qt, {sql.sentences('text')} as ss from c),
    x as (select query_id, doc_id, len(ss) as n, unnest(ss) as s, generate_subscripts(ss, 1) as i, qt from e),
    y as (select *, len(list_intersect(qt, {sql.tokens('s')})) / len(qt) as score from x),
    t as (select *, row_number() over (partition by query_id, doc_id order by score desc, i) as r from y),
    k as (select *, max(case when r <= least(n, greatest(1, floor(n * 0.6::double))) then 1 else 0 end) over
            (partition by query_id, doc_id order by i rows between 1 preceding and 1 following) as keep
          from t),
    j as (select query_id, doc_id, string_agg(s, ' ' order by i) as body from k
          where keep = 1 or n <= 3 group by all),
    w as (select query_id, doc_id, regexp_extract_all(body, '\\S+') as ws, body from j),
    z as (select e.query_id, e.doc_id, length(e.text) as original_length, w.body, w.ws,
            least(600, greatest(64, floor(greatest(1, len(regexp_extract_all(e.text, '\\S+'))) * 0.6::double)))::bigint as target
          from e join w using (query_id, doc_id))
    select query_id, doc_id, original_length, length(content) as compressed_length, md5(content) as digest
    from (select *, case when len(ws) > target then array_to_string(ws[1:target], ' ') else body end as content
          from z)""")
def sentence_filter(spark, sf_dir):
    out = compress.compress_sentence_filter(_chunks(spark, sf_dir))
    return out.select(
        "query_id", "doc_id", "original_length", "compressed_length",
        F.md5("content").alias("digest"),
    )


@query("extractive_compress")
def extractive_compress(spark, sf_dir):
    docs = testbed.corpus(spark, sf_dir, testbed.texts).select("doc_id", "content", "key_genes")
    out = compress.compress_extractive(docs, "key_genes")
    return out.select(
        "doc_id", "original_length", "compressed_length", F.md5("content").alias("digest")
    )


_PACK_K = 40
_ENTRY = f"""
    with {sql.bm25(sql.BENCHMARK, k=_PACK_K)},
    e as (select h.query_id, h.rank, h.score, d.text, split_part(d.text, chr(10), 1) as title,
            chr(10) || 'Source [' || h.rank || '] ' || (case when d.lang <> 'en' then '🌐 [WEB] ()' else '📄 [LOCAL]' end)
            || ' [Rel: ' || {sql.decimals('h.score', 3)} || ']' || chr(10) || 'Title: '
            || split_part(d.text, chr(10), 1) || chr(10)
            || (case when d.lang = 'en' and len({sql.first_genes('d.text', 3)}) > 0 then 'Key Genes: '
                || array_to_string({sql.first_genes('d.text', 3)}, ', ') || chr(10) else '' end)
            || 'Content: ' || d.text || chr(10) as entry
          from hits h join documents d using (doc_id)),
    u as (select *, sum(length(entry) // 4) over (partition by query_id order by rank) as used from e),
    p as (select query_id, count(*) as n_references, max(used) as p3_tokens,
            string_agg(entry, '' order by rank) as body from u where used <= 11000 group by query_id)"""


def _packed(spark, sf_dir):
    asked = testbed.questions(spark, sf_dir)
    hits = bm25.search(asked, _index(spark, sf_dir), _PACK_K)
    rows = fusion.fetch(hits, testbed.corpus(spark, sf_dir), asked.count() * _PACK_K)
    results = rows.withColumn("source", F.lit("bm25"))
    return budget.pack_context(hits, results, today="2025-01-01")


@query("pack_context", f"""{_ENTRY}
    select query_id, coalesce(p3_tokens, 0)::bigint as p3_tokens,
      (1000 + coalesce(p3_tokens, 0))::bigint as total_tokens, coalesce(n_references, 0) as n_references,
      md5('**Current Date:** 2025-01-01 (Use this to judge ''recent'' evidence)' || chr(10) || chr(10)
        || '=== [PRIORITY 3] Retrieved Scientific Literature ===' || chr(10) || coalesce(body, '')) as digest
    from (select distinct query_id from hits) left join p using (query_id)""")
def pack_context(spark, sf_dir):
    return _packed(spark, sf_dir).select(
        "query_id", "p3_tokens", "total_tokens",
        F.size("references").cast("long").alias("n_references"),
        F.md5("context").alias("digest"),
    )


@query("packed_references", f"""{_ENTRY}
    select query_id, rank as id, title, round(score, 6) as score,
      length(case when length(text) > 10000 then left(text, 10000) || '...' else text end) as n_chars
    from u where used <= 11000""")
def packed_references(spark, sf_dir):
    refs = _packed(spark, sf_dir).select("query_id", F.explode("references").alias("r"))
    return refs.select(
        "query_id", F.col("r.id").cast("long").alias("id"), "r.title",
        F.round("r.score", 6).alias("score"), F.length("r.content").cast("long").alias("n_chars"),
    )


@query("format_references", f"""
    with {sql.bm25(sql.BENCHMARK)}
    select query_id, rank as id, split_part(text, chr(10), 1) as title, round(score, 3) as score,
      md5(case when length(text) > 10000 then left(text, 10000) || '...' else text end) as digest, '' as link
    from hits join documents using (doc_id)""")
def format_references(spark, sf_dir):
    asked = testbed.questions(spark, sf_dir)
    hits = bm25.search(asked, _index(spark, sf_dir), 10)
    rows = fusion.fetch(hits, testbed.corpus(spark, sf_dir), asked.count() * 10)
    refs = budget.format_references(rows)
    return refs.select(
        "query_id", F.col("id").cast("long").alias("id"), "title", "score",
        F.md5("content").alias("digest"), "link",
    )


@query("segment_tokens", """
    select conv_id as query_id,
      coalesce(sum(length(text) // 4) filter (turn % 4 = 0), 0)::bigint as p0_tokens,
      coalesce(sum(length(text) // 4) filter (turn % 4 = 1), 0)::bigint as p1_tokens,
      coalesce(sum(length(text) // 4) filter (turn % 4 = 2), 0)::bigint as p2_tokens,
      coalesce(sum(length(text) // 4) filter (turn % 4 = 3), 0)::bigint as p3_tokens,
      sum(length(text) // 4)::bigint as total_tokens
    from conversations group by conv_id""")
def segment_tokens(spark, sf_dir):
    turns = testbed.table(spark, sf_dir, "conversations")
    segments = turns.select(
        F.col("conv_id").alias("query_id"), (F.col("turn") % 4).cast("int").alias("priority"),
        count_tokens("text").alias("tokens"),
    )
    return budget.token_stats(segments)


@query("prefix_budget", """
    with u as (select *, sum(length(text) // 4) over (partition by conv_id order by turn) as used
               from conversations)
    select conv_id, count(*) as kept, max(used)::bigint as tokens from u where used <= 200 group by conv_id""")
def prefix_budget(spark, sf_dir):
    turns = testbed.table(spark, sf_dir, "conversations").withColumn("cost", count_tokens("text"))
    kept = budget.prefix_budget(turns, [F.asc("turn")], "cost", 200, ("conv_id",))
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.max("used").alias("tokens"))


@query("embed_corpus")
def embed_corpus(spark, sf_dir):
    made = dense.embed_corpus(testbed.corpus(spark, sf_dir, testbed.texts))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return made.select("vec_id", F.size("embedding").alias("dims"), F.round(size, 4).alias("norm"))
