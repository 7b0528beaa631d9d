"""Catalogue: pages, links, stored records, stored model outputs and benchmark scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outputs, queries, render, text, trim, urls
from ..operators import entities, evaluate, records
from . import sql, testbed
from .registry import query

# ---------------------------------------------------------------- pages


@query("page_links", """
    with l as (select page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1))) as h from pages),
    a as (select page_id, case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then h
        when starts_with(h, '/') then regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h
        else regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || h end as link from l)
    select distinct page_id, link from a where starts_with(link, 'http')""")
def page_links(spark, sf_dir):
    pages = testbed.texts(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(urls.page_links("html", "url")).alias("link"))


# Every page address with one of eight kinds of record address made from it.
_ADDRESS = """
    select page_id, case page_id % 8
        when 0 then 'https://clinicaltrials.gov/study/nct' || lpad((page_id + 1000)::varchar, 8, '0')
        when 1 then 'https://www.biorxiv.org/content/10.1101/2020.01.14.' || (900000 + page_id) || 'v2'
        when 2 then 'https://pubmed.ncbi.nlm.nih.gov/' || (page_id + 30000000) || '/'
        when 3 then 'https://www.nature.com/articles/s' || (page_id + 41586) || '-021'
        when 4 then 'https://doi.org/10.1016/j.cell.' || page_id || '?x=' || url
        when 5 then 'https://pmc.ncbi.nlm.nih.gov/articles/pmc' || (page_id + 7000000) || '/pdf/main.pdf'
        when 6 then url || '?ref=PMID: ' || (page_id + 100)
        else url end as url
    from pages"""


def _addresses(spark, sf_dir):
    pages = testbed.table(spark, sf_dir, "pages")
    n, kind = F.col("page_id"), F.col("page_id") % 8

    def num(c):
        return c.cast("string")

    made = (
        F.when(kind == 0, F.concat(
            F.lit("https://clinicaltrials.gov/study/nct"), F.lpad(num(n + 1000), 8, "0")))
        .when(kind == 1, F.concat(
            F.lit("https://www.biorxiv.org/content/10.1101/2020.01.14."), num(n + 900000), F.lit("v2")))
        .when(kind == 2, F.concat(
            F.lit("https://pubmed.ncbi.nlm.nih.gov/"), num(n + 30000000), F.lit("/")))
        .when(kind == 3, F.concat(
            F.lit("https://www.nature.com/articles/s"), num(n + 41586), F.lit("-021")))
        .when(kind == 4, F.concat(
            F.lit("https://doi.org/10.1016/j.cell."), num(n), F.lit("?x="), "url"))
        .when(kind == 5, F.concat(
            F.lit("https://pmc.ncbi.nlm.nih.gov/articles/pmc"), num(n + 7000000), F.lit("/pdf/main.pdf")))
        .when(kind == 6, F.concat("url", F.lit("?ref=PMID: "), num(n + 100)))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", made.alias("url"))


@query("page_url_ids", f"""
    select page_id,
      nullif(upper(regexp_extract(url, '(?i)(NCT\\d{{8}})', 1)), '') as nct_id,
      case when contains(url, 'biorxiv.org') or contains(url, 'medrxiv.org')
        then nullif(regexp_extract(url, '(10\\.1101/(?:\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}\\.)?\\d+)', 1), '') end as preprint_doi,
      nullif(coalesce(nullif(regexp_extract(url, '(?i)pubmed\\.ncbi\\.nlm\\.nih\\.gov/(\\d+)', 1), ''),
        regexp_extract(url, '(?i)PMID[:\\s]+(\\d+)', 1)), '') as pmid,
      coalesce(nullif(regexp_extract(url, '(10\\.1101/(?:\\d{{4}}\\.\\d{{2}}\\.\\d{{2}}\\.)?\\d+)', 1), ''),
        nullif(regexp_extract(url, 'doi\\.org/([\\d\\.]+/[^\\s"<>]+)', 1), ''),
        '10.1038/' || nullif(regexp_extract(url, '/articles/([sd]\\d+)', 1), '')) as doi,
      nullif(upper(regexp_extract(url, '(?i)(PMC\\d+)', 1)), '') as pmc_id
    from ({_ADDRESS})""")
def page_url_ids(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.extract_ids("url").alias("i")).select(
        "page_id", "i.*"
    )


@query("page_routes", f"""
    select page_id, case when regexp_matches(url, '(?i)NCT\\d{{8}}') then 'trial'
        when contains(url, 'biorxiv.org') then 'preprint'
        when ends_with(lower(url), '.pdf') or contains(lower(url), '/pdf/') then 'pdf' else 'web' end as route,
      contains(url, 'pubmed.ncbi.nlm.nih.gov') as is_pubmed, contains(url, 'pmc.ncbi.nlm.nih.gov') as is_pmc,
      contains(url, 'biorxiv.org') as is_preprint, contains(url, 'clinicaltrials.gov') as is_trial,
      case when contains(url, '/content/') then regexp_replace(url, 'v\\d+$', '') || '.full.pdf' end as pdf_url
    from ({_ADDRESS})""")
def page_routes(spark, sf_dir):
    return _addresses(spark, sf_dir).select(
        "page_id", urls.url_route("url").alias("route"),
        urls.is_pubmed_url("url").alias("is_pubmed"), urls.is_pmc_url("url").alias("is_pmc"),
        urls.is_preprint_url("url").alias("is_preprint"), urls.is_trial_url("url").alias("is_trial"),
        urls.preprint_pdf_url("url").alias("pdf_url"),
    )


def _main_text_sql() -> str:
    out = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
    for tag in (*urls.BOILERPLATE_TAGS, "head"):
        out = f"regexp_replace({out}, '<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'gsi')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'gs')"
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{plain}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_MAIN = f"select page_id, html, {_main_text_sql()} as body from pages"


@query("page_text", f"""
    select page_id, md5(body) as digest, length(body) as n_chars,
      case when {' or '.join(f"contains(lower(html), '{p}')" for p in urls.PAYWALL_PHRASES)} then 'paywall'
        when length(body) < 200 then 'content_too_short' end as reason
    from ({_MAIN})""")
def page_text(spark, sf_dir):
    pages = testbed.texts(spark, sf_dir, "pages").withColumn("body", urls.main_text("html"))
    return pages.select(
        "page_id", F.md5("body").alias("digest"), F.length("body").alias("n_chars"),
        urls.page_outcome("html", "body").alias("reason"),
    )


_DATED = """
    select o_orderkey, case o_orderkey % 5
      when 0 then 'Posted ' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) || '.'
      when 1 then 'on ' || day(o_orderdate) || ' ' || strftime(o_orderdate, '%B') || ' ' || year(o_orderdate)
      when 2 then 'dated ' || strftime(o_orderdate, '%Y-%m-%d') || ' in print'
      when 3 then 'Published: ' || year(o_orderdate) else 'since ' || year(o_orderdate) || ' or so' end as body,
      o_orderdate from orders"""


@query("extract_dates", f"""
    select o_orderkey, case when year(o_orderdate) < 2000 then null else case o_orderkey % 5
      when 0 then strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ' ' || year(o_orderdate)
      when 1 then day(o_orderdate) || ' ' || strftime(o_orderdate, '%B') || ' ' || year(o_orderdate)
      when 2 then strftime(o_orderdate, '%Y %m %d') else year(o_orderdate)::varchar end end as found
    from ({_DATED})""")
def extract_dates(spark, sf_dir):
    o = testbed.table(spark, sf_dir, "orders")
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    month, day, year = F.date_format(d, "MMMM"), F.day(d).cast("string"), F.year(d).cast("string")
    body = (
        F.when(kind == 0, F.concat(F.lit("Posted "), month, F.lit(" "), day, F.lit(", "), year, F.lit(".")))
        .when(kind == 1, F.concat(F.lit("on "), day, F.lit(" "), month, F.lit(" "), year))
        .when(kind == 2, F.concat(F.lit("dated "), F.date_format(d, "yyyy-MM-dd"), F.lit(" in print")))
        .when(kind == 3, F.concat(F.lit("Published: "), year))
        .otherwise(F.concat(F.lit("since "), year, F.lit(" or so")))
    )
    return o.select("o_orderkey", urls.extract_date(body).alias("found"))


_HITS = f"""
    hits as (select conv_id as query_id, turn as pos, 'Hit ' || turn as title, url as link, text as snippet, role as date
      from conversations join pages on page_id = (conv_id * 7 + turn) % (select count(*) from pages)),
    first as (select * from (select *, row_number() over (partition by query_id, link order by pos) as r from hits) where r = 1),
    kept as (select * from (select *, row_number() over (partition by query_id order by pos) as r2 from first) where r2 <= 20),
    texts as (select url as link, max(case when length(body) >= 200 then body end) as body
      from (select url, {_main_text_sql()} as body from pages) group by url)"""


@query("web_candidates", f"""
    with {_HITS},
    c as (select query_id, pos, 'Title: ' || title || chr(10) || 'Date: ' || date || chr(10) || 'Link: ' || link || chr(10)
        || 'Content Type: ' || case when body is null then 'Google Snippet' else 'Deep Fetch (Full Abstract)' end || chr(10)
        || 'Body: ' || coalesce(left(body, 3000), snippet) || chr(10) as content
      from kept join texts using (link) where coalesce(body, nullif(snippet, '')) is not null)
    select query_id, pos, md5(content) as digest, case when contains(content, 'PMID:') then 'pubmed' else 'web_search' end as source
    from c""")
def web_candidates(spark, sf_dir):
    """Each turn of a conversation stands for a web hit on one of the stored pages."""
    pages = testbed.texts(spark, sf_dir, "pages")
    n = pages.agg(F.count("*")).scalar()
    turns = testbed.table(spark, sf_dir, "conversations").withColumn(
        "page_id", (F.col("conv_id") * 7 + F.col("turn")) % n
    )
    hits = turns.join(pages.select("page_id", "url"), "page_id").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"),
        F.concat(F.lit("Hit "), F.col("turn").cast("string")).alias("title"),
        F.col("url").alias("link"), F.col("text").alias("snippet"),
        F.col("role").alias("date"),
    )
    body = urls.main_text("html")
    stored = pages.select(F.col("url").alias("link"), body.alias("text")).where(F.length("text") >= 200)
    out = records.web_candidates(hits, stored)
    return out.select("query_id", "pos", F.md5("content").alias("digest"), "source")


# ---------------------------------------------------------------- records


_ARTICLES = "articles as (select doc_id::varchar as pmid, split_part(text, chr(10), 1) as title, '10.1016/j.doc.' || doc_id as doi from documents)"
# each document asks for itself in one of five ways
_REQUESTS = """
    requests as (select doc_id as request_id, split_part(text, chr(10), 1) as t, case doc_id % 5
        when 0 then 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id when 3 then 'https://doi.org/10.1016/j.doc.' || doc_id
        when 4 then 'https://www.researchgate.net/p/' || doc_id else 'https://example.org/' || doc_id end as url,
      case doc_id % 5 when 1 then split_part(text, chr(10), 1) when 2 then '[' || split_part(text, chr(10), 1) || ']'
        when 4 then 'The ' || split_part(text, chr(10), 1) else '' end as title
      from documents)"""
_SQ = "trim(regexp_replace(regexp_replace({x}, '[:\\[\\](){{}}]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _loose_sql(x: str) -> str:
    out = f"regexp_replace({x}, '(?i)^(The|A|An)\\s+', '')"
    out = f"regexp_replace({out}, '(?i)\\s+(is|are|reveals?|shows?)\\s+.+$', '')"
    out = f"regexp_replace({out}, '(?i)\\s+(via|through|by|in|of|and)\\s+', ' ', 'g')"
    return f"trim(regexp_replace(left({out}, 100), '\\s+', ' ', 'g'))"


@query("resolve_records", f"""
    with {_ARTICLES}, {_REQUESTS},
    tt as (select lower(trim(title)) as k, min(pmid) as pmid from articles where trim(title) <> '' group by 1),
    ct as (select lower({_SQ.format(x='title')}) as k, min(pmid) as pmid from articles group by 1),
    lt as (select lower({_loose_sql('title')}) as k, min(pmid) as pmid from articles group by 1),
    dt as (select lower(doi) as k, min(pmid) as pmid from articles group by 1),
    r as (select request_id, url, nullif(trim(title), '') as title from requests),
    m as (select request_id, nullif(regexp_extract(url, 'pubmed\\.ncbi\\.nlm\\.nih\\.gov/(\\d+)', 1), '') as p1, tt.pmid as p2,
        ct.pmid as p3, dt.pmid as p4, lt.pmid as p5
      from r left join tt on tt.k = lower(title)
        left join ct on ct.k = lower({_SQ.format(x='title')}) and ct.k <> '' and {_SQ.format(x='title')} <> title
        left join dt on dt.k = lower(nullif(regexp_extract(url, 'doi\\.org/([\\d\\.]+/[^\\s"<>]+)', 1), ''))
        left join lt on lt.k = lower({_loose_sql('title')}) and lt.k <> '' and contains(url, 'researchgate'))
    select request_id, coalesce(p1, p2, p3, p4, p5) as pmid, case when p1 is not null then 'URL_EXTRACTION'
      when p2 is not null then 'TITLE_EXACT' when p3 is not null then 'TITLE_FUZZY' when p4 is not null then 'DOI_SEARCH'
      when p5 is not null then 'RESEARCHGATE_CLEANUP' end as method from m""")
def resolve_records(spark, sf_dir):
    docs = testbed.table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    ident, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    articles = docs.select(
        ident.alias("pmid"), title.alias("title"), F.concat(F.lit("10.1016/j.doc."), ident).alias("doi")
    )
    requests = docs.select(
        F.col("doc_id").alias("request_id"),
        F.when(kind == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), ident))
        .when(kind == 3, F.concat(F.lit("https://doi.org/10.1016/j.doc."), ident))
        .when(kind == 4, F.concat(F.lit("https://www.researchgate.net/p/"), ident))
        .otherwise(F.concat(F.lit("https://example.org/"), ident)).alias("url"),
        F.when(kind == 1, title).when(kind == 2, F.concat(F.lit("["), title, F.lit("]")))
        .when(kind == 4, F.concat(F.lit("The "), title)).otherwise("").alias("title"),
    )
    return records.resolve_records(requests, articles)


@query("published_versions", """
    with p as (select distinct '10.1016/j.part.' || l_partkey as doi from lineitem),
    a as (select '10.1016/J.PART.' || p_partkey as doi, min(p_partkey::varchar) as pmid from part where p_size > 25 group by 1)
    select p.doi, pmid from p left join a on lower(a.doi) = lower(p.doi)""")
def published_versions(spark, sf_dir):
    preprints = testbed.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("10.1016/j.part."), F.col("l_partkey").cast("string")).alias("doi")
    )
    articles = testbed.table(spark, sf_dir, "part").where(F.col("p_size") > 25).select(
        F.col("p_partkey").cast("string").alias("pmid"),
        F.concat(F.lit("10.1016/J.PART."), F.col("p_partkey").cast("string")).alias("doi"),
    )
    return records.published_versions(preprints, articles)


@query("latest_versions", """
    select doi, max(version) as version, max(date) as date from (
      select 'P' || l_partkey as doi, l_linenumber as version,
        max(strftime(l_shipdate, '%Y-%m-%d')) over (partition by l_partkey, l_linenumber) as date,
        max(l_linenumber) over (partition by l_partkey) as top from lineitem) where version = top group by doi""")
def latest_versions(spark, sf_dir):
    """Order lines of a part as versions of a preprint."""
    lines = testbed.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("doi"),
        F.col("l_linenumber").cast("string").alias("version"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
    )
    return records.latest_versions(lines).select(
        "doi", F.col("version").cast("int").alias("version"), "date"
    )


@query("search_preprints", """
    select doc_id::varchar as doi, lang as date from documents
    where contains(lower(split_part(text, chr(10), 1) || ' ' || text), 'the')
      and contains(lower(split_part(text, chr(10), 1) || ' ' || text), 'and') and lang >= 'de' and lang <= 'fr'
    order by lang, doc_id::varchar limit 25""")
def search_preprints(spark, sf_dir):
    docs = testbed.texts(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doi"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"), F.col("lang").alias("date"),
    )
    return records.search_preprints(docs, "THE and", "de", "fr", 25).select("doi", "date")


def _trial_payloads(spark, sf_dir):
    """Each order as the stored JSON document of a trial."""
    o = testbed.texts(spark, sf_dir, "orders").join(
        testbed.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key = F.col("o_orderkey").cast("string")
    protocol = F.struct(
        F.struct(
            F.concat(F.lit("NCT"), F.lpad(key, 8, "0")).alias("nctId"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Official "), key)).alias("officialTitle"),
            F.concat(F.lit("Brief "), key).alias("briefTitle"),
        ).alias("identificationModule"),
        F.struct(F.col("o_orderpriority").alias("briefSummary")).alias("descriptionModule"),
        F.struct(
            F.col("o_orderstatus").alias("overallStatus"),
            F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("startDateStruct"),
        ).alias("statusModule"),
        F.struct(
            F.when(F.col("o_totalprice") > 250000, F.array(F.lit("PHASE1"), F.lit("PHASE2"))).alias("phases")
        ).alias("designModule"),
        F.struct(F.array("c_mktsegment").alias("conditions")).alias("conditionsModule"),
        F.struct(
            F.array(F.struct(F.lit("DRUG").alias("type"), F.col("c_name").alias("name"))).alias("interventions")
        ).alias("armsInterventionsModule"),
    )
    return o.select("o_orderkey", F.to_json(F.struct(protocol.alias("protocolSection"))).alias("payload"))


_TRIAL = """
    select 'NCT' || lpad(o_orderkey::varchar, 8, '0') as nct_id,
      case when o_orderstatus = 'F' then 'Official ' else 'Brief ' end || o_orderkey as title,
      o_orderstatus as status, case when o_totalprice > 250000 then 'PHASE1, PHASE2' else '' end as phase,
      c_mktsegment as conditions, o_orderpriority as brief_summary, c_name as intervention,
      strftime(o_orderdate, '%Y-%m-%d') as start_date, '' as lead_sponsor
    from orders join customer on o_custkey = c_custkey"""


@query("trial_fields", _TRIAL)
def trial_fields(spark, sf_dir):
    t = _trial_payloads(spark, sf_dir).select(render.trial_fields("payload").alias("t"))
    return t.select(
        "t.nct_id", "t.title", "t.status", "t.phase", F.array_join("t.conditions", ",").alias("conditions"),
        "t.brief_summary", F.col("t.interventions")[0]["name"].alias("intervention"),
        "t.start_date", "t.lead_sponsor",
    )


@query("trial_texts", f"""
    select nct_id, md5('Clinical Trial: ' || nct_id || chr(10) || chr(10) || 'Official Title: ' || title || chr(10)
      || 'Status: ' || status || chr(10) || case when phase <> '' then 'Phase: ' || phase || chr(10) else '' end
      || 'Conditions: ' || conditions || chr(10) || chr(10) || 'Brief Summary:' || chr(10) || brief_summary || chr(10)
      || chr(10) || 'Interventions:' || chr(10) || '1. DRUG: ' || intervention || chr(10) || chr(10)
      || 'Start Date: ' || start_date || chr(10) || chr(10) || '[Source: ClinicalTrials.gov API v2]') as digest
    from ({_TRIAL})""")
def trial_texts(spark, sf_dir):
    t = _trial_payloads(spark, sf_dir).select(render.trial_fields("payload").alias("t"))
    return t.select("t.nct_id", F.md5(render.format_trial("t")).alias("digest"))


@query("filter_trials", f"""
    select nct_id, title from ({_TRIAL}) where contains(lower(conditions), 'auto') and contains(lower(intervention), 'customer')
      and status = 'F' and phase <> '' and contains(lower(title || ' ' || brief_summary), 'official')
    order by nct_id limit 40""")
def filter_trials(spark, sf_dir):
    t = _trial_payloads(spark, sf_dir).select(render.trial_fields("payload").alias("trial"))
    out = records.filter_trials(t, "official", "auto", "Customer", "f", "phase2", 40)
    return out.select("trial.nct_id", "trial.title")


def _article_payloads(spark, sf_dir):
    """Each part as the stored JSON document of an article, with more authors for larger parts."""
    part = testbed.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    authors = F.transform(
        F.sequence(F.lit(1), F.col("p_size") % 8 + 1),
        lambda i: F.struct(
            F.concat(F.lit("Author"), i.cast("string")).alias("last"), F.lit("A").alias("initials")
        ),
    )
    return part.select(
        F.to_json(
            F.struct(
                key.alias("pmid"), F.concat(F.lit("On part "), key).alias("title"),
                F.array(
                    F.struct(F.lit("AIM").alias("label"), F.col("p_type").alias("text")),
                    F.struct(F.lit(None).cast("string").alias("label"), F.col("p_brand").alias("text")),
                ).alias("abstract"),
                authors.alias("authors"), F.lit("Journal of Parts").alias("journal"),
                (F.col("p_size") + 1970).cast("string").alias("year"),
            )
        ).alias("payload")
    )


_ARTICLE = """
    with a as (select *, list_transform(range(1, p_size % 8 + 2), lambda i: 'Author' || i || ' A') as names from part),
    f as (select p_partkey::varchar as pmid, 'On part ' || p_partkey as title, 'AIM: ' || p_type || ' ' || p_brand as abstract,
        array_to_string(names[1:5], ', ') || case when len(names) > 5 then ' et al.' else '' end as authors,
        'Journal of Parts' as journal, (p_size + 1970)::varchar as year
      from a)"""


@query("article_fields", f"{_ARTICLE} select * from f")
def article_fields(spark, sf_dir):
    return _article_payloads(spark, sf_dir).select(render.article_fields("payload").alias("a")).select("a.*")


@query("citations", f"""{_ARTICLE}
    select pmid, authors || '. ' || title || '. ' || journal || '. (' || year || '). PMID: ' || pmid as citation,
      md5('Title: ' || title || chr(10) || 'Authors: ' || authors || chr(10) || 'Journal: ' || journal || ' (' || year || ')' || chr(10)
        || 'PMID: ' || pmid || chr(10) || chr(10) || 'Abstract:' || chr(10) || abstract || chr(10) || chr(10) || '[Source: PubMed]') as digest
    from f""")
def citations(spark, sf_dir):
    a = _article_payloads(spark, sf_dir).select(render.article_fields("payload").alias("a")).select("a.*")
    fields = {c: c for c in a.columns}
    return a.select(
        "pmid", render.format_citation(fields).alias("citation"),
        F.md5(render.format_article(fields)).alias("digest"),
    )


@query("record_texts", """
    select p_partkey, 'Gene: G' || (p_partkey % 100) || ' (' || p_name || ')' || chr(10) || 'Function: ' || p_type || chr(10)
        || 'Pathway: ' || p_brand || chr(10) || case when p_size <> 0 then 'Essentiality Score: ' || p_size || chr(10) else '' end
        || '[Source: External KG]' as gene_text,
      'Synthetic Lethality: ' || p_name || ' ↔ ' || p_type || chr(10) || 'SL Score: ' || p_size || chr(10) || 'Evidence: N/A' || chr(10)
        || 'PMID: ' || p_partkey || chr(10) || '[Source: External KG]' as pair_text,
      'Title: ' || p_name || chr(10) || 'Category: ' || p_type || chr(10) || 'DOI: 10.1101/' || p_partkey || chr(10) || chr(10)
        || 'Abstract:' || chr(10) || p_brand || chr(10) || chr(10) || '[Source: biorxiv]' as preprint_text
    from part""")
def record_texts(spark, sf_dir):
    part = testbed.table(spark, sf_dir, "part")
    none, key = F.lit(None).cast("string"), F.col("p_partkey").cast("string")
    return part.select(
        "p_partkey",
        render.format_gene({
            "symbol": testbed.gene_of("p_partkey"), "name": "p_name", "function": "p_type",
            "pathway": "p_brand", "essentiality_score": "p_size",
        }).alias("gene_text"),
        render.format_pair({
            "gene_a": "p_name", "gene_b": "p_type", "sl_score": "p_size", "evidence_type": none,
            "pmid": key, "source": none,
        }).alias("pair_text"),
        render.format_preprint({
            "title": "p_name", "authors": none, "category": "p_type", "date": none,
            "doi": F.concat(F.lit("10.1101/"), key), "abstract": "p_brand", "server": none,
        }).alias("preprint_text"),
    )


@query("hit_lists", """
    select page_id, 'Web Search Results:' || chr(10) || chr(10) || '1. No title' || chr(10) || '   URL: ' || url || chr(10)
      || '   ' || html || chr(10) || chr(10) || '2. Page ' || page_id || chr(10) || '   URL: N/A' || chr(10) as listing
    from pages""")
def hit_lists(spark, sf_dir):
    """Two hits for each page: one without a title, one without link and snippet."""
    none = F.lit(None).cast("string")
    hits = F.array(
        F.struct(
            none.alias("title"), F.col("url").alias("link"), F.col("html").alias("snippet")
        ),
        F.struct(
            F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
            none.alias("link"), F.lit("").alias("snippet"),
        ),
    )
    return testbed.table(spark, sf_dir, "pages").select(
        "page_id", render.format_hits(hits).alias("listing")
    )


@query("layout_parts", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, 1 as n_tables, 1 as n_figures, 1 as n_texts,
      '| line | flag |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || l_linenumber || ' | ' || l_returnflag || ' |' || chr(10)
        || '| ' || l_partkey || ' |  |' as table_text
    from lineitem""")
def layout_parts(spark, sf_dir):
    """Each order line as the stored layout of a page with a ragged table, a figure and a heading."""
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<array<string>>")
    cells = F.array(
        F.array(F.lit("line"), F.lit("flag")),
        F.array(F.col("l_linenumber").cast("string"), F.concat("l_returnflag", F.lit(" "))),
        F.array(F.col("l_partkey").cast("string")),
    )

    def block(kind, caption=none, body=none, rows=empty):
        return F.struct(
            F.lit(kind).alias("type"), caption.alias("caption"), body.alias("text"),
            F.lit(0).alias("page_idx"), rows.alias("rows"),
        )

    layout = F.to_json(
        F.array(
            block("table", rows=cells), block("figure", F.lit("A plot")),
            block("text", body=F.lit("Heading")),
        )
    )
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    parts = testbed.texts(spark, sf_dir, "lineitem").select(
        *keys, render.layout_parts(layout).alias("p")
    )
    return parts.select(
        *keys, F.size("p.tables").alias("n_tables"), F.size("p.figures").alias("n_figures"),
        F.size("p.first_page").alias("n_texts"), F.col("p.tables")[0].alias("table_text"),
    )


# ---------------------------------------------------------------- questions and search strings


@query("search_strings", f"""
    select query_id, md5(query || case when len(g) > 0 then ' ("' || array_to_string(g[1:3], '" OR "') || '")' else '' end
        || ' (site:ncbi.nlm.nih.gov OR site:pubmed.ncbi.nlm.nih.gov OR site:nature.com OR site:cell.com OR site:sciencedirect.com '
        || 'OR site:biorxiv.org OR site:medrxiv.org)') as digest,
      regexp_matches(query, '(?i)\\b(latest|recent|newest|current|202[0-9])\\b|最新|近期|最近') as is_recent
    from (select query_id, query, list_sort({sql.genes('query')}) as g from ({sql.TURNS}))""")
def search_strings(spark, sf_dir):
    asked = entities.extract_entities(testbed.turns(spark, sf_dir))
    return asked.select(
        "query_id", F.md5(queries.compose_search("query", "genes", "drugs")).alias("digest"),
        queries.is_recent_query("query").alias("is_recent"),
    )


_SITES = "(site:ncbi.nlm.nih.gov OR site:pubmed.ncbi.nlm.nih.gov OR site:nature.com OR site:cell.com OR site:sciencedirect.com OR site:biorxiv.org OR site:medrxiv.org)"


@query("pair_search_strings", f"""
    with {sql.pairs()}
    select distinct gene_a, gene_b, '"' || gene_a || '" "' || gene_b || '" "synthetic lethality" OR "synthetic lethal" {_SITES}' as pair_search,
      '"' || gene_a || '" "' || gene_b || '" (inhibitor OR resistance OR sensitivity OR treatment) {_SITES}' as drug_search
    from pairs""")
def pair_search_strings(spark, sf_dir):
    p = testbed.pairs(spark, sf_dir).select("gene_a", "gene_b").distinct()
    return p.select(
        "gene_a", "gene_b",
        queries.compose_lethality_search("gene_a", "gene_b", F.lit("")).alias("pair_search"),
        queries.compose_drug_gene_search("gene_a", "gene_b").alias("drug_search"),
    )


_NAMES = """
    names as (select gene, list_distinct(list_filter([gene] || alias[1:3], lambda a: length(a) > 1)) as names
      from (select 'G' || (p_partkey % 100) as gene, list_sort(list(distinct p_brand)) as alias from part group by 1))"""


def _alias_table(spark, sf_dir):
    part = testbed.table(spark, sf_dir, "part")
    return part.groupBy(testbed.gene_of("p_partkey").alias("query")).agg(
        F.array_sort(F.collect_set("p_brand")).alias("alias")
    ).withColumn("symbol", F.col("query"))


@query("alias_expansion", f"""
    with {sql.MATRIX}, {_NAMES}, g as (select distinct gene from matrix),
    e as (select g.gene, coalesce(n.names, [g.gene]) as names from g left join names n using (gene))
    select gene, len(names) as n_names, array_to_string(list_sort(names), ' ') as names from e""")
def alias_expansion(spark, sf_dir):
    genes = testbed.matrix(spark, sf_dir).select("gene").distinct()
    out = entities.expand_aliases(genes, _alias_table(spark, sf_dir))
    return out.select(
        "gene", F.size("names").cast("long").alias("n_names"),
        F.array_join(F.array_sort("names"), " ").alias("names"),
    )


@query("boolean_queries", f"""
    with {sql.MATRIX}, g as (select distinct gene from matrix),
    a as (select 'G' || (p_partkey % 100) as gene, list_sort(list(distinct p_brand)) as alias from part group by 1)
    select gene, '("' || array_to_string(([gene] || coalesce(alias, []))[1:3], '" OR "')
      || '") AND ("synthetic lethality" OR "synthetic lethal")' as expanded
    from g left join a using (gene)""")
def boolean_queries(spark, sf_dir):
    genes = testbed.matrix(spark, sf_dir).select("gene").distinct()
    out = entities.expand_aliases(genes, _alias_table(spark, sf_dir))
    return out.select("gene", queries.boolean_expand("gene", F.array("names")).alias("expanded"))


@query("step_back_queries", f"""
    with q as (select query_id, query, coalesce(nullif(regexp_extract(query,
        '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([A-Z][A-Z0-9]{{1,9}})(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1), ''), 'gene') as g from ({sql.TURNS}))
    select query_id, unnest([0, 1, 2]) as pos, unnest([g || ' pathway function mechanism', g || ' paralog redundancy backup',
      g || ' loss cellular stress phenotype']) as query from q""")
def step_back_queries(spark, sf_dir):
    return testbed.turns(spark, sf_dir).select(
        "query_id", F.posexplode(queries.step_back_queries("query")).alias("pos", "query")
    )


@query("query_lines", """
    with l as (select conv_id, turn, regexp_replace(regexp_replace(unnest(string_split('1. ' || text || chr(10) || '# note' || chr(10)
        || '- ' || role || chr(10) || 'Example x', chr(10))), '^\\s+|\\s+$', '', 'g'), '^[\\d.\\-*\\s]+', '') as s from conversations)
    select conv_id, turn, count(*) as n, sum(length(s))::bigint as n_chars from l
    where s <> '' and not starts_with(s, '#') and not starts_with(s, 'Example') and not starts_with(s, 'Output') group by all""")
def query_lines(spark, sf_dir):
    turns = testbed.table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("1. "), "text", F.lit("\n# note\n- "), "role", F.lit("\nExample x"))
    lines = turns.select("conv_id", "turn", F.explode(queries.parse_query_lines(raw)).alias("s"))
    return lines.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n"), F.sum(F.length("s")).alias("n_chars")
    )


# ---------------------------------------------------------------- stored outputs


@query("verdicts", """
    select doc_id, case when toxic = 1 then 'FAIL' else 'PASS' end as status,
      case when doc_id % 3 = 2 then case when toxic = 1 then 0.4 else 0.85 end else least(1.0, doc_id % 13 / 10.0) end::double as confidence,
      case when toxic = 1 or doc_id % 3 = 1 then 1 else 0 end as n_issues,
      case when toxic = 1 and doc_id % 3 <> 2 then 1 else 0 end as n_suggestions,
      toxic = 1 or (doc_id % 3 <> 2 and doc_id % 13 / 10.0 < 0.5) as regenerate
    from labels""")
def verdicts(spark, sf_dir):
    """Stored checker outputs made from the labels: JSON, labelled text, and bare words."""
    labels = testbed.table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS")
    conf = (F.col("doc_id") % 13 / 10).cast("string")
    as_json = F.concat(
        F.lit("Result:\n```json\n"),
        F.to_json(
            F.struct(
                status.alias("status"), (F.col("doc_id") % 13 / 10).alias("confidence"),
                F.when(
                    F.col("toxic") == 1,
                    F.array(
                        F.struct(
                            F.lit("claim").alias("type"), F.lit("not supported").alias("description"),
                            F.lit("cite it").alias("suggestion"),
                        )
                    ),
                ).alias("issues"),
            )
        ),
        F.lit("\n```"),
    )
    as_text = F.concat(
        F.lit("VERDICT: "), status, F.lit("\nCONFIDENCE: "), conf,
        F.lit("\nISSUES:\n- the claim is thin\n- x"),
        F.when(F.col("toxic") == 1, "\nSUGGESTIONS:\n• read it again").otherwise(""),
    )
    as_word = F.when(F.col("toxic") == 1, "It must fail.\nISSUE:\n- it is not right").otherwise("Fine, it will pass")
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 0, as_json).when(kind == 1, as_text).otherwise(as_word)
    v = labels.select("doc_id", outputs.parse_verdict(raw).alias("v"))
    return v.select(
        "doc_id", "v.status", F.round("v.confidence", 6).alias("confidence"),
        F.size("v.issues").alias("n_issues"), F.size("v.suggestions").alias("n_suggestions"),
        outputs.needs_regeneration("v").alias("regenerate"),
    )


@query("intents", """
    select conv_id, turn, case when contains(upper(text), 'SCIENTIFIC') then 'SCIENTIFIC'
      when role = 'user' then 'GENERAL' else 'SCIENTIFIC' end as intent from conversations""")
def intents(spark, sf_dir):
    turns = testbed.table(spark, sf_dir, "conversations")
    raw = F.concat("text", F.when(F.col("role") == "user", " general").otherwise(""))
    return turns.select("conv_id", "turn", outputs.normalize_intent(raw).alias("intent"))


@query("fenced_json", """
    select event_id, case when event_id % 3 = 2 then -1 else json_extract(props, '$.k')::bigint end as k from events""")
def fenced_json(spark, sf_dir):
    e = testbed.table(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    raw = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .otherwise(F.concat(F.lit("no json "), "props"))
    )
    return e.select("event_id", F.coalesce(outputs.parse_fenced_json(raw, "k bigint")["k"], F.lit(-1)).alias("k"))


@query("accuracy_by_task", """
    with s as (select lang as task, quality = case when n_chars >= 1000 then 1 else 0 end as correct
      from labels join documents using (doc_id))
    select task, count(*) as n, round(avg(correct::int), 6) as accuracy from s group by task
    union all select 'ALL', count(*), round(avg(correct::int), 6) from s""")
def accuracy_by_task(spark, sf_dir):
    """Quality labels as targets and text length as the predictor, one task for each language."""
    rows = testbed.table(spark, sf_dir, "labels").join(
        testbed.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id"
    )
    long = F.col("n_chars") >= 1000
    answers = rows.select(
        F.col("lang").alias("task"),
        F.when(F.col("lang") == "en", "letter").otherwise("yes_no").alias("options"),
        F.when(F.col("lang") == "en", F.when(F.col("quality") == 1, "A").otherwise("B"))
        .otherwise(F.when(F.col("quality") == 1, "Yes").otherwise("No")).alias("target"),
        F.when(F.col("lang") == "en", F.when(long, "Answer: A").otherwise("the option is (b)"))
        .otherwise(F.when(long, "yes.").otherwise("No, it is short")).alias("raw"),
    )
    return evaluate.accuracy_by_task(evaluate.score_answers(answers))


@query("alias_variants", f"""
    with {sql.pairs()}, {_NAMES}, items as (select distinct pair_pos as item_id, gene_a as gene, gene_b from pairs),
    v as (select item_id, gene, gene_b, unnest(names) as alias from items join names using (gene))
    select item_id, gene_b, alias, 'Is ' || alias || ' lethal with ' || gene_b || '?' as variant_input from v where alias <> gene""")
def alias_variants(spark, sf_dir):
    items = testbed.pairs(spark, sf_dir).select(
        F.col("pair_pos").alias("item_id"), F.col("gene_a").alias("gene"), "gene_b",
        F.concat(F.lit("Is "), "gene_a", F.lit(" lethal with "), "gene_b", F.lit("?")).alias("input"),
    ).distinct()
    out = evaluate.alias_variants(items, _alias_table(spark, sf_dir))
    return out.select(
        "item_id", F.regexp_extract("input", r"with (\w+)\?", 1).alias("gene_b"), "alias", "variant_input"
    )


@query("invariance_rate", """
    select count(*) as variants, round(avg((a.role = o.role)::int), 6) as invariance
    from conversations a join conversations o using (conv_id) where a.turn <> 0 and o.turn = 0""")
def invariance_rate(spark, sf_dir):
    """Roles of the turns of a conversation as the answers to one question and its variants."""
    answers = testbed.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("variant"), F.col("role").alias("answer")
    )
    return evaluate.invariance_rate(answers)


@query("truncations", """
    select conv_id, turn, left(text, 80) as head, right(text, 80) as tail from conversations""")
def truncations(spark, sf_dir):
    turns = testbed.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", text.truncate_tokens("text", 20).alias("head"),
        text.truncate_tokens("text", 20, True).alias("tail"),
    )


@query("truncate_lines", """
    with l as (select doc_id, s, i, sum((length(s) + 1) // 4) over (partition by doc_id order by i) as used
      from (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))
    select d.doc_id, md5(coalesce(t, '')) as digest from documents d left join
      (select doc_id, string_agg(s, chr(10) order by i) as t from l where used <= 300 group by doc_id) using (doc_id)""")
def truncate_lines(spark, sf_dir):
    docs = testbed.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(trim.truncate_lines("text", 300)).alias("digest"))


@query("truncate_graph", """
    with b as (select doc_id, text, list_filter(string_split(text, ' '), lambda w: w <> '' and not contains(w, chr(10))) as ws from documents),
    l as (select doc_id, 'TEXT ' || doc_id as head, w || ' --[in]--> ' || doc_id as s, i from
      (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from b)),
    u as (select *, sum((length(s) + 1) // 4) over (partition by doc_id order by i) as used, length(head) // 4 as h,
        sum(length(s) + 1) over (partition by doc_id) as n_chars from l),
    k as (select doc_id, string_agg(s, chr(10) order by i) filter (used <= 300 - h - 50) as cut,
        string_agg(s, chr(10) order by i) filter ((length(head) + n_chars) // 4 <= 300) as whole from u group by doc_id)
    select doc_id, md5(coalesce('TEXT ' || doc_id || chr(10) || coalesce(whole, cut),
      case when len(ws) = 0 then 'TEXT ' || doc_id || chr(10) else '' end)) as digest
    from b left join k using (doc_id)""")
def truncate_graph(spark, sf_dir):
    """The words of each document as relation lines under a head."""
    docs = testbed.texts(spark, sf_dir, "documents")
    ident = F.col("doc_id").cast("string")
    words = F.filter(F.split("text", " "), lambda w: (w != "") & ~w.contains("\n"))
    lines = F.transform(words, lambda w: F.concat(w, F.lit(" --[in]--> "), ident))
    body = F.concat(F.lit("TEXT "), ident, F.lit("\n"), F.array_join(lines, "\n"))
    return docs.select("doc_id", body.alias("body")).select(
        "doc_id", F.md5(trim.truncate_graph("body", 300)).alias("digest")
    )
