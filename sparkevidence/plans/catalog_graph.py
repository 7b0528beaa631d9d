"""Catalogue: the graph of triplets, its traversals and its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from . import sql, testbed
from .catalog_knowledge import _triples
from .registry import query

EDGES = "edges as (select x_name as src, y_name as dst, display_relation as relationship from triples)"
BOTH = """both_ways as (select src as node, dst as next from edges
    union select dst, src from edges)"""
# every region and nation stands for a question about the nodes around it
SEEDS = """seeds as (select r_regionkey::bigint as query_id, upper(r_name) as node from region
    union all select 100 + n_nationkey, upper(n_name) from nation)"""


def _seeds(spark, sf_dir):
    region = testbed.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("query_id"), F.upper("r_name").alias("node")
    )
    nation = testbed.table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("long").alias("query_id"), F.upper("n_name").alias("node")
    )
    return region.unionByName(nation)


def _edges(spark, sf_dir):
    """Edges of the stored triple table."""
    return testbed.triple_edges(_triples(spark, sf_dir))


# ---------------------------------------------------------------- building


def _raw_triplets(spark, sf_dir):
    """Stored outputs: one text for each order line, with one triplet and one broken line."""
    lines = testbed.table(spark, sf_dir, "lineitem").join(
        testbed.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    raw = F.concat(
        F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" | bought in "),
        F.col("l_returnflag"), F.lit("| "), testbed.gene_of("l_partkey"),
        F.lit("\nnote on "), F.col("l_linestatus"), F.lit("|only"),
    )
    return lines.select(
        F.col("o_orderkey").alias("query_id"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), raw.alias("raw"),
    )


_TRIPLETS = """
    t as (select o_orderkey * 10 + l_linenumber as doc_id, 0 as pos, 'Customer ' || o_custkey as subject,
            'bought in ' || l_returnflag as relation, 'G' || (l_partkey % 100) as object
          from lineitem join orders on l_orderkey = o_orderkey)"""


@query("parse_triplets", f"with {_TRIPLETS} select doc_id, pos, subject, relation, object from t")
def parse_triplets(spark, sf_dir):
    return graph.triplets_of(_raw_triplets(spark, sf_dir)).drop("query_id")


@query("build_graph", f"""
    with {_TRIPLETS}
    select upper(subject) as src, object as dst, arg_max(relation, (doc_id, pos, relation)) as relationship
    from t group by all""")
def build_graph(spark, sf_dir):
    return graph.build_graph(graph.triplets_of(_raw_triplets(spark, sf_dir)))


@query("normalize_names", """
    with a as (select 'G' || (p_partkey % 100) as name, min(p_brand) as symbol from part group by 1),
    n as (select distinct 'G' || (l_partkey % 100) as name from lineitem
      union select distinct n_name from nation
      union select unnest(['p53', 'Her2', 'C-MYC']))
    select name, case lower(name) when 'p53' then 'TP53' when 'her2' then 'ERBB2' when 'c-myc' then 'MYC'
      else coalesce(symbol, upper(name)) end as normal
    from n left join a using (name)""")
def normalize_names(spark, sf_dir):
    from ..operators.entities import normalize_names as normalize

    aliases = testbed.table(spark, sf_dir, "part").select(
        testbed.gene_of("p_partkey").alias("query"), F.col("p_brand").alias("symbol")
    )
    names = (
        testbed.table(spark, sf_dir, "lineitem").select(testbed.gene_of("l_partkey").alias("name"))
        .union(testbed.table(spark, sf_dir, "nation").select("n_name"))
        .union(
            testbed.table(spark, sf_dir, "region").select(
                F.explode(F.array(F.lit("p53"), F.lit("Her2"), F.lit("C-MYC")))
            )
        )
        .distinct()
    )
    return normalize(names, aliases)


_CHECKED = f"""
    with {sql.pairs()},
    t as (select pair_pos as doc_id, gene_a as src, gene_b as dst from pairs
      union all select pair_pos, gene_a, c_mktsegment || ' DISEASE' from pairs join orders on o_orderkey = pair_pos // 10
        join customer on o_custkey = c_custkey),
    i as (select least(gene_a, gene_b) as lo, greatest(gene_a, gene_b) as hi, max(round(o_totalprice / 500000, 4)) as score
      from pairs join orders on o_orderkey = pair_pos // 10 where o_orderpriority <> '1-URGENT' group by all),
    a as (select gene_a as s, c_mktsegment || ' DISEASE' as o, max(round(c_acctbal / 10000, 4)) as score
      from pairs join orders on o_orderkey = pair_pos // 10 join customer on o_custkey = c_custkey group by all)"""


@query("validate_triplets", f"""{_CHECKED}
    select src, dst, count(*) as n, any_value(i.score >= 0.7 or a.score >= 0.1) is true as validated,
      any_value(case when i.score >= 0.7 then 'STRING' when a.score >= 0.1 then 'OpenTargets' end) as validation_source,
      any_value(case when i.score >= 0.7 then i.score when a.score >= 0.1 then a.score else 0 end) as validation_score,
      any_value(case when i.score >= 0.7 then null when a.score >= 0.1 then 'OT Validation: ' || src || '-' || dst || ' (Score: '
        || {sql.decimals('a.score', 2)} || ', ' || case when a.score > 0.5 then 'High' else 'Moderate' end
        || ', Top Evidence: Genetic Association)' end) as validation_text
    from t left join i on lo = least(src, dst) and hi = greatest(src, dst) left join a on s = src and o = dst
    group by src, dst""")
def validate_triplets(spark, sf_dir):
    """Pairs of an order against an interaction and an association table made from the orders."""
    known = testbed.pairs(spark, sf_dir)
    orders = testbed.table(spark, sf_dir, "orders")
    customer = testbed.table(spark, sf_dir, "customer")
    rows = known.join(orders, testbed.order_of_pair() == F.col("o_orderkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    disease = F.concat("c_mktsegment", F.lit(" DISEASE"))
    triplets = rows.select("gene_a", F.col("gene_b").alias("dst")).unionByName(
        rows.select("gene_a", disease.alias("dst"))
    ).select(F.col("gene_a").alias("src"), "dst")
    interactions = rows.where(F.col("o_orderpriority") != "1-URGENT").select(
        "gene_a", "gene_b", F.round(F.col("o_totalprice") / 500000, 4).alias("score")
    )
    share = F.round(F.col("c_acctbal") / 10000, 4)
    associations = rows.select(
        F.col("gene_a").alias("gene"), disease.alias("disease"), share.alias("score"),
        F.create_map(
            F.lit("literature"), F.lit(0.1), F.lit("genetic_association"), F.lit(0.2)
        ).alias("datatype_scores"),
    )
    checked = graph.validate_triplets(triplets, interactions, associations)
    return checked.groupBy("src", "dst").agg(
        F.count("*").alias("n"),
        *[
            F.first(c).alias(c)
            for c in ("validated", "validation_source", "validation_score", "validation_text")
        ],
    )


@query("graph_upsert", f"""
    with {sql.TRIPLES}, all_edges as (select x_name as src, y_name as dst, display_relation as relationship from triples),
    new as (select upper(c_name) as src, 'PART#' || l_partkey as dst,
        arg_max('ordered in ' || l_returnflag, (l_orderkey, l_linenumber)) as relationship
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      where l_returnflag <> 'N' group by all)
    select src, dst, coalesce(new.relationship, e.relationship) as relationship
    from all_edges e full join new using (src, dst)""")
def graph_upsert(spark, sf_dir):
    """Edges of returned or accepted order lines renamed; the last line of a pair of nodes counts."""
    lines = testbed.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "N")
    new = (
        lines.join(testbed.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(testbed.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.upper("c_name").alias("src"), testbed.part_name("l_partkey").alias("dst"),
            F.concat(F.lit("ordered in "), "l_returnflag").alias("relationship"),
            "l_orderkey", "l_linenumber",
        )
    )
    return graph.upsert_edges(_edges(spark, sf_dir), new, ["l_orderkey", "l_linenumber"])


@query("node_upsert", f"""
    with {sql.TRIPLES}, n as (select x_name as id, x_type as type from triples union select y_name, y_type from triples),
    new as (select 'PART#' || l_partkey as id, arg_max(l_returnflag, (l_orderkey, l_linenumber)) as type
      from lineitem group by all)
    select id, coalesce(new.type, n.type) as type, coalesce(case when new.id is null then lower(n.id) end, 'part') as name
    from n full join new using (id)""")
def node_upsert(spark, sf_dir):
    """Parts typed by the flag of their last order line."""
    new = testbed.table(spark, sf_dir, "lineitem").select(
        testbed.part_name("l_partkey").alias("id"), F.col("l_returnflag").alias("type"),
        F.lit("part").alias("name"), "l_orderkey", "l_linenumber",
    )
    return graph.upsert_nodes(testbed.triple_nodes(_triples(spark, sf_dir)), new, ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- traversal


@query("find_seeds", f"""
    with {sql.TRIPLES}, {EDGES}, nodes as (select src as node from edges union select dst from edges),
    q as (select s_suppkey as query_id, s_name as gene, 'about nation_1 or asia' as query from supplier
      union all select -1 - n_nationkey, n_name || ' gene', 'about ' || n_name || ' or asia' from nation),
    named as (select distinct query_id, node from q join nodes on node = upper(gene)),
    w as (select distinct query_id, unnest(string_split(upper(query), ' ')) as w from q
      where query_id not in (select query_id from named)),
    m as (select distinct query_id, node from w join nodes on contains(upper(node), w))
    select * from named union all
    select query_id, node from (select *, row_number() over (partition by query_id order by node) as r from m) where r <= 5""")
def find_seeds(spark, sf_dir):
    """Suppliers found by name, nations by the words of a question."""
    supplier = testbed.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("gene"),
        F.lit("about nation_1 or asia").alias("query"),
    )
    nation = testbed.table(spark, sf_dir, "nation").select(
        (-1 - F.col("n_nationkey")).cast("long").alias("query_id"),
        F.concat("n_name", F.lit(" gene")).alias("gene"),
        F.concat(F.lit("about "), "n_name", F.lit(" or asia")).alias("query"),
    )
    asked = supplier.unionByName(nation)
    return graph.find_seeds(
        asked.select("query_id", "gene"), asked.select("query_id", "query"),
        testbed.triple_nodes(_triples(spark, sf_dir)),
    )


@query("find_seeds_loose", f"""
    with {sql.TRIPLES}, {EDGES}, nodes as (select src as node from edges union select dst from edges),
    e as (select n_nationkey::bigint as query_id, upper(n_name) as e from nation
      union all select 100 + r_regionkey, upper(r_name) || ' MARKET' from region)
    select distinct query_id, node from e join nodes on contains(upper(node), e) or contains(e, upper(node))""")
def find_seeds_loose(spark, sf_dir):
    asked = testbed.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("entity")
    ).unionByName(
        testbed.table(spark, sf_dir, "region").select(
            (F.col("r_regionkey") + 100).cast("long").alias("query_id"),
            F.concat("r_name", F.lit(" market")).alias("entity"),
        )
    )
    return graph.find_seeds_loose(asked, testbed.triple_nodes(_triples(spark, sf_dir)))


_REACH = f"""
    with recursive {sql.TRIPLES}, {EDGES}, {BOTH}, {SEEDS},
    walk as (select query_id, node, 0 as hop from seeds
      union select w.query_id, b.next, w.hop + 1 from walk w join both_ways b using (node) where w.hop < 2),
    reached as (select query_id, node, min(hop) as hop from walk group by all)"""


@query("graph_expand", f"{_REACH} select query_id, node, hop from reached")
def graph_expand(spark, sf_dir):
    return graph.expand(_seeds(spark, sf_dir), _edges(spark, sf_dir), 2)


@query("graph_distance", f"""{_REACH},
    out as (select query_id, node, 0 as d from seeds
      union select w.query_id, e.dst, w.d + 1 from out w join edges e on e.src = w.node where w.d < 10),
    inn as (select query_id, node, 0 as d from seeds
      union select w.query_id, e.src, w.d + 1 from inn w join edges e on e.dst = w.node where w.d < 10),
    d as (select query_id, node, min(d) as distance from (select * from out union all select * from inn) group by all)
    select query_id, node, coalesce(distance, -1) as distance from reached left join d using (query_id, node)""")
def graph_distance(spark, sf_dir):
    seeds, edges = _seeds(spark, sf_dir), _edges(spark, sf_dir)
    return graph.distance_to_seeds(graph.expand(seeds, edges, 2), seeds, edges)


@query("graph_relevance", f"""{_REACH},
    deg as (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by 1),
    con as (select s.query_id, b.next as node, count(*) as links from seeds s join both_ways b using (node)
      where b.node <> b.next group by all)
    select query_id, node, round(case when seeds.node is not null then 1.0::double
      else least(0.9, 0.3::double + coalesce(links, 0) * 0.2::double + least(coalesce(degree, 0), 10) * 0.02::double) end, 6) as score
    from reached left join deg using (node) left join con using (query_id, node) left join seeds using (query_id, node)""")
def graph_relevance(spark, sf_dir):
    seeds, edges = _seeds(spark, sf_dir), _edges(spark, sf_dir)
    return graph.relevance(graph.expand(seeds, edges, 2), seeds, edges)


@query("graph_paths", f"""
    with recursive {sql.TRIPLES}, e0 as (select x_name as src, y_name as dst, display_relation as relationship from triples),
    edges as (select * from e0 union all
      select upper(n_name), upper(s_name), 'hosts' from nation join supplier on s_nationkey = n_nationkey),
    asked as (select upper(s_name) as source, upper(r_name) as target from supplier, region),
    walk as (select source, target, source as cur, [source] as path, 0 as len, '' as text from asked
      union all select w.source, w.target, e.dst, list_append(w.path, e.dst), w.len + 1,
        w.text || case when w.text = '' then '' else '; ' end || e.src || ' -[' || e.relationship || ']-> ' || e.dst
      from walk w join edges e on e.src = w.cur
      where w.len < 4 and w.cur <> w.target and not list_contains(w.path, e.dst))
    select source, target, text, row_number() over (partition by source, target order by len, path) as rank
    from walk where cur = target""")
def graph_paths(spark, sf_dir):
    """Paths from every supplier to every region."""
    nation = testbed.table(spark, sf_dir, "nation")
    supplier = testbed.table(spark, sf_dir, "supplier")
    hosts = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.upper("n_name").alias("src"), F.upper("s_name").alias("dst"), F.lit("hosts").alias("relationship")
    )
    # the five regions as a list on every supplier row
    regions = testbed.table(spark, sf_dir, "region").agg(F.collect_set(F.upper("r_name"))).scalar()
    asked = supplier.select(
        F.upper("s_name").alias("source"), F.explode(regions).alias("target")
    )
    found = graph.find_paths(asked, _edges(spark, sf_dir).unionByName(hosts))
    return found.select("source", "target", "text", "rank")


@query("graph_neighbours", f"""
    with {sql.TRIPLES}, {EDGES}, {SEEDS}
    select distinct node, 'outgoing' as direction, relationship, dst as neighbour from seeds join edges on src = node
    union all select distinct node, 'incoming', relationship, src from seeds join edges on dst = node""")
def graph_neighbours(spark, sf_dir):
    return graph.neighbours(_seeds(spark, sf_dir), _edges(spark, sf_dir))


# ---------------------------------------------------------------- texts


_CONTEXT = f"""
    nodes as (select x_name as id, x_type as type from triples union select y_name, y_type from triples),
    sides as (select src as node, 0 as way, dst as other, relationship from edges
      union all select dst, 1, src, relationship from edges),
    k as (select *, row_number() over (partition by node, way order by other, relationship) as n from sides),
    ctx as (select id as node, type || ': ' || lower(id) || chr(10)
        || coalesce(chr(10) || 'Relationships:' || chr(10) || string_agg(case when way = 0 then '  → ' || relationship || ' → '
          else '  ← ' || relationship || ' ← ' end || lower(other), chr(10) order by way, n) || chr(10), '')
        || '[Source: Knowledge Graph]' as content
      from nodes left join k on node = id and n <= 10 group by id, type)"""


@query("node_context", f"""
    with {sql.TRIPLES}, {EDGES}, {SEEDS}, {_CONTEXT}
    select distinct node, content from seeds join ctx using (node)""")
def node_context(spark, sf_dir):
    return graph.node_context(
        _seeds(spark, sf_dir), _edges(spark, sf_dir), testbed.triple_nodes(_triples(spark, sf_dir))
    )


@query("graph_search", f"""{_REACH}, {_CONTEXT},
    q as (select query_id, node as gene from seeds),
    deg as (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by 1),
    con as (select s.query_id, b.next as node, count(*) as links from seeds s join both_ways b using (node)
      where b.node <> b.next group by all),
    s as (select query_id, node, hop, round(case when seeds.node is not null then 1.0::double
      else least(0.9, 0.3::double + coalesce(links, 0) * 0.2::double + least(coalesce(degree, 0), 10) * 0.02::double) end, 6) as score
      from reached left join deg using (node) left join con using (query_id, node) left join seeds using (query_id, node)),
    r as (select *, row_number() over (partition by query_id order by score desc, node) as rank from s)
    select query_id, node, hop, score, rank, md5(content) as digest from r join ctx using (node) where rank <= 10""")
def graph_search(spark, sf_dir):
    asked = _seeds(spark, sf_dir)
    found = graph.graph_search(
        asked.select("query_id", F.col("node").alias("gene")),
        asked.select("query_id", F.lower("node").alias("query")),
        _edges(spark, sf_dir), testbed.triple_nodes(_triples(spark, sf_dir)),
    )
    return found.select("query_id", "node", "hop", "score", "rank", F.md5("content").alias("digest"))


_LINES = f"""
    with {sql.TRIPLES}, {EDGES}, {SEEDS},
    sides as (select src as node, 0 as way, dst as other, src || ' --[' || relationship || ']--> ' || dst as line from edges
      union all select dst, 1, src, src || ' --[' || relationship || ']--> ' || dst from edges),
    f as (select query_id, line, min((node, way, other)) as seen from seeds join sides using (node) group by all),
    n as (select query_id, line, row_number() over (partition by query_id order by seen, line) as n from f)"""


@query("graph_context", f"""{_LINES}
    select query_id, '=== [Knowledge Graph Context] ===' || chr(10) || 'Query Genes: ' || any_value(node) || chr(10)
      || 'Extracted Relationships (' || count(*) || '):' || chr(10) || string_agg(line, chr(10) order by n) || chr(10)
      || '[Source: Dynamic Graph RAG]' as content
    from n join seeds using (query_id) where n <= 20 group by query_id""")
def graph_context(spark, sf_dir):
    seeds = _seeds(spark, sf_dir)
    names = seeds.select("query_id", F.array("node").alias("names"))
    return graph.graph_context(seeds, _edges(spark, sf_dir), names)


@query("graph_insights", f"""
    with {sql.TRIPLES}, {EDGES}, {SEEDS},
    l as (select *, src || ' --[' || relationship || ']--> ' || dst as line from edges),
    o as (select query_id, dst as next, line from seeds join l on src = node),
    i as (select query_id, src as next, line from seeds join l on dst = node)
    select query_id, line from o union select query_id, line from i
    union select query_id, l.line from o join l on src = next
    union select query_id, l.line from i join l on dst = next""")
def graph_insights(spark, sf_dir):
    return graph.graph_insights(_seeds(spark, sf_dir), _edges(spark, sf_dir))
