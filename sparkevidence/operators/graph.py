"""The graph of extracted triplets: building, expansion, distances, paths and its texts.

Edges are rows (src, dst, relationship). Breadth-first levels keep, for each reached node, bit sets of
the questions that reached it, and join them with the edges once for all questions; hub nodes are
spread like any other rows, every level drops what is known already and is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..config import DEFAULTS, DISEASE_KEYWORDS, Settings
from ..functions.common import contains_any
from ..functions.outputs import parse_triplets
from ..functions.text import is_gene_like
from .entities import common_alias, normalize_names
from .grams import substring_join
from .scale import broadcast_if_small, cut_lineage
from .topk import limited_rows, top_k


# ---------------------------------------------------------------- building


def triplets_of(raw: DataFrame) -> DataFrame:
    """(query_id, doc_id, pos, subject, relation, object) of stored extraction outputs (raw)."""
    return raw.select("query_id", "doc_id", F.explode(parse_triplets("raw")).alias("t")).select(
        "query_id", "doc_id", "t.pos", "t.subject", "t.relation", "t.object"
    )


def normalize_triplets(triplets: DataFrame, alias_table: DataFrame | None = None) -> DataFrame:
    """Subjects and objects under their official names, each distinct name looked up once."""
    if alias_table is None:
        return triplets.withColumns({
            "src": F.coalesce(common_alias("subject"), F.upper("subject")),
            "dst": F.coalesce(common_alias("object"), F.upper("object")),
        })
    names = (
        triplets.select(F.col("subject").alias("name"))
        .unionByName(triplets.select(F.col("object").alias("name")))
        .distinct()
    )
    table = normalize_names(names, alias_table)
    left = table.select(F.col("name").alias("subject"), F.col("normal").alias("src"))
    right = table.select(F.col("name").alias("object"), F.col("normal").alias("dst"))
    return triplets.join(left, "subject").join(right, "object")


def build_graph(
    triplets: DataFrame, alias_table: DataFrame | None = None, by: tuple[str, ...] = (),
    drop_loops: bool = False,
) -> DataFrame:
    """One edge for each (src, dst); the last triplet names it. ``by`` keeps graphs apart."""
    normal = normalize_triplets(triplets, alias_table)
    if drop_loops:
        normal = normal.where(F.col("src") != F.col("dst"))
    return last_edges(normal, "relation", by, [c for c in ("doc_id", "pos") if c in normal.columns])


def last_edges(
    rows: DataFrame, relation: str, by: tuple[str, ...] = (), order: list[str] | None = None
) -> DataFrame:
    position = F.struct(*(order or ["pos"]), relation)
    return rows.groupBy(*by, "src", "dst").agg(F.max_by(relation, position).alias("relationship"))


def nodes_of(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that occur in edges, as plain entities."""
    ends = edges.select(*by, F.col("src").alias("id")).unionByName(
        edges.select(*by, F.col("dst").alias("id"))
    )
    return ends.distinct().withColumns({"type": F.lit("Entity"), "name": F.col("id")})


def _upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace stored ones with the same keys; of several new ones the last in order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    last = [F.desc("_new"), *[F.desc_nulls_last(c) for c in order]]
    extra = [c for c in order if c not in old.columns]
    return top_k(both, 1, keys, last, "_n").drop("_n", "_new", *extra)


def upsert_nodes(nodes: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add nodes; the last new row for an id, by the ``order`` columns, replaces the stored one.

    Without ``order`` the greatest values of the other columns win, so that results repeat.
    """
    return _upsert(nodes, new, ["id"], order or [c for c in new.columns if c != "id"])


def upsert_edges(edges: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add edges; the last new row between two nodes, by ``order``, replaces the stored one."""
    rest = [c for c in new.columns if c not in ("src", "dst")]
    return _upsert(edges, new, ["src", "dst"], order or rest)


# ---------------------------------------------------------------- validation



def validate_triplets(
    triplets: DataFrame,
    interactions: DataFrame,
    associations: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Normalised triplets (src, relation, dst) with ``validated``, ``source``, score and text.

    Gene pairs are looked up in ``interactions`` (gene_a, gene_b, score) in either order; what that
    does not settle and looks like gene and disease is looked up in ``associations``
    (gene, disease, score, datatype_scores). Both tables are reduced to one row for each key first.
    """
    pairs = interactions.groupBy(
        F.least(F.upper("gene_a"), F.upper("gene_b")).alias("lo"),
        F.greatest(F.upper("gene_a"), F.upper("gene_b")).alias("hi"),
    ).agg(F.max("score").alias("pair_score"))
    top = F.array_sort(
        F.transform(
            F.map_entries("datatype_scores"),
            lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("key")),
        )
    )
    evidence = F.when(
        F.size(top) > 0, F.initcap(F.replace(F.get(top, F.lit(0))["key"], F.lit("_"), F.lit(" ")))
    ).otherwise("N/A")
    diseases = (
        associations.withColumn("top_evidence", evidence)
        .groupBy(F.upper("gene").alias("s"), F.upper("disease").alias("o"))
        .agg(
            F.max("score").alias("assoc_score"),
            F.max_by("top_evidence", "score").alias("top_evidence"),
        )
    )
    s, o = F.upper("src"), F.upper("dst")
    rows = (
        triplets.withColumn("s", s)
        .withColumn("o", o)
        .withColumn("lo", F.least("s", "o"))
        .withColumn("hi", F.greatest("s", "o"))
        .join(pairs, ["lo", "hi"], "left")
        .join(diseases, ["s", "o"], "left")
    )
    by_pair = (
        is_gene_like("s") & is_gene_like("o")
        & (F.col("pair_score") >= settings.interaction_threshold)
    )
    by_disease = (
        is_gene_like("s") & contains_any(F.col("o"), DISEASE_KEYWORDS)
        & (F.col("assoc_score") >= settings.association_threshold)
    )
    by_pair, by_disease = F.coalesce(by_pair, F.lit(False)), F.coalesce(by_disease, F.lit(False))
    grade = F.when(F.col("assoc_score") > settings.association_high, "High").otherwise("Moderate")
    text = F.concat(
        F.lit("OT Validation: "), "s", F.lit("-"), "dst", F.lit(" (Score: "),
        F.round("assoc_score", 2).cast("decimal(10,2)").cast("string"), F.lit(", "), grade,
        F.lit(", Top Evidence: "), "top_evidence", F.lit(")"),
    )
    return rows.select(
        *triplets.columns,
        (by_pair | by_disease).alias("validated"),
        F.when(by_pair, "STRING").when(by_disease, "OpenTargets").alias("validation_source"),
        F.when(by_pair, F.col("pair_score")).when(by_disease, F.col("assoc_score")).otherwise(0.0)
        .alias("validation_score"),
        F.when(~by_pair & by_disease, text).alias("validation_text"),
    )


def gold_lines(validated: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, gold): up to three distinct association texts of each question, first seen first."""
    texts = validated.where(F.col("validation_text").isNotNull())
    first = texts.groupBy("query_id", "validation_text").agg(
        F.min(F.struct("doc_id", "pos")).alias("seen")
    )
    kept = top_k(first, limit, ["query_id"], [F.asc("seen")], "n")
    return kept.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("n", "validation_text"))),
                lambda r: F.concat(F.lit("- "), r["validation_text"]),
            ),
            "\n",
        ).alias("gold")
    )


# ---------------------------------------------------------------- seeds and expansion


def find_seeds(
    genes: DataFrame, queries: DataFrame, nodes: DataFrame, limit: int = 5
) -> DataFrame:
    """(query_id, node): nodes named by the question's genes, else nodes its words occur in.

    ``genes`` is (query_id, gene), ``queries`` is (query_id, query), ``nodes`` has ``id``.
    """
    ids = nodes.select(F.col("id").alias("node")).distinct()
    upper = genes.select("query_id", F.upper("gene").alias("node"), F.upper("gene").alias("g"))
    lower = genes.select("query_id", F.lower("gene").alias("node"), F.upper("gene").alias("g"))
    exact = upper.join(ids, "node", "left_semi")
    second = lower.join(ids, "node", "left_semi").join(
        exact.select("query_id", "g"), ["query_id", "g"], "left_anti"
    )
    named = exact.unionByName(second).select("query_id", "node").distinct()

    words = (
        queries.join(named.select("query_id").distinct(), "query_id", "left_anti")
        .select("query_id", F.explode(F.array_distinct(F.split(F.upper("query"), r"\s+"))).alias("w"))
        .where(F.col("w") != "")
    )
    tall = ids.withColumn("tall", F.upper("node"))
    # the first nodes of a question are among the first nodes of its words
    by_word = top_k(
        substring_join(words, "w", tall, "tall").join(tall, "tall"),
        limit, ["w"], [F.asc("node")], "n",
    ).select("w", "node")
    matched = words.join(by_word, "w").select("query_id", "node").distinct()
    kept = top_k(matched, limit, ["query_id"], [F.asc("node")], "n").select("query_id", "node")
    return named.unionByName(kept)


def find_seeds_loose(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node): nodes that contain an entity of the question or are contained in one."""
    asked = entities.select("query_id", F.upper("entity").alias("e")).distinct()
    tall = nodes.select(F.col("id").alias("node"), F.upper("id").alias("tall")).distinct()
    inside = substring_join(asked, "e", tall, "tall")
    around = substring_join(tall, "tall", asked, "e").select("e", "tall")
    hits = inside.unionByName(around).distinct()
    return asked.join(hits, "e").join(tall, "tall").select("query_id", "node").distinct()


def _outward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))


def _inward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))


def both_ways(edges: DataFrame) -> DataFrame:
    return _outward(edges).unionByName(_inward(edges)).distinct()


#: Questions of one bit set: the bits of a long.
_BITS = 6


def _as_bits(rows: DataFrame) -> DataFrame:
    """(node, part, mask) of rows (query_id, node): 64 questions to a bit set.

    Question q is bit q mod 64 of part q div 64, so the ids need no numbering; runs of ids share sets.
    """
    query = F.col("query_id").cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit_of(query))
    return (
        rows.where(query.isNotNull() & F.col("node").isNotNull())
        .groupBy("node", F.shiftright(query, _BITS).alias("part"))
        .agg(F.bit_or(one).alias("mask"))
    )


def _target_bits(rows: DataFrame) -> DataFrame:
    """``_as_bits`` that keeps rows without a question, as a set without ``part``, or without a node."""
    query = F.col("query_id").cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit_of(query))
    return rows.groupBy("node", F.shiftright(query, _BITS).alias("part")).agg(
        F.coalesce(F.bit_or(one), F.lit(0).cast("long")).alias("mask")
    )


def _has_bit(mask: Column, bit: Column) -> Column:
    return F.call_function("shiftright", mask, bit).bitwiseAND(1) == 1


def _bit_of(query: Column) -> Column:
    return query.cast("long").bitwiseAND((1 << _BITS) - 1).cast("int")


def _from_bits(rows: DataFrame, kind: DataType) -> DataFrame:
    """(query_id, node, ...) of rows (node, part, mask, ...)."""
    set_bits = F.filter(
        F.sequence(F.lit(0), F.lit((1 << _BITS) - 1)), lambda i: _has_bit(F.col("mask"), i)
    )
    bits = F.when(F.col("part").isNull(), F.array(F.lit(0))).otherwise(set_bits)
    query = (F.call_function("shiftleft", F.col("part"), F.lit(_BITS)) + F.col("bit")).cast(kind)
    rest = [c for c in rows.columns if c not in ("node", "part", "mask")]
    return rows.withColumn("bit", F.explode(bits)).select(query.alias("query_id"), "node", *rest)


def _step(frontier: DataFrame, links: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, part, mask): what all questions reach with one more step and did not reach before.

    New and known bits meet in one aggregation. Its partial sums put the sets of a node together
    before they move, so a node with very many links sends one row from each task.
    """
    none = F.lit(0).cast("long")
    new = frontier.join(links, "node").select(
        F.col("next").alias("node"), "part", F.col("mask").alias("new"), none.alias("old")
    )
    old = reached.select("node", "part", none.alias("new"), F.col("mask").alias("old"))
    left = F.bit_or("new").bitwiseAND(F.bitwise_not(F.bit_or("old")))
    return new.unionByName(old).groupBy("node", "part").agg(left.alias("mask")).where("mask <> 0")


#: Bit sets that a task of a search takes apart.
SEARCH_ROWS = 1 << 18
#: Levels whose tables are read one by one before they are put together.
KEPT_LEVELS = 8


def _levels(seeds: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, part, mask, hop): steps from the nearest seed, for at most ``most`` steps.

    A level is one join of the links with the frontier of all questions at once, and a table of its
    own, so what was reached is not written again with every level. Repeated links do no harm.
    """
    first = cut_lineage(_as_bits(seeds))
    frontier, reached, level = first, first.withColumn("hop", F.lit(0)), 0
    while level != most:
        level += 1
        frontier = cut_lineage(_step(frontier, links, reached))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hop", F.lit(level)))
        if level % KEPT_LEVELS == 0:
            reached = cut_lineage(reached)
    return reached


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(query_id, node, hop): nodes within ``hops`` steps of the seeds, direction ignored.

    ``query_id`` is a whole number. Seeds without a question or a node take no part.
    """
    reached = _levels(seeds, _outward(edges).unionByName(_inward(edges)), hops)
    return _from_bits(reached, seeds.schema["query_id"].dataType)


def distance_to_seeds(targets: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node, distance): shortest directed path from or to any seed; -1 without one.

    Targets and levels meet as bit sets, one row for a node and 64 questions, which are taken apart
    when every node has its distances.
    """
    levels = _levels(seeds, _outward(edges)).unionByName(_levels(seeds, _inward(edges)))
    wanted = _target_bits(targets).withColumn("hop", F.lit(None).cast("int"))
    met = (
        wanted.unionByName(levels.where("node is not null"))
        .groupBy("node", "part")
        .agg(
            F.max(F.when(F.col("hop").isNull(), F.col("mask"))).alias("own"),
            F.collect_list(F.when(F.col("hop").isNotNull(), F.struct("hop", "mask"))).alias("levels"),
        )
        .where("own is not null")
        .withColumnRenamed("own", "mask")
    )
    bit = _bit_of(F.col("query_id"))
    hops = F.transform(F.filter("levels", lambda x: _has_bit(x["mask"], bit)), lambda x: x["hop"])
    return _from_bits(met, targets.schema["query_id"].dataType).select(
        "query_id", "node", F.coalesce(F.array_min(hops), F.lit(-1)).alias("distance")
    )


def relevance(targets: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node, score): 1 for a seed, else by links to seeds and by degree."""
    kind = targets.schema["query_id"].dataType
    return _scores(_from_bits(_with_links(_target_bits(targets), seeds, edges), kind)).select(
        "query_id", "node", "score"
    )


def _with_links(targets: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, part, mask, ...) with what their scores need: the node's ``degree``, ``is_seed`` as a
    bit set and the number of ``links`` to seeds by bit.

    Only links of seeds are told apart from repeated ones, and nothing is written out for each question.
    """
    asked = seeds.where("query_id is not null and node is not null")
    around = _outward(edges).unionByName(_inward(edges)).where(F.col("node") != F.col("next"))
    links = around.join(broadcast_if_small(asked.select("node").distinct()), "node", "left_semi").distinct()
    counts = (
        asked.select("query_id", "node")
        .join(links, "node")
        .groupBy("query_id", F.col("next").alias("node"))
        .agg(F.count("*").alias("links"))
    )
    query = F.col("query_id").cast("long")
    part = F.shiftright(query, _BITS).alias("part")
    none = F.lit(0).cast("long")
    entry = F.struct(_bit_of(query).alias("bit"), "links")
    known = (
        counts.select("node", part, none.alias("own"), entry.alias("entry"))
        .unionByName(_as_bits(asked).withColumnRenamed("mask", "own"), allowMissingColumns=True)
        .groupBy("node", "part")
        .agg(F.bit_or("own").alias("is_seed"), F.map_from_entries(F.collect_list("entry")).alias("links"))
    )
    ends = edges.select(F.col("src").alias("node")).unionByName(
        edges.select(F.col("dst").alias("node"))
    )
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return targets.join(known, ["node", "part"], "left").join(degree, "node", "left")


def _scores(rows: DataFrame) -> DataFrame:
    """Add ``score`` to rows (query_id, node, degree, is_seed, links)."""
    bit = _bit_of(F.col("query_id"))
    links_n = F.coalesce(F.try_element_at("links", bit), F.lit(0))
    degree_n = F.coalesce("degree", F.lit(0))
    score = F.least(
        F.lit(0.9), 0.3 + links_n * 0.2 + F.least(degree_n, F.lit(10)) * 0.02
    )
    return rows.withColumn(
        "score", F.round(F.when(_has_bit(F.col("is_seed"), bit), 1.0).otherwise(score), 6)
    )


# ---------------------------------------------------------------- paths and neighbours


def _walks(starts: DataFrame, links: DataFrame, steps: int, forward: bool) -> list[DataFrame]:
    """Simple walks of 1 to ``steps`` steps from, or with ``forward`` false to, the given nodes.

    Each is (end, at, path, relations): ``path`` holds its nodes in the direction of the edges, with
    ``end`` at one side and ``at`` at the other.
    """
    walks = starts.select(
        "end", F.col("end").alias("at"), F.array("end").alias("path"),
        F.array().cast("array<string>").alias("relations"),
    )
    out = []
    for _ in range(steps):
        node, name = F.array("next"), F.array("relationship")
        grown = walks.join(links, "at").where(~F.array_contains("path", F.col("next")))
        walks = cut_lineage(grown.select(
            "end", F.col("next").alias("at"),
            (F.concat("path", node) if forward else F.concat(node, "path")).alias("path"),
            (F.concat("relations", name) if forward else F.concat(name, "relations")).alias("relations"),
        ))
        out.append(walks)
    return out


def _middles(ahead: DataFrame, behind: DataFrame | None) -> DataFrame:
    """Simple walks (a, b, path, relations) between different nodes, halves that meet put together."""
    if behind is None:
        return ahead.where(F.col("end") != F.col("at")).select(
            F.col("end").alias("a"), F.col("at").alias("b"), "path", "relations"
        )
    rest = behind.select(
        F.col("end").alias("b"), "at", F.col("path").alias("tail"), F.col("relations").alias("more")
    )
    head = F.slice("path", F.lit(1), F.size("path") - 1)
    return ahead.withColumnRenamed("end", "a").join(rest, "at").where(
        (F.col("a") != F.col("b")) & ~F.arrays_overlap(head, F.col("tail"))
    ).select("a", "b", F.concat(head, "tail").alias("path"), F.concat("relations", "more").alias("relations"))


def find_paths(
    pairs: DataFrame, edges: DataFrame, max_length: int = 4, limit: int = 10
) -> DataFrame:
    """(source, target, rank, path, text): the first simple directed paths between two nodes.

    Shorter paths come first, equal ones by their nodes. The first and the last edge of a path are looked
    up for each pair; what lies between them is found once for all pairs, as walks from a node after
    some source to a node before some target that meet in the middle. So sources that share a neighbour
    share its walks, and a walk that comes back is dropped before it meets any pair. A pair that has its
    paths is not searched further.
    """
    asked = pairs.select("source", "target").where(F.col("source") != F.col("target")).distinct()
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), "relationship")
    into = edges.select(F.col("dst").alias("at"), F.col("src").alias("next"), "relationship")
    ends = lambda c: asked.select(F.col(c).alias("at")).distinct()
    first = cut_lineage(out.join(ends("source"), "at", "left_semi").where("at <> next").select(
        F.col("at").alias("source"), F.col("next").alias("a"), F.col("relationship").alias("opens")
    ))
    last = cut_lineage(into.join(ends("target"), "at", "left_semi").where("at <> next").select(
        F.col("at").alias("target"), F.col("next").alias("b"), F.col("relationship").alias("closes")
    ))
    inner = max_length - 2
    ahead = _walks(first.select(F.col("a").alias("end")).distinct(), out, (inner + 1) // 2, True)
    behind = _walks(last.select(F.col("b").alias("end")).distinct(), into, inner // 2, False)
    done, open_pairs = None, asked
    for length in range(1, max_length + 1):
        if length == 1:
            met = open_pairs.join(first, "source").where(F.col("a") == F.col("target")).select(
                "source", "target", F.array("source", "target").alias("path"), F.array("opens").alias("relations")
            )
        else:
            if length == 2:
                tails = last.select(
                    F.col("b").alias("a"), "target", F.array("b", "target").alias("tail"), F.array("closes").alias("more")
                )
            else:
                steps = length - 2
                between = _middles(ahead[(steps + 1) // 2 - 1], behind[steps // 2 - 1] if steps > 1 else None)
                tails = between.join(last, "b").where(~F.array_contains("path", F.col("target"))).select(
                    "a", "target", F.concat("path", F.array("target")).alias("tail"),
                    F.concat("relations", F.array("closes")).alias("more"),
                )
            met = open_pairs.join(first, "source").join(tails, ["a", "target"]).where(
                ~F.array_contains("tail", F.col("source"))
            ).select(
                "source", "target", F.concat(F.array("source"), "tail").alias("path"),
                F.concat(F.array("opens"), "more").alias("relations"),
            )
        hit = cut_lineage(top_k(met, limit, ["source", "target"], [F.asc("path")], "n").drop("n"))
        done = hit if done is None else done.unionByName(hit)
        full = done.groupBy("source", "target").agg(F.count("*").alias("c")).where(F.col("c") >= limit)
        open_pairs = asked.join(full.select("source", "target"), ["source", "target"], "left_anti")
    text = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.size("relations")),
            lambda i: F.concat(
                F.element_at("path", i), F.lit(" -["), F.element_at("relations", i), F.lit("]-> "),
                F.element_at("path", i + 1),
            ),
        ),
        "; ",
    )
    return top_k(
        done, limit, ["source", "target"], [F.asc(F.size("path")), F.asc("path")]
    ).withColumn("text", text)


def _sides(edges: DataFrame) -> DataFrame:
    """Every edge seen from both of its ends."""
    out = edges.select(
        F.col("src").alias("node"), F.lit("outgoing").alias("direction"), "relationship",
        F.col("dst").alias("neighbour"),
    )
    into = edges.select(
        F.col("dst").alias("node"), F.lit("incoming").alias("direction"), "relationship",
        F.col("src").alias("neighbour"),
    )
    return out.unionByName(into)


def neighbours(nodes: DataFrame, edges: DataFrame, relationship: str | None = None) -> DataFrame:
    """(node, direction, relationship, neighbour) for each wanted node."""
    kept = edges if relationship is None else edges.where(F.col("relationship") == relationship)
    return _sides(kept).join(nodes.select("node").distinct(), "node")


# ---------------------------------------------------------------- texts


def node_context(targets: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(node, content): type, name and the first ten relations each way."""
    asked = targets.select("node").distinct()
    kept = limited_rows(
        _sides(edges), asked, "node", ["node", "direction"],
        [F.asc("neighbour"), F.asc("relationship")], limit, "n",
    )
    names = nodes.select(F.col("id").alias("neighbour"), F.col("name").alias("neighbour_name"))
    shown = F.coalesce("neighbour_name", "neighbour")
    text = F.when(
        F.col("direction") == "outgoing",
        F.concat(F.lit("  → "), "relationship", F.lit(" → "), shown),
    ).otherwise(F.concat(F.lit("  ← "), "relationship", F.lit(" ← "), shown))
    lines = (
        kept.join(names, "neighbour", "left")
        .select(
            "node",
            F.struct(
                (F.col("direction") == "incoming").alias("second"), "n", text.alias("text")
            ).alias("row"),
        )
        .groupBy("node")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
    )
    info = nodes.select(
        F.col("id").alias("node"), F.coalesce("type", F.lit("Entity")).alias("node_type"),
        F.coalesce("name", "id").alias("node_name"),
    )
    relations = F.concat(
        F.lit("\nRelationships:\n"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    )
    content = F.concat_ws(
        "\n",
        F.concat("node_type", F.lit(": "), "node_name"),
        relations,
        F.lit("[Source: Knowledge Graph]"),
    )
    return asked.join(info, "node").join(lines, "node", "left").select("node", content.alias("content"))


def graph_search(
    genes: DataFrame, queries: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 2,
    k: int = 10,
) -> DataFrame:
    """Nodes around the seeds of each question, scored, with their texts."""
    nodes = cut_lineage(nodes)  # read several times below
    seeds = cut_lineage(find_seeds(genes, queries, nodes))
    reached = _levels(seeds, _outward(edges).unionByName(_inward(edges)), hops)
    # a row becomes up to 64 ones, which are sorted in the task
    tasks = -(-reached.count() // SEARCH_ROWS)
    linked = _with_links(reached, seeds, edges).repartition(max(tasks, 1))
    scored = _scores(_from_bits(linked, seeds.schema["query_id"].dataType)).select(
        "query_id", "node", "score", "hop"
    )
    best = cut_lineage(top_k(scored, k, ["query_id"], [F.desc("score"), F.asc("node")]))
    return best.join(node_context(best, edges, nodes), "node")


def graph_lines(seeds: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, n, line): relations at the seeds of each question, each line once.

    ``edges`` may hold a graph for each question (with ``query_id``) or one for all.
    """
    own = "query_id" in edges.columns
    keys = ["query_id", "node"] if own else ["node"]
    line = F.concat("src", F.lit(" --["), "relationship", F.lit("]--> "), "dst").alias("line")
    ids = ["query_id"] if own else []
    out = edges.select(
        *ids, F.col("src").alias("node"), F.lit(0).alias("way"), F.col("dst").alias("other"), line
    )
    into = edges.select(
        *ids, F.col("dst").alias("node"), F.lit(1).alias("way"), F.col("src").alias("other"), line
    )
    sides = out.unionByName(into)
    if not own:
        # a node adds at most ``limit`` lines to any question
        sides = limited_rows(
            sides, seeds, "node", ["node"], [F.asc("way"), F.asc("other"), F.asc("line")], 2 * limit
        ).drop("_n")
    found = seeds.select("query_id", "node").distinct().join(sides, keys)
    first = found.groupBy("query_id", "line").agg(
        F.min(F.struct("node", "way", "other")).alias("seen")
    )
    return top_k(first, limit, ["query_id"], [F.asc("seen"), F.asc("line")], "n").drop("seen")


def graph_context(
    seeds: DataFrame, edges: DataFrame, names: DataFrame, gold: DataFrame | None = None,
    limit: int = 20,
) -> DataFrame:
    """(query_id, content) from the lines of each question; ``names`` is (query_id, names array)."""
    lines = graph_lines(seeds, edges, limit).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows")
    )
    content = F.concat(
        F.lit("=== [Knowledge Graph Context] ===\nQuery Genes: "),
        F.array_join("names", ", "),
        F.lit("\nExtracted Relationships ("), F.size("rows").cast("string"), F.lit("):\n"),
        F.array_join(F.transform("rows", lambda r: r["line"]), "\n"),
        F.lit("\n[Source: Dynamic Graph RAG]"),
    )
    out = lines.join(names, "query_id").withColumn("content", content)
    if gold is not None:
        out = out.join(gold, "query_id", "left").withColumn(
            "content",
            F.concat(
                "content",
                F.coalesce(
                    F.concat(F.lit("\n\n[Gold Standard Validation (Open Targets)]\n"), "gold"),
                    F.lit(""),
                ),
            ),
        )
    return out.select("query_id", "content")


def graph_insights(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, line): all distinct relations up to two directed steps from the seeds."""
    line = F.concat("src", F.lit(" --["), "relationship", F.lit("]--> "), "dst")
    out = edges.select(
        F.col("src").alias("node"), F.col("dst").alias("next"), line.alias("line")
    )
    into = edges.select(
        F.col("dst").alias("node"), F.col("src").alias("next"), line.alias("line")
    )
    parts = []
    for links in (out, into):
        first = seeds.select("query_id", "node").distinct().join(links, "node")
        parts.append(first.select("query_id", "line"))
        if depth > 1:
            second = first.select("query_id", F.col("next").alias("node")).distinct().join(
                links, "node"
            )
            parts.append(second.select("query_id", "line"))
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more)
    return merged.distinct()
