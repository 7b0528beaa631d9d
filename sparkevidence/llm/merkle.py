"""A Merkle manifest of a dataset: a tree for each language, one above them, and proofs by climbing.

A leaf is the sha256 of a document's fields, each framed by its length. The leaves of a language in
order of doc_id are the lowest level of its tree; eight consecutive nodes (the last run: fewer) become
their hash until one is left, the subroot. The subroots in order of language are the leaves of the top
tree, which gives the root. Positions come from a range sort with counts added up over its parts, so no
task holds a language.

Every built level is stored as rows of nodes that name their parent (tree, level, place), their slot in
the parent's run and the hashes of their own run. Proofs come from a recursive query: it starts at the
lowest run of each leaf and goes up by one parent link a step, appends the siblings there and folds the
hash at hand into the run in place of the original, until a node has no parent. The leaves of one run
climb in one row, with a folded hash each, since all siblings above the run are the same for them; what
climbs is then about a tenth of what single leaves would carry.

Defined results: null fields are framed as ``-``; null languages are a tree of their own, ordered before
all others, and the empty name is another; rows without id come first in their tree and are never
tampered with; rows repeated under one id are a leaf each, ordered by hash; a lone leaf is its subroot
and a lone subroot the root, without a sibling (the proof is then the hash of nothing); an empty table
gives no rows. Only the columns of the manifest are read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import pieces, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 8
PART_ROWS = 1_000_000
TOP = -1
#: Settings of the recursive query: no limit on its rows; a tree of 1,000 levels is never reached.
RECURSION = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "1000"}


def digest(*parts: Column) -> Column:
    """The sha256 of strings and arrays of strings, concatenated."""
    return F.sha2(F.concat_ws("", *parts), 256)


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def document_leaf(**changed: Column) -> Column:
    """The leaf of a row of documents; ``changed`` replaces fields by name."""
    return digest(*[framed(changed.get(c, F.col(c))) for c in FIELDS])


def lowered_text() -> Column:
    """The text with A-Z lower-cased where 3 divides the crc32 of the id: the tampered copy."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(hit, low).otherwise(F.col("text"))


@dataclass(frozen=True)
class Manifest:
    """``runs``: the lowest runs with their leaves; ``nodes``: all nodes above them; ``root``: a hash."""

    runs: DataFrame
    nodes: DataFrame
    root: str | None


def _positions(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in order, stored, with a growing number ``at``; and the parts that each group takes.

    The second table holds (group, part, own rows, shift), where ``at + shift`` is the place in the group
    of the rows whose number has ``part`` above its lowest 33 bits.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, pieces(rows.count(), PART_ROWS))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()))
    counted = placed.groupBy(group, F.shiftright("at", 33).alias("part")).agg(
        F.count("*").alias("own"), F.min("at").alias("head")
    )
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("head")
    return placed, stored(counted.select(group, "part", "own", shift.alias("shift")))


def _numbered(rows: DataFrame, shifts: DataFrame, group: str) -> DataFrame:
    """Rows of ``_positions`` with their place as ``at`` and the further columns of their group's part."""
    rows = rows.withColumn("part_of", F.shiftright("at", 33))
    same = (F.col("part_of") == F.col("part")) & F.col(group).eqNullSafe(F.col("group_of"))
    met = rows.join(shifts.withColumnRenamed(group, "group_of"), same)
    return met.withColumn("at", F.col("at") + F.col("shift")).drop("part_of", "part", "own", "shift", "group_of")


def _raised(nodes: DataFrame) -> DataFrame:
    """The next level of all trees that have several nodes: (tree, level, at, size, children, hash)."""
    above = nodes.where("size > 1").groupBy(
        "tree", "size", F.floor(F.col("at") / FAN_OUT).alias("place")
    ).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("run"), F.first("level").alias("below"))
    return above.select(
        "tree",
        (F.col("below") + 1).alias("level"),
        F.col("place").alias("at"),
        F.ceil(F.col("size") / FAN_OUT).alias("size"),
        F.col("run.hash").alias("children"),
    ).withColumn("hash", digest(F.col("children")))


def _linked(nodes: DataFrame, trees: int) -> DataFrame:
    """Nodes with the id of their parent, the slot there, and the subroot where they are one."""
    place = F.when(F.col("size") > 1, F.col("at")).otherwise(F.col("tree"))
    level = F.when(F.col("size") > 1, F.col("level") + 1).otherwise(F.lit(1))
    tree = F.when(F.col("size") > 1, F.col("tree")).otherwise(F.lit(TOP).cast("long"))
    rises = (F.col("size") > 1) | ((F.col("tree") != TOP) & F.lit(trees > 1))
    parent = F.struct(tree.alias("tree"), level.alias("level"), F.floor(place / FAN_OUT).alias("at"))
    return nodes.select(
        "*",
        F.struct("tree", "level", "at").alias("id"),
        F.when(rises, parent).alias("parent"),
        F.when(rises, (place % FAN_OUT).cast("int")).alias("slot"),
        F.when((F.col("tree") != TOP) & (F.col("size") == 1), F.col("hash")).alias("subroot"),
    )


def build(leaves: DataFrame) -> Manifest:
    """All levels over (lang, doc_id, leaf, given); ``given`` is the leaf of the copy to be proved."""
    rows = stored(leaves.withColumn("row", F.monotonically_increasing_id()))
    placed, shifts = _positions(rows, "lang", ["doc_id", "leaf", "row"])
    sizes = shifts.groupBy("lang").agg(F.sum("own").alias("size")).withColumn("all", F.lit(0))
    listed, order = _positions(sizes, "all", ["lang"])
    numbered = stored(_numbered(listed, order, "all").select("lang", "size", F.col("at").alias("tree")))
    trees, largest = numbered.agg(F.count("*"), F.max("size")).first()
    if not trees:
        trees, largest = 0, 0
    named = numbered.withColumnRenamed("lang", "name")
    shifts = shifts.join(named, F.col("lang").eqNullSafe(F.col("name"))).drop("name")
    members = F.array_sort(F.collect_list(F.struct("at", "doc_id", "leaf", "given")))
    lone = F.col("size") == 1
    runs = stored(
        _numbered(placed, stored(shifts), "lang")
        .groupBy("tree", "size", F.floor(F.col("at") / FAN_OUT).alias("place"))
        .agg(members.alias("members"))
        .select(
            "tree",
            F.when(lone, 0).otherwise(1).alias("level"),
            F.col("place").alias("at"),
            F.ceil(F.col("size") / FAN_OUT).alias("size"),
            lone.alias("lone"),
            "members",
            F.when(lone, F.col("members")[0]["leaf"]).otherwise(digest(F.col("members.leaf"))).alias("hash"),
        )
    )
    plain = ["tree", "level", "at", "size", "hash"]
    bottom = runs.select(*plain)
    levels, ends, size = [], [bottom], -(-largest // FAN_OUT)
    while size > 1:
        levels.append(stored(_raised(ends[-1])))
        ends.append(levels[-1].select(*plain))
        size = -(-size // FAN_OUT)
    if trees > 1:
        subroots = [x.where("size = 1") for x in ends]
        top = subroots[0]
        for more in subroots[1:]:
            top = top.union(more)
        top = top.select(
            F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("at"),
            F.lit(trees).cast("long").alias("size"), "hash",
        )
        size = trees
        while size > 1:
            levels.append(stored(_raised(top)))
            top = levels[-1].select(*plain)
            size = -(-size // FAN_OUT)
    nodes = bottom.where("false").withColumn("children", F.array().cast("array<string>"))
    for level in levels:
        nodes = nodes.unionByName(level)
    nodes, runs = _linked(nodes, trees), _linked(runs, trees)
    ends = nodes.select("parent", "hash").union(runs.select("parent", "hash")).where("parent is null")
    root = ends.first()
    return Manifest(runs, nodes, root and root["hash"])


CLIMB = """
with recursive climb(run, parent, slot, subroot, folded, proof) as (
  select struct(tree, at), parent, slot, subroot, folded, cast(array() as array<string>) from {anchors}
  union all
  select c.run, n.parent, n.slot, coalesce(c.subroot, n.subroot),
         transform(c.folded, x -> sha2(concat_ws('', slice(n.children, 1, c.slot), x,
                                                 slice(n.children, c.slot + 2, {fan_out})), 256)),
         concat(c.proof, slice(n.children, 1, c.slot), slice(n.children, c.slot + 2, {fan_out}))
  from climb c join {nodes} n on c.parent = n.id)
select run, subroot, folded, proof from climb where parent is null
"""


def _climbed(manifest: Manifest) -> DataFrame:
    """(run, subroot, folded, proof) of each lowest run: what its leaves come to at the root."""
    spark = manifest.runs.sparkSession
    own, others = F.col("members.leaf"), F.col("members.given")
    into = F.transform(
        others,
        lambda x, i: digest(F.slice(own, F.lit(1), i), x, F.slice(own, i + 2, F.lit(FAN_OUT))),
    )
    anchors = manifest.runs.withColumn("folded", F.when(F.col("lone"), others).otherwise(into))
    before = {k: spark.conf.get(k) for k in RECURSION}
    for k, v in RECURSION.items():
        spark.conf.set(k, v)
    try:
        return stored(spark.sql(CLIMB, anchors=anchors, nodes=manifest.nodes, fan_out=FAN_OUT))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def prove(manifest: Manifest) -> DataFrame:
    """For each leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    climbed = _climbed(manifest)
    met = manifest.runs.withColumn("run", F.struct("tree", "at")).select("run", "members").join(climbed, "run")
    each = met.select("*", F.posexplode("members").alias("slot", "own"))
    leaves = F.col("members.leaf")
    beside = [F.slice(leaves, F.lit(1), F.col("slot")), F.slice(leaves, F.col("slot") + 2, F.lit(FAN_OUT))]
    return each.select(
        F.col("own.doc_id").alias("doc_id"),
        F.col("own.leaf").alias("leaf"),
        "subroot",
        F.lit(manifest.root).alias("root"),
        digest(*beside, F.col("proof")).alias("proof_sha256"),
        F.col("folded")[F.col("slot")].alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame) -> Manifest:
    """The manifest of documents, with the tampered copies to be proved."""
    return build(
        docs.select("lang", "doc_id", document_leaf().alias("leaf"), document_leaf(text=lowered_text()).alias("given"))
    )
