"""Jaccard join of documents by their word shingles.

``near_groups`` and ``keep_first`` need the connected components of the links, found by the
metric-space join below; its search leaves out documents that links already connect, so a large
group of near copies costs one distance each.

``near_duplicates`` and ``linked_classes`` are a listing beside it, for callers that want every link
or the number of links: candidates are the pairs that sizes and the number of shared prefix shingles
(step 2) leave, and each one is verified. A group of k near copies with different texts has up to
k(k-1)/2 links, and as many are compared and stored; no query or pipeline stage calls them.

The Jaccard distance of shingle sets is a metric. Two documents link at a distance of at most
``RADIUS`` (1 - 0.75). The steps:

1. Each text gives its set of ``SHINGLE``-word shingles. Documents with equal sets are one class,
   held by the smallest id.
2. Coarse regions. A single shingle is a pivot too: its nearest documents are those that hold it.
   Linked documents share at least m of the first n - ceil(0.75 n) + m shingles of each set in any
   fixed order; m is a tenth of n (one at least, and one less is asked for, against rounding). So
   documents with fewer shared ones among those link with nothing and go, as do all copies of a
   class but the one that holds it. The order puts shingles that a sample of
   ``SAMPLE_DOCS`` documents shows to be frequent last, else it goes by hash; the sample decides
   about cost only. For the others all shingles are counted: those that share fewer than 0.75 n go,
   which is repeated as long as a tenth of them goes, and the rest are replicated into the regions of
   their rarest shared ones. Linked sets differ in size by a third at most, so regions are cut into bands of
   sizes, each with the next smaller one. A document leaves a region in which nothing is small
   enough to link with what it shares from there on. Regions with the same members are joined once.
3. Voronoi recursion. In each region documents become pivots, and every member's exact distance to
   them is computed. Members go to the cell of the nearest pivot; those at the boundary, with a
   distance to another cell's pivot of at most 2 radii more, are replicated into that cell. A cell
   is a region of the next round; a region whose cells would hold ``SPLIT_LIMIT`` times its members
   is no set of cells (nearly all distances are alike) and is not split. Documents that links already connect need no comparison: the
   members that are not connected with the cell's most common component stay, and of the others
   those whose distance to the pivot is within a radius of theirs (triangle inequality). The number
   of pivots grows ``PIVOT_GROWTH`` times each round. Pivots leave their region, so the recursion ends.
4. Regions with few unconnected members, ``CLOSE_OWN`` for each pivot they had, are closed if they were not
   split or these and all members make at most ``CLOSE_PAIRS`` pairs: the unconnected members meet all
   of other components. A set's parity of ``PARITY_BITS`` hashed places differs from another's in no more places
   than the sets differ in shingles, so only pairs whose parities differ in few enough places to link leave
   the join, and only for those are sets moved. Larger regions are dealt in parts of ``CLOSE_PAIRS`` pairs.
   A region with more of them gets its pivots first, without the ones it had, as these connect what can be.
5. Links give connected components.

No other pairs than these and those of members with pivots are formed. No step of the recursion gathers a region: counts and minima are partial
sums, and joins on a hot region or pivot have one row on the other side, which adaptive execution can split.

Defined results: a null or empty text has an empty set and links with nothing; rows without an id
take no part and have component null; rows repeated under one id are one document; an empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import broadcast_if_small
from .components import components
from .tables import stored
from .words import Words, grams, lists, mix, signed, slices, words_of

SHINGLE = 5
PERCENT = 75
RADIUS = 1 - PERCENT / 100
TENTH = 10
SPLIT_LIMIT = 1.5
PIVOT_GROWTH = 4
CLOSE_OWN = 256
CLOSE_PAIRS = 1 << 24
PARITY_BITS = 1024
RECOUNT_BELOW = 0.9
SAMPLE_DOCS = 10_000
FREQUENT_IN_SAMPLE = 3
FREQUENT_LIMIT = 200_000
_SECOND = np.uint64(0x5851F42D4C957F2D)
_HASH_SPACE = 1 << 30


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all rows, row after row, and the size of each row's set."""
    hashes = words.hashes()
    value, inside = grams(hashes, words.row, size)
    row, value = words.row[: len(value)][inside], value[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):  # the whole sequence is one shingle
        whole = []
        for i in short:
            own = hashes[words.first[i] : words.first[i + 1]]
            whole.append(grams(own, np.zeros(len(own), np.int64), len(own))[0][0])
        whole = mix(np.array(whole, dtype=np.uint64) + words.counts[short].astype(np.uint64))
        row, value = np.concatenate((row, short)), np.concatenate((value, whole))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(row)]
    row, value = row[new], value[new]
    return value, np.bincount(row, minlength=len(words.first) - 1)


def _profiles(frequent):
    """Set size, set hashes and the replicated shingles of each row."""
    kinds = ["doc_id", "n", "key", "more", "prefix"]

    def run(batches):
        last = frequent.value
        for batch in batches:
            for part in slices(batch, "text"):
                value, n = shingle_sets(words_of(part.column("text"), lower=True))
                row = np.repeat(np.arange(len(n)), n)
                with np.errstate(over="ignore"):
                    sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                    np.add.at(sums[0], row, mix(value + np.uint64(1)))
                    np.add.at(sums[1], row, mix(value * _SECOND))
                late = np.isin(value, last) if len(last) else np.zeros(len(value), bool)
                order = np.lexsort((value, late, row))
                place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
                first = np.minimum(n, n - (PERCENT * n + 99) // 100 + np.maximum(1, n // TENTH))
                kept = place < np.repeat(first, n)
                chosen = value[order][kept]
                made = [pa.array(n, pa.int64()), *(pa.array(signed(x)) for x in sums)]
                prefix = lists(signed(chosen), np.where(n > 0, first, 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made, prefix], names=kinds)

    return run


def _shingle_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            value, _ = shingle_sets(words_of(part.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([pa.array(signed(value))], names=["shingle"])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that several documents of a sample hold; at most FREQUENT_LIMIT, most frequent first."""
    total = docs.count()
    share = int(min(1.0, SAMPLE_DOCS / max(total, 1)) * _HASH_SPACE)
    rows = (
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_SPACE)) < share)
        .select("text")
        .mapInArrow(_shingle_rows, "shingle bigint")
        .groupBy("shingle")
        .count()
        .where(F.col("count") >= FREQUENT_IN_SAMPLE)
        .orderBy(F.desc("count"), "shingle")
        .limit(FREQUENT_LIMIT)
        .select("shingle")
        .collect()
    )
    return np.array(sorted(r.shingle for r in rows), dtype=np.int64).view(np.uint64)


def parities(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set, whether an odd number of its shingles fall on each of ``PARITY_BITS`` places, as 64-bit words."""
    words = PARITY_BITS // 64
    place = mix(value) % np.uint64(PARITY_BITS)
    out = np.zeros(len(n) * words, np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    np.bitwise_xor.at(out, row * words + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def _set_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            value, n = shingle_sets(words_of(part.column("text"), lower=True))
            parity = lists(signed(parities(value, n)), np.full(len(n), PARITY_BITS // 64), pa.int64())
            made = [part.column("doc_id"), lists(signed(value), n, pa.int64()), pa.array(n, pa.int64()), parity]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "shingles", "n", "parity"])


@dataclass
class Regions:
    members: DataFrame  # region, doc, own
    sets: DataFrame  # doc_id, shingles, n, parity


def _distinct_regions(members: DataFrame) -> DataFrame:
    """Of regions with the same members (region, doc, own) one, with its numbers of ``all`` and ``owned``
    members; regions of one document go."""
    distinct = (
        members.groupBy("region")
        .agg(
            F.min("doc").alias("a"),
            F.max("doc").alias("b"),
            F.count("*").alias("n"),
            F.sum(F.xxhash64("doc", "own").cast("decimal(38,0)")).alias("members"),
            F.count_if("own").alias("owned"),
        )
        .where("a < b")
        .groupBy("a", "b", "n", "members", "owned")
        .agg(F.min("region").alias("region"))
        .select("region", F.col("n").alias("all"), "owned")
    )
    return members.join(distinct.hint("shuffle_merge"), "region")


def _sets_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The shingle sets (doc_id, shingles, n, parity) of the documents in ``found`` (doc_id).

    Texts stay where they are read as long as the ids are few enough to be sent to them.
    """
    return docs.join(broadcast_if_small(found), "doc_id", "left_semi").mapInArrow(
        _set_rows, "doc_id bigint, shingles array<bigint>, n bigint, parity array<bigint>"
    )


def _shared_rows(listed: DataFrame) -> DataFrame:
    """(doc, n, holders, region) for each shingle that several documents of (doc, n, shingles) hold.

    ``region`` tells shingles with the same holders from others by a sum of hashes, which at worst
    makes one region of two.
    """
    # dealt once; counting uses all columns, so that both sides of the join read the same shuffle
    held = listed.select(F.explode("shingles").alias("shingle"), "doc", "n").repartition("shingle")
    close = 100 * F.col("least") >= PERCENT * F.col("most")
    shared = (
        held.groupBy("shingle")
        .agg(
            F.count("*").alias("holders"),
            F.min("doc").alias("low"),
            F.max("doc").alias("high"),
            F.sum(F.shiftright(F.xxhash64("doc"), 28)).alias("members"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
        )
        .where((F.col("low") < F.col("high")) & ((F.col("holders") > 2) | close))
        .select("shingle", "holders", F.xxhash64("holders", "members").alias("region"))
    )
    return held.join(shared.hint("shuffle_merge"), "shingle").select("doc", "n", "holders", "region")


def _rarest(listed: DataFrame) -> DataFrame:
    """(doc, n, regions) of the documents of (doc, n, shingles) that share enough to link.

    A set of n links only if ceil(0.75 n) of its shingles are shared; two that link have so many
    in common, and the rarest of those is not among the last ceil(0.75 n) - 1 of either set, ordered
    by holders and region. So each set keeps the regions of the others, with ``behind``, the number
    of shared shingles from the region's first on.
    """
    needed = F.ceil(PERCENT * F.col("n") / 100).cast("int")
    found = F.col("found")
    first = F.slice(found, F.lit(1), F.size(found) - needed + 1)
    opens = F.filter(
        F.transform(
            first,
            lambda x, i: F.struct(
                x["region"].alias("region"),
                (F.size(found) - i).alias("behind"),
                ((i == 0) | (F.get(found, i - 1)["region"] != x["region"])).alias("opens"),
            ),
        ),
        lambda x: x["opens"],
    )
    return (
        _shared_rows(listed)
        .groupBy("doc", "n")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "region"))).alias("found"))
        .where(F.size(found) >= needed)
        .select("doc", "n", opens.alias("regions"))
    )


def _can_link(placed: DataFrame) -> DataFrame:
    """Of (region, doc, n, behind) the documents that can link with one of the region's sizes.

    Sets of n and m link only if they share 3/7 (n + m) shingles, so many are behind their first one.
    """
    lowest = placed.groupBy("region").agg(F.min("n").alias("lowest"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    enough = (100 + PERCENT) * F.col("behind") >= PERCENT * (F.col("n") + F.col("lowest"))
    return placed.join(lowest.where("a < b").hint("shuffle_merge"), "region").where(enough).drop("lowest", "a", "b")


def _coarse_regions(docs: DataFrame, profile: DataFrame, heads: DataFrame) -> Regions:
    """Regions of the shared shingles of documents (doc_id, n, prefix) that may link at all.

    ``heads`` (doc) are the documents that hold a class; the others go before prefixes are taken
    apart. Whole sets are read and counted only for documents that share enough of their prefix,
    again for those that are left as long as many go, so their regions are those of their rarest
    shared shingles.
    """
    own = profile.select(F.col("doc_id").alias("doc"), "n", F.col("prefix").alias("shingles")).join(
        broadcast_if_small(heads), "doc", "left_semi"
    )
    needed = F.greatest(F.lit(1), F.floor(F.col("n") / TENTH) - 1)
    live = _shared_rows(own).groupBy("doc", "n").count().where(F.col("count") >= needed)
    live = stored(live.select(F.col("doc").alias("doc_id")).distinct())
    sets = stored(_sets_of(docs, live))
    left, before = live.count(), None
    while before is None or left < RECOUNT_BELOW * before:
        listed = sets if before is None else sets.join(broadcast_if_small(live), "doc_id", "left_semi")
        rarest = stored(_rarest(listed.select(F.col("doc_id").alias("doc"), F.size("shingles").alias("n"), "shingles")))
        live = stored(rarest.select(F.col("doc").alias("doc_id")).distinct())
        left, before = live.count(), left
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))
    placed = stored(
        rarest.select("doc", "n", F.explode("regions").alias("at"), F.array(band, band + 1).alias("bands"))
        .select("at", "doc", "n", F.explode("bands").alias("band"))
        .select(F.xxhash64("at.region", "band").alias("region"), "doc", "n", "at.behind")
    )
    for _ in range(3):
        placed = stored(_can_link(placed))
    placed = stored(placed.select("region", "doc").distinct())
    members = stored(_distinct_regions(placed.withColumn("own", F.lit(True))).select("region", "doc", "own"))
    return Regions(members, sets)


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d, linked) of pairs of documents (a, b)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).hint("shuffle_merge")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")).hint("shuffle_merge")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    counted = pairs.join(left, "a").join(right, "b").select(
        "a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum")
    )
    union = F.col("sum") - F.col("both")
    return counted.select(
        "a", "b", (1 - F.col("both") / union).alias("d"), (100 * F.col("both") >= PERCENT * union).alias("linked")
    )


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after more links; only components that change are worked on."""
    if labels is None:
        return components(links)
    known = labels.hint("shuffle_merge")
    for side in ("a", "b"):
        links = links.join(
            known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_now")), side, "left"
        ).withColumn(side, F.coalesce(f"{side}_now", side)).select("a", "b")
    merged = components(links)
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
    moved = labels.join(new.hint("shuffle_merge"), "component", "left").select(
        "node", F.coalesce("now", "component").alias("component")
    )
    return stored(moved.union(merged).groupBy("node").agg(F.min("component").alias("component")))


def _cells(labels: DataFrame, met: DataFrame) -> DataFrame:
    """The regions that follow (region, doc, own, component, whole), from members' distances to pivots (region, doc, slot, d).

    ``whole`` tells regions that pivots did not split.
    """
    near = met.groupBy("region", "doc").agg(
        F.min(F.struct("d", "slot")).alias("home"), F.collect_list(F.struct("slot", "d")).alias("all")
    )
    near = stored(
        near.withColumn(
            "cells",
            F.filter(
                "all",
                lambda at: (at["slot"] == F.col("home.slot"))
                | (at["slot"] > F.col("home.slot")) & (at["d"] <= F.col("home.d") + 2 * RADIUS + 1e-9),
            ),
        )
    )
    alike = (
        near.groupBy("region")
        .agg((F.sum(F.size("cells")) > SPLIT_LIMIT * F.count("*")).alias("whole"), F.min("home.slot").alias("one"))
    )
    whole = F.col("whole")
    placed = (
        near.join(alike.hint("shuffle_merge"), "region")
        .withColumn("cells", F.when(whole, F.filter("all", lambda at: at["slot"] == F.col("one"))).otherwise(F.col("cells")))
        .select("region", "doc", "whole", F.explode("cells").alias("at"))
        .select(
            F.when(whole, F.col("region")).otherwise(F.xxhash64("region", "at.slot")).alias("region"),
            "doc",
            F.col("at.d").alias("d"),
            "whole",
        )
        .join(labels.select(F.col("node").alias("doc"), "component").hint("shuffle_merge"), "doc", "left")
        .withColumn("component", F.coalesce("component", "doc"))
    )
    placed = stored(placed)
    common = (
        placed.groupBy("region", "component")
        .count()
        .groupBy("region")
        .agg(F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("region", F.col("most.component").alias("main"))
    )
    judged = placed.join(common.hint("shuffle_merge"), "region").select(
        "region", "doc", "component", "whole", "d", (F.col("component") != F.col("main")).alias("own")
    )
    reach = judged.where("own").groupBy("region").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return judged.join(reach.hint("shuffle_merge"), "region").where(
        F.col("own")
        | F.col("d").between(F.col("low") - RADIUS - 1e-9, F.col("high") + RADIUS + 1e-9)
    ).select("region", "doc", "own", "component", "whole")


def _close_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of own and any members of a region (region, doc, own, component, all, owned) that sizes and parities let link."""
    rows = members.join(sets.select(F.col("doc_id").alias("doc"), "n", "parity").hint("shuffle_merge"), "doc")
    parts = F.ceil(F.col("all") * F.col("owned") / CLOSE_PAIRS)
    left = rows.where("own").select(
        "region", F.pmod(F.xxhash64("doc"), parts).alias("part"), F.col("doc").alias("x"), F.col("n").alias("nx"),
        F.col("parity").alias("p"), F.col("component").alias("one"),
    )
    right = rows.select(
        "region", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("doc").alias("y"),
        F.col("n").alias("ny"), F.col("parity").alias("q"), F.col("component").alias("two"), "own",
    )
    places = [F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(PARITY_BITS // 64)]
    near = (100 + PERCENT) * sum(places[1:], places[0]) <= (100 - PERCENT) * (F.col("nx") + F.col("ny"))
    sizes = 100 * F.least("nx", "ny") >= PERCENT * F.greatest("nx", "ny")
    return (
        left.join(right.hint("shuffle_merge"), ["region", "part"])
        .where((~F.col("own") | (F.col("x") < F.col("y"))) & (F.col("one") != F.col("two")) & sizes & near)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def _linked_components(regions: Regions) -> DataFrame:
    """(node, component) of all documents that link with another one, but for the smallest ones."""
    members, labels, pivots_each, step = regions.members, None, 1, 0
    while True:
        slot = F.pmod(F.xxhash64("doc", F.lit(step)), F.lit(pivots_each)).alias("slot")
        pivots = members.where("own").groupBy("region", slot).agg(F.min("doc").alias("pivot"))
        pivots = stored(pivots)
        rest = members.join(
            pivots.select("region", F.col("pivot").alias("doc")).hint("shuffle_merge"), ["region", "doc"], "left_anti"
        )
        met = rest.join(pivots.hint("shuffle_merge"), "region").select(
            "region", "doc", "slot", F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")
        )
        between = pivots.select("region", F.col("pivot").alias("a")).join(
            pivots.select("region", F.col("pivot").alias("b")).hint("shuffle_merge"), "region"
        ).where("a < b")
        pairs = met.select("a", "b").union(between.select("a", "b")).distinct()
        found = stored(_distances(pairs, regions.sets))
        labels = _relabelled(labels, found.where("linked").select("a", "b"))
        placed = met.join(found.select("a", "b", "d").hint("shuffle_merge"), ["a", "b"])
        cells = stored(_cells(labels, placed.select("region", "doc", "slot", "d")))
        members = stored(_distinct_regions(cells))
        closing = (F.col("owned") <= CLOSE_OWN * pivots_each) & (
            F.col("whole") | (F.col("all") * F.col("owned") <= CLOSE_PAIRS)
        )
        last = stored(_close_pairs(members.where(closing), regions.sets))
        linked = _distances(last, regions.sets).where("linked").select("a", "b")
        labels = _relabelled(labels, stored(linked))
        members = members.where(~closing)
        if not members.where("own").take(1):
            return labels
        pivots_each, step = PIVOT_GROWTH * pivots_each, step + 1


def _links(docs: DataFrame, profile: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b), a < b, of all documents that hold a class (``heads``: doc) and link, stored.

    Two sets with c shared shingles in their prefixes share at most c and what is behind the prefix
    that ends first; pairs for which that is too few go before any set is moved. Prefix shingles
    with the same members are one region with their number as its weight.
    """
    own = profile.select(F.col("doc_id").alias("doc"), "n", "prefix").join(
        heads.hint("shuffle_merge"), "doc", "left_semi"
    )
    held = own.select(F.explode("prefix").alias("shingle"), "doc", "n")
    together = Window.partitionBy("shingle")  # one shuffle of all prefix shingles, by shingle
    ends = held.withColumns({"low": F.min("doc").over(together), "high": F.max("doc").over(together)})
    touching = stored(ends.where("low < high").drop("low", "high"))
    live = (
        touching.groupBy("doc", "n")
        .count()
        .where(F.col("count") >= F.greatest(F.lit(1), F.floor(F.col("n") / TENTH) - 1))
        .select("doc", "n")
    )
    placed = stored(touching.join(live.hint("shuffle_merge"), ["doc", "n"]))
    regions = (
        placed.groupBy("shingle")
        .agg(
            F.min("doc").alias("a"),
            F.max("doc").alias("b"),
            F.count("*").alias("members"),
            F.sum(F.xxhash64("doc", "n").cast("decimal(38,0)")).alias("all"),
        )
        .where("a < b")
        .groupBy("a", "b", "members", "all")
        .agg(F.min("shingle").alias("shingle"), F.count("*").alias("weight"))
        .select("shingle", "weight")
    )
    placed = stored(placed.join(regions.hint("shuffle_merge"), "shingle"))
    left = placed.select("shingle", F.col("doc").alias("a"), F.col("n").alias("na"), "weight")
    right = placed.select("shingle", F.col("doc").alias("b"), F.col("n").alias("nb"))
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    behind = F.ceil(PERCENT * most / 100) - F.greatest(F.lit(1), F.floor(most / TENTH))
    candidates = (
        left.join(right.hint("shuffle_merge"), "shingle")
        .where((F.col("a") < F.col("b")) & (100 * least >= PERCENT * most))
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("weight").alias("c"))
        .where((100 + PERCENT) * (F.col("c") + behind + 1) >= PERCENT * (F.col("na") + F.col("nb")))
        .select("a", "b")
        .distinct()
    )
    candidates = stored(candidates)
    found = stored(candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = stored(_sets_of(docs, found))
    return stored(_distances(candidates, sets).where("linked").select("a", "b").distinct())


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, their profiles, each one's class (doc_id, n, key, first_id), and class holders."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows))
    profile = stored(
        rows.mapInArrow(
            _profiles(frequent), "doc_id bigint, n bigint, key bigint, more bigint, prefix array<bigint>"
        )
    )
    kinds = profile.where("doc_id is not null and n > 0").groupBy("n", "key", "more")
    classes = kinds.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    known = stored(
        profile.drop("prefix")
        .join(classes.where("copies > 1").hint("shuffle_merge"), ["n", "key", "more"], "left")
        .select("doc_id", "n", "key", F.coalesce("first_id", "doc_id").alias("first_id"))
    )
    heads = known.where("first_id = doc_id").select(F.col("doc_id").alias("doc")).distinct()
    with_set = profile.where("doc_id is not null and n > 0").select("doc_id", "n", "prefix")
    return rows.where("doc_id is not null"), with_set, known, heads


def _with_components(known: DataFrame, labels: DataFrame) -> DataFrame:
    return known.join(
        labels.select(F.col("node").alias("first_id"), "component").hint("shuffle_merge"), "first_id", "left"
    ).withColumn("component_id", F.coalesce("component", "first_id"))


def linked_classes(docs: DataFrame) -> DataFrame:
    """(a, b), a < b, of all linked classes of equal sets of documents (doc_id, text), by their smallest ids."""
    rows, with_set, _, heads = _prepared(docs)
    return _links(rows, with_set, heads)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of documents (doc_id, text).

    ``n_links`` counts the other documents at a distance of at most RADIUS, copies among them; a
    class counts with its size. It is null for rows without an id and 0 without a set.
    """
    rows, with_set, known, heads = _prepared(docs)
    links = _links(rows, with_set, heads)
    sizes = stored(
        known.where("doc_id is not null and n > 0")
        .groupBy("first_id")
        .agg(F.countDistinct("doc_id").alias("size"))
    )
    both = links.union(links.select("b", "a")).toDF("first_id", "other")
    others = (
        both.join(sizes.toDF("other", "size").hint("shuffle_merge"), "other")
        .groupBy("first_id")
        .agg(F.sum("size").alias("linked"))
    )
    counts = sizes.join(others.hint("shuffle_merge"), "first_id", "left").select(
        "first_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    return (
        _with_components(known, components(links))
        .join(counts.hint("shuffle_merge"), "first_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "component_id",
            F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0))
            .cast("long")
            .alias("n_links"),
        )
    )


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents (doc_id, text).

    Found by the Voronoi recursion: each class of equal sets is held by one document, and each
    holder meets pivots, not all of its group, so the work does not grow with a group's square.
    """
    rows, with_set, known, heads = _prepared(docs)
    labels = _linked_components(_coarse_regions(rows, with_set, heads))
    return _with_components(known, labels).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id stay.

    Of rows repeated under that id one stays: the one whose text comes first, null before all
    texts. Rows of the same id and text that differ elsewhere are told by a hash of all columns.
    """
    found = stored(near_groups(docs))
    others = stored(found.where("component_id < doc_id").select("doc_id").distinct())
    several = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(broadcast_if_small(others), "doc_id", "left_anti")
    once = kept.join(broadcast_if_small(several), "doc_id", "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    place = F.struct(F.col("text"), F.xxhash64(*columns))
    first = (
        kept.join(broadcast_if_small(several), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct(*columns), place).alias("row"))
        .select("row.*")
    )
    return once.select(*columns).unionByName(first)
