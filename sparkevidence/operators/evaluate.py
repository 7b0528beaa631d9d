"""Benchmark work: scoring answers, choosing negatives, renaming genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.outputs import normalize_answer
from .dependency import codependency_topk
from .entities import expand_aliases
from .pairs import symmetric_closure
from .scale import broadcast_if_small, cut_lineage


def score_answers(answers: DataFrame) -> DataFrame:
    """Add ``answer`` and ``correct`` to (task, options, target, raw)."""
    answer = F.when(
        F.col("options") == "letter", normalize_answer("raw", "letter")
    ).otherwise(normalize_answer("raw", "yes_no"))
    return answers.withColumn("answer", answer).withColumn(
        "correct", F.coalesce(F.col("answer") == F.col("target"), F.lit(False))
    )


def accuracy_by_task(scored: DataFrame) -> DataFrame:
    """Items and exact-match accuracy of each task, and over all tasks (task ``ALL``)."""
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    tasks = scored.groupBy("task").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))
    total = tasks.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(
        F.lit("ALL").alias("task"), "n", "hits"
    )
    return tasks.unionByName(total).select(
        "task", "n", F.round(F.try_divide("hits", "n"), 6).alias("accuracy")
    )


def seeded_number(*parts: Column | str) -> Column:
    """Repeatable 32-bit number from a seed and keys."""
    joined = F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def numbered(genes: DataFrame) -> DataFrame:
    """(grp, gene, pos): distinct genes numbered from 0 inside their group by name.

    The rows are sorted in parts and each part counted; only the counts of the parts are summed in
    one place, so a group with all genes is no single task.
    """
    rows = genes.select("grp", "gene").where("grp is not null and gene is not null").distinct()
    placed = cut_lineage(
        rows.orderBy("grp", "gene").withColumn("row", F.monotonically_increasing_id())
    ).select("grp", "gene", F.shiftright("row", 33).alias("part"), F.expr("row & 8589934591").alias("k"))
    before, parts = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():
        parts.append((r["part"], before))
        before += r["count"]
    offsets = genes.sparkSession.createDataFrame(parts, "part long, before long")
    at = placed.join(F.broadcast(offsets), "part").select(  # a row for each part of the sort
        "grp", "gene", (F.col("before") + F.col("k")).alias("at")
    )
    start = at.groupBy("grp").agg(F.min("at").alias("start"))
    return at.join(broadcast_if_small(start), "grp").select(
        "grp", "gene", (F.col("at") - F.col("start")).alias("pos")
    )


def drawn_negatives(
    positives: DataFrame, groups: DataFrame, seed: int, per_pair: int = 1
) -> DataFrame:
    """(gene_a, gene_b, negative): for each positive pair, other genes drawn from a group.

    ``groups`` is (grp, gene). Of the groups that hold gene_a and some gene that is neither gene_a
    nor a known partner, the seed picks one, and in it ``per_pair`` of those free genes. A draw is
    a number below the count of free genes, moved past the taken positions before it, so it always
    succeeds. A pair whose gene is in a group but has no free gene in any gets one row with NULL;
    pairs whose gene is in no group give no row.
    """
    index = cut_lineage(numbered(groups))
    asked = positives.select("gene_a", "gene_b").where("gene_a is not null").distinct()
    member = index.select(F.col("gene").alias("gene_a"), "grp").join(
        asked.select("gene_a").distinct(), "gene_a"
    )
    known = symmetric_closure(positives).select("gene_a", F.col("gene_b").alias("gene"))
    own = asked.select("gene_a", F.col("gene_a").alias("gene"))
    taken = cut_lineage(
        member.join(known.unionByName(own).distinct(), "gene_a").join(index, ["grp", "gene"])
        .select("gene_a", "grp", "pos")
    )
    sizes = index.groupBy("grp").agg(F.count("*").alias("size"))
    by_gene = Window.partitionBy("gene_a")
    options = (
        taken.groupBy("gene_a", "grp").agg(F.count("*").alias("n_taken"))
        .join(broadcast_if_small(sizes), "grp")
        .withColumn("free", F.col("size") - F.col("n_taken"))
        .where("free > 0")
        # as many rows as a gene has groups
        .withColumn("option", F.row_number().over(by_gene.orderBy("grp")) - 1)
        .withColumn("n_options", F.count("*").over(by_gene))
        .select("gene_a", "grp", "free", "option", "n_options")
    )
    number = seeded_number(F.lit(str(seed)), "gene_a", "gene_b")
    pick = seeded_number(F.lit(str(seed)), F.lit("group"), "gene_a", "gene_b")
    draws = (
        asked.join(options, "gene_a")
        .where(F.col("option") == pick % F.col("n_options"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_pair), "free") - 1)))
        .select(
            "gene_a", "gene_b", "grp", ((number + F.col("k")) % F.col("free")).alias("value"),
            F.lit(1).alias("is_draw"),
        )
    )
    in_order = Window.partitionBy("gene_a", "grp").orderBy("pos")
    before = taken.select(
        "gene_a", F.lit(None).cast("string").alias("gene_b"), "grp",
        (F.col("pos") - F.row_number().over(in_order) + 1).alias("value"), F.lit(0).alias("is_draw"),
    )
    # a running count of the taken positions at or before each draw
    so_far = Window.partitionBy("gene_a", "grp").orderBy("value", "is_draw").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    drawn = (
        draws.unionByName(before)
        .withColumn("passed", F.sum(1 - F.col("is_draw")).over(so_far))
        .where("is_draw = 1")
        .select("gene_a", "gene_b", "grp", (F.col("value") + F.col("passed")).alias("pos"))
        .join(index.withColumnRenamed("gene", "negative"), ["grp", "pos"])
        .select("gene_a", "gene_b", "negative")
    )
    in_groups = asked.join(member.select("gene_a").distinct(), "gene_a", "left_semi")
    none = in_groups.join(options.select("gene_a").distinct(), "gene_a", "left_anti").select(
        "gene_a", "gene_b", F.lit(None).cast("string").alias("negative")
    )
    return drawn.unionByName(none)


def random_negatives(
    positives: DataFrame, genes: DataFrame, seed: int = 0, per_pair: int = 1
) -> DataFrame:
    everyone = genes.select(F.lit("all").alias("grp"), "gene")
    return drawn_negatives(positives, everyone, seed, per_pair)


def correlated_negatives(
    positives: DataFrame, matrix: DataFrame, per_gene: int = 5, settings: Settings = DEFAULTS
) -> DataFrame:
    """(gene, partner, correlation): most correlated partners that are not known pairs."""
    known = symmetric_closure(positives)
    return codependency_topk(matrix, per_gene, exclude=known, settings=settings)


def alias_variants(
    items: DataFrame, alias_table: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Items (item_id, input, gene) rewritten with each other name of their gene."""
    named = expand_aliases(items, alias_table, settings)
    variants = named.select(
        "item_id", "gene", "input", F.posexplode("names").alias("variant", "alias")
    ).where(F.col("alias") != F.col("gene"))
    pattern = F.concat(
        F.lit(r"\b"), F.regexp_replace("gene", r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\b")
    )
    replacement = F.regexp_replace("alias", r"([\\$])", r"\\$1")
    return variants.withColumn("variant_input", F.regexp_replace("input", pattern, replacement))


def invariance_rate(answers: DataFrame) -> DataFrame:
    """Share of renamed items with the answer of the original: (item_id, variant, answer).

    Variant 0 is the original.
    """
    original = answers.where(F.col("variant") == 0).select(
        "item_id", F.col("answer").alias("original")
    )
    pairs = answers.where(F.col("variant") != 0).join(original, "item_id")
    same = F.when(F.equal_null("answer", "original"), 1.0).otherwise(0.0)
    return pairs.agg(
        F.count("*").alias("variants"), F.round(F.avg(same), 6).alias("invariance")
    )
