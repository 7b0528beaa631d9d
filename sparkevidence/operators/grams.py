"""Substring matching of two tables by an index of character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import cut_lineage

#: Gram sizes; a needle uses the largest one that it holds.
SIZES = (1, 2, 3, 6, 12, 24)


def _pieces(text: Column, size: Column) -> Column:
    """Distinct substrings of one size."""
    last = F.length(text) - size + 1
    cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size))
    return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def substring_join(needles: DataFrame, needle: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs in which the ``needle`` text occurs in the ``name`` text, over distinct texts.

    Every needle meets the names by its rarest gram only: the one that the fewest names hold. Grams are
    as long as the needle allows (needles of one or two characters are their own gram), so a needle
    among names with a long common beginning is found by the part that tells them apart. The index holds
    the grams of the names that some needle has; a needle with a gram that no name holds meets none.
    """
    n = needles.select(needle).where(F.length(needle) > 0).distinct()
    fits = F.array_max(F.filter(F.array(*[F.lit(s) for s in SIZES]), lambda s: s <= F.length(needle)))
    parts = cut_lineage(n.select(needle, F.explode(_pieces(F.col(needle), fits)).alias("_piece")))
    sizes = [r[0] for r in parts.select(F.length("_piece")).distinct().collect()]  # SIZES at most
    t = names.select(name).where(F.length(name) > 0).distinct()
    pieces = F.flatten(F.array(*[_pieces(F.col(name), F.lit(s)) for s in sizes])) if sizes else F.array(F.lit(""))
    index = cut_lineage(
        t.select(name, F.explode(pieces).alias("_piece")).join(parts.select("_piece").distinct(), "_piece", "left_semi")
    )
    held = index.groupBy("_piece").agg(F.count("*").alias("_held"))
    rarest = (
        parts.join(held, "_piece", "left")
        .groupBy(needle)
        .agg(F.min_by("_piece", F.struct(F.coalesce("_held", F.lit(0)), "_piece")).alias("_piece"))
    )
    return (
        rarest.join(index, "_piece").where(F.contains(F.col(name), F.col(needle))).select(needle, name)
    )
