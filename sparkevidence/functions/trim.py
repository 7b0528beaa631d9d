"""Cutting texts to a token budget, all inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, let
from .text import count_tokens


def _as_limit(limit: Column | int) -> Column:
    return F.lit(limit) if isinstance(limit, int) else limit


def prefix_within(costs: Column, limit: Column | int) -> Column:
    """How many leading items fit the budget; the first overflow ends the prefix."""
    cap = _as_limit(limit).cast("long")
    start = F.struct(
        F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open")
    )

    def step(acc: Column, cost: Column) -> Column:
        fits = acc["open"] & (acc["used"] + cost <= cap)
        return F.struct(
            F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["kept"] + 1).otherwise(acc["kept"]).alias("kept"),
            fits.alias("open"),
        )

    return F.aggregate(costs, start, step, lambda acc: acc["kept"])


def _line_costs(lines: Column) -> Column:
    return F.transform(lines, lambda s: F.floor((F.length(s) + 1) / 4).cast("long"))


def truncate_lines(text: Column | str, limit: Column | int) -> Column:
    """Leading whole lines that fit the budget."""
    return let(
        F.split(as_col(text), "\n"),
        lambda lines: F.array_join(
            F.slice(lines, F.lit(1), prefix_within(_line_costs(lines), limit)), "\n"
        ),
    )


def fit_lines(text: Column | str, limit: Column | int) -> Column:
    """The text itself when it fits, else its leading whole lines."""
    cap = _as_limit(limit)
    return F.when(count_tokens(text) <= cap, as_col(text)).otherwise(truncate_lines(text, cap))


def truncate_graph(text: Column | str, limit: Column | int, margin: int = 50) -> Column:
    """Keep every header line and the leading relation lines that fit; empty if none fits."""
    cap = _as_limit(limit)
    c = as_col(text)

    def is_relation(s: Column) -> Column:
        return s.contains("--[") & s.contains("]-->")

    def cut(lines: Column) -> Column:
        parts = F.struct(
            F.array_join(F.filter(lines, lambda s: ~is_relation(s)), "\n").alias("header"),
            F.filter(lines, is_relation).alias("relations"),
        )
        return let(parts, fit)

    def fit(p: Column) -> Column:
        room = cap - count_tokens(p["header"]) - margin
        # the room is computed once, not for every line it is compared with
        count = let(room, lambda r: prefix_within(_line_costs(p["relations"]), r))
        return let(
            count,
            lambda n: F.when(
                (room > 0) & (n > 0),
                F.concat(
                    p["header"], F.lit("\n"),
                    F.array_join(F.slice(p["relations"], F.lit(1), n), "\n"),
                ),
            ).otherwise(""),
        )

    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(count_tokens(c) <= cap, c)
        .otherwise(let(F.split(c, "\n"), cut))
    )
