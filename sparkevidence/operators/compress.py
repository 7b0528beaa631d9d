"""Shortening texts by sentences. Each text is one row, so all work stays inside the row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.common import as_col, let
from ..functions.text import SENTENCE_BREAK, count_words, first_words, split_sentences, tokenize

# Words and figures that make a sentence worth keeping.
CONTENT_WORDS = (
    "gene", "protein", "mutation", "cancer", "tumor", "synthetic lethal", "inhibitor", "pathway",
    "expression", "crispr", "knockout", "dependency", "essentiality",
)
FIGURE_PATTERN = r"\d+\.?\d*%|\d+\.?\d*-fold|p\s*[<>=]\s*\d"


def target_words(text: Column | str, ratio: float) -> Column:
    """Words to keep: a share of the text, at least 64 and at most 600."""
    share = F.floor(F.greatest(F.lit(1), count_words(text)) * ratio).cast("int")
    return F.least(F.lit(600), F.greatest(F.lit(64), share))


def keep_best(sentences: Column, scores: Column, ratio: float, window: int) -> Column:
    """The best share of the sentences together with their neighbours, in reading order."""
    count = F.size(sentences)
    keep = F.least(count, F.greatest(F.lit(1), F.floor(count * ratio).cast("int")))

    def ranked(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.struct((-x).alias("minus"), i.alias("at")))

    def select(entries: Column) -> Column:
        last = F.get(F.array_sort(entries), keep - 1)
        flags = let(last, lambda cut: F.transform(entries, lambda e: e <= cut))
        return let(
            flags,
            lambda f: F.filter(
                sentences,
                lambda s, i: F.exists(
                    F.sequence(
                        F.greatest(i - window, F.lit(0)), F.least(i + window, F.size(f) - 1)
                    ),
                    lambda j: F.get(f, j),
                ),
            ),
        )

    short = F.array_join(sentences, " ")
    return (
        F.when(count == 0, "")
        .when(count <= 3, short)
        .otherwise(F.array_join(let(ranked(scores), select), " "))
    )


def overlap_scores(query: Column | str, sentences: Column) -> Column:
    """Share of the question's words found in each sentence."""
    return let(
        tokenize(query),
        lambda asked: F.transform(
            sentences,
            lambda s: F.when(
                F.size(asked) > 0, F.size(F.array_intersect(asked, tokenize(s))) / F.size(asked)
            ).otherwise(0.0),
        ),
    )


def encoded_scores(
    chunks: DataFrame, encoder: Callable[[pd.Series], np.ndarray]
) -> DataFrame:
    """Add ``scores``: products of question and sentence vectors of a given encoder."""
    schema = chunks.withColumn("scores", F.array().cast("array<double>")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            questions = np.asarray(encoder(frame["query"]), dtype=np.float64)
            flat = pd.Series([s for row in frame["sentences"] for s in row], dtype=object)
            rows = np.asarray(encoder(flat), dtype=np.float64) if len(flat) else np.zeros((0, 1))
            at, scores = 0, []
            for q, row in zip(questions, frame["sentences"]):
                scores.append((rows[at : at + len(row)] @ q).tolist() if len(row) else [])
                at += len(row)
            yield frame.assign(scores=scores)

    return chunks.mapInPandas(run, schema)


def compress_sentence_filter(
    chunks: DataFrame,
    encoder: Callable[[pd.Series], np.ndarray] | None = None,
    settings: Settings = DEFAULTS,
    ratio: float | None = None,
) -> DataFrame:
    """Shorten ``content`` to the sentences nearest the ``query`` and their neighbours."""
    share = settings.compression_ratio if ratio is None else ratio
    rows = chunks.withColumn("sentences", split_sentences("content"))
    if encoder is None:
        rows = rows.withColumn("scores", overlap_scores("query", F.col("sentences")))
    else:
        rows = encoded_scores(rows, encoder)
    kept = keep_best(F.col("sentences"), F.col("scores"), share, settings.context_window)
    target = target_words("content", share)
    body = let(kept, lambda k: F.when(count_words(k) > target, first_words(k, target)).otherwise(k))
    body = F.when(F.size("sentences") > 0, body)
    fallback = extractive("content", target)
    return (
        rows.withColumn("original_length", F.length("content"))
        .withColumn("content", F.coalesce(body, fallback))
        .withColumn("compressed_length", F.length("content"))
        .drop("sentences", "scores")
    )


def sentence_value(sentence: Column, position: Column, keep: Column) -> Column:
    """Worth of a sentence: place, kept names, content words and figures."""
    lead = F.when(position < 3, 2 - position * 0.5).otherwise(0.0)
    upper, lower = F.upper(sentence), F.lower(sentence)
    names = F.size(F.filter(keep, lambda e: F.contains(upper, e))) * 3
    words = sum(
        (F.when(lower.contains(w), 1).otherwise(0) for w in CONTENT_WORDS[1:]),
        F.when(lower.contains(CONTENT_WORDS[0]), 1).otherwise(0),
    )
    figure = F.when(sentence.rlike(FIGURE_PATTERN), 2).otherwise(0)
    return lead + names + words + figure


def extractive(
    text: Column | str, target: Column | int, entities: Column | None = None
) -> Column:
    """Best sentences that fit ``target`` words. One that does not fit is passed over, not final.

    A text that is short enough stays as it is.
    """
    c = as_col(text)
    limit = F.lit(target) if isinstance(target, int) else target
    empty = F.array().cast("array<string>")
    names = empty if entities is None else F.coalesce(
        F.array_distinct(F.transform(entities, F.upper)), empty
    )
    sentences = F.filter(F.split(c, SENTENCE_BREAK), lambda s: s != "")
    start = F.struct(
        F.lit(0).alias("used"), F.array().cast("array<int>").alias("chosen")
    )
    # everything that the fold looks at is computed once for the row
    row = F.struct(sentences.alias("all"), names.alias("names"), limit.alias("cap"))

    def choose(r: Column) -> Column:
        def pick(acc: Column, s: Column) -> Column:
            fits = (acc["used"] < r["cap"]) & (acc["used"] + s["words"] <= r["cap"])
            return F.struct(
                F.when(fits, acc["used"] + s["words"]).otherwise(acc["used"]).alias("used"),
                F.when(fits, F.concat(acc["chosen"], F.array(s["at"])))
                .otherwise(acc["chosen"])
                .alias("chosen"),
            )

        valued = F.transform(
            r["all"],
            lambda s, i: F.struct(
                (-sentence_value(s, i, r["names"])).alias("minus"), i.alias("at"),
                count_words(s).alias("words"),
            ),
        )
        chosen = F.aggregate(F.array_sort(valued), start, pick, lambda acc: acc["chosen"])
        kept = F.transform(F.array_sort(chosen), lambda i: F.get(r["all"], i))
        return F.when(F.size(r["all"]) == 0, F.substr(c, F.lit(1), r["cap"] * 4)).otherwise(
            F.array_join(kept, " ")
        )

    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(count_words(c) <= limit, c)
        .otherwise(let(row, choose))
    )


def compress_extractive(
    chunks: DataFrame, entities: str | None = None, settings: Settings = DEFAULTS,
    ratio: float | None = None,
) -> DataFrame:
    """Shorten ``content`` without a question; ``entities`` names a column of names to keep."""
    share = settings.compression_ratio if ratio is None else ratio
    names = F.col(entities) if entities else None
    return (
        chunks.withColumn("original_length", F.length("content"))
        .withColumn("content", extractive("content", target_words("content", share), names))
        .withColumn("compressed_length", F.length("content"))
    )
