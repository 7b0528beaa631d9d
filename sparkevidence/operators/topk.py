"""Top-k per question: as a window, and as a running selection inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import BROADCAST_ROWS, at_most

#: Scores are compared after rounding to six places.
FLOOR_MARGIN = 1e-6
HIT_SCHEMA = "query_id long, doc_id long, score double"


def top_k(
    df: DataFrame, k: int | Column, by: list[str], order: list[Column], rank: str = "rank"
) -> DataFrame:
    """Rows ranked within ``by`` and cut at ``k``.

    Spark limits every group before the shuffle, so a group that holds most of the rows sends
    only k rows from each task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def limited_rows(
    rows: DataFrame, keys: DataFrame, key: str, by: list[str], order: list[Column], cap: int,
    rank: str = "_n", broadcast_rows: int | None = None,
) -> DataFrame:
    """The first ``cap`` rows of each group whose ``key`` is wanted.

    A wanted set of checked size is broadcast and filters the rows where they are read. A larger
    set is joined after every group was cut to ``cap`` rows, so that neither a key with very many
    rows nor a frequent key can fill one task.
    """
    wanted = keys.select(key).distinct()
    if at_most(wanted, BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        return top_k(rows.join(F.broadcast(wanted), key, "left_semi"), cap, by, order, rank)
    return top_k(rows, cap, by, order, rank).join(wanted, key, "left_semi")


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Best k documents of each question; equal scores are ordered by id."""
    return top_k(hits, k, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def six_places(scores: np.ndarray) -> np.ndarray:
    """Scores to six places, halves away from zero."""
    scaled = scores * 1e6
    whole = np.trunc(scaled)
    with np.errstate(invalid="ignore"):
        half = np.abs(scaled - whole) >= 0.5
    return (whole + np.where(half, np.sign(scaled), 0)) / 1e6


def six_places_of(score: Column) -> Column:
    """The same for a column."""
    return F.round(score * 1e6) / 1e6


class RunningTopK:
    """Best k (score, id) pairs of many questions over a stream of score blocks.

    Used inside one task: it holds at most k pairs for each question, whatever the number of
    documents the task reads.
    """

    def __init__(self, k: int, positive_only: bool):
        self.k = k
        self.positive_only = positive_only
        self.query = np.empty(0, dtype=np.int64)
        self.doc = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.float64)

    def floors(self, query_ids: np.ndarray) -> np.ndarray:
        """The k-th score so far of each question; minus infinity where there are fewer."""
        last = np.searchsorted(self.query, query_ids) + self.k - 1
        inside = last < len(self.query)
        out = np.full(len(query_ids), -np.inf)
        at = last[inside]
        out[inside] = np.where(self.query[at] == query_ids[inside], self.score[at], -np.inf)
        return out

    def add(
        self, query_ids: np.ndarray, doc_ids: np.ndarray, scores: np.ndarray, floor: np.ndarray | None = None
    ) -> None:
        """Offer a block of scores with one row for each question; scores below ``floor`` are passed over."""
        n = len(doc_ids)
        if n == 0 or len(query_ids) == 0:
            return
        if floor is not None:
            row, col = np.divmod(np.flatnonzero(scores >= (floor - FLOOR_MARGIN)[:, None]), n)
            if len(row) <= self.k * len(query_ids):  # few pass, the others need no work
                found = six_places(scores[row, col])
                kept = found >= floor[row]
                if self.positive_only:
                    kept &= found > 0
                self._take(query_ids[row[kept]], doc_ids[col[kept]], found[kept])
                return
        scores = six_places(scores)
        if n > self.k:
            own = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
            keep = scores >= own[:, None]
        else:
            keep = np.ones(scores.shape, dtype=bool)
        if self.positive_only:
            keep &= scores > 0
        if floor is not None:
            keep &= scores >= floor[:, None]
        row, col = np.nonzero(keep)
        self._take(query_ids[row], doc_ids[col], scores[row, col])

    def _take(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.query = np.concatenate([self.query, query])
            self.doc = np.concatenate([self.doc, doc])
            self.score = np.concatenate([self.score, score])
            self._shrink()

    def _shrink(self) -> None:
        order = np.lexsort((self.doc, -self.score, self.query))
        query = self.query[order]
        starts = np.r_[True, query[1:] != query[:-1]] if len(query) else np.empty(0, dtype=bool)
        first = np.maximum.accumulate(np.where(starts, np.arange(len(query)), 0))
        best = (np.arange(len(query)) - first) < self.k
        self.query, self.doc, self.score = (
            query[best], self.doc[order][best], self.score[order][best]
        )
