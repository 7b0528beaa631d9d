"""Exact top-k search by inner product with a KD-tree for each shard of the vectors.

Vectors are dealt to shards of ``SHARD_ROWS`` by a hash of the id; a shard's tree splits at medians
of the widest dimension down to leaves, each with the tight box of its vectors. A box bounds the
score of a query from above: each component takes the better end of its interval. A query visits
nodes best bound first and stops when the best open bound is below its k-th score. That k-th score
is carried from shard to shard of a task, so later shards are entered only where they can still
improve the result. Ties go to the smaller id; a box whose bound equals the k-th score is visited.

Queries come in blocks of ``BLOCK_ROWS``. Shards are dealt to groups of ``GROUP_SHARDS``; a task holds
the trees of its group, each built once, and lets all blocks pass. So a shard moves once and each
block once for every group, and a task sends k rows for each query.

Vectors are given as integers. Bounds are doubles with a margin for their rounding; where products
may go beyond 2**53, the scores of vectors that pass them are computed once more in whole numbers.
Defined results: null vectors, vectors with null or non-finite components and rows without id take
no part; a query meets the vectors of its own length only; a query does not find rows of its own
id; rows repeated under one id compete each, with equal score and id; fewer than k candidates give
all; an empty table gives no rows; further columns are not read; components and scores beyond a long are the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import pieces, stored

SHARD_ROWS = 4096
BLOCK_ROWS = 2048
LEAF_ROWS = 512
GROUP_SHARDS = 8
_LONG = np.iinfo(np.int64)


class KDTree:
    """Median splits with tight boxes; children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], vectors[order]
        self.vectors = self.whole.astype(np.float64)
        self.largest = np.abs(self.vectors).max()
        depth = 0
        while len(ids) > leaf_rows << depth:
            depth += 1
        self.inner = (1 << depth) - 1
        self.rows: list[np.ndarray] = [np.arange(len(ids))]
        for node in range(self.inner):
            rows = self.rows[node]
            own = self.vectors[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = len(rows) // 2
            split = np.argpartition(own[:, axis], half)
            self.rows += [np.sort(rows[split[:half]]), np.sort(rows[split[half:]])]
        self.low = np.stack([self.vectors[r].min(axis=0) for r in self.rows])
        self.high = np.stack([self.vectors[r].max(axis=0) for r in self.rows])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows, for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own_id: int, bound: np.ndarray, k: int, kept: Best) -> None:
        """Put the best vectors of a query of whole numbers into ``kept``, best node first."""
        real = query.astype(np.float64)
        margin = margin_of(self.largest, np.abs(real).max(), len(query))
        open_nodes = [(-bound[0], 0)]
        while open_nodes and -open_nodes[0][0] >= kept.floor - margin:
            node = heapq.heappop(open_nodes)[1]
            if node < self.inner:
                for child in (2 * node + 1, 2 * node + 2):
                    if bound[child] >= kept.floor - margin:
                        heapq.heappush(open_nodes, (-bound[child], child))
                continue
            rows = self.rows[node]
            score = self.vectors[rows] @ real
            good = (score >= kept.floor - margin) & (self.ids[rows] != own_id)
            if not good.any():
                continue
            score = score[good] if margin == 0 else whole_scores(self.whole[rows[good]], query)
            kept.add(score.astype(np.int64), self.ids[rows[good]], k)


def margin_of(a: float, b: float, width: int) -> float:
    """What a double may be off in a product of vectors with components up to a and b; 0 if exact."""
    most = float(a) * float(b) * width
    return 0.0 if most < 2**53 else (width + 4) * 2.0**-51 * most


def whole_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, beyond a long the nearest long."""
    exact = vectors.astype(object) @ query.astype(object)
    return np.clip(exact, _LONG.min, _LONG.max)


class Best:
    """The k best (score, id) of a query so far; ``floor`` is the k-th score."""

    def __init__(self):
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, k: int) -> None:
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, ~score))[:k]
        self.score, self.id = score[order], ids[order]
        if len(order) == k and self.score[-1] > _LONG.min:  # that one may stand for less
            self.floor = self.score[-1]


def _pack(groups: pa.Table) -> pa.Table:
    ids = groups.column("id").to_numpy().astype(np.int64)
    values = groups.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    data = values.astype(np.int64).tobytes()
    return groups.select(["width", "part"]).slice(0, 1).append_column("ids", pa.array([ids.tobytes()])).append_column(
        "data", pa.array([data])
    )


def _packed(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Vectors packed into parts of ``rows`` or so of one length: (width, part, ids, data); number of parts."""
    count = pieces(vectors.count(), rows)
    part = F.pmod(F.xxhash64("id", "v"), F.lit(count))
    packed = vectors.select("id", "v").withColumns({"width": F.size("v"), "part": part}).groupBy("width", "part").applyInArrow(
        _pack, "width int, part bigint, ids binary, data binary"
    )
    return stored(packed), count


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    number = np.frombuffer(row["ids"], dtype=np.int64)
    return number, np.frombuffer(row["data"], dtype=np.int64).reshape(len(number), -1)


def _searched(k: int):
    def found(ids: np.ndarray, queries: np.ndarray, trees: list[KDTree]) -> pa.RecordBatch:
        best = [Best() for _ in ids]
        for tree in trees:
            bounds = tree.bounds(queries.astype(np.float64))
            for i, own in enumerate(ids):
                tree.search(queries[i], own, bounds[i], k, best[i])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, [len(b.id) for b in best])),
                pa.array(np.concatenate([b.id for b in best])),
                pa.array(np.concatenate([b.score for b in best])),
            ],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, trees = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if at != row["shards"]:
                    at, trees = row["shards"], {}
                if not row["asks"]:
                    trees.setdefault(row["width"], []).append(KDTree(*_unpack(row)))
                elif row["width"] in trees:
                    yield found(*_unpack(row), trees[row["width"]])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors for each query.

    Both tables hold (id long, v array<long>).
    """
    shards, n_shards = _packed(vectors, SHARD_ROWS)
    blocks, _ = _packed(queries, BLOCK_ROWS)
    groups = pieces(n_shards, GROUP_SHARDS)
    dealt = shards.select(
        (F.col("part") % groups).alias("shards"), F.lit(False).alias("asks"), "width", "part", "ids", "data"
    ).unionByName(
        blocks.select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("shards"),
            F.lit(True).alias("asks"), "width", "part", "ids", "data",
        )
    )
    found = (
        dealt.repartition(groups, "shards")
        .sortWithinPartitions("shards", "asks", "part", "width")
        .mapInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def whole_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(id, v) of the rows (vec_id, embedding) with all components finite, as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), x.alias("embedding")).where(
        F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    ).where(sound).select("id", F.transform("embedding", lambda e: F.floor(e * scale)).alias("v"))
