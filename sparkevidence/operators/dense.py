"""Cosine ranking of stored vectors for many question vectors at once, as a join of blocks.

Tasks pack questions and vectors into blocks of ``BLOCK_BYTES`` where they lie. Every question has to be
compared with every vector, so blocks of vectors are dealt to groups, blocks of questions to parts of
``PART_BYTES``, and each pair of a group and a part meets in one task by a single shuffle: the questions
come first and stay, the vector blocks pass by one after the other, and the best k of each question
leave the task. Nothing goes through the driver, and the number of jobs does not grow with the questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .scale import cut_lineage
from .topk import HIT_SCHEMA, RunningTopK, rank_hits

BLOCK_BYTES = 1 << 20
#: Questions that a task holds, and vectors that one group lets pass.
PART_BYTES = 64 << 20
GROUP_BYTES = 1 << 30
#: Pairs of a question and a vector that a task compares: more of them make more tasks, not longer ones.
TASK_PAIRS = 1 << 31
QUERY_BLOCK = 512
DOC_BLOCK = 4096
EPSILON = 1e-8
BLOCKS = "block long, width int, ids binary, data binary"


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.maximum(norms, EPSILON)


def _packed(vectors: DataFrame, id_col: str) -> DataFrame:
    """Vectors of one length each, packed into blocks: ids as int64 and entries as float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                own = batch.filter(pa.array(sizes == width))
                ids = own.column(0).to_numpy()
                data = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                each = max(1, BLOCK_BYTES // max(8 * int(width), 1))
                for start in range(0, len(ids), each):
                    end = min(start + each, len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block], pa.int64()),
                            pa.array([int(width)], pa.int32()),
                            pa.array([ids[start:end].tobytes()], pa.binary()),
                            pa.array([data[start * width : end * width].tobytes()], pa.binary()),
                        ],
                        names=["block", "width", "ids", "data"],
                    )
                    block += 1

    named = vectors.select(F.col(id_col).cast("long").alias("id"), "embedding")
    whole = named.where("id is not null and embedding is not null and size(embedding) > 0")
    return cut_lineage(whole.mapInArrow(run, BLOCKS))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(row["data"], dtype=np.float64).reshape(-1, row["width"])
    return np.frombuffer(row["ids"], dtype=np.int64), _unit(data)


def _size(blocks: DataFrame) -> Row:
    """Numbers of blocks and of vectors, and the bytes of all."""
    return blocks.agg(
        F.count("*").alias("blocks"),
        F.coalesce(F.sum(F.octet_length("ids")) / 8, F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"),
    ).first()


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks under consecutive numbers, so that shares of them differ by one block at most."""
    task = F.shiftright("block", 32)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy(task.alias("task")).agg(F.count("*").alias("n"))  # a row for each packing task
    starts = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("block").bitwiseAND(0xFFFFFFFF)
    return blocks.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("number", number).drop(
        "task", "start"
    )


def search(query_vectors: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) from (query_id, embedding) and (vec_id, embedding).

    Rows without id or vector take no part, and vectors of different lengths are not compared.
    """
    asked, stored = _packed(query_vectors, "query_id"), _packed(vectors, "vec_id")
    usual = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    questions, rows = _size(asked), _size(stored)
    parts = max(-(-questions["bytes"] // PART_BYTES), 1)
    pairs = -(-questions["rows"] // parts) * rows["rows"]
    # every group takes a copy of all questions: no more of them than the work needs
    spread_out = -(-min(rows["blocks"] * parts, usual) // parts)
    groups = max(-(-rows["bytes"] // GROUP_BYTES), min(rows["blocks"], -(-pairs // TASK_PAIRS)), spread_out, 1)
    asked, stored = _numbered(asked), _numbered(stored)
    share = lambda shares: F.pmod("number", F.lit(shares)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    columns = ["block", "width", "ids", "data"]
    rows = asked.select(share(parts).alias("part"), every(groups).alias("grp"), F.lit(0).alias("kind"), *columns).union(
        stored.select(every(parts).alias("part"), share(groups).alias("grp"), F.lit(1), *columns)
    )
    place = F.col("grp") * parts + F.col("part")
    dealt = rows.repartitionById(groups * parts, place).sortWithinPartitions("grp", "part", "kind", "block")
    return cut_lineage(rank_hits(dealt.mapInArrow(_scorer(k), HIT_SCHEMA), k))


def _scorer(k: int):
    def found(asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        for _, _, best in asked:
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.query), pa.array(best.doc), pa.array(best.score)],
                names=["query_id", "doc_id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if at != (row["grp"], row["part"]):
                    yield from found(asked)
                    at, asked = (row["grp"], row["part"]), []
                ids, unit = _unpacked(row)
                if row["kind"] == 0:
                    for q in range(0, len(ids), QUERY_BLOCK):
                        block = slice(q, q + QUERY_BLOCK)
                        asked.append((ids[block], unit[block], RunningTopK(k, positive_only=False)))
                    continue
                for query_ids, queries, best in asked:
                    if queries.shape[1] != unit.shape[1]:
                        continue
                    for d in range(0, len(ids), DOC_BLOCK):
                        block = slice(d, d + DOC_BLOCK)
                        best.add(query_ids, ids[block], queries @ unit[block].T, best.floors(query_ids))
        yield from found(asked)

    return run


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two array columns, for vectors that already sit in one row."""
    x = F.transform(a if isinstance(a, Column) else F.col(a), lambda v: v.cast("double"))
    y = F.transform(b if isinstance(b, Column) else F.col(b), lambda v: v.cast("double"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    nx = F.greatest(F.sqrt(total(F.transform(x, lambda v: v * v))), F.lit(EPSILON))
    ny = F.greatest(F.sqrt(total(F.transform(y, lambda v: v * v))), F.lit(EPSILON))
    return dot / (nx * ny)


def embed_corpus(
    docs: DataFrame,
    encoder: Callable[[pd.Series], np.ndarray] | None = None,
    id_col: str = "doc_id",
    text_col: str = "content",
    batch: int = 32,
    dims: int = 256,
) -> DataFrame:
    """(vec_id, embedding) with unit length.

    ``encoder`` turns a series of texts into a matrix and is called in each task for batches of
    texts. Without one, words are hashed into ``dims`` counts, all with built-in operators.
    """
    if encoder is None:
        return _hashed(docs, id_col, text_col, dims)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                rows = _unit(np.asarray(encoder(part["text"]), dtype=np.float64))
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].to_numpy(),
                    "embedding": list(rows.astype(np.float32)),
                })

    texts = docs.select(F.col(id_col).alias("vec_id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(run, "vec_id long, embedding array<float>")


def _hashed(docs: DataFrame, id_col: str, text_col: str, dims: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = docs.select(
        F.col(id_col).alias("vec_id"),
        F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\b\w+\b"), F.lit(0)).alias("words"),
    )
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="counts", outputCol="unit").transform(counts)
    return unit.select("vec_id", vector_to_array("unit", "float32").alias("embedding"))
