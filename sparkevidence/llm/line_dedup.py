"""Line dedup with sharded cuckoo filters over exact reference counts, reversible document by document.

A line's key is the line without white space at both ends and with A-Z lower-cased. An index of lines
holds three tables:

* ``ledger``: the distinct keys of each document, as 16-byte digests, so that a document can be taken
  out again by its id;
* ``counts``: for each key the number of documents that hold it, exact;
* ``filters``: for each shard of the keys a cuckoo filter of those that ``min_documents`` documents hold.

``insert`` and ``delete`` add up the counts of the changed keys and put into the filters, or take out
of them, the keys that cross the threshold; a filter that is full is built anew from the counts. Taking
documents out leaves what building without them gives.

``drop_lines`` reads texts once and asks the filters, which are small (7 to 13 bytes for each frequent
line) and go to the tasks in slices of ``SLICE_BYTES``: a further slice is a further pass over the
texts, so any number of lines works. The few keys that a filter reports wrongly are found beforehand by
asking it for all counted keys below the threshold, and go along as exceptions: the result is exact.
Texts are never shuffled, and a line that most documents hold is one row for each task in the count.

Defined results: each row is a document of its own, also rows repeated under one id or without id
(``delete`` takes out all rows of an id; rows without id stay); a null or empty text is one empty line;
lines of white space only have no key and stay; a null text stays null; texts of any length are whole;
an empty table gives no rows. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cuckoo
from .tables import pieces, shielded, stored
from .words import _LOWER, SPACED, buffer_of, slices

MIN_DOCUMENTS = 10
SHARD_KEYS = 250_000
SLICE_BYTES = 64 << 20
#: Tables of changes kept beside the counts before they are added up.
MAX_CHANGES = 8


class Lines:
    """Lines of a text column: byte bounds, the number of the first one of each row, and key bounds."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffer_of(column)
        breaks = np.flatnonzero(self.data == 0x0A)
        at = np.searchsorted(breaks, self.offsets)
        self.first = at + np.arange(len(at))
        total = int(self.first[-1])
        heads, tails = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
        heads[self.first[:-1]] = True
        tails[self.first[1:] - 1] = True
        self.heads = heads
        self.start, self.end = np.empty(total, np.int64), np.empty(total, np.int64)
        self.start[heads], self.start[~heads] = self.offsets[:-1], breaks + 1
        self.end[tails], self.end[~tails] = self.offsets[1:], breaks
        solid = np.flatnonzero(SPACED[self.data])
        low, high = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        #: Numbers of the lines that have a key.
        self.keyed = np.flatnonzero(low < high)
        self.key_start = solid[low[self.keyed]]
        self.key_end = solid[high[self.keyed] - 1] + 1

    def keys(self) -> list[bytes]:
        """The digest of each line that has a key."""
        low = _LOWER[self.data].tobytes()
        make = hashlib.blake2b
        return [
            make(low[a:b], digest_size=cuckoo.KEY_BYTES).digest()
            for a, b in zip(self.key_start.tolist(), self.key_end.tolist())
        ]

    def without(self, gone: np.ndarray, kind: pa.DataType) -> pa.Array:
        """The texts of the other lines, joined by line breaks."""
        kept = ~gone
        before = np.concatenate(([0], np.cumsum(kept)))
        follows = kept & (before[:-1] > before[np.repeat(self.first[:-1], np.diff(self.first))])
        # each line as two runs of bytes: the break before it and itself
        sizes = np.stack([~self.heads, self.end - self.start], axis=1).ravel()
        mask = np.repeat(np.stack([follows, kept], axis=1).ravel(), sizes)
        at = np.concatenate(([0], np.cumsum(mask)))[self.offsets]
        text = pa.py_buffer(self.data[mask].tobytes())
        width = np.int64 if pa.types.is_large_string(kind) else np.int32
        return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(width)), text])


@dataclass(frozen=True)
class LineIndex:
    """The tables of an index; ``counts`` may hold several rows of a key, which add up."""

    ledger: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_documents: int
    changes: int = 0


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keys) with the distinct digests of each row's lines."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column("text"))
                digest = lines.keys()
                at = np.searchsorted(lines.keyed, lines.first).tolist()
                own = [list(dict.fromkeys(digest[a:b])) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(own, pa.list_(pa.binary()))], names=["doc_id", "keys"]
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, keys array<binary>")


def _counted(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _shard(shards: int):
    """The shard of column ``key``, as ``cuckoo.shard_of`` gives it (first four bytes, little-endian)."""
    parts = [F.hex(F.substring("key", i, 1)) for i in (4, 3, 2, 1)]
    return F.pmod(F.conv(F.concat(*parts), 16, 10).cast("long"), F.lit(shards))


def _built(groups: pa.Table) -> pa.Table:
    """A filter for the keys of one shard, made larger until all find room."""
    keys = cuckoo.digests(groups.column("key").to_pylist())
    room = len(keys)
    while not cuckoo.insert(cells := cuckoo.empty(room), keys):
        room = 2 * room + 1
    return pa.table({"shard": groups.column("shard")[:1], "cells": pa.array([cells.tobytes()], pa.binary())})


def _changed(old: pa.Table, crossing: pa.Table) -> pa.Table:
    """The filter of one shard after keys came and went; null cells where it has no room."""
    shard = (crossing if crossing.num_rows else old).column("shard")[:1]
    cells = cuckoo.empty(0)
    if old.num_rows:
        cells = np.frombuffer(old.column("cells")[0].as_py(), dtype=np.uint32).reshape(-1, cuckoo.SLOTS).copy()
    fits = True
    if crossing.num_rows:
        keys = cuckoo.digests(crossing.column("key").to_pylist())
        enters = crossing.column("enters").to_numpy(zero_copy_only=False).astype(bool)
        cuckoo.delete(cells, keys[~enters])
        fits = cuckoo.insert(cells, keys[enters])
    return pa.table({"shard": shard, "cells": pa.array([cells.tobytes() if fits else None], pa.binary())})


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


def _filters(counts: DataFrame, shards: int, min_documents: int) -> DataFrame:
    frequent = counts.where(F.col("n") >= min_documents).select(_shard(shards).alias("shard"), "key")
    return frequent.groupBy("shard").applyInArrow(_built, "shard bigint, cells binary")


def build_index(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_keys: int = SHARD_KEYS,
) -> LineIndex:
    ledger = stored(line_keys(docs, doc_id, text))
    counts = stored(_counted(ledger))
    shards = pieces(counts.where(F.col("n") >= min_documents).count(), shard_keys)
    filters = stored(_filters(counts, shards, min_documents))
    return LineIndex(ledger, counts, filters, shards, min_documents)


def _apply(index: LineIndex, ledger: DataFrame, change: DataFrame) -> LineIndex:
    """The index after a table of count changes (key, n)."""
    change = stored(change)
    touched = index.counts.join(change.select("key"), "key", "left_semi")
    sums = (
        touched.select("key", "n", F.lit(0).cast("long").alias("d"))
        .union(change.select("key", F.lit(0).cast("long"), "n"))
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    )
    least = index.min_documents
    enters = F.col("n") + F.col("d") >= least
    crossing = sums.where(enters != (F.col("n") >= least)).select(
        _shard(index.shards).alias("shard"), "key", enters.alias("enters")
    )
    changed = stored(
        index.filters.groupBy("shard")
        .cogroup(crossing.groupBy("shard"))
        .applyInArrow(_changed, "shard bigint, cells binary")
    )
    counts = index.counts.union(change.select("key", "n"))
    changes = index.changes + 1
    if changes >= MAX_CHANGES:
        counts, changes = stored(_summed(counts)), 0
    full = changed.where(F.col("cells").isNull()).select("shard")
    if full.limit(1).count():
        again = _summed(counts).where(F.col("n") >= least).select(_shard(index.shards).alias("shard"), "key")
        rebuilt = again.join(full, "shard", "left_semi").groupBy("shard").applyInArrow(
            _built, "shard bigint, cells binary"
        )
        changed = stored(changed.where(F.col("cells").isNotNull()).union(rebuilt))
    return replace(index, ledger=ledger, counts=counts, filters=changed, changes=changes)


def insert(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with further documents."""
    more = stored(line_keys(docs, doc_id, text))
    return _apply(index, index.ledger.union(more), _counted(more))


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of the given ids (first column); unknown ids change nothing."""
    wanted = ids.toDF("doc_id", *[f"other_{i}" for i in range(1, len(ids.columns))]).select("doc_id")
    gone = index.ledger.join(wanted, "doc_id", "left_semi")
    rest = stored(index.ledger.join(wanted, "doc_id", "left_anti"))
    return _apply(index, rest, _counted(gone).select("key", (-F.col("n")).alias("n")))


def _slices(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shards dealt to slices of ``SLICE_BYTES`` or one shard each."""
    out, room = [[]], SLICE_BYTES
    for shard, size in sorted(sizes):
        if out[-1] and size > room:
            out.append([])
            room = SLICE_BYTES
        out[-1].append(shard)
        room -= size
    return out


def _lookup(index: LineIndex, counts: DataFrame, own: list[int]):
    """Broadcast filters of some shards, and the keys that they report wrongly."""
    spark = counts.sparkSession
    rows = index.filters.where(F.col("shard").isin(own)).collect()  # SLICE_BYTES or so
    cells = {r.shard: np.frombuffer(r.cells, dtype=np.uint32).reshape(-1, cuckoo.SLOTS) for r in rows}
    filters = spark.sparkContext.broadcast(cuckoo.Filters(cells, index.shards))

    def wrong(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = filters.value.holds(cuckoo.digests(batch.column("key").to_pylist()))
                yield batch.filter(pa.array(held))

    rare = counts.where(F.col("n") < index.min_documents).select("key")
    # one key in 5 * 10**8 or so
    return filters, frozenset(bytes(r.key) for r in rare.mapInArrow(wrong, "key binary").collect())


def drop_lines(
    docs: DataFrame, index: LineIndex, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The ``keep`` columns of each row with the text that is left, n_lines and n_dropped."""
    sizes = index.filters.select("shard", F.octet_length("cells")).collect()
    counts = _summed(index.counts) if index.changes else index.counts
    fields = {x.name: x.dataType.simpleString() for x in docs.schema.fields}
    others = [x for x in dict.fromkeys(keep) if x != text]
    schema = ", ".join(f"`{x}` {fields[x]}" for x in others)
    schema += f", `{text}` string, n_lines bigint, n_dropped bigint"
    left = docs.select(
        *others, text, F.lit(None).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")
    )
    passes = _slices([tuple(r) for r in sizes])
    for number, own in enumerate(passes):
        filters, wrong = _lookup(index, counts, own)

        def run(batches, filters=filters, wrong=wrong) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    yield _without(part, text, filters.value, wrong)

        left = left.mapInArrow(run, schema)
        if number < len(passes) - 1:
            left = stored(left)
    return left


def _without(part: pa.RecordBatch, text: str, filters: cuckoo.Filters, wrong: frozenset) -> pa.RecordBatch:
    lines = Lines(part.column(text))
    keys = lines.keys()
    gone = np.zeros(len(lines.start), dtype=bool)
    if keys:
        held = np.flatnonzero(filters.holds(cuckoo.digests(keys)))
        gone[lines.keyed[np.array([i for i in held if keys[i] not in wrong], dtype=np.int64)]] = True
    dropped = np.add.reduceat(gone.astype(np.int64), lines.first[:-1])
    before = part.column("n_lines")
    made = {
        "n_lines": pa.array(np.diff(lines.first), pa.int64()) if before.null_count else before,
        "n_dropped": pa.array(part.column("n_dropped").to_numpy() + dropped, pa.int64()),
    }
    if gone.any():
        column = part.column(text)
        left = lines.without(gone, column.type)
        made[text] = left if not column.null_count else pa.compute.if_else(column.is_valid(), left, None)
    names = part.schema.names
    return pa.RecordBatch.from_arrays([made.get(x, part.column(x)) for x in names], names=names)


def drop_repeated_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents without lines that ``min_documents`` of them hold; all columns stay."""
    inner, columns = shielded(docs, "text")
    index = build_index(inner.withColumn("id", F.lit(0)), min_documents, "id")
    return drop_lines(inner, index, tuple(inner.columns)).select(*columns)
