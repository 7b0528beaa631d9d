"""Passages that occur in several documents: what op9 and op10 share.

A window is ``window`` consecutive words of one document; it repeats if a document with a smaller
id holds the same words. The steps:

1. Each text gives its word count, a hash of its word sequence and its selected positions
   (minimisers: every window selects one gram, equal windows the same one in themselves).
2. Documents with equal word sequences become one class, held by the smallest id; only that one
   goes on. The others repeat as a whole.
3. Grams that two documents select are counted with partial sums; only documents that hold such a
   gram go on, with the stretch around each (all windows that select it).
4. Equal stretches are merged (smallest id). They are dealt to shards by the gram, and an index of
   each shard, the operator's own, finds for each window the smallest document that holds it.
5. Grams in more than ``HOT_DOCS`` documents could fill a shard with a group that grows with the
   input. The windows of their merged stretches are dealt by a hash of all their words instead.

Only texts of candidate documents move, compressed, and once. No step gathers a group of unbounded
size: a shard holds ``SHARD_BYTES`` of distinct stretches or so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces, shielded, stored
from .words import (
    Words,
    grams,
    lists,
    minimisers,
    row_hash,
    signed,
    slices,
    spans_of,
    words_of,
)

HOT_DOCS = 1_000
SHARD_BYTES = 4 << 20
_SECOND = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Method:
    """Window and gram length, and the index: distinct stretches of a shard to window minima.

    ``match`` takes the words of the stretches (a row each), the gram's place in each and the
    smallest document of each, and returns the smallest document of each window of each stretch,
    one stretch after another.
    """

    window: int
    gram: int
    match: Callable[[Words, np.ndarray, np.ndarray], np.ndarray]


def _keys(hashes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    return row_hash(hashes, words.first), row_hash(hashes * _SECOND, words.first)


def _profiles(window: int, gram: int):
    """Word count, sequence hashes and distinct selected grams of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                hashes = words.hashes()
                key, more = _keys(hashes, words)
                _, chosen, hashed = minimisers(hashes, words.row, window, gram)
                chosen = np.unique(chosen)
                row, value = words.row[chosen], hashed[chosen]
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(row)]
                row, value = row[new], value[new]
                counts = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(words.counts), pa.array(signed(key)),
                        pa.array(signed(more)),
                        lists(signed(value), counts, pa.int64()),
                    ],
                    names=["doc_id", "n_words", "key", "more", "grams"],
                )

    return run


def _squeezed(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [squeeze.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "packed"]
        )


def _stretches(window: int, gram: int):
    """Rows of the stretches around shared grams: where they start, their words, the gram's place."""
    names = ["doc_id", "key", "gram", "is_hot", "start", "at", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]

    def one(doc_id: int, text: bytes, cold: list[int], hot: list[int]) -> Iterator[list]:
        words = words_of(pa.array([text], pa.binary()))
        hashes = words.hashes()
        key = int(signed(_keys(hashes, words)[0])[0])
        start, chosen, hashed = minimisers(hashes, words.row, window, gram)
        value = signed(hashed[chosen])
        head = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])[: len(chosen)])
        stop = np.append(head[1:], len(chosen))
        for grams_of_kind, is_hot in ((cold, False), (hot, True)):
            own = np.isin(value[head], grams_of_kind)
            for a, b in zip(head[own].tolist(), stop[own].tolist()):
                run = words.text(start[a], start[b - 1] + window)
                yield [doc_id, key, value[a], is_hot, start[a], chosen[a] - start[a], run]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        rows: list[list] = []
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("doc_id", "packed", "cold", "hot")]
            for doc_id, packed, cold, hot in zip(*columns):
                rows.extend(one(doc_id, unpack.decompress(packed), cold, hot))
                if len(rows) >= 20_000:
                    yield _rows(rows, kinds, names)
                    rows = []
        yield _rows(rows, kinds, names)

    return run


def _windows(window: int):
    """Rows of the windows of stretches, by two hashes of their words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "words"):
                words = words_of(part.column("words"))
                hashes = words.hashes()
                (one, inside), (two, _) = (grams(h, words.row, window) for h in (hashes, hashes * _SECOND))
                at = np.flatnonzero(inside)
                row = words.row[at]
                names = ["hash", "more", "first_id"]
                kept = [part.column(x).take(pa.array(row)) for x in names]
                made = [at - words.first[row], signed(one[at]), signed(two[at])]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(x) for x in made)], names=[*names, "i", "own", "other"]
                )

    return run


def _rows(rows: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names
    )


def _matched(method: Method):
    def run(shard: pa.Table) -> pa.Table:
        words = words_of(shard.column("words"))
        at = shard.column("at").to_numpy().astype(np.int64)
        first = shard.column("first_id").to_numpy().astype(np.int64)
        minima = method.match(words, at, first)
        return pa.table({
            "hash": shard.column("hash"),
            "more": shard.column("more"),
            "minima": lists(minima, words.counts - method.window + 1, pa.int64()),
        })

    return run


@dataclass
class Repeats:
    """Word counts and classes of all rows, candidates' texts, and the repeating windows."""

    profile: DataFrame  # doc_id, n_words, key, more, first_id
    texts: DataFrame  # doc_id, packed: texts that hold shared grams
    starts: DataFrame  # doc_id, key, starts: first words of the repeating windows


def find_repeats(docs: DataFrame, method: Method) -> Repeats:
    """Repeating windows of the documents (doc_id, text); see the module's description."""
    window, gram = method.window, method.gram
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    profile = stored(
        rows.mapInArrow(
            _profiles(window, gram),
            "doc_id bigint, n_words bigint, key bigint, more bigint, grams array<bigint>",
        )
    )
    classes = profile.where("doc_id is not null").groupBy("key", "more").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")
    )
    known = stored(
        profile.drop("grams")
        .join(classes.where("n_copies > 1").hint("shuffle_merge"), ["key", "more"], "left")
        .select("doc_id", "n_words", "key", "more", F.coalesce("first_id", "doc_id").alias("first_id"))
    )
    copies = known.where("first_id < doc_id").select("doc_id", "key").distinct()
    heads = (
        profile.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
        .select("doc_id", "key", "grams")
        .join(copies.hint("shuffle_merge"), ["doc_id", "key"], "left_anti")
    )
    held = heads.select("doc_id", F.explode("grams").alias("gram"))
    shared = stored(
        held.groupBy("gram")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
        .where("a < b")
        .select("gram", (F.col("n") > HOT_DOCS).alias("is_hot"))
    )
    candidates = (
        held.join(shared.hint("shuffle_merge"), "gram")
        .groupBy("doc_id")
        .agg(
            F.collect_list(F.when(~F.col("is_hot"), F.col("gram"))).alias("cold"),
            F.collect_list(F.when(F.col("is_hot"), F.col("gram"))).alias("hot"),
        )
    )
    packed = rows.where("doc_id is not null").mapInArrow(_squeezed, "doc_id bigint, packed binary")
    texts = stored(packed.join(candidates.hint("shuffle_merge"), "doc_id"))
    found = stored(
        texts.mapInArrow(
            _stretches(window, gram),
            "doc_id bigint, key bigint, gram bigint, is_hot boolean, start int, at int, words binary",
        )
        .withColumn("hash", F.xxhash64("words", "at"))
        .withColumn("more", F.xxhash64("at", "words", F.lit(1)))
    )
    stretch = found.groupBy("gram", "is_hot", "hash", "more", "at", "words").agg(
        F.min("doc_id").alias("first_id")
    )
    size = found.where("not is_hot").agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("gram"), F.lit(pieces(size, SHARD_BYTES)))
    cold = (
        stretch.where("not is_hot")
        .withColumn("shard", shard)
        .groupBy("shard")
        .applyInArrow(_matched(method), "hash bigint, more bigint, minima array<bigint>")
    )
    windows = stored(
        stretch.where("is_hot")
        .select("hash", "more", "first_id", "words")
        .mapInArrow(
            _windows(window),
            "hash bigint, more bigint, first_id bigint, i bigint, own bigint, other bigint",
        )
    )
    lows = windows.groupBy("own", "other").agg(F.min("first_id").alias("low"))
    hot = (
        windows.join(lows.hint("shuffle_merge"), ["own", "other"])
        .groupBy("hash", "more")
        .agg(F.array_sort(F.collect_list(F.struct("i", "low"))).alias("all"))
        .select("hash", "more", F.col("all.low").alias("minima"))
    )
    early = F.transform("minima", lambda m, i: F.when(m < F.col("doc_id"), F.col("start") + i))
    starts = (
        found.select("doc_id", "key", "start", "hash", "more")
        .join(cold.unionByName(hot).hint("shuffle_merge"), ["hash", "more"])
        .select("doc_id", "key", F.filter(early, lambda x: x.isNotNull()).alias("starts"))
        .where("size(starts) > 0")
        .groupBy("doc_id", "key")
        .agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    )
    return Repeats(known, texts.select("doc_id", "packed"), starts)


def _covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Flags of the words that the windows at ``starts`` cover."""
    depth = np.zeros(n_words + window, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + window, -1)
    return np.cumsum(depth[:n_words]) > 0


def repeated_spans(found: Repeats, window: int) -> DataFrame:
    """(doc_id, key, n_words, spans) of each distinct document that repeats something.

    Spans are bounds (start, end) in words, sorted and apart.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = []
            for n, starts in zip(batch.column("n_words").to_pylist(), batch.column("starts").to_pylist()):
                hit = _covered(n, np.array(starts, dtype=np.int64), window)
                spans.append([{"start": int(a), "end": int(b)} for a, b in spans_of(hit)])
            made = [batch.column("doc_id"), batch.column("key"), batch.column("n_words")]
            yield pa.RecordBatch.from_arrays(
                [*made, pa.array(spans, kind)], names=["doc_id", "key", "n_words", "spans"]
            )

    of = found.profile
    copies = of.where((F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)).select(
        "doc_id",
        "key",
        "n_words",
        F.array(
            F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))
        ).alias("spans"),
    )
    heads = (
        found.starts.join(
            of.where("doc_id is not null").select("doc_id", "key", "n_words").distinct(),
            ["doc_id", "key"],
        )
        .select("doc_id", "key", "n_words", "starts")
        .mapInArrow(
            run, "doc_id bigint, key bigint, n_words bigint, spans array<struct<start:int,end:int>>"
        )
    )
    return copies.distinct().unionByName(heads)


def without_repeats(docs: DataFrame, method: Method) -> DataFrame:
    """The documents with the repeated words cut out of the text, white space as it was.

    Rows that repeat nothing keep their text unchanged; those of which no word is left go.
    """
    found = repeated_spans(find_repeats(docs, method), method.window)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("key", "spans")).alias("of_key"))
    inner, columns = shielded(docs, "doc_id", "text")
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in inner.schema.fields)
    joined = inner.join(spans.hint("shuffle_merge"), "doc_id", "left").select(*inner.columns, "of_key")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut(part)

    cut = joined.mapInArrow(run, f"{fields}, n_words bigint, n_removed bigint")
    return cut.where("n_removed = 0 or n_removed < n_words").select(*columns)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    words = words_of(batch.column("text"))
    keys = signed(_keys(words.hashes(), words)[0])
    removed = [0] * len(texts)
    for i, found in enumerate(batch.column("of_key").to_pylist()):
        spans = next((x["spans"] for x in found or () if x["key"] == keys[i]), None)
        if spans and texts[i]:
            raw, base, first = texts[i].encode(), words.offsets[i], words.first[i]
            kept, at = [], 0
            for s in spans:
                kept.append(raw[at : words.start[first + s["start"]] - base])
                at = words.end[first + s["end"] - 1] - base
            texts[i] = b"".join([*kept, raw[at:]]).decode()
            removed[i] = sum(s["end"] - s["start"] for s in spans)
    names = [x for x in batch.schema.names if x != "of_key"]
    made = {"text": pa.array(texts, batch.schema.field("text").type)}
    columns = [made.get(x, batch.column(x)) for x in names]
    columns += [pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed"])


def digest(docs: DataFrame, method: Method) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; kept words joined by a space.

    The rows that repeat nothing are digested where they are scanned; only the texts of the others
    are read again, from the candidates that were stored for the search.
    """
    found = find_repeats(docs, method)
    spans = stored(repeated_spans(found, method.window))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    plain = whole.mapInArrow(
        _digest_all, "doc_id bigint, n_words bigint, key bigint, kept_sha256 string"
    )
    cut = (
        spans.where("size(spans) > 1 or spans[0].end - spans[0].start < n_words")
        .join(found.texts.hint("shuffle_merge"), "doc_id")
        .mapInArrow(_digest_cut, "doc_id bigint, key bigint, kept_sha256 string")
        .distinct()
    )
    gone = spans.where("size(spans) = 1 and spans[0].end - spans[0].start = n_words").select(
        "doc_id", "key", F.sha2(F.lit(""), 256).alias("kept_sha256")
    )
    changed = (
        cut.unionByName(gone)
        .join(spans.drop("n_words"), ["doc_id", "key"])
        .withColumnRenamed("kept_sha256", "cut_sha256")
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans_or_none = F.coalesce("spans", none)
    removed = F.aggregate(
        spans_or_none, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]
    )
    return plain.join(changed.hint("shuffle_merge"), ["doc_id", "key"], "left").select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"),
        spans_or_none.alias("spans"),
    )


def _digest_all(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"))
            digests = [
                hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest()
                for x in part.column("text").to_pylist()
            ]
            key = signed(_keys(words.hashes(), words)[0])
            made = [pa.array(words.counts, pa.int64()), pa.array(key), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *made], names=["doc_id", "n_words", "key", "kept_sha256"]
            )


def _digest_cut(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            data = unpack.decompress(row["packed"])
            words = words_of(pa.array([data], pa.binary()))
            if int(signed(_keys(words.hashes(), words)[0])[0]) != row["key"]:
                continue  # another row of the same id
            hit = np.zeros(len(words), dtype=bool)
            for s in row["spans"]:
                hit[s["start"] : s["end"]] = True
            kept = [data[a:b] for a, b in zip(words.start[~hit], words.end[~hit])]
            out.append((row["doc_id"], row["key"], hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield _rows(out, [pa.int64(), pa.int64(), pa.string()], ["doc_id", "key", "kept_sha256"])
