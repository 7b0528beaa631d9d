"""Benchmark decontamination with an FM-index for each shard of the training texts.

A task cuts its texts into shards of a few MB. The words of a shard become symbols: a word of the
test phrases its number, any other word a separator, and stretches shorter than the shortest phrase
go, since no phrase fits in them. The shard's FM-index is searched backwards for all phrases at
once; occurrences are located by sampled suffix positions, and their word spans are merged.

Nothing is shuffled. The phrases go to the tasks in blocks of bounded size (``BLOCK_BYTES`` of item
text); each block is one more pass over the rows in the same stage, so any number of items works.

Defined results: a null or empty text has no words and no hits; a null or empty item is no phrase;
an item without id marks words but is not listed; repeated items count once by id; every input row
gives one output row, so repeated rows stay; an empty benchmark leaves all rows clean. Of the
documents only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .tables import pieces, shielded
from .words import ALNUM, Words, lists, slices, spans_of, words_of

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
HITS = "n_words bigint, hits array<struct<start:int,end:int>>, item_ids array<string>"


class Phrases:
    """Windows of a block of items: distinct word sequences and the items each belongs to."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], window: int):
        words = words_of(pa.array(texts, pa.string()), ALNUM, lower=True)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        owners: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            size = min(window, b - a)
            for at in range(a, b - size + 1) if size else ():
                run = symbols[at : at + size]
                owners.setdefault(run.tobytes(), (run, set()))[1].add(i)
        runs = [run for run, _ in owners.values()]
        self.text = np.concatenate(runs) if runs else np.empty(0, np.int64)
        self.length = np.array([len(r) for r in runs], dtype=np.int64)
        self.end = np.cumsum(self.length)
        self.shortest = int(self.length.min()) if runs else 0
        self.names = np.array(["" if x is None else x for x in item_ids], dtype=object)
        named = [[i for i in sorted(of) if item_ids[i] is not None] for _, of in owners.values()]
        self.owner_at = np.concatenate(([0], np.cumsum([len(x) for x in named]))).astype(np.int64)
        self.owner = np.array([i for x in named for i in x], dtype=np.int64)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes
        return np.where(known, at + 1, 0)


def _expand(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers at[i], at[i] + 1, ... (count[i] of them), one after another."""
    return np.repeat(at - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and first word of each occurrence in one shard."""
    none = np.empty(0, np.int64)
    if not len(phrases.length) or not len(words):
        return none, none
    symbols = phrases.symbols(words.hashes())
    head = np.concatenate(([True], words.row[1:] != words.row[:-1]))
    known = symbols > 0
    opens = known & (head | np.concatenate(([True], ~known[:-1])))
    starts = np.flatnonzero(opens)
    closes = known & np.append(opens[1:] | ~known[1:], True)
    size = np.flatnonzero(closes) + 1 - starts
    starts, size = starts[size >= phrases.shortest], size[size >= phrases.shortest]
    if not len(starts):
        return none, none
    word = _expand(starts, size + 1)  # each run and one place for its separator
    text = np.where(np.arange(len(word)) == np.repeat(np.cumsum(size + 1) - 1, size + 1), 0, 1)
    text = np.where(text == 1, symbols[np.minimum(word, len(symbols) - 1)], 0)
    index = FMIndex(text).compact()
    low, high = index.search(phrases.text, phrases.end, phrases.length)
    found = np.flatnonzero(low < high)
    phrase = np.repeat(found, (high - low)[found])
    place = index.locate(_expand(low[found], (high - low)[found]))
    return phrase, word[place]


def _mark(batch: pa.RecordBatch, text: str, phrases: Phrases) -> pa.RecordBatch:
    words = words_of(batch.column(text), ALNUM, lower=True)
    phrase, at = occurrences(words, phrases)
    n = batch.num_rows
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + phrases.length[phrase], -1)
    hit = np.cumsum(depth[:-1]) > 0
    items = [set(x or ()) for x in batch.column("item_ids").to_pylist()]
    before = batch.column("hits").to_pylist()
    for i in np.flatnonzero([bool(x) for x in before]):
        for span in before[i]:
            hit[words.first[i] + span["start"] : words.first[i] + span["end"]] = True
    count = (phrases.owner_at[1:] - phrases.owner_at[:-1])[phrase]
    row = np.repeat(words.row[at], count)
    item = phrases.owner[_expand(phrases.owner_at[phrase], count)] if len(phrase) else row
    for pair in np.unique(np.stack([row, item], axis=1), axis=0) if len(row) else ():
        items[pair[0]].add(phrases.names[pair[1]])
    spans = [[] for _ in range(n)]
    for i in np.unique(words.row[hit]):
        a, b = words.first[i], words.first[i + 1]
        spans[i] = [{"start": int(s), "end": int(e)} for s, e in spans_of(hit[a:b])]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    made = {
        "n_words": pa.array(words.counts, pa.int64()),
        "hits": pa.array(spans, kind),
        "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
    }
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([made.get(x, batch.column(x)) for x in names], names=names)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``keep`` columns of each row with n_words, merged hit spans (in words) and item ids."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = pieces(size, BLOCK_BYTES)
    fields = {x.name: x.dataType.simpleString() for x in docs.schema.fields}
    carried = list(dict.fromkeys((*keep, text)))
    marked = docs.select(
        *carried,
        F.lit(None).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("hits"),
        F.lit(None).cast("array<string>").alias("item_ids"),
    )
    for block in range(blocks):
        own = F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block
        rows = items.where(own).select("i", "t").collect()  # BLOCK_BYTES of item text or so
        names = sorted(((r.i, r.t) for r in rows), key=lambda r: (r[0] or "", r[1] or ""))
        phrases = docs.sparkSession.sparkContext.broadcast(
            Phrases([r[0] for r in names], [r[1] for r in names], window)
        )
        out = carried if block < blocks - 1 else list(keep)
        schema = ", ".join(f"`{x}` {fields[x]}" for x in out) + ", " + HITS

        def run(batches, phrases=phrases, out=tuple(out)):
            for batch in batches:
                for part in slices(batch, text, SHARD_BYTES):
                    yield _mark(part, text, phrases.value).select([*out, "n_words", "hits", "item_ids"])

        marked = marked.mapInArrow(run, schema)
    return marked


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without the words inside test phrases; clean texts stay as they are.

    A hit span goes with the white space and punctuation between its words. A document of which no
    word is left goes if it had a hit.
    """
    inner, columns = shielded(docs, "text")
    found = find_contamination(inner, benchmark, window, keep=tuple(inner.columns))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut(part)

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in inner.schema.fields)
    return (
        found.mapInArrow(cut, f"{fields}, n_words bigint, n_hit bigint")
        .where("n_hit = 0 or n_hit < n_words")
        .select(*columns)
    )


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, hits = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
    words = words_of(batch.column("text"), ALNUM, lower=True)
    for i, spans in enumerate(hits):
        if spans:
            raw, base, first = texts[i].encode(), words.offsets[i], words.first[i]
            kept, at = [], 0
            for s in spans:
                kept.append(raw[at : words.start[first + s["start"]] - base])
                at = words.end[first + s["end"] - 1] - base
            texts[i] = b"".join([*kept, raw[at:]]).decode()
    n_hit = [sum(s["end"] - s["start"] for s in x) for x in hits]
    names = [x for x in batch.schema.names if x not in ("hits", "item_ids")]
    made = {"text": pa.array(texts, batch.schema.field("text").type)}
    columns = [made.get(x, batch.column(x)) for x in names] + [pa.array(n_hit, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "n_hit"])
