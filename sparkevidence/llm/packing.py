"""Best-fit packing of token sequences by hierarchical residual packing.

Round 0 tokenises and packs where the texts are: each task cuts documents into pieces and puts them
best-fit into bins, longest first. Nearly full bins are final. Underfull bins, with all their
pieces, become items of the next round: groups of tasks' leftovers are dealt to fewer tasks, packed
again best-fit, and so on up the tree. A round deals at most ``GROUP_ITEMS`` bins to a task, at
random when one task no longer holds them all; rounds end when one group was left or when a round
saves less than one bin in a hundred. Only what is left after that many rounds stays underfull.

A bin holds at most ``capacity`` tokens, hence at most that many pieces, so a row is bounded. Token
ids stay with the pieces only when asked for.

Defined results: a null or empty text is its end token alone; longer documents are cut so that all
pieces but the first are full; repeated rows are packed each; an empty table gives no bins; a null
id is kept. Only the named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tables import pieces, stored
from .words import Words, mix, slices, words_of

CAPACITY = 2048
END_TOKEN = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
GROUP_ITEMS = 30_000
NEARLY_FULL = 0.995
CACHE_ENTRIES = 1_000_000
LEARNT_TOGETHER = 256
SPACE_BYTE = "\u0120"  # the byte 0x20 in the alphabet of byte-level tokenizers

UNSPACED = np.arange(256) != 0x20
_TWO_SPACES = re.compile(r"\s | \s|^ | \Z")
#: White space of one byte, and first bytes of all longer white space.
_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])

_PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:int,ids_crc32:bigint,ids:array<int>>"
BINS = f"fill int, pieces array<{_PIECE}>"
_PIECE_TYPE = pa.struct([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
    ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())),
])


class Encoder:
    """Token ids of whole texts, with the ids of space-separated stretches remembered.

    A byte-level tokenizer splits a text before any single space between two other characters, so
    the stretches between such spaces can be encoded alone; its added tokens hold no space. Texts with
    other white space beside a space, and all texts of other tokenizers, are encoded whole.

    Stretches are told apart by a 64-bit hash, for a whole batch at once. New ones are encoded
    ``LEARNT_TOGETHER`` at a time as one text; a token that begins with the byte of a space opens the
    next one. Hashes and ids are flat arrays, emptied at ``CACHE_ENTRIES``. The tokenizer starts no
    threads of its own: tasks keep the cores busy, and each thread would hold memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        splitter = type(self.tokenizer.pre_tokenizer).__name__
        self.splits = splitter == "ByteLevel" and self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE_BYTE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by key
        self.bounds, self.ids = np.zeros(1, np.int64), np.empty(0, "<u4")  # of each entry

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _behind_space(self, words: Words, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the chosen stretches, each with the space before it, and their number in each."""
        texts, parts = [], [which[i : i + LEARNT_TOGETHER] for i in range(0, len(which), LEARNT_TOGETHER)]
        for part in parts:
            at, size = words.start[part] - 1, words.end[part] - words.start[part] + 1
            texts.append(words.data[runs_of(at, size)].tobytes().decode())
        for part, ids in zip(parts, self._whole(texts)):
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(part) and first[0] == 0:
                yield ids, np.diff(np.append(first, len(ids)))
            else:
                alone = self._whole([" " + words.text(i, i + 1).decode() for i in part.tolist()])
                yield np.concatenate(alone), np.array([len(x) for x in alone])

    def _learn(self, words: Words, keys: np.ndarray, which: np.ndarray, head: np.ndarray) -> None:
        """Add the stretches ``which`` under their keys; ``head`` tells those that begin a text."""
        behind, heads = which[~head], which[head]
        found = list(self._behind_space(words, behind))
        found += [(x, [len(x)]) for x in self._whole([words.text(i, i + 1).decode() for i in heads.tolist()])]
        new = np.concatenate((keys[~head], keys[head]))
        entry = len(self.bounds) - 1 + np.arange(len(new))
        self.ids = np.concatenate([self.ids, *(x for x, _ in found)])
        sizes = np.concatenate([n for _, n in found])
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
        order = np.argsort(new)
        at = np.searchsorted(self.keys, new[order])
        self.keys, self.entry = np.insert(self.keys, at, new[order]), np.insert(self.entry, at, entry[order])

    def _entries(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entry[at], -1)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null has none."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.splits:
            return [x.tobytes() for x in self._whole([x or "" for x in column.to_pylist()])]
        if len(self.keys) > CACHE_ENTRIES:
            self._forget()
        words = words_of(column, UNSPACED)
        head = words.start == words.offsets[words.row]
        keys = mix(words.hashes() + head.astype(np.uint64))
        kinds, at, of = np.unique(keys, return_index=True, return_inverse=True)
        new = np.flatnonzero(self._entries(kinds) < 0)
        if len(new):
            self._learn(words, kinds[new], at[new], head[at[new]])
        entry = self._entries(kinds)[of]
        size = self.bounds[entry + 1] - self.bounds[entry]
        data = self.ids[runs_of(self.bounds[entry], size)].tobytes()
        ends = 4 * np.append(0, np.cumsum(size))[words.first]
        out = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        whole = [i for i in _beside_space(words).tolist() if _TWO_SPACES.search(column[i].as_py())]
        for i, ids in zip(whole, self._whole([column[i].as_py() for i in whole])):
            out[i] = ids.tobytes()
        return out


def runs_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs of some sizes, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _beside_space(words: Words) -> np.ndarray:
    """Rows that may hold white space beside a space, or a space at an end; few others among them."""
    data, offsets = words.data, words.offsets
    space = np.flatnonzero(data == 0x20)
    row = np.searchsorted(offsets, space, side="right") - 1
    around = np.concatenate((np.full(3, 0x20, np.uint8), data, np.full(1, 0x20, np.uint8)))
    before, after = around[space + 2], around[space + 4]
    odd = _WHITE[before] | _WHITE[after] | _WIDE[after] | (around[space + 1] == 0xC2) | _WIDE[around[space]]
    odd |= (space == offsets[row]) | (space + 1 == offsets[row + 1])
    return np.unique(row[odd])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; all but the first are full."""
    first = total % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, total, capacity)]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if room > size:
            open_bins[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def _bins(fill: list[int], rows: list[list[dict]]) -> pa.RecordBatch:
    made = [pa.array(fill, pa.int32()), pa.array(rows, pa.list_(_PIECE_TYPE))]
    return pa.RecordBatch.from_arrays(made, names=["fill", "pieces"])


def _packed(items: list[tuple[int, list]], capacity: int) -> Iterator[pa.RecordBatch]:
    bins = best_fit(np.array([x[0] for x in items], dtype=np.int64), capacity)
    for a in range(0, len(bins), 2048):
        part = bins[a : a + 2048]
        yield _bins(
            [sum(items[i][0] for i in own) for own in part],
            [[piece for i in own for piece in items[i][1]] for own in part],
        )


def _first_round(path: str, capacity: int, with_ids: bool):
    def document_pieces(doc_id, data: bytes) -> Iterator[tuple[int, list]]:
        data += END_TOKEN.to_bytes(4, "little")
        for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
            own = data[4 * start : 4 * (start + length)]
            ids = np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None
            piece = (doc_id, k, start, length, zlib.crc32(own), ids)
            yield length, [dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), piece))]

    def run(batches):
        items: list[tuple[int, list]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                encoded = encoder(path).encode(part.column("text"))
                for doc_id, data in zip(part.column("doc_id").to_pylist(), encoded):
                    items.extend(document_pieces(doc_id, data))
            if len(items) >= GROUP_ITEMS:  # bounds the task, whatever its input
                yield from _packed(items, capacity)
                items = []
        yield from _packed(items, capacity)

    return run


def _next_round(capacity: int):
    def run(batches):
        items: list[tuple[int, list]] = []
        for batch in batches:
            items.extend(zip(batch.column("fill").to_pylist(), batch.column("pieces").to_pylist()))
            if len(items) >= 2 * GROUP_ITEMS:
                yield from _packed(items, capacity)
                items = []
        yield from _packed(items, capacity)

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    with_ids: bool = False,
    fan_in: int = 8,
) -> DataFrame:
    """Bins (sequence_id, fill, pieces) of all documents (doc_id, text).

    Pieces stand in the order of their offsets; ``with_ids`` adds their token ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = int(capacity * NEARLY_FULL)
    bins = stored(rows.mapInArrow(_first_round(tokenizer, capacity, with_ids), BINS))
    done, left = [bins.where(F.col("fill") >= full)], bins.where(F.col("fill") < full)
    count = left.count()
    groups = max(1, left.rdd.getNumPartitions())
    while count > 1:
        groups = max(pieces(count, GROUP_ITEMS), groups // fan_in)
        seed = F.xxhash64(F.col("pieces")[0]["doc_id"], F.size("pieces"), F.lit(len(done)))
        dealt = left.repartition(groups, seed) if groups > 1 else left.coalesce(1)
        bins = stored(dealt.mapInArrow(_next_round(capacity), BINS))
        done.append(bins.where(F.col("fill") >= full))
        left = bins.where(F.col("fill") < full)
        before, total = count, bins.count()
        count = left.count()
        if groups == 1 or groups == pieces(before, GROUP_ITEMS) and total > 0.99 * before:
            break
    packed = left
    for part in done:
        packed = packed.unionByName(part)
    return packed.select(F.monotonically_increasing_id().alias("sequence_id"), "fill", "pieces")


def placed_pieces(bins: DataFrame) -> DataFrame:
    """One row for each piece with its sequence and its offset there."""
    each = bins.select("sequence_id", F.col("pieces.length").alias("l"), F.posexplode("pieces"))
    before = F.aggregate(F.slice("l", 1, F.col("pos")), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select(
        "col.doc_id",
        "col.piece",
        "col.start",
        F.col("col.length").cast("long").alias("length"),
        "col.ids_crc32",
        "sequence_id",
        before.alias("offset"),
        "col.ids",
    )
