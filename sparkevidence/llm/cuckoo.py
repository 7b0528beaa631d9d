"""Cuckoo filters as arrays: buckets of four 32-bit fingerprints, whole batches of keys at once.

A key is a 16-byte digest. Its bytes give the shard, the fingerprint and the first bucket; the second
bucket is the first one xor a hash of the fingerprint, so a fingerprint can move, and be deleted,
without its key. A filter never misses a key it holds, and takes another for one of its own about once
in 5 * 10**8 keys.
"""

from __future__ import annotations

import numpy as np

from .words import mix

SLOTS = 4
MAX_LOAD = 0.8
ROUNDS = 500
KEY_BYTES = 16


def digests(keys: list[bytes]) -> np.ndarray:
    """Keys as an array of four 32-bit numbers each."""
    return np.frombuffer(b"".join(keys), dtype="<u4").reshape(-1, KEY_BYTES // 4)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0] % np.uint32(shards)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of the key, 0 excepted, which marks a free slot."""
    return np.maximum(keys[:, 1], np.uint32(1))


def _place(keys: np.ndarray) -> np.ndarray:
    return keys[:, 2].astype(np.uint64) | (keys[:, 3].astype(np.uint64) << np.uint64(32))


def _jump(prints: np.ndarray) -> np.ndarray:
    return mix(prints.astype(np.uint64))


def buckets_for(n: int) -> int:
    """A power of two of buckets that n keys fill to ``MAX_LOAD`` at most."""
    need = max(1, int(np.ceil(n / (SLOTS * MAX_LOAD))))
    return 1 << (need - 1).bit_length()


def empty(n: int) -> np.ndarray:
    return np.zeros((buckets_for(n), SLOTS), dtype=np.uint32)


def _turns(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and the number of each entry among those of its bucket."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    head = np.concatenate(([True], own[1:] != own[:-1]))
    return order, np.arange(len(own)) - np.flatnonzero(head)[np.cumsum(head) - 1]


def insert(cells: np.ndarray, keys: np.ndarray) -> bool:
    """Add keys in place; False, with the filter spoilt, if there is no room for all."""
    if not len(keys):
        return True
    if np.count_nonzero(cells) + len(keys) > MAX_LOAD * cells.size:
        return False
    mask = np.uint64(len(cells) - 1)
    prints, bucket = fingerprint(keys), (_place(keys) & mask).astype(np.int64)
    rnd = np.random.default_rng(len(keys))
    for step in range(ROUNDS):
        order, turn = _turns(bucket)
        prints, bucket = prints[order], bucket[order]
        free = cells[bucket] == 0
        fits = turn < free.sum(axis=1)
        slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), turn[fits]]
        cells[bucket[fits], slot] = prints[fits]
        prints, bucket = prints[~fits], bucket[~fits]
        if not len(prints):
            return True
        if step:  # one entry of each full bucket takes the place of another, which moves on
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            slot = rnd.integers(0, SLOTS, len(first))
            at = bucket[first]
            out = cells[at, slot]
            cells[at, slot] = prints[first]
            prints[first] = out
        bucket = ((bucket.astype(np.uint64) ^ _jump(prints)) & mask).astype(np.int64)
    return False


def delete(cells: np.ndarray, keys: np.ndarray) -> None:
    """Take out keys that were put in, in place; one fingerprint goes for each."""
    mask = np.uint64(len(cells) - 1)
    prints, bucket = fingerprint(keys), (_place(keys) & mask).astype(np.int64)
    for _ in range(2):
        missed = [(prints[:0], bucket[:0])]
        while len(prints):  # one key of each bucket at a time
            order, turn = _turns(bucket)
            prints, bucket, now = prints[order], bucket[order], turn == 0
            match = cells[bucket[now]] == prints[now][:, None]
            found = match.any(axis=1)
            cells[bucket[now][found], match[found].argmax(axis=1)] = 0
            missed.append((prints[now][~found], bucket[now][~found]))
            prints, bucket = prints[~now], bucket[~now]
        prints, bucket = (np.concatenate(x) for x in zip(*missed))
        bucket = ((bucket.astype(np.uint64) ^ _jump(prints)) & mask).astype(np.int64)


class Filters:
    """Filters of some shards, laid end to end, for lookups of keys of any shard."""

    def __init__(self, cells: dict[int, np.ndarray], shards: int):
        self.shards = shards
        self.base = np.full(shards, -1, dtype=np.int64)
        self.mask = np.zeros(shards, dtype=np.uint64)
        at = 0
        for shard, own in cells.items():
            self.base[shard], self.mask[shard] = at, len(own) - 1
            at += len(own)
        self.cells = np.concatenate([*cells.values(), np.zeros((1, SLOTS), np.uint32)])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys a filter reports; keys of other shards are never reported."""
        shard = shard_of(keys, self.shards)
        base, mask = self.base[shard], self.mask[shard]
        prints, place = fingerprint(keys), _place(keys)
        other = place ^ _jump(prints)
        here = base >= 0
        found = np.zeros(len(keys), dtype=bool)
        for spot in (place, other):
            bucket = np.where(here, base + (spot & mask).astype(np.int64), len(self.cells) - 1)
            found |= (self.cells[bucket] == prints[:, None]).any(axis=1)
        return found & here
