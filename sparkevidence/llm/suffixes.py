"""Suffix-array dedup with sparse suffix arrays.

Only the suffixes that start at selected positions (minimisers of a window of words) are kept, one
in about twenty; every passage of ``window`` words holds one, at the same place in each copy. A
shard's suffixes are sorted, and neighbours compared: their common prefixes give how far matches
reach to the right of the position. The words to the left, read backwards, are sorted and compared
in the same way and extend the matches to the left. Two copies of a window agree in both parts, so
the windows fall into classes, and the smallest document of its class decides whether one repeats.

A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
id; windows are judged on the input. Defined results are those of ``substrings``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .passages import Method, digest, without_repeats
from .words import Words

WINDOW = 50
GRAM = 8


def _sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of symbol rows (0 fills them up) and the common prefix of each with the one before."""
    n, width = rows.shape
    text = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel()
    order = np.argsort(text, kind="stable")
    same = (rows[order[1:]] == rows[order[:-1]]) & (rows[order[1:]] > 0)
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, np.concatenate(([0], common))


def _cut_out(symbol: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, width: int):
    """Rows of ``width`` symbols read from ``start`` on (or back), 0 beyond ``size``."""
    at = np.arange(width)
    place = start[:, None] + step * at
    return np.where(at < size[:, None], symbol[np.clip(place, 0, len(symbol) - 1)], 0)


def window_minima(words: Words, at: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Smallest document that holds each window of each stretch; ``at`` is the selected position."""
    n_windows = words.counts - window + 1
    out_at = np.concatenate(([0], np.cumsum(n_windows)))
    out = np.repeat(first, n_windows)
    if not len(words):
        return out
    _, symbol = np.unique(words.hashes(), return_inverse=True)
    symbol = symbol.ravel() + 1
    anchor = words.first[:-1] + at
    order_r, common_r = _sorted_prefixes(
        _cut_out(symbol, anchor, np.minimum(words.first[1:] - anchor, window), 1, window)
    )
    reach = window - gram
    order_l, common_l = _sorted_prefixes(
        _cut_out(symbol, anchor - 1, np.minimum(at, reach), -1, max(reach, 1))
    )
    right, left = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for back in range(reach + 1):  # windows that start ``back`` words before the position
        has = np.flatnonzero((at >= back) & (at - back < n_windows))
        if not len(has):
            continue
        right[order_r] = np.cumsum(common_r < window - back)
        left[order_l] = np.cumsum(common_l < back) if back else 0
        kind = right[has] * (len(at) + 1) + left[has]
        by = np.argsort(kind, kind="stable")
        head = np.flatnonzero(np.append(True, kind[by][1:] != kind[by][:-1]))
        low = np.minimum.reduceat(first[has[by]], head)
        place = out_at[has] + at[has] - back
        out[place[by]] = np.repeat(low, np.diff(np.append(head, len(by))))
    return out


def method(window: int = WINDOW, gram: int = GRAM) -> Method:
    return Method(
        window, gram, lambda words, at, first: window_minima(words, at, first, window, gram)
    )


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word counts, removed words, a digest of the kept words and the removed spans of each row."""
    return digest(docs, method(window, min(GRAM, window)))


def drop_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated passages; those of which no word is left go."""
    return without_repeats(docs, method(window, min(GRAM, window)))
