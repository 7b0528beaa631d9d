"""Substring dedup with a compressed FM-index for each shard.

A shard holds the distinct stretches around some selected grams (see ``passages``). Its FM-index is
built over their words; the stretches are streamed against it, and each window of ``window`` words
is searched backwards through the wavelet matrix. A search stops early once one suffix is left,
which is then the window itself. The suffix interval of a window that matches in full is the set of
its occurrences; the smallest document of the interval decides whether the window repeats.

Defined results: a null or empty text has no words; a text shorter than the window repeats nothing;
equal texts under different ids repeat as a whole, but for the smallest id; rows without an id, and
repeated rows of one id, are not earlier than anything and each give a row; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .fm_index import FMIndex
from .passages import Method, digest, without_repeats
from .words import Words

WINDOW = 13
GRAM = 5


def window_minima(words: Words, first: np.ndarray, window: int) -> np.ndarray:
    """Smallest document that holds each window of each stretch."""
    if not len(words):
        return np.empty(0, np.int64)
    _, symbol = np.unique(words.hashes(), return_inverse=True)
    place = np.arange(len(words)) + words.row  # one separator closes each stretch
    text = np.zeros(len(words) + len(words.first) - 1, dtype=np.int64)
    text[place] = symbol + 1
    start = np.flatnonzero(words.row[: len(words) - window + 1] == words.row[window - 1 :])
    index = FMIndex(text)
    length = np.full(len(start), window, np.int64)
    low, high = index.search(text, place[start] + window, length, stop_at_one=True)
    minima = first[words.row[start]]
    many = np.flatnonzero(high - low > 1)
    if len(many):
        row = np.repeat(np.arange(len(words.first) - 1), words.counts + 1)
        document = np.append(first[row[index.order]], np.iinfo(np.int64).max)
        own, back = np.unique(low[many], return_inverse=True)
        stop = np.zeros(len(own), np.int64)
        stop[back] = high[many]
        bounds = np.stack([own, stop], axis=1).ravel()
        minima[many] = np.minimum.reduceat(document, bounds)[::2][back]
    return minima


def method(window: int = WINDOW, gram: int = GRAM) -> Method:
    return Method(window, gram, lambda words, at, first: window_minima(words, first, window))


def repeated_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word counts, removed words, a digest of the kept words and the removed spans of each row."""
    return digest(docs, method(window, min(GRAM, window)))


def drop_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without their repeated words; those of which no word is left go."""
    return without_repeats(docs, method(window, min(GRAM, window)))
