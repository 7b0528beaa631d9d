"""Repeated passages (FM-index and sparse suffix arrays) and the index itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from sparkevidence.llm import passages, substrings, suffixes
from sparkevidence.llm.fm_index import FMIndex, suffix_order
from sparkevidence.llm.words import minimisers, words_of


def found(df):
    return sorted(
        ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr
    )


@pytest.mark.parametrize("hot_docs", [1, 1_000])
@pytest.mark.parametrize("window", [13, 4])
def test_substrings(mixed, mixed_rows, monkeypatch, window, hot_docs):
    monkeypatch.setattr(passages, "HOT_DOCS", hot_docs)
    assert found(substrings.repeated_substrings(mixed, window)) == brute.repeats(mixed_rows, window)


@pytest.mark.parametrize("window", [50, 12, 3])
def test_suffixes(mixed, mixed_rows, window):
    assert found(suffixes.repeated_passages(mixed, window)) == brute.repeats(mixed_rows, window)


def test_many_shards(mixed, mixed_rows, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_BYTES", 2_000)
    assert found(suffixes.repeated_passages(mixed, 20)) == brute.repeats(mixed_rows, 20)


def test_cut_texts_keep_the_rest(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    docs = spark.createDataFrame(
        [(1, f"a  {shared}\nb", "k"), (2, f"c,\t{shared}  d", "k"), (3, shared, "k"), (4, None, None)],
        "doc_id long, text string, spans string",
    )
    kept = suffixes.drop_passages(docs)
    assert kept.columns == docs.columns
    cut = {r.doc_id: (r.text, r.spans) for r in kept.collect()}
    assert cut == {1: (f"a  {shared}\nb", "k"), 2: ("c,\t  d", "k"), 4: (None, None)}


def test_empty(no_documents):
    assert substrings.repeated_substrings(no_documents).count() == 0
    assert suffixes.drop_passages(no_documents).count() == 0


def test_suffix_order_and_search():
    rnd = random.Random(1)
    for _ in range(30):
        runs = [[rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 30))] for _ in range(6)]
        text = np.array([x for r in runs for x in [*r, 0]], dtype=np.int64)
        stops = np.flatnonzero(text == 0)
        ends = {int(p): i for i, p in enumerate(stops)}

        def suffix(at):
            stop = int(stops[np.searchsorted(stops, at)])
            return [*(int(x) + 10_000 for x in text[at:stop]), ends[stop]]

        order = suffix_order(text)
        assert order.tolist() == sorted(range(len(text)), key=suffix)
        index = FMIndex(text, sample=4)
        patterns = [[rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 5))] for _ in range(20)]
        flat = np.array([x for p in patterns for x in p])
        length = np.array([len(p) for p in patterns])
        low, high = index.search(flat, np.cumsum(length), length)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_equal_windows_select_equal_places():
    rnd = random.Random(2)
    words = [f"{rnd.randrange(6)}" for _ in range(400)]
    w = words_of(pa.array([" ".join(words)]))
    start, chosen, _ = minimisers(w.hashes(), w.row, 9, 3)
    seen = {}
    for s, c in zip(start, chosen):
        assert s <= c <= s + 6
        assert seen.setdefault(tuple(words[s : s + 9]), c - s) == c - s


def test_words_stay_in_their_row():
    column = pa.array(["a b", None, "", "c", " d\x00e\tf", "g"])
    w = words_of(column)
    text = [w.text(a, b) for a, b in zip(w.first[:-1], w.first[1:])]
    assert text == [b"a b", b"", b"", b"c", b"d\x00e f", b"g"]
    sliced = words_of(column.slice(3, 2))
    assert [sliced.text(a, b) for a, b in zip(sliced.first[:-1], sliced.first[1:])] == text[3:5]
