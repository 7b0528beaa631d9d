"""Packing and WARC: round trips and corner cases."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkevidence.llm import packing, warc
from sparkevidence.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(tokenizer, docs, rows):
    """Pieces rebuild each document, and sequences are full and without gaps."""
    wanted = sorted(
        (i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()))
        for i, text in docs
        for ids in [whole_ids(tokenizer, text)]
        for k, (a, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))
    )
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= packing.CAPACITY
    return sequences


def test_packed_query(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op5_pack"](spark, "/root/testdata/sf0.001").collect()
    sequences = check_packing(tokenizer, docs, rows)
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / packing.CAPACITY + 1


def test_packing_corner_cases(spark, tokenizer, no_documents, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 7)
    texts = [None, "", "a  b", " x \n\n y", "word " * 9_000, "x" * 5_000, "<|endoftext|>", "it's 12,5%"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, ""), (3, texts[3])]
    rows += [(100 + i, "t " * (17 * i)) for i in range(60)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, piece int").repartition(5)
    check_packing(tokenizer, rows, packing.placed_pieces(packing.pack(docs)).collect())
    assert packing.placed_pieces(packing.pack(no_documents)).count() == 0
    null_id = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert packing.placed_pieces(packing.pack(null_id)).first().doc_id is None


def test_packing_with_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    (row,) = packing.pack(docs, with_ids=True).collect()
    ids = {p.doc_id: p.ids for p in row.pieces}
    assert ids == {1: whole_ids(tokenizer, "one two"), 2: whole_ids(tokenizer, "three")}
    assert row.fill == sum(map(len, ids.values()))


def test_encoder_equals_tokenizer(tokenizer):
    texts = ["", " ", "  a", "a  b", "a \n b", "it's o'clock 's", "x\n\ny z", "a\tb c", "\x1ca b\x1c c",
             " lead", "trail ", "Ünï 12ab, ... !! (foo) <|endoftext|>", "a\u00a0b c", "日本 語 text",
             "foo <|endoftext|> bar", "<|endoftext|> x", "a<|endoftext|>b c", "x <|endoftext|>", "<|endoftext|><|endoftext|>",
             "a  <|endoftext|> b", "<|endoftext| > y"]
    found = packing.Encoder(packing.TOKENIZER).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_new_stretches_are_encoded_together(tokenizer):
    class Counting:
        calls = 0

        def encode_batch_fast(self, texts, **how):
            self.calls += len(texts)
            return tokenizer.encode_batch_fast(texts, **how)

    odd = ["", " ", "a", " a", "a ", "a  b", "a\n b", "it's x's", "a <|endoftext|> b", "é\u3000 ü", "\xa0", "_ \xa0", " \xa0"]
    texts = odd + [f"head{i} " + " ".join(f"w{i}x{k}, {k}\nof" for k in range(300)) for i in range(9)] + odd[::-1]
    encoder = packing.Encoder(packing.TOKENIZER)
    encoder.tokenizer, plain = Counting(), tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for _ in range(2):
        found = encoder.encode(pa.array([*texts, None], pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in plain] + [[]]
    assert encoder.tokenizer.calls < 100  # of about 3,000 stretches


def test_best_fit():
    bins = packing.best_fit(np.array([5, 7, 3, 10, 2, 3]), 10)
    assert sorted(sum(([5, 7, 3, 10, 2, 3][i] for i in b)) for b in bins) == [10, 10, 10]
    assert packing.best_fit(np.array([], dtype=np.int64), 10) == []


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (4, None, "<p>same</p>"),
    (2, "http://b", None), (3, "http://c\r\nX: y", ""), (5, "http://d", "\u00fc\u4e16" * 40_000),
    (6, "http://e", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5), (1, "http://a/1", "<p>same</p>"),
    (7, "u", "x" * 100), (7, "u", "other"), (8, "v", "\u0000\r\n0\r\n\r\n"), (None, "w", "<p>same</p>"),
]


def expected(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, _, html in pages:
        data = (html or "").encode()
        again = i is not None and len(data) >= least and first[html or ""] < i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        yield (i, len(data), digest, "revisit" if again else "response", first[html or ""] if again else None)


@pytest.mark.parametrize("least", [0, 12])
def test_warc_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc.write_archives, "__defaults__", (0, 1_000, 5_000))
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages.repartition(3), warc.archive_folder(spark), least).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(PAGES, least), key=repr)


def test_warc_segments_long_pages_by_default(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>" * 6_000), (2, "http://b", "<p>short</p>")],
                                  "page_id long, url string, html string")
    path = warc.archive_folder(spark)
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path)
    assert {r.segment for r in records.collect()} == {0, 1, 2, 3}
    found = {r.page_id: (bytes(r.payload), r.error) for r in warc.reassemble(records).collect()}
    assert found == {1: (b"<p>x</p>" * 6_000, None), 2: (b"<p>short</p>", None)}


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, warc.archive_folder(spark)).count() == 0


def test_segments_are_verified(spark):
    payload = b"payload " * 100
    records = list(warc.records_of_page(1, "u", payload, warc.digest_of(payload), None, 100))
    assert len(records) > 3
    rows = [r for data in records for r in warc.records_of_archive(data)]

    def payload_of(rows):
        df = spark.createDataFrame([tuple(r[k] for k in warc._schema().names) for r in rows], warc.RECORDS)
        (found,) = warc.reassemble(df).collect()
        return found.payload, found.error

    assert payload_of(rows[::-1]) == (bytearray(payload), None)
    assert payload_of(rows[:1] + rows[2:]) == (None, "segments missing")
    assert payload_of(rows[:-1]) == (None, "last segment missing")
    wrong = [*rows[:-1], rows[-1] | {"total_length": 5}]
    assert payload_of(wrong) == (None, "total length differs")


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 20_000, b"\r\n0\r\n\r\n"])
def test_chunked_framing(payload):
    assert warc.unchunked(warc.chunked(payload)) == payload
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(payload or b"a")[:-7])
