"""Line dedup: cuckoo filters, whole results, and documents that come and go."""

import numpy as np
import pytest
from brute import LOWER, sha

from sparkevidence.llm import cuckoo, line_dedup
from sparkevidence.llm.tables import small_batches

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, least):
    """(doc_id, n_lines, n_dropped, kept_sha256) of rows (doc_id, text)."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            held[k] = held.get(k, 0) + 1
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if held.get(key(x), 0) < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def got(docs, index):
    rows = line_dedup.drop_lines(docs, index).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, sha(r.text or "")) for r in rows), key=repr)


def keys(rnd, n):
    return cuckoo.digests([rnd.bytes(16) for _ in range(n)])


def test_filter_holds_what_was_put_in_until_it_is_taken_out():
    rnd = np.random.default_rng(1)
    own, other = keys(rnd, 5_000), keys(rnd, 5_000)
    cells = cuckoo.empty(5_000)
    assert cuckoo.insert(cells, own)
    at_first = cuckoo.Filters({0: cells}, 1)
    assert at_first.holds(own).all() and at_first.holds(other).sum() == 0
    cuckoo.delete(cells, own[:2_000])
    after = cuckoo.Filters({0: cells}, 1)
    assert after.holds(own[2_000:]).all() and not after.holds(own[:2_000]).any()
    assert np.count_nonzero(cells) == 3_000
    cuckoo.delete(cells, own[2_000:])
    assert not cells.any()


def test_filter_keeps_keys_of_one_fingerprint_apart_by_number():
    same = np.repeat(keys(np.random.default_rng(2), 1), 6, axis=0)
    cells = np.zeros((8, 4), np.uint32)
    assert cuckoo.insert(cells, same)
    for left in range(5, -1, -1):
        cuckoo.delete(cells, same[:1])
        assert np.count_nonzero(cells) == left
    assert not cuckoo.insert(np.zeros((1, 4), np.uint32), same)


def test_shards_agree(spark):
    rnd = np.random.default_rng(3)
    raw = [rnd.bytes(16) for _ in range(200)]
    df = spark.createDataFrame([(bytearray(x),) for x in raw], "key binary")
    native = [r[0] for r in df.select(line_dedup._shard(7)).collect()]
    assert native == cuckoo.shard_of(cuckoo.digests(raw), 7).tolist()


@pytest.fixture(scope="module")
def line_rows(mixed_rows):
    rows = [(i, t) for i, t in mixed_rows]
    shared = ["Header Line", "  header line\t", "é Fuß", "x", "", "   ", "\r"]
    for i in range(60):
        own = [shared[(i + j) % (1 + i % 7)] for j in range(i % 9)] + [f"own {i}", "HEADER LINE " * (i % 2)]
        rows.append((5_000 + i, "\n".join(own)))
    rows += [(6_000, "\n"), (6_001, "x\n"), (6_002, "\nx"), (6_003, "x"), (6_003, "X"), (6_004, "x\nx\nx")]
    rows += [(None, "x\nleft"), (6_005, "header line\n" * 3_000 + "tail" * 20_000)]
    return rows


def test_lines_with_odd_rows(spark, line_rows, monkeypatch):
    small_batches(spark)
    extra = "key long, keys array<long>, n long, cells string, shard int, n_lines string, n_dropped int"
    docs = spark.createDataFrame(
        [(i, t, 1, [2], 3, "a", 4, "b", 5) for i, t in line_rows], f"doc_id long, text string, {extra}"
    ).repartition(4)
    for least in (1, 2, 10):
        assert got(docs, line_dedup.build_index(docs, least)) == plain(line_rows, least)
    monkeypatch.setattr(line_dedup, "SLICE_BYTES", 100)
    index = line_dedup.build_index(docs, 3, shard_keys=1)
    assert index.shards > 2
    assert got(docs, index) == plain(line_rows, 3)


def test_wrongly_reported_keys_stay(spark, line_rows, monkeypatch):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(cuckoo.Filters, "holds", lambda self, keys: np.ones(len(keys), dtype=bool))
    assert got(docs, line_dedup.build_index(docs, 4)) == plain(line_rows, 4)


def test_documents_come_and_go(spark, line_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_CHANGES", 2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one, two, three = line_rows[0::3], line_rows[1::3], line_rows[2::3]
    index = line_dedup.build_index(frame(one), 4, shard_keys=3)
    for more in (two, three):
        index = line_dedup.insert(index, frame(more))
    assert got(frame(line_rows), index) == plain(line_rows, 4)
    gone = {i for i, _ in two if i is not None}
    index = line_dedup.delete(index, spark.createDataFrame([(i,) for i in [*gone, -1]], "doc_id long"))
    rest = [r for r in line_rows if r[0] not in gone]
    assert got(frame(rest), index) == plain(rest, 4)
    index = line_dedup.delete(index, spark.createDataFrame([(i,) for i, _ in rest if i], "doc_id long"))
    left = [r for r in rest if r[0] is None]
    assert got(frame(left), index) == plain(left, 4)


def test_no_documents(spark, no_documents, mixed):
    index = line_dedup.build_index(no_documents)
    assert got(no_documents, index) == []
    index = line_dedup.insert(index, mixed)
    assert line_dedup.drop_lines(mixed, index).count() == mixed.count()
    assert line_dedup.drop_repeated_lines(mixed, 2).columns == mixed.columns
