"""Jaccard join, decontamination and exact top-k against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

import brute
from sparkevidence.llm import decontaminate, jaccard, kdtree
from sparkevidence.llm.components import components


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_jaccard_join(mixed, mixed_rows):
    rows = [r for r in mixed_rows if r[1] != "another text under a known id"]
    docs = mixed.where("text is null or text <> 'another text under a known id'")
    assert joined(jaccard.near_duplicates(docs)) == brute.near_duplicates(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_chains_and_clouds(spark, seed):
    """Near copies of near copies, and many documents around one that do not link with each other."""
    rnd = random.Random(seed)
    rows, base = [], [f"b{i}" for i in range(60)]
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randrange(0, 9)):
            own[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        rows.append((i * 3 % 121, " ".join(own[: rnd.randrange(30, 61)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(jaccard.near_duplicates(docs)) == brute.near_duplicates(rows)


def cloud(seed):
    """Near copies of near copies, many documents around one, and short ones."""
    rnd = random.Random(seed)
    rows, base = [], [f"b{i}" for i in range(60)]
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randrange(0, 9)):
            own[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        rows.append((i * 3 % 121, " ".join(own[: rnd.randrange(30, 61)])))
    return rows + [(200 + i, " ".join(f"s{j}" for j in range(i, i + 6))) for i in range(12)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_voronoi_groups_of_chains_and_clouds(spark, seed):
    rows = cloud(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert joined(jaccard.near_groups(docs)) == brute.near_duplicates(rows)


def test_regions_closed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CLOSE_PAIRS", 200)
    monkeypatch.setattr(jaccard, "CLOSE_OWN", 8)
    rows = cloud(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert joined(jaccard.near_groups(docs)) == brute.near_duplicates(rows)


def test_near_copies_that_do_not_link_are_not_all_compared(spark, monkeypatch):
    """Of the pairs between unlinked copies and a group only those that may link have their sets compared."""
    rnd, rows, base = random.Random(11), [], [f"b{i}" for i in range(120)]
    for i in range(100):
        own = list(base)
        for at in rnd.sample(range(0, 120, 6), 4 if i % 4 == 0 else 1):  # 20 of 116 shingles go, or 5
            own[at] = f"x{i} y{at}"
        rows.append((i, " ".join(own)))
    compared, plain = [], jaccard._distances

    def counted(pairs, sets):
        compared.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(jaccard, "_distances", counted)
    monkeypatch.setattr(jaccard, "CLOSE_OWN", 64, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.stored(jaccard._sets_of(docs, docs.select("doc_id")))
    members = docs.selectExpr("0L as region", "doc_id as doc", "true as own")
    labels = {r.node: r.component for r in jaccard._linked_components(jaccard.Regions(members, sets)).collect()}
    want = {i: c for i, _, c in brute.near_duplicates(rows) if i != c}
    assert labels == want and len(want) == 74
    assert sum(compared) < 8 * len(rows)


def test_parities_differ_in_no_more_places_than_sets():
    rnd = random.Random(5)
    for size in (1, 40, 3000):
        pool = [rnd.getrandbits(64) for _ in range(2 * size)]
        one, two = sorted(rnd.sample(pool, size)), sorted(rnd.sample(pool, size))
        words = jaccard.parities(np.array(one + two, np.uint64), np.array([size, size])).reshape(2, -1)
        assert words.shape[1] * 64 == jaccard.PARITY_BITS
        differ = sum(int(x).bit_count() for x in words[0] ^ words[1])
        assert differ <= len(set(one) ^ set(two)) and (differ > 0 or one == two)


def test_voronoi_groups(mixed, mixed_rows, no_documents):
    rows = [r for r in mixed_rows if r[1] != "another text under a known id"]
    docs = mixed.where("text is null or text <> 'another text under a known id'")
    assert joined(jaccard.near_groups(docs)) == brute.near_duplicates(rows)
    assert jaccard.near_groups(no_documents).count() == 0


def test_keep_first_of_repeated_ids(spark):
    """Of different texts under one id the first in order stays, whatever the order of the rows."""
    rows = [(5, "zebra " * 9, "a"), (5, "apple pie", "b"), (5, None, "c"), (6, "x y z", "d"), (6, "a b c", "e")]
    rows += [(None, "x y z", "f"), (None, "x y z", "f"), (7, "x  Y z", "g"), (8, "own text here", "h")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, row string").repartition(2)
        assert sorted(r.row for r in jaccard.keep_first(docs).collect()) == ["c", "e", "f", "f", "h"]


def test_jaccard_links(spark):
    """Every link between different texts is there, and copies count by the size of their class."""
    rnd, base = random.Random(7), [f"b{i}" for i in range(80)]
    rows = []
    for i in range(40):
        own = list(base)
        own[rnd.randrange(80)] = f"x{rnd.randrange(30)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[i % 3][1]) for i in range(7)] + [(5, rows[5][1])]
    rows += [(200, "alone in this table"), (201, ""), (202, None)]
    sets = {}
    for i, text in rows:
        w = (text or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = lambda x, y: bool(x) and 100 * len(x & y) >= 75 * len(x | y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: sum(i != j and near(sets[i], sets[j]) for j in sets) for i in sets}
    heads = {min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    want = {(i, j) for i in heads for j in heads if i < j and near(sets[i], sets[j])}
    assert len(want) > len(heads)
    assert {tuple(r) for r in jaccard.linked_classes(docs).collect()} == want


def test_keep_first(mixed, mixed_rows, no_documents):
    kept = jaccard.keep_first(mixed)
    assert kept.columns == mixed.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = {i for i, _, c in brute.near_duplicates(mixed_rows) if i is not None and i == c}
    assert set(ids) == want and len(ids) == len(want)
    assert kept.where("doc_id is null").count() == 2
    assert jaccard.keep_first(no_documents).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(7, 7), (5, 4)]
    edges += [(rnd.randrange(300, 340), rnd.randrange(300, 340)) for _ in range(20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    top = lambda i: i if parent.setdefault(i, i) == i else top(parent[i])
    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    assert got == {i: top(i) for i in parent if top(i) != i}


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"), (2, "short one"), (3, None),
    (4, ""), (2, "short one"), (None, "lonely words here"), (5, "ÜBER alles 12,34 x"), (6, "!?"),
]
TEXTS = [
    (1, "so the QUICK, brown fox jumps over the lazy dog and runs away again"), (2, "a short one; short one"),
    (3, None), (4, ""), (5, "lonely words here"), (6, "Über alles 12 34 X"), (7, "nothing"), (7, "nothing"),
    (None, "short one"), (8, "word " * 40_000 + "short one"), (9, "short\none two short"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_decontamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame([(*r, 1, "z") for r in TEXTS], "doc_id long, text string, i int, hits string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_contamination(docs, items).collect()
    got = [
        (r.doc_id, r.n_words, sum(s.end - s.start for s in r.hits), tuple(r.item_ids)) for r in found
    ]
    assert sorted(got, key=repr) == brute.contamination(TEXTS, ITEMS)


def test_removed_contamination(spark, no_documents):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.remove_contamination(docs, items).collect()
    text = {r.doc_id: r.text for r in kept}
    assert text[1] == "so  again" and text[2] == "a " and text[9] == " two short"
    assert set(text) == {1, 2, 3, 4, 7, 8, 9} and len(kept) == 8
    assert decontaminate.remove_contamination(docs, items.where("false")).count() == len(TEXTS)
    assert decontaminate.remove_contamination(no_documents, items).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 60)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 7)
    monkeypatch.setattr(kdtree, "GROUP_SHARDS", 2)
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 8)
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.99]) for _ in range(5)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0])]
    rows += [(502, [float("nan")] * 5), (503, [float("inf")] * 5), (None, rows[1][1]), (504, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = kdtree.whole_vectors(table)
    got = {}
    for r in kdtree.top_k(vectors.where("id % 20 = 0"), vectors, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    import math

    sound = {i: [math.floor(64 * x) for x in v] for i, v in rows[:330]}
    for q in (i for i in sound if i % 20 == 0):
        score = lambda c: sum(a * b for a, b in zip(sound[q], sound[c]))
        assert got.pop(q) == sorted(((score(c), c) for c in sound if c != q), key=lambda x: (-x[0], x[1]))[:20]
    assert not got
    few = vectors.where("id < 5")
    assert kdtree.top_k(few.where("id % 20 = 0"), few, 20).count() == 4
    assert kdtree.top_k(few.where("false"), few, 20).count() == 0
    assert kdtree.top_k(few.where("false"), few.where("false"), 20).count() == 0


def test_top_k_of_large_numbers_ragged_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 40)
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 4)
    rng = random.Random(11)
    top = 2**63 - 1
    rows = [(i, [rng.randint(-(2**31), 2**31) for _ in range(rng.choice([1, 3]))]) for i in range(300)]
    rows += [(400 + i, [94906267 + i % 3]) for i in range(30)]  # products beyond a double's whole numbers
    rows += [(500, [top]), (501, [top]), (502, [-top]), (503, [2])]
    rows += [rows[0], (20, [5, 5, 5]), (20, [7])]  # one row twice, one id with several vectors
    vectors = spark.createDataFrame(rows, "id long, v array<bigint>").selectExpr("*", "'clash' as part", "v as data")
    queries = vectors.where("id % 20 = 0").distinct()
    got = defaultdict(list)
    for r in kdtree.top_k(queries, vectors, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = defaultdict(list)
    for q, v in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        for i, w in rows:
            if i != q and len(w) == len(v):
                score = sum(a * b for a, b in zip(v, w, strict=True))
                want[q].append((i, max(-top - 1, min(top, score))))
    assert dict(got) == {q: sorted(f, key=lambda x: (-x[1], x[0]))[:20] for q, f in want.items()}


def test_unlinked_near_copies_meet_few(spark, monkeypatch):
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(w if k % 20 != i % 20 else f"x{i}k{k}" for k, w in enumerate(base))) for i in range(60)]
    rows += [(100, " ".join(base)), (101, " ".join([*base, "end"]))]
    compared, distances = [], jaccard._distances

    def counting(pairs, sets):
        compared.append(pairs.count())
        return distances(pairs, sets)

    monkeypatch.setattr(jaccard, "_distances", counting)
    found = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: min(i, 100) for i, _ in rows}
    assert sum(compared) <= len(rows)  # of 1,891 pairs that share many shingles
