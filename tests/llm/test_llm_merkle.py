"""Merkle manifest: every proof against a plain tree, and odd tables."""

import random
import zlib

import pytest
from brute import LOWER, sha

from sparkevidence.llm import merkle

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(row):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(frame(row[c]) for c in NAMES))


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def climbed(levels, at, given):
    """Siblings and the folded hash of leaf ``at``."""
    beside = []
    for level in levels[:-1]:
        a = at // 8 * 8
        run = list(level[a : a + 8])
        beside += run[: at - a] + run[at - a + 1 :]
        run[at - a] = given
        at, given = at // 8, sha("".join(run))
    return beside, given


def plain(rows):
    first = lambda v: (v is not None, v)
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (first(r["doc_id"]), leaf_of(r)))
        trees.append((own, levels_of([leaf_of(r) for r in own])))
    top, out = levels_of([x[-1][0] for _, x in trees]), []
    for t, (own, levels) in enumerate(trees):
        for at, r in enumerate(own):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            given = leaf_of(r | {"text": r["text"] and r["text"].translate(LOWER)} if hit else r)
            beside, folded = climbed(levels, at, given)
            above, folded = climbed(top, t, folded)
            root = top[-1][0]
            out.append((r["doc_id"], levels[0][at], levels[-1][0], root, sha("".join(beside + above)), folded, folded == root))
    return sorted(out, key=repr)


def proved(spark, rows, parts=3):
    schema = "doc_id long, source string, lang string, n_chars long, text string, run int, hash string, parent long"
    docs = spark.createDataFrame([(*[r[c] for c in NAMES], 1, "x", 2) for r in rows], schema).repartition(parts)
    found = merkle.prove(merkle.document_manifest(docs))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def row(i, lang="en", text="Some Text", source="s", n_chars=9):
    return dict(zip(NAMES, (i, source, lang, n_chars, text)))


@pytest.mark.parametrize("n", [1, 8, 9, 65, 520])
def test_one_language(spark, n):
    rows = [row(7 * i - 20, text=f"Text {i % 5}") for i in range(n)]
    got = proved(spark, rows)
    assert got == plain(rows)
    assert {g[-1] for g in got} <= {True, False} and any(not g[-1] for g in got) == any(
        zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 for r in rows
    )


def test_languages_and_odd_rows(spark):
    rnd = random.Random(4)
    langs = [None, "", "a", "Z", "é", "日本", "en", "de", "fr", "x1", "x2"]
    rows = [
        row(i, rnd.choice(langs[1:]), rnd.choice([None, "", "lower", "Ünï CÖDE\n", "A" * 5_000]), rnd.choice([None, "", "w:eb"]),
            rnd.choice([None, 0, 12]))
        for i in range(150)
    ]
    rows += [row(1_000, None), row(2_000, "lone"), row(None, "en"), row(None, "en"), row(None, None, None, None, None)]
    rows += [rows[3], rows[3], row(5, "en", "other"), row(5, "en", "OTHER")] + [row(9, "same")] * 20
    assert proved(spark, rows) == plain(rows)


def test_settings_come_back_and_no_rows(spark, no_documents):
    before = {k: spark.conf.get(k) for k in merkle.RECURSION}
    assert merkle.prove(merkle.document_manifest(no_documents)).collect() == []
    assert {k: spark.conf.get(k) for k in merkle.RECURSION} == before


def test_levels_name_their_parents(spark):
    rows = [row(i, f"l{i % 9}") for i in range(200)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.document_manifest(docs)
    nodes = {tuple(r["id"]): r for r in manifest.nodes.collect()}
    tops = [r for r in nodes.values() if r["parent"] is None]
    assert [r["hash"] for r in tops] == [manifest.root]
    for r in [*nodes.values(), *manifest.runs.collect()]:
        if r["parent"] is not None:
            assert nodes[tuple(r["parent"])]["children"][r["slot"]] == r["hash"]
