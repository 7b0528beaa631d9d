"""The pipeline's stages against brute force, each on its own input."""

import re

import brute
import corpus_pipeline as pipeline


def test_stages(spark, mixed_rows, tmp_path):
    items = [(1, " ".join(f"w{i}" for i in range(12))), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tail = " tail " + items[0][1]
    rows = [(i, None if t is None else t + tail if i == 4010 else t) for i, t in mixed_rows]
    docs = spark.createDataFrame(
        [(i, t, "x", "s", None if t is None else len(t)) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts, columns = docs, docs.columns
    found = {}
    for name, stage in pipeline.STAGES:
        out = pipeline.stored(stage(spark, texts, str(tmp_path)))
        found[name] = out.collect()
        if name != "pack":
            assert out.columns == columns
            assert all(r.n_chars == len(r.text) for r in found[name])
            texts = out
    by = {k: sorted(((r.doc_id, r.text) for r in v), key=repr) for k, v in found.items() if k != "pack"}

    lettered = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert by["language_id"] == sorted(lettered, key=repr)

    joined = brute.near_duplicates(by["language_id"])
    first = {i for i, _, c in joined if i == c and i is not None}
    assert {i for i, _ in by["jaccard_join"] if i is not None} == first
    assert len(by["jaccard_join"]) == len(first) + sum(i is None for i, _ in lettered)

    want = {i: (n, gone, s) for i, n, gone, s in brute.repeats(by["jaccard_join"], 50)}
    after = {i: t for i, t in by["suffix_array_dedup"]}
    assert set(after) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    for i, text in after.items():
        assert brute.sha(" ".join(brute.SPACED.findall(text))) == want[i][2]
    assert any(gone for _, gone, _ in want.values())

    hits = {i: (n, hit) for i, n, hit, _ in brute.contamination(by["suffix_array_dedup"], items)}
    clean = {i: t for i, t in by["decontaminate"]}
    assert set(clean) == {i for i, (n, hit) in hits.items() if not hit or hit < n}
    assert any(hit for _, hit in hits.values())
    for i, text in clean.items():
        assert len(brute.ALNUM.findall(text.translate(brute.LOWER))) == hits[i][0] - hits[i][1]
        assert hits[i][1] or text == after[i]

    assert {r.doc_id for r in found["pack"]} == set(clean)
    run = pipeline.run(spark, str(tmp_path)).collect()
    piece = lambda r: (repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(piece, run)) == sorted(map(piece, found["pack"]))


def test_empty_table(spark, no_documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    no_documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
