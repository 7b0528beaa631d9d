import inspect
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkevidence.config import Settings
from sparkevidence.functions.text import tokenize, tokenize_hyphen
from sparkevidence.operators import bm25, dense, entities, expansion, fusion, ranking, scale
from sparkevidence.operators.topk import RunningTopK

WORDS = "alpha beta gamma delta TP53 MTAP loss-of-function cell the of".split()


def documents(seed, n=60):
    rnd = random.Random(seed)
    # a third of all documents are copies of one text
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 9))) for _ in range(n)]
    return [(i, texts[0] if i % 3 == 0 else t) for i, t in enumerate(texts)]


def by_hand(docs, queries, k):
    """BM25 over given token lists, written out for one question at a time."""
    n, mean_len = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = defaultdict(int)
    for _, toks in docs:
        for t in set(toks):
            df[t] += 1
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: (0.25 * mean if v < 0 else v) for t, v in raw.items()}
    out = {}
    for q, toks in queries:
        scores = []
        for d, terms in docs:
            s = sum(
                idf.get(t, 0) * terms.count(t) * 2.5
                / (terms.count(t) + 1.5 * (0.25 + 0.75 * len(terms) / mean_len))
                for t in toks
            )
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def check_bm25(spark, tokens, **how):
    docs = documents(1)
    asked = [(0, "alpha TP53 the"), (1, "loss-of-function MTAP MTAP"), (2, "nowhere"), (3, "  ")]
    d = spark.createDataFrame(docs, "doc_id long, content string")
    q = spark.createDataFrame(asked, "query_id long, query string")
    toks = {r[0]: r[1] for r in d.select("doc_id", tokens("content")).collect()}
    qtoks = {r[0]: r[1] for r in q.select("query_id", tokens("query")).collect()}
    want = by_hand(sorted(toks.items()), sorted(qtoks.items()), 7)
    rows = bm25.search(q, bm25.build_index(d, tokens), 7, tokens=tokens, **how).orderBy("query_id", "rank")
    got = defaultdict(list)
    for r in rows.collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for q_id in (0, 1, 2, 3):
        assert [x[0] for x in got[q_id]] == [x[0] for x in want[q_id]]
        assert np.allclose([x[1] for x in got[q_id]], [x[1] for x in want[q_id]], atol=2e-6)


def test_bm25(spark):
    check_bm25(spark, tokenize)
    check_bm25(spark, tokenize_hyphen)


def test_bm25_over_many_buckets_and_parts(spark, monkeypatch):
    """Small buckets, blocks, groups and chunks, and a word list too long to be pushed."""
    for name, size in {
        "BUCKET_DOCS": 7, "BLOCK_DOCS": 2, "GROUP_BUCKETS": 2, "GROUP_WEIGHTS": 3, "CHUNK_QUERIES": 1,
        "PUSHED_TERMS": 1,
    }.items():
        monkeypatch.setattr(bm25, name, size)
    check_bm25(spark, tokenize)
    check_bm25(spark, tokenize_hyphen)


def test_bm25_skips_blocks_below_the_kth_score(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BUCKET_DOCS", 16)
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 4)
    rows = [(i, "rare " * (9 if i < 3 else 1) + "filler " * (i % 5)) for i in range(200)]
    docs = spark.createDataFrame([*rows, *((1_000 + i, "other") for i in range(600))], "doc_id long, content string")
    index = bm25.build_index(docs.coalesce(1), lambda c: F.split(F.trim(c), " +"))
    seen = []
    add = bm25.RunningTopK.add
    asked = pa.RecordBatch.from_pydict({"query_id": [1], "term": ["rare"], "weight": [1.0]})
    monkeypatch.setattr(
        bm25.RunningTopK, "add", lambda self, q, d, s, floor=None: (seen.append((s > 0).sum()), add(self, q, d, s, floor))
    )
    best = bm25._Best([asked], 3)
    heads = index.buckets.selectExpr("bucket", "1 kind", "'' term", "lengths docs", "null tf", "null blocks", "null tops", "ids")
    lists = index.postings.where("term = 'rare'").selectExpr(
        "bucket", "2 kind", "term", "docs", "tf", "blocks", "tops", "cast(null as array<long>) ids"
    )
    table = heads.union(lists).orderBy("bucket", "kind").toArrow()
    for bucket in sorted(set(table.column("bucket").to_pylist())):
        own = table.filter(pc.equal(table.column("bucket"), bucket)).to_batches()
        best.add(bm25._Bucket(own, best.questions, index.k1, index.b, index.totals.avg_length))
    assert sorted(best.rows().column("doc_id").to_pylist()) == [0, 1, 2]
    assert sum(seen) < 40


def test_bm25_questions_stay_in_the_tasks(spark, monkeypatch):
    """Many questions over many words: nothing of them comes to the driver."""
    monkeypatch.setattr(bm25, "PUSHED_TERMS", 100)
    docs = spark.range(2_000).selectExpr("id as doc_id", "concat_ws(' ', 'w', id % 997, id % 89, id % 7) as content")
    queries = spark.range(100_000).selectExpr("id as query_id", "concat_ws(' ', id % 997, id % 89) as query")
    words = lambda c: F.split(c, " ")
    index = bm25.build_index(docs, words)
    brought = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: brought.append(out := collect(self)) or out)
    found = bm25.search(queries, index, 3, tokens=words)
    monkeypatch.undo()
    assert sum(map(len, brought)) < 200 and "toPandas" not in inspect.getsource(bm25)
    assert found.select("query_id").distinct().count() == 100_000
    few = queries.where("query_id in (5, 996, 1994, 99999)")
    assert sorted(map(tuple, bm25.search(few, index, 3, tokens=words).collect())) == sorted(
        map(tuple, found.where("query_id in (5, 996, 1994, 99999)").collect())
    )


def test_bm25_reads_the_asked_words_only(spark, monkeypatch):
    monkeypatch.setattr(bm25, "ROW_GROUP_BYTES", 20_000)
    docs = spark.range(6_000).selectExpr("id as doc_id", "concat_ws(' ', 'all', 'u' || id, 'v' || id * 7) as content")
    index = bm25.build_index(docs.coalesce(1), lambda c: F.split(c, " "))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    one = index.postings.where(bm25._any_of("term", ["u17", "it's \\ '"]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "In(term, [it's \\ ',u17])" in plan or "In(term, [u17,it's \\ '])" in plan
    assert [r.term for r in one.collect()] == ["u17"]
    files = index.postings.inputFiles()
    assert max(pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in files) > 3


def test_bm25_copies_questions_only_to_keep_cores_busy(spark, monkeypatch):
    """Many buckets and many shuffle partitions: each copy of the questions is one row a question."""
    monkeypatch.setattr(bm25, "BUCKET_DOCS", 2)
    docs = spark.range(400).selectExpr("id as doc_id", "concat('w ', id % 9, ' ', id % 5) as content")
    queries = spark.range(50).selectExpr("id as query_id", "concat('w ', id % 9, ' ', id % 5) as query")
    words = lambda c: F.split(c, " ")
    index = bm25.build_index(docs, words)
    dealt = []
    handed = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: dealt.append(self) or handed(self, *a, **b))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert bm25.search(queries, index, 3, tokens=words).count() == 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert index.totals.n_buckets >= 200
    assert dealt[0].where("kind = 0").count() <= 50 * bm25.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 50 * 200


def test_bm25_index_is_sorted_in_bounded_runs(spark, monkeypatch):
    """No task sorts its whole part of the corpus; a file is a few sorted runs of buckets."""
    monkeypatch.setattr(bm25, "BUCKET_DOCS", 50)
    monkeypatch.setattr(bm25, "RUN_BUCKETS", 4)
    docs = spark.range(1_000).selectExpr("id as doc_id", "concat_ws(' ', 'all', id % 37, id % 11) as content")
    plans = []
    cut = bm25.cut_lineage
    monkeypatch.setattr(
        bm25, "cut_lineage",
        lambda df, options=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, options),
    )
    index = bm25.build_index(docs.coalesce(1), lambda c: F.split(c, " "))
    assert not any("Sort " in p for p in plans[:2])
    rows = []
    for file in index.postings.inputFiles():
        rows += zip(*pq.read_table(file.removeprefix("file:"), columns=["term", "bucket"]).to_pydict().values())
    rows = [(t, b) for t, b in rows if t is not None]
    falls = sum(a > b for a, b in zip(rows, rows[1:]))
    assert index.totals.n_buckets >= 20 and falls <= index.totals.n_buckets // 4 + 8


def test_bm25_moves_packed_postings_once(spark, monkeypatch):
    """Building stores postings and word counts only; a search of many words moves a few rows, evenly dealt."""
    monkeypatch.setattr(bm25, "BUCKET_DOCS", 50)
    monkeypatch.setattr(bm25, "PUSHED_TERMS", 10)
    docs = spark.range(3_000).selectExpr("id as doc_id", "concat_ws(' ', 'all', id % 700, 'u' || id % 7, 'v' || id) as content")
    queries = spark.range(200).selectExpr("id as query_id", "concat_ws(' ', 'all', id, 'u' || id % 7, 'v' || id * 3, 'none') as query")
    words = lambda c: F.split(c, " ")
    stored, dealt = [], []
    cut, handed = bm25.cut_lineage, type(docs).mapInArrow
    monkeypatch.setattr(bm25, "cut_lineage", lambda df, options=None: stored.append(df.columns) or cut(df, options))
    index = bm25.build_index(docs, words)
    assert len(stored) == 2 and "blocks" not in stored[0] and "tops" not in stored[0]
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: dealt.append(self) or handed(self, *a, **b))
    found = sorted(map(tuple, bm25.search(queries, index, 3, tokens=words).collect()))
    rows = dealt[-1].select("grp", "kind", "bucket").collect()
    groups = {r.grp for r in rows}
    assert sum(r.kind == 2 for r in rows) <= 2 * index.totals.n_buckets < index.postings.count() / 10
    assert sum(r.kind == 0 for r in rows) <= 8 * len(groups) < queries.count()
    shares = [sum(r.kind == 1 and r.grp == g for r in rows) for g in groups]
    assert max(shares) - min(shares) <= 1 and "SortMergeJoin" not in dealt[-2]._jdf.queryExecution().executedPlan().toString()
    # packs and parts of any size give the same rows
    for name, size in {"PACK_ROWS": 7, "PACK_WEIGHTS": 5, "GROUP_WEIGHTS": 11, "PRODUCTS": 1, "BROADCAST_ROWS": 1}.items():
        monkeypatch.setattr(bm25, name, size)
    assert sorted(map(tuple, bm25.search(queries, index, 3, tokens=words).collect())) == found
    monkeypatch.setattr(bm25, "PUSHED_TERMS", 10_000)
    assert sorted(map(tuple, bm25.search(queries, index, 3, tokens=words).collect())) == found and len(found) == 600


def test_bm25_wants_the_settings_of_the_index(spark):
    index = bm25.build_index(spark.createDataFrame([(1, "a")], "doc_id long, content string"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    with pytest.raises(ValueError):
        bm25.search(asked, index, 1, Settings(bm25_k1=0.5))


def test_bm25_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "query_id long, query string")
    assert bm25.search(asked, bm25.build_index(none), 3).collect() == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "zeta"), (4, "b b")], "doc_id long, content string")
    assert [r.doc_id for r in bm25.search(asked, bm25.build_index(docs), 3).collect()] == [4]
    assert bm25.search(asked.where("query_id > 1"), bm25.build_index(docs), 3).collect() == []


def test_dense_blocks_agree_with_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(80)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.withColumnRenamed("vec_id", "query_id")
    one_pass = sorted(map(tuple, dense.search(q, v, 4).collect()))
    with monkeypatch.context() as m:
        for name, size in {"BLOCK_BYTES": 300, "PART_BYTES": 900, "GROUP_BYTES": 700, "QUERY_BLOCK": 2, "DOC_BLOCK": 3}.items():
            m.setattr(dense, name, size)
        blocks = sorted(map(tuple, dense.search(q.repartition(3), v.repartition(5), 4).collect()))
    assert one_pass == blocks
    odd = v.union(spark.createDataFrame([(900, None), (901, []), (None, [1.0] * 8), (902, [1.0] * 3)], v.schema))
    asked = q.union(spark.createDataFrame([(903, [2.0] * 3), (904, None), (None, [1.0] * 8)], q.schema))
    odd_rows = sorted(map(tuple, dense.search(asked, odd, 4).collect()))
    assert [r for r in odd_rows if r[0] != 903] == one_pass and [r[1] for r in odd_rows if r[0] == 903] == [902]
    assert dense.search(q, v.where("false"), 4).count() == dense.search(q.where("false"), v, 4).count() == 0
    assert "toPandas" not in inspect.getsource(dense) and "collect(" not in inspect.getsource(dense)
    m = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(m @ m.T, 6)
    for i in range(80):
        want = sorted(range(80), key=lambda j: (-sims[i, j], j))[:4]
        assert [r[1] for r in sorted((r for r in one_pass if r[0] == i), key=lambda r: r[3])] == want


def test_cosine_column_and_encoder(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "")], "doc_id long, content string")

    def encoder(texts):
        return np.array([[t.count("a"), t.count("b")] for t in texts])

    made = dense.embed_corpus(df, encoder)
    got = {r[0]: [round(float(x), 4) for x in r[1]] for r in made.collect()}
    assert got == {1: [0.7071, 0.7071], 2: [1.0, 0.0], 3: [0.0, 0.0]}
    both = made.where("vec_id = 1").select(F.col("embedding").alias("x")).crossJoin(
        made.where("vec_id = 2").select(F.col("embedding").alias("y"))
    )
    assert round(both.select(dense.cosine("x", "y")).first()[0], 4) == 0.7071


def leg(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int, key string")


def test_rrf_counts_copies_and_keeps_the_first_document(spark):
    d = leg(spark, [(1, 10, 1, "x"), (1, 11, 2, "x"), (1, 12, 3, "y")])
    s = leg(spark, [(1, 12, 1, "y")])
    out = {r["key"]: r for r in fusion.rrf_fuse({"sparse": s, "dense": d}).collect()}
    assert out["x"]["score"] == round(1 / 61 + 1 / 62, 10) and out["x"]["doc_id"] == 10
    assert out["y"]["score"] == round(1 / 63 + 1 / 61, 10) and out["y"]["source"] == "local_dense"
    weighted = fusion.rrf_fuse({"dense": d, "sparse": s}, {"dense": 0.0}).collect()
    assert {r["key"]: r["score"] for r in weighted}["x"] == 0.0


def test_merge_keeps_the_score_of_the_first_question(spark):
    rows = spark.createDataFrame(
        [(1, 5, "k", 0.2, 1), (2, 5, "k", 0.9, 1), (2, 6, "m", 0.5, 2)],
        "query_id long, doc_id long, key string, score double, rank int",
    )
    groups = spark.createDataFrame([(1, 7, 0), (2, 7, 1)], "query_id long, group_id long, query_pos int")
    out = fusion.merge_queries(rows, groups, 5).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in out] == [("m", 0.5), ("k", 0.2)]


def round_robin(rows, per_paper=2, total=15):
    """Papers take turns in order of appearance; each turn gives the best chunk left."""
    papers = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        papers.setdefault(r[3], []).append(r)
    chosen = []
    for turn in range(per_paper):
        for chunks in papers.values():
            if turn < len(chunks) and len(chosen) < total:
                chosen.append(chunks[turn][1])
    return chosen


def test_diversify_against_a_loop(spark):
    rnd = random.Random(3)
    rows = []
    for q in range(25):
        for d in range(rnd.randint(0, 40)):
            # one paper holds a third of the chunks
            paper = "hot" if d % 3 == 0 else f"p{rnd.randint(0, 12)}"
            rows.append((q, d, round(rnd.choice([0.1, 0.3, 0.5, 0.7, rnd.random()]), 3), paper))
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, fingerprint string")
    got = defaultdict(list)
    for r in ranking.diversify(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    for q in range(25):
        assert got[q] == round_robin([r for r in rows if r[0] == q and r[2] >= 0.3])


def test_explicit_zero_threshold_is_kept(spark):
    df = spark.createDataFrame([(1, 1, 0.0, "p")], "query_id long, doc_id long, score double, fingerprint string")
    assert ranking.diversify(df, Settings(score_threshold=0.0)).count() == 1


def test_boost(spark):
    rows = [
        (1, 1, 1.0, "On SYNTHETIC lethal pairs", ["A"], ["crispr"], True, "bm25", ["A"], ["crispr"]),
        (1, 2, 1.5, "plain", [], [], False, "web_search", ["A"], []),
        (2, 3, 1.0, "synthetic lethal", [], [], True, "bm25", [], []),
    ]
    df = spark.createDataFrame(
        rows,
        "query_id long, doc_id long, score double, title string, key_genes array<string>, "
        "key_methods array<string>, is_web boolean, source string, genes array<string>, keywords array<string>",
    ).withColumn("paper_title", F.lit(None).cast("string"))
    out = {r["doc_id"]: (r["entity_boost"], r["score"], r["rank"]) for r in ranking.entity_boost(df).collect()}
    assert out == {1: (0.55, 1.55, 2), 2: (0.05, 1.575, 1), 3: (0.0, 1.0, 1)}


def test_pair_scorer_runs_in_tasks(spark):
    df = spark.createDataFrame([(1, 1, "ab", "abc")], "query_id long, doc_id long, query string, content string")
    scored = ranking.pair_score(df, lambda q, c: q.str.len() / c.str.len())
    assert round(scored.first()["score"], 3) == 0.667


def test_spans(spark):
    rows = [
        (1, "##tp53", "Gene", 0.9), (1, "olaparib", "Drug", 0.5), (1, "x", "Gene", 0.9),
        (1, "flu", "Disease", 0.9),
    ]
    spans = spark.createDataFrame(rows, "query_id long, word string, entity_group string, score double")
    r = entities.spans_to_entities(spans).first()
    assert (r["genes"], r["drugs"], r["keywords"]) == (["TP53"], ["olaparib"], [])
    r = entities.spans_to_entities(spans, strict=True).first()
    assert (r["genes"], r["drugs"], r["keywords"]) == (["TP53"], [], ["flu"])
    q = spark.createDataFrame([(1, "loss of MTAP"), (2, "drug")], "query_id long, query string")
    got = {r["query_id"]: r for r in entities.extract_entities(q, spans).collect()}
    assert got[1]["genes"] == ["LOSS", "MTAP", "OF", "TP53"]
    assert got[2]["drugs"] == [] and got[2]["keywords"] == ["drug"]


def test_aliases(spark):
    table = spark.createDataFrame(
        [("A", "AA", ["x", "A1", "A2", "A3"]), ("B", None, None), ("C", "CC", ["C1"])],
        "query string, symbol string, alias array<string>",
    )
    genes = spark.createDataFrame([("A",), ("B",), ("Z",)], "gene string")
    got = {r["gene"]: r["names"] for r in entities.expand_aliases(genes, table).collect()}
    # three aliases are taken, then one-letter names go
    assert got == {"A": ["AA", "A1", "A2"], "B": [], "Z": ["Z"]}


def test_multi_hop_stops_when_good_or_nothing_new(spark):
    queries = spark.createDataFrame(
        [(1, "weak MTAP"), (2, "strong PRMT5"), (3, "dead WRN")], "query_id long, query string"
    )
    schema = "query_id long, doc_id long, key string, content string, score double"
    first = ranking.rerank(
        spark.createDataFrame(
            [(1, 10, "a", "a", 0.1), (2, 20, "b", "b", 0.9), (3, 30, "c", "c", 0.2)], schema
        )
    )
    asked = []

    def search(questions):
        rows = [(r["query_id"], r["query"]) for r in questions.collect()]
        asked.append(sorted(t for _, t in rows))
        found = [(q, 11, "n", "new", 0.0) for q, t in rows if t.startswith("MTAP")]
        found += [(q, 30, "c", "c", 0.0) for q, t in rows if t.startswith("WRN")]
        return ranking.rerank(spark.createDataFrame(found, schema))

    def score(rows):
        return rows.withColumn("score", F.lit(0.8))

    out = expansion.multi_hop_expand(queries, first, search, score)
    got = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in out.collect())
    assert got == [(1, 10, 2), (1, 11, 1), (2, 20, 1), (3, 30, 1)]
    # one round: question 1 became good, question 3 found nothing new
    assert len(asked) == 1 and len(asked[0]) == 6


def test_a_second_round_follows_the_first_and_repeats_no_question(spark):
    queries = spark.createDataFrame([(1, "weak MTAP"), (2, "weak WRN")], "query_id long, query string")
    schema = "query_id long, doc_id long, key string, content string, score double"
    first = ranking.rerank(
        spark.createDataFrame([(1, 10, "a", "a", 0.0), (2, 20, "b", "b", 0.0)], schema)
    )
    leads_to = {"weak mtap": "start", "about start": "PRMT5", "about PRMT5": "MAT2A"}
    asked = []

    def search(questions):
        rows = [(r["query_id"], r["query"]) for r in questions.collect()]
        asked.append(sorted(t for _, t in rows))
        found = [(q, 100 + len(t), leads_to[t], leads_to[t], 0.0) for q, t in rows if t in leads_to]
        return ranking.rerank(spark.createDataFrame(found, schema))

    def ask(active, results):
        """What was found names the next question; the original one is proposed again and again."""
        again = active.select("query_id", F.lit(0).alias("query_pos"), F.upper(F.concat("query", F.lit("  "))).alias("query"))
        begin = active.select("query_id", F.lit(1).alias("query_pos"), F.lit("about start").alias("query"))
        more = results.join(active, "query_id", "left_semi").select(
            "query_id", F.lit(2).alias("query_pos"), F.concat(F.lit("about "), "content").alias("query")
        )
        return again.unionByName(begin).unionByName(more.where("length(content) > 1"))

    out = expansion.multi_hop_expand(queries, first, search, lambda rows: rows.withColumn("score", F.lit(0.1)), ask=ask)
    assert asked == [["about start"] * 2, ["about PRMT5"] * 2]
    assert {(r["query_id"], r["key"]) for r in out.collect()} == {
        (1, "a"), (1, "PRMT5"), (1, "MAT2A"), (2, "b"), (2, "PRMT5"), (2, "MAT2A")
    }
    # the broader questions of a gene are the same in every round
    told = expansion.step_back(queries)
    assert told.groupBy("group_id").count().where("count = 3").count() == 2
    assert expansion.step_back(queries, asked=told.select("group_id", "query")).count() == 0


def test_fusion_on_stored_keys_reads_no_text(spark):
    corpus = spark.createDataFrame(
        [(i, f"{w} pathway") for i, w in enumerate(["MTAP", "WRN", "MTAP", "PRMT5", "ATM"])], "doc_id long, content string"
    )
    asked = spark.createDataFrame([(1, "MTAP pathway"), (2, "none of them")], "query_id long, query string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    near = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    index = bm25.build_index(corpus)
    want = fusion.hybrid_search(asked, corpus, index, vectors, near, 3).collect()
    assert {r["query_id"] for r in want} == {1, 2}
    keys = scale.cut_lineage(fusion.content_keys(corpus))
    # equal texts are one result, and the corpus is not needed at all
    no_texts = corpus.withColumn("content", F.raise_error(F.lit("a text was read")))
    got = fusion.hybrid_search(asked, no_texts, index, vectors, near, 3, keys=keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len({r["key"] for r in got if r["query_id"] == 1}) == len([r for r in got if r["query_id"] == 1])


def test_seen_links_are_dropped(spark):
    schema = "query_id long, doc_id long, key string, link string, score double"
    seen = spark.createDataFrame([(1, 1, "a", "L1", 0.5)], schema)
    new = spark.createDataFrame(
        [(1, 2, "a", "", 0.5), (1, 3, "b", "L1", 0.5), (1, 4, "c", "L2", 0.5), (1, 5, "d", "L2", 0.4),
         (1, 6, "e", None, 0.1)],
        schema,
    )
    assert sorted(r["doc_id"] for r in fusion.drop_seen(new, seen, ["query_id"]).collect()) == [4, 6]


def test_multi_hop_rankings_hold_no_texts(spark, tmp_path, monkeypatch):
    from sparkevidence.plans import catalog_evidence

    docs = [(i, f"word{i % 4} alpha beta {i}", "en", "s") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "word1 gamma delta epsilon zeta eta"), (2, 0, "user", "alpha word2"), (2, 1, "assistant", "alpha")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    held = []
    expand = catalog_evidence.expansion.multi_hop_expand
    monkeypatch.setattr(
        catalog_evidence.expansion, "multi_hop_expand", lambda q, r, *rest: held.append(r.columns) or expand(q, r, *rest)
    )
    got = {(r.query_id, r.doc_id): r.score for r in catalog_evidence.multi_hop(spark, str(tmp_path)).collect()}
    assert "key" in held[0] and "content" not in held[0]
    assert got[1000, 1] == round(1 / 6, 6) and got[2000, 2] == 1.0 and len({d for q, d in got if q == 1000}) >= 3


def test_multi_hop_cuts_found_texts_into_words_once(spark, tmp_path, monkeypatch):
    from sparkevidence.plans import catalog_evidence

    docs = [(i, "one common text" if i < 3 else f"rest{i} filler words", "en", "s") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i, 0, "user", "one common TEXT of mine") for i in range(30)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs, score = [], catalog_evidence.ranking.pair_score
    monkeypatch.setattr(catalog_evidence.ranking, "pair_score", lambda rows: pairs.append(rows) or score(rows))
    got = catalog_evidence.multi_hop(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2} and {r.score for r in got} == {0.6} and len(got) == 90
    plan = pairs[0]._jdf.queryExecution().executedPlan().toString()
    # the texts of found documents are picked out and cut before they are joined, and no pair carries a text
    assert "content" not in pairs[0].columns and "LeftSemi" in plan
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan.split("Join")[0]


def test_pair_scores_of_words_are_those_of_the_text(spark):
    rows = [("TP53 loss", "loss of TP53 and tp53"), ("", "a"), ("a b", None), ("a b", ""), ("Été a", "été\nA  b-c"), (None, "a"), ("?", "?")]
    pairs = spark.createDataFrame(rows, "query string, content string")
    words = pairs.withColumn("content_words", F.array_join(tokenize("content"), "\n")).drop("content")
    want = [r.score for r in ranking.pair_score(pairs.coalesce(1)).collect()]
    assert [r.score for r in ranking.pair_score(words.coalesce(1)).collect()] == want and want[0] == 1.0


def test_dense_tasks_get_even_shares(spark, monkeypatch):
    """More vectors make more tasks; blocks of uneven packing tasks are dealt evenly, pairs are not hashed."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(float).tolist()) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    v = v.where("vec_id < 100").union(v.where("vec_id >= 100"))  # two packing tasks, one with most rows
    q = v.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, dense.search(q, v, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK_BYTES", 32 * 5)  # five vectors
    blocks = dense._numbered(dense._packed(v, "vec_id"))
    assert sorted(r["number"] for r in blocks.collect()) == list(range(24))
    monkeypatch.setattr(dense, "TASK_PAIRS", 120 * 10)
    held, scorer = spark.sparkContext.accumulator(0), dense._scorer

    def counted(k):
        run = scorer(k)

        def count(batches):
            pairs = 0

            def seen():
                nonlocal pairs
                for b in batches:
                    pairs += sum(b.column("kind").to_pylist())
                    yield b

            yield from run(seen())
            held.add(1 if pairs > 2 else 0)

        return count

    monkeypatch.setattr(dense, "_scorer", counted)
    assert sorted(map(tuple, dense.search(q, v, 3).collect())) == whole
    assert held.value == 0  # no task compares more than two blocks


def test_running_top_k_with_floors():
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(6, 400)), 2)
    ask, plain, fast = np.arange(6), RunningTopK(3, False), RunningTopK(3, False)
    for at in range(0, 400, 40):
        part = scores[:, at : at + 40]
        plain.add(ask, np.arange(at, at + 40), part)
        fast.add(ask, np.arange(at, at + 40), part, fast.floors(ask))
    assert [plain.query.tolist(), plain.doc.tolist(), plain.score.tolist()] == [
        fast.query.tolist(), fast.doc.tolist(), fast.score.tolist()
    ]
