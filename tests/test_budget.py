import random
import re

from pyspark.sql import functions as F

from sparkevidence.config import Settings
from sparkevidence.operators import budget, compress

RESULT = (
    "query_id long, doc_id long, content string, title string, paper_title string, link string, "
    "url string, key_genes array<string>, is_web boolean, is_synthetic boolean, score double, "
    "rank int, source string"
)


def result(q, d, content, source, rank, synthetic=False, web=False, title="T", genes=()):
    return (q, d, content, title, None, "L", None, list(genes), web, synthetic, 0.5, rank, source)


def pack(spark, rows, kg=None, graph=None, ids=(1,), **limits):
    queries = spark.createDataFrame([(i,) for i in ids], "query_id long")
    texts = "query_id long, content string"
    out = budget.pack_context(
        queries, spark.createDataFrame(rows, RESULT),
        None if kg is None else spark.createDataFrame(kg, texts),
        None if graph is None else spark.createDataFrame(graph, texts),
        "2025-01-01", Settings(**limits),
    )
    return {r["query_id"]: r for r in out.collect()}


def test_sections_in_order_of_trust(spark):
    rows = [
        result(1, 1, "lit " * 10, "bm25", 2, genes=["A", "B", "C", "D"]),
        result(1, 2, "kb doc", "depmap_kb", 1, synthetic=True),
        result(1, 3, "web " * 10, "web_search", 3, web=True),
        result(1, 4, "fact", "external_kg", 4),
        result(1, 5, "edge", "graph_rag", 5),
    ]
    r = pack(spark, rows)[1]
    text = r["context"]
    marks = [text.index(f"[PRIORITY {i}]") for i in range(4)]
    assert marks == sorted(marks)
    assert "1. fact (relation: unknown, score: 0.50)\n" in text
    assert "1. kb doc\n" in text and "1. edge\n" in text
    assert "Source [1] 📄 [LOCAL] [Rel: 0.500]\nTitle: T\nKey Genes: A, B, C\nContent: lit" in text
    assert "Source [2] 🌐 [WEB] (L) [Rel: 0.500]\nTitle: T\nContent: web" in text
    assert [x["id"] for x in r["references"]] == [1, 2]
    assert r["p1_tokens"] == len("1. kb doc\n") // 4
    parts = r["p0_tokens"] + r["p1_tokens"] + r["p2_tokens"] + r["p3_tokens"]
    assert r["total_tokens"] == 1000 + parts


def test_ready_texts_replace_results_and_are_cut(spark):
    kg = [(1, "line one\n" + "x" * 400 + "\nlast")]
    graph = [(1, "HEAD\n" + "\n".join(f"A{i} --[r]--> B{i}" for i in range(300)))]
    rows = [result(1, 4, "fact", "external_kg", 1), result(1, 5, "edge", "graph_rag", 2)]
    r = pack(spark, rows, kg, graph, p0_tokens=20, p2_tokens=120)[1]
    assert "line one" in r["context"] and "xxxx" not in r["context"] and "fact" not in r["context"]
    assert r["p0_tokens"] == 2 and 0 < r["p2_tokens"] <= 120
    assert "1. edge" not in r["context"]


def test_first_overflow_ends_a_section(spark):
    rows = [result(1, i, "k" * n, "depmap_kb", i, synthetic=True) for i, n in enumerate((40, 400, 4), 1)]
    r = pack(spark, rows, p1_tokens=20)[1]
    assert r["p1_tokens"] == 11 and r["context"].count("...(truncated)") == 1
    assert "3. kkkk" not in r["context"]


def test_literature_takes_what_is_left(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for q in range(6):
        used, ids, closed = 0, [], False
        # one question holds most of the rows
        for n in range(1, (120 if q == 0 else 12) + 1):
            content = "w" * rnd.choice((10, 200, 900))
            rows.append(result(q, n, content, "bm25", n))
            entry = f"\nSource [{n}] 📄 [LOCAL] [Rel: 0.500]\nTitle: T\nContent: {content}\n"
            closed = closed or used + len(entry) // 4 > 1000
            if not closed:
                used += len(entry) // 4
                ids.append(n)
        want[q] = (used, ids)
    got = pack(spark, rows, ids=range(6), max_context_tokens=2000)
    for q, (used, ids) in want.items():
        assert got[q]["p3_tokens"] == used
        assert [x["id"] for x in got[q]["references"]] == ids


def test_question_without_results(spark):
    r = pack(spark, [result(1, 1, "x", "bm25", 1)], ids=(1, 2))
    assert r[2]["total_tokens"] == 1000 and r[2]["references"] == []
    assert "PRIORITY" not in r[2]["context"]


def test_references(spark):
    rows = spark.createDataFrame([result(1, 1, "y" * 300, "bm25", 1)], RESULT)
    short = budget.format_references(rows, Settings(eval_mode=False)).first()
    assert short["content"] == "y" * 200 + "..."
    full = budget.format_references(rows, Settings(eval_content_length=0)).first()
    assert full["content"] == "y" * 300 and full["score"] == 0.5


def test_literature_segment(spark):
    rows = [result(1, i, "y" * 600, "bm25", i) for i in (1, 2, 3)]
    out = budget.literature_segment(spark.createDataFrame(rows, RESULT), 300).first()
    assert out["content"].startswith("**Literature Evidence:**\n[1] **Title:** T\n")
    assert out["content"].endswith("...(truncated, 1 more references)") and out["tokens"] <= 300


def greedy(text, cap, names=()):
    """The chosen sentences, by value, passing over those that do not fit."""
    if len(text.split()) <= cap:
        return text
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s]
    valued = []
    for i, s in enumerate(sentences):
        value = max(0, 2 - i * 0.5) if i < 3 else 0
        value += 3 * sum(n.upper() in s.upper() for n in set(names))
        value += sum(w in s.lower() for w in compress.CONTENT_WORDS)
        value += 2 if re.search(compress.FIGURE_PATTERN, s) else 0
        valued.append((-value, i, len(s.split())))
    used, kept = 0, []
    for _, i, words in sorted(valued):
        if used < cap and used + words <= cap:
            used += words
            kept.append(i)
    return " ".join(sentences[i] for i in sorted(kept))


def test_extractive_against_a_loop(spark):
    rnd = random.Random(7)
    pool = "gene cancer cell of the TP53 12.5% pathway loss p<0.05 a b".split()
    texts = []
    for _ in range(80):
        n = rnd.randint(0, 14)
        texts.append(" ".join(
            " ".join(rnd.choices(pool, k=rnd.randint(1, 25))) + rnd.choice(".!?") for _ in range(n)
        ))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    names = F.array(F.lit("tp53"))
    got = dict(df.select("i", compress.extractive("t", 40, names)).collect())
    for i, t in enumerate(texts):
        assert got[i] == greedy(t, 40, ["TP53"]), t


def test_sentence_filter_keeps_neighbours(spark):
    # with five sentences and a ratio of 0.2 one is best, and both its neighbours stay
    text = "First one here. Second one here. MTAP loss matters. Fourth one here. Fifth one here."
    df = spark.createDataFrame([(1, 1, "MTAP loss", text), (1, 2, "q", "One only. ")],
                               "query_id long, doc_id long, query string, content string")
    out = {r["doc_id"]: r for r in compress.compress_sentence_filter(df, ratio=0.2).collect()}
    assert out[1]["content"] == "Second one here. MTAP loss matters. Fourth one here."
    assert out[1]["original_length"] == len(text) and out[2]["content"] == "One only."

    def encoder(texts):
        return [[float(t.startswith("Fifth") or t.startswith("MTAP loss"))] for t in texts]

    out = compress.compress_sentence_filter(df.where("doc_id = 1"), encoder, ratio=0.2).first()
    assert out["content"] == "Second one here. MTAP loss matters. Fourth one here."


def test_target_words(one):
    assert one(compress.target_words(F.lit("a " * 50), 0.6)) == 64
    assert one(compress.target_words(F.lit("a " * 200), 0.6)) == 120
    assert one(compress.target_words(F.lit("a " * 5000), 0.6)) == 600
