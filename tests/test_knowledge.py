import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sparkevidence.operators import dependency, evaluate, grams, graph, kg, pairs, records, scale


def test_unknown_and_blank_cancer_types(spark):
    m = spark.createDataFrame(
        [("G", "a", -1.0), ("G", "b", -0.9), ("G", "c", -0.4), ("G", "d", -2.0)],
        "gene string, cell_line string, score double",
    )
    lines = spark.createDataFrame([("a", "Lung"), ("b", None), ("c", "Lung")], "cell_line string, cancer_type string")
    h = dependency.essential_by_cancer(m, lines)
    assert dependency.essential_cancers(h).first()["essential_cancers"] == {"": 1, "Lung": 1, "Unknown": 1}
    s = dependency.gene_summary(m).first()
    assert (s["essential_count"], s["essential_pct"], s["total_cell_lines"]) == (3, 75.0, 4)
    c = dependency.cancer_specific(m, lines, "LUNG").first()
    assert (c["total"], c["essential_count"]) == (2, 1)


def score_matrix(seed, genes=23, lines=15):
    rnd = random.Random(seed)
    rows = []
    for g in range(genes):
        for line in range(lines):
            if rnd.random() < 0.85:
                # one gene does not vary at all
                rows.append((f"g{g}", f"l{line}", 0.5 if g == 3 else round(rnd.gauss(0, 1), 3)))
    return rows


def pearson(rows):
    of = {}
    for g, line, s in rows:
        of.setdefault(g, {})[line] = s
    out = {}
    for a, b in itertools.permutations(sorted(of), 2):
        common = sorted(set(of[a]) & set(of[b]))
        x, y = np.array([of[a][c] for c in common]), np.array([of[b][c] for c in common])
        if len(common) >= 10 and x.std() > 1e-9 and y.std() > 1e-9:
            out[a, b] = round(float(np.corrcoef(x, y)[0, 1]), 6)
    return out


def test_codependency_is_the_same_for_any_blocks(spark, monkeypatch):
    rows = score_matrix(1)
    m = spark.createDataFrame(rows, "gene string, cell_line string, score double")
    truth = pearson(rows)
    banned = spark.createDataFrame([("g1", "g2"), ("g7", "g5")], "gene_a string, gene_b string")
    skip = {("g1", "g2"), ("g2", "g1"), ("g5", "g7"), ("g7", "g5")}
    for cells in (4_000_000, 100):
        monkeypatch.setattr(dependency, "CELLS_PER_TASK", cells)
        for exclude, hidden in ((None, set()), (banned, skip)):
            got = {}
            for r in dependency.codependency_topk(m, 4, exclude).collect():
                got.setdefault(r["gene"], []).append((r["rank"], r["partner"], r["correlation"]))
            for g in {g for g, _, _ in rows}:
                best = sorted(
                    ((-v, b) for (a, b), v in truth.items() if a == g and (a, b) not in hidden)
                )[:4]
                mine = [(p, c) for _, p, c in sorted(got.get(g, []))]
                assert [p for p, _ in mine] == [b for _, b in best]
                assert np.allclose([c for _, c in mine], [-v for v, _ in best], atol=2e-6)


def test_pair_correlation_nulls(spark, monkeypatch):
    rows = score_matrix(2)
    m = spark.createDataFrame(rows, "gene string, cell_line string, score double")
    truth = pearson(rows)
    names = sorted({g for g, _, _ in rows}) + ["absent"]
    asked = [(a, b) for a in names for b in names if a < b]
    p = spark.createDataFrame(asked + asked[:5], "gene_a string, gene_b string")
    for cells in (4_000_000, 150):
        monkeypatch.setattr(dependency, "CELLS_PER_TASK", cells)
        got = {(r["gene_a"], r["gene_b"]): r["correlation"] for r in dependency.pair_correlation(p, m).collect()}
        assert set(got) == set(asked)
        for key, value in got.items():
            assert (value is None) == (key not in truth)
            assert value is None or abs(value - truth[key]) < 2e-6


def test_many_cell_lines_are_dealt_in_chunks_and_not_copied(spark, monkeypatch):
    rows = score_matrix(4, genes=8, lines=300)
    m = spark.createDataFrame(rows, "gene string, cell_line string, score double")
    truth = pearson(rows)
    asked = spark.createDataFrame(list(itertools.permutations([f"g{i}" for i in range(8)], 2)), "gene_a string, gene_b string")
    banned = spark.createDataFrame([("g1", "g2")], "gene_a string, gene_b string")
    monkeypatch.setattr(dependency, "CELLS_PER_TASK", 400)
    for per_block in (512, 3):
        monkeypatch.setattr(dependency, "GENES_PER_BLOCK", per_block)
        blocks, chunks = dependency._deal(m)
        dealt = dependency._dealt_scores(m, blocks, chunks)
        assert chunks > 5 and dealt.count() == len(rows) * blocks
        most = dealt.groupBy("bi", "bj", "chunk").count().agg(F.max("count")).first()[0]
        assert most <= 800
        got = {(r.gene_a, r.gene_b): r.correlation for r in dependency.pair_correlation(asked, m).collect()}
        assert {k for k, v in got.items() if v is not None} == set(truth) and len(got) == 56
        assert all(abs(got[k] - v) < 2e-6 for k, v in truth.items())
        best = {}
        for r in dependency.codependency_topk(m, 3, banned).collect():
            best.setdefault(r.gene, []).append((r["rank"], r.partner))
        for g in {a for a, _ in truth}:
            want = sorted((-v, b) for (a, b), v in truth.items() if a == g and {a, b} != {"g1", "g2"})[:3]
            assert [p for _, p in sorted(best[g])] == [b for _, b in want]


PAIRS = [
    (" brca1", "PARP1", "screen", "N/A", "1", "", "Gold standard"),
    ("parp1", "BRCA1", "paper", "HeLa", "", "", "Silver"),
    (None, "X", "s", "", "", "", ""),
    ("MTAP", "PRMT5", None, "", "9", "", None),
]
PAIR_SCHEMA = (
    "gene_a string, gene_b string, evidence_source string, cell_line string, pubmed_id string, "
    "cancer_type string, benchmark_level string"
)


def test_known_pairs(spark):
    df = spark.createDataFrame(PAIRS, PAIR_SCHEMA).withColumn("gene_a", F.trim("gene_a"))
    closure = {tuple(r) for r in pairs.symmetric_closure(df).collect()}
    assert closure == {("BRCA1", "PARP1"), ("PARP1", "BRCA1"), ("MTAP", "PRMT5"), ("PRMT5", "MTAP")}
    asked = spark.createDataFrame([("parp1", "brca1"), ("MTAP", "prmt5"), ("A", "B")], "gene_a string, gene_b string")
    got = {r["gene_a"]: r for r in pairs.validate_pairs(asked, df).collect()}
    assert got["PARP1"]["is_validated"] and got["PARP1"]["confidence"] in (0.7, 0.9)
    assert got["MTAP"]["evidence"] == "Unknown ()" and got["MTAP"]["confidence"] == 0.7
    assert not got["A"]["is_validated"] and got["A"]["confidence"] == 0.0
    genes = spark.createDataFrame([("BRCA1",)], "gene string")
    assert pairs.sl_partners(genes, df).count() == 2


def test_partner_document_counts_a_hub_whole(spark):
    rows = [("HUB", f"P{i:03d}", f"src{i % 3}", "", str(i), "", "", i) for i in range(300)]
    df = spark.createDataFrame(rows, PAIR_SCHEMA + ", pair_pos long")
    doc = pairs.partner_documents(spark.createDataFrame([("hub",)], "gene string"), df).first()
    assert "Known Synthetic Lethal Partners: P000, P001, P002, P003, P004\n" in doc["content"]
    assert "Total validated SL interactions: 300\nData sources: src0, src1, src2" in doc["content"]
    assert doc["content"].count("is synthetic lethal with") == 3
    assert doc["key_genes"] == ["HUB", "P000", "P001", "P002"]


def test_negatives_avoid_known_pairs(spark):
    known = spark.createDataFrame([("A", "B"), ("A", "C"), ("D", "E")], "gene_a string, gene_b string")
    genes = spark.createDataFrame([(g,) for g in "ABCDEFGH"], "gene string")
    out = evaluate.random_negatives(known, genes, seed=1, per_pair=2).collect()
    assert len(out) == 6
    for r in out:
        assert r["negative"] != r["gene_a"] and (r["gene_a"], r["negative"]) not in {("A", "B"), ("A", "C"), ("D", "E")}
    groups = spark.createDataFrame([("x", g) for g in "ABCF"] + [("y", g) for g in "DEGH"], "grp string, gene string")
    drawn = evaluate.drawn_negatives(known, groups, 1, 60).collect()
    assert len(drawn) == 4  # F twice for A, and both G and H for D
    for r in drawn:
        assert (r["negative"] == "F") if r["gene_a"] == "A" else (r["negative"] in "GH")


def test_every_pair_gets_a_negative_if_there_is_one(spark):
    genes = [f"G{i:02d}" for i in range(40)]
    known = [("G00", g) for g in genes[1:39]] + [("G05", "G06"), ("G39", "X"), ("LONE", "G01"), ("FULL", "P1")]
    groups = [("all", g) for g in genes] + [("z", "G05"), ("z", "G06"), ("f", "FULL"), ("f", "P1")]
    out = evaluate.drawn_negatives(
        spark.createDataFrame(known, "gene_a string, gene_b string"),
        spark.createDataFrame(groups, "grp string, gene string"), seed=3,
    ).collect()
    got = {(r["gene_a"], r["gene_b"]): r["negative"] for r in out}
    assert len(out) == len(got) and set(got) == {p for p in known if p[0] != "LONE"}
    assert {n for (a, _), n in got.items() if a == "G00"} == {"G39"}
    assert got[("FULL", "P1")] is None and got[("G05", "G06")] not in ("G05", "G06", "G00", None)


def test_substring_join_is_exact(spark):
    rnd = random.Random(4)
    names = ["".join(rnd.choices("ab-", k=rnd.randint(1, 9))) for _ in range(120)]
    needles = ["".join(rnd.choices("ab-", k=rnd.randint(1, 5))) for _ in range(40)] + [""]
    got = grams.substring_join(
        spark.createDataFrame([(n,) for n in needles], "n string"), "n",
        spark.createDataFrame([(n,) for n in names], "t string"), "t",
    ).collect()
    want = {(n, t) for n in needles if n for t in names if n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hub_gives_the_same_facts_with_and_without_broadcast(spark, monkeypatch):
    rows = [("HUB", "Gene", "r", "r", f"T{i:03d}", "Gene", "s") for i in range(200)]
    rows += [("T000", "Gene", "CelllinedependOnGene", "dep", "Z", "Cell", "s"), ("T000", "Gene", "r", "r", "HUB", "Gene", "s")]
    schema = "x_name string, x_type string, relation string, display_relation string, y_name string, y_type string, rel_source string"
    t = spark.createDataFrame(rows, schema)
    ask = spark.createDataFrame([(1, " hub ")], "query_id long, entity string")
    found = []
    for bound in (1_000_000, 0):
        monkeypatch.setattr(kg, "BROADCAST_ROWS", bound)
        found.append([tuple(r) for r in kg.kg_subgraph(ask, t, 2).orderBy("rank").collect()])
    assert found[0] == found[1] and len(found[0]) == 20
    assert found[0][0][1] == "- HUB → r → T000 → dep → Z" and found[0][0][2]
    everything = kg.kg_paths(ask, t, 2).collect()
    # 50 forward facts, one second step that does not lead back, one fact into the hub
    assert len(everything) == 52


def test_facts_move_once_to_their_question(spark, monkeypatch):
    schema = "x_name string, x_type string, relation string, display_relation string, y_name string, y_type string, rel_source string"
    t = spark.createDataFrame([(f"A{i}", "Gene", "r", "r", f"A{i + 1}", "Gene", "s") for i in range(9)], schema)
    ask = spark.createDataFrame([(i % 3, f"a{i}") for i in range(9)], "query_id long, entity string")
    monkeypatch.setattr(kg, "TASK_ENTITIES", 1)  # more entities make more tasks
    best = kg.kg_subgraph(ask, t, 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("Union")]
    assert last.count("Exchange ") == 1 and "hashpartitioning(query_id" in last and ", 9)" in last
    paths = {(r["query_id"], r["path"]) for r in best.collect()}
    want = {(i % 3, f"- A{i} → r → A{i + 1} (Type: Gene, Source: s)") for i in range(9)}
    want |= {(i % 3, f"- A{i} → r → A{i + 1} → r → A{i + 2}") for i in range(8)}
    assert paths == want | {((i + 1) % 3, f"- A{i} (Gene) → r → A{i + 1} (Source: s)") for i in range(8)}


def test_node_info(spark):
    t = spark.createDataFrame(
        [("A", "Gene", "r", "r", "B", "x", "s")],
        "x_name string, x_type string, relation string, display_relation string, y_name string, y_type string, rel_source string",
    )
    n = spark.createDataFrame([("a ",), ("B",), ("C",)], "name string")
    got = {r["name"]: (r["exists"], r["type"], r["out_degree"], r["in_degree"]) for r in kg.node_info(n, t).collect()}
    assert got == {"A": (True, "Gene", 1, 0), "B": (True, "Unknown", 0, 1), "C": (False, None, 0, 0)}


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, relationship string")


def test_graph_building(spark):
    raw = spark.createDataFrame(
        [(1, 1, "p53|binds|MDM2\nMDM2|binds|mdm2\nbad|line"), (1, 2, "TP53|blocks|MDM2")],
        "query_id long, doc_id long, raw string",
    )
    t = graph.triplets_of(raw)
    got = {(r["src"], r["dst"]): r["relationship"] for r in graph.build_graph(t).collect()}
    assert got == {("TP53", "MDM2"): "blocks", ("MDM2", "MDM2"): "binds"}
    aliases = spark.createDataFrame([("MDM2", "MDM2X"), ("p53", "no"), ("MDM2", "MDM2Y")], "query string, symbol string")
    got = {(r["src"], r["dst"]) for r in graph.build_graph(t, aliases, drop_loops=True).collect()}
    assert got == {("TP53", "MDM2X"), ("MDM2X", "MDM2")}


def test_distances_and_expansion(spark):
    e = edges(spark, [("A", "B", "r"), ("B", "C", "r"), ("C", "A", "r"), ("D", "A", "r"), ("X", "Y", "r"), ("C", "D", "r")])
    seeds = spark.createDataFrame([(1, "A")], "query_id long, node string")
    hops = {r["node"]: r["hop"] for r in graph.expand(seeds, e, 2).collect()}
    assert hops == {"A": 0, "B": 1, "C": 1, "D": 1}
    targets = spark.createDataFrame([(1, n) for n in "ABCDX"], "query_id long, node string")
    d = {r["node"]: r["distance"] for r in graph.distance_to_seeds(targets, seeds, e).collect()}
    assert d == {"A": 0, "B": 1, "C": 1, "D": 1, "X": -1}
    s = {r["node"]: r["score"] for r in graph.relevance(targets, seeds, e).collect()}
    assert s["A"] == 1.0 and s["B"] == 0.54 and s["X"] == 0.32


def steps_from(links, start):
    found, level = {start: 0}, [start]
    while level:
        level = sorted({b for a, b in links if a in level and b not in found})
        found |= {n: 1 + max(found.values()) for n in level}
    return found


def test_levels_of_many_questions_at_once(spark):
    rng = random.Random(5)
    names = [f"N{i}" for i in range(60)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(70)]
    links += [("N0", n) for n in names[1:40]] + links[:20]  # a hub and repeated links
    e = edges(spark, [(a, b, "r") for a, b in links])
    # ids of several bit sets, below zero and at the ends of a long
    starts = {q: rng.choice(names) for q in [*range(-70, 140), 2**63 - 1, -(2**63)]}
    rows = [*starts.items(), (None, "N1"), (5000, None), (6000, "not a node"), (0, starts[0])]
    seeds = spark.createDataFrame(rows, "query_id long, node string")
    both = links + [(b, a) for a, b in links]
    got = {(r["query_id"], r["node"]): r["hop"] for r in graph.expand(seeds, e, 3).collect()}
    want = {(q, n): h for q, s in starts.items() for n, h in steps_from(both, s).items() if h <= 3}
    assert got == want | {(6000, "not a node"): 0}
    asked = spark.createDataFrame([(q, n) for q in starts for n in names[:7]], "query_id long, node string")
    d = {(r["query_id"], r["node"]): r["distance"] for r in graph.distance_to_seeds(asked, seeds, e).collect()}
    for q, s in starts.items():
        out, into = steps_from(links, s), steps_from([(b, a) for a, b in links], s)
        for n in names[:7]:
            near = [h for h in (out.get(n), into.get(n)) if h is not None]
            assert d[q, n] == min(near, default=-1)
    assert graph.expand(seeds.limit(0), e, 2).count() == 0
    assert graph.expand(seeds, e.limit(0), 2).where("hop > 0").count() == 0


def test_bit_sets_are_taken_apart_last(spark):
    """Rows of single questions are not shuffled; odd targets and repeated seeds count as before."""
    e = edges(spark, [("A", "B", "r"), ("A", "B", "s"), ("B", "A", "r"), ("C", "B", "r"), ("B", "B", "r"), ("A", None, "r")])
    seeds = spark.createDataFrame([(1, "A"), (1, "A"), (70, "C"), (None, "B"), (2, None)], "query_id long, node string")
    rows = [(1, "A"), (1, "A"), (1, "B"), (70, "B"), (70, "A"), (-3, "B"), (None, "B"), (None, "B"), (1, None), (None, None), (2, "Z")]
    targets = spark.createDataFrame(rows, "query_id long, node string")
    distance, score = graph.distance_to_seeds(targets, seeds, e), graph.relevance(targets, seeds, e)
    d = {(r["query_id"], r["node"]): r["distance"] for r in distance.collect()}
    s = {(r["query_id"], r["node"]): r["score"] for r in score.collect()}
    odd = {(None, "B"): -1, (1, None): -1, (None, None): -1, (2, "Z"): -1, (-3, "B"): -1}
    assert d == {(1, "A"): 0, (1, "B"): 1, (70, "B"): 1, (70, "A"): 2} | odd and distance.count() == len(d)
    # two repeated seeds and one link give two; B has six ends
    want = {(1, "A"): 1.0, (1, "B"): 0.82, (70, "B"): 0.62, (70, "A"): 0.38, (-3, "B"): 0.42, (None, "B"): 0.42}
    assert s == want | {(1, None): 0.3, (None, None): 0.3, (2, "Z"): 0.3} and score.count() == len(s)
    for df in (distance, score):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.index("Generate ") < plan.index("Exchange ")


def all_paths(links, a, b, most):
    out, stack = [], [[a]]
    while stack:
        path = stack.pop()
        if path[-1] == b:
            out.append(path)
        elif len(path) <= most:
            stack += [path + [n] for s, n in links if s == path[-1] and n not in path]
    return sorted(out, key=lambda p: (len(p), p))


def test_paths_against_a_search(spark):
    rnd = random.Random(9)
    nodes = "ABCDEFG"
    links = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(22)})
    e = edges(spark, [(a, b, "r") for a, b in links])
    asked = [(a, b) for a in nodes for b in nodes if a != b]
    got = {}
    for r in graph.find_paths(spark.createDataFrame(asked, "source string, target string"), e).collect():
        got.setdefault((r["source"], r["target"]), []).append((r["rank"], r["path"]))
    for a, b in asked:
        assert [p for _, p in sorted(got.get((a, b), []))] == all_paths(links, a, b, 4)[:10]


def test_graph_texts(spark):
    e = edges(spark, [("A", "B", "binds"), ("C", "A", "blocks"), ("A", "A", "self")])
    nodes = graph.nodes_of(e)
    text = graph.node_context(spark.createDataFrame([("A",)], "node string"), e, nodes).first()["content"]
    assert text == (
        "Entity: A\n\nRelationships:\n  → self → A\n  → binds → B\n  ← self ← A\n  ← blocks ← C\n"
        "[Source: Knowledge Graph]"
    )
    seeds = spark.createDataFrame([(1, "A")], "query_id long, node string")
    names = spark.createDataFrame([(1, ["A"])], "query_id long, names array<string>")
    gold = spark.createDataFrame([(1, "- G")], "query_id long, gold string")
    context = graph.graph_context(seeds, e, names, gold).first()["content"].split("\n")
    assert context[1:6] == [
        "Query Genes: A", "Extracted Relationships (3):", "A --[self]--> A", "A --[binds]--> B", "C --[blocks]--> A",
    ]
    assert context[-2:] == ["[Gold Standard Validation (Open Targets)]", "- G"]


def test_upserts(spark):
    e = edges(spark, [("A", "B", "old"), ("B", "C", "keep")])
    got = {(r["src"], r["dst"]): r["relationship"] for r in graph.upsert_edges(e, edges(spark, [("A", "B", "new")])).collect()}
    assert got == {("A", "B"): "new", ("B", "C"): "keep"}
    n = spark.createDataFrame([("A", "old")], "id string, type string")
    got = {r["id"]: r["type"] for r in graph.upsert_nodes(n, spark.createDataFrame([("A", "new"), ("B", "b")], "id string, type string")).collect()}
    assert got == {"A": "new", "B": "b"}


def test_validation_rules(spark):
    t = spark.createDataFrame(
        [(1, 1, 0, "AAA", "r", "BBB"), (1, 1, 1, "AAA", "r", "LUNG CANCER"), (1, 1, 2, "AAA", "r", "CCC"), (1, 1, 3, "AAA", "r", "SKIN TUMOR")],
        "query_id long, doc_id long, pos int, src string, relation string, dst string",
    )
    i = spark.createDataFrame([("BBB", "AAA", 0.7), ("AAA", "CCC", 0.69)], "gene_a string, gene_b string, score double")
    a = spark.createDataFrame(
        [("aaa", "lung cancer", 0.51, {"known_drug": 0.9, "literature": 0.1}), ("AAA", "SKIN TUMOR", 0.09, {})],
        "gene string, disease string, score double, datatype_scores map<string,double>",
    )
    out = graph.validate_triplets(t, i, a)
    got = {r["dst"]: (r["validated"], r["validation_source"]) for r in out.collect()}
    assert got == {"BBB": (True, "STRING"), "LUNG CANCER": (True, "OpenTargets"), "CCC": (False, None), "SKIN TUMOR": (False, None)}
    assert graph.gold_lines(out).first()["gold"] == (
        "- OT Validation: AAA-LUNG CANCER (Score: 0.51, High, Top Evidence: Known Drug)"
    )


def test_resolving_records(spark):
    articles = spark.createDataFrame(
        [("7", "Loss of MTAP: a study", "10.1/a"), ("3", "Loss of MTAP: a study", "10.1/b"), ("9", "WRN helicase", "10.1/c")],
        "pmid string, title string, doi string",
    )
    asked = spark.createDataFrame(
        [
            (1, "https://pubmed.ncbi.nlm.nih.gov/55", "WRN helicase"), (2, "http://x", "loss of mtap: A STUDY"),
            (3, "http://x", "Loss of MTAP (a study)"), (4, "https://doi.org/10.1/c", "other"),
            (5, "https://www.researchgate.net/p", "The WRN helicase"), (6, "http://x", None),
            (7, "https://pmc.ncbi.nlm.nih.gov/articles/PMC5/", ""),
        ],
        "request_id long, url string, title string",
    )
    archive = spark.createDataFrame([("PMC5", "88")], "pmc_id string, pmid string")
    got = {r["request_id"]: (r["pmid"], r["method"]) for r in records.resolve_records(asked, articles, archive).collect()}
    assert got == {
        1: ("55", "URL_EXTRACTION"), 2: ("3", "TITLE_EXACT"), 3: ("3", "TITLE_FUZZY"), 4: ("9", "DOI_SEARCH"),
        5: ("9", "RESEARCHGATE_CLEANUP"), 6: (None, None), 7: ("88", "URL_EXTRACTION"),
    }


def test_answers_and_invariance(spark):
    rows = spark.createDataFrame(
        [("A1", "yes_no", "Yes", "yes."), ("A1", "yes_no", "No", "unsure"), ("A2", "letter", "C", "Answer: C")],
        "task string, options string, target string, raw string",
    )
    got = {r["task"]: (r["n"], r["accuracy"]) for r in evaluate.accuracy_by_task(evaluate.score_answers(rows)).collect()}
    assert got == {"A1": (2, 0.5), "A2": (1, 1.0), "ALL": (3, 0.666667)}
    a = spark.createDataFrame([(1, 0, "Yes"), (1, 1, "Yes"), (1, 2, "No"), (2, 0, None), (2, 1, None)], "item_id long, variant int, answer string")
    assert tuple(evaluate.invariance_rate(a).first()) == (3, 0.666667)


def test_lineage_is_cut(spark):
    df = scale.cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and len(df.inputFiles()) > 0
    assert scale.at_most(df, 5) and not scale.at_most(df, 4)


def test_substring_join_by_the_rarest_gram(spark):
    names = [f"CUSTOMER#{i:09d}" for i in range(300)] + ["a", "ab", "xaby", "", None, "Ünï-çödé", "x" * 40]
    needles = [f"CUSTOMER#{i:09d}" for i in range(0, 300, 7)] + [
        "CUSTOMER#", "a", "ab", "b", "zz", "", None, "ï-ç", "00000012", "x" * 30, "x" * 41, "MER#0000000", "q" * 12,
    ]
    got = grams.substring_join(
        spark.createDataFrame([(x, 1) for x in needles * 2], "w string, n int"), "w",
        spark.createDataFrame([(x, 2) for x in names * 2], "t string, n int"), "t",
    )
    want = sorted((w, t) for w in set(needles) for t in set(names) if w and t and w in t)
    assert sorted(map(tuple, got.collect())) == want


def test_substring_candidates_are_about_the_matches(spark, monkeypatch):
    """Names that share all but their last characters: candidates grow with the matches, not with the pairs."""
    names = spark.range(3_000).selectExpr("concat('CUSTOMER#', lpad(id, 9, '0')) as t")
    needles = names.where("right(t, 1) = '7'").withColumnRenamed("t", "w")
    joined = grams.substring_join(needles, "w", names, "t")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan
    monkeypatch.setattr(grams.F, "contains", lambda a, b: grams.F.lit(True))
    candidates = grams.substring_join(needles, "w", names, "t").count()
    assert joined.count() == 300 and candidates <= 600


def test_paths_against_a_plain_search(spark):
    rnd = random.Random(3)
    edges = sorted({(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(45)})
    links = defaultdict(list)
    for a, b in edges:
        links[a].append(b)

    def walks(path, target, most):
        if path[-1] == target:
            return [path]
        if len(path) > most:
            return []
        return [w for n in links[path[-1]] if n not in path for w in walks([*path, n], target, most)]

    pairs_ = [("n0", "n5"), ("n3", "n9"), ("n1", "n1"), ("n2", "nowhere"), ("n7", "n13")]
    df = spark.createDataFrame([(a, b, f"{a}>{b}") for a, b in edges], "src string, dst string, relationship string")
    asked = spark.createDataFrame(pairs_ * 2, "source string, target string")
    for most, limit in ((4, 10), (5, 3), (3, 100), (1, 2)):
        got = defaultdict(list)
        for r in graph.find_paths(asked, df, most, limit).orderBy("source", "target", "rank").collect():
            got[r.source, r.target].append(r.path)
            assert r.text == "; ".join(f"{a} -[{a}>{b}]-> {b}" for a, b in zip(r.path, r.path[1:]))
        for a, b in set(pairs_):
            want = sorted(walks([a], b, most), key=lambda p: (len(p), p))[:limit] if a != b else []
            assert got[a, b] == want


def test_sources_at_one_hub_do_not_walk_to_each_other(spark, monkeypatch):
    """Suppliers of one nation lead to it and back: no walk from each to each other is written."""
    n = 300
    rows = [*((f"s{i}", "hub") for i in range(n)), *(("hub", f"s{i}") for i in range(n)), ("hub", "end")]
    edges = spark.createDataFrame([(a, b, f"{a}>{b}") for a, b in rows], "src string, dst string, relationship string")
    asked = spark.createDataFrame([(f"s{i}", "end") for i in range(n)], "source string, target string")
    written = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append((out := cut(df)).count()) or out)
    got = graph.find_paths(asked, edges).collect()
    assert sorted(r.path[0] for r in got) == sorted(f"s{i}" for i in range(n))
    assert all(r.path[1:] == ["hub", "end"] for r in got)
    assert max(written) <= 2 * n


def test_parallel_edges_loops_and_shared_ends_of_paths(spark):
    rows = [("a", "b", "x"), ("a", "b", "y"), ("b", "c", "x"), ("b", "b", "loop"), ("a", "a", "loop"), ("c", "a", "x"), ("c", "d", "x")]
    edges = spark.createDataFrame(rows, "src string, dst string, relationship string")
    asked = spark.createDataFrame([("a", "d"), ("b", "a"), ("c", "b"), ("d", "a")], "source string, target string")
    got = sorted((r.source, r.target, "".join(r.path), r.text) for r in graph.find_paths(asked, edges).collect())
    assert [g[:3] for g in got] == [("a", "d", "abcd"), ("a", "d", "abcd"), ("b", "a", "bca"), ("c", "b", "cab"), ("c", "b", "cab")]
    assert {g[3] for g in got if g[0] == "c"} == {"c -[x]-> a; a -[x]-> b", "c -[x]-> a; a -[y]-> b"}
