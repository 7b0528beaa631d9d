import json

from sparkevidence.operators import bm25
from sparkevidence.sources import corpus, dependency_files, graph_files


def test_corpus_and_index(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    items = [
        {"text": "MTAP loss", "metadata": {"paper_title": "P", "key_genes": ["MTAP"], "is_web": True}},
        {"text": "no metadata"},
    ]
    path.write_text("\n".join(json.dumps(i) for i in items))
    rows = {r["content"]: r for r in corpus.read_corpus(spark, str(path)).collect()}
    assert rows["MTAP loss"]["title"] is None and rows["MTAP loss"]["paper_title"] == "P"
    assert rows["MTAP loss"]["key_genes"] == ["MTAP"] and rows["no metadata"]["is_web"] is None
    index = bm25.build_index(corpus.read_corpus(spark, str(path)))
    corpus.write_index(index, str(tmp_path / "index"))
    again = corpus.read_index(spark, str(tmp_path / "index"))
    assert again.totals == index.totals and again.totals.n_docs == 2 and again.postings.count() == 8
    assert again.words.where("term = 'MTAP'").first()["df"] == 1


def test_vectors_benchmark_payloads_results(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<float>")
    corpus.write_vectors(v, str(tmp_path / "v"))
    assert corpus.read_vectors(spark, str(tmp_path / "v")).first()["embedding"] == [0.5, 0.25]
    (tmp_path / "b.jsonl").write_text('{"input":"i","target":"No","metadata":{"gene_a":"A","label":0}}')
    b = corpus.read_benchmark(spark, str(tmp_path / "b.jsonl")).first()
    assert b["target"] == "No" and b["metadata"]["gene_a"] == "A"
    assert corpus.read_payloads(spark, str(tmp_path / "b.jsonl")).first()["payload"].startswith("{")
    corpus.write_results(v, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_wide_matrix(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "DepMap_ID,BRCA1 (672),PARP1 (142),BRCA1 (9)\n"
        "L1,-1.5,NA,0.25\nL2,0.5,,\nL3,x,1e-1,\n"
    )
    got = {(r["gene"], r["cell_line"]): r["score"] for r in dependency_files.read_dependency_matrix(spark, str(path)).collect()}
    assert got == {("BRCA1", "L1"): 0.25, ("BRCA1", "L2"): 0.5, ("PARP1", "L3"): 0.1}


def test_cell_lines_and_pairs(spark, tmp_path):
    (tmp_path / "l.csv").write_text("DepMap_ID,StrippedCellLineName,OncotreeLineage\nA1,HELA,Cervix\n,X,Y\nA2,,\n")
    rows = dependency_files.read_cell_lines(spark, str(tmp_path / "l.csv")).collect()
    assert [(r["cell_line"], r["name"], r["cancer_type"], r["tissue"]) for r in rows] == [
        ("A1", "HELA", "Cervix", ""), ("A2", "", "", ""),
    ]
    assert dependency_files.read_pairs(spark, str(tmp_path)) is None
    (tmp_path / "SL_pairs.csv").write_text("Gene_A,Gene_B,Source\nA,B,x\n,C,y\n")
    p = dependency_files.read_pairs(spark, str(tmp_path)).collect()
    assert [(r["gene_a"], r["gene_b"], r["evidence_source"], r["cell_line"]) for r in p] == [("A", "B", "x", "N/A")]
    (tmp_path / "sl_benchmark.csv").write_text("gene_a,gene_b\nD,E\n")
    assert dependency_files.read_pairs(spark, str(tmp_path)).first()["evidence_source"] == "Unknown"


def test_graph_files(spark, tmp_path):
    doc = {
        "nodes": [{"id": "A", "type": "Gene", "name": "a"}, {"id": "B", "note": "n"}],
        "edges": [
            {"source": "A", "target": "B", "relationship": "old"},
            {"source": "A", "target": "B", "type": "new", "w": 1},
        ],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    nodes, edges = graph_files.load_node_link(spark, str(tmp_path / "g.json"))
    assert {r["id"]: r["attrs"] for r in nodes.collect()} == {"A": {}, "B": {"note": "n"}}
    assert [(r["relationship"], r["attrs"]) for r in edges.collect()] == [("new", {"w": "1"})]
    graph_files.save_graph(nodes, edges, str(tmp_path / "g"))
    n2, e2 = graph_files.load_graph(spark, str(tmp_path / "g"))
    assert n2.count() == 2 and e2.first()["src"] == "A"


def test_stored_graphs_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_files, "FILE_ROWS", 40)
    empty = "cast(map() as map<string,string>) as attrs"
    nodes = spark.range(100, numPartitions=1).selectExpr("'N' || id as id", "'T' as type", "'n' as name", empty)
    edges = nodes.selectExpr("id as src", "'N1' as dst", "'r' as relationship", "attrs")
    graph_files.save_graph(nodes, edges, str(tmp_path / "g"))
    for name in ("nodes", "edges"):
        files = [f.name for f in (tmp_path / "g" / name).iterdir() if f.name.startswith("part-")]
        assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)
    n2, e2 = graph_files.load_graph(spark, str(tmp_path / "g"))
    assert sorted(map(str, n2.collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(str, e2.collect())) == sorted(map(str, edges.collect()))


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<graphml><key id="d0" for="node" attr.name="type"/><key id="d1" for="edge" attr.name="relationship"/>'
        '<graph edgedefault="directed"><node id="A"><data key="d0">Gene</data></node>\n<node id="B"></node>\n'
        '<edge source="A" target="B"><data key="d1">binds</data></edge></graph></graphml>'
    )
    nodes, edges = graph_files.load_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["id"]: r["type"] for r in nodes.collect()} == {"A": "Gene", "B": None}
    assert [(r["src"], r["dst"], r["relationship"]) for r in edges.collect()] == [("A", "B", "binds")]


def test_triples_in_buckets(spark, tmp_path):
    t = spark.createDataFrame(
        [("A", "Gene", "r", "r", "B", "Gene", "s")], ", ".join(f"{c} string" for c in graph_files.TRIPLE_COLUMNS)
    )
    t.write.parquet(str(tmp_path / "t"))
    again = graph_files.read_triples(spark, str(tmp_path / "t"))
    graph_files.write_triples(again, "kg", 4)
    plan = spark.table("kg_by_x").join(again.select("x_name"), "x_name")._jdf.queryExecution().toString()
    assert spark.table("kg_by_y").count() == 1 and "kg_by_x" in plan


def test_knowledge_base_round_trip(spark, tmp_path):
    one = spark.range(1)
    dependency_files.write_knowledge_base(one, one, one, str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb" / "matrix")).count() == 1


def test_quoted_commas_shift_no_column(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('DepMap_ID,"AAA (1, old)",BBB (2)\n"ACH-1, x",-0.5,0.25\nACH-2,"0.75",1\n')
    got = {(r.gene, r.cell_line): r.score for r in dependency_files.read_dependency_matrix(spark, str(path)).collect()}
    assert got == {("AAA", "ACH-1, x"): -0.5, ("BBB", "ACH-1, x"): 0.25, ("AAA", "ACH-2"): 0.75, ("BBB", "ACH-2"): 1.0}


def test_ids_of_a_corpus_without_ids_repeat(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"text": "a", "metadata": {"title": "t"}}\n{"text": "b"}\n')
    ids = [{r.content: r.doc_id for r in corpus.read_corpus(spark, str(path)).repartition(n).collect()} for n in (1, 3)]
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 2
