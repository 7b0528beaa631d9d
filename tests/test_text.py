from pyspark.sql import functions as F

from sparkevidence.functions import outputs, queries, render, text, trim, urls


def lit(s):
    return F.lit(s)


def test_symbols_are_taken_from_the_upper_cased_text(one):
    assert one(text.extract_genes(lit("Is tp53 lethal with STK11缺失 or X?"))) == [
        "IS", "TP53", "LETHAL", "STK11",
    ]
    assert one(text.extract_genes(lit("TP53 and brca1"), case_sensitive=True)) == ["TP53"]
    assert one(text.extract_genes(lit("ABCDEFGHIJK A AB"))) == ["AB"]


def test_tokens_hold_symbols_and_words_once(one):
    assert sorted(one(text.tokenize(lit("TP53, tp53 OR mut_1 é")))) == sorted(
        ["TP53", "OR", "MUT", "tp53", "or", "mut_1", "é"]
    )
    assert one(text.tokenize_hyphen(lit("BRCA-1 is-it bRCA BRCA-1"))) == [
        "BRCA-1", "brca-1", "is-it", "brca", "BRCA-1", "brca-1",
    ]


def test_keywords(one):
    assert one(text.match_keywords(lit("A CRISPR screening of synthetic lethality 缺失"))) == [
        "synthetic lethal", "synthetic lethality", "screening", "crispr", "缺失",
    ]


def test_sentences_and_tokens(one):
    assert one(text.split_sentences(lit("One two. No.  Three four!\nFive six?"))) == [
        "One two.", "Three four!", "Five six?",
    ]
    assert one(text.count_tokens(lit("abcdefg"))) == 1
    assert one(text.truncate_tokens(lit("abcdefghij"), 2)) == "abcdefgh"
    assert one(text.truncate_tokens(lit("abcdefghij"), 2, True)) == "cdefghij"


def test_empty_title_hides_paper_title(one):
    assert one(text.title_of(lit(""), lit("paper"))) == ""
    assert one(text.title_of(lit(None).cast("string"), lit("paper"))) == "paper"


def test_fingerprint_falls_back(one):
    def fp(title, link, source, content):
        return one(text.title_fingerprint(lit(title), lit(link), lit(source), lit(content)))

    long = "A Study: of the Loss of PRMT5 in Cells, and more and more and more of it"
    assert fp(long, "", "", "") == "a study of the loss of prmt5 in cells and more and more and "
    assert fp("Short", "http://x", "s", "c") == "http://x"
    assert fp("Short", "", "s", "c") == "local_s"
    assert fp("", "", "", "c") == "hash_4a8a08f09d37b737"


def test_identifiers(one):
    def ids(u):
        return tuple(one(urls.extract_ids(lit(u))))

    assert ids("https://clinicaltrials.gov/study/nct03785249")[0] == "NCT03785249"
    assert ids("https://www.biorxiv.org/content/10.1101/845446v1")[1] == "10.1101/845446"
    assert ids("https://x.org/10.1101/845446v1")[1] is None
    assert ids("https://pubmed.ncbi.nlm.nih.gov/123/")[2] == "123"
    assert ids("https://www.ncbi.nlm.nih.gov/pubmed/77")[2] == "77"
    assert ids("see PMID: 42")[2] == "42"
    assert ids("https://www.nature.com/articles/s41586-021")[3] == "10.1038/s41586"
    assert ids("https://doi.org/10.1016/j.cell.1")[3] == "10.1016/j.cell.1"
    assert ids("https://pmc.ncbi.nlm.nih.gov/articles/PMC99/")[4] == "PMC99"


def test_routes_and_pdf(one):
    assert one(urls.url_route(lit("https://a.org/NCT00000001.pdf"))) == "trial"
    assert one(urls.url_route(lit("https://medrxiv.org/content/10.1101/1.pdf"))) == "preprint"
    assert one(urls.url_route(lit("https://a.org/pdf/1"))) == "pdf"
    assert one(urls.url_route(lit("https://a.org/x"))) == "web"
    assert one(urls.preprint_pdf_url(lit("https://biorxiv.org/content/10.1101/1v2/"))) == (
        "https://biorxiv.org/content/10.1101/1.full.pdf"
    )
    assert one(urls.preprint_pdf_url(lit("https://biorxiv.org/x"))) is None


def test_links_are_resolved(one):
    from urllib.parse import urljoin

    base = "https://a.org/d/e/page.html?q=1#f"
    hrefs = ["x", "../y", "/z/./w/../v", "//b.org/p", "?k=2", "https://c.org/a", "./", "../../../u"]
    html = " ".join(f'<a href="{h}">' for h in hrefs) + '<a href="mailto:me@x">'
    want = {urljoin(base, h) for h in hrefs}
    assert set(one(urls.page_links(lit(html), lit(base)))) == want
    assert one(urls.page_links(lit(html), lit(base), r"b\.org")) == ["https://b.org/p"]


def test_page_text_and_paywall(one):
    html = "<head><title>t</title></head><nav>menu</nav><p>A &amp; B</p><script>x<1</script>"
    assert one(urls.main_text(lit(html))) == "A & B"
    assert one(urls.page_outcome(lit("Please: Subscription Required"), lit("x" * 300))) == "paywall"
    assert one(urls.page_outcome(lit("<p>"), lit("x" * 199))) == "content_too_short"
    assert one(urls.page_outcome(lit("<p>"), lit("x" * 200))) is None


def test_titles(one):
    assert one(urls.clean_title(lit("Loss [of]  X: a (new) way"))) == "Loss of X a new way"
    assert one(urls.loose_title(lit("The loss of MTAP reveals a need"))) == "loss MTAP"


def test_dates(one):
    assert one(urls.extract_date(lit("on January 5, 2024 and 2023-01-01"))) == "January 5 2024"
    assert one(urls.extract_date(lit("5 March 2021"))) == "5 March 2021"
    assert one(urls.extract_date(lit("x 2024/1/15"))) == "2024 1 15"
    assert one(urls.extract_date(lit("Published: 2019"))) == "2019"
    assert one(urls.extract_date(lit("in 1999"))) is None


def test_search_strings(one):
    names = F.array(*[lit(x) for x in "ABCD"])
    out = one(queries.compose_search(lit("q"), names, F.array().cast("array<string>")))
    assert out.startswith('q ("A" OR "B" OR "C") (site:ncbi.nlm.nih.gov OR ')
    lists = F.array(F.array(*[lit(x) for x in "ABCD"]), F.array(lit("E")))
    assert one(queries.boolean_expand(lit("q"), lists)) == (
        '("A" OR "B" OR "C" OR "E") AND ("synthetic lethality" OR "synthetic lethal")'
    )
    assert one(queries.is_recent_query(lit("the Latest work")))
    assert one(queries.is_recent_query(lit("最新的研究")))
    assert not one(queries.is_recent_query(lit("in 2019")))
    assert one(queries.step_back_queries(lit("role of Tp53 and MTAP")))[0].startswith("MTAP ")


def test_query_lines(one):
    raw = "# head\n1. first one\n\n- second\nExample: no\n  * 3) third"
    assert one(queries.parse_query_lines(lit(raw))) == ["first one", "second", ") third"]


def test_triplets(one):
    raw = "A|binds|B\nno\nA|b\nA|x|y|z\n |r|B\n C | hits | D "
    got = [(t["subject"], t["relation"], t["object"]) for t in one(outputs.parse_triplets(lit(raw)))]
    assert got == [("A", "binds", "B"), ("C", "hits", "D")]


def verdict(one, raw):
    v = one(outputs.parse_verdict(lit(raw)))
    return v["status"], v["confidence"], [i["description"] for i in v["issues"]], v["suggestions"]


def test_verdicts(one):
    assert verdict(one, '{"status":"fail","confidence":1.7,"issues":[{"description":"d","suggestion":"s"},"plain"]}') == (
        "FAIL", 1.0, ["d", "plain"], ["s"],
    )
    fenced = 'Sure:\n```json\n{"status": "PASS", "confidence": "x"}\n```'
    assert verdict(one, fenced) == ("PASS", 0.8, [], [])
    assert verdict(one, '{"status":"FAIL"}')[2] == [outputs.NO_ISSUE_DESCRIPTION]
    plain = "VERDICT: FAIL\nCONFIDENCE: 0.3\nISSUES:\n- too weak a claim\n- no\nSUGGESTIONS:\n• read more papers"
    assert verdict(one, plain) == ("FAIL", 0.3, ["too weak a claim"], ["read more papers"])
    assert verdict(one, "all good") == ("PASS", 0.85, [], [])
    assert verdict(one, "it will fail") == ("FAIL", 0.4, [], [])
    assert verdict(one, "pass or fail")[0] == "PASS"


def test_regeneration(one):
    low = outputs.parse_verdict(lit("VERDICT: PASS\nCONFIDENCE: 0.4"))
    assert one(outputs.needs_regeneration(low))
    assert one(outputs.regeneration_feedback(low)) is None
    bad = outputs.parse_verdict(lit("VERDICT: FAIL\nISSUES:\n- wrong gene\nSUGGESTIONS:\n- use the other"))
    feedback = one(outputs.regeneration_feedback(bad)).split("\n")
    assert feedback[2] == "- wrong gene" and feedback[5] == "- use the other"


def test_intent_answers_and_json(one):
    assert one(outputs.normalize_intent(lit(" general "))) == "GENERAL"
    assert one(outputs.normalize_intent(lit("general, scientific"))) == "SCIENTIFIC"
    assert one(outputs.normalize_intent(lit("?"))) == "SCIENTIFIC"
    assert one(outputs.normalize_answer(lit("Well, yes."))) == "Yes"
    assert one(outputs.normalize_answer(lit("Answer: C"), "letter")) == "C"
    assert one(outputs.normalize_answer(lit("(b)"), "letter")) == "B"
    assert one(outputs.normalize_answer(lit("I pick D."), "letter")) == "D"
    assert one(outputs.parse_fenced_json(lit('x ```json\n{"a": 1}\n```'), "a int"))["a"] == 1
    assert one(outputs.parse_fenced_json(lit("nothing"), "a int")) is None


def test_truncation(one):
    body = "aaaa\nbbbbbbb\ncc"
    assert one(trim.truncate_lines(lit(body), 3)) == body
    assert one(trim.truncate_lines(lit(body), 2)) == "aaaa"
    assert one(trim.truncate_lines(lit(body), 0)) == ""
    lines = "\n".join(f"N{i} --[r]--> M{i}" for i in range(60))
    graph = "HEAD\n" + lines + "\nTAIL"
    cut = one(trim.truncate_graph(lit(graph), 100)).split("\n")
    assert cut[:2] == ["HEAD", "TAIL"] and 0 < len(cut) - 2 < 60
    assert one(trim.truncate_graph(lit(graph), 40)) == ""
    assert one(trim.truncate_graph(lit("HEAD"), 40)) == "HEAD"


def test_record_texts(one):
    none = F.lit(None).cast("string")
    article = {"authors": lit("A B"), "title": lit("T"), "journal": lit(""), "year": none, "pmid": lit("1")}
    assert one(render.format_citation(article)) == "A B. T. PMID: 1"
    chunk = render.format_web_chunk(lit("T"), lit(" "), lit("L"), none, lit("snip"))
    assert one(chunk) == "Title: T\nDate: Unknown Date\nLink: L\nContent Type: Google Snippet\nBody: snip\n"
    assert one(render.format_web_chunk(lit("T"), none, lit("L"), none, lit(""))) is None
    table = F.array(F.array(lit("a"), lit("b")), F.array(lit("1")), F.array(lit("2"), lit("3"), lit("4")))
    assert one(render.table_to_markdown(table)) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
