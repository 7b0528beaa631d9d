"""Language, toxicity and URL models: held-out accuracy and corner cases."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkevidence.llm import langid, toxicity, urlfilter
from sparkevidence.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def frame(sql):
    return duckdb.sql(sql).df()


def test_language_of_held_out_documents(spark):
    got = QUERIES["op4_language"](spark, SF_DIR).toPandas()
    known = frame(f"select doc_id, lang from '{SF_DIR}/documents.parquet'")
    both = got.merge(known, on="doc_id")
    assert len(got) == len(known) and got.score.between(0, 1).all()
    held_out = both[both.held_out]
    assert len(held_out) > 100 and (held_out.lang_pred == held_out.lang).mean() > 0.98


def test_language_corner_cases(spark, no_documents):
    rows = [
        (1, "alpha beta gamma", "x"), (2, "alpha gamma beta", "x"), (3, "ßüö ßüö", "y"),
        (4, None, "x"), (5, "", "y"), (6, "12 .. !", None), (7, "αβγ", None), (None, "alpha", "x"),
        (8, "beta " * 50_000, None), (8, "beta", None), (11, "zzz", None),
    ]
    docs = spark.createDataFrame([(*r, "l", 0.5) for r in rows], "doc_id long, text string, lang string, gram string, score double")
    profiles = langid.fit_profiles(docs)
    found = langid.identify(docs.drop("score"), profiles, keep=("doc_id", "gram")).collect()
    assert len(found) == len(rows)
    label = {r.doc_id: r.lang_pred for r in found}
    assert label[1] == label[2] == label[8] == label[None] == "x" and label[3] == "y"
    assert label[4] == label[5] == label[6] == "und"
    kept = langid.keep_identified(docs.withColumn("doc_id", F.col("doc_id")))
    assert kept.columns == docs.columns
    assert not {4, 5, 6} & {r.doc_id for r in kept.collect()}
    assert langid.learn_and_identify(no_documents).count() == 0
    assert langid.fit_profiles(docs.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_gram_distance_is_out_of_place():
    fr = langid.gram_codes("ab")
    value, n = langid.counted(fr)
    profile = value[(-n).argsort(kind="stable")]
    model = langid.Profiles({"l": profile}, len(profile))
    assert model.nearest("ab") == ("l", 1.0, 0.0)
    assert model.nearest("qq")[2] == 1.0
    assert sorted(langid.gram_codes("a,b")) == sorted([*langid.gram_codes("a"), *langid.gram_codes("b")])


def test_toxicity_of_held_out_documents(spark):
    got = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    known = frame("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'")
    assert got.score.between(0, 1).all() and len(got) == 10_000
    both = got.merge(known, on="doc_id")
    held_out = both[both.held_out]
    good, bad = held_out[held_out.toxic == 0], held_out[held_out.toxic == 1]
    assert (good.predicted == 0).mean() > 0.98 and (bad.predicted == 1).mean() > 0.85
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_toxicity_corner_cases(spark, no_documents):
    rows = [(1, None), (2, ""), (2, ""), (None, "you idiot"), (3, "fine " * 30_000), (4, "nice")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(2, 0), (4, 0), (2, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.0}
    assert toxicity.score_toxicity(docs, labels.where("false")).count() == 6
    assert toxicity.score_toxicity(no_documents, labels).count() == 0


def test_toxicity_features():
    of = toxicity.Features({"^achli": 4.0, "blob": 2.0})
    value = dict(zip(toxicity.FEATURES, of.of("You are an 1D10T!! achliches blob")))
    assert value["strong_count"] == 1 and value["near_second_person"] == 1
    assert value["masked_count"] == 1 and value["shouted_rate"] > 0
    assert all(math.isfinite(x) for x in of.of(""))


def test_url_parts_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/x?q#f", "https://net", "http://net/", "http://x.net/a", "http://org/fr/",
        "http://notorg/fr/", "http://example.com/de/1", "http://example.com/deu", "no scheme", None, "",
        "http://h?x://y", "http://h#/p", "http://example.net/en/", "HTTP://u@net:80/",
    ]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x"), (None, urls[3], "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = urlfilter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule) for r in got}
    assert by[0] == ("a.example.net", "/en/x", "example.net/en/") and by[1] == ("net", "", None)
    assert by[2] == ("net", "/", "net/") and by[3] == ("x.net", "/a", "net/")
    assert by[4] == ("org", "/fr/", "org/fr/") and by[5][2] is None
    assert by[6][2] == "example.com/de/" and by[7][2] is None
    assert by[8] == by[9] == by[10] == ("", "", None)
    assert by[11] == ("h", "", None) and by[12] == ("h", "", None) and by[14] == ("u@net:80", "/", None)
    assert urlfilter.filter_urls(pages.where("false")).count() == 0


def test_url_model_tells_kinds_apart(spark):
    rnd = random.Random(1)
    word = lambda a: "".join(rnd.choice(a) for _ in range(12))
    urls = [f"http://s{i}.org/fr/{word('abcde')}" for i in range(200)]
    urls += [f"http://s{i}.net/{word('vwxyz')}" for i in range(200)]
    urls += [f"http://s{i}.info/{word('abcde' if i % 2 else 'vwxyz')}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.filter_urls(pages).collect()}
    assert all(got[i].verdict == "allow" and got[i].rule for i in range(200))
    assert all(got[i].verdict == "block" for i in range(200, 400))
    right = [got[400 + i].verdict == ("allow" if i % 2 else "block") for i in range(60)]
    assert sum(right) >= 55


@pytest.mark.parametrize("name", ["op7_url_filter"])
def test_native_plan(spark, name, capsys):
    QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
