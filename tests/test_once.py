"""What makes long texts runs once: it is written before columns of it are filtered, met or grouped."""

from pyspark.sql import functions as F

from assay.operators import search, trials
from assay.plans import views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_quote_is_cut_before_it_is_cleaned(spark, sf):
    assert "regexp_replace(text" not in plan(views.evidence(spark, sf).select("quote"))


def test_a_corpus_is_made_once(spark, monkeypatch):
    seen, write = {}, search.table
    monkeypatch.setattr(search, "table", lambda df, name: (seen.setdefault(name, plan(df)), write(df, name))[1])
    rows = spark.createDataFrame([("7", "abcd")], "scope string, quote string")
    corpus = spark.createDataFrame([("7", "a b", "cd"), ("7", None, "x")], "scope string, a string, b string").select("scope", F.concat("a", F.lit("MARK"), "b").alias("body"))
    got = search.quoted(rows, "scope", "quote", corpus, "body")
    assert [r["quoted"] for r in got.collect()] == [False]
    assert max(p.count("MARK") for p in seen.values()) == 1


def test_evidence_is_no_key_of_faults(spark):
    q = spark.createDataFrame([(1, "normal", "what?", "[1002 a] some words", [("1002", "some words")]), (2, "normal", "", "other", [("1002", "some words")])], "qid long, layer string, question string, evidence string, citations array<struct<standard: string, quote: string>>")
    got = trials.question_faults(q, spark.createDataFrame([("1002", "some  words here")], "standard string, body string"))
    assert sorted(map(tuple, got.collect())) == [(2, "quote_not_in_evidence")]
    assert "evidence#" not in plan(got)
