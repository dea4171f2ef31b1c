"""Evidence is read for what is asked: no body is cut for addresses, no pattern goes over bodies for their ends."""

import re

from pyspark.sql import functions as F

from assay import gate_queries
from assay.functions import text
from assay.operators import gate
from assay.plans import views
from assay.sources import evidence

RAW = ["[1002 a 문단 3] one [note] two　\n [문단 4A]\tthree", "[x [1003 b 문단 5(2)] y [ 문단 6 ]", "no header", None, "[문단 7]"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_those_of_records(spark):
    rows = spark.createDataFrame([(i, x, f"IFRS {1100 + i}") for i, x in enumerate(RAW)], "id int, raw string, standard_of string")
    for default in (None, F.col("standard_of")):
        whole = evidence.records(rows, "raw", default).select("id", "standard_of", "standard", "paragraph")
        got = evidence.addresses(rows, "raw", default)
        assert got.columns == whole.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) != []


def test_the_locator_cuts_no_bodies(spark, sf):
    assert "split(" not in plan(gate_queries.jn4(spark, sf))


def test_ends_of_bodies_are_trimmed_without_a_pattern(spark, sf):
    held = plan(views.records(spark, sf).select("body"))
    assert "regexp_replace(_r" not in held and "trim(_r" in held


def test_the_characters_trimmed_are_those_of_the_pattern(spark):
    code = spark.range(0x110000).filter("id not between 55296 and 57343")
    c = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")  # a byte order mark first: U+FEFF is a character too
    x = code.select(c.alias("c")).select(F.explode(F.array("c", F.concat("c", F.lit(" a b"), "c", F.lit("\r\n"), "c"))).alias("x"))
    by_pattern = F.regexp_replace("x", f"^(?:{text.SPACE})|(?:{text.SPACE})$", "")
    assert x.filter(~text.strip(F.col("x")).eqNullSafe(by_pattern)).count() == 0
    assert x.filter(text.strip(F.col("x")) == "").count() == len(text.BLANKS)


def test_evidence_is_cleaned_as_by_a_class(spark, sf, tmp_path):
    texts = ["", "plain text, 1.", "é", "a\nb\r\n\U0001f600c", "\n", "tail é", "é é ", "$1 \\ [x]", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for at in (sf, str(tmp_path)):
        e = views.evidence(spark, at).select("question_id", F.regexp_replace("raw", r"^\[[^\]]*\] ", "").alias("body"))
        d = views.read(spark, at, "documents").select(F.col("doc_id").alias("question_id"), F.regexp_replace("text", "[^A-Za-z0-9 .,]", " ").alias("want"))
        m = e.join(d, "question_id")
        assert m.count() == d.count() and m.filter("not body <=> want").count() == 0


def test_what_evidence_keeps_is_looked_up(spark, sf):
    assert sorted(views.KEPT) == [c for c in map(chr, range(0x110000)) if re.fullmatch("[A-Za-z0-9 .,]", c)]
    assert "A-Z" not in plan(views.evidence(spark, sf))


def test_a_body_is_collapsed_once_for_a_subitem(spark):
    df = spark.createDataFrame([("an (  2 ) b", "(2"), ("an ( 2 ) b", " 2 "), ("(가)", "가"), (None, "1"), ("x", None)], "body string, sub string")
    got = df.select(text.has_subitem(F.col("body"), F.col("sub")).alias("has"))
    assert plan(got).count("regexp_replace(coalesce(body") == 1
    assert [r["has"] for r in got.collect()] == [False, True, True, False, True]


def test_quotes_are_found_as_in_collapsed_bodies(spark):
    bodies = ["a  b", "a b", "a\u3000\n b", " xa b", "ab", "", None]
    df = spark.createDataFrame([(b, q) for b in bodies for q in ("a b", " a\tb ", "b", " ", "", None)], "body string, quote string")
    q = text.collapse(F.col("quote"))
    got = df.select(text.contains_quote(F.col("body"), F.col("quote")).alias("got"), ((q != "") & F.contains(text.collapse(F.col("body")), q)).alias("want"))
    assert got.filter("not got <=> want").count() == 0 and 0 < got.filter("got").count() < got.count()


def test_sums_of_citations_search_no_body(spark, sf):
    c = gate.claims(gate.parse(views.answers(spark, sf)))
    sums = [x for x in plan(gate.citation_reasons(c, views.records(spark, sf))).splitlines() if "Aggregate [" in x]
    assert sums and not any("regexp_replace" in x for x in sums)
