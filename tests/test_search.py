"""Quotes in a corpus and words of a dictionary against plain search."""

import random

import pytest

from assay.operators import search

SCHEMA = "scope string, text string"


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    shared = "".join(rnd.choice("abcd") for _ in range(60))
    docs = []
    for i in range(80):
        body = "".join(rnd.choice("abcdé") for _ in range(rnd.choice([0, 3, 15, 16, 40, 300])))
        docs.append((rnd.choice("XYZ"), body + shared * (i % 2) + body[:5]))
    return [*docs, ("X", None), (None, shared), ("Y", ""), ("X", "ab\U0001f600cd" * 9)], shared


def test_found_equals_plain_search(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "TOGETHER", 3)
    monkeypatch.setattr(search, "PATTERNS", 4)
    rnd, (docs, shared) = random.Random(6), corpus
    quotes = [("X", ""), ("W", ""), ("W", shared), (None, "ab"), ("X", None), ("X", shared), ("Y", shared[3:40]), ("X", "\U0001f600cdab\U0001f600cdab\U0001f600")]
    for _ in range(150):
        body = rnd.choice(docs)[1] or "x"
        a = rnd.randrange(len(body) + 1)
        one = body[a : a + rnd.choice([1, 2, 8, 15, 16, 17, 30, 60])]
        quotes.append((rnd.choice("XYZ"), one if rnd.random() < 0.6 else one[::-1] + rnd.choice(["", "e", "a"])))
    got = {(r["scope"], r["text"]): r["found"] for r in search.found(spark.createDataFrame(quotes + quotes[:9], SCHEMA).repartition(3), spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()}
    assert got == {(s, q): any(s == t and b is not None and q in b for t, b in docs) for s, q in quotes if s is not None and q is not None}
    assert {True, False} == set(got.values())
    assert search.found(spark.createDataFrame([], SCHEMA), spark.createDataFrame(docs, SCHEMA)).count() == 0
    assert {r["found"] for r in search.found(spark.createDataFrame(quotes, SCHEMA), spark.createDataFrame([], SCHEMA)).collect()} == {False}


def test_quoted_keeps_rows_and_ignores_space(spark):
    rows = spark.createDataFrame([(1, "7", "a b　c d e f g h i j k l m n o p"), (2, "7", "zz"), (3, None, "a"), (4, "7", None), (1, "7", "a b　c d e f g h i j k l m n o p")], "k int, scope string, text string")
    held = spark.createDataFrame([("7", "x abcdefg hijkl\nmnop y")], SCHEMA)
    got = sorted((r["k"], r["quoted"]) for r in search.quoted(rows, "scope", "text", held, "text").collect())
    assert got == [(1, True), (1, True), (2, False), (3, None), (4, None)]


def test_dictionary_equals_str_count(spark, monkeypatch):
    monkeypatch.setattr(search, "PATTERNS", 7)
    rnd = random.Random(8)
    docs = [(i, None if i == 3 else "".join(rnd.choice("ab\né") for _ in range(rnd.choice([0, 1, 30, 200])))) for i in range(40)]
    words = ["", "a", "aa", "aba", "ab", "b\na", "é", "zz", "aaa", *["".join(rnd.choice("abé") for _ in range(3)) for _ in range(15)], None, "a"]
    df, patterns = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(w,) for w in words], "pattern string")
    got = sorted(map(tuple, search.dictionary(df, "doc_id", "text", patterns).collect()))
    assert got == sorted((i, w, t.count(w), 1 + t[: t.index(w)].count("\n")) for i, t in docs if t for w in set(words) if w and w in t)
    assert search.dictionary(df, "doc_id", "text", patterns.filter("false")).count() == 0


def test_many_patterns(spark):
    """100,000 patterns in one pass: as many plan nodes as for one."""
    docs = spark.range(50).selectExpr("id as doc_id", "concat('w', id * 7, ' w', id * 11, ' w', id * 7, '.') as text")
    patterns = spark.range(100_000).selectExpr("concat('w', id, ' ') as pattern")
    got = {(r["doc_id"], r["pattern"]): r["n"] for r in search.dictionary(docs, "doc_id", "text", patterns).collect()}
    want = {}
    for i in range(50):
        for w in (f"w{i * 7} ", f"w{i * 11} "):
            want[i, w] = f"w{i * 7} w{i * 11} w{i * 7}.".count(w)
    assert got == want
