"""Broken invariants end the job and name the row; clean data pass through unchanged."""

import pytest
from pyspark.sql import functions as F

from assay.operators import guards, metrics, prompts, trials, votes
from assay.sources import evidence


def ends(df, *said):
    with pytest.raises(Exception) as e:  # noqa: B017, PT011  (its class depends on how Spark reports a task's error)
        df.collect()
    assert all(s in str(e.value) for s in said)


def test_labels_that_differ(spark):
    sheet = spark.createDataFrame([("u1", "S"), ("u2", "C")], "id string, sheet_human string")
    clean = spark.createDataFrame([("u1", "S"), ("u1", ""), ("u2", None), ("u9", "I")], "id string, human string")
    assert guards.consistent(clean, sheet).count() == 3
    ends(guards.consistent(clean.union(spark.createDataFrame([("u2", "I")], clean.schema)), sheet), "label differs from the sheet: u2")


def test_blank_labels(spark):
    clean = spark.createDataFrame([(1, "S"), (2, "C")], "id int, human string")
    assert guards.labelled(clean, "human", ("S", "C", "I"), "id").count() == 2
    for bad in (None, "", "X"):
        ends(guards.labelled(clean.union(spark.createDataFrame([(7, bad)], clean.schema)), "human", ("S", "C", "I"), "id").groupBy("human").count(), "no valid label: 7")


def test_quota(spark):
    rows = spark.createDataFrame([(f"u{i}", "S" if i % 2 else "C") for i in range(20)], "id string, human string")
    five = trials.sample(rows, "id", "7", "human", 5)
    assert guards.quota(rows, five, "human", ("S", "C"), 5).groupBy("human").count().collect()[0]["count"] == 5
    ends(guards.quota(rows, five, "human", ("S", "C"), 11), "fewer than 11 rows")
    ends(guards.quota(rows, five, "human", ("S", "C", "I"), 5), "fewer than 5 rows: I")


def test_prompts_that_differ_by_more(spark):
    block = F.concat(F.lit("\n\n"), prompts.sibling_lines(F.col("siblings")))
    base = spark.range(3).select("id", F.array(F.struct(F.lit("said").alias("text"), F.lit("1002 문단 1").alias("citation"))).alias("siblings"), F.lit("prompt").alias("a"))
    good = base.withColumn("b", F.concat("a", block))
    assert prompts.checked_pairs(good, "a", "b", "siblings", "id").count() == 3
    ends(prompts.checked_pairs(good.withColumn("b", F.when(F.col("id") == 2, F.concat("b", F.lit("!"))).otherwise(F.col("b"))), "a", "b", "siblings", "id"), "2")


def test_headers(spark):
    rows = [
        (1, "[1002 재고자산 문단 34] one [note] two [1002 재고자산 문단 34A]\n three ", None), (2, "[문단 9] body", "1115 고객과의 계약"), (3, "[ 문단 9 ] body", "none"),
        (4, "no header [note] here", "1115"), (5, None, "1115"), (6, "", None), (7, "lead [문단 1][1109 x 문단 2]", None), (8, "[see 12] [1116 리스 문단 12B] [1] kept [x]", None),
    ]
    df = spark.createDataFrame(rows, "qid int, raw string, own string")
    got = sorted((r["qid"], r["standard"], r["paragraph"], r["body"]) for r in evidence.records(df, "raw", F.col("own")).collect())
    assert got == [
        (1, "1002", "34", "one [note] two"), (1, "1002", "34A", "three"), (2, "1115", "9", "body"), (3, "UNKNOWN", "9", "body"),
        (7, "1109", "2", ""), (7, "UNKNOWN", "1", ""), (8, "1116", "12B", "[1] kept [x]"),
    ]


def test_second_hypothesis(spark):
    def one(rows):
        return trials.second_hypothesis(spark.createDataFrame(rows, "rule string, qid string, changed boolean")).first()["verdict"]

    apart = [("CONJUNCTIVE", f"q{i % 20}", True) for i in range(60)] + [("SELECTION", f"q{i % 20}", i == 0) for i in range(60)]
    assert one(apart) == "ACCEPTED"
    clustered = [("CONJUNCTIVE", "q0" if i < 50 else f"q{i}", i < 50) for i in range(60)] + [("SELECTION", f"q{i}", i < 6) for i in range(60)]
    assert one([*clustered, *[("SELECTION", "q1", False)] * 40]) in ("CLUSTERED", "REJECTED")
    assert one([("OTHER", "q", True)]) == "REJECTED" == one([(r, q, False) for r, q, _ in apart])


def test_versions_and_net_effect(spark):
    units = spark.createDataFrame([("a", "S"), ("b", "C"), ("c", "I")], "id string, human string")
    said = spark.createDataFrame([("a", "x", "S"), ("a", "y", "S"), ("b", "x", "C"), ("b", "z", "I"), ("c", "y", "I"), ("c", "z", "I")], "id string, version string, label string")
    got = {r["id"]: tuple(r)[2:] for r in votes.versions(units, said, "id", "version", "label", {"x": "v1", "y": "v2", "z": "v3"}).collect()}
    assert got == {"a": ("S", "S", "U", "S"), "b": ("C", "U", "I", "U"), "c": ("U", "I", "I", "I")}
    rows = [("C", False, False, True), ("C", False, True, False), ("I", True, False, False), ("S", False, False, True), ("C", False, False, False)]
    r = metrics.net_effect(spark.createDataFrame(rows, "human string, review boolean, all_flagged boolean, yes boolean")).first()
    assert (r["review_off"], r["review_on"], r["caught_off"], r["caught_on"], r["more_review"], r["more_caught"], r["recall_off"], r["recall_on"]) == (1, 3, 2, 3, 2, 1, 0.5, 0.75)
