import pytest
from pyspark.sql import functions as F

from assay.functions import text
from assay.operators import pareto, stats, votes


def test_lcg_draws_are_the_recorded_ones(spark):
    # fixed values: the first draws of the seed for 55 units
    want = [21, 35, 45, 0, 42, 50, 23, 29, 32, 52, 37, 10, 31, 5, 21, 14, 29, 30, 18, 11]
    got = [r["pos"] for r in stats.draws(spark, 55, 1).collect()][:20]
    assert got == want


def test_wilson_and_mcnemar(spark):
    r = spark.range(1).select(
        stats.wilson(F.lit(9), F.lit(10)).alias("w"), stats.wilson(F.lit(0), F.lit(0)).alias("e"),
        *[stats.mcnemar(F.lit(a), F.lit(b)).alias(f"p{a}{b}") for a, b in ((0, 4), (0, 6), (1, 1), (0, 0))],
    ).first()
    assert round(r["w"]["lo"], 4) == 0.5958 and round(r["w"]["hi"], 4) == 0.9821
    assert (r["e"]["lo"], r["e"]["hi"]) == (0.0, 1.0)
    assert [round(r[p], 6) for p in ("p04", "p06", "p11", "p00")] == [0.125, 0.03125, 1.0, 1.0]


def front_of(spark, rows):
    return spark.createDataFrame(rows, "candidate string, generation int, origin string, n_flagged int, recall double, precision double, recall_lo double, recall_hi double, precision_lo double, precision_hi double")


def test_pruning_of_ties_takes_the_fewest_flagged(spark):
    members = front_of(spark, [(f"c{i:03}", 0, "front_pair", i, 0.5, 0.5, 0.2, 0.8, 0.2, 0.8) for i in range(12)])
    pruned = {r["candidate"] for r in pareto.prune(members).filter("pruned").collect()}
    assert pruned == {"c001", "c002", "c003", "c004"}


def test_pruning_of_trade_offs_takes_the_latest(spark):
    members = front_of(spark, [(f"c{i:03}", i, "front_pair", 5, i / 12, 1 - i / 12, i / 12, i / 12, 1 - i / 12, 1 - i / 12) for i in range(12)])
    pruned = {r["candidate"] for r in pareto.prune(members).filter("pruned").collect()}
    assert pruned == {"c010", "c009", "c008", "c007"}


def test_filter_strip_halts(spark):
    members = front_of(spark, [(f"c{i:03}", i, "filter_strip", 5, 0.5, 0.5, 0.2, 0.8, 0.2, 0.8) for i in range(12)])
    assert pareto.prune(members).filter("pruned").count() == 0
    assert pareto.prune(members).filter("halted").count() == 12


def test_majority_splits_and_breaks_ties_by_label(spark):
    rows = spark.createDataFrame([("a", x) for x in ("S", "C", "I")] + [("b", x) for x in ("S", "S", "C", "C")], "id string, label string")
    assert dict(votes.majority(rows, ["id"]).collect()) == {"a": "SPLIT", "b": "C"}


def test_text_functions(spark):
    r = spark.range(1).select(
        text.collapse(F.lit(" a 　\x1cb ")).alias("c"), text.citation(F.lit("기준 1002 문단 34(2)")).alias("f"), text.citation(F.lit("none")).alias("n"),
        text.unfence(F.lit('```json\n{"a": 1}\n```')).alias("u"), text.contains_quote(F.lit("a  b"), F.lit("a b")).alias("q"), text.contains_quote(F.lit("a"), F.lit("")).alias("e"),
    ).first()
    assert r["c"] == "a b" and r["u"] == '{"a": 1}' and r["q"] and not r["e"] and r["n"] is None
    assert (r["f"]["standard"], r["f"]["paragraph"], r["f"]["subitem"]) == ("1002", "34", "2")


@pytest.mark.parametrize(("said", "want"), [
    ("1002 문단 34-(2)", ("1002", "34", "2")), ("[1002 재고자산 문단 34A]", ("1002", "34A", None)), ("K-IFRS 1116 문단 9(1)", ("1116", "9", "1")),
    ("1002 문단 34 – (가)", ("1002", "34", "가")), ("1002 문단 34-35", ("1002", "34", None)), ("no citation", None),
])
def test_citation_forms(spark, said, want):
    c = spark.range(1).select(text.citation(F.lit(said)).alias("c")).first()["c"]
    assert (tuple(c) if c else None) == want
