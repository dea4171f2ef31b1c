"""Injected callables get whole texts in batches of a few hundred, however many a task has."""

from pyspark.sql import functions as F

from assay import block_queries
from assay.operators import gate, reports
from assay.plans import shared

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limits(spark, monkeypatch, module):
    seen, write = {}, shared.table
    monkeypatch.setattr(module, "table", lambda df, name: (seen.setdefault(name, int(spark.conf.get(NAME))), write(df, name))[1], raising=False)
    return seen


def test_judge(spark, monkeypatch):
    before, seen = spark.conf.get(NAME), limits(spark, monkeypatch, gate)
    kept = spark.range(1200).select(F.col("id").alias("question_id"), F.lit("c1").alias("claim_id"), F.lit("x").alias("text"))
    assert gate.judge_claims(kept, lambda p, c: "SUPPORTED").filter("label = 'SUPPORTED'").count() == 1200
    assert seen["judgements"] == 500 and spark.conf.get(NAME) == before


def test_arms(spark, monkeypatch):
    before, seen = spark.conf.get(NAME), limits(spark, monkeypatch, reports)
    q = spark.range(1200).select(F.col("id").alias("qid"), F.lit("").alias("question"), F.lit("e").alias("evidence"))
    assert reports.run_arms(q, lambda q, e: "{}", lambda e, c: "", lambda d, i: d).filter("done").count() == 1200
    assert seen["arms"] == 500 and spark.conf.get(NAME) == before


def test_fail_closed(spark, sf, monkeypatch):
    before, seen = spark.conf.get(NAME), limits(spark, monkeypatch, block_queries)
    assert block_queries.va5(spark, sf).count() > 0
    assert seen["checked"] == 500 and spark.conf.get(NAME) == before
