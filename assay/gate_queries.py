"""Queries of the gate, its inputs and its judges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gate
from .plans import views
from .plans.views import sql
from .queries import query

FOUND = sql("evidence", "found")
DECIDED = "CASE WHEN bool_or(f.reason NOT LIKE 'semantic_c%' AND f.reason NOT LIKE 'semantic_i%') THEN 'INDETERMINATE' WHEN count(f.reason) > 0 THEN 'FLAGGED' ELSE 'VERIFIED' END AS verdict"


@query("JS1_payload_kinds", "SELECT doc_id AS question_id, CASE WHEN doc_id % 12 = 7 THEN 'empty_output' WHEN doc_id % 12 IN (4, 5, 6) THEN 'schema_invalid' ELSE 'object' END AS kind FROM documents")
def js1(s: SparkSession, d: str) -> DataFrame:
    parsed = gate.parse(views.answers(s, d))
    return parsed.select("question_id", F.when(F.col("ok"), "object").otherwise(F.col("reasons")[0]).alias("kind"))


@query("VA1_schema_findings", "SELECT question_id, reason, count(*) AS n FROM (SELECT doc_id AS question_id, unnest(CASE doc_id % 12 WHEN 3 THEN ['claims_missing'] WHEN 4 THEN ['schema_invalid'] WHEN 5 THEN ['schema_invalid'] WHEN 6 THEN ['schema_invalid'] WHEN 7 THEN ['empty_output'] WHEN 8 THEN ['schema_invalid', 'claims_missing'] ELSE [] END) AS reason FROM documents) GROUP BY ALL")
def va1(s: SparkSession, d: str) -> DataFrame:
    return gate.parse(views.answers(s, d)).select("question_id", F.explode("reasons").alias("reason")).groupBy("question_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("VA2_claims", "SELECT doc_id AS question_id, i AS idx, i = 0 AS kept, CASE WHEN doc_id % 12 = 11 THEN 'citation_missing,citation_missing' WHEN i = 1 THEN 'claim_id_duplicate' ELSE '' END AS reasons FROM documents, (SELECT CAST(unnest(range(2)) AS INTEGER) AS i) WHERE doc_id % 12 IN (0, 1, 2, 9, 10, 11) AND (i = 0 OR doc_id % 12 = 10)")
def va2(s: SparkSession, d: str) -> DataFrame:
    c = gate.claims(gate.parse(views.answers(s, d)))
    return c.select("question_id", "idx", "kept", F.array_join("reasons", ",").alias("reasons"))


@query("VA3_findings", FOUND + "SELECT question_id, reason, count(*) AS n FROM found GROUP BY ALL")
def va3(s: SparkSession, d: str) -> DataFrame:
    return gate.findings(views.answers(s, d), views.records(s, d)).groupBy("question_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("VA4_verdicts", FOUND + f"SELECT q.question_id, {DECIDED} FROM q LEFT JOIN found f USING (question_id) GROUP BY q.question_id")
def va4(s: SparkSession, d: str) -> DataFrame:
    return gate.evaluate(views.answers(s, d), views.records(s, d), None)


@query("VA6_evaluate", FOUND.rstrip() + f""", f AS (SELECT * FROM found UNION ALL
  SELECT question_id, CASE question_id % 5 WHEN 0 THEN 'semantic_contradicted' WHEN 1 THEN 'semantic_insufficient' ELSE 'semantic_unresolved' END FROM q
  WHERE question_id % 5 <> 4 AND question_id NOT IN (SELECT question_id FROM found))
SELECT q.question_id, {DECIDED} FROM q LEFT JOIN f USING (question_id) GROUP BY q.question_id""")
def va6(s: SparkSession, d: str) -> DataFrame:
    answers = views.answers(s, d)
    k = F.col("question_id") % 5
    label = F.when(k == 0, "CONTRADICTED").when(k == 1, "INSUFFICIENT").when(k == 2, "UNRESOLVED").when(k == 4, "SUPPORTED")
    judgements = answers.select("question_id", F.lit("c1").alias("claim_id"), label.alias("label")).filter("label is not null")
    return gate.evaluate(answers, views.records(s, d), judgements)


@query("JN4_locator_evidence", FOUND + "SELECT question_id, k <> 1 AND there AS found FROM q WHERE k IN (0, 1, 2, 9, 10)")
def jn4(s: SparkSession, d: str) -> DataFrame:
    c = gate.claims(gate.parse(views.answers(s, d))).filter("kept").select("question_id", F.explode("locators").alias("at"))
    e = views.addresses(s, d).withColumnRenamed("question_id", "q")
    m = c.join(e, (F.col("question_id") == F.col("q")) & (F.col("at.standard") == F.col("standard")) & (F.col("at.paragraph") == F.col("paragraph")), "left")
    return m.select("question_id", F.col("q").isNotNull().alias("found"))
