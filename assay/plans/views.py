"""Deterministic views of the shared tables that stand in for measured data.

Integer arithmetic only, so that Spark and a second engine give the same rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.evidence import addresses as addresses_of
from ..sources.evidence import records as records_of

#: Fixed value: what evidence keeps, one by one: such a class is looked up in a table, ranges are tried in turn.
KEPT = string.ascii_letters + string.digits + " .,"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, qid, doc_id, arm, human (C, I or S) of labelled documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    u = read(spark, sf_dir, "labels").join(docs, "doc_id")
    qid = F.concat(F.lit("Q"), F.lpad((F.col("doc_id") % 60).cast("string"), 3, "0"))
    arm = F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B")
    human = F.when(F.col("toxic") == 1, "C").when(F.col("quality") == 0, "I").otherwise("S")
    return u.select(F.concat_ws("-", qid, arm, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("id"), qid.alias("qid"), "doc_id", arm.alias("arm"), human.alias("human"))


def judge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """units x 12 candidates x 3 runs with a label each."""
    u = units(spark, sf_dir)
    runs = u.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(3))))
    roll = (F.col("doc_id") * 7919 + F.col("run") * 104729 + F.col("k") * 1299709) % 1000
    runs = runs.withColumn("roll", roll)
    label = (
        F.when(F.col("roll") >= 990, "UNRESOLVED")
        .when((F.col("human") != "S") & (F.col("roll") < 500 + 40 * F.col("k")), F.when(F.col("roll") % 2 == 0, "CONTRADICTED").otherwise("INSUFFICIENT"))
        .when((F.col("human") == "S") & (F.col("roll") < 240 + 25 * F.col("k")), "INSUFFICIENT").otherwise("SUPPORTED")
    )
    return runs.select(F.concat(F.lit("c"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("candidate"), "id", "qid", "doc_id", "human", "run", label.alias("label"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate, seq, status: an append-only log of states, from events."""
    status = {"view": "ON_FRONT", "click": "DOMINATED", "signup": "UNJUDGED", "error": "INVALID", "purchase": "PRUNED"}
    mapped = F.lit(None).cast("string")
    for event, state in status.items():
        mapped = F.when(F.col("event_type") == event, state).otherwise(mapped)
    candidate = F.concat(F.lit("c"), F.lpad((F.col("user_id") % 12).cast("string"), 3, "0"))
    return read(spark, sf_dir, "events").select(candidate.alias("candidate"), F.col("event_id").alias("seq"), "ts", mapped.alias("status"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, raw (header and body) and quote of every document."""
    docs = read(spark, sf_dir, "documents")
    clean = lambda x: F.regexp_replace(x, f"[^{KEPT}]", " ")
    head = F.concat(F.lit("["), (1001 + F.col("doc_id") % 9).cast("string"), F.lit(" topic 문단 "), (1 + F.col("doc_id") % 97).cast("string"), F.lit("] "))
    # a quote may stand anywhere in the text; characters are replaced one by one, so it is cut before only its own are
    cut = F.substr("text", F.lit(1) + F.pmod(F.col("doc_id") * 37, F.greatest(F.length("text") - 60, F.lit(1))).cast("int"), F.lit(60))
    quote = F.trim(F.regexp_replace(clean(cut), " +", " "))
    return docs.select(F.col("doc_id").alias("question_id"), F.concat(head, clean("text")).alias("raw"), quote.alias("quote"))


#: The same views as common table expressions.
CTE = {
    "units": """units AS (
  SELECT 'Q' || lpad(CAST(doc_id % 60 AS VARCHAR), 3, '0') || '-' || CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END || '-c' || doc_id AS id,
    'Q' || lpad(CAST(doc_id % 60 AS VARCHAR), 3, '0') AS qid, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm,
    CASE WHEN toxic = 1 THEN 'C' WHEN quality = 0 THEN 'I' ELSE 'S' END AS human
  FROM labels JOIN documents USING (doc_id))""",
    "runs": """rolls AS (
  SELECT *, (doc_id * 7919 + run * 104729 + k * 1299709) % 1000 AS roll
  FROM units, (SELECT unnest(range(12)) AS k), (SELECT unnest(range(1, 4)) AS run)),
runs AS (
  SELECT 'c' || lpad(CAST(k AS VARCHAR), 3, '0') AS candidate, id, qid, doc_id, human, CAST(run AS INTEGER) AS run,
    CASE WHEN roll >= 990 THEN 'UNRESOLVED'
         WHEN human <> 'S' AND roll < 500 + 40 * k THEN CASE WHEN roll % 2 = 0 THEN 'CONTRADICTED' ELSE 'INSUFFICIENT' END
         WHEN human = 'S' AND roll < 240 + 25 * k THEN 'INSUFFICIENT' ELSE 'SUPPORTED' END AS label
  FROM rolls)""",
    "votes": """tally AS (SELECT candidate, id, qid, human, label, count(*) AS n FROM runs GROUP BY ALL),
votes AS (
  SELECT candidate, id, qid, human, CASE WHEN n >= 2 THEN label ELSE 'SPLIT' END AS maj
  FROM (SELECT *, row_number() OVER (PARTITION BY candidate, id ORDER BY n DESC, label) AS rk FROM tally) WHERE rk = 1)""",
    "ledger": """ledger AS (
  SELECT 'c' || lpad(CAST(user_id % 12 AS VARCHAR), 3, '0') AS candidate, event_id AS seq, ts,
    CASE event_type WHEN 'view' THEN 'ON_FRONT' WHEN 'click' THEN 'DOMINATED' WHEN 'signup' THEN 'UNJUDGED' WHEN 'error' THEN 'INVALID' WHEN 'purchase' THEN 'PRUNED' END AS status
  FROM events)""",
    "evidence": r"""evidence AS (
  SELECT doc_id AS question_id, '[' || (1001 + doc_id % 9) || ' topic 문단 ' || (1 + doc_id % 97) || '] ' || body AS raw,
    trim(regexp_replace(substr(body, CAST(1 + (doc_id * 37) % greatest(length(body) - 60, 1) AS BIGINT), 60), ' +', ' ', 'g')) AS quote
  FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g') AS body FROM documents))""",
}

CTE["bundles"] = r"""bundles AS (
  SELECT question_id, CASE WHEN question_id % 5 = 4 THEN '[note] ' || body WHEN question_id % 5 = 3 THEN bare || left(body, length(body) // 2) || ' [note] ' || substr(body, length(body) // 2 + 1)
    ELSE named || left(body, length(body) // 2) || ' [see 9] ' || bare || substr(body, length(body) // 2 + 1) END AS raw, CASE question_id % 5 WHEN 1 THEN '1115 contracts' WHEN 2 THEN 'none' END AS standard
  FROM (SELECT question_id, regexp_replace(raw, '^\[[^\]]*\] ', '') AS body, '[' || (1001 + question_id % 9) || ' topic 문단 ' || (1 + question_id % 97) || 'A]' AS named, '[ 문단 ' || (2 + question_id % 97) || ' ] ' AS bare FROM evidence))"""


def sql(*names: str) -> str:
    """WITH clause of the named expressions, in order."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, standard, paragraph, body of each header in the evidence."""
    return records_of(evidence(spark, sf_dir).select("question_id", "raw"), "raw").drop("content_sha256")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, standard, paragraph of each header in the evidence."""
    return addresses_of(evidence(spark, sf_dir).select("question_id", "raw"), "raw")


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, raw, standard of evidence with two headers, one or both without a standard, brackets in a body, or no header."""
    k, p = F.col("question_id") % 5, 1 + F.col("question_id") % 97
    half = (F.length("body") / 2).cast("int")
    first, second = F.substr("body", F.lit(1), half), F.substr("body", half + 1)
    named = F.concat(F.lit("["), (1001 + F.col("question_id") % 9).cast("string"), F.lit(" topic 문단 "), p.cast("string"), F.lit("A]"))
    bare = F.concat(F.lit("[ 문단 "), (p + 1).cast("string"), F.lit(" ] "))
    e = evidence(spark, sf_dir).withColumn("body", F.regexp_replace("raw", r"^\[[^\]]*\] ", ""))
    raw = F.when(k == 4, F.concat(F.lit("[note] "), "body")).when(k == 3, F.concat(bare, first, F.lit(" [note] "), second)).otherwise(F.concat(named, first, F.lit(" [see 9] "), bare, second))
    standard = F.when(k == 1, "1115 contracts").when(k == 2, "none")
    return e.select("question_id", raw.alias("raw"), standard.alias("standard"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, raw: an answer per document, sound or broken in one of eleven ways."""
    k = F.col("question_id") % 12
    s, p = (1001 + F.col("question_id") % 9).cast("string"), (1 + F.col("question_id") % 97).cast("string")
    quote = F.when(k == 9, "nowhere to be found 0000").otherwise(F.coalesce("quote", F.lit("")))
    address = F.format_string('{"standard": "%s", "paragraph": "%s"}', F.when(k == 1, "9999").otherwise(s), p)
    cited = F.when(k == 2, F.format_string('"%s 문단 %s(77)"', s, p)).when(k == 11, F.lit('"see above"')).otherwise(address)
    claim = F.format_string('{"id": "c1", "text": "a claim", "citations": [%s], "quote": "%s"}', cited, quote)
    listed = F.when(k == 3, F.lit("[]")).when(k == 8, F.lit('"none"')).when(k == 10, F.format_string("[%s, %s]", claim, claim)).otherwise(F.format_string("[%s]", claim))
    whole = F.format_string('{"answer": "an answer", "claims": %s}', listed)
    raw = F.when(k == 4, F.expr("left(w, length(w) - 9)")).when(k == 5, F.regexp_replace("w", r"\}$", ",}")).when(k == 6, F.concat(F.lit("["), "w", F.lit("]"))).when(k == 7, "").otherwise(F.col("w"))
    return evidence(spark, sf_dir).withColumn("w", whole).select("question_id", raw.alias("raw"))


CTE["found"] = r"""q AS (SELECT question_id, question_id % 12 AS k, trim(regexp_replace(coalesce(quote, ''), '[\s]+', ' ', 'g')) AS quote,
    trim(regexp_replace(regexp_replace(raw, '^\[[^\]]*\] ', ''), '[\s]+', ' ', 'g')) AS body, raw IS NOT NULL AS there FROM evidence),
q2 AS (SELECT *, there AND quote <> '' AND contains(body, quote) AND k <> 9 AS quoted FROM q),
found AS (SELECT question_id, unnest(CASE
    WHEN k IN (0, 9, 10) THEN list_concat(CASE WHEN there THEN [] ELSE ['source_id_not_found'] END, CASE WHEN quoted THEN [] ELSE ['quote_not_in_source'] END, CASE WHEN k = 10 THEN ['claim_id_duplicate'] ELSE [] END)
    WHEN k = 1 THEN ['source_id_not_found', 'quote_not_in_source']
    WHEN k = 2 AND NOT there THEN ['source_id_not_found', 'quote_not_in_source']
    WHEN k = 2 AND NOT contains(body, '77') THEN ['subitem_not_found', 'quote_not_in_source']
    WHEN k = 2 THEN CASE WHEN quoted THEN [] ELSE ['quote_not_in_source'] END
    WHEN k = 3 THEN ['claims_missing'] WHEN k IN (4, 5, 6) THEN ['schema_invalid'] WHEN k = 7 THEN ['empty_output']
    WHEN k = 8 THEN ['schema_invalid', 'claims_missing'] ELSE ['citation_missing', 'citation_missing'] END) AS reason FROM q2)"""
