"""Control answers through the gate."""

import json

import pytest
from pyspark.sql import functions as F

from assay.operators import gate, pareto

BODY = "An entity shall (1) recognise cost. (2) Twelve months or less."
GOOD = {"id": "c1", "text": "a claim", "citations": [{"standard": "1002", "paragraph": "34"}], "quote": "Twelve months"}


def answer(*claims, said="an answer"):
    return json.dumps({"answer": said, "claims": list(claims)})


CASES = {
    "sound": (answer(GOOD), []),
    "fenced": ("```json\n" + answer(GOOD) + "\n```", []),
    "text citation": (answer(GOOD | {"citations": ["1002 문단 34(2)"]}), []),
    "one citation, other keys": (answer({"claim_id": "x", "statement": "s", "citation": "1002 문단 34", "quote": "recognise cost"}), []),
    "numbers for text": (answer(GOOD | {"citations": [{"standard": 1002, "paragraph": 34}]}), []),
    "sub-item in the paragraph": (answer(GOOD | {"citations": [{"standard": "1002", "paragraph": "34(2)"}]}), []),
    "sub-item after a dash": (answer(GOOD | {"citations": ["1002 문단 34-(2)"]}), []),
    "range of paragraphs": (answer(GOOD | {"citations": ["1002 문단 34-35"]}), []),
    "no such sub-item after a dash": (answer(GOOD | {"citations": ["1002 문단 34 – (가)"]}), ["quote_not_in_source", "subitem_not_found"]),
    "more than a sub-item": (answer(GOOD | {"citations": [{"standard": "1002", "paragraph": "34(2) x"}]}), ["quote_not_in_source", "source_id_not_found"]),
    "other standard": (answer(GOOD | {"citations": [{"standard": "1038", "paragraph": "34"}]}), ["quote_not_in_source", "source_id_not_found"]),
    "no such sub-item": (answer(GOOD | {"citations": ["1002 문단 34(7)"]}), ["quote_not_in_source", "subitem_not_found"]),
    "half evidence": (answer(GOOD, GOOD | {"id": "c2", "quote": "never said"}), ["quote_not_in_source"]),
    "no claims": (answer(), ["claims_missing"]),
    "nothing": (answer(said=" "), ["empty_output"]),
    "no quote": (answer(GOOD | {"quote": None}), ["quote_not_in_source"]),
    "five citations": (answer(GOOD | {"citations": ["1002 문단 34"] * 5}), ["limit_exceeded"]),
    "no citation": (answer(GOOD | {"citations": []}), ["citation_missing"]),
    "unread citation": (answer(GOOD | {"citations": ["see above"]}), ["citation_missing"] * 2),
    "same id": (answer(GOOD, GOOD), ["claim_id_duplicate"]),
    "ids of place": (answer({**GOOD, "id": ""}, {**GOOD, "id": None}), []),
    "no text": (answer(GOOD | {"text": ""}), ["schema_invalid"]),
    "claim is text": (answer("c"), ["schema_invalid"]),
    "claims are text": (json.dumps({"answer": "a", "claims": "none"}), ["claims_missing", "schema_invalid"]),
    "odd quote": (answer(GOOD | {"quote": 7}), ["quote_not_in_source", "schema_invalid"]),
    "too many claims": (answer(*[GOOD | {"id": f"c{i}"} for i in range(33)]), ["limit_exceeded"]),
    "cut": (answer(GOOD)[:-5], ["schema_invalid"]),
    "trailing comma": (answer(GOOD)[:-1] + ",}", ["schema_invalid"]),
    "list": ("[1]", ["schema_invalid"]),
    "more after it": (answer(GOOD) + " {}", ["schema_invalid"]),
    "blank": ("  ", ["empty_output"]),
    "null": (None, ["empty_output"]),
}


@pytest.fixture(scope="module")
def tables(spark):
    answers = spark.createDataFrame([(k, v[0], "more") for k, v in CASES.items()], "question_id string, raw string, extra string")
    evidence = spark.createDataFrame([(k, "1002", "34", BODY) for k in CASES], "question_id string, standard string, paragraph string, body string")
    return answers, evidence


def test_findings_of_controls(tables):
    got = {k: [] for k in CASES}
    for r in gate.findings(*tables).collect():
        got[r["question_id"]].append(r["reason"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v[1]) for k, v in CASES.items()}


def test_judgements_decide_what_is_left(spark, tables):
    rows = [("sound", "c1", "CONTRADICTED"), ("fenced", "c1", "SUPPORTED"), ("text citation", "c1", "odd"), ("no claims", "c1", "SUPPORTED")]
    got = dict(gate.evaluate(*tables, spark.createDataFrame(rows, "question_id string, claim_id string, label string")).collect())
    assert got["sound"] == "FLAGGED" and got["fenced"] == "VERIFIED"
    assert got["text citation"] == got["no claims"] == got["numbers for text"] == "INDETERMINATE"
    assert len(got) == len(CASES)


def test_no_rows(tables):
    answers, evidence = tables
    assert gate.evaluate(answers.limit(0), evidence.limit(0), None).count() == 0


def test_termination_and_admission(spark):
    cols = "candidate string, recall double, precision double, recall_lo double, recall_hi double, precision_lo double, precision_hi double"
    pool = spark.createDataFrame([("c000", .5, .5, .4, .6, .4, .6), ("c001", .5, .5, .4, .6, .4, .6), ("c002", .9, .1, .8, 1., 0., .2)], cols)
    current = spark.createDataFrame([(0, 900, True), (1, 800, False), (1, None, False)], "generation int, calls long, judgeable boolean")
    assert tuple(pareto.termination(pool, current, stall=3).first()) == ("T1,T2,T3,T4", True, 1700, 1)
    assert pareto.termination(pool.filter("candidate <> 'c001'"), current.limit(1)).first()["triggered"] == ""
    known = pool.selectExpr("*", "concat('h', candidate) as prompt_sha256")
    new = spark.createDataFrame([
        ("c000", "r", "m", "x", True, .5), ("n1", " ", "m", "x", True, .5), ("n2", "r", "other", "x", True, .5), ("n3", "r", "m", "hc001", True, .5),
        ("n4", "r", "m", None, True, .5), ("n5", "r", "m", "x", False, .5), ("n6", "r", "m", "x", True, .1), ("n7", "r", "m", "x", True, .5),
    ], "candidate string, origin_reason string, model string, prompt_sha256 string, gate_passed boolean, recall double")
    new = new.selectExpr("*", "recall as precision", *[f"{b} as {a}_{c}" for a in ("recall", "precision") for b, c in (("recall", "lo"), ("recall", "hi"))])
    got = {r["candidate"]: (r["status"], r["code"]) for r in pareto.admit(new, known, "m").collect()}
    assert got == {"c000": (None, 2), "n1": (None, 2), "n2": ("INVALID", 3), "n3": ("INVALID", 3), "n4": ("INVALID", 3), "n5": ("UNJUDGED", 3), "n6": ("DOMINATED", 0), "n7": ("ON_FRONT", 0)}


PLAIN = {
    '{"answer": "a", "claims": []}': True, '{"answer": "a", "claims": [{"id": "", "text": "t", "citations": ["1002 문단 3", "{odd"], "quote": "q\\n\\u00e9\\ud83d"}]}': False,
    '{"answer": "", "claims": [{"text": "t"}]}': True, ' {"claims": [{"id": "c1", "text": "", "citations": [{"standard": "1002", "paragraph": "34(2)"}]}], "answer": "x"}\n': True,
    '{"answer": "a", "claims": [{"id": "c1", "text": "t", "citations": ["1002 문단 3", "x"]}, {"text": "\\u00e9 \\"q\\" \\\\", "quote": ""}]}': True,
    '{"answer": "a", "claims": [{"id": "c", "text": "t", "citations": [{"standard": "1002", "paragraph": "3", "subitem": "가"}, {"standard": "9", "paragraph": ""}]}]}': True,
    '{"answer": "a", "claims": [{"id": "c1", "id": "c2", "text": "t"}]}': False, '{"answer": "a", "claims": []} trailing': False, '{"answer": "a", "claims": []}, null': False,
    '{"answer": "a", "claims": [{"id": 7, "text": "t"}]}': False, '{"answer": "a", "claims": null}': False, '{"answer": NaN, "claims": []}': False, "{'answer': 'a', 'claims': []}": False,
    '{"answer": "a", "claims": [{"text": null}]}': False, '{"answer": "a", "claims": ["x"]}': False, '{"answer": "a", "claims": [{"text": "t", "citations": ["a", {"standard": "1"}]}]}': False,
    '{"answer": "a", "claims": [], "more": 1}': False, '{"answer": "a\nb", "claims": []}': False, '[{"answer": "a", "claims": []}]': False, "": False, '{"answer": "a", "claims": [{"text": "t", "citations": []}]}': True,
}


def test_both_readers_agree(spark):
    """What is read natively is what the exact reader gives."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PLAIN)], "question_id int, raw string")
    seen = {r["raw"]: r["p"] for r in df.select("raw", gate.is_plain(F.col("raw")).alias("p")).collect()}
    assert seen == PLAIN
    plain = df.filter(gate.is_plain(F.col("raw")))
    native = {r["question_id"]: r["p"].asDict(True) for r in plain.select("question_id", gate._natively(F.col("raw")).alias("p")).collect()}
    exact = {r["question_id"]: r["p"].asDict(True) for r in plain.select("question_id", F.pandas_udf(gate._payload, gate.PAYLOAD)("raw").alias("p")).collect()}
    assert native == exact and len(native) == sum(PLAIN.values())
