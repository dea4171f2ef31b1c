"""Answers are parsed once: filters on what was parsed read it from a table."""

from pyspark.sql import functions as F

from assay.operators import gate
from assay.plans import views


def test_parsed_answers_are_stored(spark, sf):
    parsed = gate.parse(views.answers(spark, sf)).filter("go").select(F.explode("reasons"))
    held = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in held and "from_json" not in held and "parse_json" not in held


def test_the_json_of_an_answer_is_parsed_once(spark, sf, monkeypatch):
    """Of the bracketed text the kind and what follows are asked; in one projection each question would parse it again."""
    written, real = [], gate.table
    monkeypatch.setattr(gate, "table", lambda df, name: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    gate.parse(views.answers(spark, sf))
    assert written[0].lower().replace("_", "").count("parsejson(") == 1
