"""Two arms: mechanical grading of citations, the report over both, and runs by injected callables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import small_batches, table
from . import stats

#: The verdict of a probe that agrees, and the share of over-corrections that is too much.
AGREES, OVER = "일치", 0.005


def citation_error(cited: Column, layer: Column, allowed: Column, gold: Column) -> Column:
    """Whether an answer's citations are wrong.

    ``cited``: paragraphs it names; null is an answer that couldn't be read, which is wrong.
    Without an answer in the evidence (layer no_answer) any citation is wrong.  Otherwise none
    at all is, one outside the evidence is, and so is naming no gold paragraph where there are any.
    """
    missed = (F.size(gold) > 0) & ~F.arrays_overlap(cited, gold)
    return (
        F.when(cited.isNull(), True).when(layer == "no_answer", F.size(cited) > 0).when(F.size(cited) == 0, True)
        .when(F.size(F.array_except(cited, allowed)) > 0, True).otherwise(missed)
    )


def graded(answers: DataFrame) -> DataFrame:
    """Answers (a, b: what either arm cites; layer, allowed, gold) with error_a and error_b."""
    wrong = lambda x: citation_error(F.col(x), F.col("layer"), F.col("allowed"), F.col("gold"))
    return answers.withColumns({"error_a": wrong("a"), "error_b": wrong("b")})


def _count(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def two_arms(grades: DataFrame) -> DataFrame:
    """One row over both arms: citation errors and their McNemar p, accuracy, and over-correction.

    ``grades``: error_a, error_b, acc_a, acc_b and acc_draft, null where nothing was revised.
    Over-corrected is a draft that was right and whose revision isn't; its share is of all.
    """
    return _rated(grades.agg(*_tallies()))


def report(grades: DataFrame) -> DataFrame:
    """The rows of ``two_arms`` over all and per layer, from one aggregation: layer, whole (the row over all), and its columns."""
    sets = grades.groupingSets([[], [F.col("layer")]], F.col("layer"))
    return _rated(sets.agg((F.grouping("layer") == 1).alias("whole"), *_tallies()))


def _tallies() -> list[Column]:
    a, b = F.col("error_a"), F.col("error_b")
    return [
        F.count(F.lit(1)).alias("n"), _count(a, "errors_a"), _count(b, "errors_b"), _count(a & ~b, "improved"), _count(~a & b, "worsened"),
        _count(F.col("acc_a"), "right_a"), _count(F.col("acc_b"), "right_b"), F.count("acc_draft").alias("revised"), _count(F.col("acc_draft") & ~F.col("acc_b"), "over_corrected"),
    ]


def _rated(r: DataFrame) -> DataFrame:
    share = lambda x: F.try_divide(F.col(x).cast("double"), F.col("n").cast("double"))
    named = {"error_rate_a": "errors_a", "error_rate_b": "errors_b", "accuracy_a": "right_a", "accuracy_b": "right_b", "over_correction": "over_corrected"}
    return r.withColumns({k: F.bround(share(v), 4) for k, v in named.items()} | {"over_limit": share("over_corrected") > OVER, "p": F.bround(stats.mcnemar(F.col("improved"), F.col("worsened")), 6)})


def by_layer(grades: DataFrame) -> DataFrame:
    return grades.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), _count(F.col("error_a"), "errors_a"), _count(F.col("error_b"), "errors_b"))


def needs_revision(items: Column) -> Column:
    """Whether any of a probe's items (array of struct(verdict)) doesn't agree; what the model says of it doesn't count."""
    return F.coalesce(F.exists(items, lambda i: ~i["verdict"].eqNullSafe(F.lit(AGREES))), F.lit(False))


def _object(raw: str | None) -> dict | None:
    """The JSON object in a model's output: fences off, else from the first to the last brace."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", (raw or "").strip())
    inside = re.search(r"\{.*\}", bare, re.S)
    for one in (bare, inside.group(0) if inside else ""):
        try:
            found = json.loads(one)
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


ARMS = "qid long, draft string, needs_revision boolean, final string, done boolean"


def run_arms(questions: DataFrame, answer: Callable[[str, str], str], probe: Callable[[str, str], str], revise: Callable[[str, str], str]) -> DataFrame:
    """The second arm of each question (qid, question, evidence): answer, probe, at most one revision.

    An answer without claims isn't probed; what isn't JSON leaves draft null.  A revision that
    isn't JSON leaves the draft.  A question whose callable fails is not done, and the others
    go on.  The callables are given by the study; a row's calls depend on each other, so this
    is one pass of Python over the questions.
    """
    def one(question: str, evidence: str) -> tuple:
        draft = _object(answer(question, evidence))
        claims = (draft or {}).get("claims") or []
        if not claims:
            return draft, False, draft
        lines = "\n".join(f"{c.get('claim_id', i)}. {c.get('text', '')} [{c.get('citation', '')}]" for i, c in enumerate(claims, 1))
        probed = _object(probe(evidence, lines))
        needs = any(item.get("verdict") != AGREES for item in (probed or {}).get("items") or [])
        if not needs:
            return draft, False, draft
        whole = json.dumps(draft, ensure_ascii=False)
        return draft, True, _object(revise(whole, json.dumps(probed, ensure_ascii=False))) or draft

    def run(batches):  # noqa: ANN001, ANN202
        text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
        for batch in batches:
            out = []
            for qid, question, evidence in zip(batch["qid"], batch["question"], batch["evidence"], strict=True):
                try:
                    draft, needs, final = one(question, evidence)
                    out.append((qid, text(draft), needs, text(final), True))
                except Exception:  # a callable may fail in any way; the question stays open  # noqa: BLE001
                    out.append((qid, None, False, None, False))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ARMS.split(", ")])

    with small_batches(questions.sparkSession):  # evidence is whole texts; written, as a call is dear
        return table(questions.filter("qid is not null").select("qid", "question", "evidence").mapInPandas(run, ARMS), "arms")


def run_stress(cases: DataFrame, first: Callable[[str], bool], second: Callable[[str], bool]) -> DataFrame:
    """Cases (id, kind, claims, answer) with what two injected probes make of the claims and of the answer."""
    of_claims = F.pandas_udf(lambda x: pd.Series([bool(first(v)) for v in x]), "boolean")
    of_answer = F.pandas_udf(lambda x: pd.Series([bool(second(v)) for v in x]), "boolean")
    return cases.select("id", "kind", of_claims("claims").alias("caught_1"), of_answer("answer").alias("caught_2"))
