"""Answers through the gate: parse, check the shape, check citations, judge, decide.

Answers are (question_id, raw); evidence is (question_id, standard, paragraph, body).
Findings are rows (question_id, claim_id, reason); claim_id is null where a finding is
about the answer.  One Arrow function reads the JSON; all checks are column expressions over
exploded claims, and evidence is met by one equi join.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.shared import small_batches, table

#: Limits of an answer, and the reasons that flag.  Any other reason forces INDETERMINATE.
MAX_CLAIMS, MAX_LOCATORS, MAX_QUOTE, MAX_ANSWER = 32, 3, 2000, 20000
FLAGGING = ("semantic_contradicted", "semantic_insufficient")
REASON_OF = {"CONTRADICTED": "semantic_contradicted", "INSUFFICIENT": "semantic_insufficient", "UNRESOLVED": "semantic_unresolved"}


CITATION = "text string, standard string, paragraph string, subitem string"
CLAIM = f"object boolean, id string, text string, quote string, quote_ok boolean, citations array<struct<{CITATION}>>"
PAYLOAD = f"ok boolean, answer string, answer_ok boolean, claims_ok boolean, claims array<struct<{CLAIM}>>"


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, reason) for condition, reason in pairs]))


def _as_text(x: object) -> str | None:
    return None if x is None else str(x)


def _citation(x: object) -> dict:
    if isinstance(x, dict):
        return {k: _as_text(x.get(k)) for k in ("standard", "paragraph", "subitem")}
    return {"text": x} if isinstance(x, str) else {}


def _claim(x: object) -> dict:
    """One claim in columns: alternate keys, the first that is set; one citation or a list of them."""
    if not isinstance(x, dict):
        return {"object": False}
    said, quote, cited = x.get("text") or x.get("statement"), x.get("quote") or "", x.get("citations")
    if cited is None:
        cited = x.get("citation")
    return {
        "object": True, "id": _as_text(x.get("id") or x.get("claim_id") or None), "text": said if isinstance(said, str) else None,
        "quote": quote if isinstance(quote, str) else "", "quote_ok": isinstance(quote, str),
        "citations": [_citation(c) for c in (cited if isinstance(cited, list) else [] if cited is None else [cited])],
    }


def _payload(raw: pd.Series) -> pd.DataFrame:
    """JSON texts in columns.  JSON mixes types under one key, which no fixed schema reads; nothing is repaired."""
    out = []
    for one in raw:
        try:
            x = json.loads(one)
        except (ValueError, RecursionError):
            x = None
        if not isinstance(x, dict):
            out.append((False, "", True, True, []))
            continue
        answer, listed = x.get("answer"), x.get("claims")
        held = listed if isinstance(listed, list) else []
        out.append((True, answer if isinstance(answer, str) else "", answer is None or isinstance(answer, str), isinstance(listed, list), [_claim(c) for c in held]))
    return pd.DataFrame(out, columns=["ok", "answer", "answer_ok", "claims_ok", "claims"])


#: Types of a payload that native functions read as the exact reader does: texts only, citations of one kind.
_ADDRESS = "OBJECT<paragraph: STRING, standard: STRING(, subitem: STRING)?>"
PLAIN = f"^OBJECT<answer: STRING, claims: ARRAY<(VOID|OBJECT<(citations: ARRAY<(VOID|STRING|{_ADDRESS})>, )?(id: STRING, )?(quote: STRING, )?text: STRING>)>>$"
_FIELDS = "answer string, claims array<struct<id: string, text: string, quote: string, citations: array<string>>>"


def is_plain(raw: Column) -> Column:
    """Whether a text is one JSON object of the common shape, on whose reading all readers agree.

    Not so: what no JSON is, repeated keys, NaN, text after the object, numbers or nulls for
    texts, other keys, half surrogates.  The brackets make text after the object an error or
    a second element.
    """
    return _is_plain(raw, _bracketed(raw))


def _bracketed(raw: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))


def _is_plain(raw: Column, whole: Column) -> Column:
    """``is_plain`` of a text and its JSON in brackets; as a column of its own that is parsed once."""
    one = F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.coalesce(one & F.schema_of_variant(F.try_variant_get(whole, "$[0]", "variant")).rlike(PLAIN) & ~raw.rlike(r"(?i)\\ud[89a-f]|\"\s*\{"), F.lit(False))


def _natively(raw: Column) -> Column:
    """The columns of PAYLOAD of a plain text."""
    x = F.from_json(raw, _FIELDS)

    def cited(c: Column) -> Column:
        own = F.from_json(c, "standard string, paragraph string, subitem string")
        address = F.startswith(F.ltrim(c), F.lit("{"))  # objects come as their JSON
        return F.struct(F.when(~address, c).alias("text"), *[F.when(address, own[k]).alias(k) for k in ("standard", "paragraph", "subitem")])

    def claim(c: Column) -> Column:
        none = F.array().cast(f"array<struct<{CITATION}>>")
        return F.struct(
            F.lit(True).alias("object"), F.nullif(c["id"], F.lit("")).alias("id"), F.nullif(c["text"], F.lit("")).alias("text"), F.coalesce(c["quote"], F.lit("")).alias("quote"), F.lit(True).alias("quote_ok"),
            F.coalesce(F.transform(c["citations"], cited), none).alias("citations"),
        )

    return F.struct(F.lit(True).alias("ok"), x["answer"].alias("answer"), F.lit(True).alias("answer_ok"), F.lit(True).alias("claims_ok"), F.transform(x["claims"], claim).alias("claims"))


def parse(answers: DataFrame) -> DataFrame:
    """Answers with claims (array of structs), ok (the text is a JSON object), reasons and go.

    A fence around the JSON is taken off; null and blank texts are empty_output, other
    texts that are no JSON object schema_invalid.  ``go``: claims are worth checking.  Texts of
    the common shape are read natively, only the others by the exact reader.
    """
    # both steps are written: their filters would else repeat, for each row, all that the texts and reasons are made of
    whole = answers.withColumn("_clean", text.unfence(F.coalesce("raw", F.lit("")))).withColumn("_json", _bracketed(F.col("_clean")))
    marked = table(whole.select(*answers.columns, "_clean", _is_plain(F.col("_clean"), F.col("_json")).alias("_plain")), "answers")
    native = marked.filter("_plain").withColumn("_p", _natively(F.col("_clean")))
    exact = marked.filter("not _plain").withColumn("_p", F.pandas_udf(_payload, PAYLOAD)("_clean"))
    a = native.unionByName(exact).select(*answers.columns, "_clean", "_p.*")
    none, said, blank, ok = F.size("claims") == 0, F.trim("answer") != "", F.trim("_clean") == "", F.col("ok")
    reasons = _reasons(
        (~ok & blank, "empty_output"), (~ok & ~blank, "schema_invalid"), (ok & ~F.col("answer_ok"), "schema_invalid"), (ok & ~F.col("claims_ok"), "schema_invalid"),
        (ok & none & ~said, "empty_output"), (ok & (F.length("answer") > MAX_ANSWER), "limit_exceeded"),
        (ok & none & said, "claims_missing"), (ok & (F.size("claims") > MAX_CLAIMS), "limit_exceeded"),
    )
    return table(a.select(*answers.columns, "ok", "claims", reasons.alias("reasons"), (ok & ~none).alias("go")), "parsed")


def _locator(c: Column) -> Column:
    """struct(standard, paragraph, subitem) of a citation: a text, or an object of the parts."""
    return F.when(c["text"].isNotNull(), text.citation(c["text"])).otherwise(text.cited_object(c["standard"], c["paragraph"], c["subitem"]))


def claims(parsed: DataFrame) -> DataFrame:
    """A row per claim of answers worth checking: idx, claim_id, text, quote, locators, reasons, kept.

    Of claims that share an id the first is kept; the others have claim_id_duplicate alone.
    """
    c = parsed.filter("go").select("question_id", F.posexplode("claims").alias("idx", "c")).select("question_id", "idx", "c.*")
    own = F.coalesce("id", F.concat(F.lit("c"), (F.col("idx") + 1).cast("string")))
    c = c.withColumn("claim_id", F.when(F.col("object"), own))
    order = Window.partitionBy("question_id", "claim_id").orderBy("idx")
    c = c.withColumns({"again": F.col("object") & (F.row_number().over(order) > 1), "located": F.transform("citations", _locator)})
    c = c.withColumn("locators", F.array_compact("located"))
    shape = _reasons(
        (F.trim(F.coalesce("text", F.lit(""))) == "", "schema_invalid"), (F.size("locators") == 0, "citation_missing"), (F.size("locators") > MAX_LOCATORS, "limit_exceeded"),
        (~F.col("quote_ok"), "schema_invalid"), (F.length("quote") > MAX_QUOTE, "limit_exceeded"),
    )
    unread = F.array_repeat(F.lit("citation_missing"), (F.size("located") - F.size("locators")).cast("int"))
    reasons = F.when(~F.col("object"), F.array(F.lit("schema_invalid"))).when(F.col("again"), F.array(F.lit("claim_id_duplicate"))).otherwise(F.concat(shape, unread))
    return c.select("question_id", "idx", "claim_id", "text", "quote", "locators", reasons.alias("reasons"), (F.col("object") & ~F.col("again")).alias("kept"))


def citation_reasons(checked: DataFrame, evidence: DataFrame, require_quote: bool = True) -> DataFrame:
    """Reasons per kept claim: addresses that aren't there, sub-items that aren't, quotes that no matched text holds."""
    e = evidence.select(F.col("question_id").alias("_q"), F.col("standard").alias("_s"), F.col("paragraph").alias("_p"), "body")
    each = checked.filter("kept").select("question_id", "idx", "claim_id", "quote", F.explode("locators").alias("at"))
    m = each.join(e, (F.col("question_id") == F.col("_q")) & (F.col("at.standard") == F.col("_s")) & (F.col("at.paragraph") == F.col("_p")), "left")
    found = F.col("_q").isNotNull()
    sub = F.col("at.subitem").isNull() | text.has_subitem(F.col("body"), F.col("at.subitem"))
    # as columns, since the sums would each search the body for the sub-item again
    m = m.select("question_id", "idx", "claim_id", found.alias("found"), (found & sub).alias("sub"), (found & sub & text.contains_quote(F.col("body"), F.col("quote"))).alias("said"))
    g = m.groupBy("question_id", "idx", "claim_id").agg(
        F.count(F.when(~F.col("found"), 1)).alias("missing"), F.count(F.when(F.col("found") & ~F.col("sub"), 1)).alias("no_sub"),
        F.coalesce(F.bool_or("said"), F.lit(False)).alias("quoted"),
    )
    again = lambda reason, n: F.array_repeat(F.lit(reason), F.col(n).cast("int"))
    unquoted = _reasons((~F.col("quoted") & F.lit(require_quote), "quote_not_in_source"))
    return g.select("question_id", "claim_id", F.concat(again("source_id_not_found", "missing"), again("subitem_not_found", "no_sub"), unquoted).alias("reasons"))


def findings(answers: DataFrame, evidence: DataFrame, require_quote: bool = True) -> DataFrame:
    """All findings of the parser, the shape and the citations, repeats included."""
    return _findings(*_read(answers), evidence, require_quote)


def _read(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, claims) of answers, each written once: the JSON reader works row by row and runs a single time."""
    parsed = parse(answers)
    return parsed, table(claims(parsed), "claims")


def _findings(parsed: DataFrame, c: DataFrame, evidence: DataFrame, require_quote: bool) -> DataFrame:
    parts = (
        parsed.select("question_id", F.lit(None).cast("string").alias("claim_id"), "reasons"),
        c.select("question_id", "claim_id", "reasons"), citation_reasons(c, evidence, require_quote),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("question_id", "claim_id", F.explode("reasons").alias("reason"))


def decide(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, verdict): INDETERMINATE before FLAGGED before VERIFIED; no finding verifies."""
    worst = found.groupBy("question_id").agg(F.max(F.when(F.col("reason").isin(*FLAGGING), 1).otherwise(2)).alias("worst"))
    verdict = F.when(F.col("worst") == 2, "INDETERMINATE").when(F.col("worst") == 1, "FLAGGED").otherwise("VERIFIED")
    return answers.select("question_id").join(worst, "question_id", "left").select("question_id", verdict.alias("verdict"))


def reason_of(label: Column) -> Column:
    """The reason of a judgement's label: SUPPORTED has none, none or an unknown label is unresolved."""
    out = F.when(label == "SUPPORTED", None)
    for known, code in REASON_OF.items():
        out = out.when(label == known, code)
    return out.otherwise("semantic_unresolved")


def judged(kept: DataFrame, judgements: DataFrame | None) -> DataFrame:
    """Findings of a table of judgements (question_id, claim_id, label); without one all claims are unresolved."""
    if judgements is None:
        return kept.select("question_id", "claim_id", F.lit("semantic_unresolved").alias("reason"))
    j = kept.join(judgements, ["question_id", "claim_id"], "left")
    return j.select("question_id", "claim_id", reason_of(F.col("label")).alias("reason")).filter("reason is not null")


def judge_claims(kept: DataFrame, judge: Callable[[str, str], str], prompt: str = "text") -> DataFrame:
    """Judgements (question_id, claim_id, label) of claims by an injected ``judge(prompt, claim_id)``.

    A judge that fails or gives anything but a known label leaves its claim unresolved: the
    claims go on, and nothing passes for want of a verdict.
    """
    def ask(prompts: pd.Series, claim: pd.Series) -> pd.Series:
        def one(p: str, c: str) -> str:
            try:
                said = judge(p, c)
            except Exception:  # a judge may fail in any way  # noqa: BLE001
                return "UNRESOLVED"
            return said if said in ("SUPPORTED", *REASON_OF) else "UNRESOLVED"

        return pd.Series([one(p, c) for p, c in zip(prompts, claim, strict=True)], dtype=object)

    # prompts are written before they are asked, and answers once: a judge is dear
    ready = table(kept.select("question_id", "claim_id", prompt), "prompts")
    with small_batches(kept.sparkSession):  # prompts hold whole texts
        return table(ready.select("question_id", "claim_id", F.pandas_udf(ask, "string")(prompt, "claim_id").alias("label")), "judgements")


def fail_closed(check: Callable[[str], list[str]]) -> Callable[[pd.Series], pd.Series]:
    """A check of single texts (it gives reasons) as a function of a column that never lets an error pass.

    A timeout gives verifier_timeout, any other error internal_error; both force INDETERMINATE.
    """
    def run(texts: pd.Series) -> pd.Series:
        def one(x: str) -> list[str]:
            try:
                return list(check(x))
            except TimeoutError:
                return ["verifier_timeout"]
            except Exception:  # whatever it is, it must not pass  # noqa: BLE001
                return ["internal_error"]

        return pd.Series([one(x) for x in texts], dtype=object)

    return run


def evaluate(answers: DataFrame, evidence: DataFrame, judgements: DataFrame | None, require_quote: bool = True) -> DataFrame:
    """(question_id, verdict) through all layers; only answers without a finding so far are judged.

    Without judgements the verdict is that of the layers before.
    """
    parsed, c = _read(answers)
    found = _findings(parsed, c, evidence, require_quote)
    if judgements is None:
        return decide(answers, found)
    found = table(found, "findings")
    kept = c.filter("kept").join(found.select("question_id"), "question_id", "left_anti").select("question_id", "claim_id")
    return decide(answers, found.unionByName(judged(kept, judgements)))
