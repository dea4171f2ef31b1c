"""Rates over voted units.  A rate without a denominator is null, never zero, unless asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .votes import flagged


def problem(human: str = "human") -> Column:
    return F.col(human).isin("C", "I")


def number(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def counts(units: DataFrame, keys: list[str]) -> DataFrame:
    """One aggregation: units, problems, flagged, detected, contradicted, split, unresolved."""
    hit = flagged("maj")
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), number(problem()).alias("n_problem"), number(hit).alias("n_flagged"),
        number(problem() & hit).alias("n_detected"), number(problem() & (F.col("maj") == "CONTRADICTED")).alias("n_contradicted"),
        number(F.col("maj") == "SPLIT").alias("n_split"), number(F.col("maj") == "UNRESOLVED").alias("n_unresolved"),
    )


def rates(counted: DataFrame, zero_as_null: bool = True) -> DataFrame:
    """``counts`` with recall and precision, rounded half to even at 4 places."""
    def rate(a: str, b: str) -> Column:
        r = F.bround(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
        return r if zero_as_null else F.coalesce(r, F.lit(0.0))

    return counted.withColumns({"recall": rate("n_detected", "n_problem"), "precision": rate("n_detected", "n_flagged")})


def per_class(units: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall per class (S, C, I) and of C or I together (gate).

    ``units``: human and short label ``said``.  The four classes are one explode and one
    aggregation, not a pass each.
    """
    sides = F.array(*[
        F.struct(F.lit(name).alias("class"), F.col("human").isin(*own).alias("h"), F.col("said").isin(*own).alias("s"))
        for name, own in (("S", ["S"]), ("C", ["C"]), ("I", ["I"]), ("gate", ["C", "I"]))
    ])
    x = units.select(*keys, F.explode(sides).alias("x")).select(*keys, "x.*")
    x = x.groupBy(*keys, "class").agg(number(F.col("h") & F.col("s")).alias("tp"), number(~F.col("h") & F.col("s")).alias("fp"), number(F.col("h") & ~F.col("s")).alias("fn"))
    precision = F.bround(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), 4)
    recall = F.bround(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), 4)
    return x.withColumns({"precision": precision, "recall": recall})


def confusion(units: DataFrame, keys: list[str]) -> DataFrame:
    return units.groupBy(*keys, "human", "said").agg(F.count(F.lit(1)).alias("n"))


def roll_up(units: DataFrame, keys: list[str]) -> DataFrame:
    """Gate roll-up over (human, decision): automatic and reviewed units, recall with review."""
    auto = F.col("decision") != "INDETERMINATE"
    said = F.col("decision") == "FLAGGED"
    c = units.groupBy(*keys).agg(
        number(auto).alias("auto_n"), number(~auto).alias("review_n"), number(auto & said & problem()).alias("tp"), number(auto & said & ~problem()).alias("fp"),
        number(auto & ~said & problem()).alias("fn"), number(auto & ~said & ~problem()).alias("tn"), number(~auto & problem()).alias("review_problem"),
    )
    d = lambda a, b: F.bround(F.try_divide(a.cast("double"), b.cast("double")), 4)
    col = F.col
    return c.withColumns({
        "recall_with_review": d(col("tp") + col("review_problem"), col("tp") + col("fn") + col("review_problem")),
        "review_rate": d(col("review_n"), col("auto_n") + col("review_n")), "review_yield": d(col("review_problem"), col("review_n")),
        "accuracy": d(col("tp") + col("tn"), col("auto_n")),
    })


def flips(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """From (human, a, b): how often B is right where A is wrong, the reverse, and the rest."""
    right = lambda c: F.col(c) == F.col("human")
    return pairs.groupBy(*keys).agg(
        number(~right("a") & right("b")).alias("improve"), number(right("a") & ~right("b")).alias("worsen"),
        number((F.col("a") != F.col("b")) & ~right("a") & ~right("b")).alias("other"), F.count(F.lit(1)).alias("n"),
    )


def diagnostics(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind) of voted units to look at: miss, false_alarm, or a split that is neither."""
    hit = flagged("maj")
    kind = F.when(problem() & ~hit, "miss").when(~problem() & hit, "false_alarm").when(F.col("maj") == "SPLIT", "split")
    return units.select(*keys, kind.alias("kind")).filter("kind is not null")


def net_effect(units: DataFrame) -> DataFrame:
    """One row: reviews and problems caught without and with a probe of what would pass.

    ``units``: human, review (is reviewed anyhow), all_flagged, yes (the probe's vote).  Caught
    is what is flagged or reviewed.
    """
    off = F.when(F.col("review"), "REVIEW").when(F.col("all_flagged"), "FLAGGED").otherwise("PASS")
    u = units.withColumn("_off", off).withColumn("_on", F.when((F.col("_off") == "PASS") & F.col("yes"), "REVIEW").otherwise(F.col("_off")))
    c = u.agg(*[number(F.col(f"_{x}") == "REVIEW").alias(f"review_{x}") for x in ("off", "on")], *[number(problem() & (F.col(f"_{x}") != "PASS")).alias(f"caught_{x}") for x in ("off", "on")], number(problem()).alias("problems"))
    rate = lambda a: F.bround(F.try_divide(F.col(a).cast("double"), F.col("problems").cast("double")), 4)
    return c.withColumns({"more_review": F.col("review_on") - F.col("review_off"), "more_caught": F.col("caught_on") - F.col("caught_off"), "recall_off": rate("caught_off"), "recall_on": rate("caught_on")})


def availability(answers: DataFrame, claims: str, arm: str, rule: str) -> DataFrame:
    """Per arm, and per arm and rule (null: over all rules): answers, abstentions, claims, answers with siblings and their claims."""
    n = F.col(claims)
    many = n > 1
    return answers.groupingSets([[F.col(arm)], [F.col(arm), F.col(rule)]], F.col(arm), F.col(rule)).agg(
        F.count(F.lit(1)).alias("answers"), number(n == 0).alias("abstained"), F.sum(n).alias("claims"), number(many).alias("with_siblings"), F.coalesce(F.sum(F.when(many, n)), F.lit(0)).alias("sibling_claims"),
    )


def _share(condition: Column, of: Column) -> Column:
    return F.try_divide(number(condition & of).cast("double"), number(of).cast("double"))


#: Predicates and axes by name, for plans that are given by name.
RULES = {
    "problem": problem, "flagged": lambda: flagged("maj"), "detected": lambda: problem() & flagged("maj"), "split": lambda: F.col("maj") == "SPLIT",
}
AXES = {"recall": lambda: _share(flagged("maj"), problem()), "precision": lambda: _share(problem(), flagged("maj"))}
