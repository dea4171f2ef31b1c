"""Votes on labelled units: majorities, consensus, ensembles, stability.

Each function takes rows (keys..., label) and gives one row per key; every one is a single
hash aggregation with partial sums, whatever the number of votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("CONTRADICTED", "INSUFFICIENT", "SUPPORTED", "UNRESOLVED")
#: Short forms; anything else is U.
SHORT = {"SUPPORTED": "S", "CONTRADICTED": "C", "INSUFFICIENT": "I"}


def short(label: str = "label") -> Column:
    out = F.lit("U")
    for long, one in SHORT.items():
        out = F.when(F.col(label) == long, one).otherwise(out)
    return out


def flagged(label: str) -> Column:
    """Whether a label is one of the two that flag; null is not."""
    return F.coalesce(F.col(label).isin("CONTRADICTED", "INSUFFICIENT"), F.lit(False))


def majority(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The most frequent label if it has two votes, else SPLIT; ties by label.

    UNRESOLVED is a vote like any other; any number of rows per key will do.
    """
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    # most votes first, then the smallest label
    top = F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label")))
    return counts.groupBy(*keys).agg(top.alias("_top")).select(*keys, F.when(F.col("_top.n") <= -2, F.col("_top.label")).otherwise("SPLIT").alias("maj"))


def first_most_common(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The most frequent label even with one vote; ties by label."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    top = F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label")))
    return counts.groupBy(*keys).agg(top.alias("_top")).select(*keys, F.col("_top.label").alias("maj"))


def three_run(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Three runs needed, the last row of a run counts: incomplete, unresolved, the majority or split."""
    last = rows.groupBy(*keys, "run").agg(F.max_by("label", order).alias("label"))
    counts = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in LABELS])
    outcome = F.when(F.col("n") < 3, "incomplete").when(F.col("UNRESOLVED") > 0, "unresolved")
    for x in LABELS[:3]:
        outcome = outcome.when(F.col(x) >= 2, x)
    return counts.select(*keys, outcome.otherwise("split").alias("outcome"))


def consensus(rows: DataFrame, keys: list[str], strict: bool = True, label: str = "label") -> DataFrame:
    """PASS if no vote flags, FLAGGED if all do, else INDETERMINATE.

    ``strict``: an undecided vote stands in the way of PASS; otherwise it counts as unflagged.
    """
    known = F.col(label).isin(*SHORT)
    agg = rows.groupBy(*keys).agg(F.bool_or(flagged(label)).alias("any"), F.bool_and(flagged(label)).alias("all"), F.bool_and(F.coalesce(known, F.lit(False))).alias("known"))
    passes = ~F.col("any") & (F.col("known") if strict else F.lit(True))
    return agg.select(*keys, F.when(passes, "PASS").when(F.col("all"), "FLAGGED").otherwise("INDETERMINATE").alias("decision"))


def ensembles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, rule, flagged): first run alone, any of three, two or more, all."""
    n = rows.groupBy(*keys).agg(F.sum(flagged("label").cast("int")).alias("n"), F.bool_or(flagged("label") & (F.col("run") == 1)).alias("one"))
    rules = {"all_of_3": F.col("n") >= 3, "any_of_3": F.col("n") >= 1, "single_run_1": F.col("one"), "two_of_3": F.col("n") >= 2}
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("flagged")) for k, v in rules.items()])
    return n.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.rule", "r.flagged")


def stability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number of distinct labels, and whether they are unstable (more than one)."""
    return rows.groupBy(*keys).agg(F.count_distinct("label").alias("n_labels")).withColumn("unstable", F.col("n_labels") > 1)


def probe(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """YES if ``k`` runs or more say YES, and how the runs agree (all_yes, all_no, split)."""
    n = rows.groupBy(*keys).agg(F.count(F.when(F.col("vote") == "YES", 1)).alias("yes"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("yes") == F.col("n"), "all_yes").when(F.col("yes") == 0, "all_no").otherwise("split")
    return n.select(*keys, "yes", (F.col("yes") >= k).alias("hit"), kind.alias("kind"))


def listed(rows: DataFrame, keys: list[str], run: str, label: str) -> DataFrame:
    """The votes of each key as an array of struct(run, label) in the order of runs, which are few."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), F.col(label).alias("label")))).alias("votes"))


def versions(units: DataFrame, said: DataFrame, key: str, version: str, label: str, names: dict[str, str]) -> DataFrame:
    """Units with a column per version of the judge and their ``ensemble``: what two of them say, in their order, else U.

    ``said``: key, version and short label, one row each (of several, the largest); a unit that
    a version didn't judge has U there.
    """
    wide = said.groupBy(F.col(key).alias("_k")).agg(*[F.max(F.when(F.col(version) == v, F.col(label))).alias(n) for v, n in names.items()])
    out = units.join(wide, F.col(key) == F.col("_k"), "left").select(*units.columns, *[F.coalesce(n, F.lit("U")).alias(n) for n in names.values()])
    own = list(names.values())
    agreed = F.coalesce(*[F.when(F.col(a) == F.col(b), F.col(a)) for i, a in enumerate(own) for b in own[i + 1 :]], F.lit("U"))
    return out.withColumn("ensemble", agreed)
