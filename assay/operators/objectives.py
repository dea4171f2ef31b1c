"""The whole objective document of candidates: measurement, intervals, sample gate, reference fields, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, ordered, pareto, stats
from .votes import flagged

ENDS = tuple(f"{a}_{e}" for a in pareto.AXES for e in ("lo", "hi", "valid"))


def document(runs: DataFrame, voted: DataFrame, key: str, cluster: str, rounds: int = 2000, seed: int = stats.SEED) -> DataFrame:
    """One row per ``key``.

    ``runs``: key, id, run, label, elapsed, prompt_chars (nulls don't count); ``voted``: key, id,
    cluster, human, maj.  Counts and rates; of either rate the interval over clusters and over
    claims (``_claim_``) with how many resamples counted; the sample gate; medians over runs (of
    characters the whole part) and the number of calls; and how many units are misses, false
    alarms and splits.  The units themselves are the rows of ``metrics.diagnostics``, as their
    lists grow with the units.
    """
    own = ordered.quantiles(runs, [key], "elapsed", {"_elapsed": 0.5}).select(F.col(key).alias("_e"), F.bround("_elapsed", 2).alias("elapsed_median"))
    length = ordered.quantiles(runs, [key], "prompt_chars", {"_chars": 0.5}).select(F.col(key).alias("_c"), F.floor("_chars").alias("prompt_chars_median"))
    raw = runs.groupBy(key).agg(F.count_distinct("run").alias("n_runs"), F.count(F.lit(1)).alias("n_rows"), metrics.number(F.col("label") == "UNRESOLVED").alias("n_raw_unresolved"))
    hit = flagged("maj")
    seen = voted.groupBy(key).agg(metrics.number(metrics.problem() & ~hit).alias("n_misses"), metrics.number(~metrics.problem() & hit).alias("n_false_alarms"))
    out = metrics.rates(metrics.counts(voted, [key])).join(raw, key).join(seen, key)
    out = out.join(stats.bootstrap(voted, [key], cluster, rounds, seed), key)
    claims = stats.bootstrap(voted, [key], None, rounds, seed)
    out = out.join(claims.select(key, *[F.col(e).alias(e.replace("_", "_claim_")) for e in ENDS]), key)
    out = out.join(own, F.col(key) == F.col("_e"), "left").join(length, F.col(key) == F.col("_c"), "left").drop("_e", "_c")
    return pareto.gate_violations(out).withColumnRenamed("n_rows", "search_cost_calls").withColumns({"seed": F.lit(seed), "resamples": F.lit(rounds)})
