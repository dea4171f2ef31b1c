"""Queries of intervals, objective vectors and fronts that tie where intervals overlap, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, pareto, stats, trials
from .operators import objectives as objectives_module
from .plans import views
from .plans.shared import table
from .plans.views import sql
from .queries import BAD, COUNTS, HIT, RATE, VOTED, _voted, query

#: Resamples of an interval.
ROUNDS = 2000
MODULUS = "18446744073709551616::UHUGEINT"


def draws_sql(by: str, units: str, p: str) -> str:
    """Expressions that end in ``p`` + t (b, pos, times): the generator by doubling, and the draws."""
    return f"""{p}k AS (SELECT count(DISTINCT {by}) AS n FROM {units}),
{p}g(lvl, i, s, a, c) AS (SELECT 0, 0::BIGINT, 20260730::UHUGEINT, 6364136223846793005::UHUGEINT, 1442695040888963407::UHUGEINT UNION ALL
  SELECT lvl + 1, i + j * (1::BIGINT << lvl), CASE WHEN j = 0 THEN s ELSE (s * a + c) % {MODULUS} END, (a * a) % {MODULUS}, (a * c + c) % {MODULUS}
  FROM {p}g, {p}k, (SELECT unnest([0, 1]) AS j) WHERE (1::BIGINT << lvl) <= {ROUNDS} * n),
{p}t AS (SELECT (i - 1) // n AS b, CAST((((s - s % 131072::UHUGEINT) // 131072::UHUGEINT) * n::UHUGEINT) // 140737488355328::UHUGEINT AS BIGINT) AS pos, count(*) AS times
  FROM {p}g, {p}k WHERE lvl = (SELECT max(lvl) FROM {p}g) AND i BETWEEN 1 AND {ROUNDS} * n GROUP BY ALL)"""


def intervals_sql(by: str, units: str = "votes", name: str = "ci") -> str:
    """Expressions that end in ``name`` (candidate, bounds, valid resamples): the draws, the clusters'
    sums, rates per resample, quantiles."""
    p = name
    return draws_sql(by, units, p) + f""",
{p}r AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS pos FROM (SELECT DISTINCT {by} AS u FROM {units})),
{p}s AS (SELECT candidate, pos, count(*) FILTER ({BAD}) AS p, count(*) FILTER ({HIT}) AS f, count(*) FILTER ({BAD} AND {HIT}) AS d FROM {units} JOIN {p}r ON {by} = u GROUP BY ALL),
{p}b AS (SELECT candidate, b, sum(times * p)::DOUBLE AS p, sum(times * f)::DOUBLE AS f, sum(times * d)::DOUBLE AS d FROM {p}t JOIN {p}s USING (pos) GROUP BY ALL),
{p} AS (SELECT candidate, """ + ", ".join(
        f"round_even(quantile_cont(d / nullif({c}, 0), {q}), 4) AS {axis}_{end}" for axis, c in (("recall", "p"), ("precision", "f")) for end, q in (("lo", 0.025), ("hi", 0.975))
    ) + f", count(*) FILTER (p > 0) AS recall_valid, count(*) FILTER (f > 0) AS precision_valid FROM {p}b GROUP BY candidate)"


CLUSTERED = VOTED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + COUNTS + ",\n" + intervals_sql("qid")
POOL = CLUSTERED + f""", candidates AS (SELECT candidate, n_flagged, n_split, CAST(substr(candidate, 2) AS INTEGER) // 3 AS generation, CASE WHEN candidate IN ('c004', 'c008') THEN 'filter_strip' ELSE 'front_pair' END AS origin,
  {RATE.format(a='n_detected', b='n_problem')} AS recall, {RATE.format(a='n_detected', b='n_flagged')} AS precision, recall_lo, recall_hi, precision_lo, precision_hi FROM counts JOIN ci USING (candidate)),
pool AS (SELECT * FROM candidates WHERE recall IS NOT NULL AND precision IS NOT NULL)"""


def objectives(s: SparkSession, d: str, voted: DataFrame | None = None) -> DataFrame:
    """The objective vectors with cluster intervals, written once a call, as fronts read them more than once."""
    v = table(_voted(s, d), "voted") if voted is None else voted
    rated = metrics.rates(metrics.counts(v, ["candidate"]))
    return table(rated.join(stats.bootstrap(v, ["candidate"], "qid", ROUNDS), "candidate"), "objectives")


def candidates(s: SparkSession, d: str) -> DataFrame:
    generation = F.floor(F.substring("candidate", 2, 3).cast("int") / 3).cast("int")
    origin = F.when(F.col("candidate").isin("c004", "c008"), "filter_strip").otherwise("front_pair")
    ends = [f"{a}_{e}" for a in pareto.AXES for e in ("lo", "hi")]
    c = objectives(s, d).select("candidate", "n_flagged", "n_split", generation.alias("generation"), origin.alias("origin"), "recall", "precision", *ends, F.lit(None).cast("string").alias("status"), F.lit(True).alias("gate_passed"))
    return pareto.judgeable(c)


def cmp_sql(axis: str, x: str = "x", y: str = "y") -> str:
    return f"(CASE WHEN {x}.{axis}_lo > {y}.{axis}_hi + 1e-9 THEN 1 WHEN {y}.{axis}_lo > {x}.{axis}_hi + 1e-9 THEN -1 ELSE 0 END)"


def dom_sql(x: str = "x", y: str = "y") -> str:
    a, b = cmp_sql("recall", x, y), cmp_sql("precision", x, y)
    return f"({a} >= 0 AND {b} >= 0 AND {a} + {b} > 0)"


DOM, TIE = dom_sql(), f"({cmp_sql('recall')} = 0 AND {cmp_sql('precision')} = 0)"


# --- intervals -------------------------------------------------------------------------


UNITS = ("candidate", "recall_lo", "recall_hi", "precision_lo", "precision_hi", "recall_valid", "precision_valid")


@query("SA3_lcg_draws", "WITH RECURSIVE " + sql("units").removeprefix("WITH ").rstrip() + ",\n" + draws_sql("id", "units", "u") + " SELECT b, pos, times FROM ut WHERE b < 20")
def sa3(s: SparkSession, d: str) -> DataFrame:
    """The seeded draws of the first 20 resamples of the units."""
    size = views.units(s, d).select("id").distinct().count()
    return stats.draws(s, size, 20).groupBy("b", "pos").agg(F.count(F.lit(1)).alias("times"))


@query("SA4_claim_bootstrap", VOTED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + intervals_sql("id") + f" SELECT {', '.join(UNITS)} FROM ci")
def sa4(s: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap(_voted(s, d), ["candidate"], None, ROUNDS).select(*UNITS)


@query("SA5_cluster_bootstrap", CLUSTERED + f" SELECT {', '.join(UNITS)} FROM ci")
def sa5(s: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap(_voted(s, d), ["candidate"], "qid", ROUNDS).select(*UNITS)


SPARSE = VOTED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", few AS (SELECT candidate, id, qid, CASE WHEN qid IN ('Q011', 'Q023') THEN human ELSE 'S' END AS human, CASE WHEN candidate = 'c003' THEN 'SUPPORTED' ELSE maj END AS maj FROM votes)"""


@query("SA6_interval_of_few", SPARSE + ",\n" + intervals_sql("qid", "few") + f" SELECT {', '.join(UNITS)} FROM ci")
def sa6(s: SparkSession, d: str) -> DataFrame:
    """Few problems: resamples without any don't count, and a candidate that never flags has no precision."""
    v = _voted(s, d)
    few = v.withColumns({"human": F.when(F.col("qid").isin("Q011", "Q023"), F.col("human")).otherwise("S"), "maj": F.when(F.col("candidate") == "c003", "SUPPORTED").otherwise(F.col("maj"))})
    return stats.bootstrap(few, ["candidate"], "qid", ROUNDS).select(*UNITS)


@query("SA7_apart", POOL + " SELECT x.candidate AS a, y.candidate AS b, x.recall_hi < y.recall_lo AS below, x.recall_lo > y.recall_hi OR y.recall_lo > x.recall_hi AS apart FROM pool x JOIN pool y ON x.candidate < y.candidate")
def sa7(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d).select("candidate", F.struct(F.col("recall_lo").alias("lo"), F.col("recall_hi").alias("hi")).alias("r"))
    return _pairs(c).select(F.col("x.candidate").alias("a"), F.col("y.candidate").alias("b"), stats.below(F.col("x.r.hi"), F.col("y.r.lo")).alias("below"), stats.disjoint(F.col("x.r"), F.col("y.r")).alias("apart"))


@query("SA14_interval_self_test", "SELECT * FROM (VALUES ('all_hit', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('all_miss', 0.0::DOUBLE, 0.0::DOUBLE, NULL, NULL)) t(candidate, recall_lo, recall_hi, precision_lo, precision_hi)")
def sa14(s: SparkSession, d: str) -> DataFrame:
    """All found: [1, 1]; all missed: [0, 0]; none flagged: no interval of precision."""
    u = views.units(s, d).withColumn("human", F.lit("C"))
    both = u.withColumns({"candidate": F.lit("all_hit"), "maj": F.lit("CONTRADICTED")}).unionByName(u.withColumns({"candidate": F.lit("all_miss"), "maj": F.lit("SUPPORTED")}))
    return stats.bootstrap(both, ["candidate"], "qid", 50).select("candidate", "recall_lo", "recall_hi", "precision_lo", "precision_hi")


@query("PA11_objectives", CLUSTERED + ",\n" + intervals_sql("id", name="cl") + """ SELECT candidate, n_units, n_problem, n_flagged, n_detected, n_split, """ + f"{RATE.format(a='n_detected', b='n_problem')} AS recall, {RATE.format(a='n_detected', b='n_flagged')} AS precision, ci.recall_lo, ci.recall_hi, ci.precision_lo, ci.precision_hi, "
       + "cl.recall_lo AS recall_claim_lo, cl.recall_hi AS recall_claim_hi, cl.precision_lo AS precision_claim_lo, cl.precision_hi AS precision_claim_hi FROM counts JOIN ci USING (candidate) JOIN cl USING (candidate)")
def pa11(s: SparkSession, d: str) -> DataFrame:
    """The objective vector: counts, both rates, and of either rate the cluster and the claim interval."""
    ends = [f"{a}_{e}" for a in pareto.AXES for e in ("lo", "hi")]
    v = table(_voted(s, d), "voted")
    claim = stats.bootstrap(v, ["candidate"], None, ROUNDS).select("candidate", *[F.col(e).alias(e.replace("_", "_claim_")) for e in ends])
    return objectives(s, d, v).select("candidate", "n_units", "n_problem", "n_flagged", "n_detected", "n_split", "recall", "precision", *ends).join(claim, "candidate")


DOCUMENT = CLUSTERED + ",\n" + intervals_sql("id", name="cl") + """, timed AS (SELECT *, ((doc_id * 7 + run * 13 + k) % 97)::DOUBLE / 10 AS elapsed, 200 + doc_id % 131 AS chars FROM (SELECT runs.*, CAST(substr(candidate, 2) AS INTEGER) AS k FROM runs)),
raw AS (SELECT candidate, count(DISTINCT run) AS n_runs, count(*) AS search_cost_calls, count(*) FILTER (label = 'UNRESOLVED') AS n_raw_unresolved, round_even(quantile_cont(elapsed, 0.5), 2) AS elapsed_median, CAST(floor(quantile_cont(chars, 0.5)) AS BIGINT) AS prompt_chars_median FROM timed GROUP BY candidate),
seen AS (SELECT candidate, count(*) FILTER (""" + f"{BAD} AND NOT {HIT}) AS n_misses, count(*) FILTER (NOT ({BAD}) AND {HIT}" + """) AS n_false_alarms FROM votes GROUP BY candidate),
gated AS (SELECT candidate, concat_ws(',', CASE WHEN n_problem < 8 THEN 'R1' END, CASE WHEN n_flagged < 5 THEN 'R2' END, CASE WHEN n_runs <> 3 THEN 'R3' END, CASE WHEN greatest(n_unresolved::DOUBLE / n_units, n_raw_unresolved::DOUBLE / search_cost_calls) >= 0.1 THEN 'R4' END, CASE WHEN n_split::DOUBLE / n_units >= 0.2 THEN 'R5' END) AS violations FROM counts JOIN raw USING (candidate))
SELECT counts.*, n_runs, search_cost_calls, n_raw_unresolved, n_misses, n_false_alarms, """ + f"{RATE.format(a='n_detected', b='n_problem')} AS recall, {RATE.format(a='n_detected', b='n_flagged')} AS precision, " + ", ".join(f"{t}.{e} AS {e.replace('_', '_' + u, 1)}" for t, u in (("ci", ""), ("cl", "claim_")) for e in objectives_module.ENDS) + """,
  elapsed_median, prompt_chars_median, violations, violations = '' AS gate_passed, 20260730 AS seed, """ + f"{ROUNDS} AS resamples FROM counts JOIN ci USING (candidate) JOIN cl USING (candidate) JOIN raw USING (candidate) JOIN seen USING (candidate) JOIN gated USING (candidate)"


@query("PA11_document", DOCUMENT)
def pa11b(s: SparkSession, d: str) -> DataFrame:
    """The objective document with sample gate, medians, calls and diagnostics."""
    v = table(_voted(s, d), "voted")
    k = F.substring("candidate", 2, 3).cast("int")
    timed = views.judge_runs(s, d).withColumns({"elapsed": ((F.col("doc_id") * 7 + F.col("run") * 13 + k) % 97).cast("double") / 10, "prompt_chars": 200 + F.col("doc_id") % 131})
    return objectives_module.document(timed, v, "candidate", "qid", ROUNDS)


# --- comparison and fronts -------------------------------------------------------------


def _pairs(c: DataFrame) -> DataFrame:
    """All pairs of candidates, as the report lists them."""
    return pareto.pairs(c, c, F.col("x.candidate") < F.col("y.candidate"))


@query("PA1_compare", POOL + " SELECT x.candidate AS a, y.candidate AS b, " + ", ".join(f"{cmp_sql(axis)} AS {axis}" for axis in pareto.AXES) + " FROM pool x JOIN pool y ON x.candidate < y.candidate")
def pa1(s: SparkSession, d: str) -> DataFrame:
    return _pairs(candidates(s, d)).select(F.col("x.candidate").alias("a"), F.col("y.candidate").alias("b"), *[pareto.compare(axis, "x", "y").alias(axis) for axis in pareto.AXES])


RELATION = f"CASE WHEN {TIE} THEN 'TIE' WHEN {DOM} THEN 'X' WHEN {dom_sql('y', 'x')} THEN 'Y' ELSE 'TRADE_OFF' END"


@query("PA2_relation", POOL + f" SELECT x.candidate AS a, y.candidate AS b, {RELATION} AS relation FROM pool x JOIN pool y ON x.candidate < y.candidate")
def pa2(s: SparkSession, d: str) -> DataFrame:
    return pareto.relation(_pairs(candidates(s, d))).select(F.col("x.candidate").alias("a"), F.col("y.candidate").alias("b"), "relation")


POINT = ("(abs(x.recall - y.recall) <= 1e-9 AND abs(x.precision - y.precision) <= 1e-9)", "x.recall >= y.recall - 1e-9 AND x.precision >= y.precision - 1e-9 AND (x.recall > y.recall + 1e-9 OR x.precision > y.precision + 1e-9)")


@query("PA2_relation_of_points", POOL + f" SELECT x.candidate AS a, y.candidate AS b, CASE WHEN {POINT[0]} THEN 'TIE' WHEN {POINT[1]} THEN 'X' WHEN {POINT[1].replace('x.', 'z.').replace('y.', 'x.').replace('z.', 'y.')} THEN 'Y' ELSE 'TRADE_OFF' END AS relation FROM pool x JOIN pool y ON x.candidate < y.candidate")
def pa2b(s: SparkSession, d: str) -> DataFrame:
    return pareto.relation(_pairs(candidates(s, d)), intervals=False).select(F.col("x.candidate").alias("a"), F.col("y.candidate").alias("b"), "relation")


@query("PA9_dominance_of_two", POOL + f" SELECT x.candidate AS a, y.candidate AS b, {RELATION} AS relation, {cmp_sql('recall')} AS recall, {cmp_sql('precision')} AS precision FROM pool x, pool y WHERE x.candidate = 'c000' AND y.candidate = 'c011'")
def pa9(s: SparkSession, d: str) -> DataFrame:
    return pareto.of_two(candidates(s, d), "c000", "c011")


FRONT = f", front AS (SELECT y.*, list_sort(list(x.candidate) FILTER (x.candidate IS NOT NULL)) AS beaten_by, count(x.candidate) = 0 AS on_front FROM pool y LEFT JOIN pool x ON {DOM} GROUP BY ALL)"


@query("PA3_front", POOL + FRONT + " SELECT candidate, coalesce(array_to_string(beaten_by, ','), '') AS dominated_by, on_front FROM front")
def pa3(s: SparkSession, d: str) -> DataFrame:
    return pareto.front(candidates(s, d)).select("candidate", F.array_join("dominated_by", ",").alias("dominated_by"), "on_front")


@query("JN8_dominance_pairs", POOL + f" SELECT x.candidate AS better, y.candidate AS worse FROM pool x JOIN pool y ON {DOM}")
def jn8(s: SparkSession, d: str) -> DataFrame:
    front = pareto.front(candidates(s, d))
    return front.select(F.explode("dominated_by").alias("better"), F.col("candidate").alias("worse"))


ENDS = "ends AS (SELECT (SELECT candidate FROM {t} ORDER BY recall DESC, precision DESC, generation, candidate LIMIT 1) AS r, (SELECT candidate FROM {t} ORDER BY precision DESC, recall DESC, generation, candidate LIMIT 1) AS p)"


def pruned_sql(members: str, cap: int) -> str:
    return f"""{ENDS.format(t=members)},
t AS (SELECT *, EXISTS (SELECT 1 FROM {members} y WHERE x.candidate <> y.candidate AND {TIE}) AS tied, candidate IN (SELECT r FROM ends UNION SELECT p FROM ends) AS safe FROM {members} x),
k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN safe THEN 3 WHEN tied THEN 1 ELSE 2 END, CASE WHEN tied AND NOT safe THEN n_flagged ELSE 0 END, generation DESC, candidate DESC) AS rk, count(*) OVER () AS size, count(*) FILTER (origin = 'filter_strip') OVER () AS strips FROM t),
pruned AS (SELECT candidate, NOT (size > {cap} AND strips * 2 >= size) AND NOT safe AND rk <= size - {cap} AS pruned, size > {cap} AND strips * 2 >= size AS halted, rk FROM k)"""


@query("PA4_prune", POOL + ",\n" + pruned_sql("pool", 8) + " SELECT candidate, pruned, halted FROM pruned")
def pa4(s: SparkSession, d: str) -> DataFrame:
    return pareto.prune(candidates(s, d), cap=8)


@query("TK2_excess_rows", POOL + ",\n" + pruned_sql("pool", 3) + " SELECT candidate FROM pruned WHERE pruned")
def tk2(s: SparkSession, d: str) -> DataFrame:
    return pareto.prune(candidates(s, d), cap=3).filter("pruned").select("candidate")


@query("PA5_termination", POOL + FRONT + f""", f AS (SELECT * FROM front WHERE on_front),
t AS (SELECT count(*) AS size, count(*) FILTER (EXISTS (SELECT 1 FROM f y WHERE x.candidate <> y.candidate AND {TIE})) AS tied FROM f x)
SELECT concat_ws(',', CASE WHEN (SELECT 150 * count(*) FROM pool) > 1650 THEN 'T2' END, CASE WHEN size > 0 AND tied * 2 >= size THEN 'T4' END) AS triggered, (SELECT 150 * count(*) FROM pool) > 1650 OR (size > 0 AND tied * 2 >= size) AS stop,
  (SELECT 150 * count(*) FROM pool) AS calls, (SELECT max(generation) FROM pool) AS generation FROM t""")
def pa5(s: SparkSession, d: str) -> DataFrame:
    pool = pareto.front(candidates(s, d))
    current = pool.select("generation", F.lit(150).cast("long").alias("calls"), F.lit(True).alias("judgeable"))
    return pareto.termination(pool.filter("on_front"), current)


@query("PA6_front_document", POOL + FRONT + ", f AS (SELECT * FROM front WHERE on_front),\n" + pruned_sql("f", 8) + f""",
keep AS (SELECT list_sort(list(candidate)) AS ids FROM pruned WHERE NOT pruned), held AS (SELECT * FROM f WHERE candidate IN (SELECT candidate FROM pruned WHERE NOT pruned)),
e2 AS (SELECT (SELECT candidate FROM held ORDER BY recall DESC, precision DESC, generation, candidate LIMIT 1) AS r, (SELECT candidate FROM held ORDER BY precision DESC, recall DESC, generation, candidate LIMIT 1) AS p)
SELECT array_to_string(ids, ',') AS front, r AS recall_end, p AS precision_end, len(ids) AS front_size,
  coalesce((SELECT string_agg(candidate || '<' || array_to_string(beaten_by, '+'), ',' ORDER BY candidate) FROM front WHERE NOT on_front), '') AS dominated,
  coalesce((SELECT string_agg(candidate, ',' ORDER BY candidate) FROM pruned WHERE pruned), '') AS pruned, array_to_string(ids, ',') <> 'c000,c001' AS front_changed,
  CASE WHEN array_to_string(ids, ',') <> 'c000,c001' THEN 0 ELSE 3 END AS stall_rounds FROM keep, e2""")
def pa6(s: SparkSession, d: str) -> DataFrame:
    doc = pareto.front_document(candidates(s, d), ["c000", "c001"], 2)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return doc.select(joined("front"), "recall_end", "precision_end", "front_size", joined("dominated"), joined("pruned"), "front_changed", "stall_rounds")


@query("PA8_admission", POOL + f""" SELECT y.candidate || '-next' AS candidate, CASE WHEN y.generation = 1 THEN 'INVALID' WHEN y.generation = 2 THEN 'UNJUDGED' WHEN {DOM} THEN 'DOMINATED' ELSE 'ON_FRONT' END AS status,
  CASE WHEN y.generation IN (1, 2) THEN 3 ELSE 0 END AS code FROM pool y, (SELECT * FROM pool WHERE candidate = 'c006') x""")
def pa8(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d)
    ends = [f"{a}_{e}" for a in pareto.AXES for e in ("lo", "hi")]
    new = c.select(F.concat("candidate", F.lit("-next")).alias("candidate"), F.lit("why").alias("origin_reason"), F.lit("m").alias("model"), F.when(F.col("generation") == 1, F.lit("h-c006")).otherwise(F.sha2("candidate", 256)).alias("prompt_sha256"), (F.col("generation") != 2).alias("gate_passed"), "recall", "precision", *ends)
    return pareto.admit(new, c.select("candidate", F.concat(F.lit("h-"), "candidate").alias("prompt_sha256"), "recall", "precision", *ends), "m", baseline="c006")


@query("PA10_unjudged", POOL + """, s AS (SELECT candidate, CASE generation WHEN 1 THEN 'UNJUDGED' WHEN 2 THEN 'INVALID' ELSE 'ON_FRONT' END AS status, n_split % 2 = 0 AS gate_passed FROM pool)
SELECT candidate FROM s WHERE status = 'UNJUDGED' OR (status <> 'INVALID' AND NOT gate_passed)""")
def pa10(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("generation") == 1, "UNJUDGED").when(F.col("generation") == 2, "INVALID").otherwise("ON_FRONT")
    return pareto.unjudged(candidates(s, d).withColumns({"status": status, "gate_passed": F.col("n_split") % 2 == 0})).select("candidate")


@query("PA12_outward", POOL + " SELECT y.candidate, y.recall >= x.recall - 1e-9 AND y.n_flagged <= x.n_flagged AND (y.recall > x.recall + 1e-9 OR y.n_flagged < x.n_flagged) AS outward FROM pool y, (SELECT * FROM pool WHERE candidate = 'c006') x")
def pa12(s: SparkSession, d: str) -> DataFrame:
    # fewer reviews are better, so that axis is negated
    c = candidates(s, d).select("candidate", "recall", (-F.col("n_flagged")).cast("double").alias("precision"))
    base = c.filter("candidate = 'c006'").agg(F.first(F.struct("recall", "precision")).alias("y"))
    return c.select("candidate", F.struct("recall", "precision").alias("x")).join(base, F.lit(True)).select("candidate", pareto.dominates("x", "y", intervals=False).alias("outward"))


@query("SP1_parents", POOL + ",\n" + ENDS.format(t="pool") + """ SELECT 'S1' AS slot, 'front_endpoint' AS origin, r AS parents FROM ends UNION ALL SELECT 'S2', CASE WHEN r = p THEN 'filter_strip' ELSE 'front_endpoint' END, p FROM ends UNION ALL SELECT 'S3', 'front_pair', r || ',' || p FROM ends""")
def sp1(s: SparkSession, d: str) -> DataFrame:
    return trials.parents(candidates(s, d)).withColumn("parents", F.array_join("parents", ","))


SIDES = POOL + f""", side AS (SELECT *, CAST(substr(candidate, 4) AS INTEGER) % 3 AS g FROM pool), against AS (SELECT y.g AS theirs, x.g AS mine, y.candidate, coalesce(bool_or({DOM}), false) AS beaten, coalesce(bool_or({DOM} OR {TIE}), false) AS met FROM side y JOIN side x ON x.g <> y.g GROUP BY ALL),
won AS (SELECT mine, theirs, bool_and(met) AND bool_or(beaten) AS dominates, bool_and(met) AS covers FROM against GROUP BY ALL)"""


@query("SP6_front_against_front", SIDES + " SELECT mine, theirs, dominates, covers FROM won")
def sp6(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d).withColumn("g", F.substring("candidate", 4, 1).cast("int") % 3)
    parts = [c.filter(F.col("g") == g).drop("g") for g in range(3)]
    out = [trials.covered(parts[a], parts[b]).select(F.lit(a).alias("mine"), F.lit(b).alias("theirs"), "dominates", "covers") for a in range(3) for b in range(3) if a != b]
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole


@query("SP6_verdict", SIDES + """, w AS (SELECT bool_or(dominates) FILTER (mine = 2 AND theirs = 0) AS over0, bool_or(dominates) FILTER (mine = 2 AND theirs = 1) AS over1, bool_or(dominates) FILTER (theirs = 2) AS under, bool_and(covers AND NOT dominates) AS level FROM won)
SELECT CASE WHEN under THEN 'V4' WHEN over0 AND over1 THEN 'V1' WHEN over0 THEN 'V2_C0' WHEN over1 THEN 'V2_C1' WHEN level THEN 'V3' ELSE 'NONE' END AS verdict FROM w""")
def sp6b(s: SparkSession, d: str) -> DataFrame:
    return trials.front_verdict(sp6(s, d), mine=2, others=(0, 1))
