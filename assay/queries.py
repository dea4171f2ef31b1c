"""Queries of the engine, keyed by operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import guards, metrics, ordered, pareto, stats, trials, votes
from .plans import views
from .plans.views import sql
from .sources import evidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ["candidate", "id", "qid", "human"]


def query(name: str, oracle: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return put


def _voted(s: SparkSession, d: str) -> DataFrame:
    return votes.majority(views.judge_runs(s, d), KEYS)


BASE = sql("units", "runs")
VOTED = sql("units", "runs", "votes")
HIT = "maj IN ('CONTRADICTED', 'INSUFFICIENT')"
BAD = "human IN ('C', 'I')"
COUNTS = f"""counts AS (
  SELECT candidate, count(*) AS n_units, count(*) FILTER ({BAD}) AS n_problem, count(*) FILTER ({HIT}) AS n_flagged,
    count(*) FILTER ({BAD} AND {HIT}) AS n_detected, count(*) FILTER ({BAD} AND maj = 'CONTRADICTED') AS n_contradicted,
    count(*) FILTER (maj = 'SPLIT') AS n_split, count(*) FILTER (maj = 'UNRESOLVED') AS n_unresolved
  FROM votes GROUP BY candidate)"""
RATE = "round_even(CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END, 4)"


# --- joins, votes, counts, rates -------------------------------------------------------


@query("JN1_runs_labels", BASE + "SELECT candidate, human, label, count(*) AS n FROM runs GROUP BY ALL")
def jn1(s: SparkSession, d: str) -> DataFrame:
    return views.judge_runs(s, d).groupBy("candidate", "human", "label").agg(F.count(F.lit(1)).alias("n"))


@query("JN2_label_consistency", sql("units") + "SELECT u.id FROM units u JOIN labels l USING (doc_id) WHERE u.human IS NOT NULL AND (u.human = 'C') <> (l.toxic = 1)")
def jn2(s: SparkSession, d: str) -> DataFrame:
    labels = views.read(s, d, "labels").select("doc_id", "toxic")
    return views.units(s, d).join(labels, "doc_id").filter((F.col("human") == "C") != (F.col("toxic") == 1)).select("id")


@query("JN2_checked_join", BASE + "SELECT candidate, human, count(*) AS n FROM runs WHERE human <> 'S' GROUP BY ALL")
def jn2b(s: SparkSession, d: str) -> DataFrame:
    """Runs met with the sheet; were a label different, the job would end there."""
    sheet = views.units(s, d).select("id", F.col("human").alias("sheet_human"))
    met = guards.consistent(views.judge_runs(s, d).filter("human <> 'S'"), sheet)
    return met.groupBy("candidate", F.col("sheet_human").alias("human")).agg(F.count(F.lit(1)).alias("n"))


@query("JN5_pairing", VOTED + "SELECT a.id, a.human, a.maj AS a, b.maj AS b FROM votes a JOIN votes b ON a.id = b.id WHERE a.candidate = 'c005' AND b.candidate = 'c006'")
def jn5(s: SparkSession, d: str) -> DataFrame:
    v = _voted(s, d).filter(F.col("candidate").isin("c005", "c006"))
    side = lambda c: F.max(F.when(F.col("candidate") == c, F.col("maj")))
    return v.groupBy("id", "human").agg(side("c005").alias("a"), side("c006").alias("b"))


@query("JN6_siblings", sql("units") + "SELECT a.id, count(b.id) AS n_siblings FROM units a LEFT JOIN units b ON a.qid = b.qid AND a.arm = b.arm AND a.id <> b.id GROUP BY a.id")
def jn6(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d)
    return u.join(u.groupBy("qid", "arm").agg(F.count(F.lit(1)).alias("n")), ["qid", "arm"]).select("id", (F.col("n") - 1).alias("n_siblings"))


@query("JN11_resume_todo", BASE + "SELECT DISTINCT u.id FROM units u WHERE u.id NOT IN (SELECT id FROM runs WHERE candidate = 'c000' AND label = 'UNRESOLVED')")
def jn11(s: SparkSession, d: str) -> DataFrame:
    done = views.judge_runs(s, d).filter("candidate = 'c000' and label = 'UNRESOLVED'").select("id")
    return views.units(s, d).select("id").join(done, "id", "left_anti")


@query("JN12_exploratory_flag", sql("units") + "SELECT id, CASE WHEN qid IN (SELECT qid FROM units WHERE doc_id % 7 = 0) THEN 'exploratory' ELSE 'confirmatory' END AS part FROM units")
def jn12(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d)
    seen = u.filter("doc_id % 7 = 0").select("qid").distinct().withColumn("seen", F.lit(True))
    return u.join(seen, "qid", "left").select("id", F.when(F.col("seen"), "exploratory").otherwise("confirmatory").alias("part"))


@query("JN16_pivot", BASE + "SELECT id, max(label) FILTER (run = 1) AS r1, max(label) FILTER (run = 2) AS r2, max(label) FILTER (run = 3) AS r3 FROM runs WHERE candidate = 'c000' GROUP BY id")
def jn16(s: SparkSession, d: str) -> DataFrame:
    r = views.judge_runs(s, d).filter("candidate = 'c000'")
    return r.groupBy("id").pivot("run", [1, 2, 3]).agg(F.max("label")).toDF("id", "r1", "r2", "r3")


VERSIONS = """said AS (SELECT id, candidate, CASE label WHEN 'SUPPORTED' THEN 'S' WHEN 'CONTRADICTED' THEN 'C' WHEN 'INSUFFICIENT' THEN 'I' ELSE 'U' END AS short FROM runs WHERE run = 1 AND candidate IN ('c000', 'c001', 'c002') AND NOT (candidate = 'c001' AND doc_id % 7 = 0) AND NOT (candidate = 'c002' AND doc_id % 5 = 0))"""


@query("JN16_versions", BASE.rstrip() + ",\n" + VERSIONS + """, w AS (SELECT u.id, u.human, """ + ", ".join(f"coalesce(max(short) FILTER (candidate = 'c00{i}'), 'U') AS v{i + 1}" for i in range(3)) + """ FROM units u LEFT JOIN said USING (id) GROUP BY ALL)
SELECT *, CASE WHEN v1 = v2 OR v1 = v3 THEN v1 WHEN v2 = v3 THEN v2 ELSE 'U' END AS ensemble FROM w""")
def jn16b(s: SparkSession, d: str) -> DataFrame:
    """Labels of three versions and of their ensemble beside each unit; what a version lacks is U."""
    runs = views.judge_runs(s, d).filter("run = 1").select("candidate", "id", "doc_id", votes.short().alias("short"))
    lacks = {"c000": F.lit(False), "c001": F.col("doc_id") % 7 == 0, "c002": F.col("doc_id") % 5 == 0}
    said = runs.filter(F.col("candidate").isin(*lacks)).filter(~F.when(F.col("candidate") == "c001", lacks["c001"]).when(F.col("candidate") == "c002", lacks["c002"]).otherwise(False))
    return votes.versions(views.units(s, d).select("id", "human"), said, "id", "candidate", "short", {"c000": "v1", "c001": "v2", "c002": "v3"})


@query("AG2_majority", VOTED + "SELECT candidate, id, maj FROM votes")
def ag2(s: SparkSession, d: str) -> DataFrame:
    return _voted(s, d).select("candidate", "id", "maj")


@query("AG3_most_common", sql("units", "runs") + "SELECT candidate, id, label AS maj FROM (SELECT *, row_number() OVER (PARTITION BY candidate, id ORDER BY n DESC, label) AS rk FROM (SELECT candidate, id, label, count(*) AS n FROM runs GROUP BY ALL)) WHERE rk = 1")
def ag3(s: SparkSession, d: str) -> DataFrame:
    return votes.first_most_common(views.judge_runs(s, d), ["candidate", "id"])


@query("AG4_three_run", BASE + """SELECT candidate, id, CASE WHEN count(*) < 3 THEN 'incomplete' WHEN count(*) FILTER (label = 'UNRESOLVED') > 0 THEN 'unresolved'
  WHEN count(*) FILTER (label = 'CONTRADICTED') >= 2 THEN 'CONTRADICTED' WHEN count(*) FILTER (label = 'INSUFFICIENT') >= 2 THEN 'INSUFFICIENT'
  WHEN count(*) FILTER (label = 'SUPPORTED') >= 2 THEN 'SUPPORTED' ELSE 'split' END AS outcome FROM runs GROUP BY candidate, id""")
def ag4(s: SparkSession, d: str) -> DataFrame:
    return votes.three_run(views.judge_runs(s, d), ["candidate", "id"], "doc_id")


FLAG = "label IN ('CONTRADICTED', 'INSUFFICIENT')"
DECIDED = f"""decided AS (SELECT candidate, id, human,
  CASE WHEN NOT bool_or({FLAG}){{strict}} THEN 'PASS' WHEN bool_and({FLAG}) THEN 'FLAGGED' ELSE 'INDETERMINATE' END AS decision FROM runs GROUP BY ALL)"""
STRICT = DECIDED.format(strict=" AND bool_and(label <> 'UNRESOLVED')")


@query("AG5_consensus_strict", BASE.rstrip() + ",\n" + STRICT + " SELECT candidate, id, decision FROM decided")
def ag5(s: SparkSession, d: str) -> DataFrame:
    return votes.consensus(views.judge_runs(s, d), ["candidate", "id"])


@query("AG5_consensus_open", BASE.rstrip() + ",\n" + DECIDED.format(strict="") + " SELECT candidate, id, decision FROM decided")
def ag5b(s: SparkSession, d: str) -> DataFrame:
    return votes.consensus(views.judge_runs(s, d), ["candidate", "id"], strict=False)


@query("AG6_ensembles", BASE + f"""SELECT candidate, rule, count(*) FILTER (flagged) AS n_flagged FROM (
  SELECT candidate, id, unnest(['all_of_3', 'any_of_3', 'single_run_1', 'two_of_3']) AS rule,
    unnest([count(*) FILTER ({FLAG}) >= 3, count(*) FILTER ({FLAG}) >= 1, bool_or({FLAG} AND run = 1), count(*) FILTER ({FLAG}) >= 2]) AS flagged
  FROM runs GROUP BY candidate, id) GROUP BY ALL""")
def ag6(s: SparkSession, d: str) -> DataFrame:
    e = votes.ensembles(views.judge_runs(s, d), ["candidate", "id"])
    return e.groupBy("candidate", "rule").agg(F.count(F.when(F.col("flagged"), 1)).alias("n_flagged"))


PROBE = sql("units") + """, probe AS (SELECT id, human, run, CASE WHEN (doc_id * 31 + run * (doc_id % 5) * 3) % 10 < 5 THEN 'YES' ELSE 'NO' END AS vote
  FROM units, (SELECT unnest(range(1, 4)) AS run))"""


def _probe(s: SparkSession, d: str) -> DataFrame:
    p = views.units(s, d).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(3))))
    yes = (F.col("doc_id") * 31 + F.col("run") * (F.col("doc_id") % 5) * 3) % 10 < 5
    return p.withColumn("vote", F.when(yes, "YES").otherwise("NO"))


@query("AG7_probe_votes", PROBE + """SELECT id, count(*) FILTER (vote = 'YES') AS yes, count(*) FILTER (vote = 'YES') >= 3 AS hit,
  CASE count(*) FILTER (vote = 'YES') WHEN 3 THEN 'all_yes' WHEN 0 THEN 'all_no' ELSE 'split' END AS kind FROM probe GROUP BY id""")
def ag7(s: SparkSession, d: str) -> DataFrame:
    return votes.probe(_probe(s, d), ["id"], 3)


@query("AG8_instability", BASE + "SELECT candidate, id, count(DISTINCT label) AS n_labels, count(DISTINCT label) > 1 AS unstable FROM runs GROUP BY ALL")
def ag8(s: SparkSession, d: str) -> DataFrame:
    return votes.stability(views.judge_runs(s, d), ["candidate", "id"])


@query("AG9_counts", VOTED.rstrip() + ",\n" + COUNTS + " SELECT * FROM counts")
def ag9(s: SparkSession, d: str) -> DataFrame:
    return metrics.counts(_voted(s, d), ["candidate"])


RATES = f"SELECT candidate, n_detected, {RATE.format(a='n_detected', b='n_problem')} AS recall, {RATE.format(a='n_detected', b='n_flagged')} AS precision FROM counts"


@query("AG10_rates", VOTED.rstrip() + ",\n" + COUNTS + " " + RATES)
def ag10(s: SparkSession, d: str) -> DataFrame:
    return metrics.rates(metrics.counts(_voted(s, d), ["candidate"])).select("candidate", "n_detected", "recall", "precision")


SAID = "CASE maj WHEN 'SUPPORTED' THEN 'S' WHEN 'CONTRADICTED' THEN 'C' WHEN 'INSUFFICIENT' THEN 'I' ELSE 'U' END"


def _said(s: SparkSession, d: str) -> DataFrame:
    return _voted(s, d).withColumn("said", votes.short("maj"))


@query("AG11_per_class", VOTED.rstrip() + f""", said AS (SELECT candidate, human, {SAID} AS said FROM votes),
sides AS (SELECT candidate, unnest(['S', 'C', 'I', 'gate']) AS class, unnest([human = 'S', human = 'C', human = 'I', {BAD}]) AS h,
  unnest([said = 'S', said = 'C', said = 'I', said IN ('C', 'I')]) AS s FROM said),
n AS (SELECT candidate, class, count(*) FILTER (h AND s) AS tp, count(*) FILTER (NOT h AND s) AS fp, count(*) FILTER (h AND NOT s) AS fn FROM sides GROUP BY ALL)
SELECT *, {RATE.format(a='tp', b='(tp + fp)')} AS precision, {RATE.format(a='tp', b='(tp + fn)')} AS recall FROM n""")
def ag11(s: SparkSession, d: str) -> DataFrame:
    return metrics.per_class(_said(s, d), ["candidate"])


@query("AG14_confusion", VOTED + f"SELECT candidate, human, {SAID} AS said, count(*) AS n FROM votes GROUP BY ALL")
def ag14(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_said(s, d), ["candidate"])


@query("AG15_group_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def ag15(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("AG16_distinct", sql("units") + "SELECT arm, count(DISTINCT qid) AS n_qid, count(DISTINCT human) AS n_human FROM units GROUP BY arm")
def ag16(s: SparkSession, d: str) -> DataFrame:
    return views.units(s, d).groupBy("arm").agg(F.count_distinct("qid").alias("n_qid"), F.count_distinct("human").alias("n_human"))


@query("AG18_median", "SELECT event_type, round_even(median(value), 4) AS median_value FROM events GROUP BY event_type")
def ag18(s: SparkSession, d: str) -> DataFrame:
    q = ordered.quantiles(views.read(s, d, "events"), ["event_type"], "value", {"median_value": 0.5})
    return q.select("event_type", F.bround("median_value", 4).alias("median_value"))


@query("AG19_percentile", "SELECT event_type, round_even(quantile_cont(value, 0.025), 6) AS lo, round_even(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def ag19(s: SparkSession, d: str) -> DataFrame:
    q = ordered.quantiles(views.read(s, d, "events"), ["event_type"], "value", {"lo": 0.025, "hi": 0.975})
    return q.select("event_type", F.bround("lo", 6).alias("lo"), F.bround("hi", 6).alias("hi"))


ROLL = f"""roll AS (SELECT candidate, count(*) FILTER (decision <> 'INDETERMINATE') AS auto_n, count(*) FILTER (decision = 'INDETERMINATE') AS review_n,
  count(*) FILTER (decision = 'FLAGGED' AND {BAD}) AS tp, count(*) FILTER (decision = 'FLAGGED' AND NOT {BAD}) AS fp,
  count(*) FILTER (decision = 'PASS' AND {BAD}) AS fn, count(*) FILTER (decision = 'PASS' AND NOT {BAD}) AS tn,
  count(*) FILTER (decision = 'INDETERMINATE' AND {BAD}) AS review_problem FROM decided GROUP BY candidate)"""


@query("AG20_gate_roll_up", BASE.rstrip() + ",\n" + STRICT + ",\n" + ROLL + f""" SELECT *, {RATE.format(a='(tp + review_problem)', b='(tp + fn + review_problem)')} AS recall_with_review,
  {RATE.format(a='review_n', b='(auto_n + review_n)')} AS review_rate, {RATE.format(a='review_problem', b='review_n')} AS review_yield, {RATE.format(a='(tp + tn)', b='auto_n')} AS accuracy FROM roll""")
def ag20(s: SparkSession, d: str) -> DataFrame:
    return metrics.roll_up(votes.consensus(views.judge_runs(s, d), ["candidate", "id", "human"]), ["candidate"])


@query("AG21_lift", PROBE + f""", p AS (SELECT id, human, count(*) FILTER (vote = 'YES') AS yes FROM probe GROUP BY ALL)
SELECT count(*) FILTER (yes >= 1) AS routed, count(*) FILTER (yes >= 1 AND {BAD}) AS hits,
  round_even((count(*) FILTER (yes >= 1 AND {BAD}))::DOUBLE / (count(*) FILTER (yes >= 1))::DOUBLE / ((count(*) FILTER ({BAD}))::DOUBLE / count(*)::DOUBLE), 4) AS lift FROM p""")
def ag21(s: SparkSession, d: str) -> DataFrame:
    p = votes.probe(_probe(s, d), ["id", "human"], 1)
    n = p.agg(F.count(F.lit(1)).alias("n"), metrics.number(metrics.problem()).alias("bad"), metrics.number(F.col("hit")).alias("routed"), metrics.number(F.col("hit") & metrics.problem()).alias("hits"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return n.select("routed", "hits", F.bround(F.try_divide(rate("hits", "routed"), rate("bad", "n")), 4).alias("lift"))


@query("AG21_net_effect", BASE.rstrip() + f""", v AS (SELECT id, doc_id, human, count(*) FILTER (label IN ('CONTRADICTED', 'INSUFFICIENT')) AS hits, count(*) AS n FROM runs WHERE candidate = 'c004' GROUP BY ALL),
r AS (SELECT human, CASE WHEN doc_id % 9 = 0 THEN 'REVIEW' WHEN hits = n THEN 'FLAGGED' ELSE 'PASS' END AS off, doc_id % 4 = 0 AS yes FROM v),
o AS (SELECT human, off, CASE WHEN off = 'PASS' AND yes THEN 'REVIEW' ELSE off END AS probed FROM r),
c AS (SELECT count(*) FILTER (off = 'REVIEW') AS review_off, count(*) FILTER (probed = 'REVIEW') AS review_on, count(*) FILTER ({BAD} AND off <> 'PASS') AS caught_off, count(*) FILTER ({BAD} AND probed <> 'PASS') AS caught_on, count(*) FILTER ({BAD}) AS problems FROM o)
SELECT *, review_on - review_off AS more_review, caught_on - caught_off AS more_caught, {RATE.format(a='caught_off', b='problems')} AS recall_off, {RATE.format(a='caught_on', b='problems')} AS recall_on FROM c""")
def ag21b(s: SparkSession, d: str) -> DataFrame:
    """What a probe of what would pass costs in reviews and brings in problems caught."""
    v = views.judge_runs(s, d).filter("candidate = 'c004'").groupBy("id", "doc_id", "human").agg(F.bool_and(votes.flagged("label")).alias("all_flagged"))
    u = v.select("human", (F.col("doc_id") % 9 == 0).alias("review"), "all_flagged", (F.col("doc_id") % 4 == 0).alias("yes"))
    return metrics.net_effect(u)


@query("AG25_flips", VOTED + f""", p AS (SELECT a.human, {SAID.replace('maj', 'a.maj')} AS a, {SAID.replace('maj', 'b.maj')} AS b FROM votes a JOIN votes b ON a.id = b.id WHERE a.candidate = 'c005' AND b.candidate = 'c006')
SELECT count(*) FILTER (a <> human AND b = human) AS improve, count(*) FILTER (a = human AND b <> human) AS worsen, count(*) FILTER (a <> b AND a <> human AND b <> human) AS other, count(*) AS n FROM p""")
def ag25(s: SparkSession, d: str) -> DataFrame:
    p = jn5(s, d).withColumns({"a": votes.short("a"), "b": votes.short("b")})
    return metrics.flips(p, [])


@query("AG26_rates_by_unit_and_cluster", sql("units") + f"SELECT arm, count(*) AS n, count(*) FILTER ({BAD}) AS bad, count(DISTINCT qid) AS n_qid, count(DISTINCT CASE WHEN {BAD} THEN qid END) AS bad_qid FROM units GROUP BY arm")
def ag26(s: SparkSession, d: str) -> DataFrame:
    return views.units(s, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), metrics.number(metrics.problem()).alias("bad"), F.count_distinct("qid").alias("n_qid"), F.count_distinct(F.when(metrics.problem(), F.col("qid"))).alias("bad_qid"))


@query("AG31_diagnostics", VOTED + f"SELECT candidate, id, CASE WHEN {BAD} AND NOT {HIT} THEN 'miss' WHEN NOT ({BAD}) AND {HIT} THEN 'false_alarm' ELSE 'split' END AS kind FROM votes WHERE ({BAD} AND NOT {HIT}) OR (NOT ({BAD}) AND {HIT}) OR maj = 'SPLIT'")
def ag31(s: SparkSession, d: str) -> DataFrame:
    """Misses, false alarms and other splits, a row each: the lists grow with the units."""
    return metrics.diagnostics(_voted(s, d), ["candidate", "id"])


# --- statistics ------------------------------------------------------------------------

WILSON = """CASE WHEN n = 0 THEN {edge} ELSE {best}((k / n + {z} * {z} / (2 * n) {sign} {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n), {edge}) END"""


@query("SA1_wilson", VOTED.rstrip() + ",\n" + COUNTS + ", w AS (SELECT candidate, CAST(n_detected AS DOUBLE) AS k, CAST(n_problem AS DOUBLE) AS n FROM counts) SELECT candidate, round_even(" + WILSON.format(edge="0.0", best="greatest", sign="-", z="1.96e0") + ", 6) AS lo, round_even(" + WILSON.format(edge="1.0", best="least", sign="+", z="1.96e0") + ", 6) AS hi FROM w")
def sa1(s: SparkSession, d: str) -> DataFrame:
    w = stats.wilson(F.col("n_detected"), F.col("n_problem"))
    return metrics.counts(_voted(s, d), ["candidate"]).select("candidate", F.bround(w["lo"], 6).alias("lo"), F.bround(w["hi"], 6).alias("hi"))


@query("SA1_wilson_precise", VOTED.rstrip() + ",\n" + COUNTS + ", w AS (SELECT candidate, CAST(n_detected AS DOUBLE) AS k, CAST(n_problem AS DOUBLE) AS n FROM counts) SELECT candidate, round_even(" + WILSON.format(edge="0.0", best="greatest", sign="-", z="1.959963985e0") + ", 6) AS lo, round_even(" + WILSON.format(edge="1.0", best="least", sign="+", z="1.959963985e0") + ", 6) AS hi FROM w")
def sa1b(s: SparkSession, d: str) -> DataFrame:
    w = stats.wilson(F.col("n_detected"), F.col("n_problem"), stats.Z_PRECISE)
    return metrics.counts(_voted(s, d), ["candidate"]).select("candidate", F.bround(w["lo"], 6).alias("lo"), F.bround(w["hi"], 6).alias("hi"))


@query("SA2_mcnemar", VOTED + f""", p AS (SELECT b.candidate, count(*) FILTER (a.maj <> 'SUPPORTED' AND b.maj = 'SUPPORTED') AS b, count(*) FILTER (a.maj = 'SUPPORTED' AND b.maj <> 'SUPPORTED') AS c
  FROM votes a JOIN votes b ON a.id = b.id WHERE a.candidate = 'c000' AND b.candidate <> 'c000' AND a.human <> 'S' GROUP BY b.candidate)
SELECT candidate, b, c, round_even(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)) FOR i IN range(least(b, c) + 1)])) END, 6) AS p FROM p""")
def sa2(s: SparkSession, d: str) -> DataFrame:
    v = _voted(s, d).filter("human <> 'S'")
    a = v.filter("candidate = 'c000'").select("id", F.col("maj").alias("a"))
    p = v.filter("candidate <> 'c000'").join(a, "id")
    ok = lambda c: F.col(c) == "SUPPORTED"
    p = p.groupBy("candidate").agg(metrics.number(~ok("a") & ok("maj")).alias("b"), metrics.number(ok("a") & ~ok("maj")).alias("c"))
    return p.withColumn("p", F.bround(stats.mcnemar(F.col("b"), F.col("c")), 6))


# --- fronts and ledger -----------------------------------------------------------------

CANDIDATES = VOTED.rstrip() + ",\n" + COUNTS + f""", candidates AS (SELECT candidate, n_flagged, CAST(substr(candidate, 2) AS INTEGER) // 3 AS generation, 'front_pair' AS origin,
  {RATE.format(a='n_detected', b='n_problem')} AS recall, {RATE.format(a='n_detected', b='n_flagged')} AS precision FROM counts),
pool AS (SELECT * FROM candidates WHERE recall IS NOT NULL AND precision IS NOT NULL)"""


def _candidates(s: SparkSession, d: str) -> DataFrame:
    c = metrics.rates(metrics.counts(_voted(s, d), ["candidate"]))
    generation = F.floor(F.substring("candidate", 2, 3).cast("int") / 3).cast("int")
    c = c.select("candidate", "n_flagged", generation.alias("generation"), F.lit("front_pair").alias("origin"), "recall", "precision", F.lit(None).cast("string").alias("status"), F.lit(True).alias("gate_passed"))
    return pareto.judgeable(c)


DOMINATES = "x.recall >= y.recall - 1e-9 AND x.precision >= y.precision - 1e-9 AND (x.recall > y.recall + 1e-9 OR x.precision > y.precision + 1e-9)"


@query("TK1_endpoints", CANDIDATES + " SELECT (SELECT candidate FROM pool ORDER BY recall DESC, precision DESC, generation, candidate LIMIT 1) AS recall, (SELECT candidate FROM pool ORDER BY precision DESC, recall DESC, generation, candidate LIMIT 1) AS precision")
def tk1(s: SparkSession, d: str) -> DataFrame:
    return pareto.endpoints(_candidates(s, d))


@query("VA12_sample_gate", VOTED.rstrip() + ",\n" + COUNTS + """, r AS (SELECT candidate, count(DISTINCT run) AS n_runs, count(*) AS n_rows, count(*) FILTER (label = 'UNRESOLVED') AS u FROM runs GROUP BY candidate)
SELECT candidate, concat_ws(',', CASE WHEN n_problem < 8 THEN 'R1' END, CASE WHEN n_flagged < 5 THEN 'R2' END, CASE WHEN n_runs <> 3 THEN 'R3' END,
  CASE WHEN greatest(n_unresolved::DOUBLE / n_units, u::DOUBLE / n_rows) >= 0.1 THEN 'R4' END, CASE WHEN n_split::DOUBLE / n_units >= 0.2 THEN 'R5' END) AS violations FROM counts JOIN r USING (candidate)""")
def va12(s: SparkSession, d: str) -> DataFrame:
    raw = views.judge_runs(s, d).groupBy("candidate").agg(F.count_distinct("run").alias("n_runs"), F.count(F.lit(1)).alias("n_rows"), metrics.number(F.col("label") == "UNRESOLVED").alias("n_raw_unresolved"))
    return pareto.gate_violations(metrics.counts(_voted(s, d), ["candidate"]).join(raw, "candidate")).select("candidate", "violations")


@query("WN1_latest_state", sql("ledger") + "SELECT candidate, max(seq) AS seq, arg_max(status, seq) AS status FROM ledger GROUP BY candidate")
def wn1(s: SparkSession, d: str) -> DataFrame:
    return pareto.latest(views.ledger(s, d)).select("candidate", "seq", "status")


@query("PA7_transitions", sql("ledger") + """, l AS (SELECT candidate, arg_max(status, seq) AS status FROM ledger GROUP BY candidate)
SELECT candidate, status AS before, 'ON_FRONT' AS status FROM l WHERE status NOT IN ('PRUNED', 'INVALID', 'ON_FRONT')""")
def pa7(s: SparkSession, d: str) -> DataFrame:
    current = pareto.latest(views.ledger(s, d))
    return pareto.transitions(current, current.select("candidate", F.lit("ON_FRONT").alias("status")))


@query("WN11_stalls", """WITH r AS (SELECT CAST(o_orderkey % 50 AS BIGINT) AS round, CAST(count(*) % 3 AS VARCHAR) AS front FROM orders GROUP BY 1),
l AS (SELECT *, coalesce(lag(front) OVER (ORDER BY round) = front, false) AS same FROM r), i AS (SELECT *, sum((NOT same)::INT) OVER (ORDER BY round) AS island FROM l)
SELECT round, front, CAST(row_number() OVER (PARTITION BY island ORDER BY round) - 1 AS INTEGER) AS stall FROM i""")
def wn11(s: SparkSession, d: str) -> DataFrame:
    r = views.read(s, d, "orders").groupBy((F.col("o_orderkey") % 50).cast("long").alias("round")).agg((F.count(F.lit(1)) % 3).cast("string").alias("front"))
    return pareto.stalls(r)


# --- sampling and ordered selection ----------------------------------------------------


@query("WN2_cap_per_group", sql("units") + "SELECT id FROM (SELECT id, human, row_number() OVER (PARTITION BY qid ORDER BY sha256('7' || id)) AS rk FROM units) WHERE rk <= 2 OR human = 'C'")
def wn2(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d).select("id", "qid", "human", F.sha2(F.concat(F.lit("7"), F.col("id")), 256).alias("h"))
    # the cap alone lets each task keep two rows of a group; the exempt are added after it
    capped = u.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("h"))).filter("rk <= 2").select("id")
    return capped.union(u.filter("human = 'C'").select("id")).distinct()


@query("WN3_stratum_quota", sql("units") + "SELECT human, id FROM (SELECT *, row_number() OVER (PARTITION BY human ORDER BY sha256('7' || id)) AS rk FROM units) WHERE rk <= 5")
def wn3(s: SparkSession, d: str) -> DataFrame:
    """Five of each label; a label with fewer ends the job."""
    u = views.units(s, d).select("human", "id")
    return guards.quota(u, trials.sample(u, "id", "7", "human", 5), "human", ("S", "C", "I"), 5)


@query("WN4_round_robin", sql("units") + """, f AS (SELECT id, arm, qid, 0 AS forced FROM units WHERE human = 'C' AND doc_id % 50 = 7), g AS (SELECT qid, count(*) AS n FROM f GROUP BY qid),
r AS (SELECT u.id, u.arm, u.qid, CASE u.human WHEN 'I' THEN 0 ELSE 1 END AS layer, row_number() OVER (PARTITION BY u.qid ORDER BY CASE u.human WHEN 'I' THEN 0 ELSE 1 END, u.id) AS r FROM units u WHERE u.id NOT IN (SELECT id FROM f)),
k AS (SELECT r.id, r.arm, row_number() OVER (ORDER BY r.r, r.qid) AS rk FROM r LEFT JOIN g USING (qid) WHERE r.r + coalesce(g.n, 0) <= 8)
SELECT id, arm FROM f UNION ALL SELECT id, arm FROM k WHERE rk <= 80 - (SELECT count(*) FROM f)""")
def wn4(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d).withColumn("layer", F.when(F.col("human") == "I", 0).otherwise(1))
    return trials.round_robin(u, (F.col("human") == "C") & (F.col("doc_id") % 50 == 7), "qid", ["layer", "id"], 8, 80).select("id", "arm")


@query("ST_set_operations", sql("units") + """SELECT 'union' AS op, count(*) AS n FROM (SELECT qid FROM units WHERE human = 'C' UNION SELECT qid FROM units WHERE human = 'I')
UNION ALL SELECT 'intersect', count(*) FROM (SELECT qid FROM units WHERE human = 'C' INTERSECT SELECT qid FROM units WHERE human = 'I')
UNION ALL SELECT 'except', count(*) FROM (SELECT qid FROM units WHERE human = 'C' EXCEPT SELECT qid FROM units WHERE human = 'I')""")
def st(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d)
    c, i = (u.filter(F.col("human") == h).select("qid") for h in "CI")
    n = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(c.union(i).distinct(), "union").union(n(c.intersect(i), "intersect")).union(n(c.subtract(i), "except"))


# --- text, evidence, documents ---------------------------------------------------------


@query("SRC7_evidence_records", sql("evidence") + r"SELECT question_id, regexp_extract(raw, '^\[([0-9]{3,4})', 1) AS standard, regexp_extract(raw, '문단 ([0-9]+[A-Za-z]?)\]', 1) AS paragraph, sha256(trim(regexp_replace(raw, '^\[[^\]]*\] ', ''))) AS content_sha256 FROM evidence")
def src7(s: SparkSession, d: str) -> DataFrame:
    return evidence.records(views.evidence(s, d).select("question_id", "raw"), "raw").drop("body")


@query("SRC7_mixed_headers", sql("evidence", "bundles") + rf""", r AS (SELECT question_id, regexp_extract(standard, '[0-9]{{3,4}}') AS other, regexp_extract_all(raw, '{evidence.HEADER}') AS heads, string_split_regex(raw, '{evidence.HEADER.replace("(", "(?:")}') AS parts FROM bundles),
f AS (SELECT question_id, other, unnest(heads) AS head, unnest(parts[2:]) AS body FROM r)
SELECT question_id, CASE WHEN regexp_extract(head, '{evidence.HEADER}', 1) <> '' THEN regexp_extract(head, '{evidence.HEADER}', 1) WHEN other <> '' THEN other ELSE 'UNKNOWN' END AS standard, regexp_extract(head, '{evidence.HEADER}', 2) AS paragraph, sha256(trim(body)) AS content_sha256 FROM f""")
def src7b(s: SparkSession, d: str) -> DataFrame:
    """Headers with and without a standard, brackets within bodies, texts without a header."""
    return evidence.records(views.bundles(s, d).withColumnRenamed("standard", "_own"), "raw", F.col("_own")).drop("body", "_own")


@query("FN6_contains_quote", sql("evidence") + r"SELECT question_id, trim(regexp_replace(quote, '[\s]+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(raw, '[\s]+', ' ', 'g')), trim(regexp_replace(quote, '[\s]+', ' ', 'g'))) AS found FROM evidence")
def fn6(s: SparkSession, d: str) -> DataFrame:
    return views.evidence(s, d).select("question_id", text.contains_quote(F.col("raw"), F.col("quote")).alias("found"))


SHAPES = """CASE doc_id % 7 WHEN 0 THEN s || ' 문단 ' || p WHEN 1 THEN s || ' 문단 ' || p || '-(' || q || ')' WHEN 2 THEN '[' || s || ' 재고자산 문단 ' || p || 'A]' WHEN 3 THEN 'K-IFRS ' || s || ' 문단 ' || p || '(' || q || ')'
  WHEN 4 THEN s || ' 문단 ' || p || ' – (가)' WHEN 5 THEN s || ' 문단 ' || p || '-' || (p + 1) ELSE 'see page ' || p END || ' ' || coalesce(source, '')"""
CITATION_SQL = r"([0-9]{3,4})\s*[^0-9\[\]]*?문단\s*([0-9]+[A-Za-z]?)\s*(?:[-–]\s*)?(?:\(([^)]{1,12})\))?"


@query("FN3_citation", f"WITH n AS (SELECT doc_id, source, CAST(1001 + doc_id % 9 AS VARCHAR) AS s, 1 + doc_id % 97 AS p, doc_id % 5 AS q FROM documents), c AS (SELECT doc_id, {SHAPES} AS cite FROM n) SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(cite, '{CITATION_SQL}', {i}), '') AS {n}" for i, n in enumerate(("standard", "paragraph", "subitem"), 1)) + " FROM c")
def fn3(s: SparkSession, d: str) -> DataFrame:
    n = views.read(s, d, "documents").select("doc_id", "source", F.expr("cast(1001 + doc_id % 9 as string)").alias("s"), F.expr("1 + doc_id % 97").alias("p"), F.expr("doc_id % 5").alias("q"))
    c = text.citation(F.expr(SHAPES))
    return n.select("doc_id", *[c[k].alias(k) for k in ("standard", "paragraph", "subitem")])


@query("FN21_literal_counts", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the FROM documents")
def fn21(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "documents").select("doc_id", text.occurrences(F.col("text"), "the").alias("n_the"))


@query("SRC9_page_profile", "SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<h[1-6]')) AS headings, len(string_split(html, chr(10))) AS lines FROM pages")
def src9(s: SparkSession, d: str) -> DataFrame:
    p = views.read(s, d, "pages")
    return p.select("page_id", *[F.regexp_count("html", F.lit(x)).cast("long").alias(n) for x, n in (("<a ", "links"), ("<h[1-6]", "headings"))], F.size(F.split("html", "\n", -1)).cast("long").alias("lines"))


@query("HS1_sha256", "SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents")
def hs1(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))


@query("PRJ1_id_parts", sql("units") + "SELECT id, split_part(id, '-', 1) AS qid, regexp_replace(id, '-[^-]*$', '') AS answer, split_part(id, '-', 3) AS claim FROM units")
def prj1(s: SparkSession, d: str) -> DataFrame:
    return views.units(s, d).select("id", F.split("id", "-")[0].alias("qid"), F.regexp_replace("id", "-[^-]*$", "").alias("answer"), F.element_at(F.split("id", "-"), -1).alias("claim"))


@query("PRJ2_recode", BASE + f"SELECT {SAID.replace('maj', 'label')} AS short, count(*) AS n FROM runs GROUP BY 1")
def prj2(s: SparkSession, d: str) -> DataFrame:
    return views.judge_runs(s, d).groupBy(votes.short().alias("short")).agg(F.count(F.lit(1)).alias("n"))
