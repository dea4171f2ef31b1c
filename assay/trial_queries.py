"""Queries of trials, fronts, sources and resumed runs, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import metrics, pareto, stats, trials, votes
from .plans import views
from .plans.views import sql
from .queries import BAD, BASE, COUNTS, HIT, VOTED, WILSON, _voted, query
from .sources import files
from .streaming import runs as streams
from .plans.shared import folder, table
from .study_queries import _n

LO, HI = WILSON.format(edge="0.0", best="greatest", sign="-", z="1.96e0"), WILSON.format(edge="1.0", best="least", sign="+", z="1.96e0")


# --- statistics and trials -------------------------------------------------------------


PAIRED = VOTED.rstrip() + ",\n" + COUNTS + f", w AS (SELECT candidate, k, n, {LO} AS lo, {HI} AS hi FROM (SELECT candidate, n_detected::DOUBLE AS k, n_problem::DOUBLE AS n FROM counts))"


@query("SA10_power_grid", PAIRED + " SELECT a.candidate AS a, b.candidate AS b, a.lo > b.hi AS apart FROM w a JOIN w b ON a.candidate <> b.candidate")
def sa10(s: SparkSession, d: str) -> DataFrame:
    """Which measured rates are apart with their whole intervals, for every pair of candidates."""
    return _rate_pairs(s, d).select("a", "b", "apart")


def _rate_pairs(s: SparkSession, d: str) -> DataFrame:
    c = metrics.counts(_voted(s, d), ["candidate"]).select("candidate", "n_detected", "n_problem", stats.wilson(F.col("n_detected"), F.col("n_problem")).alias("w"))
    p = pareto.pairs(table(c, "rates"), table(c, "rates"), F.col("x.candidate") != F.col("y.candidate"))
    gap = F.try_divide(F.col("x.n_detected").cast("double"), F.col("x.n_problem").cast("double")) - F.try_divide(F.col("y.n_detected").cast("double"), F.col("y.n_problem").cast("double"))
    return p.select(F.col("x.candidate").alias("a"), F.col("y.candidate").alias("b"), (F.col("x.w.lo") > F.col("y.w.hi")).alias("apart"), F.bround(gap, 6).alias("gap"))


@query("TK4_least_separating_gap", PAIRED + " SELECT a, b, gap FROM (SELECT a.candidate AS a, b.candidate AS b, round_even(a.k / a.n - b.k / b.n, 6) AS gap FROM w a JOIN w b ON a.candidate <> b.candidate WHERE a.lo > b.hi) ORDER BY gap, a, b LIMIT 1")
def tk4(s: SparkSession, d: str) -> DataFrame:
    """The pair whose rates are the closest of those that are apart."""
    least = _rate_pairs(s, d).filter("apart").agg(F.min(F.struct("gap", "a", "b")).alias("m")).filter("m is not null")
    return least.select("m.a", "m.b", "m.gap")


@query("TK5_first_n", VOTED.rstrip() + ",\n" + COUNTS + ", s AS (SELECT candidate, n_detected::DOUBLE / n_problem AS p FROM counts), g AS (SELECT candidate, p, unnest(range(10, 2001, 10))::DOUBLE AS n FROM s), w AS (SELECT candidate, n, " + LO + " AS lo FROM (SELECT candidate, p, n, p * n AS k FROM g)) SELECT s.candidate, coalesce(CAST(min(w.n) FILTER (w.lo > 0.5) AS BIGINT), 0) AS n FROM s JOIN w USING (candidate) GROUP BY s.candidate")
def tk5(s: SparkSession, d: str) -> DataFrame:
    """How many units each candidate's measured rate needs until its interval lies above a half; 0 if 2,000 don't do."""
    rate = F.try_divide(F.col("n_detected").cast("double"), F.col("n_problem").cast("double"))
    g = metrics.counts(_voted(s, d), ["candidate"]).select("candidate", rate.alias("p"), F.explode(F.sequence(F.lit(10), F.lit(2000), F.lit(10))).alias("n"))
    n = F.col("n").cast("double")
    return g.groupBy("candidate").agg(F.coalesce(F.min(F.when(stats.wilson(F.col("p") * n, n)["lo"] > 0.5, F.col("n"))).cast("long"), F.lit(0)).alias("n"))


@query("SM3_resume", "WITH q AS (SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND coalesce(turns >= 3, false) THEN 1 ELSE 2 END AS pass FROM q")
def sm3b(s: SparkSession, d: str) -> DataFrame:
    """A run that broke off and is taken up: the second pass gets only what isn't done, and a repeated batch changes nothing."""
    at, schema = folder(s, "questions"), "conv_id long, done boolean, pass int"
    q = views.read(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    files.put_batch(q.filter("conv_id % 2 = 0").select("conv_id", F.coalesce(F.col("turns") >= 3, F.lit(False)).alias("done"), F.lit(1).alias("pass")), at, 0)
    held = table(files.keyed(s, at, schema, "conv_id"), "held")
    left = trials.to_do(q, "conv_id", held.filter("done"))
    for _ in range(2):  # the batch again, as after a crash before its commit
        files.put_batch(left.select("conv_id", F.lit(True).alias("done"), F.lit(2).alias("pass")), at, 1)
    return files.keyed(s, at, schema, "conv_id").select("conv_id", "pass")


@query("SA11_cost", sql("units") + "SELECT qid, count(*) * 2 * 3 AS calls FROM units GROUP BY qid")
def sa11(s: SparkSession, d: str) -> DataFrame:
    return views.units(s, d).groupBy("qid").agg((F.count(F.lit(1)) * 2 * 3).alias("calls"))


@query("SA12_first_hypothesis", VOTED.rstrip() + f""", p AS (SELECT b.candidate, count(*)::DOUBLE AS n, count(*) FILTER (a.maj <> 'SUPPORTED' AND b.maj = 'SUPPORTED') AS b, count(*) FILTER (a.maj = 'SUPPORTED' AND b.maj <> 'SUPPORTED') AS c, count(*) FILTER (a.maj <> b.maj)::DOUBLE AS k
  FROM votes a JOIN votes b ON a.id = b.id WHERE a.candidate = 'c011' AND b.candidate <> 'c011' GROUP BY b.candidate),
q AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)) FOR i IN range(least(b, c) + 1)])) END < 0.05 AS significant, b > c AS better, {LO} > 0.1 AS beyond_control FROM p)
SELECT candidate, significant, better, beyond_control, significant AND better AND beyond_control AS accepted FROM q""")
def sa12(s: SparkSession, d: str) -> DataFrame:
    v = _voted(s, d)
    a = v.filter("candidate = 'c011'").select("id", F.col("maj").alias("a"))
    ok = lambda c: F.col(c) == "SUPPORTED"
    p = v.filter("candidate <> 'c011'").join(a, "id").groupBy("candidate").agg(_n(), metrics.number(~ok("a") & ok("maj")).alias("b"), metrics.number(ok("a") & ~ok("maj")).alias("c"), metrics.number(~ok("a") & ~ok("maj") & (F.col("a") != F.col("maj"))).alias("o"))
    h = trials.first_hypothesis(F.col("b"), F.col("c"), F.col("o"), F.col("n"), F.lit(0.1))
    return p.select("candidate", h.alias("h")).select("candidate", "h.significant", "h.better", "h.beyond_control", "h.accepted")


H2 = VOTED.rstrip() + f""", p AS (SELECT a.qid, CASE WHEN hash_rule = 0 THEN 'CONJUNCTIVE' WHEN hash_rule = 1 THEN 'SELECTION' ELSE 'OTHER' END AS rule, a.maj <> b.maj AS changed FROM (SELECT *, CAST(substr(id, 9) AS BIGINT) % 3 AS hash_rule FROM votes WHERE candidate = 'c000') a JOIN votes b ON a.id = b.id WHERE b.candidate = 'c011'),
r AS (SELECT """ + ", ".join(f"count(*) FILTER (rule = '{x}' AND changed) AS {x.lower()}_k, count(*) FILTER (rule = '{x}') AS {x.lower()}_n, count(DISTINCT CASE WHEN rule = '{x}' AND changed THEN qid END) AS {x.lower()}_flip_questions, count(DISTINCT CASE WHEN rule = '{x}' THEN qid END) AS {x.lower()}_questions" for x in ("CONJUNCTIVE", "SELECTION")) + """ FROM p),
w AS (SELECT r.*, lo.low, hi.high FROM r, (SELECT """ + LO + """ AS low FROM (SELECT conjunctive_k::DOUBLE AS k, conjunctive_n::DOUBLE AS n FROM r)) lo, (SELECT """ + HI + """ AS high FROM (SELECT selection_k::DOUBLE AS k, selection_n::DOUBLE AS n FROM r)) hi),
t AS (SELECT *, low > high AS claims_apart, conjunctive_flip_questions::DOUBLE / greatest(1, conjunctive_questions) > selection_flip_questions::DOUBLE / greatest(1, selection_questions) AS questions_agree FROM w)
SELECT * EXCLUDE (low, high), CASE WHEN claims_apart AND questions_agree THEN 'ACCEPTED' WHEN claims_apart THEN 'CLUSTERED' ELSE 'REJECTED' END AS verdict FROM t"""


@query("SA12_second_hypothesis", H2)
def sa12b(s: SparkSession, d: str) -> DataFrame:
    v = _voted(s, d).filter("candidate in ('c000', 'c011')")
    side = lambda c: F.max(F.when(F.col("candidate") == c, F.col("maj")))
    k = F.substring("id", 9, 20).cast("long") % 3
    p = v.groupBy("id", "qid").agg(side("c000").alias("a"), side("c011").alias("b"))
    return trials.second_hypothesis(p.select("qid", F.when(k == 0, "CONJUNCTIVE").when(k == 1, "SELECTION").otherwise("OTHER").alias("rule"), (F.col("a") != F.col("b")).alias("changed")))


@query("SP8_versions", """WITH e AS (SELECT user_id % 7 AS q, user_id % 3 AS version, count(*) FILTER (event_type = 'purchase') AS bought, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT a.q, a.version AS version, b.version AS other, CASE WHEN a.version % 2 = b.version % 2 THEN CASE WHEN a.bought::DOUBLE / a.n > b.bought::DOUBLE / b.n THEN 'BETTER' ELSE 'NOT_BETTER' END ELSE 'SKIPPED' END AS verdict FROM e a JOIN e b ON a.q = b.q AND a.version < b.version""")
def sp8b(s: SparkSession, d: str) -> DataFrame:
    """Reports compared only where their metrics are of one version."""
    e = views.read(s, d, "events").filter("event_type is not null").groupBy((F.col("user_id") % 7).alias("q"), (F.col("user_id") % 3).alias("version")).agg(metrics.number(F.col("event_type") == "purchase").alias("bought"), _n())
    share = F.col("bought").cast("double") / F.col("n")
    a, b = e.select("q", "version", share.alias("a")), e.select(F.col("q").alias("_q"), F.col("version").alias("other"), share.alias("b"))
    verdict = trials.comparable(F.col("version") % 2, F.col("other") % 2, F.when(F.col("a") > F.col("b"), "BETTER").otherwise("NOT_BETTER"))
    return a.join(b, (F.col("q") == F.col("_q")) & (F.col("version") < F.col("other"))).select("q", "version", "other", verdict.alias("verdict"))


@query("SP8_precision_at", """WITH e AS (SELECT user_id % 7 AS q, event_type AS doc, event_type IN ('purchase', 'click') AS ok FROM events WHERE event_type IS NOT NULL)
SELECT q, round_even(count(*) FILTER (ok)::DOUBLE / count(*), 4) AS by_slot, round_even(count(DISTINCT doc) FILTER (ok)::DOUBLE / count(DISTINCT doc), 4) AS by_document, count(DISTINCT doc) FILTER (ok) AS distinct_right FROM e GROUP BY q""")
def sp8(s: SparkSession, d: str) -> DataFrame:
    e = views.read(s, d, "events").filter("event_type is not null")
    slots = e.select((F.col("user_id") % 7).alias("q"), F.col("event_type").alias("doc"), F.col("event_type").isin("purchase", "click").alias("ok"))
    return trials.precision_at(slots, ["q"], "doc", "ok")


@query("SP9_noise", "SELECT doc_id, doc_id % 1200 > 999 OR regexp_matches(coalesce(text, ''), '(?i)e-?mail|fax|tel\\b|foundation') AS noise FROM documents")
def sp9(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "documents").select("doc_id", text.noise(F.col("doc_id") % 1200, F.col("text")).alias("noise"))


@query("SP10_ladder", """WITH r AS (SELECT d.source, d.doc_id % 3 = 0 AS new, d.doc_id % 5 = 0 AS old, l.quality = 1 AS gold FROM documents d JOIN labels l USING (doc_id)),
a AS (SELECT source, count(*) AS n, count(*) FILTER (new) AS nn, count(*) FILTER (old) AS o, count(*) FILTER (gold) AS g, count(*) FILTER (new AND gold) AS ng, count(*) FILTER (old AND gold) AS og, count(*) FILTER (new AND gold AND NOT old) AS fresh FROM r GROUP BY source),
b AS (SELECT source, nn > 0 AS covered, nn > 0 AND ng::DOUBLE / nn > g::DOUBLE / n AS lift, nn > 0 AND o > 0 AND ng::DOUBLE / nn > og::DOUBLE / o AS precise, fresh > 0 AS contributes FROM a)
SELECT *, CASE WHEN NOT covered THEN 1 WHEN NOT lift THEN 2 WHEN NOT precise THEN 3 WHEN NOT contributes THEN 4 ELSE 0 END AS fails_at FROM b""")
def sp10(s: SparkSession, d: str) -> DataFrame:
    docs = views.read(s, d, "documents").select("doc_id", "source").join(views.read(s, d, "labels").select("doc_id", "quality"), "doc_id")
    return docs.groupBy("source").agg(*trials.ladder(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0, F.col("quality") == 1))


@query("SP11_routing", VOTED.rstrip() + f""", a AS (SELECT candidate, count(*) FILTER ({HIT} AND {BAD})::DOUBLE AS tp, count(*) FILTER ({HIT})::DOUBLE AS f, count(*) FILTER ({BAD})::DOUBLE AS p FROM votes GROUP BY candidate)
SELECT candidate, round_even(tp / nullif(f, 0), 4) AS precision, round_even(tp / nullif(p, 0), 4) AS recall, coalesce(tp / nullif(f, 0) >= 0.5 AND tp / nullif(p, 0) >= 0.7, false) AS passed FROM a""")
def sp11(s: SparkSession, d: str) -> DataFrame:
    return _voted(s, d).groupBy("candidate").agg(*trials.routing(votes.flagged("maj"), metrics.problem()))


# --- sources, resumed runs -------------------------------------------------------------


@query("SRC2_tolerant_lines", sql("units") + "SELECT human, count(*) AS n FROM units WHERE doc_id % 5 <> 0 GROUP BY human")
def src2(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "broken")
    line = F.when(F.col("doc_id") % 5 == 0, '{"id": "cut of').otherwise(F.to_json(F.struct("id", "human")))
    views.units(s, d).select(line.alias("value")).write.text(at)
    # the reader drops what it can't parse only where it reads a column
    return files.json_lines(s, [at], tolerant=True).filter("id is not null").groupBy("human").agg(_n())


@query("SRC13_corpus_view", "SELECT lang, doc_id, left(text, 80) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(left(text, 160), 'license|copyright')) WHERE rk > 3 AND rk <= 8")
def src13(s: SparkSession, d: str) -> DataFrame:
    docs = views.read(s, d, "documents").filter("text is not null").filter(~F.substring("text", 1, 160).rlike("license|copyright"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return docs.select("lang", "doc_id", F.substring("text", 1, 80).alias("shown"), rank.alias("rk")).filter("rk > 3 and rk <= 8").drop("rk")


@query("SNK3_ledger_append", sql("ledger") + "SELECT candidate, seq, status FROM ledger WHERE status IS NOT NULL")
def snk3(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "ledger")
    rows = views.ledger(s, d).select("candidate", "seq", "status").filter("status is not null")
    files.seed_ledger(rows.filter("seq % 3 = 0"), at)
    files.append_json_lines(rows.filter("seq % 3 <> 0"), at)
    return s.read.schema("candidate string, seq long, status string").json(at)


@query("VA18_manifest_changes", "SELECT coalesce(a.source, '-') AS key, a.n AS before, b.n AS after FROM (SELECT source, count(*)::VARCHAR AS n FROM documents WHERE source IS NOT NULL GROUP BY source) a FULL JOIN (SELECT source, count(*)::VARCHAR AS n FROM documents WHERE source IS NOT NULL AND doc_id % 9 <> 0 GROUP BY source) b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n")
def va18(s: SparkSession, d: str) -> DataFrame:
    docs = views.read(s, d, "documents").filter("source is not null").select("source", "doc_id")
    count = lambda x: x.groupBy(F.col("source").alias("key")).agg(_n("value")).select("key", F.col("value").cast("string").alias("value"))
    return files.changed(count(docs), count(docs.filter("doc_id % 9 <> 0")))


@query("SM2_resume_by_two_keys", sql("units") + "SELECT DISTINCT qid, arm FROM units")
def sm2(s: SparkSession, d: str) -> DataFrame:
    log, out = folder(s, "log"), folder(s, "done")
    views.units(s, d).select("qid", "arm").write.parquet(log)
    streams.drain(streams.resume(streams.source(s, log, "qid string, arm string"), ["qid", "arm"]), out, folder(s, "state"), "append")
    return s.read.schema("qid string, arm string").parquet(out).select("qid", "arm")


@query("SM3_not_done", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT coalesce(bool_or(turn >= 3), false)")
def sm3(s: SparkSession, d: str) -> DataFrame:
    turns = views.read(s, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.bool_or(F.col("turn") >= 3), F.lit(False)).alias("done"))
    return turns.filter(~F.col("done")).select("conv_id")


@query("SM4_judge_tasks", sql("units") + """, q AS (SELECT qid, bool_or(human = 'C') AS revised FROM units GROUP BY qid), t AS (SELECT qid, unnest(CASE WHEN revised THEN ['A', 'B', 'Bd'] ELSE ['A', 'B'] END) AS task FROM q)
SELECT qid, task FROM t WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.qid = t.qid AND u.arm = t.task AND u.doc_id % 4 = 0)""")
def sm4(s: SparkSession, d: str) -> DataFrame:
    u = views.units(s, d)
    q = u.groupBy("qid").agg(F.bool_or(F.col("human") == "C").alias("revised"))
    two = [F.lit("A"), F.lit("B")]
    tasks = q.select("qid", F.explode(F.when(F.col("revised"), F.array(*two, F.lit("Bd"))).otherwise(F.array(*two))).alias("task"))
    done = u.filter("doc_id % 4 = 0").select("qid", F.col("arm").alias("task")).distinct()
    return tasks.join(done, ["qid", "task"], "left_anti")


@query("SM6_stall_stream", """WITH e AS (SELECT user_id AS study, event_id AS round, event_type AS front FROM events WHERE event_type IS NOT NULL),
m AS (SELECT *, CASE WHEN lag(front) OVER w = front THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY study ORDER BY round)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY study ORDER BY round) AS island FROM m)
SELECT 's' || study AS study, round, CAST(row_number() OVER (PARTITION BY study, island ORDER BY round) - 1 AS INTEGER) AS stall FROM i""")
def sm6(s: SparkSession, d: str) -> DataFrame:
    log, out = folder(s, "rounds"), folder(s, "stalls")
    e = views.read(s, d, "events").filter("event_type is not null")
    study: Column = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    # in no order: half of the rounds come late
    made = e.select(study.alias("study"), F.col("event_id").alias("round"), F.col("event_type").alias("front"))
    made.repartition(2, F.xxhash64("round") % 2).write.parquet(log)
    streams.drain(streams.stalls(streams.source(s, log, "study string, round long, front string")), out, folder(s, "state"), "append")
    return streams.settled(s, out)


@query("SM8_repeated_rows", BASE + ", r AS (SELECT candidate, id, run, count(*) + max(CASE WHEN id LIKE '%7' THEN 1 ELSE 0 END) AS n FROM runs GROUP BY candidate, id, run) SELECT candidate, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM r GROUP BY candidate")
def sm8(s: SparkSession, d: str) -> DataFrame:
    runs = views.judge_runs(s, d).select("candidate", "id", "run")
    logged = runs.unionByName(runs.filter("id like '%7'"))
    per = logged.groupBy("candidate", "id", "run").agg(_n())
    return per.groupBy("candidate").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeated"))
