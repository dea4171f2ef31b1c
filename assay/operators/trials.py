"""Decisions about trials: hypotheses, routing, signals, sets of questions, fronts against fronts.

Inputs are aggregates (a row per trial) or rows keyed by a question; every function is an
expression or one aggregation, so nothing grows but the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.shared import table
from . import ordered, pareto, search, stats

LAYERS = ("distractor", "no_answer", "normal")


def first_hypothesis(improved: Column, worsened: Column, other: Column, n: Column, control_hi: Column) -> Column:
    """struct(p, significant, better, beyond_control, accepted): context changes verdicts for the better.

    All three must hold: McNemar p below 0.05, more improved than worsened, and the share
    that changed lies with its whole interval above the control's.
    """
    p = stats.mcnemar(improved, worsened)
    parts = p < 0.05, improved > worsened, stats.wilson(improved + worsened + other, n, 1.96)["lo"] > control_hi
    return F.struct(p.alias("p"), parts[0].alias("significant"), parts[1].alias("better"), parts[2].alias("beyond_control"), (parts[0] & parts[1] & parts[2]).alias("accepted"))


def second_hypothesis(units: DataFrame) -> DataFrame:
    """One row: does a change of context turn verdicts on rules whose parts must all hold more often than on those that pick one?

    ``units``: rule, qid, changed.  The share of claims that changed must lie with its whole
    interval above, and the share of questions with a change must point the same way; where
    only the claims differ, clusters may be the cause and nothing is decided.
    """
    def of(rule: str) -> list[Column]:
        own, name = F.col("rule") == rule, rule.lower()
        hit = own & F.col("changed")
        return [F.count(F.when(hit, 1)).alias(f"{name}_k"), F.count(F.when(own, 1)).alias(f"{name}_n"), F.count_distinct(F.when(hit, F.col("qid"))).alias(f"{name}_flip_questions"), F.count_distinct(F.when(own, F.col("qid"))).alias(f"{name}_questions")]

    r = units.agg(*of("CONJUNCTIVE"), *of("SELECTION"))
    low = stats.wilson(F.col("conjunctive_k"), F.col("conjunctive_n"))["lo"]
    high = stats.wilson(F.col("selection_k"), F.col("selection_n"))["hi"]
    rate = lambda n: F.col(f"{n}_flip_questions") / F.greatest(F.lit(1), F.col(f"{n}_questions"))
    r = r.withColumns({"claims_apart": low > high, "questions_agree": rate("conjunctive") > rate("selection")})
    verdict = F.when(F.col("claims_apart") & F.col("questions_agree"), "ACCEPTED").when(F.col("claims_apart"), "CLUSTERED").otherwise("REJECTED")
    return r.withColumn("verdict", verdict)


def axis_check(negative_hi: Column, base_lo: Column) -> Column:
    """PASS if a control made worse lies below the base with its whole interval; unknown bounds fail."""
    return F.when(F.coalesce(negative_hi < base_lo, F.lit(False)), "PASS").otherwise("FAIL")


def routing(flagged: Column, problem: Column) -> list[Column]:
    """Aggregates precision, recall and passed (half of the flagged are problems, 70 % of these are flagged)."""
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    precision, recall = F.try_divide(n(flagged & problem), n(flagged)), F.try_divide(n(flagged & problem), n(problem))
    return [F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.coalesce((precision >= 0.5) & (recall >= 0.7), F.lit(False)).alias("passed")]


def ladder(new: Column, old: Column, gold: Column) -> list[Column]:
    """Aggregates of a signal's four steps: covered, lift, precise, contributes; and the step it fails (0: none).

    It must fire at all, beat a random pick, be more precise than the old top list that it
    takes places from, and find something right which that list lacks.
    """
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    precision, base, before = F.try_divide(n(new & gold), n(new)), F.try_divide(n(gold), n(F.lit(True))), F.try_divide(n(old & gold), n(old))
    steps = {"covered": n(new) > 0, "lift": precision > base, "precise": precision > before, "contributes": n(new & gold & ~old) > 0}
    ok = {k: F.coalesce(v, F.lit(False)) for k, v in steps.items()}
    fails = F.lit(0)
    for i, v in reversed(list(enumerate(ok.values(), 1))):
        fails = F.when(~v, i).otherwise(fails)
    return [*[v.alias(k) for k, v in ok.items()], fails.alias("fails_at")]


def precision_at(slots: DataFrame, keys: list[str], doc: str, right: str) -> DataFrame:
    """Precision over slots, over distinct documents, and the number of distinct right documents."""
    seen = slots.groupBy(*keys, doc).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(right).alias("_ok"))
    ok = F.col("_ok").cast("long")
    share = lambda a, b: F.bround(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), 4)
    return seen.groupBy(*keys).agg(share(ok * F.col("_n"), F.col("_n")).alias("by_slot"), share(ok, F.lit(1)).alias("by_document"), F.sum(ok).alias("distinct_right"))


def comparable(version: Column, other: Column, verdict: Column) -> Column:
    """A verdict on two reports, or SKIPPED where their metrics are of different versions."""
    return F.when(version.eqNullSafe(other), verdict).otherwise("SKIPPED")


def question_faults(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, fault) of a set of questions against (standard, body) of a corpus.

    Questions have qid, layer, question, evidence and citations (array of standard and
    quote).  White space doesn't count where quotes are looked for.  Questions that share a
    qid, evidence and citation are one as to that citation's faults.
    """
    norm = text.without_space
    n = F.size(F.coalesce("citations", F.array()))
    none = F.col("layer") == "no_answer"
    whole = {
        "bad_layer": ~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False)),
        "citations_not_empty": F.coalesce(none, F.lit(False)) & (n > 0), "citations_empty": ~F.coalesce(none, F.lit(False)) & (n == 0),
        "copied_question": (F.col("_asked") != "") & F.contains("_text", "_asked"),
    }
    cites = F.transform("citations", lambda c: F.struct(c["standard"].alias("standard"), norm(c["quote"]).alias("_q"), F.contains(F.col("_text"), norm(c["quote"])).alias("_in")))
    # evidence is read once; after that its digest stands for it
    q = questions.withColumns({"_text": norm(F.col("evidence")), "_asked": norm(F.col("question"))})
    q = table(q.select("qid", F.array_compact(F.array(*[F.when(v, k) for k, v in whole.items()])).alias("shape"), F.sha2("_text", 256).alias("_e"), cites.alias("cites")), "questions")
    shape = q.select("qid", F.explode("shape").alias("fault"))
    twice = q.groupBy("qid").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("qid", F.explode(F.expr("array_repeat('duplicate_qid', int(_n - 1))")).alias("fault"))
    cited = q.select("qid", "_e", F.posexplode("cites").alias("_i", "c")).select("qid", "_i", "_e", "c.*")
    held = corpus.select(F.col("standard").alias("_s")).distinct().withColumn("_known", F.lit(1))
    met = search.quoted(cited, "standard", "_q", corpus, "body", "_there").join(held, F.col("standard") == F.col("_s"), "left")
    met = met.groupBy("qid", "_i", "_e", "_q", "_in").agg(F.count("_known").alias("_known"), F.coalesce(F.bool_or("_there"), F.lit(False)).alias("_there"))
    known = F.col("_known") > 0
    faults = F.array_compact(F.array(F.when(~known, "unknown_standard"), F.when(known & ~F.col("_there"), "quote_not_in_corpus"), F.when(known & ~F.col("_in"), "quote_not_in_evidence")))
    return shape.unionByName(twice).unionByName(met.select("qid", F.explode(faults).alias("fault")))


def parents(members: DataFrame) -> DataFrame:
    """(slot, origin, parents) of a round: both endpoints and the pair of them.

    Where one candidate is both endpoints, the second slot takes something away instead.
    """
    r, p = F.col("recall"), F.col("precision")
    rows = [("S1", F.lit("front_endpoint"), F.array(r)), ("S2", F.when(r == p, "filter_strip").otherwise("front_endpoint"), F.array(p)), ("S3", F.lit("front_pair"), F.array(r, p))]
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), o.alias("origin"), a.alias("parents")) for s, o, a in rows])
    return pareto.endpoints(members).select(F.explode(slots).alias("s")).select("s.*")


def covered(mine: DataFrame, theirs: DataFrame, intervals: bool = True) -> DataFrame:
    """One row on two fronts: whether mine dominates theirs: each of theirs is beaten or tied, one of them beaten.
    """
    tie = (pareto.compare("recall", "x", "y", intervals) == 0) & (pareto.compare("precision", "x", "y", intervals) == 0)
    beats = pareto.dominates("x", "y", intervals)
    met = pareto.pairs(mine, theirs, beats | tie).groupBy(F.col("y.candidate").alias("candidate")).agg(F.bool_or(beats).alias("_beaten"))
    each = theirs.select("candidate").join(met.withColumn("_met", F.lit(True)), "candidate", "left").select(F.coalesce("_beaten", F.lit(False)).alias("_beaten"), F.col("_met").isNotNull().alias("_met"))
    return each.agg((F.bool_and("_met") & F.bool_or("_beaten")).alias("dominates"), F.bool_and("_met").alias("covers"))


def round_robin(rows: DataFrame, forced: Column, group: str, order: list[str], cap: int, limit: int) -> DataFrame:
    """``limit`` rows dealt from groups in turn: forced ones first, which count to cap and limit.

    Within a group rows come in ``order``, ``cap`` of a group at most; turns go by group.
    """
    f = rows.filter(forced)
    n = f.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    turn = rows.filter(~F.coalesce(forced, F.lit(False))).withColumn("_turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_turn") <= cap)
    open_ = turn.join(n, F.col(group) == F.col("_g"), "left").filter(F.col("_turn") + F.coalesce("_n", F.lit(0)) <= cap)
    left = max(0, limit - f.limit(limit).count())  # the limit is a parameter
    return f.unionByName(open_.orderBy("_turn", group).limit(left).select(*rows.columns))


def front_verdict(won: DataFrame, mine: int, others: tuple[int, int], halted: bool = False, control: str = "PASS", sizes: tuple[int, ...] = ()) -> DataFrame:
    """One row, verdict, of fronts compared in pairs (mine, theirs, dominates, covers).

    V6: the negative control failed, so nothing is read.  V5: pruning halted on ties.  V7: no
    front grew beyond the baseline (all ``sizes`` 1).  V4: another front dominates mine.  V1: mine
    dominates both.  V2: only one, named.  V3: all cover each other and none dominates.  NONE
    if nothing of that was seen.
    """
    at = lambda a, b: F.coalesce(F.bool_or((F.col("mine") == a) & (F.col("theirs") == b) & F.col("dominates")), F.lit(False))
    first, second = others
    w = won.agg(
        at(mine, first).alias("a"), at(mine, second).alias("b"), F.coalesce(F.bool_or((F.col("theirs") == mine) & F.col("dominates")), F.lit(False)).alias("under"),
        F.coalesce(F.bool_and(F.col("covers") & ~F.col("dominates")), F.lit(False)).alias("level"),
    )
    verdict = (
        F.when(F.lit(control != "PASS"), "V6").when(F.lit(halted), "V5").when(F.lit(bool(sizes) and all(n == 1 for n in sizes)), "V7")
        .when(F.col("under"), "V4").when(F.col("a") & F.col("b"), "V1").when(F.col("a"), f"V2_C{first}").when(F.col("b"), f"V2_C{second}").when(F.col("level"), "V3").otherwise("NONE")
    )
    return w.select(verdict.alias("verdict"))


def has_proposition(memo: Column) -> Column:
    """Whether a memo doesn't say that there is no proposition; none at all is one."""
    return ~F.contains(F.coalesce(memo, F.lit("")), F.lit("명제없음"))  # fixed value


def evidence_labels(cited: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, human): S with any supporting evidence, C with other evidence only, I where none is there.

    ``evidence``: keys and supports; it is summed before the join, so keys with much of it cost one row.
    """
    per = evidence.groupBy(*keys).agg(F.bool_or("supports").alias("_any"))
    found = cited.distinct().join(per, keys, "left")
    return found.select(*keys, F.when(F.col("_any").isNull(), "I").when(F.col("_any"), "S").otherwise("C").alias("human"))


def to_do(rows: DataFrame, key: str, done: DataFrame, only: tuple[str, tuple[str, ...]] | None = None, limit: int | None = None) -> DataFrame:
    """Rows still to do, by key: of some values of a column only, without those done, the first ``limit``."""
    left = rows.filter(F.col(only[0]).isin(*only[1])) if only else rows
    left = left.join(done.select(key), key, "left_anti").orderBy(key)
    return left.limit(limit) if limit is not None else left


def pair_units(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, qid, human, quadrant) of two endpoints' verdicts (id, qid, human, said) on the units of both."""
    both = a.join(b.select("id", F.col("said").alias("_other")), "id")
    right, other = F.col("said") == F.col("human"), F.col("_other") == F.col("human")
    q = F.when(right & other, "BOTH_OK").when(right, "A_ONLY").when(other, "B_ONLY").otherwise("BOTH_FAIL")
    return both.select("id", "qid", "human", q.alias("quadrant"))


def base_rates(voted: DataFrame, keys: list[str]) -> DataFrame:
    """Per set: units, those judged a problem and their rate, splits, and how many could at most be mended."""
    hit = F.col("maj").isin("CONTRADICTED", "INSUFFICIENT")
    n = lambda c: F.count(F.when(c, 1))
    rate = F.bround(F.try_divide(n(hit).cast("double"), F.count(F.lit(1)).cast("double")), 4)
    return voted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n(hit).alias("problem"), rate.alias("rate"), n(F.col("maj") == "SPLIT").alias("split"), n(hit).alias("improvement_ceiling"))


def shuffled(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows in the order of a keyed hash: the same in any engine and any run."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key)), 256))


def sample(rows: DataFrame, key: str, seed: str, stratum: str, n: int) -> DataFrame:
    """``n`` rows of each stratum by a keyed hash; each task keeps ``n`` a stratum before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key)), 256)))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row on two sets: whether b is a subset of a, and whether they are equal."""
    n = lambda x, y, name: x.join(y, key, "left_anti").agg(F.count(F.lit(1)).alias(name))
    both = n(b, a, "beyond").join(n(a, b, "lacking"), F.lit(True))  # a row each
    return both.select((F.col("beyond") == 0).alias("subset"), (F.col("beyond") + F.col("lacking") == 0).alias("equal"))


#: Slots of a round in the order in which a budget is spent, and the calls of a candidate.
SLOTS, CALLS = ("filter_strip", "S1", "S2", "S3"), 165


def affordable(rounds: DataFrame, budget: Column, strip: bool = True) -> DataFrame:
    """Rounds with the slots (kind) that their budget pays for: the last in order are dropped first."""
    kinds = [k for k in SLOTS if strip or k != "filter_strip"]
    slots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(kinds, 1)])
    return rounds.withColumn("_s", F.explode(F.filter(slots, lambda x: x["i"] * CALLS <= budget))).select(*rounds.columns, "_s.kind")


def random_parents(pool: DataFrame, key: str, rounds: int, seed: int = 20260731) -> DataFrame:
    """(round, parent): a parent per round, any of the pool alike, by the seeded generator over sorted ids."""
    placed = ordered.place(pool, [F.col(key)], "pos").select("pos", F.col(key).alias("parent"))
    drawn = stats.draws(pool.sparkSession, pool.count(), rounds, seed, each=1)
    return drawn.select(F.col("b").alias("round"), "pos").join(placed, "pos").select("round", "parent")


def two_gates(measured: DataFrame, baseline: str) -> DataFrame:
    """What a scalar gate and a Pareto gate take of candidates (candidate, score, cost) against a baseline.

    ``scalar``: a higher score.  ``pareto``: nowhere worse, somewhere better.  ``dearer``: more
    cost.  ``inferior``: no higher score at more cost.
    """
    base = measured.filter(F.col("candidate") == baseline).agg(F.first("score").alias("_s"), F.first("cost").alias("_c"))
    m = measured.filter(F.col("candidate") != baseline).join(base, F.lit(True))
    up, dearer = F.col("score") > F.col("_s"), F.col("cost") > F.col("_c")
    level = (F.col("score") >= F.col("_s")) & ~dearer & (up | (F.col("cost") < F.col("_c")))
    return m.select("candidate", up.alias("scalar"), level.alias("pareto"), dearer.alias("dearer"), (~up & dearer).alias("inferior"))


def answer_context(units: DataFrame, recall: float, least_flips: int = 8, least_recall: float = 0.9) -> DataFrame:
    """One row: is a probe that sees the whole answer adopted?  ``units``: human, old and new (a stable YES), siblings.

    All three must hold: ``least_flips`` old false alarms turned, every old hit stayed (and there
    was one), the gate's recall is kept.  Turned ones without siblings mean that the wording did
    it, not the context (``attributable``).
    """
    old, new, clean = F.col("old"), F.col("new"), F.col("human") == "S"
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    turned = old & ~new & clean
    r = units.agg(n(turned, "flipped"), n(old & clean, "false_alarms"), n(old & new & ~clean, "kept"), n(old & ~clean, "hits"), n(turned & (F.col("siblings") <= 1), "solo_flips"))
    adopted = (F.col("flipped") >= least_flips) & (F.col("hits") > 0) & (F.col("kept") == F.col("hits")) & F.lit(recall >= least_recall - 1e-9)
    return r.select("*", adopted.alias("adopted"), (F.col("solo_flips") == 0).alias("attributable"))
