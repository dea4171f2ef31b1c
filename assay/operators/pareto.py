"""Dominance under interval ties, the front, pruning, termination; and the ledger's state.

Candidates: candidate, generation, origin, n_flagged, recall, precision, and for either rate
``_lo`` and ``_hi`` (null: no interval, which ties with everything).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import table
from . import ordered

EPS = 1e-9
TERMINAL = ("PRUNED", "INVALID")
NOT_JUDGED = ("INVALID", "PRUNED", "UNJUDGED", "REJECTED_C0")
AXES = ("recall", "precision")


def compare(axis: str, x: str, y: str, intervals: bool = True) -> Column:
    """1 if x is better than y on the axis, -1 if worse, else 0 (overlap or nothing known)."""
    if intervals:
        more = F.col(f"{x}.{axis}_lo") > F.col(f"{y}.{axis}_hi") + EPS
        less = F.col(f"{y}.{axis}_lo") > F.col(f"{x}.{axis}_hi") + EPS
    else:
        more = F.col(f"{x}.{axis}") > F.col(f"{y}.{axis}") + EPS
        less = F.col(f"{y}.{axis}") > F.col(f"{x}.{axis}") + EPS
    return F.when(more, 1).when(less, -1).otherwise(0)


def dominates(x: str, y: str, intervals: bool = True) -> Column:
    """x is nowhere worse and somewhere better.  With interval ties this is not transitive."""
    a, b = (compare(axis, x, y, intervals) for axis in AXES)
    return (a >= 0) & (b >= 0) & (a + b > 0)


def relation(pairs: DataFrame, intervals: bool = True) -> DataFrame:
    """TIE, X, Y or TRADE_OFF of pairs of candidates (structs x and y)."""
    a, b = (compare(axis, "x", "y", intervals) for axis in AXES)
    return pairs.withColumn("relation", F.when((a == 0) & (b == 0), "TIE").when((a >= 0) & (b >= 0), "X").when((a <= 0) & (b <= 0), "Y").otherwise("TRADE_OFF"))


def judgeable(candidates: DataFrame) -> DataFrame:
    """Measured candidates in the pool: DOMINATED ones stay in it; an unknown or null status too."""
    state = F.coalesce("status", F.lit(""))
    return candidates.filter(~state.isin(*NOT_JUDGED) & F.col("gate_passed") & F.col("recall").isNotNull() & F.col("precision").isNotNull())


#: Rows of a tile's side where pairs are listed.
TILE = 4096


def pairs(xs: DataFrame, ys: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Pairs of rows (structs x and y) that meet ``condition``, in tiles of at most about TILE by TILE rows.

    For listings whose result is pairs; neither side is broadcast or held whole.
    """
    across, down = (max(1, -(-df.count() // TILE)) for df in (xs, ys))
    x = xs.select(F.struct(*xs.columns).alias("x"), F.pmod(F.xxhash64("candidate"), F.lit(across)).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_d"))
    y = ys.select(F.struct(*ys.columns).alias("y"), F.pmod(F.xxhash64("candidate"), F.lit(down)).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_u"))
    return x.join(y, (F.col("_a") == F.col("_u")) & (F.col("_d") == F.col("_v")) & condition, how).drop("_a", "_d", "_u", "_v")


def _ends(axis: str, intervals: bool) -> tuple[Column, Column]:
    return (F.col(f"{axis}_lo"), F.col(f"{axis}_hi")) if intervals else (F.col(axis), F.col(axis))


ENDLESS = float("inf")


def _beaten_on(pool: DataFrame, first: str, second: str, intervals: bool) -> DataFrame:
    """Ids of those beaten on ``first`` by one that isn't worse on ``second``.

    y is beaten if some x has lo(x) > hi(y) + eps on the first axis and hi(x) + eps >= lo(y) on
    the second: a sweep down the first axis keeps the largest hi of the second so far.  At
    equal places what asks comes before what answers.
    """
    (lo, hi), (other_lo, other_hi) = _ends(first, intervals), _ends(second, intervals)
    known = lambda c, x: F.coalesce(c, F.lit(x)).cast("double")
    answers = pool.select(lo.cast("double").alias("_at"), F.lit(1).alias("_turn"), known(other_hi, ENDLESS).alias("_hi"), F.lit(None).cast("double").alias("_need"), F.lit(None).cast("string").alias("candidate"))
    asks = pool.select((hi + EPS).cast("double").alias("_at"), F.lit(0).alias("_turn"), F.lit(None).cast("double").alias("_hi"), known(other_lo, -ENDLESS).alias("_need"), "candidate")
    swept = ordered.leading(answers.unionByName(asks).filter("_at is not null"), [F.desc("_at"), F.col("_turn")], "_hi", "_best")
    return swept.filter((F.col("_turn") == 0) & (F.col("_need") <= F.col("_best") + EPS)).select("candidate")


def on_front(pool: DataFrame, intervals: bool = True, tile: int = TILE) -> DataFrame:
    """The pool with on_front: whether no other candidate dominates it.

    A pool of up to ``tile`` rows is one tile of pairs.  A larger one takes two sorts, one per
    axis, and no pairs: each axis is an interval order, so the one that reaches furthest on
    the other axis tells for all that are better on this one.  Nothing is discarded early, as
    dominance isn't transitive where intervals tie.  Ids are unique, and no interval ends
    before it begins.
    """
    if pool.count() <= tile:
        beaten = pairs(pool, pool, dominates("x", "y", intervals)).select("y.candidate").distinct()
    else:
        beaten = _beaten_on(pool, *AXES, intervals).unionByName(_beaten_on(pool, *AXES[::-1], intervals)).distinct()
    marked = pool.join(beaten.withColumn("_beaten", F.lit(True)), "candidate", "left")
    return marked.select(*[c for c in pool.columns if c != "on_front"], F.col("_beaten").isNull().alias("on_front"))


def front(pool: DataFrame, intervals: bool = True) -> DataFrame:
    """The pool with dominated_by (sorted) and on_front.

    Who is on the front is swept (``on_front``); only for the others the ones that dominate
    them are looked up.  Where these lists aren't wanted, ``on_front`` makes no pairs.
    """
    marked = table(on_front(pool, intervals).drop("dominated_by"), "front")
    lost = marked.filter("not on_front")
    worse = pairs(marked, lost, dominates("x", "y", intervals)).groupBy(F.col("y.candidate").alias("candidate")).agg(F.array_sort(F.collect_list("x.candidate")).alias("dominated_by"))
    out = marked.join(worse, "candidate", "left").withColumn("dominated_by", F.coalesce("dominated_by", F.array().cast("array<string>")))
    return out.select(*[c for c in pool.columns if c not in ("dominated_by", "on_front")], "dominated_by", "on_front")


def tied(members: DataFrame, intervals: bool = True, tile: int = TILE) -> DataFrame:
    """Ids of members that another member ties with on both axes.

    Up to ``tile`` members are one tile of pairs; beyond that, two that don't dominate each other tie if they overlap on one axis, so among members that
    nobody beats, all of them on a front, a sweep up and one down that axis tell.  Only for
    those that are beaten pairs are looked at.
    """
    level = (F.col("x.candidate") != F.col("y.candidate")) & (compare(AXES[0], "x", "y", intervals) == 0) & (compare(AXES[1], "x", "y", intervals) == 0)
    if members.count() <= tile:
        return pairs(members, members, level).select("y.candidate").distinct()
    marked = table(on_front(members, intervals, tile), "members")
    lo, hi = _ends(AXES[0], intervals)
    line = marked.filter("on_front").select("candidate", F.coalesce(lo, F.lit(-ENDLESS)).alias("_lo"), F.coalesce(hi, F.lit(ENDLESS)).alias("_hi"))
    up = ordered.leading(line, [F.col("_lo"), F.col("candidate")], "_hi", "_reach").filter(F.col("_lo") <= F.col("_reach") + EPS)
    down = ordered.leading(line.withColumn("_back", -F.col("_lo")), [F.desc("_lo"), F.desc("candidate")], "_back", "_next").filter(-F.col("_next") <= F.col("_hi") + EPS)
    met = pairs(marked, marked.filter("not on_front"), level).select(F.explode(F.array("x.candidate", "y.candidate")).alias("candidate"))
    return up.select("candidate").unionByName(down.select("candidate")).unionByName(met).distinct()


def endpoints(members: DataFrame) -> DataFrame:
    """Best candidate per axis: the axis, the other axis, then oldest and smallest id; null as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    best = [F.min_by("candidate", F.struct((-zero(a)).alias("a"), (-zero(b)).alias("b"), "generation", "candidate")).alias(a) for a, b in (AXES, AXES[::-1])]
    return members.agg(*best)


def prune(members: DataFrame, cap: int = 8) -> DataFrame:
    """Members of a front with ``pruned``.

    Endpoints are safe.  First those go that tie with another member on both axes (fewest
    flagged, latest, largest id first), then the latest.  Nothing goes if the front fits, or
    if half of it or more are filter_strip (``halted``).
    """
    level = tied(members).withColumn("tied", F.lit(True))
    ends = endpoints(members).select(F.explode(F.array(*AXES)).alias("candidate")).distinct().withColumn("safe", F.lit(True))
    m = members.join(level, "candidate", "left").join(ends, "candidate", "left")
    size, strips = members.agg(F.count(F.lit(1)), F.count(F.when(F.col("origin") == "filter_strip", 1))).first()
    halted = size > cap and strips * 2 >= size
    stage = F.when(F.col("safe"), 3).when(F.col("tied"), 1).otherwise(2)
    m = m.withColumns({"_stage": stage, "_flagged": F.when(stage == 1, F.col("n_flagged")).otherwise(0)})
    # what stays is at most ``cap`` rows: the last ones in the order in which members go
    last = m.orderBy(F.desc("_stage"), F.desc("_flagged"), "generation", "candidate").limit(cap).select("candidate", F.lit(True).alias("stays"))
    m = m.join(last, "candidate", "left")
    gone = F.lit(not halted) & F.col("safe").isNull() & F.col("stays").isNull()
    return m.select("candidate", gone.alias("pruned"), F.lit(halted).alias("halted"))


def of_two(pool: DataFrame, a: str, b: str, intervals: bool = True) -> DataFrame:
    """(a, b, relation, recall, precision) of two candidates by id: how they relate, and on either axis."""
    row = F.struct(*pool.columns)
    pair = pool.filter(F.col("candidate") == a).agg(F.first(row).alias("x")).join(pool.filter(F.col("candidate") == b).agg(F.first(row).alias("y")), F.lit(True))
    out = relation(pair.filter("x is not null and y is not null"), intervals)
    return out.select(F.col("x.candidate").alias("a"), F.col("y.candidate").alias("b"), "relation", *[compare(axis, "x", "y", intervals).alias(axis) for axis in AXES])


def unjudged(candidates: DataFrame) -> DataFrame:
    """Candidates without a verdict: UNJUDGED, or not INVALID while the sample gate didn't let them pass."""
    state = F.coalesce("status", F.lit(""))
    return candidates.filter((state == "UNJUDGED") | ((state != "INVALID") & ~F.coalesce("gate_passed", F.lit(False))))


def front_document(pool: DataFrame, before: list[str], stall: int, cap: int = 8, intervals: bool = True) -> DataFrame:
    """One row: front (sorted), its ends, dominated ("id<by+by"), pruned, whether it changed from ``before``, stall_rounds.

    The pool is the short list of candidates; ``stall`` is how long the front before had not changed.
    """
    drawn = front(pool, intervals)
    members = drawn.filter("on_front").drop("dominated_by", "on_front")
    cut = prune(members, cap)
    kept = members.join(cut.filter("not pruned").select("candidate"), "candidate")
    listed = lambda df, c: df.agg(F.array_sort(F.collect_list(c)).alias("v"))
    ids, gone = listed(kept, "candidate").withColumnRenamed("v", "front"), listed(cut.filter("pruned"), "candidate").withColumnRenamed("v", "pruned")
    lost = listed(drawn.filter("not on_front").select(F.concat_ws("<", "candidate", F.array_join("dominated_by", "+")).alias("d")), "d").withColumnRenamed("v", "dominated")
    ends = endpoints(kept).select(F.col("recall").alias("recall_end"), F.col("precision").alias("precision_end"))
    one = ids.join(gone, F.lit(True)).join(lost, F.lit(True)).join(ends, F.lit(True))  # a row each
    changed = F.col("front") != F.array(*[F.lit(x) for x in sorted(before)]).cast("array<string>")
    return one.select("*", F.size("front").cast("long").alias("front_size"), changed.alias("front_changed"), F.when(changed, 0).otherwise(stall + 1).alias("stall_rounds"))


def transition(record: DataFrame, status: str, by: str, at: str) -> DataFrame:
    """Records with a new status and an entry (at, status, by) at the end of status_history; the old rows stay as they are."""
    entry = F.struct(F.lit(at).alias("at"), F.lit(status).alias("status"), F.lit(by).alias("by"))
    none = F.array().cast("array<struct<at:string,status:string,by:string>>")
    return record.withColumns({"status": F.lit(status), "status_history": F.concat(F.coalesce("status_history", none), F.array(entry))})


def faults(harness: DataFrame, current: DataFrame, model: str, builders: dict) -> DataFrame:
    """(candidate, faults) of harnesses (model, prompt_sha256, builder): other model, no prompt hash, one that is
    there already, a builder that isn't registered."""
    known = current.select(F.col("prompt_sha256").alias("_hash")).filter("_hash is not null").distinct()
    h = harness.join(known, F.col("prompt_sha256") == F.col("_hash"), "left")
    named = F.array(*[F.lit(b) for b in sorted(builders)]).cast("array<string>")
    rules = {
        "model": ~F.col("model").eqNullSafe(F.lit(model)), "no_prompt": F.coalesce("prompt_sha256", F.lit("")) == "",
        "prompt_again": F.col("_hash").isNotNull(), "builder": ~F.coalesce(F.array_contains(named, F.col("builder")), F.lit(False)),
    }
    return h.select("candidate", F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()])).alias("faults"))


def latest(ledger: DataFrame) -> DataFrame:
    """Current state of each candidate: the row with the largest seq."""
    columns = [c for c in ledger.columns if c != "candidate"]
    return ledger.groupBy("candidate").agg(F.max_by(F.struct(*columns), "seq").alias("_r")).select("candidate", *[F.col(f"_r.{c}").alias(c) for c in columns])


def transitions(current: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows to append: targets (candidate, status) that differ from a current state that isn't final."""
    c = current.select(F.col("candidate").alias("_c"), F.col("status").alias("_s"))
    changed = ~F.col("_s").eqNullSafe(F.col("status")) & ~F.coalesce(F.col("_s").isin(*TERMINAL), F.lit(False))
    return targets.join(c, F.col("candidate") == F.col("_c")).filter(changed).select("candidate", F.col("_s").alias("before"), "status")


def stalls(rounds: DataFrame) -> DataFrame:
    """From (round, front): how many rounds in a row the front has not changed.

    A round's stall is its place less that of the last change, found by running sums over ranges.
    """
    r = ordered.previous(rounds, [], [F.col("round")], "front", "_before")
    r = r.withColumn("_fresh", (~F.coalesce(F.col("_before") == F.col("front"), F.lit(False))).cast("long"))
    r = ordered.running(r, [F.col("round")], {"_place": F.lit(1).cast("long"), "_changes": F.col("_fresh")})
    r = r.withColumn("_island", F.col("_changes") + F.col("_fresh"))
    first = r.groupBy("_island").agg(F.min("_place").alias("_first"))
    return r.join(first, "_island").select("round", "front", (F.col("_place") - F.col("_first")).cast("int").alias("stall"))


def gate_violations(c: DataFrame) -> DataFrame:
    """Sample gate: R1 to R5 of counts and runs; an empty denominator counts as a ratio of 1."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(1.0))
    unresolved = F.greatest(ratio("n_unresolved", "n_units"), ratio("n_raw_unresolved", "n_rows"))
    rules = {"R1": F.col("n_problem") < 8, "R2": F.col("n_flagged") < 5, "R3": F.col("n_runs") != 3, "R4": unresolved >= 0.10, "R5": ratio("n_split", "n_units") >= 0.20}
    found = F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))
    return c.withColumn("violations", F.array_join(found, ",")).withColumn("gate_passed", F.size(found) == 0)


def termination(members: DataFrame, current: DataFrame, stall: int = 0, halted: bool = False, intervals: bool = True) -> DataFrame:
    """One row: triggered (T1 to T4), stop, calls, generation.

    ``members``: the front.  ``current``: the latest row per candidate with generation,
    calls (null: 0) and judgeable.  T1: no change for 3 rounds; T2: over 1,650 calls; T3:
    the newest generation, if not the first, has none to judge; T4: half of the front or
    more ties with another member on both axes, or pruning halted.
    """
    level = tied(members, intervals).agg(F.count(F.lit(1)).alias("tied"))
    by_generation = current.groupBy("generation").agg(F.sum(F.coalesce("calls", F.lit(0))).alias("calls"), F.bool_or("judgeable").alias("any"))
    spent = by_generation.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.max("generation"), F.lit(0)).alias("generation"), F.max_by("any", "generation").alias("any"))
    one = members.agg(F.count(F.lit(1)).alias("size")).crossJoin(level).crossJoin(spent)  # a row each
    rules = {
        "T1": F.lit(stall >= 3), "T2": F.col("calls") > 1650, "T3": (F.col("generation") > 0) & ~F.coalesce("any", F.lit(False)),
        "T4": F.lit(halted) | ((F.col("size") > 0) & (F.col("tied") * 2 >= F.col("size"))),
    }
    hit = F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))
    return one.select(F.array_join(hit, ",").alias("triggered"), (F.size(hit) > 0).alias("stop"), "calls", "generation")


def admit(new: DataFrame, current: DataFrame, model: str, intervals: bool = True, baseline: str = "c000") -> DataFrame:
    """(candidate, status, code) of candidates that ask to enter the ledger.

    Code 2 and no status: the id is there already or origin_reason is blank.  INVALID (3):
    another model, no prompt hash or one that is there.  UNJUDGED (3): the sample gate
    failed.  DOMINATED (0) by the baseline, else ON_FRONT (0) until the front is drawn.
    """
    known = current.select(F.col("candidate").alias("_id"))
    hashes = current.select(F.col("prompt_sha256").alias("_hash")).filter("_hash is not null").distinct()
    base = current.filter(F.col("candidate") == baseline).select(F.struct(*[F.col(c) for c in current.columns if c[:3] in ("rec", "pre")]).alias("b"))
    row = F.struct(*new.columns)
    x = new.select("*", row.alias("n")).join(known, F.col("candidate") == F.col("_id"), "left").join(hashes, F.col("prompt_sha256") == F.col("_hash"), "left").join(base, F.lit(True), "left")
    refused = F.col("_id").isNotNull() | (F.trim(F.coalesce("origin_reason", F.lit(""))) == "")
    invalid = ~F.col("model").eqNullSafe(F.lit(model)) | (F.coalesce("prompt_sha256", F.lit("")) == "") | F.col("_hash").isNotNull()
    worse = F.coalesce(dominates("b", "n", intervals), F.lit(False)) & (F.col("candidate") != baseline)
    status = F.when(refused, None).when(invalid, "INVALID").when(~F.coalesce("gate_passed", F.lit(False)), "UNJUDGED").when(worse, "DOMINATED").otherwise("ON_FRONT")
    return x.select("candidate", status.alias("status"), F.when(refused, 2).when(status.isin("INVALID", "UNJUDGED"), 3).otherwise(0).alias("code"))
