"""Intervals and tests as column expressions, and the seeded bootstrap as a plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import table
from .ordered import place

# The generator's multiplier, increment and seed.
LCG_A, LCG_C, SEED = 6364136223846793005, 1442695040888963407, 20260730
Z, Z_PRECISE = 1.96, 1.959963985


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """95 % Wilson interval as struct(lo, hi) within [0, 1]; (0, 1) where n is 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z), 2 * n)) / den
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / den
    inside = F.struct(F.greatest(F.lit(0.0), mid - half).alias("lo"), F.least(F.lit(1.0), mid + half).alias("hi"))
    return F.when(n > 0, inside).otherwise(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p of the two discordant counts: 1 where both are 0.

    The binomial terms are summed in logarithms, so large counts do not underflow.
    """
    n = (b + c).cast("double")
    low = F.least(b, c).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = F.when(i == 0, acc["term"]).otherwise(acc["term"] + F.log((n - i + 1) / F.greatest(i, F.lit(1))))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), low), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def disjoint(a: Column, b: Column) -> Column:
    """Whether two intervals do not overlap."""
    return (a["lo"] > b["hi"]) | (b["lo"] > a["hi"])


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and increments of 1 to ``n`` steps of the generator, modulo 2^64."""
    mul, add = np.array([LCG_A], np.uint64), np.array([LCG_C], np.uint64)
    while len(mul) < n:  # k more steps after each of the first k
        mul, add = np.concatenate([mul, mul * mul[-1]]), np.concatenate([add, mul * add[-1] + add])
    return mul[:n], add[:n]


def _positions(first: int, count: int, size: int, seed: int, at_once: int) -> Iterator[np.ndarray]:
    """Draws ``first`` to ``first + count - 1`` of the sequence, below ``size``, in arrays of at most ``at_once``.

    The sequence is entered by a jump: m steps are one affine step modulo 2^64.
    """
    mul, add = _steps(min(at_once, max(count, 1)))
    a, c, m, state = LCG_A, LCG_C, first, seed % 2**64
    while m:  # binary powers of the affine step
        if m & 1:
            state = (state * a + c) % 2**64
        a, c, m = a * a % 2**64, (c * a + c) % 2**64, m >> 1
    while count:
        n = min(len(mul), count)
        states = mul[:n] * np.uint64(state) + add[:n]
        state, count = int(states[-1]), count - n
        # ((state >> 17) * size) >> 47 in two halves, so that no product leaves 64 bits
        x, big = states >> np.uint64(17), np.uint64(size)
        high, low = x >> np.uint64(24), x & np.uint64((1 << 24) - 1)
        yield ((high * big + (low * big >> np.uint64(24))) >> np.uint64(23)).astype(np.int64)


def draws(spark: SparkSession, size: int, rounds: int, seed: int = SEED, at_once: int = 1 << 18, each: int | None = None) -> DataFrame:
    """(b, pos): the draws below ``size`` of ``rounds`` resamples of ``each`` (``size``, if not said), b-major.

    A block of rounds jumps straight to its place in the sequence, so blocks are made in
    parallel.  ``at_once`` states are one numpy expression, from one state and the factors of
    1 to ``at_once`` steps.
    """
    step, each = max(1, -(-rounds // 64)), size if each is None else each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in map(int, batch["id"]):
                at = first * each
                for pos in _positions(at, (min(rounds, first + step) - first) * each, size, seed, at_once):
                    yield pd.DataFrame({"b": np.arange(at, at + len(pos)) // each, "pos": pos})
                    at += len(pos)

    return spark.range(0, rounds, step, numPartitions=min(64, rounds)).mapInPandas(run, "b long, pos long")


#: Places in a slice (one array), slices that a task holds, keys in an array, and tasks wanted.
SLICE, SLICES, KEYS, TASKS = 1 << 16, 64, 16, 64
#: Draws that are one expression.
AT_ONCE = 1 << 18


def resampled(cells: DataFrame, keys: list[str], size: int, rounds: int, seed: int = SEED, slice_: int = SLICE, slices: int = SLICES) -> DataFrame:
    """Sums of p, f and d per key and resample ``b``, from ``cells`` (the keys, pos, p, f, d).

    No draw is shuffled.  The cells of up to KEYS keys and ``slice_`` consecutive places become
    one compact matrix.  A task takes up to ``slices`` of them and a block of resamples, jumps
    to its draws, counts how often each of its places is drawn, and multiplies the counts with
    the matrix.  What is shuffled is the matrices, once per block of resamples (of which there
    are fewer the more places there are), and one row per key and resample of each task.  A
    task over a part of the places passes over the draws of the others, which costs a few
    nanoseconds each.
    """
    spark = cells.sparkSession
    named = table(place(cells.select(*keys).distinct(), [*map(F.col, keys)], "_key"), "keys")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbers = named.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    at = cells.join(numbers, same).select(
        F.floor(F.col("_key") / KEYS).alias("group"), (F.col("_key") % KEYS).alias("column"), F.floor(F.col("pos") / slice_).alias("slice"), (F.col("pos") % slice_).alias("row"), "p", "f", "d"
    )

    def compact(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows[["p", "f", "d"]].to_numpy(np.int64)
        kind = np.min_scalar_type(int(values.max()))
        m = np.zeros((int(rows["row"].max()) + 1, KEYS * 3), kind)
        for i in range(3):
            m[rows["row"], rows["column"] * 3 + i] = values[:, i]
        return pd.DataFrame({"group": rows["group"].iloc[:1], "slice": rows["slice"].iloc[:1], "kind": kind.str, "m": [m.tobytes()]})

    matrices = table(at.groupBy("group", "slice").applyInPandas(compact, "group long, slice long, kind string, m binary"), "matrices")
    spans = max(1, -(-size // (slice_ * slices)))
    blocks = max(1, min(rounds, -(-TASKS // spans)))
    step = -(-rounds // blocks)
    dealt = matrices.withColumns({"span": F.floor(F.col("slice") / slices), "block": F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // step) - 1)))})

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        low = int(rows["span"].iloc[0]) * slice_ * slices
        high = min(size, low + slice_ * slices)
        first = int(rows["block"].iloc[0]) * step
        held = [(int(s) * slice_ - low, np.frombuffer(m, kind).reshape(-1, KEYS * 3)) for s, kind, m in zip(rows["slice"], rows["kind"], rows["m"], strict=True)]
        n = min(step, rounds - first)
        out, span = np.zeros((n, KEYS * 3), np.int64), high - low
        most = max(int(m.max()) for _, m in held)
        number = np.float64 if most * size < 2**53 else np.int64  # either way sums are exact
        together = max(1, min(n, AT_ONCE // size))  # resamples whose draws are counted at once
        for b in range(0, n, together):
            c, at = min(together, n - b), 0
            times = np.zeros(c * span, np.int64)
            for pos in _positions((first + b) * size, c * size, size, seed, AT_ONCE):
                cell = np.arange(at, at + len(pos)) // size * span + pos - low
                at += len(pos)
                times += np.bincount(cell if span == size else cell[(pos >= low) & (pos < high)], minlength=c * span)
            times = times.reshape(c, span).astype(number)
            for start, m in held:
                out[b : b + c] += (times[:, start : start + len(m)] @ m.astype(number)).astype(np.int64)
        out = out.reshape(n * KEYS, 3)
        b, k = np.divmod(np.arange(n * KEYS), KEYS)
        return pd.DataFrame({"_key": int(rows["group"].iloc[0]) * KEYS + k, "b": first + b, "p": out[:, 0], "f": out[:, 1], "d": out[:, 2]})

    parts = dealt.repartition(min(TASKS, 2 * spark.sparkContext.defaultParallelism) if spans * blocks <= TASKS else spans * blocks, "group", "span", "block")
    sums = parts.groupBy("group", "span", "block").applyInPandas(draw, "_key long, b long, p long, f long, d long").groupBy("_key", "b").agg(*[F.sum(c).alias(c) for c in "pfd"])
    return sums.join(named, "_key").select(*keys, "b", "p", "f", "d")


def bootstrap(units: DataFrame, keys: list[str], cluster: str | None, rounds: int = 2000, seed: int = SEED) -> DataFrame:
    """Percentile intervals (2.5 and 97.5) of recall and precision per key, rounded to 4 places.

    ``units``: the keys, id, human and maj; every key has the same units.  ``cluster``: column
    whose values are drawn (a cluster's units come together), or None to draw units by id.  A
    resample without problems (or without flags) counts for the other rate only; ``_valid`` says
    how many count, and without any the interval is null.  Clusters are summed to counts
    before they are drawn; the draws are made where they are counted (``resampled``).
    """
    by = cluster or "id"
    hit = F.col("maj").isin("CONTRADICTED", "INSUFFICIENT")
    bad = F.col("human").isin("C", "I")
    units = table(units.select(*keys, F.col(by).alias("_by"), "human", "maj"), "units")
    sums = units.groupBy(*keys, "_by").agg(
        F.count(F.when(bad, 1)).alias("p"), F.count(F.when(hit, 1)).alias("f"), F.count(F.when(bad & hit, 1)).alias("d")
    )
    ranked = table(place(units.select("_by").distinct(), [F.col("_by")], "pos"), "ranked")
    size = ranked.count()
    per = resampled(sums.join(ranked, "_by").drop("_by"), keys, size, rounds, seed)
    per = per.select(*keys, F.try_divide(F.col("d").cast("double"), F.col("p").cast("double")).alias("recall"), F.try_divide(F.col("d").cast("double"), F.col("f").cast("double")).alias("precision"))
    at = lambda c, q: F.bround(F.percentile(c, F.lit(q)), 4)
    # at most ``rounds`` values per key
    return per.groupBy(*keys).agg(*[x for c in ("recall", "precision") for x in (at(c, 0.025).alias(f"{c}_lo"), at(c, 0.975).alias(f"{c}_hi"), F.count(c).alias(f"{c}_valid"))])


def below(a_hi: Column, b_lo: Column) -> Column:
    """Whether an interval lies below another as a whole; unknown bounds don't."""
    return F.coalesce(a_hi < b_lo, F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
