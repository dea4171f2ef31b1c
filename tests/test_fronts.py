"""Fronts, ties and intervals against all pairs and against the plain resampling."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay import front_queries
from assay.operators import ordered, pareto, stats, trials

COLUMNS = "candidate string, generation int, origin string, n_flagged int, recall double, precision double, recall_lo double, recall_hi double, precision_lo double, precision_hi double"


def pool_of(seed, n, null=0.15):
    """Intervals on a coarse grid, so that many meet exactly, some shifted by eps, some bounds null."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        ends = []
        for _ in range(2):
            a = rnd.randint(0, 20) / 20 + rnd.choice([0, 0, 1e-9, 2e-9])
            b = a + rnd.choice([0, 0.05, 0.1, 0.3])
            ends += [None if rnd.random() < null else a, None if rnd.random() < null else b]
        out.append((f"c{i:03}", rnd.randint(0, 3), rnd.choice(["front_pair", "filter_strip", "front_pair"]), rnd.randint(0, 9), rnd.choice([0.1, 0.5, 0.5 + 1e-9, None, 0.9]), rnd.choice([0.2, 0.5, 0.8]), *ends))
    return out


def cmp(x, y, axis, intervals):
    at = (6, 7, 8, 9) if intervals else (4, 4, 5, 5)
    (xl, xh), (yl, yh) = ((r[at[2 * axis]], r[at[2 * axis + 1]]) for r in (x, y))
    more = xl is not None and yh is not None and xl > yh + 1e-9
    less = yl is not None and xh is not None and yl > xh + 1e-9
    return 1 if more else -1 if less else 0


def dominates(x, y, intervals=True):
    a, b = cmp(x, y, 0, intervals), cmp(x, y, 1, intervals)
    return a >= 0 and b >= 0 and a + b > 0


@pytest.mark.parametrize(("seed", "intervals", "null", "tile"), [(1, True, 0.15, 0), (2, True, 0.0, 5), (3, False, 0.1, 0), (5, True, 0.2, 4096)])
def test_front_and_ties_equal_all_pairs(spark, seed, intervals, null, tile):
    rows = pool_of(seed, 60, null)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = {r["candidate"]: r for r in pareto.front(df, intervals).collect()}
    for y in rows:
        by = sorted(x[0] for x in rows if dominates(x, y, intervals))
        assert (got[y[0]]["dominated_by"], got[y[0]]["on_front"]) == (by, not by)
    assert {r["candidate"]: r["on_front"] for r in pareto.on_front(df, intervals, tile).collect()} == {c: r["on_front"] for c, r in got.items()}
    members = [y for y in rows if got[y[0]]["on_front"]]
    for some in (rows, members):
        level = {x[0] for x, y in itertools.permutations(some, 2) if not cmp(x, y, 0, intervals) and not cmp(x, y, 1, intervals)}
        assert {r[0] for r in pareto.tied(spark.createDataFrame(some, COLUMNS), intervals, tile).collect()} == level
    assert pareto.front(df.filter("false"), intervals).count() == pareto.tied(df.filter("false")).count() == 0


def test_tiles_list_every_pair(spark, monkeypatch):
    monkeypatch.setattr(pareto, "TILE", 7)
    rows = pool_of(4, 40)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r["x"]["candidate"], r["y"]["candidate"]) for r in pareto.pairs(df, df, pareto.dominates("x", "y")).collect()}
    assert got == {(x[0], y[0]) for x in rows for y in rows if dominates(x, y)}
    mine, theirs = rows[:15], rows[15:]
    one = trials.covered(spark.createDataFrame(mine, COLUMNS), spark.createDataFrame(theirs, COLUMNS)).first()
    met = [any(dominates(x, y) or not (cmp(x, y, 0, True) or cmp(x, y, 1, True)) for x in mine) for y in theirs]
    beaten = [any(dominates(x, y) for x in mine) for y in theirs]
    assert (one["covers"], one["dominates"]) == (all(met), all(met) and any(beaten))


def test_large_front_without_pairs(spark):
    """A million candidates: no nested loop and no cross product, the strip of the best is the front."""
    n = 1_000_000
    at = (F.xxhash64("id") % 1_000_003) / 1_000_003.0
    df = spark.range(n).select(F.col("id").cast("string").alias("candidate"), at.alias("recall"), (F.xxhash64(F.col("id") + n) % 1_000_003 / 1_000_003.0).alias("precision"))
    got = pareto.on_front(df, intervals=False)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    r, p = (np.array(c) for c in zip(*df.select("recall", "precision").collect(), strict=True))
    best, front, order = -9.0, 0, np.lexsort((-p, -r))
    for i in order:
        front, best = (front + (p[i] > best), max(best, p[i]))
    assert got.filter("on_front").count() == front


def test_leading(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, rnd.random()])) for i in range(300)]
    got = {r["i"]: r["best"] for r in ordered.leading(spark.createDataFrame(rows, "i long, v double").repartition(5), [F.col("i")], "v").collect()}
    best = None
    for i, v in rows:
        assert got[i] == best
        best = v if best is None or (v is not None and v > best) else best


def plain_sums(units, keys, by, rounds, seed=stats.SEED):
    names, state, out = sorted({u[by] for u in units}), seed, {}
    for b in range(rounds):
        drawn = []
        for _ in names:
            state = (state * stats.LCG_A + stats.LCG_C) % 2**64
            drawn.append(names[((state >> 17) * len(names)) >> 47])
        for key in keys:
            sums = [0, 0, 0]
            for name in drawn:
                for u in units:
                    if u["candidate"] == key and u[by] == name:
                        sums = [s + x for s, x in zip(sums, u["pfd"], strict=True)]
            out[key, b] = tuple(sums)
    return out


@pytest.mark.parametrize(("slice_", "slices"), [(1 << 16, 64), (4, 2), (3, 1)])
def test_resampling_over_slices(spark, slice_, slices):
    rnd = random.Random(7)
    units = [{"candidate": c, "pos": i, "pfd": [rnd.randint(0, 1), rnd.randint(0, 300), rnd.randint(0, 1)]} for c in [f"k{j:02}" for j in range(18)] for i in range(23)]
    cells = spark.createDataFrame([(u["candidate"], u["pos"], *u["pfd"]) for u in units], "candidate string, pos long, p long, f long, d long")
    got = {(r["candidate"], r["b"]): (r["p"], r["f"], r["d"]) for r in stats.resampled(cells, ["candidate"], 23, 12, slice_=slice_, slices=slices).collect()}
    assert got == plain_sums(units, {u["candidate"] for u in units}, "pos", 12)
    assert stats.resampled(cells.filter("false"), ["candidate"], 0, 5).count() == 0


def test_changed_labels_give_new_fronts(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    before = {r["candidate"]: r["n_problem"] for r in front_queries.objectives(spark, str(tmp_path)).collect()}
    spark.read.parquet(f"{sf}/labels.parquet").withColumn("toxic", F.lit(1)).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    after = {r["candidate"]: r["n_problem"] for r in front_queries.objectives(spark, str(tmp_path)).collect()}
    assert before.keys() == after.keys() and all(after[c] > before[c] for c in before)
