"""Places, running totals, lags and quantiles over ranges, against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import metrics, ordered, pareto, prompts, reports, stats, trials
from assay.plans import shared


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(["hot", "a", "b", None][int(k)], int(i), float(v)) for i, (k, v) in enumerate(zip(rng.choice(4, 400, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 40, 400), strict=True))]
    return made, spark.createDataFrame([(k, i, None if i % 17 == 0 else v) for k, i, v in made], "k string, i long, v double").repartition(7)


def test_running_and_place(rows):
    _, df = rows
    got = sorted((r["i"], r["place"], r["total"]) for r in ordered.running(df, [F.col("i")], {"place": F.lit(1).cast("long"), "total": F.coalesce("v", F.lit(0.0))}).collect())
    values = {r["i"]: r["v"] or 0.0 for r in df.collect()}
    sums = [0.0, *itertools.accumulate(values[i] for i in sorted(values))]
    assert got == [(i, n, sums[n]) for n, i in enumerate(sorted(values))]
    assert ordered.place(df.filter("false"), [F.col("i")]).count() == 0


def test_previous(rows):
    made, df = rows
    got = {r["i"]: r["before"] for r in ordered.previous(df, ["k"], [F.col("i")], "v").collect()}
    last, want = {}, {}
    for k, i, v in made:
        want[i] = last.get(k)
        last[k] = None if i % 17 == 0 else v
    assert got == want


def test_quantiles(rows):
    made, df = rows
    got = {r["k"]: (r["lo"], r["mid"]) for r in ordered.quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
    for key in ("hot", "a", "b", None):
        values = [v for k, i, v in made if k == key and i % 17]
        assert np.allclose(got[key], np.quantile(values, [0.1, 0.5]))


def test_stalls(spark):
    fronts = ["a", "a", "a", "b", "b", "a", "a", "a", "a"]
    df = spark.createDataFrame(list(enumerate(fronts)), "round long, front string").repartition(3)
    assert [r["stall"] for r in pareto.stalls(df).orderBy("round").collect()] == [0, 1, 2, 0, 1, 0, 1, 2, 3]


def test_draws_of_a_large_size(spark):
    state, want, size = stats.SEED, [], 3 * 10**6
    for _ in range(50):
        state = (stats.LCG_A * state + stats.LCG_C) % 2**64
        want.append(((state >> 17) * size) >> 47)
    got = [r["pos"] for r in stats.draws(spark, size, 5, at_once=7, each=10).orderBy("b").collect()]
    assert sorted(got) == sorted(want)


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_variants_and_templates(spark):
    words = prompts.Wording(task="Judge. End.")
    assert prompts.edited(words, "task", "Judge.", " Strictly.").task == "Judge. Strictly. End."
    with pytest.raises(ValueError):
        prompts.edited(words, "task", "absent")
    row = spark.range(1).select(prompts.filled("a {x} {{y}} {z}", x=F.lit("1"), z=F.lit(None).cast("string")).alias("t")).first()
    assert row["t"] == "a 1 {y} "


def test_runs_of_an_arm(spark):
    q = spark.createDataFrame([(1, "ok", "e"), (2, "none", "e"), (3, "fail", "e"), (4, "bad", "e")], "qid long, question string, evidence string")

    def answer(question, evidence):
        if question == "fail":
            raise OSError
        return {"ok": '```json\n{"claims": [{"text": "t"}]}\n```', "none": '{"claims": []}', "bad": "no"}[question]

    got = {r["qid"]: r for r in reports.run_arms(q, answer, lambda e, c: '{"items": [{"verdict": "no"}]}', lambda d, p: "broken").collect()}
    assert got[1]["needs_revision"] and got[1]["final"] == got[1]["draft"] and got[2]["final"] == '{"claims": []}'
    assert not got[3]["done"] and got[4]["draft"] is None and got[4]["done"]


def test_verdicts_of_fronts(spark):
    def verdict(*won, **more):
        df = spark.createDataFrame([*won], "mine int, theirs int, dominates boolean, covers boolean")
        return trials.front_verdict(df, 2, (0, 1), **more).first()["verdict"]

    yes, no = (True, True), (False, True)
    assert verdict((2, 0, *yes), (2, 1, *yes), (0, 2, False, False)) == "V1"
    assert verdict((2, 0, *yes), (2, 1, *no)) == "V2_C0" and verdict((2, 0, *no), (2, 1, *yes)) == "V2_C1"
    assert verdict((2, 0, *no), (2, 1, *no), (0, 2, *no), (1, 2, *no)) == "V3" and verdict((0, 2, *yes), (2, 1, *yes)) == "V4"
    assert verdict((2, 0, *yes), halted=True) == "V5" and verdict((2, 0, *yes), control="FAIL") == "V6" and verdict((2, 0, *no), sizes=(1, 1, 1)) == "V7"


def test_axes_by_name(spark):
    df = spark.createDataFrame([("C", "CONTRADICTED"), ("I", "SUPPORTED"), ("S", "SUPPORTED")], "human string, maj string")
    assert df.agg(*[f().alias(n) for n, f in metrics.AXES.items()]).first().asDict() == {"recall": 0.5, "precision": 1.0}
