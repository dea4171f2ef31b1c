"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and texts whose labels it does not look at (U).
The risk estimator corrects for the toxic share ``prior`` of U:

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss, so that the sigmoid of the output estimates the probability.
When the second term falls below zero, a step climbs it instead (the non-negative
correction), which keeps a flexible model from explaining P away.

Features are the presence of words and of word beginnings (written with a star) that P
holds significantly more often than U does, counted over the training sample by Spark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_frames

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features.
BEGINNINGS = (5, 6, 7, 8)
#: Toxic texts to one clean one where no label says otherwise.
RARE = 0.01


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 4 (null: of the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


def words_of(text: str | None) -> set[str]:
    """The words of a text, for training and scoring alike."""
    return set(LETTERS.findall((text or "").lower()))


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self):  # noqa: ANN201
        weight = dict(zip(self.words, self.weights.tolist(), strict=True))
        whole = {w for w in weight if not w.endswith("*")}
        begin = {n: {w[:-1] for w in weight if w.endswith("*") and len(w) == n + 1} for n in BEGINNINGS}
        begin = {n: some for n, some in begin.items() if some}

        def score(text: str | None) -> float:
            words = words_of(text)
            found = list(whole & words)
            for n, some in begin.items():
                found += [f"{w}*" for w in some.intersection([w[:n] for w in words if len(w) > n])]
            z = self.bias + sum(weight[w] for w in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model by Adam on the non-negative PU risk."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1e-3, p.shape[1] + 1)
    p1, u1 = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    m, s = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        zp, zu = p1 @ w, u1 @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = -prior * (p1.T @ (1 - sig(zp))) / len(p1)
        down = u1.T @ sig(zu) / len(u1) - prior * (p1.T @ sig(zp)) / len(p1)
        grad = up + down if negative >= 0 else -down
        grad[:-1] += decay * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000, words: int = 256, least: int = 8, z: float = 5.0) -> Model:
    """Fit on rows of ``labels`` outside fold 2.

    At most ``positives`` toxic and ``unlabelled`` further texts are read, those with the
    smallest hashes of doc_id: the sample's bound, so the fit costs the same at any size.
    U is drawn from all of these rows whatever their label, which isn't looked at; ``prior``
    is the toxic share of all labelled rows outside fold 2.  At most ``words`` features,
    each in ``least`` texts of P; of equally telling ones the first by its letters.

    Labels without doc_id or value take no part; of several labels of a doc_id the highest
    counts; of several texts of a doc_id that of the smallest hash.  Null and empty texts have
    no features.  Without any label a model that calls nothing toxic is given (prior RARE to
    1), and so it is with labels that are all clean; labels that are all toxic give one that
    calls everything toxic.  Extra columns are ignored.
    """
    known = labels.filter((fold() != 2) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return Model([], np.zeros(0), float(np.log((toxic + RARE) / (n - toxic + 1))))
    hashed = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(hashed).limit(positives).select("doc_id", F.lit(1).alias("p"))
    others = known.orderBy(F.xxhash64("doc_id", F.lit(1))).limit(unlabelled).select("doc_id", F.lit(0).alias("p"))
    # at most positives + unlabelled rows of two numbers: a proven bound
    sample = docs.join(F.broadcast(chosen.unionByName(others).withColumnRenamed("doc_id", "_id")), docs["doc_id"] == F.col("_id"))
    # rows that share a doc_id are one text, so the bound holds for rows too
    sample = sample.groupBy("doc_id", "p").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "w": [sorted(w | {f"{x[:n]}*" for x in w for n in BEGINNINGS if len(x) > n}) for w in map(words_of, batch["text"])]})

    found = in_frames(sample.select("p", "text"), features, "p int, w array<string>")
    found = found.persist()
    try:
        total = dict(found.groupBy("p").count().collect())
        np_, nu = total.get(1, 0), total.get(0, 0)
        if not np_ or not nu:
            return Model([], np.zeros(0), float(np.log(toxic / (n - toxic))))
        counts = found.select("p", F.explode("w").alias("w")).groupBy("w").agg(F.sum("p").alias("cp"), F.sum(1 - F.col("p")).alias("cu"))
        rp, ru = F.col("cp") / np_, F.col("cu") / nu
        pooled = (F.col("cp") + F.col("cu") + 1) / (np_ + nu + 2)
        lift = (rp - ru) / F.sqrt(pooled * (1 - pooled) * (1 / np_ + 1 / nu))
        top = counts.filter(F.col("cp") >= least).select("w", lift.alias("z")).filter(F.col("z") >= z).orderBy(F.desc("z"), "w").limit(words)
        names = sorted(r["w"] for r in top.collect())
        rows = found.select("p", F.array_intersect("w", F.array(*map(F.lit, names)).cast("array<string>")).alias("w")).collect()
    finally:
        found.unpersist()
    at = {w: i for i, w in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[w] for w in r["w"]]] = 1
    label = np.array([r["p"] for r in rows])
    weights, bias = nnpu(x[label == 1], x[label == 0], toxic / n)
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; nothing but the text is scored.

    Null and empty texts get the score of a text without any feature.  Repeated rows score
    alike.  A null doc_id falls into the fold of the empty text.  An empty table gives an
    empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = model.scorer()
        for batch in batches:
            scores = np.array([one(t) for t in batch["text"]], np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": (scores >= threshold).astype(np.int32)})

    held = docs.select("doc_id", (fold() == 2).alias("held_out"), "text")
    return in_frames(held, run, "doc_id long, held_out boolean, score double, predicted int")


def python_fold(doc_id: int | None) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4
