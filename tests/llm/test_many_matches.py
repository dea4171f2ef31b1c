"""Texts with very many matches, several vectors of one id, words of every script, the PU risk."""

import re
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import secrets, tokenbin, topk, toxicity


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_spans_over_blocks(spark, n):
    text = "é".join(["x", *["ab12 " + "z" * (i % 7) for i in range(n)]]) + "\U0001f600 end"
    (r,) = spark.createDataFrame([(text,)], "t string").select(secrets.spans(F.col("t"), "[0-9]+").alias("s")).collect()
    assert [(s["start"], s["end"], s["match"]) for s in r["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_touching_spans(spark):
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(900, 120, replace=False)).reshape(-1, 2)
    spans = [{"start": int(a), "end": int(b), "match": "m"} for a, b in at]
    asked = [{"start": int(a), "end": int(a + n), "match": "q"} for a, n in zip(rng.integers(0, 900, 300), rng.integers(1, 30, 300), strict=True)]
    df = spark.createDataFrame([(spans, asked), ([], asked[:3])], f"s {secrets.SPANS}, q {secrets.SPANS}")
    for r in df.select("s", "q", F.transform("q", lambda q: secrets.touches(F.col("s"), q)).alias("t")).collect():
        assert r["t"] == [any(o["start"] < q["end"] and q["start"] < o["end"] for o in r["s"]) for q in r["q"]]


def test_many_secrets_in_one_text(spark):
    """50,000 assignments in 1.3 MB: as plain search, and in seconds."""
    text = "\n".join(f"password = hunter2secret{i:06}" for i in range(50_000))
    began = time.time()
    (r,) = secrets.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s["start"], s["kind"], s["end"]) for s in r["secrets"]] == brute.base_secrets(text)
    assert time.time() - began < 120


@pytest.mark.parametrize("shards", [1, 3])
def test_several_vectors_of_one_id(spark, shards):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 9, 3)]) for i in rng.choice(12, 60)]
    got = {(r["query_id"], r["rank"]): r["score"] for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, k=4, scale=1, shard_rows=60 // shards).collect()}
    distinct, want = {(i, tuple(v)) for i, v in rows}, {}
    for q in {i for i, _ in rows if i % 4 == 0}:
        scored = sorted((-int(np.dot(a, b)), i) for j, a in distinct if j == q for i, b in distinct if i != q)
        want |= {(q, n + 1): -s for n, (s, _) in enumerate(scored[:4])}
    assert got == want
    assert [x.tolist() for x in topk.best_of_tile(np.array([0]), np.array([[1]]), np.array([0, 0, 0, 1, 2, 3, 4]), np.array([[10], [20], [30], [1], [2], [3], [4]]), 2)] == [[0, 0], [4, 3], [4, 3]]


def test_words_are_the_same_in_training_and_scoring(spark):
    texts = ["Ⅷ roman", "naïve Ångström ΣΑΣ", "हिन्दी ไทย العربية", "x² y³ 12ab a_b", "日本語テキスト", "éa"] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, "plain") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, words=1000, least=1, z=0.1)
    seen = set().union(*map(toxicity.words_of, texts))
    assert {w for w in model.words if not w.endswith("*")} <= seen and any("Ⅷ".lower() in w for w in seen)


def test_risk_against_a_plain_version():
    """The fit lowers the plain non-negative PU risk, and its step is the risk's numeric gradient."""
    rng = np.random.default_rng(1)
    p, u, prior = rng.integers(0, 2, (40, 5)).astype(float), rng.integers(0, 2, (90, 5)).astype(float), 0.3
    p[:, 0] = 1

    def risk(w):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean())

    weights, bias = toxicity.nnpu(p, u, prior, decay=0.0)
    fitted, zero = np.append(weights, bias), np.zeros(6)
    assert risk(fitted) < risk(zero)
    near = [np.append(*toxicity.nnpu(p, u, prior, steps=s, decay=0.0, rate=0.01)) for s in (400, 401)]
    numeric = np.array([(risk(near[0] + d) - risk(near[0] - d)) / 2e-6 for d in np.eye(6) * 1e-6])
    assert np.dot(near[1] - near[0], numeric) <= 1e-6  # a step doesn't climb the risk


@pytest.mark.parametrize("edges", [(0, 255), (255, 256), (65_535, 65_536), (2**24 - 1, 2**24), (2**32 - 1, 0)])
@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_ranks_of_one_to_four_bytes(edges, n):
    rng = np.random.default_rng(n)
    ranks = np.where(rng.random(n) < 0.5, *edges).astype(np.uint32) if n else np.zeros(0, np.uint32)
    control, data = tokenbin.pack(ranks)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
    assert tokenbin.unpack(control, data, n).tolist() == ranks.tolist()
