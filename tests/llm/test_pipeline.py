"""The pipeline and the secret battery against plain versions that share no code with them."""

import hashlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from assay.llm import bpe, secrets
from brute import good, mixed, redacted, secrets as brute_secrets, similar
from test_corpus_operators import tiktoken_of

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
EXTRA = [
    (None, f"{TEXT} null id", "s9"), (2**53 + 1, f"{TEXT} a large id", None), (2**53 + 2, "", "s9"), (2**53 + 3, None, "s9"),
    (2**53 + 5, f"{TEXT} key Xk9fQ2mZ7vB4nT8wR3yL6pD1sH5gJ0 password = hunter2secret", "s9"), (2**53 + 5, f"{TEXT} key Xk9fQ2mZ7vB4nT8wR3yL6pD1sH5gJ0 password = hunter2secret", "s9"),
    (2**53 + 7, " ".join(f"long{i % 4001} x{i}" for i in range(20000)), "s9"), (2**53 + 9, "few words", "s1"),
]


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in EXTRA], documents.schema)
    clash = documents.unionByName(more).selectExpr("*", "'x' as secrets", "'y' as _mix_s", "'z' as th", "doc_id as row")
    clash.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(((r["doc_id"], r["text"], r["source"]) for r in documents.unionByName(more).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    rows = [r for r in rows if good(r[1])]
    root = similar([t for _, t, _ in rows])
    rows = [(i, redacted(t), s) for k, (i, t, s) in enumerate(rows) if root[k] == k]
    enc = tiktoken_of(P.path(bpe.RANKS), P.PATTERN)
    want = []
    for (i, t, _), times in zip(rows, mixed(rows), strict=True):
        want += [repr((i, hashlib.sha256(",".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest()))] * times
    got = sorted(repr((r["doc_id"], r["ids_sha256"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "secret scan", "mix sources", "bpe"]


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_battery_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sets = (letters, letters + "+/", letters + "-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF", letters[:52], "0123456789")
    plain = ("ThisIsACamelCaseName", "some/path/to/a/file/of/some/length", "a-slug-with-many-words-in-it", "a1b2c3d4e5f6g7h8i9j0", "aaaaaaaaaaaaaaaaaaaaaaaa", "01234567890123456789", "getUserById2")
    rows = []
    for i in range(400):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            if rng.random() < 0.5:
                parts.append(plain[rng.integers(len(plain))])
            else:
                some = sets[rng.integers(len(sets))]
                parts.append("".join(some[k] for k in rng.integers(len(some), size=int(rng.integers(15, 60)))))
        rows.append((i, (" " if rng.random() < 0.7 else "/").join(parts)))
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_secrets(t) for i, t in rows}
    assert sum(s[1] == 3 for found in got.values() for s in found) > 100
