"""Packing, manifest and whitening against brute force, with every odd case."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assay.llm import merkle, packing, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, digest string, x string, _group string"
LONG = "".join(f"Word{i % 977}, and{i % 13} x{i} " for i in range(9000))
BASE = [
    (1, "The quick brown fox\njumps over it's LAZY dog", "s1"), (2, "The quick brown fox\njumps over it's LAZY dog", "s1"), (3, "", "s2"), (4, None, "s2"), (5, " \n\t ", None),
    (6, LONG, "s2"), (None, "no id\nbut words here", "s1"), (None, None, None), (7, "same\nrow", "s3"), (7, "same\nrow", "s3"), (7, "other\nrow", "s3"),
    (8, "日本語 text² ½ 'S it's<|endoftext|> we're é ΣΑΣ a\x1cb\x1dc İ", "é"), (9, "'stop 'sun I'LL #$% 12ab", "Z"), (2**53 + 1, "large id", "s1"),
    *[(100 + i, f"row {i}\n{'w ' * (i * 37 % 900)}", "big") for i in range(70)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i else None, s, None if i == 9 else len(t or ""), 5, "clash", "clash", "clash") for i, t, s in BASE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_pack(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack(docs, capacity=512).cache()
    rows = got.collect()
    want = Counter()
    for i, t, _ in BASE:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, a in enumerate(range(0, len(ids), 512)):
            want[i, p, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()), ids[a : a + 512].tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], packing.tokens(r["ids"]).tobytes()) for r in rows) == want
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in inside.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))] and sum(n for _, n in found) <= 512
    assert len(inside) <= -(-sum(r["length"] for r in rows) // 512) + 1
    whole = {r["sequence_id"]: r for r in packing.sequences(got).collect()}
    for r in rows:
        s = whole[r["sequence_id"]]
        assert np.frombuffer(s["ids"], "<u4")[r["offset"] : r["offset"] + r["length"]].tobytes() == packing.tokens(r["ids"]).tobytes()
    assert packing.pack(docs.filter("false")).count() == 0 and packing.pack(docs.filter("text is null")).count() == 2


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1), st.integers(1, 8))
def test_plan_is_exact(histogram, rounds):
    lengths, held = sorted(histogram), Counter()
    configs = packing.plan(histogram, 64, rounds)
    for config, often in configs:
        assert sum(n * a for n, a in config) <= 64
        for n, a in config:
            held[n] += a * often
    assert held == Counter(histogram)
    table = packing.slots(configs)
    n = np.repeat(lengths, [histogram[x] for x in lengths])
    number = np.concatenate([np.arange(histogram[x]) for x in lengths])
    sequence, offset = packing.located(table, n, number)
    cells = [(s, o + k) for s, o, size in zip(sequence.tolist(), offset.tolist(), n.tolist(), strict=True) for k in range(size)]
    assert len(set(cells)) == len(cells) and max(o for _, o in cells) < 64


def test_plan_beats_best_fit_where_it_wastes():
    rng = np.random.default_rng(3)
    histogram = Counter(rng.integers(1100, 2200, 5000).tolist())
    lengths = np.array(sorted(histogram))
    plain = sum(packing.best_fit(lengths, np.array([histogram[int(n)] for n in lengths]), 4096).values())
    assert sum(often for _, often in packing.plan(histogram)) < plain


def test_knapsack_against_all_sets():
    lengths, value = np.array([3, 5, 7]), np.array([3.5, 5.0, 8.25])
    best, _ = packing.knapsack(lengths, value, 20)
    for c in range(21):
        sums = [a * 3.5 + b * 5.0 + d * 8.25 for a in range(7) for b in range(5) for d in range(3) if 3 * a + 5 * b + 7 * d <= c]
        assert best[c] == max(sums)


def plain_tree(leaves, fanout):
    """Root, and each leaf's siblings from the bottom up."""
    level, beside, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // fanout * fanout
            beside[i].append((p - run, [d for k, d in enumerate(level[run : run + fanout]) if k != p - run]))
        level = [hashlib.sha256("".join(level[i : i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], beside


def plain_leaf(i, source, lang, n, text):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)).encode()).hexdigest()


@pytest.mark.parametrize("fanout,levels", [(3, 5), (3, 1), (2, 2), (5, 1)])
def test_manifest(docs, fanout, levels):
    from pyspark.sql import functions as F

    lost = F.replace("text", F.lit("\n"), F.lit(""))
    got = merkle.audit(merkle.build(docs, seen={"text": F.when(F.col("doc_id") % 2 == 0, lost).otherwise(F.col("text"))}, fanout=fanout, levels=levels)).collect()
    rows = [(i, s, "en" if i else None, None if i == 9 else len(t or ""), t) for i, t, s in BASE]
    groups = sorted({s for _, s, *_ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in groups:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees.append((own, *plain_tree([plain_leaf(*r) for r in own], fanout)))
    root, over = plain_tree([t[1] for t in trees], fanout)
    want = []
    for (own, subroot, beside), above in zip(trees, over, strict=True):
        for r, path in zip(own, beside, strict=True):
            seen = plain_leaf(*r[:4], r[4].replace("\n", "") if r[4] and r[0] is not None and r[0] % 2 == 0 else r[4])
            folded = seen
            for position, others in path + above:
                folded = hashlib.sha256("".join([*others[:position], folded, *others[position:]]).encode()).hexdigest()
            proof = "".join(d for _, others in path + above for d in others)
            want.append((r[0], plain_leaf(*r), seen, subroot, root, hashlib.sha256(proof.encode()).hexdigest(), folded, folded == root, proof))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_little(spark, docs):
    assert merkle.audit(merkle.build(docs.filter("false"))).count() == 0
    (one,) = merkle.digest(docs.filter("doc_id = 3")).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_manifest_sql(spark, docs, tmp_path):
    docs.filter("doc_id is not null").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    got = merkle.digest(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(merkle.ORACLE).fetchall()))


def test_whitening(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i, [float(x) for x in r], "clash") for i, r in enumerate(v)] + [(5, [float(x) for x in v[5]], "c"), (None, [float(x) for x in v[6]], "c")]
    odd = [(900, None, "c"), (901, [1.0, None] + [0.0] * 10, "c"), (902, [float("nan")] * 12, "c"), (903, [float("inf")] * 12, "c"), (904, [], "c")]
    got = whitening.digest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x string").repartition(4)).collect()
    x = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64) + 100_000
    n, y = len(x), len(x) * x - x.sum(axis=0)
    assert Counter(r["vec_id"] for r in got) == Counter({r[0]: 8 for r in rows} | {5: 16})
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    deviation = {(r[0], int(d)) for r, d in zip(rows, (y * y).sum(axis=1), strict=True)}
    assert {(r["vec_id"], r["deviation"]) for r in got} == deviation
    values, axes = np.linalg.eigh((y / n).T @ (y / n) / n)
    for k in range(1, 9):
        own = {r["vec_id"]: r for r in got if r["component"] == k}
        want = (y / n) @ axes[:, -k] / np.sqrt(values[-k])
        have = np.array([own[r[0]]["whitened"] for r in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert abs(own[0]["explained"] / (values[-k] / values.sum()) - 1) < 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    flat = whitening.digest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [7.0])], schema)).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat} == {
        (1, 1, 2, 0, None, 0.0, None), (1, 2, 2, 0, None, 0.0, None), (2, 1, 2, 0, None, 0.0, None), (2, 2, 2, 0, None, 0.0, None), (3, 1, 1, 0, None, 0.0, None)}
    line = whitening.digest(spark.createDataFrame([(i, [i * 1e9, -i * 1e9]) for i in range(4)], schema)).collect()
    assert {r["whitened"] is None for r in line if r["component"] == 2} == {True} and max(r["identity_error"] for r in line) < 1e-9
    wide = whitening.whiten(spark.createDataFrame([(i, [i * 1e12, -i * 1e12]) for i in range(4)], schema)).collect()
    x = [1024 * i * 10**12 for i in range(4)]
    assert {r["vec_id"]: int(r["deviation"]) for r in wide} == {i: 2 * (4 * x[i] - sum(x)) ** 2 for i in range(4)}
