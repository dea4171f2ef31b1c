"""Near-duplicates of the pipeline: exact 5-word similarity of 0.8 or more, against all pairs."""

import itertools

import corpus_pipeline
from pyspark.sql import functions as F

from assay.llm import simhash



def shingle_set(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, least=0.8):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or (a | b and len(a & b) >= least * len(a | b)):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def test_edited_copies_go(spark):
    base = [f"w{i}" for i in range(200)]
    few, many = list(base), list(base)
    for at in (20, 80, 140):  # 15 of 196 shingles: similarity 0.86
        few[at] = "edited"
    for at in range(5, 200, 12):
        many[at] = "edited"
    rows = [(1, " ".join(base)), (2, " ".join(few)), (3, " ".join(many)), (4, " ".join(base)), (5, ""), (6, None), (None, " ".join(few)), (7, "a b"), (8, "A b"), (7, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5, 7]
    assert simhash.drop_similar(docs.filter("false")).count() == 0


def test_same_as_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    comp = brute([t for _, t in rows])
    assert sorted(r["doc_id"] for r in simhash.drop_similar(docs).collect()) == [rows[c][0] for c in sorted(set(comp))]


def test_blocks_of_a_list(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r["doc_id"]: r["root"] for r in simhash.similar(docs, list_rows=4).collect()}
    comp = brute(texts)
    assert len(set(roots.values())) == len(set(comp)) and all(roots[i] == roots[c] for i, c in enumerate(comp))


def test_chance_bytes_do_not_link(spark, monkeypatch):
    """Texts that agree in one sketch and in nothing else stay apart before their texts are read."""
    rng = simhash.np.random.default_rng(3)
    made = rng.integers(0, 256, (60, 8 * simhash.SKETCHES), dtype=simhash.np.uint8)
    made[:, :4] = 7  # half of the first sketch is the same everywhere
    near = made[0].copy()
    near[rng.choice(32, 10, replace=False)] += 1
    rows = [(i, *m.view(simhash.np.int64).tolist()) for i, m in enumerate([*made, near])]
    own = [f"f{k}" for k in range(simhash.SKETCHES)]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{f} long" for f in own))
    linked = simhash._index(nodes.withColumnRenamed("f0", "fp").withColumn("f0", F.col("fp")).select("fp", "node", *own), 4, 3, 16, simhash._many_bytes(simhash.SHARED), "node", *own)
    assert {(r["src"], r["dst"]) for r in linked.collect()} == {(60, 0)}


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity just above 0.8: all but a few of a thousand are found."""
    rnd, rows = simhash.np.random.default_rng(11), []
    for i in range(250):
        words = [f"t{i}x{x}" for x in rnd.integers(0, 10**6, 120)]
        other = list(words)
        for at in (30, 80):  # 10 of 116 shingles: similarity 0.84
            other[at] = "edited"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(250)} <= left and len(left) <= 252
