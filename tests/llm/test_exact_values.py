"""Ids beyond 2**53 beside nulls, repeated rows, and input columns whose names clash with the operators' own."""

import hashlib

import numpy as np
import pytest
import zlib

from assay.llm import bpe, licenses, mixing, pii, quality, secrets, simhash, tokenbin, toxicity

BIG = 2**53 + 1
WORDS = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (BIG, WORDS), (BIG + 2, WORDS), (None, "red orange yellow green blue violet black white grey brown pink cyan"), (None, None),
    (BIG + 4, "Released under the MIT License and then some more words that fill it up here"), (BIG + 4, "Released under the MIT License and then some more words that fill it up here"),
    (2**63 - 1, "mail bob@example.com or Mr Smith, password = hunter2secret, and ten or more words to pass"), (-(2**63) + 1, ""),
]
IDS = sorted(str(i) for i, _ in ROWS)
NAMES = ("secrets", "entities", "n_entities", "_assign", "_email", "_all", "_own", "_h", "_digits", "row", "t", "found", "id", "own", "hit", "_mix_s", "_me", "_th", "_root", "_key", "size", "th", "fp", "root")


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n} {k}" for n in NAMES]) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, schema).coalesce(1)  # nulls and large ids in one batch


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.collect())


def test_ids_stay(docs):
    labels = docs.select("doc_id").dropna().distinct().selectExpr("doc_id", "0 as toxic")
    assert ids(quality.measure(docs)) == IDS
    assert ids(simhash.near_duplicates(docs)) == IDS
    assert ids(bpe.digest(docs)) == IDS and ids(bpe.digest(docs, size=20, overlap=10)) == IDS
    assert ids(tokenbin.digest(docs)) == IDS
    assert ids(toxicity.score(docs, toxicity.train(docs, labels))) == IDS
    assert ids(secrets.digest(docs)) == IDS and ids(mixing.mix_sizes(docs)) == IDS and ids(pii.replace(docs)) == IDS
    assert ids(licenses.scan(docs)) == [str(BIG + 4)] * 2
    assert ids(quality.keep_good(docs)) == sorted(map(str, [BIG, BIG + 2, None, BIG + 4, BIG + 4, 2**63 - 1]))
    left = sorted(map(str, [BIG, None, BIG + 4, 2**63 - 1, -(2**63) + 1]))
    assert ids(simhash.drop_similar(docs)) == left
    assert [str(r["doc_id"]) for r in simhash.drop_near_duplicates(docs.filter(f"doc_id is null or doc_id < {BIG + 4}")).collect()].count(str(BIG + 2)) == 0
    members = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert members[BIG] == members[BIG + 2] == BIG


def test_other_columns_stay(docs):
    values = {tuple(r[n] for n in NAMES) for r in docs.collect()}
    for out in (secrets.redact(docs), quality.keep_good(docs), simhash.drop_near_duplicates(docs), mixing.mix(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and {tuple(r[n] for n in NAMES) for r in rows} <= values
    out = pii.replace(docs)
    own = [n for n in NAMES if n != "n_entities"]
    assert {tuple(r[n] for n in own) for r in out.collect()} == {tuple(r[n] for n in own) for r in docs.collect()}
    assert {r["n_entities"] for r in out.collect()} == {0, 2}
    found = secrets.find(docs)
    assert found.columns[-1] == "secrets" and {r["entities"] for r in found.collect()} == {r["entities"] for r in docs.collect()}
    by_id = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert "hunter2" not in by_id[2**63 - 1]["text"] and by_id[2**63 - 1]["n_chars"] == len(by_id[2**63 - 1]["text"])


def test_empty_table(docs):
    none = docs.filter("false")  # of the pair operators see the pipeline's test
    assert all(df.count() == 0 for df in (secrets.redact(none), pii.replace(none), quality.keep_good(none), mixing.mix(none), licenses.scan(none)))


def test_token_ids_equal_the_library():
    """Pre-tokens given to the model one by one give what the library's own entry gives."""
    import public_tokenizers as P
    path = P.path(tokenbin.VOCABULARY)
    hf = tokenbin.tokenizer(path)[0]
    rng = np.random.default_rng(4)
    alphabet = list("abcXYZ019 '\t\n.,-_éßñ½²Ⅷ日本语اب​\x1c\x85 ­😀퟿") + ["'s", "'re", "  ", "the ", "<|endoftext|>", "<|endof"]
    for _ in range(3000):
        text = "".join(alphabet[i] for i in rng.integers(len(alphabet), size=int(rng.integers(1, 40))))
        assert np.frombuffer(tokenbin.encode(text, path), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids, repr(text)
    with pytest.raises(ValueError):
        tokenbin.tokenizer(P.path("word_bpe_49k.json"))


def test_long_texts(spark):
    import public_tokenizers as P
    long = " ".join(f"w{i % 5003} x{i % 31}" for i in range(60000)) + " Released under the MIT License, mail bob@example.com"
    d = spark.createDataFrame([(1, long), (2, long), (3, "short one")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(d).orderBy("doc_id").collect()] == [(1, "MIT"), (2, "MIT")]
    out = {r["doc_id"]: r["text"] for r in pii.replace(d).collect()}
    assert out[1] == out[2] and out[1][: len(long) - 20] == long[:-20] and "bob@" not in out[1]
    hf = tokenbin.tokenizer(P.path(tokenbin.VOCABULARY))[0]
    want = np.array([*hf.encode(long, add_special_tokens=False).ids, 2], "<u4").tobytes()
    got = {r["doc_id"]: r for r in tokenbin.digest(d).collect()}
    assert got[1]["ids_crc32"] == got[2]["ids_crc32"] == zlib.crc32(want) and got[2]["start"] == len(want) // 4
    assert {r["decoded_sha256"] for r in bpe.digest(d).collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in (long, "short one")}
