"""A training corpus from raw documents: quality, near-duplicates, secrets, mix, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of documents.  Stages are written as
Parquet to the folder that the cluster shares and read again, so a lost executor repeats
no earlier stage.

In every stage an empty table stays empty, further columns keep their values whatever their
names, and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import bpe, mixing, quality, secrets, simhash
from assay.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts, having no words, among them.  Repeated rows fare alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike in 0.8 of their 5-word shingles one stays, that of the smallest doc_id (null last; then by the
    text's hash).  Null, empty and blank texts are alike; of repeated rows one stays."""
    return simhash.drop_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null and empty texts as they are, repeated rows alike."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; those it doesn't take go, and those without words.  A null
    source is one of its own; repeated rows come as often as each other."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null text is an empty one."""
    return bpe.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("secret scan", secret_scan),
    ("mix sources", mix_sources),
    ("bpe", tokenise),
]

#: Fingerprints (XXH64), random-looking secrets and BPE ids have no SQL form;
#: tests/llm/test_pipeline.py holds run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
