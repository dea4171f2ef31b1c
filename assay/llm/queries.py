"""Queries of this subpackage: each operator on its whole table, and SQL where there is any."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, merkle, mixing, packing, pii, quality, secrets, simhash, tokenbin, topk, toxicity, whitening


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_docs(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.measure(_docs(spark, sf_dir)).select(*columns)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_docs(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_docs(spark, sf_dir).select("doc_id", "text"))


def op10_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digest(_docs(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), with_ids=False)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_docs(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_topk, op2_toxicity, op3_mixing, op4_secrets, op5_quality, op6_licenses, op7_simhash, op8_bpe, op9_pii, op10_tokenbin, op11_packing, op12_merkle, op13_whitening, pipeline)
}
#: The others have none: XXH64, BPE ids, trained scores, eigenvectors, aligned or randomly tested spans.
SQL = {"op1_topk": topk.ORACLE, "op3_mixing": mixing.ORACLE, "op5_quality": quality.ORACLE, "op12_merkle": merkle.ORACLE}
