"""Exact top-k search: tiled matrix products, partial selection, tree merging.

Queries are dealt to blocks, candidates to shards.  A tile is one block against one
shard: a matrix product in numpy that keeps each query's ``k`` best.  The lists of
``fan`` shards are merged at a time until one list per query is left, so no task ever
sees more than ``fan * k`` entries of a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, table

#: Below this, sums of products are exact in double precision.
EXACT = float(2**53)
LONG = (-(2**63), 2**63 - 1)


def scaled(vector: str | Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null
    or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    doubles = F.transform(v, lambda x: x.cast("double"))
    # components beyond 2**52 / scale would not be exact integers
    fine = F.forall(doubles, lambda x: F.coalesce(F.abs(x) < 2.0**52 / scale, F.lit(False)))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if bound < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T  # Python integers; beyond long they are held at its ends
    return np.clip(exact, *LONG).astype(np.int64)


def best_of_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best other candidates; ties to smaller ids."""
    out = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(qid) if len(cid) else 0, 512):
        own, scores = qid[at : at + 512], _products(q[at : at + 512], c)
        other = cid[None, :] != own[:, None]
        if len(cid) > k:
            # a query's own rows, of which there may be several, have the lowest score; equal ones are all kept here
            scores = np.where(other, scores, LONG[0])
            place = len(cid) - k
            other &= scores >= np.partition(scores, place, axis=1)[:, place : place + 1]
        row, col = np.nonzero(other)
        order = np.lexsort((cid[col], ~scores[row, col], row))  # ~x falls as x rises, without overflow
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        row, col = row[best], col[best]
        out.append((own[row], cid[col], scores[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 8192, block_rows: int = 4096, fan: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` highest integer inner products.

    ``vectors``: vec_id, embedding.  Queries are the rows where ``is_query`` holds,
    candidates all rows but the query's own; ties go to smaller ids.  Vectors that are null
    or hold null or non-finite components take no part, nor do rows without vec_id;
    components of 2**52 / scale or more, which have no exact integer, count as non-finite.
    Only vectors of the same length are compared.  An id may have several vectors: none of them is a candidate of its own.  An empty table gives no lists.  Rows that repeat vec_id and vector are
    one row.  Empty vectors score 0.  A query with fewer candidates gets them all.  Scores
    beyond a long are held at its ends.  Extra columns are ignored.
    """
    v = vectors.select("vec_id", scaled("embedding", scale).alias("v"), is_query.alias("q"))
    v = table(v.filter("vec_id is not null and v is not null").distinct(), "vectors")
    size = v.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    shards = max(spread(v), -(-size[0] // shard_rows))
    blocks = max(1, -(-size[1] // block_rows))
    spot = F.xxhash64("vec_id")
    c = v.select(F.pmod(spot, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("v").alias("d"), "vec_id", "v", F.lit(False).alias("q"))
    q = v.filter("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.shiftrightunsigned(spot, 32), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("d"), "vec_id", "v", "q")

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        d = int(rows["d"].iat[0])
        m = np.concatenate([np.asarray(x, np.int64) for x in rows["v"]]).reshape(-1, d) if d else np.zeros((len(rows), 0), np.int64)
        ids, query = rows["vec_id"].to_numpy(np.int64), rows["q"].to_numpy(bool)
        found = best_of_tile(ids[query], m[query], ids[~query], m[~query], k)
        return pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2], "g": rows["shard"].iat[0]})

    lists = c.unionByName(q).groupBy("shard", "block", "d").applyInPandas(tile, "query_id long, vec_id long, score long, g int")
    left = shards
    while True:  # merge the lists of ``fan`` groups at a time
        left = -(-left // fan)
        lists = lists.withColumn("g", F.floor(F.col("g") / fan).cast("int"))
        order = Window.partitionBy("query_id", "g").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if left <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
