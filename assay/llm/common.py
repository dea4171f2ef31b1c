"""What the operators of this subpackage share: words, frames, sorted groups, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import folder, shared_dir, table  # noqa: F401

#: A word: a run of characters that are neither space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: Arrow types of the columns that Python functions give back.
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


#: Bytes of a batch that become Python objects at a time: whole texts take several times as much there.
FRAME = 1 << 22


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about FRAME bytes at most (a larger row by itself), as views of the ones given."""
    for batch in batches:
        rows = max(1, FRAME * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_frames(rows: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` that keeps every long as it is.

    pandas makes numbers with a null among them floating point, which rounds those above
    2**53.  So Arrow batches are taken, and a column of numbers with nulls becomes one of
    the nullable extension type; ``schema`` is a list of "name type".
    """
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in (part.strip().split(" ", 1) for part in schema.split(", "))])
    nullable = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}

    def frame(batch: pa.RecordBatch) -> pd.DataFrame:
        columns = {n: c.to_pandas(types_mapper=nullable.get) if c.null_count else c.to_pandas() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        return pd.DataFrame(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(map(frame, slices(batches))):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return rows.mapInArrow(run, schema)


class Memo(dict):
    """Pre-token to its ids as bytes, of a worker.

    Once it holds ``most`` it stays as it is, as common ones come early, and starts anew after
    as many misses; long pre-tokens aren't kept.  This changes no result.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int, longest: int = 64) -> None:
        super().__init__()
        self.encode, self.most, self.longest, self.missed = encode, most, longest, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < self.most:
            if len(word) <= self.longest:
                self[word] = ids
            return ids
        self.missed += 1
        if self.missed >= self.most:
            self.clear()
            self.missed = 0
        return ids


#: A key with more than this share of the rows is dealt apart: there are at most 1 / HEAVY such keys.
HEAVY = 1 / 500


def join_counted(rows: DataFrame, counted: DataFrame, key: Column, named: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counted`` (one row per key, column ``named``) on ``key``, hot keys apart.

    ``n`` of ``counted`` is how many of ``rows`` have the key.  The few keys that hold more
    than HEAVY of all rows are at most 500, whatever the corpus, and so are broadcast; the
    rest is shuffled, so no task gets more than that share for one key.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total * HEAVY
    heavy = F.broadcast(counted.filter(hot))
    names = F.broadcast(counted.filter(hot).select(F.col(named).alias("_hot")))
    rest = rows.join(names, key == F.col("_hot"), "left_anti")
    return rows.join(heavy, key == F.col(named)).unionByName(rest.join(counted.filter(~hot), key == F.col(named), how))


def word_count(text: str | Column) -> Column:
    """Number of words as long; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def pieces(rows: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Cut a partition that is sorted by ``key`` into frames that hold whole keys.

    One frame holds many keys, so small groups cost no call of their own; only a group
    that spans batches is carried over.
    """
    left: list[pd.DataFrame] = []
    for batch in rows:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        if left and left[-1][key].iloc[-1] == keys[-1] and keys[0] == keys[-1]:
            left.append(batch)
            continue
        cut = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if keys[0] != keys[-1] else 0
        if left and (cut or left[-1][key].iloc[-1] != keys[0]):
            yield pd.concat([*left, batch.iloc[:cut]], ignore_index=True)
            left = []
        elif cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        left.append(batch.iloc[cut:])
    if left:
        yield pd.concat(left, ignore_index=True)


def spread(df: DataFrame) -> int:
    """Partitions for work that is heavy on few rows: no fewer than the session's."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


Query = Callable[[SparkSession, str], DataFrame]
