"""Run logs and ledgers as streams: resume, latest state, stalls.

State is one small row per key; a restart goes on from the checkpoint.  Results are
written by ``foreachBatch``, which may repeat a batch, so a batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files


def source(spark: SparkSession, path: str, schema: str, at_once: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, ``at_once`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def resume(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, however often its row is written again."""
    return rows.dropDuplicates(keys)


def latest(ledger: DataFrame) -> DataFrame:
    """The current row of each candidate, that of the largest seq (update mode)."""
    held = F.max_by(F.struct("seq", "status"), "seq").alias("r")
    return ledger.groupBy("candidate").agg(held).select("candidate", "r.seq", "r.status")


def stalls(rounds: DataFrame) -> DataFrame:
    """(study, round, stall) of a stream of (study, round, front): rounds in a row with the same front.

    A study's state is its rounds so far.  A round that comes late is put in its place, and the
    rows from it up to the next change of front are given again; ``settled`` reads the last one
    of each.  A round that comes again replaces its front.  A null front equals none.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        new = dict(pair for batch in batches for pair in zip(batch["round"].tolist(), batch["front"].tolist(), strict=True))
        held |= new
        order = sorted(held)
        out, stall, dirty = [], 0, False
        for i, at in enumerate(order):
            same = i > 0 and held[at] is not None and held[at] == held[order[i - 1]]
            stall = stall + 1 if same else 0
            dirty = at in new or (dirty and same) or (i > 0 and order[i - 1] in new)
            if dirty:
                out.append((key[0], at, stall))
        state.update((order, [held[at] for at in order]))
        yield pd.DataFrame(out, columns=["study", "round", "stall"])

    return rounds.groupBy("study").applyInPandasWithState(step, "study string, round long, stall int", "rounds array<bigint>, fronts array<string>", "append", GroupStateTimeout.NoTimeout)


def settled(spark: SparkSession, out: str) -> DataFrame:
    """What ``drain`` wrote of ``stalls``: of each study's round the row of the last batch."""
    rows = spark.read.schema("study string, round long, stall int, batch int").option("basePath", out).parquet(f"{out}/batch=*")
    return rows.groupBy("study", "round").agg(F.max_by("stall", "batch").alias("stall"))


def upsert(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of keyed rows over all that is there into the batches that ``files.keyed`` reads.

    A batch that runs again after a crash between its write and its commit has the same number
    and the same rows, and so leaves the table as it was.
    """
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: files.put_batch(batch, path, number)).start().awaitTermination()


def drain(rows: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Run a stream over all that is there, each batch to a folder of its own."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
