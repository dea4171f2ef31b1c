"""Sources beyond files: commands asked with a prompt, paged services, members of archives.

What fetches is given by the caller and runs in tasks, so many calls go side by side.
"""

from __future__ import annotations

import io
import subprocess
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def command(argv: list[str], timeout: float = 120, retries: int = 0) -> Callable[[str], str | None]:
    """A callable that gives a prompt to a command's standard input and returns what it prints, stripped.

    A call that times out, fails or prints nothing is tried ``retries`` times more; then it is null.
    """
    def ask(prompt: str) -> str | None:
        for _ in range(1 + retries):
            try:
                done = subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout, check=True)
            except (subprocess.SubprocessError, OSError):
                continue
            if done.stdout.strip():
                return done.stdout.strip()
        return None

    return ask


def asked(prompts: DataFrame, ask: Callable[[str], str | None], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``said``: what a callable answers to each prompt; null prompts aren't asked."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else ask(x) for x in texts], dtype=object)

    return prompts.withColumn("said", F.pandas_udf(run, "string")(prompt))


def paged(spark: SparkSession, fetch: Callable[[int, int], list[str]], length: int, pages_at_once: int = 16) -> DataFrame:
    """(place, row) of a service that gives ``length`` rows from an offset: read until a page is short.

    Pages are fetched in waves, side by side; the last wave may ask for some pages beyond the end.
    """
    def wave(first: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for page in batch["id"]:
                    rows = fetch(int(page) * length, length)
                    yield pd.DataFrame({"page": int(page), "place": [int(page) * length + i for i in range(len(rows))], "row": rows}).astype({"place": "int64", "row": object})

        return spark.range(first, first + pages_at_once, 1, numPartitions=pages_at_once).mapInPandas(run, "page long, place long, row string")

    from ..plans.shared import table
    first, whole = 0, None
    while True:
        got = table(wave(first), "pages")  # a page is asked for once
        whole = got if whole is None else whole.unionByName(got)
        full = got.groupBy("page").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == length).count()
        if full < pages_at_once:
            return whole.select("place", "row")
        first += pages_at_once


def archived(spark: SparkSession, path: str, pattern: str = "*.tar*") -> DataFrame:
    """(archive, path, text) of the text members of tar files, compressed or not; an archive is one task's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile():
                            yield pd.DataFrame({"archive": [at], "path": [member.name], "text": [tar.extractfile(member).read().decode("utf-8", "replace")]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, "archive string, path string, text string")
