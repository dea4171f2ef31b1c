"""Readers and writers of run logs, ledgers, label files and texts; schemas are always given."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

RUN = "id string, run string, label string, rationale string, human string, n_siblings int, candidate_id string, candidate string, `condition` string, model string, prompt_sha256 string, elapsed double, domain string"


def json_lines(spark: SparkSession, paths: list[str], schema: str = RUN, tolerant: bool = False) -> DataFrame:
    """Rows of JSON-lines files with ``file``; a path named twice is read once, one that isn't there fails.

    A line that is no JSON fails the read, or is left out if ``tolerant``.
    """
    mode = "DROPMALFORMED" if tolerant else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(sorted(set(paths))).withColumn("file", F.col("_metadata.file_name"))


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def seed_ledger(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """The first rows of a ledger; fails if there is one, or takes its place if ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def json_array(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Rows of JSON arrays of objects, an array a line, or a file if not ``lines`` (such a file is one task's)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(not lines).lower()).json(path)


def keyed_json(spark: SparkSession, path: str, value: str, lines: bool = False) -> DataFrame:
    """(key, fields...) of JSON objects of objects, one a file, or a line if ``lines``; ``value`` is their struct type."""
    whole = spark.read.text(path, wholetext=not lines)
    entries = whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "v"))
    return entries.select("key", "v.*")


def labels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, human) of label files: a list of objects, or a map of id to label, a file or a line; only S, C and I stay."""
    whole = spark.read.text(path, wholetext=not lines)
    is_list = F.ltrim("value").startswith("[")
    listed = F.from_json("value", "array<struct<id string, human_label string, human string>>")
    from_list = whole.filter(is_list).select(F.explode(listed).alias("r")).select("r.id", F.coalesce("r.human_label", "r.human").alias("human"))
    from_map = whole.filter(~is_list).select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "human"))
    return from_list.unionByName(from_map).filter(F.col("human").isin("S", "C", "I"))


def write_documents(rows: DataFrame, path: str) -> None:
    """(key, document struct) as one JSON text a row: keys in the struct's order, null fields kept, other scripts as they are."""
    key = rows.columns[0]
    rows.select(key, F.to_json("document", {"ignoreNullFields": "false"}).alias("document")).write.parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class _FileWriter(DataSourceWriter):
    """Writes (name, content) rows in the tasks, each task to a folder of its own; the commit moves the files to their place."""

    def __init__(self, at: str, suffix: str) -> None:
        self.at, self.suffix, self.job = at, suffix, uuid.uuid4().hex

    def _where(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.at)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = self._where()
        own, names = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for name, content in iterator:
            with system.open_output_stream(f"{own}/{name}{self.suffix}", compression=None) as out:  # a name tells nothing of what is in it
                out.write(bytes(content))
            names.append(name)
        return _Written(own, names)

    def commit(self, messages: list) -> None:
        system, root = self._where()
        for m in filter(None, messages):
            for name in m.names:
                system.move(f"{m.folder}/{name}{self.suffix}", f"{root}/{name}{self.suffix}")
        self.abort(messages)

    def abort(self, messages: list) -> None:  # noqa: ARG002
        system, root = self._where()
        if system.get_file_info(f"{root}/_temporary-{self.job}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{root}/_temporary-{self.job}")


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:  # noqa: ARG002, FBT001
        return _FileWriter(self.options["at"], self.options["suffix"])


def write_binary(rows: DataFrame, path: str, suffix: str) -> None:
    """(key, content) as a file each, named by the key, written by the tasks that make them.

    A task writes to a folder of its own, and only names come to the driver, which moves the
    finished files; a job that fails puts no file in its place, and what tasks that were still
    running had begun is below _temporary.  The store must be one
    that pyarrow opens from ``path`` on every executor.  Two rows of one key are one file.
    """
    spark = rows.sparkSession
    spark.dataSource.register(_FileSink)
    pafs.FileSystem.from_uri(path)  # an unknown store fails here, before any work
    rows.write.format("named_files").mode("append").option("at", path).option("suffix", suffix).save()


def put_batch(rows: DataFrame, path: str, number: int) -> None:
    """Rows of a batch beside those of the batches before; a batch that comes again replaces itself, so nothing changes."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")


def _finished(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop.Path(f"{path}/{kind}=*")) or []
    return {int(f.getPath().getName().split("=")[1]): f.getPath().toString() for f in found if system.exists(hadoop.Path(f.getPath(), "_SUCCESS"))}


def keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The keyed table that the batches make: of each key the row of the latest batch (of several in it, the largest).

    Batches that were not finished don't count.  Reading starts at the last ``compact``.
    """
    bases, batches = _finished(spark, path, "base"), _finished(spark, path, "batch")
    base = max(bases, default=-1)
    parts = [(base, bases[base])] if bases else []
    parts += [(n, at) for n, at in sorted(batches.items()) if n > base]
    out = None
    for n, at in parts:
        rows = spark.read.schema(schema).parquet(at).withColumn("_batch", F.lit(n).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], schema)
    columns = [c for c in out.columns if c != "_batch"]
    last = F.max_by(F.struct(*columns), F.struct("_batch", F.struct(*columns)))
    return out.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")


def compact(spark: SparkSession, path: str, schema: str, key: str) -> None:
    """All finished batches as one, from which ``keyed`` reads on; the batches stay until they are removed."""
    done = _finished(spark, path, "batch")
    if done:
        keyed(spark, path, schema, key).write.mode("overwrite").parquet(f"{path}/base={max(done):012d}")


def merge_keyed(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Keyed rows merged into a checkpoint and read back: a row replaces the one with its key.

    Each step writes a whole new version beside the old ones, so a step that fails leaves the
    last; versions are numbered, and the highest finished one counts.
    """
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(f.getPath().getName()[2:]) for f in system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*")) if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    merged = rows
    if done:
        old = spark.read.schema(rows.schema).parquet(f"{path}/v={done[-1]}")
        merged = old.join(rows.select(key), key, "left_anti").unionByName(rows)
    new = f"{path}/v={done[-1] + 1 if done else 0}"
    merged.write.parquet(new)
    return spark.read.schema(rows.schema).parquet(new)


def guard(manifest: DataFrame, path: str, warn: tuple[str, ...] = ()) -> DataFrame:
    """A manifest (key, value) written once and compared ever after: (key, before, after, only_warns) of what differs.

    The first call writes it and finds nothing; keys of ``warn`` may change with a warning.
    """
    spark = manifest.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        manifest.select("key", "value").write.parquet(path)
    found = changed(spark.read.parquet(path), manifest)
    return found.withColumn("only_warns", F.col("key").isin(*warn) if warn else F.lit(False))


def digests(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, sha256) of the bytes of files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"))


def texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of the files below ``root`` whose names match, but for those in .git and .venv."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.col("path").rlike(r"/\.(git|venv)/"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries (key, before, after) of two manifests (key, value) that differ or that one lacks."""
    a, b = before.select("key", F.col("value").alias("before")), after.select("key", F.col("value").alias("after"))
    return a.join(b, "key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
