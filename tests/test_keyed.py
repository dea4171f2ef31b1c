"""Files written by tasks, keyed batches, and a stream that runs a batch again."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from assay.sources import files, sheets
from assay.streaming import runs

SCHEMA = "id string, n int"


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("f%02d", "id").alias("name"), F.encode(F.repeat(F.format_string("%d,", "id"), 100), "utf-8").alias("content")).repartition(5)
    files.write_binary(rows, str(tmp_path / "out"), ".bin")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"f{i:02d}.bin": f"{i},".encode() * 100 for i in range(40)}
    broken = rows.withColumn("content", F.when(F.col("name") == "f07", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.write_binary(broken, str(tmp_path / "none"), ".bin")
    assert not list((tmp_path / "none").glob("*.bin"))
    sheets.write(spark.createDataFrame([(i, f"a<{i}>") for i in range(12)], "k int, v string").repartition(3), str(tmp_path / "books"), size=2)
    read = sheets.by_header(sheets.cells(spark, str(tmp_path / "books")), "k", "v")
    assert sorted((int(r["k"]), r["v"]) for r in read.collect()) == [(i, f"a<{i}>") for i in range(12)]


def rows_of(spark, path):
    return dict(files.keyed(spark, path, SCHEMA, "id").collect())


def test_later_batches_replace_keys(spark, tmp_path):
    at = str(tmp_path / "t")
    frame = lambda *pairs: spark.createDataFrame(pairs, SCHEMA)
    assert rows_of(spark, at) == {}
    files.put_batch(frame(("a", 1), ("b", 1), ("b", 5)), at, 0)
    files.put_batch(frame(("a", 2), ("c", None)), at, 1)
    want = {"a": 2, "b": 5, "c": None}
    assert rows_of(spark, at) == want
    files.put_batch(frame(("a", 2), ("c", None)), at, 1)
    files.compact(spark, at, SCHEMA, "id")
    assert rows_of(spark, at) == want
    files.put_batch(frame(("c", 3)), at, 2)
    (tmp_path / "t" / "batch=000000000003").mkdir()  # begun and not finished
    assert rows_of(spark, at) == want | {"c": 3}
    shutil.rmtree(tmp_path / "t" / "batch=000000000000")  # what a base covers may go
    assert rows_of(spark, at) == want | {"c": 3}


def test_a_stream_that_repeats_a_batch(spark, tmp_path):
    log, at, state = (str(tmp_path / x) for x in ("log", "t", "state"))
    for part in ((("a", 1), ("b", 1)), (("b", 2), ("c", 2))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        runs.upsert(runs.source(spark, log, SCHEMA), at, state)
    want = {"a": 1, "b": 2, "c": 2}
    assert rows_of(spark, at) == want
    for name in ("1", ".1.crc"):  # as after a crash between the last batch's write and its commit
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    runs.upsert(runs.source(spark, log, SCHEMA), at, state)
    assert rows_of(spark, at) == want
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["batch=000000000000", "batch=000000000001"]


def test_late_rounds_are_put_in_order(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(s, r, rnd.choice("aab")) for s in ("s", "t") for r in range(40)]
    want = {}
    for s in ("s", "t"):
        stall, before = 0, None
        for _, r, front in (x for x in rows if x[0] == s):
            stall = stall + 1 if front == before else 0
            before, want[s, r] = front, stall
    rnd.shuffle(rows)
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    for part in (rows[:30], rows[30:45], rows[45:]):  # a restart after each
        spark.createDataFrame(part, "study string, round long, front string").coalesce(1).write.mode("append").parquet(log)
        runs.drain(runs.stalls(runs.source(spark, log, "study string, round long, front string")), out, state, "append")
    assert {(r["study"], r["round"]): r["stall"] for r in runs.settled(spark, out).collect()} == want
