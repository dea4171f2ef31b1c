"""Places and running totals over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import table


def running(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``totals`` over the rows before it in ``order``.

    Rows are ranged to partitions, each sums its own, and the sums of the partitions before
    are added: the only window without keys is over one row per partition.  ``order`` must
    tell rows apart, or the order of equal ones is any.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    at = {f"_run{i}": total for i, total in enumerate(totals.values())}
    ranged = df.withColumns(at).repartitionByRange(parts, *order)
    ranged = table(ranged.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order), "ranged")
    sums = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"{c}_own") for c in at])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"{c}_own").over(earlier), F.lit(0)).alias(f"{c}_base") for c in at])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(sums), F.col("_part") == F.col("_p"))  # one row per partition
    named = [(F.col(f"{c}_base") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for c, name in zip(at, totals, strict=True)]
    return out.select(*df.columns, *named)


def place(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``."""
    return running(df, order, {name: F.lit(1).cast("long")})


def leading(df: DataFrame, order: list[Column], value: str, name: str = "best") -> DataFrame:
    """``df`` with the largest ``value`` of the rows before it in ``order``; null if there is none.

    As a running total, but of the maximum: each range has its own, and those of the ranges
    before are one row per partition.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order), "ranged")
    most = ranged.groupBy("_part").agg(F.max(value).alias("_own"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select(F.col("_part").alias("_p"), F.max("_own").over(earlier).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(most), F.col("_part") == F.col("_p"))  # one row per partition
    return out.select(*df.columns, F.greatest("_base", F.max(value).over(inside)).alias(name))


def previous(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str = "before") -> DataFrame:
    """``df`` with ``value`` of the row before it among those of the same ``keys``, in ``order``; null for the first.

    As a lag, but a key with many rows is spread over several tasks: only a partition's first
    row looks at another one, the last row of the partition before.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = [*map(F.col, keys), *order]
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranged = table(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranged")
    last = ranged.groupBy("_part").agg(F.max_by(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")), "_at").alias("_last"))
    # one row per partition
    seams = last.select((F.lead("_part").over(Window.orderBy("_part"))).alias("_p"), "_last").filter("_p is not null")
    out = ranged.join(F.broadcast(seams), F.col("_part") == F.col("_p"), "left")
    inside = Window.partitionBy("_part").orderBy("_at")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_last.k{i}").eqNullSafe(F.col(k))
    here = F.lag(F.struct(*keys, F.col(value).alias("_v"))).over(inside)
    out = out.withColumn("_here", here)
    equal = F.lit(True)
    for k in keys:
        equal = equal & F.col(f"_here.{k}").eqNullSafe(F.col(k))
    return out.select(*df.columns, F.when(F.col("_here").isNotNull(), F.when(equal, F.col("_here._v"))).otherwise(F.when(F.col("_last").isNotNull() & same, F.col("_last.v"))).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between ranks) of ``value`` per key; nulls don't count.

    Equal values are counted first and the counts summed over ranges, so neither a key's
    values nor their sort are in one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = table(running(counted, [*map(F.col, keys), F.col(value)], {"_before": F.col("_n")}), "placed")
    whole = placed.groupBy(*keys).agg(F.min("_before").alias("_base"), F.sum("_n").alias("_total")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    r = placed.join(whole, same).withColumn("_first", F.col("_before") - F.col("_base"))

    def rank(k: Column) -> Column:
        return F.max(F.when((F.col("_first") <= k) & (k < F.col("_first") + F.col("_n")), F.col(value)))

    out = []
    for name, q in at.items():
        pos = (F.col("_total") - 1) * F.lit(q)
        low = F.floor(pos)
        part = F.max(pos - low)
        a, b = rank(low), rank(F.least(low + 1, F.col("_total") - 1))
        out.append((a * (1 - part) + b * part).alias(name))
    return r.groupBy(*keys).agg(*out)
