"""Invariants that end a job: a broken one raises inside the plan, naming the row.

A check is part of the plan of the rows it guards, so nothing is read twice and no result
is written of data that break it; which of several broken rows is named first is any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _said(what: str, ids: tuple[str, ...]) -> Column:
    return F.concat(F.lit(f"{what}: "), F.concat_ws("/", *[F.coalesce(F.col(i).cast("string"), F.lit("null")) for i in ids]))


def refuse(rows: DataFrame, broken: Column, what: str, *ids: str) -> DataFrame:
    """``rows`` as they are; the first for which ``broken`` holds ends the job with ``what`` and its ids.  Unknown isn't broken."""
    return rows.filter(F.when(F.coalesce(broken, F.lit(False)), F.raise_error(_said(what, ids)).cast("boolean")).otherwise(True))


def demand(rows: DataFrame, checks: DataFrame, broken: Column, what: str, *ids: str) -> DataFrame:
    """``rows`` as they are, if no row of ``checks`` (a summary of them, or other data) is broken."""
    none = checks.filter(F.when(F.coalesce(broken, F.lit(False)), F.raise_error(_said(what, ids)).cast("boolean")).otherwise(False))
    return rows.unionByName(none.select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))


def consistent(runs: DataFrame, sheet: DataFrame, key: str = "id") -> DataFrame:
    """Runs (human) joined with a label sheet (label): a run whose own label, if it has one, differs ends the job."""
    both = runs.join(sheet, key)
    said = F.coalesce("human", F.lit(""))
    return refuse(both, (said != "") & ~said.eqNullSafe(F.col("sheet_human")), "label differs from the sheet", key)


def labelled(rows: DataFrame, label: str, allowed: tuple, *ids: str) -> DataFrame:
    """Rows whose label is one of ``allowed``; a blank or other one ends the job."""
    return refuse(rows, F.col(label).isNull() | ~F.col(label).isin(*allowed), "no valid label", *ids)


def quota(rows: DataFrame, chosen: DataFrame, stratum: str, strata: tuple[str, ...], n: int) -> DataFrame:
    """``chosen`` rows, if each of ``strata`` has at least ``n`` rows to choose from; one that has none is short as well."""
    there = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    wanted = rows.sparkSession.createDataFrame([(s,) for s in strata], f"{stratum} string")
    checks = wanted.join(there, F.col(stratum) == F.col("_s"), "left")
    return demand(chosen, checks, F.coalesce("_n", F.lit(0)) < n, f"fewer than {n} rows", stratum)
