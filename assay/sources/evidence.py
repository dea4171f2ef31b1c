"""Evidence texts: records under headers that name a standard and a paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: A header, ``[1002 name 문단 34]`` or ``[문단 34A]``, and the address of what has no standard.
HEADER = r"\[\s*([0-9]{3,4})?\s*[^\]]*?문단\s*([0-9]+[A-Za-z]?)\s*\]"
UNKNOWN = "UNKNOWN"


def standard_number(name: Column) -> Column:
    """The first three or four digits of a standard's name, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), "[0-9]{3,4}", 0), F.lit(""))


def addresses(rows: DataFrame, raw: str, default: Column | None = None) -> DataFrame:
    """Standard and paragraph of each record in ``rows``, as ``records`` has them; no body is cut or held."""
    return _each(rows, raw, F.transform(_heads(raw), lambda h: F.struct(h.alias("head"))), default)


def records(rows: DataFrame, raw: str, default: Column | None = None) -> DataFrame:
    """``rows`` without ``raw``, one per header in it: standard, paragraph, body and content_sha256.

    A body runs to the next header or the end, so other brackets stay in it; white space at
    its ends goes.  A header without a standard takes the number in ``default`` (a question's
    standard), else UNKNOWN, so no evidence is lost.  Null texts and texts without a header
    have no record.
    """
    bodies = F.slice(F.split(F.col(raw), HEADER, -1), 2, 1_000_000)
    out = _each(rows, raw, F.arrays_zip(_heads(raw).alias("head"), bodies.alias("body")), default, strip(F.col("_r.body")).alias("body"))
    return out.withColumn("content_sha256", F.sha2("body", 256))


def _heads(raw: str) -> Column:
    return F.regexp_extract_all(F.col(raw), F.lit(HEADER), F.lit(0))


def _each(rows: DataFrame, raw: str, found: Column, default: Column | None, *more: Column) -> DataFrame:
    """A row per header of ``found`` (array of struct(head, ...)): standard, paragraph and ``more``."""
    keep = [c for c in rows.columns if c != raw]
    other = standard_number(default) if default is not None else F.lit(None).cast("string")
    each = rows.select(*keep, other.alias("_default"), F.explode(found).alias("_r"))
    own = F.nullif(F.regexp_extract("_r.head", HEADER, 1), F.lit(""))
    return each.select(*keep, F.coalesce(own, "_default", F.lit(UNKNOWN)).alias("standard"), F.regexp_extract("_r.head", HEADER, 2).alias("paragraph"), *more)
