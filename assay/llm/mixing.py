"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source, documents are taken in key
order until the source's budget is used up: ``full`` whole passes and one cut pass.
The cut is found without sorting a source in one task: keys are ranged into blocks of
about ``block_rows`` documents, and totals of blocks, of groups of blocks and so on give
the prefix sums, level by level, down to the block that holds the cut; only it is sorted.  What is left is one small row per source, so
documents are marked where they are read; neither rows nor texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import place, running
from .common import table, word_count

KEY_BITS = 52


def _key(doc_id: str, seed: int) -> Column:
    """A number below 2**52 from doc_id and seed; the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").alias("_source"),
        word_count("text").alias("size"),
        _key("doc_id", seed).alias("_key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source (``_source``, ``n``, ``source_size``): its weight and target.

    Weights repeat over the sources by code point, null last.  Targets share the sum of
    all sizes by weight, but stop at ``cap`` times the source's size; the excess goes to
    the others by weight until none is above.  Sorted by ``cap * size / weight``, the
    sources that stop come first, so one running sum finds the level of the rest.  Places
    and running sums are distributed: sources may be as many as web hosts.
    """
    s = place(sizes.withColumn("_absent", F.col("_source").isNull()), [F.col("_absent"), F.col("_source")], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap)
    s = running(s.withColumn("_ratio", F.col("_cap") / F.col("_w")), [F.col("_ratio"), F.col("_rank")], {"_spent": F.col("_cap"), "_gone": F.col("_w")})
    s = table(s, "levels")
    everything, all_weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    s = s.withColumn("_left", F.lit(everything) - F.col("_spent")).withColumn("_open", F.lit(all_weights) - F.col("_gone"))
    wide = "decimal(38,0)"

    def product(a: Column, b: Column) -> Column:
        return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")

    stops = product(F.col("_cap"), F.col("_open")) <= product(F.col("_left"), F.col("_w"))
    first = s.filter(~stops).agg(F.min(F.struct("_ratio", "_rank", "_left", "_open")).alias("at")).first()["at"]
    full = F.col("_cap").cast("double")
    if first is None:
        target = full
    else:
        share = product(F.col("_w"), F.lit(first["_left"])).cast(wide).cast("double") / F.lit(float(first["_open"]))
        target = F.when(stops, full).otherwise(F.least(share, full))
    return s.select("_source", "n", "source_size", F.col("_w").alias("weight"), target.alias("target"))


#: Blocks in a group of blocks, groups in a group of groups: the steps down to a cut.
FAN = 1024


def _descend(parts: DataFrame, levels: int) -> DataFrame:
    """(_hp, _hb, _before) of the block that holds each source's cut, from (_p, _block, rest, _sum).

    Totals are summed over groups of FAN ** level blocks.  A source's window is over FAN rows
    at a time: first its largest groups, then the groups within the one that holds the cut.
    """
    found = parts.groupBy("_p", "rest").agg(F.lit(0).cast("long").alias("_in"), F.lit(0).cast("long").alias("_base"))
    for level in reversed(range(levels)):
        size, wider = FAN**level, FAN ** (level + 1)
        sums = parts.groupBy(F.col("_p").alias("_q"), F.floor(F.col("_block") / size).alias("_g")).agg(F.sum("_sum").alias("_sum"))
        upper = F.floor(F.col("_g") / (wider // size)) if level < levels - 1 else F.lit(0).cast("long")
        inside = found.join(sums, F.col("_p").eqNullSafe(F.col("_q")) & (upper == F.col("_in")))
        before = Window.partitionBy("_p").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
        inside = inside.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        inside = inside.filter((F.col("_base") <= F.col("rest")) & (F.col("rest") < F.col("_base") + F.col("_sum")))
        found = table(inside.select("_p", "rest", F.col("_g").alias("_in"), "_base"), "cut-level")
    return found.select(F.col("_p").alias("_hp"), F.col("_in").alias("_hb"), F.col("_base").alias("_before"))


def cuts(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 42, block_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row per source with target, whole passes and the cut)."""
    sized = table(_sized(docs, seed), "sized")
    sizes = sized.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, cap)
    budget = F.round("target").cast("long")
    plan = (
        plan.withColumn("full", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("source_size") > 0, budget - F.col("full") * F.col("source_size")).otherwise(0))
        .withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long"))
    )
    plan = table(plan.withColumnRenamed("_source", "_p"), "plan")
    block = F.floor(F.col("_key").cast("double") * F.col("blocks") / F.lit(float(2**KEY_BITS))).cast("long")
    placed = sized.join(plan, F.col("_source").eqNullSafe(F.col("_p"))).select("_p", "doc_id", "size", "_key", "rest", block.alias("_block"))
    parts = table(placed.groupBy("_p", "_block", "rest").agg(F.sum("size").alias("_sum")), "blocks")
    most, levels = plan.agg(F.max("blocks")).first()[0] or 1, 1
    while FAN**levels < most:
        levels += 1
    holds = _descend(parts, levels)
    one = (
        placed.join(holds, F.col("_p").eqNullSafe(F.col("_hp")) & (F.col("_block") == F.col("_hb")))
        .groupBy("_p", "_before", "rest", "_key", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "size").agg(F.count(F.lit(1)).alias("_copies"))
    )
    inside = Window.partitionBy("_p").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("_before", F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(inside), F.lit(0)))
    left = F.col("rest") - F.col("_before")
    cut = one.filter((left >= 0) & (left < F.col("size") * F.col("_copies"))).select(
        F.col("_p").alias("_cp"), F.struct("_key", "_id", "size").alias("cut"), F.floor(left / F.col("_copies")).cast("long").alias("part")
    )
    marked = plan.join(cut, F.col("_p").eqNullSafe(F.col("_cp")), "left").drop("_cp")
    return sized, table(marked, "cuts")


def _take(size: Column) -> Column:
    """Words taken of a document that is joined with its source's row of ``cuts``."""
    mine = F.struct(F.col("_key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), size.alias("size"))
    last = F.when(F.col("cut").isNull(), F.lit(0)).when(mine < F.col("cut"), size).when(mine == F.col("cut"), F.col("part")).otherwise(0)
    return (F.col("full") * size + last).cast("long")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """How many words of each document the mix takes.

    Result: doc_id, source, size, source_size, target, taken; one row per input row.
    Null text: size 0, nothing taken.  Null source: a source of its own, after the
    others.  Repeated rows (same doc_id, source and size) take the same; if the cut
    falls on k such copies up to k - 1 words of the budget stay unused.  A source
    without words has target 0.  An empty table gives an empty result.  Extra columns
    are ignored.
    """
    sized, plan = cuts(docs, weights, cap, seed)
    plan = plan.select(F.col("_p").alias("_s"), "source_size", "target", "full", "cut", "part")
    return sized.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target", _take(F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """The mixed documents, with the input's columns: a document is there once per pass.

    Texts stay whole: the document at the cut is in the last pass if at least half of
    its words are inside the budget.  Documents that no pass takes are left out, and so are
    null and empty texts, which have no words.  A null source is one of its own, after the
    others.  Repeated rows come as often as each other.  An empty table stays empty, and
    extra columns, whatever their names, are kept as they are.
    """
    _, plan = cuts(docs, weights, cap, seed)
    plan = plan.select("_p", "full", "cut", "part")
    # the input's columns as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("_source"), "doc_id", _key("doc_id", seed).alias("_key"), word_count("text").alias("size"))
    mine = F.struct("_key", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "size")
    extra = F.when(F.col("cut").isNull(), F.lit(0)).when(mine < F.col("cut"), 1)
    extra = extra.when((mine == F.col("cut")) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)
    passes = F.when(F.col("size") > 0, F.col("full") + extra).otherwise(0)
    kept = rows.join(plan, F.col("_source").eqNullSafe(F.col("_p"))).select("row", F.explode(F.array_repeat(F.lit(0), passes.cast("int"))))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42'), 1, 13) AS BIGINT) AS k
  FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s GROUP BY source),
w AS (SELECT *, (rk - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM g),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS opn
      FROM w WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT * FROM l WHERE cap * opn > lft * w ORDER BY cap / w, rk LIMIT 1),
t AS (SELECT l.source, l.source_size,
        CASE WHEN l.cap * l.opn <= l.lft * l.w OR f.rk IS NULL THEN CAST(l.cap AS DOUBLE)
             ELSE least(CAST(l.w * f.lft AS DOUBLE) / CAST(f.opn AS DOUBLE), CAST(l.cap AS DOUBLE)) END AS target
      FROM l LEFT JOIN f ON true),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0
       ELSE CAST((budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) AS BIGINT) END AS taken
FROM p
"""
