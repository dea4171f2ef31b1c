"""Merkle manifest of a dataset: a tree per source, a tree over the sources, a proof per row.

A leaf is the digest of a row.  Leaves get their place in their source by a range
partitioning and the counts of its partitions, so no source is sorted in one task.  Blocks
of ``fanout ** levels`` consecutive leaves are aligned with the tree: a block is one
contiguous matrix of 64-byte hex digests, reshaped by the fanout and hashed level by level
in numpy.  The roots of blocks are the leaves of the next round, up to one node per source;
these are the leaves of the tree over sources, built by the same rounds.  Going down again,
each round hands the siblings above a block to the nodes in it; index arithmetic names the
siblings of every node.  A task never holds more than a batch of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import place
from .common import in_frames, spread, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of a block: 243 leaves at the fanout of 3.
LEVELS = 5
HEX = 64


def framed(*values: Column) -> Column:
    """The values as one string: ``-`` for null, else byte count, ``:``, value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def hashed(rows: bytes, width: int) -> np.ndarray:
    """Hex digests of the rows of ``width`` bytes (the last may be shorter), as a matrix."""
    digest = hashlib.sha256
    found = "".join([digest(rows[at : at + width]).hexdigest() for at in range(0, len(rows), width)])
    return np.frombuffer(found.encode(), np.uint8).reshape(-1, HEX)


def ladder(leaves: np.ndarray, total: int, fanout: int, levels: int) -> list[np.ndarray]:
    """The digest matrices of a block's levels, leaves first, its root last.

    ``total`` nodes are in the block's whole round: if they fill no more than this block,
    hashing stops at one node; else every level of the block is hashed, as other nodes remain.
    """
    rows = [leaves]
    while len(rows) <= levels and (total > fanout**levels or len(rows[-1]) > 1):
        rows.append(hashed(rows[-1].tobytes(), fanout * HEX))
    return rows


def siblings(rows: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each leaf of a block, level by level, left to right: the digests of its run's
    others, whether there is such a node, and its own position in the run."""
    n, height = len(rows[0]), len(rows) - 1
    others = np.zeros((n, height, fanout - 1, HEX), np.uint8)
    there, position = np.zeros((n, height, fanout - 1), bool), np.zeros((n, height), np.int64)
    at = np.arange(n)
    for level in range(height):
        run, own = at // fanout, at % fanout
        nodes, position[:, level] = rows[level], own
        for j in range(fanout - 1):
            other = run * fanout + j + (j >= own)
            there[:, level, j] = other < len(nodes)
            others[:, level, j] = nodes[np.minimum(other, len(nodes) - 1)]
        at = run
    return others, there, position


def paths(others: np.ndarray, there: np.ndarray) -> list[bytes]:
    """The siblings of each leaf as one string of digests, those that aren't there left out."""
    n = len(others)
    flat, use = others.reshape(n, -1, HEX), there.reshape(n, -1)
    whole = use.all(axis=1)
    return [(flat[i] if whole[i] else flat[i][use[i]]).tobytes() for i in range(n)]


def fold(own: np.ndarray, others: np.ndarray, there: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The block's root as it follows from each leaf of ``own`` and that leaf's siblings."""
    n, height, beside = there.shape
    for level in range(height):
        width = (beside + 1) * HEX
        runs, at = np.zeros((n, beside + 1, HEX), np.uint8), position[:, level]
        for j in range(beside):
            runs[np.arange(n), j + (j >= at)] = others[:, level, j]
        runs[np.arange(n), at] = own
        size = (1 + there[:, level].sum(axis=1)) * HEX
        if (size == width).all():
            own = hashed(runs.tobytes(), width)
        else:
            own = np.concatenate([hashed(runs[i].tobytes()[: size[i]], width) for i in range(n)])
    return own


def climb(own: np.ndarray, above: bytes, steps: bytes) -> np.ndarray:
    """The root as it follows from each row of ``own`` and the siblings above the block,
    which are the same for all: ``steps`` has position and size of the run of each level."""
    at, n = 0, len(own)
    for position, size in zip(steps[::2], steps[1::2], strict=True):
        beside = np.frombuffer(above, np.uint8, (size - 1) * HEX, at).reshape(-1, HEX)
        at += (size - 1) * HEX
        runs = np.empty((n, size, HEX), np.uint8)
        runs[:, :position], runs[:, position], runs[:, position + 1 :] = beside[:position], own, beside[position:]
        own = hashed(runs.tobytes(), size * HEX)
    return own


def _matrix(digests: str | bytes) -> np.ndarray:
    return np.frombuffer(digests.encode() if isinstance(digests, str) else digests, np.uint8).reshape(-1, HEX)


def _blocks(nodes: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """Nodes (_no, total, place, digest) as blocks with their roots, written once.

    A block is at most ``fanout ** levels`` rows, so the lists are bounded.  Nodes of
    round 0 have doc_id and ``seen`` as well."""
    size, leaf = fanout**levels, "doc_id" in nodes.columns
    item = F.struct("place", "digest", *(["doc_id", "seen"] if leaf else []))
    block = F.floor(F.col("place") / size).cast("long").alias("block")
    rows = nodes.groupBy("_no", "total", block).agg(F.array_sort(F.collect_list(item)).alias("_all"))

    def joined(part: str) -> Column:
        return F.array_join(F.transform("_all", lambda x: x[part]), "")

    columns = [joined("digest").alias("digests")]
    if leaf:
        known = F.array_join(F.transform("_all", lambda x: F.when(x["doc_id"].isNull(), "0").otherwise("1")), "")
        columns += [joined("seen").alias("seen"), F.transform("_all", lambda x: F.coalesce(x["doc_id"], F.lit(0))).alias("ids"), known.alias("known")]

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tops = [ladder(_matrix(d), int(t), fanout, levels)[-1].tobytes().decode() for d, t in zip(batch["digests"], batch["total"], strict=True)]
            yield batch.assign(root=tops)

    extra = ", seen string, ids array<long>, known string" if leaf else ""
    listed = rows.select("_no", "total", "block", *columns)
    return table(in_frames(listed, roots, f"_no long, total long, block long, digests string{extra}, root string"), name)


def _rounds(nodes: DataFrame, fanout: int, levels: int, name: str) -> list[DataFrame]:
    """Blocks of each round, until every tree has one node."""
    rounds, size = [], fanout**levels
    while True:
        rounds.append(_blocks(nodes, fanout, levels, f"{name}-{len(rounds)}"))
        most = rounds[-1].agg(F.max("total")).first()[0] or 0
        if most <= size:
            return rounds
        nodes = rounds[-1].select("_no", F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("block").alias("place"), F.col("root").alias("digest"))


def _under(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the siblings (``above``, ``steps``) that stand over them."""
    above = above.select(F.col("_no").alias("_n"), F.col("place").alias("_p"), "above", "steps", "subroot")
    return blocks.join(above, (F.col("_no") == F.col("_n")) & (F.col("block") == F.col("_p"))).drop("_n", "_p")


def _descend(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """From what stands over the top of each tree to what stands over each node of the lowest round given."""

    def hand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for no, total, block, digests, above, steps, subroot in zip(*(batch[c] for c in ("_no", "total", "block", "digests", "above", "steps", "subroot")), strict=True):
                rows = ladder(_matrix(digests), int(total), fanout, levels)
                others, there, position = siblings(rows, fanout)
                n, height = position.shape
                own = np.stack([position, 1 + there.sum(axis=2)], axis=2).astype(np.uint8).reshape(n, 2 * height)
                yield pd.DataFrame({
                    "_no": no, "place": int(block) * fanout**levels + np.arange(n), "above": [p.decode() + above for p in paths(others, there)],
                    "steps": [o.tobytes() + steps for o in own], "subroot": subroot, "digest": [r.tobytes().decode() for r in rows[0]],
                })

    for number, blocks in reversed(list(enumerate(rounds))):
        found = in_frames(_under(blocks, above), hand, "_no long, place long, above string, steps binary, subroot string, digest string")
        above = table(found, f"{name}-{number}")
    return above


@dataclass
class Manifest:
    """What a dataset's manifest consists of: blocks of leaves, the siblings above each block, and the root."""

    blocks: DataFrame
    above: DataFrame
    root: str | None
    fanout: int
    levels: int


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", seen: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs``: a leaf per row from ``fields``, a tree per ``group``.

    Leaves ascend by ``key``, null first; rows that share it by their digest, so rows that
    are equal in all fields may stand for each other.  Null fields are ``-`` in a leaf, empty
    ones ``0:``; texts of any length are hashed whole.  A null group is one of its own, before
    the others, which are ordered by UTF-8 bytes.  ``seen`` has columns to hash in place of
    those of its names, as a later reader sees them; ``audit`` folds these leaves.  An empty
    table has no root.  Other columns, whatever their names, are ignored.
    """
    columns = {f: F.col(f"`{f}`") for f in fields}
    digest = F.sha2(framed(*columns.values()).cast("binary"), 256)
    later = F.sha2(framed(*{**columns, **(seen or {})}.values()).cast("binary"), 256) if seen else digest
    leaves = table(docs.select(F.col(f"`{group}`").alias("_group"), F.col(f"`{key}`").cast("long").alias("doc_id"), digest.alias("digest"), later.alias("seen")), "leaves")
    order = (F.col("_group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("seen"))
    number = F.monotonically_increasing_id()  # the partition above bit 33, the row in it below
    ranged = table(leaves.repartitionByRange(spread(docs), *order).sortWithinPartitions(*order).withColumn("_id", number), "ranged")
    ranged = ranged.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    # one row per source and partition that holds some of it
    parts = table(ranged.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "parts")
    groups = parts.groupBy("_group").agg(F.sum("_n").alias("total"))
    groups = table(place(groups, [F.col("_group").asc_nulls_first()], "_no"), "groups").withColumnRenamed("_group", "_g")
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    shift = shift.join(groups, F.col("_group").eqNullSafe(F.col("_g"))).select(F.col("_g"), F.col("_part").alias("_p"), "_no", "total", "_shift")
    nodes = ranged.join(shift, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    nodes = nodes.select("_no", "total", (F.col("_at") + F.col("_shift")).alias("place"), "digest", "doc_id", "seen")

    own = _rounds(nodes, fanout, levels, "tree")
    n = groups.count()
    tops = own[-1].select(F.lit(0).cast("long").alias("_no"), F.lit(n).cast("long").alias("total"), F.col("_no").alias("place"), F.col("root").alias("digest"))
    over = _rounds(tops, fanout, levels, "top")
    last = over[-1].select("root").first()
    start = over[-1].select("_no", F.lit(0).cast("long").alias("place"), F.lit("").alias("above"), F.lit(b"").alias("steps"), F.lit("").alias("subroot"))
    above = _descend(over, start, fanout, levels, "over")
    above = above.select(F.col("place").alias("_no"), F.lit(0).cast("long").alias("place"), "above", "steps", F.col("digest").alias("subroot"))
    return Manifest(own[0], _descend(own[1:], above, fanout, levels, "within"), last["root"] if last else None, fanout, levels)


def audit(manifest: Manifest, proofs: bool = True) -> DataFrame:
    """Each row's leaf, its proof, and the root that follows from the leaf as it was seen.

    Result: doc_id, leaf, seen, subroot, root, proof_sha256, folded_root, verified (whether
    that root is the manifest's) and, with ``proofs``, proof: the siblings' digests joined,
    level by level up to the root, left to right.
    """
    fanout, levels, root = manifest.fanout, manifest.levels, manifest.root

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for total, digests, seen, ids, known, above, steps, subroot in zip(*(batch[c] for c in ("total", "digests", "seen", "ids", "known", "above", "steps", "subroot")), strict=True):
                rows = ladder(_matrix(digests), int(total), fanout, levels)
                others, there, position = siblings(rows, fanout)
                folded = climb(fold(_matrix(seen), others, there, position), above.encode(), steps)
                proof = [p + above.encode() for p in paths(others, there)]
                yield pd.DataFrame({
                    "doc_id": pd.array([int(i) if k == "1" else None for i, k in zip(ids, known, strict=True)], dtype="Int64"),
                    "leaf": [digests[i : i + HEX] for i in range(0, len(digests), HEX)], "seen": [seen[i : i + HEX] for i in range(0, len(seen), HEX)],
                    "subroot": subroot, "root": root, "proof_sha256": [hashlib.sha256(p).hexdigest() for p in proof],
                    "folded_root": (found := [r.tobytes().decode() for r in folded]), "verified": [f == root for f in found],
                    **({"proof": [p.decode() for p in proof]} if proofs else {}),
                })

    extra = ", proof string" if proofs else ""
    under = _under(manifest.blocks, manifest.above)
    return in_frames(under, check, f"doc_id long, leaf string, seen string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{extra}")


def digest(docs: DataFrame) -> DataFrame:
    """Audit of a reader who lost the newlines of every text whose doc_id's crc32 is even.

    Rows without doc_id are read as they are.  For the rest see ``build`` and ``audit``.
    """
    lost = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(lost, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return audit(build(docs, seen={"text": text}), proofs=False).select(*columns)


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


#: The tree by recursion over levels, all groups at once, then the tree over sources; proofs
#: and folds go up level by level.  ``odd`` is the last bit of the decimal doc_id's crc32.
ORACLE = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, text, row_number() OVER () AS rid,
    sha256({' || '.join(map(_field, FIELDS))}) AS leaf,
    sha256({' || '.join(map(_field, FIELDS[:-1]))} || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare,
    1 - (list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(substr(CAST(doc_id AS VARCHAR), p, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR p IN range(1, length(CAST(doc_id AS VARCHAR)) + 1)]),
      lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) // 2, 3988292384) ELSE xor(c, x) // 2 END) % 2) AS odd
  FROM documents),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) AS n FROM base GROUP BY source),
leaves AS (
  SELECT rid, doc_id, g, n, leaf, CASE WHEN odd = 0 THEN bare ELSE leaf END AS seen,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM base JOIN groups ON base.source IS NOT DISTINCT FROM groups.source),
tree AS (
  SELECT g, 0 AS level, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, level, n, i // 3),
subroots AS (SELECT g, d, level AS height FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM groups) AS n, d FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, n, i // 3),
runs AS (
  SELECT g, level, i // 3 AS run, list(d ORDER BY i) AS ds FROM tree WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT g, height + level, i // 3, ds FROM (SELECT level, i // 3 * 3 AS i, list(d ORDER BY i) AS ds FROM top WHERE n > 1 GROUP BY ALL), subroots
  WHERE i // 3 = g // CAST(pow(3, level + 1) AS BIGINT)),
up AS (
  SELECT rid, g, 0 AS level, i, seen AS d, '' AS proof FROM leaves
  UNION ALL
  SELECT o.rid, o.g, o.level + 1, o.pos // 3,
    sha256(array_to_string([CASE WHEN p = o.pos % 3 + 1 THEN o.d ELSE ds[p] END FOR p IN range(1, len(ds) + 1)], '')),
    proof || array_to_string([ds[p] FOR p IN range(1, len(ds) + 1) IF p <> o.pos % 3 + 1], '')
  FROM (SELECT u.*, CASE WHEN u.level = t.height THEN u.g ELSE u.i END AS pos FROM up u JOIN subroots t ON u.g = t.g) o
  JOIN runs ON runs.g = o.g AND runs.level = o.level AND runs.run = o.pos // 3),
last AS (SELECT rid, proof, d FROM up QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1)
SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, sha256(last.proof) AS proof_sha256, last.d AS folded_root, last.d = r.d AS verified
FROM leaves l JOIN last USING (rid) JOIN subroots s USING (g) CROSS JOIN (SELECT d FROM top WHERE n = 1) r
"""
