"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most ``d`` of
their 8 bytes, so they share at least ``8 - d`` bytes at the same position.  The index
lists fingerprints under triples of (position, byte), as single ones would be lists of
1/256 of all; the triples are chosen so that any ``8 - d`` shared positions hold at least one
of them, which loses no pair.  Within a list each of the other positions has its postings,
the entries that hold a byte there.  The postings are tallied per pair, pairs whose tally and
triple don't reach ``8 - d`` are dropped, and the rest are verified by their differing bits.

A list never emits its pairs: it emits a forest that connects what it verified, so the
output stays below its number of entries.  Lists over ``list_rows`` entries are dealt
to several tasks as pairs of blocks.

Texts of a given similarity (``drop_similar``) use the same index over other bytes: each of
the 8 is of a min-hash, so texts of similarity s share a byte with probability s.  A pair that
the index finds is linked only if it shares enough of all the min-hash bytes, most of which
the index doesn't look at; so unrelated texts that agree by chance never join two groups,
however many texts there are.  What is linked is verified by the exact similarity of the
shingles.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_frames, join_counted, pieces, spread, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A word over UTF-8: its separators are single bytes that no other character contains.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (of all words if they are fewer), repeats included."""
    found = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of ``words`` words, repeats included; no word: 0."""
    hashes = shingles(text, words, seed)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > n), bitorder="little").view(np.uint64)[0])


#: Sketches of 8 bytes: the first INDEXED are looked up, all are compared.
SKETCHES, INDEXED = 4, 2
#: Bytes of all sketches that a linked pair shares.  At similarity 0.8 fewer are shared with probability
#: 0.00004.  By chance two of n texts meet in a list and share so many with probability 2 * 70 / 256^4 *
#: C(24, 12) / 256^12, which is below 10^-29: a text has no chance partner among any number of texts.
SHARED = 16
#: Odd factors and masks of the min-hashes.
FACTORS, MASKS = np.random.default_rng(20).integers(1 << 63, size=(2, 8 * SKETCHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The sketches: of 8 min-hashes each the lowest byte; without a shingle all are 0."""
    if not len(hashes):
        return np.zeros(SKETCHES, np.int64)
    low = [((hashes ^ m) * f).min() for f, m in zip(FACTORS, MASKS, strict=True)]
    return (np.array(low, np.uint64) & np.uint64(255)).astype(np.uint8).view(np.int64)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, th (XXH64 of the text) and fp (the 64 bits as a signed long) of every row."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words, seed) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "fp": fps.view(np.int64)})

    return in_frames(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), score, "doc_id long, th long, fp long")


def position_sets(shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``shared`` of the 8 hold one.

    Triples: the positions are dealt to three parts in a circle; a triple counts if it lies
    in one part, or has two in a part and one in the next (Turan's construction: 20 of 56
    triples meet any 4 positions).  Otherwise the positions are dealt to as few parts as
    put ``width`` of any ``shared`` into one part, and the subsets of the parts count.
    """
    if width == 3 and shared >= 4:
        part = [i % 3 for i in range(8)]
        kinds = [sorted([i, i, j]) for i in range(3) for j in (i, (i + 1) % 3)]
        return [s for s in itertools.combinations(range(8), 3) if sorted(part[i] for i in s) in kinds]
    parts = max(1, (shared - 1) // (width - 1)) if width > 1 else 8
    dealt = [list(range(8))[i::parts] for i in range(parts)]
    return [s for part in dealt for s in itertools.combinations(part, width)]


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each one's component, of the graph with edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def tallied(fp: np.ndarray, begin: np.ndarray, end: np.ndarray, held: np.ndarray, need: int, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of a list that share ``need`` positional bytes or more, counted from postings.

    Entry ``i`` belongs to the list of places ``begin[i]`` to ``end[i]``; ``held[i]`` marks the
    positions that all of its list share.  At each other position the entries of a list with
    the same byte are a posting: every pair of it gets one more.  ``cells``: tallies at a time.
    """
    n = len(fp)
    shared = held.sum(axis=1)
    byte = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
    postings = []
    for p in range(8):
        rows = np.flatnonzero(~held[:, p])
        rows = rows[np.argsort(begin[rows] * 256 + byte[rows, p], kind="stable")]
        key = begin[rows] * 256 + byte[rows, p]
        stop = np.searchsorted(key, key, side="right")
        many = stop - np.arange(len(rows)) > 1  # the last of a posting has no later partner
        where = np.zeros(n, np.int64)
        later = np.zeros(n, np.int64)
        where[rows[many]] = np.flatnonzero(many)
        later[rows[many]] = (stop - np.arange(len(rows)) - 1)[many]
        postings.append((rows, where, later))
    width = end - begin
    room = np.concatenate([[0], np.cumsum(width)])
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(room, room[at] + cells, side="right")) - 1)
        base, own = room[at], slice(at, upto)
        tally = np.zeros(int(room[upto] - base), np.int64)
        for rows, where, later in postings:
            left = np.flatnonzero(later[own]) + at
            count = later[left]
            each = np.repeat(left, count)
            if not len(each):
                continue
            ahead = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + 1
            right = rows[where[each] + ahead]
            tally += np.bincount(room[each] - base + right - begin[each], minlength=len(tally))
        hit = np.flatnonzero(tally)
        i = np.searchsorted(room, hit + base, side="right") - 1
        j = begin[i] + hit + base - room[i]
        enough = tally[hit] + shared[i] >= need
        yield i[enough], j[enough]
        at = upto


def _links(batches: Iterator[pd.DataFrame], sets: list[tuple[int, ...]], bits: int, linked) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    """From rows (entry, side, slot, fp and more) sorted by entry: edges that connect all linked pairs.

    slot: which of ``sets`` the entry's key holds.  side 0: compared with all of its entry;
    sides 1 and 2: only 1 with 2.  ``linked(rows)`` gives the numbers that stand for the rows
    in edges, and a function that says which of the pairs (i, j) link.
    """
    holds = np.array([[p in some for p in range(8)] for some in sets])
    for part in pieces(batches, "entry"):
        fp = part["fp"].to_numpy(np.int64).view(np.uint64)
        entry, side = part["entry"].to_numpy(np.int64), part["side"].to_numpy(np.int32)
        n = len(fp)
        edge = np.append(np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])), n)
        size = np.diff(edge)
        begin, end = np.repeat(edge[:-1], size), np.repeat(edge[1:], size)
        root = np.arange(n)
        left, right, pairs = [], [], 0
        named, alike = linked(part)
        for i, j in tallied(fp, begin, end, holds[part["slot"].to_numpy(np.int32)], 8 - bits):
            fine = ((side[i] != side[j]) | (side[i] == 0)) & alike(i, j)
            left.append(i[fine])
            right.append(j[fine])
            pairs += int(fine.sum())
            if pairs > 1 << 22:  # a forest takes the place of many pairs
                root = _roots(np.concatenate(left), np.concatenate(right), n)
                keep = np.flatnonzero(root != np.arange(n))
                left, right, pairs = [keep], [root[keep]], len(keep)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if not len(a):
            continue
        values, index = np.unique(named[np.concatenate([a, b])], return_inverse=True)
        root = _roots(index[: len(a)], index[len(a) :], len(values))
        keep = np.flatnonzero(root != np.arange(len(values)))
        yield pd.DataFrame({"src": values[keep], "dst": values[root[keep]]})


def _dealt(listed: DataFrame, key: str, value: str, list_rows: int, *rest: str) -> DataFrame:
    """Rows (entry, side, value, rest) by entry: lists (``n`` rows each) as pairs of blocks."""
    return (
        listed.withColumn("blocks", F.ceil(F.col("n") / list_rows).cast("int"))
        .withColumn("b", F.pmod(F.xxhash64(value), F.col("blocks")).cast("int"))
        .select(key, value, *rest, "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            F.xxhash64(key, F.least("b", "other"), F.greatest("b", "other")).alias("entry"),
            F.when(F.col("b") == F.col("other"), 0).when(F.col("b") < F.col("other"), 1).otherwise(2).alias("side"),
            value, *rest,
        )
        .repartition(spread(listed), "entry")
        .sortWithinPartitions("entry")
    )


def _near_bits(most: int):  # noqa: ANN202
    def linked(rows: pd.DataFrame) -> tuple:
        fp = rows["fp"].to_numpy(np.int64)
        return fp, lambda i, j: np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most

    return linked


def _many_bytes(shared: int):  # noqa: ANN202
    def linked(rows: pd.DataFrame) -> tuple:
        all_ = rows[[f"f{k}" for k in range(SKETCHES)]].to_numpy(np.int64).copy().view(np.uint8)
        return rows["node"].to_numpy(np.int64), lambda i, j: (all_[i] == all_[j]).sum(axis=1) >= shared

    return linked


def _index(fps: DataFrame, bits: int, width: int, list_rows: int, linked, *rest: str) -> DataFrame:  # noqa: ANN001
    """Edges of what the byte-position index of ``fp`` brings together and ``linked`` accepts."""
    if not 0 <= bits <= 8 - width:
        raise ValueError("bits must be between 0 and 8 - width")
    keys, sets = [], position_sets(8 - bits, width)
    for i, at in enumerate(sets):
        value = F.lit(i).cast("long")
        for p in at:
            value = value * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
        keys.append(value)
    index = fps.select("fp", *rest, F.posexplode(F.array(*keys)).alias("slot", "key"))
    lists = table(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    dealt = _dealt(index.join(lists, "key"), "key", rest[0] if rest else "fp", list_rows, "slot", *(["fp", *rest[1:]] if rest else []))
    return in_frames(dealt, lambda rows: _links(rows, sets, bits, linked), "src long, dst long")


def links(fps: DataFrame, bits: int = 4, width: int = 3, list_rows: int = 4096) -> DataFrame:
    """Edges (src > dst, as signed longs) that connect distinct fingerprints like their links do.

    Linked are those that differ in ``bits`` bits or less.  ``width``: bytes in a key of the
    index, 3 for up to some billion fingerprints, 4 beyond.
    """
    return _index(fps.select("fp"), bits, width, list_rows, _near_bits(bits))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())


#: Tasks that share the edges of one vertex.
SALTS = 8


def _salted(edges: DataFrame, one: str, other: str, low: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of ``low`` (one row per ``u``), joined on column ``one`` and a salt from ``other``."""
    salted = low.select(F.col("u").alias("_u"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return edges.join(salted, (edges[one] == F.col("_u")) & (F.pmod(F.xxhash64(other), F.lit(SALTS)) == F.col("_salt")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of the edges but the roots; root is the smallest reachable.

    Large-star and small-star in turn: each moves edges to smaller neighbours until all
    are stars.  Minima are combined before their shuffle.  A star's edges meet its minimum in
    SALTS tasks, to each of which the minimum, two numbers, is sent.
    Every half round is a written table, so a lost executor never repeats earlier rounds.
    """
    now = table(edges.select("src", "dst").distinct(), "edges")
    before = _state(now)
    for _ in range(rounds if before[0] else 0):
        both = now.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(now.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _salted(both.filter("v > u"), "u", "v", low).select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        large = table(large, "large-star")
        low = large.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m"))
        small = _salted(large, "src", "dst", low).select(
            F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst")
        )
        now = table(small.filter("src <> dst").distinct(), "small-star")
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("v"), F.col("dst").alias("root"))


def _grouped(docs: DataFrame, words: int, bits: int, seed: int) -> DataFrame:
    """doc_id, th (a hash of the text), fp, root (a fingerprint) and component_id of every row."""
    seen = table(fingerprints(docs, words, seed), "fingerprints")
    distinct = table(seen.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "low", "rows", F.coalesce("root", "fp").alias("root"))
    rooted = table(rooted, "rooted")
    lows = table(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots").withColumnRenamed("root", "_root")
    ids = join_counted(rooted, lows, F.col("root"), "_root", "n").select(F.col("fp").alias("_fp"), "root", "component_id", "rows")
    return join_counted(seen, table(ids, "component-ids"), F.col("fp"), "_fp", "rows").select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint and component of every document.

    Documents link when their fingerprints differ in ``bits`` bits or less.  Result:
    doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id
    reachable, its own included); one row per input row.  Null and empty texts and texts
    of white space have fingerprint zero and link like any other.  Repeated rows share
    their component.  A null doc_id is a component_id only where its component has no
    other.  An empty table gives an empty result.  Extra columns are ignored.
    """
    return _grouped(docs, words, bits, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """The documents with one row left of each component: that of the smallest doc_id.

    A null doc_id comes after all others; of different texts under the smallest doc_id the
    one with the smallest hash stays, of repeated rows one.  Null, empty and blank texts are
    alike; texts of any length are read whole; an empty table stays empty.  Columns are the
    input's, whatever their names.
    """
    return _first_of_each(docs, _grouped(docs, words, bits, seed))


def _same(batches: Iterator[pd.DataFrame], words: int, least: float, seed: int) -> Iterator[pd.DataFrame]:
    """From rows (entry, side, th, text) by entry: edges that connect all similar texts."""
    for part in pieces(batches, "entry"):
        src, dst = [], []
        for _, rows in part.groupby("entry", sort=False):
            th, side, n = rows["th"].to_numpy(), rows["side"].to_numpy(), len(rows)
            if n < 2:
                continue
            sets = [np.unique(shingles(t, words, seed)) for t in rows["text"]]
            size = np.fromiter(map(len, sets), np.int64, n)
            # for each shingle the texts that hold it
            owner = np.repeat(np.arange(n), size)
            number = np.unique(np.concatenate(sets), return_inverse=True)[1]
            order = np.argsort(number, kind="stable")
            holders = np.split(owner[order], np.flatnonzero(np.diff(number[order])) + 1)
            begin = np.concatenate([[0], np.cumsum(size)])
            root = np.arange(n)
            for i in range(n):
                own = number[begin[i] : begin[i + 1]]
                both = np.bincount(np.concatenate([holders[k] for k in own]), minlength=n) if len(own) else np.where(size == 0, 1, 0)
                hit = both >= least * np.maximum(size + size[i] - both, 1) - 1e-9
                hit &= ((side != side[i]) | (side == 0)) & (root != root[i])
                if hit.any():
                    joined = np.append(np.unique(root[hit]), root[i])
                    root[np.isin(root, joined)] = joined.min()
            for i in np.flatnonzero(root != np.arange(n)):
                src.append(max(th[i], th[root[i]]))
                dst.append(min(th[i], th[root[i]]))
        yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})


def similar(docs: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42, list_rows: int = 1024, shared: int = SHARED) -> DataFrame:
    """doc_id, th (a hash of the text) and root (the th that names its component) of every row.

    Texts link when the sets of their shingles of ``words`` words have a Jaccard similarity of
    ``least`` or more.  Compared are texts that share 4 bytes or more of one of the INDEXED
    sketches and ``shared`` bytes of all (a pair of similarity 0.8 fails the first with
    probability 0.0001 and the second with 0.00004), and all in reach of them.  Null, empty
    and blank texts have no shingle and link to each other; a text of fewer words is one
    shingle; texts of any length are read whole.  Repeated rows have the same th.  An empty
    table gives an empty result.  Extra columns are ignored.
    """
    own = [f"f{k}" for k in range(SKETCHES)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_ = np.array([sketch(shingles(t, words, seed)) for t in batch["text"]], np.int64).reshape(-1, SKETCHES)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], **{f: all_[:, k] for k, f in enumerate(own)}})

    seen = in_frames(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), score, "doc_id long, th long, " + ", ".join(f"{f} long" for f in own))
    seen = table(seen, "sketches")
    texts = table(seen.groupBy("th", *own).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")).withColumn("node", F.xxhash64(*own)), "texts")
    # texts with equal sketches are one node; one that nothing else is near has no edge
    nodes = table(texts.groupBy("node", *own).agg(F.count(F.lit(1)).alias("n")), "nodes")
    near = [_index(nodes.select(F.col(f).alias("fp"), "node", *own), 4, 3, list_rows * 4, _many_bytes(shared), "node", *own) for f in own[:INDEXED]]
    edges = near[0]
    for more in near[1:]:
        edges = edges.union(more)
    roots = components(edges)
    keyed = table(nodes.join(roots, nodes["node"] == roots["v"], "left").select("node", "n", F.coalesce("root", "node").alias("key")), "keyed")
    lists = keyed.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    some = table(keyed.drop("n").join(lists, "key").select(F.col("node").alias("_node"), "key", "n"), "candidate-nodes")
    listed = table(texts.join(some, texts["node"] == some["_node"]).select(F.col("th").alias("_th"), F.col("low").alias("_low"), "key", "n"), "listed")
    # the text of a list's member is taken from one of its rows: repeats have another doc_id
    # and is merged at every size, as the lists grow with the corpus
    whole = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    whole = whole.join(listed.hint("merge"), whole["doc_id"].eqNullSafe(listed["_low"]) & (whole["th"] == listed["_th"])).dropDuplicates(["th"])
    pairs = in_frames(_dealt(whole, "key", "th", list_rows, "text"), lambda rows: _same(rows, words, least, seed), "src long, dst long")
    found = components(pairs)
    named = texts.join(found, texts["th"] == found["v"], "left").select(F.col("th").alias("_th"), "rows", F.coalesce("root", "th").alias("root"))
    return join_counted(seen, table(named, "named"), F.col("th"), "_th", "rows").select("doc_id", "th", "root")


def drop_similar(docs: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """The documents with one row left of each component of ``similar``, as drop_near_duplicates.

    Null, empty and very long texts, repeats and empty tables: see there and ``similar``.
    """
    return _first_of_each(docs, similar(docs, words, least, seed))


def _first_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    known = (F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("doc_id").isNull(), F.col("th"))
    found = table(rooted.select("doc_id", "th", "root", F.struct(*known).alias("_me")), "grouped")
    best = table(found.groupBy("root").agg(F.min("_me").alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "best")
    members = join_counted(found, best.withColumnRenamed("root", "_root"), F.col("root"), "_root", "_n")
    members = members.groupBy("doc_id", "th").agg(F.first(F.col("_me") == F.col("_best")).alias("_stays"), F.count(F.lit(1)).alias("_copies"))
    members = table(members.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_stays", "_copies"), "members")
    # the input's columns as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    # what goes grows with the corpus: it is merged at every size, never broadcast
    kept = rows.join(members.filter("not _stays or _copies > 1").hint("merge"), same, "left_anti")
    repeated = rows.join(members.filter("_stays and _copies > 1"), same, "left_semi")
    return kept.unionByName(repeated.dropDuplicates(["id", "th"])).select(*[F.col("row")[c].alias(c) for c in docs.columns])
