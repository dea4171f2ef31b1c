"""Packing documents into as few sequences of bounded length as can be.

Only the histogram of piece lengths, which has no more rows than a sequence has tokens,
goes to the driver.  There a configuration linear program (configurations are multisets of
lengths that fit one sequence; each length must be covered as often as it occurs) is
approximated by multiplicative weights: a length's price falls with its coverage, an
unbounded-knapsack dynamic program over the capacity prices all configurations at once, and
for each length that lags behind the best configuration holding it gets its share.  The
fractional counts are rounded systematically, never beyond what is there, and what is left
over is placed best-fit, the same for all pieces of one length at once.  The plan is a table
of slots per length; pieces find theirs by their number among the pieces of their length,
which is counted where they are made, so they are placed where they are read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Memo, in_frames, table
from .tokenbin import PLAIN, VISIBLE

VOCABULARY, END, CAPACITY = "word_bpe_49k.json", 1, 4096
#: Rounds of the multiplicative weights, and how fast a price follows its coverage.
ROUNDS, RATE = 32, 0.1
#: Words, and chunks, whose ids a worker remembers.
REMEMBERED = 1 << 19

Config = tuple[tuple[int, int], ...]


# -- the plan ---------------------------------------------------------------------------


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, last item or -1) of each capacity, items to be taken any number of times."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            found = best[c - lengths[:k]] + value[:k]
            j = int(found.argmax())
            if found[j] > best[c]:
                best[c], last[c] = found[j], j
    return best, last


def _filled(last: np.ndarray, lengths: np.ndarray, room: int, first: int) -> dict[int, int]:
    """Item ``first`` and the best items for the ``room`` it leaves."""
    config = {first: 1}
    while room > 0:
        if (j := int(last[room])) < 0:
            room -= 1
        else:
            config[j] = config.get(j, 0) + 1
            room -= int(lengths[j])
    return config


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple, float]:
    """Configurations (pairs of item and how often, by item) and how often each is used."""
    want, covered = counts.astype(float), np.zeros(len(counts))
    used: dict[tuple, float] = {}
    for t in range(1, rounds + 1):
        price = lengths * np.exp(-rate * (covered / want * rounds - (t - 1)))
        _, last = knapsack(lengths, price, capacity)
        due = want * (t / rounds) - covered
        spare = due + want / rounds
        for i in np.argsort(-lengths * (due > 0), kind="stable")[: int((due > 0).sum())].tolist():
            if due[i] <= 0:
                continue
            config = _filled(last, lengths, capacity - int(lengths[i]), i)
            items, often = np.array(list(config)), np.array(list(config.values()))
            share = min(due[i] / config[i], float((np.maximum(spare[items], 0) / often).min()))
            if share <= 0:
                continue
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + share
            for array, sign in ((covered, 1), (due, -1), (spare, -1)):
                array[items] += sign * share * often
    return used


def rounded(used: dict[tuple, float], counts: np.ndarray) -> tuple[dict[tuple, int], np.ndarray]:
    """(whole numbers of configurations, what they leave of ``counts``).

    The running sum of the fractional counts is rounded, so the total is kept to within
    one; a configuration is used no more often than its items are left.
    """
    left, out = counts.copy(), {}
    total, sofar = 0.5, 0
    for config, share in sorted(used.items(), key=lambda c: (-c[0][-1][0], -c[1], c[0])):
        total += share
        often = int(total) - sofar
        sofar = int(total)
        often = min([often, *(int(left[i]) // a for i, a in config)])
        if often > 0:
            out[config] = often
            for i, a in config:
                left[i] -= a * often
    return out, left


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Configurations of what is left: long items first, each to the fullest sequence it fits.

    All items of a length, and all sequences that are alike, are moved at once.
    """
    open_: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(room: int, config: tuple, often: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = {}
        open_[room][config] = open_[room].get(config, 0) + often

    for i in range(len(lengths) - 1, -1, -1):
        length, n = int(lengths[i]), int(left[i])
        while n and (at := bisect.bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            config, often = open_[room].popitem()
            if not open_[room]:
                del open_[room], rooms[at]
            fit = room // length
            whole, rest = min(often, n // fit), n % fit if n // fit < often else 0
            if whole:
                put(room - fit * length, (*config, (i, fit)), whole)
            if rest:
                put(room - rest * length, (*config, (i, rest)), 1)
            if often > whole + (rest > 0):
                put(room, config, often - whole - (rest > 0))
            n -= whole * fit + rest
        if n:
            fit = capacity // length
            if n // fit:
                put(capacity - fit * length, ((i, fit),), n // fit)
            if n % fit:
                put(capacity - n % fit * length, ((i, n % fit),), 1)
    out: dict[tuple, int] = {}
    for group in open_.values():
        for config, often in group.items():
            key = tuple(sorted(config))
            out[key] = out.get(key, 0) + often
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """Configurations ((length, how often), ...) and how many sequences have each.

    Together they hold each length exactly as often as ``histogram`` says.
    """
    lengths = np.array(sorted(n for n in histogram if 0 < n <= capacity), np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    if not len(lengths):
        return []
    chosen, left = rounded(fractional(lengths, counts, capacity, rounds), counts)
    for config, often in best_fit(lengths, left, capacity).items():
        chosen[config] = chosen.get(config, 0) + often
    return [(tuple((int(lengths[i]), a) for i, a in config), often) for config, often in sorted(chosen.items())]


def slots(configs: list[tuple[Config, int]]) -> np.ndarray:
    """Where the pieces of a length go: rows (length, first number, per sequence, first
    sequence, offset of the first), ascending."""
    rows, base, used = [], 0, {}
    for config, often in configs:
        offset = 0
        for length, a in config:
            first = used.get(length, 0)
            rows.append((length, first, a, base, offset))
            used[length], offset = first + a * often, offset + a * length
        base += often
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def located(table_: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and numbers among their length."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in pairwise([*bounds.tolist(), len(order)]):
        own = order[a:b]
        lo, hi = np.searchsorted(table_[:, 0], length[own[0]], "left"), np.searchsorted(table_[:, 0], length[own[0]], "right")
        row = table_[lo:hi][np.searchsorted(table_[lo:hi, 1], number[own], "right") - 1]
        inside = number[own] - row[:, 1]
        sequence[own] = row[:, 3] + inside // row[:, 2]
        offset[own] = row[:, 4] + inside % row[:, 2] * length[own]
    return sequence, offset


# -- pieces -----------------------------------------------------------------------------

#: The pre-tokens of plain texts in lower case.
WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~]+")
#: White space; the tokenizer doesn't split at U+001C to U+001F.
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@cache
def encoder(path: str) -> tuple[Memo, Memo, re.Pattern, int]:
    """(ids of words, ids of chunks without white space, the added tokens' pattern, size of the vocabulary).

    A plain text is cut to the tokenizer's own pre-tokens here, and new ones are given to the
    model.  Of any other text the chunks between white space, which no pre-token crosses, go
    through the tokenizer whole.  Both are remembered.  Ids are 16-bit, or 32-bit for larger
    vocabularies.
    """
    own = Tokenizer.from_file(path)
    size = own.get_vocab_size()
    kind = "H" if _kind(size) == "<u2" else "I"
    pieces_of = own.model.tokenize

    def word(text: str) -> bytes:
        seen = text if text.isascii() else text.encode().decode("latin-1").translate(VISIBLE)
        return array(kind, [p.id for p in pieces_of(seen)]).tobytes()

    def chunk(text: str) -> bytes:
        return array(kind, own.encode(text, add_special_tokens=False).ids).tobytes()

    marks = re.compile("|".join(re.escape(t.content) for t in own.get_added_tokens_decoder().values()) or r"(?!)")
    return Memo(word, REMEMBERED), Memo(chunk, REMEMBERED), marks, size


def ids_of(text: str, path: str) -> np.ndarray:
    """Ids of a text, as ``Tokenizer.encode`` without special tokens gives them."""
    words, chunks, marks, size = encoder(path)
    if PLAIN.fullmatch(text) and not marks.search(text):
        parts = map(words.__getitem__, WORDS.findall(text.lower()))
    else:
        parts = map(chunks.__getitem__, filter(None, SPACES.split(text)))
    return np.frombuffer(b"".join(parts), _kind(size))


def _kind(size: int) -> str:
    return "<u2" if size < 1 << 16 else "<u4"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of the encoded documents: doc_id, piece, start, length, ids_crc32, ids (see
    ``tokens``), and part and number: the task that made it and its number among the task's
    pieces of its length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, squeeze = public_tokenizers.path(vocabulary), zstandard.ZstdCompressor(level=1).compress
        kind = _kind(max(encoder(path)[3], end + 1))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(ids_of(text or "", path).astype("<u4"), np.uint32(end))
                for i, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    n = len(own)
                    rows.append((doc, i, start, n, zlib.crc32(own.tobytes()), squeeze(own.astype(kind).tobytes()), part, seen[n]))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "number"])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_frames(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part long, number long")


def tokens(packed: bytes, vocabulary: str = VOCABULARY, end: int = END) -> np.ndarray:
    """The ids of a piece's ``ids``."""
    kind = _kind(max(encoder(public_tokenizers.path(vocabulary))[3], end + 1))
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind).astype("<u4")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, rounds: int = ROUNDS, with_ids: bool = True) -> DataFrame:
    """Each piece and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    and, if asked for, ids.

    Documents are the texts' ids and ``end``; only those of more than ``capacity`` tokens are
    cut.  Null and empty texts are ``end`` alone.  Rows that repeat a doc_id, or have none,
    are documents of their own.  Which of several pieces of one length goes where follows the
    order in which they were read; the number of sequences doesn't depend on it.  An empty
    table gives an empty result.  Extra columns, whatever their names, are ignored.
    """
    made = table(pieces(docs, vocabulary, capacity, end), "pieces")
    tallies = table(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tallies")
    found = tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    sent = docs.sparkSession.sparkContext.broadcast(slots(plan({r["length"]: r["n"] for r in found}, capacity, rounds)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    shift = tallies.select(F.col("part").alias("_p"), F.col("length").alias("_l"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shift"))
    numbered = made.join(shift, (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_l"))).withColumn("number", F.col("number") + F.col("_shift"))
    kept = ["doc_id long", "piece int", "start long", "length long", "ids_crc32 long", *["ids binary"] * with_ids]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = located(sent.value, batch["length"].to_numpy(), batch["number"].to_numpy())
            yield batch.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    columns = [k.split()[0] for k in kept]
    return in_frames(numbered.select(*columns, "number"), place, ", ".join([*kept, "sequence_id long", "offset long"]))


def sequences(packed: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """The sequences of ``pack``: sequence_id, ids (little-endian 32-bit integers), and doc_ids
    and lengths of its pieces in order (a document without id as -1).

    A sequence is at most ``capacity`` pieces, so its list is bounded.
    """
    item = F.struct("offset", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    rows = grouped.select("sequence_id", *[F.col("p")[c].alias(c) for c in ("doc_id", "length", "ids")])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.concatenate([tokens(i, vocabulary, end) for i in own]).tobytes() for own in batch["ids"]]
            yield pd.DataFrame({"sequence_id": batch["sequence_id"], "ids": ids, "doc_ids": batch["doc_id"], "lengths": batch["length"]})

    return in_frames(rows, join, "sequence_id long, ids binary, doc_ids array<long>, lengths array<long>")
