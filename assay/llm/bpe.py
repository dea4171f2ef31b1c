"""Byte-level BPE encoding and decoding, by overlapping chunks.

A text is cut into chunks that overlap.  Chunks are pre-tokenised in parallel, each without
the others.  Neighbours are stitched at the first boundary between pre-tokens that both have
and that neither's cut can have moved; what a chunk keeps between its two stitches is then
encoded, pre-token by pre-token.  A text of one chunk has no stitches and is finished where it
is read; only the chunks of longer ones are shuffled.  Decoding concatenates the bytes of the
ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, in_frames, spread, table

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 1 << 18


@cache
def pattern(source: str) -> regex.Pattern:
    return regex.compile(source)


@cache
def coder(path: str) -> tuple[tiktoken.Encoding, list[bytes], list[str]]:
    """The encoder of single pre-tokens, the bytes of each id and its decimal form, of a rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    raw = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        raw[rank] = word
    # its pattern takes whatever it is given as one pre-token
    encoding = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return encoding, raw, [str(i) for i in range(len(raw))]


@cache
def memo(path: str) -> Memo:
    encode = coder(path)[0].encode_ordinary
    return Memo(lambda word: np.array(encode(word), "<u4").tobytes(), REMEMBERED)


def pieces_of(text: str, path: str, source: str) -> bytes:
    """Ids of a stretch of text between two true boundaries, as little-endian 32-bit integers."""
    return b"".join(map(memo(path).__getitem__, pattern(source).findall(text)))


def decode(ids: np.ndarray, path: str) -> bytes:
    raw = coder(path)[1]
    return b"".join([raw[i] for i in ids.tolist()])


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of the chunks of a text: each ends ``overlap`` after the next begins."""
    return [(at, min(len(text), at + size + overlap)) for at in range(0, max(1, len(text) - overlap), size)]


def edges(text: str, begin: int, last: bool, overlap: int, source: str) -> tuple[list[int], list[int]]:
    """Of a chunk that begins at ``begin``: the places where a pre-token begins in its first
    ``overlap`` characters, and those in its last that the cut behind them cannot have moved.

    The pattern only looks ahead: from a true boundary on a chunk's boundaries are true, but
    for the last two pre-tokens before a cut, which the missing text may change.
    """
    at = np.cumsum([0, *map(len, pattern(source).findall(text))])
    sure = at if last else at[: max(0, len(at) - 3)]
    return (at[at < overlap] + begin).tolist(), (sure[sure >= len(text) - overlap] + begin).tolist()


def stitch(parts: DataFrame) -> DataFrame:
    """(row, chunk, begin, end): the stretch of its text that each chunk keeps; null if chunks don't meet.

    ``parts``: row, chunk, first, head, tail.  Neighbours meet at the least place that is in
    the earlier one's tail and the later one's head.
    """
    order = Window.partitionBy("row").orderBy("chunk")
    meet = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    met = parts.select("row", "chunk", "size", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(meet).alias("begin"))
    later = F.lead("chunk").over(order).isNull()
    return met.select("row", "chunk", "begin", F.when(later, F.col("size")).otherwise(F.lead("begin").over(order)).alias("end"))


#: A finished text, or (row set) one of its chunks: which, where it begins, the text's length, the piece.
DONE = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
CUT = f"{DONE}, row long, chunk int, size long, piece string"


class _Sink:
    """Takes the ids of a text piece by piece; gives its finished row."""

    def __init__(self, path: str, digests: bool) -> None:
        self.path, self.digests = path, digests
        self.n, self.kept, self.decimal, self.bytes = 0, [], hashlib.sha256(), hashlib.sha256()

    def add(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        if not len(ids):
            return
        if self.digests:
            decimal = coder(self.path)[2]
            listed = ",".join([decimal[i] for i in ids.tolist()])
            self.decimal.update((listed if not self.n else f",{listed}").encode())
            self.bytes.update(decode(ids, self.path))
        else:
            self.kept.append(raw)
        self.n += len(ids)

    def row(self, doc_id: object) -> list:
        own = None if pd.isna(doc_id) else int(doc_id)
        if self.digests:
            return [own, self.n, self.decimal.hexdigest(), self.bytes.hexdigest(), None]
        return [own, self.n, None, None, b"".join(self.kept)]


def _frame(rows: list[list], schema: str) -> pd.DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    frame = pd.DataFrame({name: [r[i] for r in rows] for i, name in enumerate(names)}, dtype=object)
    return frame


def _chunks(docs: DataFrame, ranks: str, source: str, size: int, overlap: int, digests: bool) -> DataFrame:
    """Texts of one chunk finished, the others as chunks; ``docs``: row, doc_id, text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = public_tokenizers.path(ranks)
        for batch in batches:
            out = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                at = chunk_bounds(text, size, overlap)
                own = None if pd.isna(doc_id) else int(doc_id)
                if len(at) == 1:
                    sink = _Sink(path, digests)
                    sink.add(pieces_of(text, path, source))
                    out.append([*sink.row(doc_id), None, None, None, None])
                else:
                    out += [[own, None, None, None, None, row, i, len(text), text[a:b]] for i, (a, b) in enumerate(at)]
            yield _frame(out, CUT)

    return table(in_frames(docs, cut, CUT), "chunks")


def _joined(long: DataFrame, ranks: str, source: str, size: int, overlap: int, digests: bool) -> DataFrame:
    """Finished rows of the texts whose chunks are ``long``."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, chunk, whole, piece in zip(batch["row"], batch["chunk"], batch["size"], batch["piece"], strict=True):
                begin = int(chunk) * size
                out.append([int(row), int(chunk), int(whole), *edges(piece, begin, begin + len(piece) == whole, overlap, source)])
            yield _frame(out, "row, chunk, size, head, tail")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = public_tokenizers.path(ranks)
        for batch in batches:
            out = []
            for doc_id, row, chunk, begin, end, piece in zip(*(batch[c] for c in ("doc_id", "row", "chunk", "begin", "end", "piece")), strict=True):
                base = int(chunk) * size
                own = None if pd.isna(doc_id) else int(doc_id)
                out.append([own, int(row), int(chunk), pieces_of(piece[int(begin) - base : int(end) - base], path, source)])
            yield _frame(out, "doc_id, row, chunk, ids")

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = public_tokenizers.path(ranks)
        sink, now, doc = _Sink(path, digests), None, None
        for batch in batches:
            out = []
            for doc_id, row, ids in zip(batch["doc_id"], batch["row"], batch["ids"], strict=True):
                if row != now:
                    if now is not None:
                        out.append(sink.row(doc))
                    sink, now, doc = _Sink(path, digests), row, doc_id
                sink.add(ids)
            yield _frame(out, DONE)
        if now is not None:
            yield _frame([sink.row(doc)], DONE)

    n = spread(long)
    dealt = long.select("row", "chunk", "size", "piece").repartition(n, "row", "chunk")
    marked = in_frames(dealt, mark, "row long, chunk int, size long, head array<long>, tail array<long>")
    met = table(stitch(marked), "stitches").withColumnsRenamed({"row": "_row", "chunk": "_chunk"})
    apart = met.filter("begin is null").select(F.col("_row").alias("_apart")).distinct()
    same = (long["row"] == F.col("_row")) & (long["chunk"] == F.col("_chunk"))
    ready = long.join(met.join(apart, F.col("_row") == F.col("_apart"), "left_anti"), same)
    coded = in_frames(ready.select("doc_id", "row", "chunk", "begin", "end", "piece"), code, "doc_id long, row long, chunk int, ids binary")
    done = in_frames(coded.repartition(n, "row").sortWithinPartitions("row", "chunk").select("doc_id", "row", "ids"), assemble, DONE)
    if not apart.head(1):
        return done

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, doc = [], None, None
        for batch in batches:
            out = []
            for doc_id, row, whole, chunk, piece in zip(*(batch[c] for c in ("doc_id", "row", "size", "chunk", "piece")), strict=True):
                if row != now:
                    if now is not None:
                        out.append([now, doc, "".join(held)])
                    held, now, doc = [], int(row), None if pd.isna(doc_id) else int(doc_id)
                held.append(piece if int(chunk) * size + len(piece) == whole else piece[:size])
            yield _frame(out, "row, doc_id, text")
        if now is not None:
            yield _frame([[now, doc, "".join(held)]], "row, doc_id, text")

    # a pre-token is longer than the overlap: such a text is cut anew, into wider chunks
    again = long.join(apart, long["row"] == F.col("_apart"), "left_semi").repartition(n, "row").sortWithinPartitions("row", "chunk")
    again = in_frames(again.select("doc_id", "row", "size", "chunk", "piece"), rebuild, "row long, doc_id long, text string")
    wider = _chunks(again, ranks, source, size * 16, overlap * 16, digests)
    return done.unionByName(_finished(wider, ranks, source, size * 16, overlap * 16, digests))


def _finished(chunks: DataFrame, ranks: str, source: str, size: int, overlap: int, digests: bool) -> DataFrame:
    done = chunks.filter("row is null").select(*[part.split()[0] for part in DONE.split(", ")])
    long = chunks.filter("row is not null")
    return done.unionByName(_joined(long, ranks, source, size, overlap, digests)) if long.head(1) else done


def _run(docs: DataFrame, ranks: str, source: str, size: int, overlap: int, digests: bool) -> DataFrame:
    # a row's number tells copies apart; it is fixed once the chunks are written
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return _finished(_chunks(rows, ranks, source, size, overlap, digests), ranks, source, size, overlap, digests)


def encode(docs: DataFrame, ranks: str = RANKS, source: str = public_tokenizers.PATTERN, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian 32-bit integers) of every text.

    Each match of ``source`` is encoded by itself; special tokens are ordinary text.
    Null and empty texts have no ids.  Repeated rows give repeated rows; texts of any
    length are encoded whole.  An empty table gives an empty result; extra columns are
    ignored.
    """
    return _run(docs, ranks, source, size, overlap, False).select("doc_id", "n_tokens", "ids")


def digest(docs: DataFrame, ranks: str = RANKS, source: str = public_tokenizers.PATTERN, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256
    (of the bytes that the ids decode to) of every text, encoded as by ``encode``."""
    return _run(docs, ranks, source, size, overlap, True).drop("ids")
