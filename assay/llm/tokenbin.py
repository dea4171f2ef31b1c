"""Token ids in a byte-aligned variable-length file format.

An id is written as its frequency rank in the corpus, so common ids take one byte.  Four
ranks share one control byte, two bits each saying how many bytes (1 to 4) a rank takes;
control bytes and data bytes are kept apart.  Decoding looks the control byte up in a
table of lengths and gathers the data bytes, all in numpy.

The files are Parquet, so any store that Spark writes will do.  A row is a segment: the
documents it holds in ascending order (how many without id come first, ids, and number of
tokens each) and the two byte strings.  A file's rows and the files ascend by doc_id.  ``ranks`` beside them holds the
id of each rank.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from operator import attrgetter

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import folder, in_frames, spread, table

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Tokens in a segment (a longer document is a segment of its own).
SEGMENT = 1 << 18
#: Texts whose letters, digits, signs and spaces every version of the Unicode tables reads alike, and the public pattern for them.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
SIMPLE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[!-/:-@\[-`{-~]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Texts whose ids are tallied together.
TOGETHER = 256
#: Pre-tokens whose ids a worker remembers, besides as many that it met before those; longer ones than LONGEST aren't kept.
REMEMBERED, LONGEST = 1 << 18, 64
#: Characters of the texts whose pre-tokens are looked up together (a longer text by itself), and pre-tokens the model gets at once.
AT_ONCE, JOINED = 1 << 21, 256
#: A byte-level vocabulary writes a byte as the character of that number if it can be seen, else as the next from U+0100.
SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
VISIBLE = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in SEEN)}
#: How many data bytes the four ranks of each control byte take.
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def _class(names: str) -> str:
    """The code points of a Unicode class, as ranges for a set in a pattern."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for found in regex.findall(f"[{names}]+", every) for run in _runs(found))


def _runs(found: str) -> list[str]:
    """A string of ascending characters, cut where one is left out."""
    cuts = [0, *(i for i in range(1, len(found)) if ord(found[i]) != ord(found[i - 1]) + 1), len(found)]
    return [found[a:b] for a, b in itertools.pairwise(cuts)]


@cache
def split() -> re.Pattern:
    """The public pattern, said so that a run of Latin letters, ASCII digits or other ASCII signs takes
    one step where an ASCII character follows; the classes are those of \\p{L}, \\p{N} and \\s."""
    letter, number, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
    end, other = r"(?![\x80-\U0010ffff])", f"[^{letter}{number}{space}]"
    return re.compile(
        rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]++{end}| ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]++{end}| ?[{number}]+"
        rf"| ?[\x00-\x08\x0e-\x1f!-/:-@\[-`{{-\x7f]++{end}| ?{other}+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Pretokens:
    """Pre-tokens and their ids as bytes, of a worker.

    The model gets many new ones at once, joined by a byte that none of its merges has, so
    that each is merged by itself.  Once as many as REMEMBERED are held they become the old
    ones, of which those met again are taken over.
    """

    def __init__(self, own: Tokenizer) -> None:
        self.tokenize, self.known, self.old = own.model.tokenize, {}, {}
        self.seen = "".join(chr(VISIBLE.get(b, b)) for b in range(256))
        merged = set("".join(token for token in own.get_vocab() if len(token) > 1))
        apart = [b for b in VISIBLE if b < 128 and self.seen[b] not in merged and own.token_to_id(self.seen[b]) is not None]
        self.between = chr(apart[0]) if apart else None
        self.mark = own.token_to_id(self.seen[apart[0]]) if apart else None

    def ids(self, text: str) -> np.ndarray:
        pieces = self.tokenize(text.encode("utf-8").decode("latin-1").translate(self.seen))
        return np.fromiter(map(attrgetter("id"), pieces), "<u4", len(pieces))

    def learn(self, words: list[str]) -> None:
        single = [w for w in words if self.between is None or self.between in w]
        for word in single:
            self.known[word] = self.ids(word).tobytes()
        if single:
            words = [w for w in words if w not in self.known]
        for at in range(0, len(words), JOINED):
            held = words[at : at + JOINED]
            ids = self.ids(self.between.join(held))
            raw, begin = ids.tobytes(), 0
            for word, end in zip(held, [*(np.flatnonzero(ids == self.mark) * 4).tolist(), len(raw)], strict=True):
                self.known[word] = raw[begin:end]
                begin = end + 4

    def encode(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens."""
        new = set().union(*lists).difference(self.known)
        again = new.intersection(self.old)
        self.known.update((word, self.old[word]) for word in again)
        self.learn(list(new - again))
        out = [b"".join(map(self.known.__getitem__, words)) for words in lists]
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        if len(self.known) >= REMEMBERED:
            self.known, self.old = {}, self.known
        return out


@cache
def tokenizer(path: str) -> tuple[Tokenizer, list[str], Pretokens]:
    """The tokenizer, the texts of its added tokens, and the ids of pre-tokens so far.

    Only byte-level vocabularies that split by the public pattern are taken: pre-tokens are
    made by it here, and given to the model as they are.
    """
    own = Tokenizer.from_file(path)
    before = own.pre_tokenizer
    plain = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
    if own.normalizer is not None or not plain or own.post_processor is not None:
        raise ValueError(f"{path}: only byte-level vocabularies without normalizer, prefix space and post-processor")
    return own, [t.content for t in own.get_added_tokens_decoder().values()], Pretokens(own)


def _together(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    total = 0
    for text in texts:
        if held and total + len(text) > AT_ONCE:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def encode_all(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of texts as little-endian 32-bit integers, as ``Tokenizer.encode`` gives them.

    Byte-level BPE treats each pre-token by itself, so the model is given pre-tokens, and
    each is remembered.  A text that holds an added token goes through the tokenizer whole.
    """
    own, added, known = tokenizer(path)
    for held in _together(texts):
        whole = [any(a in text for a in added) for text in held]
        lists = [[] if w else (SIMPLE if PLAIN.fullmatch(text) else split()).findall(text) for text, w in zip(held, whole, strict=True)]
        for text, w, ids in zip(held, whole, known.encode(lists), strict=True):
            yield np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if w else ids


def encode(text: str, path: str) -> bytes:
    """``encode_all`` of one text."""
    return next(encode_all([text], path))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative integers below 2**32."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    code = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    code[: len(ranks)] = size - 1
    control = code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)
    return control.sum(axis=1, dtype=np.uint8).tobytes(), data[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of ``pack``."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _segments(rows: Iterator[tuple], tokens: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += row[1]
        if total >= tokens:
            yield held
            held, total = [], 0
    if held:
        yield held


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of at most ``rows`` in what runs meanwhile: a worker holds fewer whole texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encode every text and write the files to ``path``/segments and ``path``/ranks.

    ``end`` is appended to each document.  Null and empty texts have it alone.  Documents
    ascend by doc_id, null first; those of the same doc_id by their text's hash, and copies
    as they were read.  An empty table gives no segment; extra columns are ignored.
    """
    spark = docs.sparkSession

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = public_tokenizers.path(vocabulary)
        last = np.array([end], "<u4").tobytes()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, n = [], []
            for own in encode_all([text or "" for text in batch["text"]], file):
                own += last
                n.append(len(own) // 4)
                ids.append(squeeze(np.frombuffer(own, "<u4").astype("<u2").tobytes() if wide == 2 else own))
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "h": batch["h"], "n": n, "ids": ids})

    size = tokenizer(public_tokenizers.path(vocabulary))[0].get_vocab_size()
    wide = 2 if max(size, end) < 1 << 16 else 4
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    coded = in_frames(rows, code, "row long, doc_id long, h long, n long, ids binary")
    # the bounds of the ranges come from doc_id alone, so no text is encoded for them
    parts = spread(docs)
    with small_batches(spark):
        coded = table(coded, "coded")

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), f"<u{wide}").astype("<u4")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(max(size, end + 1), np.int64)
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):  # a tally is as long as the vocabulary, so not one for each text
                total += np.bincount(np.concatenate([read(raw) for raw in batch["ids"].iloc[at : at + TOGETHER]]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    counts = in_frames(coded.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most one row per id of the vocabulary, whatever the corpus
    counts = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)
    counts.coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(size, end + 1), np.int64)
    for row in spark.read.parquet(f"{path}/ranks").collect():
        rank_of[row["id"]] = row["rank"]
    order_of = spark.sparkContext.broadcast(rank_of.astype("<u4"))

    def recode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = order_of.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch["doc_id"], batch["n"].tolist(), batch["ids"], strict=True)

        for held in _segments(rows(), SEGMENT):
            ids = np.concatenate([read(r[2]) for r in held])
            control, data = pack(ranks[ids])
            known = [int(r[0]) for r in held if not pd.isna(r[0])]
            yield pd.DataFrame({"absent": [len(held) - len(known)], "docs": [known], "lengths": [[r[1] for r in held]], "tokens": [len(ids)], "control": [control], "data": [data]})

    # the row's number deals copies of one row to several ranges
    order = (F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row"))
    ranged = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    out = in_frames(ranged, recode, "absent long, docs array<long>, lengths array<long>, tokens long, control binary, data binary")
    # partitions ascend, and so do a partition's segments
    place = (F.spark_partition_id().cast("long"), F.monotonically_increasing_id())
    out.withColumns({"part": place[0], "segment": place[1]}).write.option("compression", "uncompressed").parquet(f"{path}/segments")
    order_of.unpersist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: doc_id, start (tokens before it), ids (binary: little-endian
    32-bit integers) and n_tokens."""
    return _decoded(spark, path, "ids binary", lambda ids: ids)


def _decoded(spark: SparkSession, path: str, column: str, of_ids) -> DataFrame:  # noqa: ANN001
    """doc_id, start, n_tokens and, as ``column`` ("name type"), what ``of_ids`` makes of each document's ids."""
    segments = spark.read.parquet(f"{path}/segments")
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("_tokens"))
    # one row per written file and segment: running totals within a file, then over files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("part", F.col("segment").alias("_segment"), F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("_inside"))
    places = places.join(starts, places["part"] == starts["_part"]).select("_segment", (F.col("_before") + F.col("_inside")).alias("start"))
    places = table(places, "places")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    ids_of = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], "<u4"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for absent, docs, lengths, control, data, start in zip(*(batch[c] for c in ("absent", "docs", "lengths", "control", "data", "start")), strict=True):
                n = np.array(lengths, np.int64)
                ids = ids_of.value[unpack(control, data, int(n.sum()))]
                ends = np.cumsum(n)
                yield pd.DataFrame({
                    "doc_id": pd.array([None] * int(absent) + docs.tolist(), dtype="Int64"),
                    "start": start + ends - n,
                    "n_tokens": n,
                    column.split()[0]: [of_ids(ids[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)],
                })

    located = segments.join(places, segments["segment"] == places["_segment"]).select("absent", "docs", "lengths", "control", "data", "start")
    return in_frames(located, decode, f"doc_id long, start long, n_tokens long, {column}")


def digest(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    ``start`` counts the ids of all documents before it in ascending doc_id order; rows
    that share a doc_id come in the order of their text's hash.  Null and empty texts
    have the end id alone.  An empty table gives an empty result; extra columns are
    ignored.
    """
    spark = docs.sparkSession
    path = folder(spark, "tokens")
    write(docs, path, vocabulary, end)
    return _decoded(spark, path, "ids_crc32 long", zlib.crc32)
