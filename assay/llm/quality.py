"""Quality rules by suffix-array repetition.

Words of a batch of documents are numbered and their suffixes sorted by prefix doubling;
a suffix ends with its document, so documents never mix.  Neighbours in the suffix array
with a longest common prefix of ``m`` words or more bound an interval: a maximal repeated
substring.  Its occurrences are spans; the rules limit the fraction of a document that the
spans cover and the longest repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, in_frames, slices

FOUND = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Words that are sorted at a time (a longer document is sorted alone): some 20 arrays are as long.
BATCH_WORDS = 1 << 16
#: Repeats of so many words or more may cover this share of the characters; none may be longer than LONGEST words.
LONG_WORDS, FRACTION, LONGEST = 10, 0.1, 60


def common_prefixes(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of many documents, in those suffixes that share a word with a neighbour.

    ``words``: numbers of the words, ``doc``: ascending document numbers, both by place.
    Gives places ``a``, ``b`` of neighbouring suffixes of one document and the length of
    their longest common prefix (1 or more).
    """
    n = len(words)
    end = np.searchsorted(doc, doc, side="right")  # a suffix ends with its document
    ranks = [np.unique(doc.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int64) if n else words]
    step = 1
    # suffixes that are still equal to another one; the others keep their rank
    order = np.argsort(ranks[0], kind="stable") if n else np.zeros(0, np.int64)
    while n:
        rank = ranks[-1]
        r = rank[order]
        same = np.concatenate([[False], r[1:] == r[:-1]])
        tied = same | np.concatenate([same[1:], [False]])
        at = order[tied]
        if not len(at):
            break
        follow = at + step
        second = np.where(follow < end[at], rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        first = rank[at]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        old = np.concatenate([[True], first[1:] != first[:-1]])
        # ranks stay unique: a class is named by its smallest place in the whole order
        place = np.flatnonzero(tied)
        name = place[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        base = place[np.maximum.accumulate(np.where(old, np.arange(len(at)), 0))]
        if step == 1 and len(ranks) == 1:  # the first ranks are dense numbers, later ones are places
            start = np.flatnonzero(~same)
            full = np.empty(n, np.int64)
            full[order] = np.repeat(start, np.diff(np.append(start, n)))
            ranks[0] = full
        fresh = ranks[-1].copy()
        fresh[at] = name
        del base
        order = order.copy()
        order[tied] = at
        ranks.append(fresh)
        step *= 2
        if new.all():
            break
    if not n:
        return (np.zeros(0, np.int64),) * 3
    a, b = order[:-1], order[1:]
    hit = ranks[0][a] == ranks[0][b]
    a, b = a[hit], b[hit]
    lcp = np.zeros(len(a), np.int64)
    x, y = a.copy(), b.copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (x < end[a]) & (y < end[b])
        equal = inside & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
        # an equal rank speaks for 2**level words only if neither suffix ends before
        whole = equal & (x + (1 << level) <= end[a]) & (y + (1 << level) <= end[b])
        jump = np.where(whole, 1 << level, 0)
        lcp += jump
        x += jump
        y += jump
    return a, b, lcp


def covered(words: np.ndarray, doc: np.ndarray, docs: int, least: tuple[tuple[int, np.ndarray | None], ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per document: for each (length, weights) of ``least`` what repeats of that many words or
    more cover (words, or their weights), and the words of the longest repeat."""
    a, b, lcp = common_prefixes(words, doc)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc[a], lcp)
    counts = []
    for m, weights in least:
        long = lcp >= m
        start = np.concatenate([a[long], b[long]])
        stop = start + np.concatenate([lcp[long], lcp[long]])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, stop, -1)
        inside = np.cumsum(edge[:-1]) > 0
        counts.append(np.bincount(doc[inside], None if weights is None else weights[inside], docs).astype(np.int64))
    return counts, longest


def _repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if FOUND.search(line):
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return again


def _measure(ids: list, texts: list[str], lists: list[list[str]], rules: tuple[int, int, float, int]) -> pd.DataFrame:
    window, long_words, fraction, longest_words = rules
    n_words = np.array([len(x) for x in lists], np.int64)
    flat = [w for x in lists for w in x]
    doc = np.repeat(np.arange(len(lists)), n_words)
    numbers = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
    chars = np.fromiter(map(len, flat), np.int64, len(flat))
    word_chars = np.bincount(doc, chars, len(lists)).astype(np.int64)
    (repeat, long), longest = covered(numbers.astype(np.int64), doc, len(lists), ((window, None), (long_words, chars)))
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    return pd.DataFrame({
        "doc_id": pd.array(ids, dtype="Int64"),  # nulls and large ids stay whole
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": [len(SYMBOLS.findall(t)) for t in texts],
        "n_dup_lines": [_repeated_lines(t) for t in texts],
        "n_repeat_words": repeat,
        "base_failed": failed,
        "long_repeat_chars": long,
        "longest_repeat": longest,
        "kept": ~failed & (long <= fraction * word_chars) & (longest <= longest_words),
    })


COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, long_repeat_chars long, longest_repeat long, kept boolean"
)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[str]]]]:
    """Rows and the words of their texts, about BATCH_WORDS at a time."""
    for batch in batches:
        lists: list[list[str]] = []
        begin = total = 0
        for i, text in enumerate(batch["text"]):
            found = FOUND.findall(text) if text else []
            lists.append(found)
            total += len(found)
            if total >= BATCH_WORDS:
                yield batch.iloc[begin : i + 1], lists
                begin, total, lists = i + 1, 0, []
        if lists:
            yield batch.iloc[begin:], lists


def measure(docs: DataFrame, window: int = 5, long_words: int = LONG_WORDS, fraction: float = FRACTION, longest_words: int = LONGEST) -> DataFrame:
    """Counts and verdict of every document.

    Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in
    repeats of ``window`` words or more), base_failed (fewer than 10 words, or over 20 % of
    them in such repeats), long_repeat_chars, longest_repeat, kept.  A document is kept
    if it isn't base_failed, repeats of ``long_words`` words or more cover at most
    ``fraction`` of the characters of its words, and no repeat is longer than ``longest_words`` words.
    Null, empty and white texts have no words: all counts 0, base_failed, not kept.
    Repeated rows are measured alike.  An empty table gives an empty result.  Extra columns
    are ignored; a document of any length is measured whole.
    """
    rules = (window, long_words, fraction, longest_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, lists in _batches(batches):
            yield _measure(list(rows["doc_id"]), [t or "" for t in rows["text"]], lists, rules)

    return in_frames(docs.select("doc_id", "text"), run, COLUMNS)


def keep_good(docs: DataFrame, window: int = 5, long_words: int = LONG_WORDS, fraction: float = FRACTION, longest_words: int = LONGEST) -> DataFrame:
    """The documents that ``measure`` keeps, with the input's columns; one pass, no shuffle.

    Rows pass as Arrow batches of which some are left out, so every value stays as it is,
    whatever the columns' names.  Null, empty and white texts go; repeated rows stay or go
    together; an empty table stays empty.
    """
    rules = (window, long_words, fraction, longest_words)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            frames = iter([pd.DataFrame({"text": batch.column(at).to_pandas()})])
            kept = [_measure([None] * len(rows), [t or "" for t in rows["text"]], lists, rules)["kept"] for rows, lists in _batches(frames)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
c AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
v AS (SELECT r, i, w,
        CASE WHEN lead(i, 4) OVER p IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) END AS s5,
        CASE WHEN lead(i, 9) OVER p IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p,
             lead(w, 5) OVER p, lead(w, 6) OVER p, lead(w, 7) OVER p, lead(w, 8) OVER p, lead(w, 9) OVER p) END AS s10,
        CASE WHEN lead(i, 60) OVER p IS NOT NULL THEN string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING) END AS s61
      FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, w,
        s5 IS NOT NULL AND count(*) OVER (PARTITION BY r, s5) > 1 AS h5,
        s10 IS NOT NULL AND count(*) OVER (PARTITION BY r, s10) > 1 AS h10,
        s61 IS NOT NULL AND count(*) OVER (PARTITION BY r, s61) > 1 AS h61
      FROM v),
m AS (SELECT r, w, bool_or(h5) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
        bool_or(h10) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, h61 FROM h),
q AS (SELECT r, count(*) FILTER (c5) AS n_repeat_words, coalesce(sum(length(w)) FILTER (c10), 0) AS n_long, bool_or(h61) AS over FROM m GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT d.doc_id, coalesce(c.n_words, 0) AS n_words, CAST(coalesce(c.word_chars, 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(k.n_dup_lines, 0) AS n_dup_lines,
        coalesce(q.n_repeat_words, 0) AS n_repeat_words, coalesce(q.n_long, 0) AS n_long, coalesce(q.over, false) AS over
      FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r) LEFT JOIN q USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_long <= 0.1 * word_chars AND NOT over AS kept
FROM a
"""
