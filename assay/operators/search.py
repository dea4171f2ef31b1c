"""Looking for many texts in many documents: quotes in a corpus, words of a dictionary.

Quotes are found by an inverted index of fingerprints of character runs: each window of
hashes keeps its smallest, so whatever holds a quote has all of the quote's fingerprints.
A quote's rarest fingerprint names the documents to look at, and containment is verified.
A dictionary is one automaton, or several if it is large, passed over each text once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.shared import table

#: Characters of a run, and runs of a window: what is shorter than RUN + WINDOW - 1 has no fingerprint.
RUN, WINDOW = 8, 9
#: Documents of a fingerprint that are looked at together.
TOGETHER = 4096
#: Patterns, and characters of patterns, of one automaton.
PATTERNS, CHARACTERS = 200_000, 8_000_000


def winnowed(one: str, run: int = RUN, window: int = WINDOW) -> np.ndarray:
    """Distinct smallest hashes of the windows of a text."""
    code = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(code) < run + window - 1:
        return np.zeros(0, np.int64)
    # runs and windows by doubling: a run is hashed from two that overlap or meet, and so is the smallest of a window
    h, size, base = code, 1, np.uint64(0x9E3779B97F4A7C15)
    while size < run:
        step = min(size, run - size)
        h = (h[: len(h) - step] * base) ^ (h[step:] + (h[step:] >> np.uint64(29)))
        size += step
    h = h * base
    least, size = h ^ (h >> np.uint64(32)), 1
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    turns = np.ones(len(least), bool)  # neighbours mostly share theirs
    np.not_equal(least[1:], least[:-1], out=turns[1:])
    return np.unique(least[turns]).view(np.int64)


def fingerprints(rows: DataFrame) -> DataFrame:
    """(scope, at, print) of rows (scope, at, text)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [winnowed(t) for t in batch["text"]]
            n = [len(f) for f in found]
            yield pd.DataFrame({"scope": batch["scope"].repeat(n), "at": batch["at"].repeat(n), "print": np.concatenate([*found, np.zeros(0, np.int64)])})

    return rows.select("scope", "at", "text").mapInPandas(work, "scope string, at long, print long")


def _automata(patterns: DataFrame) -> Iterator[list[str]]:
    """The distinct patterns (``pattern``) in lists of bounded size, one at a time."""
    kept = table(patterns.select("pattern").filter("pattern <> ''").distinct(), "patterns")
    n, characters = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    parts = max(-(-n // PATTERNS), -(-characters // CHARACTERS))
    for i in range(parts):  # one pass over the texts for each
        yield [r[0] for r in kept.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i).collect()]


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    made.make_automaton()
    return made


def dictionary(docs: DataFrame, key: str, body: str, patterns: DataFrame) -> DataFrame:
    """(key, pattern, n, first_line) of the patterns that each text holds.

    ``patterns``: a column pattern; nulls, repeats and empty ones don't count.  ``n`` counts
    occurrences of a pattern that don't overlap, left to right; ``first_line`` is the line of
    the first, from 1.  Each text is read once per automaton, whatever the number of patterns;
    an automaton holds at most PATTERNS, and its words are broadcast.  Null and empty texts
    hold nothing.  ``key`` is a long.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("at"), F.col(body).alias("text")).filter("text <> ''")
    out = spark.createDataFrame([], "at long, pattern string, n long, first_line long")
    for listed in _automata(patterns):
        sent = spark.sparkContext.broadcast(listed)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            made = _automaton(sent.value)
            for batch in batches:
                found = []
                for at, one in zip(batch["at"], batch["text"], strict=True):
                    free: dict[str, int] = {}
                    tally: dict[str, list[int]] = {}
                    for end, p in made.iter(one):
                        start = end - len(p) + 1
                        if start >= free.get(p, 0):
                            free[p] = end + 1
                            tally.setdefault(p, [0, start])[0] += 1
                    found += [(at, p, n, 1 + one.count("\n", 0, start)) for p, (n, start) in tally.items()]
                yield pd.DataFrame(found, columns=["at", "pattern", "n", "first_line"])

        out = out.unionByName(rows.mapInPandas(scan, "at long, pattern string, n long, first_line long"))
    return out.withColumnRenamed("at", key)


def _short(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(scope, text) of the short quotes that a document of their scope holds; a task tells each once."""
    spark, out = docs.sparkSession, quotes.select("scope", "text").filter("text = ''").join(docs.select("scope").distinct(), "scope")
    for listed in _automata(quotes.select(F.col("text").alias("pattern"))):
        sent = spark.sparkContext.broadcast(listed)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            made, told = _automaton(sent.value), defaultdict(set)
            for batch in batches:
                news = []
                for s, one in zip(batch["scope"], batch["text"], strict=True):
                    new = set(map(itemgetter(1), made.iter(one))) - told[s]
                    told[s] |= new
                    news += [(s, p) for p in new]
                yield pd.DataFrame(news, columns=["scope", "text"])

        held = docs.select("scope", "text").mapInPandas(scan, "scope string, text string").distinct()
        out = out.unionByName(quotes.select("scope", "text").join(held, ["scope", "text"], "left_semi"))
    return out


def _verified(pairs: DataFrame, quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Quotes (q) of the pairs (q, at) whose document holds them; a document's text moves once."""
    asked = pairs.join(quotes.select(F.col("at").alias("q"), F.col("text").alias("quote")), "q")
    return asked.join(docs.select("at", "text"), "at").filter(F.contains("text", "quote")).select("q").distinct()


def found(quotes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(scope, text, found) of the distinct quotes (scope, text): whether a document of their scope holds them.

    ``corpus``: scope and text.  Texts are compared as they are.  An empty quote is held by
    any document; a null one, or one without scope, isn't answered, and null documents hold
    nothing.  Long quotes go by their rarest fingerprint: first to one document, then those
    not found there to all that have it, common fingerprints in parts of TOGETHER documents.
    Short ones go through automata.
    """
    order = F.monotonically_increasing_id().alias("at")
    # texts are written before nulls are left out, or what makes a text would run once more for the filter
    given = "scope is not null and text is not null"
    docs = table(corpus.select(order, "scope", "text"), "corpus").filter(given)
    asked = table(table(quotes.select("scope", "text"), "asked").filter(given).distinct().select(order, "scope", "text"), "quotes")
    long = asked.filter(F.length("text") >= RUN + WINDOW - 1)
    theirs = table(fingerprints(long), "quote-prints")
    wanted = theirs.select("scope", "print").distinct().hint("shuffle_hash")  # the corpus's prints, far more, aren't sorted
    index = table(fingerprints(docs).join(wanted, ["scope", "print"], "left_semi"), "index")
    known = index.groupBy("scope", "print").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("one"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "print", "one"))
    # a fingerprint that no document has: the quote isn't there
    chosen = theirs.join(known, ["scope", "print"], "left").groupBy(F.col("at").alias("q"), "scope").agg(rarest.alias("r")).filter("r.n > 0")
    chosen = table(chosen.select("q", "scope", "r.*"), "chosen")
    first = table(_verified(chosen.select("q", F.col("one").alias("at")), asked, docs), "first")
    left = chosen.join(first, "q", "left_anti").filter("n > 1")
    parts = F.ceil(F.col("n") / TOGETHER)
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n", "one")
    sizes = known.filter("n > 1").select("scope", "print", parts.alias("parts"))
    dealt = index.join(sizes, ["scope", "print"]).withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")))
    rest = _verified(left.join(dealt, ["scope", "print", "part"]).select("q", "at"), asked, docs)
    hit = first.unionByName(rest).join(asked, F.col("q") == F.col("at")).select("scope", "text")
    hit = hit.unionByName(_short(asked.filter(F.length("text") < RUN + WINDOW - 1), docs)).withColumn("_hit", F.lit(True))
    return asked.select("scope", "text").join(hit, ["scope", "text"], "left").select("scope", "text", F.col("_hit").isNotNull().alias("found"))


def quoted(rows: DataFrame, scope: str, quote: str, corpus: DataFrame, body: str, name: str = "quoted") -> DataFrame:
    """``rows`` with ``name``: whether a document of ``corpus`` with the same ``scope`` holds the quote.

    White space doesn't count.  Null where the row has no scope or no quote.
    """
    own = table(rows.withColumns({"_scope": F.col(scope).cast("string"), "_bare": text.bare(F.col(quote))}), "rows")
    held = corpus.select(F.col(scope).cast("string").alias("scope"), text.bare(F.col(body)).alias("text"))
    answers = found(own.select(F.col("_scope").alias("scope"), F.col("_bare").alias("text")), held)
    joined = own.join(answers.toDF("_s", "_t", "_found"), (F.col("_scope") == F.col("_s")) & (F.col("_bare") == F.col("_t")), "left")
    return joined.select(*rows.columns, F.col("_found").alias(name))
