"""Secret scans: fixed kinds, and a battery of randomness tests with false-discovery control.

Column expressions only.  A regular expression's matches and the pieces between them
(``regexp_extract_all`` and ``split``) give every match's place by running lengths.

The battery looks at runs of 20 or more key characters that no fixed kind covers, and at
the pieces of them between slashes:

* the encoding is inferred from the characters: hex, base32, base62 or base64;
* chi-squared uniformity over its alphabet: the statistic is linear in the number of equal
  pairs of characters, whose share is 1 / k if uniform and TEXT_PAIRS in text;
* runs above and below the middle of the alphabet, whose turns text has in TEXT_TURNS of its
  places, and the lag-1 serial correlation;
* "random" has three p-values, of uniformity, runs and correlation, combined as three times
  the least; "text" has two, of few equal pairs and of many turns, combined by Fisher's rule;
* a document's p-values are divided by length (long tokens have the power, so they get the
  greater part of the rate), and the Benjamini-Hochberg rule decides twice: which tokens
  aren't text, at ``rate``, and which of these aren't random either, at ``lost``.  What is no
  text and may be random is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings: name, pattern of the whole token, alphabet in ascending order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+$", "234567" + UPPER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", "+/" + DIGITS + UPPER + LOWER),
    ("base64url", "^[A-Za-z0-9_-]+$", "-" + DIGITS + UPPER + "_" + LOWER),
)
PIECE = r"[A-Za-z0-9+_-]{20,}"
#: Share of equal pairs of characters in text (of an alphabet of k, at least 2 / k), and of
#: places where words in camel case turn from the lower to the upper half of the alphabet.
TEXT_PAIRS, TEXT_TURNS = 0.065, 0.35
SPANS = "array<struct<start:int,end:int,match:string>>"


#: Matches whose places are summed together.
BLOCK = 256


def spans(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array of (start, end, match), in code points, end exclusive.

    A list that grows by one is copied at each step, so places are summed over blocks of
    BLOCK matches, and the blocks' own sums over the blocks: a text with many matches costs
    BLOCK steps a match at most, not as many as it has.
    """
    empty, places = F.array().cast(SPANS), F.array().cast("array<int>")

    def inside(found: Column, between: Column, block: Column) -> Column:
        """(total, out) of a block: its length and its spans, counted from its own start."""

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(between, i))
            match = F.get(found, i)
            end = begin + F.length(match)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), match.alias("match")))).alias("out"))

        own = F.sequence(block * BLOCK, F.least((block + 1) * BLOCK, F.size(found)) - 1)
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def moved(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), places.alias("out"))
        first = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, first, lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["match"].alias("match")))))

    def cut(found: Column) -> Column:
        blocks = lambda between: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: inside(found, between, b))
        return _one(F.split(text, pattern, -1), lambda between: _one(blocks(between), moved))

    # most texts have no match: for them nothing is cut
    return _one(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, cut(found)).otherwise(empty))


def touches(of_kind: Column, s: Column) -> Column:
    """Whether a span overlaps one of ``of_kind``, spans of one kind in order: of those that begin
    before its end the last one reaches furthest, and halving finds it."""

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        before = F.get(of_kind, middle)["start"] < s["end"]
        open_ = at["lo"] < at["hi"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~before, middle).otherwise(at["hi"]).alias("hi"))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(of_kind) + 1)).cast("int"))
    begin = F.struct(F.lit(0).alias("lo"), F.size(of_kind).alias("hi"))
    last = F.aggregate(halvings, begin, step, lambda at: F.get(of_kind, at["lo"] - 1))
    return F.when(F.size(of_kind) > 0, F.coalesce(last["end"] > s["start"], F.lit(False))).otherwise(False)


def upper_tail(z: Column) -> Column:
    """P(N > z) by the five-term polynomial of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(match: Column) -> Column:
    """(n, text, random) of a token: its length and the p-values of being text and of being random."""
    encoding = F.lit(None).cast("string")
    for _, pattern, alphabet in reversed(ENCODINGS):
        encoding = F.when(match.rlike(pattern), F.lit(alphabet)).otherwise(encoding)
    # hex is compared in lower case
    body = F.when(match.rlike(ENCODINGS[0][1]), F.lower(match)).otherwise(match)

    def values(x: Column) -> Column:
        n, k = F.length(x["body"]).cast("double"), F.length(x["alphabet"]).cast("double")
        v = F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c).cast("double") - 1)
        return _one(F.struct(n.alias("n"), k.alias("k"), v.alias("v"), x["body"].alias("body")), counts)

    def counts(r: Column) -> Column:
        squares = F.aggregate(
            F.array_distinct(F.split(r["body"], "")), F.lit(0.0),
            lambda acc, c: acc + F.pow((F.length(r["body"]) - F.length(F.replace(r["body"], c, F.lit("")))).cast("double"), F.lit(2.0)),
        )
        high = F.transform(r["v"], lambda v: v > (r["k"] - 1) / 2)
        turns = F.size(F.filter(F.zip_with(F.slice(high, 2, F.size(high) - 1), F.slice(high, 1, F.size(high) - 1), lambda a, b: a != b), lambda d: d))
        centre = F.aggregate(r["v"], F.lit(0.0), lambda acc, v: acc + v) / r["n"]
        spread = F.aggregate(r["v"], F.lit(0.0), lambda acc, v: acc + (v - centre) * (v - centre))
        lagged = F.aggregate(
            F.zip_with(F.slice(r["v"], 2, F.size(r["v"]) - 1), F.slice(r["v"], 1, F.size(r["v"]) - 1), lambda a, b: (a - centre) * (b - centre)),
            F.lit(0.0), lambda acc, v: acc + v,
        )
        return _one(F.struct(
            r["n"].alias("n"), r["k"].alias("k"), ((squares - r["n"]) / 2).alias("equal"), turns.cast("double").alias("turns"),
            F.size(F.filter(high, lambda h: h)).cast("double").alias("high"), spread.alias("spread"), lagged.alias("lagged"),
        ), p_values)

    def p_values(r: Column) -> Column:
        n, pairs = r["n"], r["n"] * (r["n"] - 1) / 2
        share, even = F.greatest(F.lit(TEXT_PAIRS), 2 / r["k"]), 1 / r["k"]
        few = upper_tail((pairs * share - r["equal"]) / F.sqrt(pairs * share * (1 - share)))
        many = upper_tail((r["turns"] - (n - 1) * TEXT_TURNS) / F.sqrt((n - 1) * TEXT_TURNS * (1 - TEXT_TURNS)))
        uniform = upper_tail((r["equal"] - pairs * even) / F.sqrt(pairs * even * (1 - even)))
        mean = 1 + 2 * (n - r["high"]) * r["high"] / n
        deviation = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0)))
        # all on one side of the middle: half to the power of n - 1
        runs = F.when(deviation > 0, 2 * upper_tail(F.abs((1 + r["turns"] - mean) / deviation))).otherwise(F.pow(F.lit(2.0), 1 - n))
        serial = F.when(r["spread"] > 0, 2 * upper_tail(F.abs(r["lagged"] / r["spread"] * F.sqrt(n)))).otherwise(F.lit(0.0))
        product = F.greatest(few * many, F.lit(1e-300))
        return F.struct(n.alias("n"), (product * (1 - F.ln(product))).alias("text"), F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial)).alias("random"))

    return _one(F.struct(body.alias("body"), encoding.alias("alphabet")), values)


def _one(value: Column, then) -> Column:  # noqa: ANN001
    """``then(value)`` with ``value`` computed once: a one-element transform."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _discovered(all_: Column, name: str, rate: float, then) -> Column:  # noqa: ANN001
    """``then(all_, p, level)``: ``p(c)`` is a candidate's p-value ``name`` by its part of the rate, and
    those up to ``level`` are discoveries by the Benjamini-Hochberg rule."""
    total = F.aggregate(all_, F.lit(0.0), lambda acc, c: acc + c["t"]["n"])

    def weighted(mean: Column) -> Column:
        p = lambda c: c["t"][name] * mean / c["t"]["n"]
        ranked = F.array_sort(F.transform(all_, p))
        places = F.sequence(F.lit(1), F.size(all_))
        level = _one(ranked, lambda r: F.aggregate(places, F.lit(-1.0), lambda acc, i: F.when(F.element_at(r, i) <= rate * i / F.size(r), F.element_at(r, i)).otherwise(acc)))
        return _one(level, lambda at: then(all_, p, at))

    return _one(total / F.size(all_), weighted)


def _random(candidates: Column, rate: float, lost: float) -> Column:
    """The candidates (start, end, match) that are no text and may be random; of nested ones the longest."""
    bare = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"))
    empty = F.array().cast(SPANS)
    tested = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), _battery(c["match"]).alias("t")))

    def left(found: Column) -> Column:
        def outer(some: Column) -> Column:
            # only a run with a slash holds another candidate, a piece of it, and runs don't overlap
            runs = F.filter(some, lambda c: c["match"].contains("/"))
            return _one(runs, lambda over: F.transform(F.filter(some, lambda c: c["match"].contains("/") | ~touches(over, c)), bare))

        keep = _discovered(found, "random", lost, lambda all_, p, at: F.filter(all_, lambda c: p(c) > at))
        return F.when(F.size(found) > 0, _one(keep, outer)).otherwise(empty)

    strange = _one(tested, lambda all_: _discovered(all_, "text", rate, lambda some, p, at: F.filter(some, lambda c: p(c) <= at)))
    return F.when(F.size(candidates) > 0, _one(strange, left)).otherwise(empty)


def _with_spans(docs: DataFrame, text: str, rate: float, lost: float) -> DataFrame:
    """(row, t, found): the input's columns as one struct, so that no name of theirs can clash,
    the text, and its spans (start, kind, end)."""
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    step = step.withColumns({"assign": spans(t, ASSIGN), "access": spans(t, ACCESS), "hex": spans(t, HEX), "token": spans(t, TOKEN)})
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    step = step.withColumn("assign", F.when(F.size("assign") > 0, long_enough).otherwise(F.col("assign")))
    # a run with a slash may be a path: its pieces are candidates too
    both = F.when(F.exists("token", lambda s: s["match"].contains("/")), F.array_distinct(F.concat("token", spans(t, PIECE)))).otherwise(F.col("token"))
    encoded = "|".join(pattern for _, pattern, _ in ENCODINGS)
    fit = F.filter(both, lambda s: s["match"].rlike(encoded) & ~touches(F.col("assign"), s) & ~touches(F.col("access"), s) & ~touches(F.col("hex"), s))
    step = step.withColumn("token", F.when(F.size("token") > 0, fit).otherwise(F.col("token")))
    step = step.withColumn("random", _random(F.col("token"), rate, lost))

    def kind(name: str, at: int) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("kind"), s["end"].alias("end")))

    every = F.concat(*[kind(k, i) for i, k in enumerate(KINDS)])
    # an array of structs sorts by start, then kind
    return step.select("row", "t", F.array_sort(every).alias("found"))


def find(docs: DataFrame, text: str = "text", rate: float = 0.01, lost: float = 0.002) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, kind, end), by start and then kind's place in KINDS.

    Null and empty texts have none; texts of any length are searched whole.  Kinds may overlap
    each other (a token that is assigned and hex is both); random ones overlap no other.
    Repeated rows have the same.  Any columns may be there besides, and keep their values; one
    named ``secrets`` is replaced.  An empty table stays empty.
    """
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "secrets"]
    return _with_spans(docs, text, rate, lost).select(*kept, F.col("found").alias("secrets"))


def _joined(found: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every document.

    One row per input row, repeated rows alike; null and empty texts have none of any kind
    and an empty list.  An empty table gives an empty result; extra columns are ignored.
    """
    found = find(docs.select("doc_id", "text"))

    def count(at: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == at)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(_joined(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.01, lost: float = 0.002) -> DataFrame:
    """The documents with every secret replaced by ``mark``; overlapping ones by a single one.

    ``n_chars``, where there is such a column, becomes the new length of a changed text.  All
    other values stay as they are, whatever the columns' names.  Null and empty texts stay;
    repeated rows change alike; an empty table stays empty.
    """
    t = F.col("t")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("found", begin, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1)))
    hit = F.size("found") > 0
    done = _with_spans(docs, "text", rate, lost).select("row", "found", F.when(hit, clean).otherwise(F.col("row.text")).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
