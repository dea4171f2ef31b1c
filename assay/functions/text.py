"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Fixed value: the characters that ``SPACE`` meets, one by one.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The word for paragraph, and the shape of a citation in text.
PARAGRAPH = "문단"
CITATION = r"([0-9]{3,4})\s*[^0-9\[\]]*?문단\s*([0-9]+[A-Za-z]?)\s*(?:[-–]\s*)?(?:\(([^)]{1,12})\))?"


def collapse(x: Column) -> Column:
    """Runs of white space, of any script, become one space; ends are stripped; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, " "))


def without_space(x: Column) -> Column:
    return bare(F.coalesce(x, F.lit("")))


def bare(x: Column) -> Column:
    """All white space gone, null stays null; plain spaces go first, by a search of bytes, so that the pattern meets few."""
    return F.regexp_replace(F.replace(x, F.lit(" "), F.lit("")), SPACE, "")


def citation(x: Column) -> Column:
    """struct(standard, paragraph, subitem) of the first citation in a text, or null."""
    part = lambda i: F.nullif(F.regexp_extract(x, CITATION, i), F.lit(""))
    return F.when(x.rlike(CITATION), F.struct(part(1).alias("standard"), part(2).alias("paragraph"), part(3).alias("subitem")))


def cited_object(standard: Column, paragraph: Column, subitem: Column) -> Column:
    """struct(standard, paragraph, subitem) of a citation given in parts, or null if either of the first two is blank.

    A paragraph that is as a whole a number with a sub-item in brackets is split; a sub-item
    given by itself comes first.
    """
    whole = r"^([0-9]+[A-Za-z]?)\s*\(([^)]+)\)$"
    blank = lambda x: F.nullif(strip(x), F.lit(""))
    para = strip(paragraph)
    given = F.when(F.coalesce(subitem, F.lit("")) != "", strip(subitem))
    split = para.rlike(whole)
    number = F.when(split, F.regexp_extract(para, whole, 1)).otherwise(para)
    inside = F.when(split, F.regexp_extract(para, whole, 2))
    parts = F.struct(strip(standard).alias("standard"), number.alias("paragraph"), F.coalesce(F.when(split, F.nullif(given, F.lit(""))).otherwise(given), inside).alias("subitem"))
    return F.when(blank(standard).isNotNull() & blank(paragraph).isNotNull(), parts)


def strip(x: Column) -> Column:
    """White space of any script gone from both ends; only they are looked at, where a pattern would try each space of the text."""
    return F.trim(x, F.lit(BLANKS))


def has_subitem(body: Column, sub: Column) -> Column:
    """Whether a body names a sub-item: bare, in brackets, or closed by one; white space is collapsed in both."""
    body, s = collapse(body), collapse(sub)
    bare = F.regexp_replace(s, r"^[()]+|[()]+$", "")
    forms = (s, F.concat(F.lit("("), s, F.lit(")")), F.concat(s, F.lit(")")), F.concat(F.lit("("), bare, F.lit(")")), F.concat(bare, F.lit(")")))
    def named(held: Column) -> Column:
        out = F.lit(False)
        for form in forms:
            out = out | F.contains(held, form)
        return out

    return F.exists(F.array(body), named)  # else each form would collapse the body again


def contains_quote(body: Column, quote: Column) -> Column:
    """Whether a body holds a quote; white space is collapsed in both.

    A collapsed quote has single spaces only, inside it, so a body that holds it as it stands
    holds it collapsed too: only other bodies are collapsed.
    """
    body, q = F.coalesce(body, F.lit("")), collapse(quote)
    return (q != "") & (F.contains(body, q) | F.contains(collapse(body), q))


def unfence(x: Column) -> Column:
    """A leading code fence (with or without json) and a trailing one removed."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def occurrences(x: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def paragraph_number(x: Column) -> Column:
    return F.regexp_extract(x, rf"{PARAGRAPH}\s*([0-9]+[A-Za-z]?)", 1)


def line_of(x: Column, at: Column) -> Column:
    """Line number (from 1) of the character at place ``at`` (from 1)."""
    before = F.substring(x, F.lit(1), at - 1) if not isinstance(at, int) else F.substring(x, 1, at - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


# Phrases in evidence that read as orders, in the order they are replaced; the mark
# put for them; the fences of an evidence block and what stands for a forged one.
ORDERS = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"(?i)disregard\s+(?:all\s+)?(?:previous|prior|above)",
    r"이전\s*지시.{0,10}무시",
    r"위\s*지시.{0,10}무시",
    r"(?i)system\s*:",
    r"(?i)</?(?:system|instruction|prompt)>",
    r"(?i)\bSUPPORTED\b\s*(?:로|으로)?\s*(?:판정|출력|답)",
    r"(?i)always\s+(?:answer|respond|output)\s+SUPPORTED",
    r"```",
)
MARK = "〈무력화된 지시문〉"
FENCES = {"<<<EVIDENCE_BEGIN>>>": "«EVIDENCE_BEGIN»", "<<<EVIDENCE_END>>>": "«EVIDENCE_END»"}
#: Words that negate a tag in the 12 characters after it.
NEGATORS = ("아님", "아니", "해당 없", "해당없", "제외")
#: Words of a rule that picks one, and of one whose parts must all hold.
SELECTION = ("중 이른", "중 늦은", "중 빠른", "둘 중", "중 하나", "중 작은", "중 큰", "중 낮은", "중 높은")
CONJUNCTIVE = ("모두 충족", "모두 해당", "요소로 구성", "항목으로 구성", "모두 확인", "다음을 모두")
#: The narrow lists of the same, for studies that were made with them.
SELECTION_NARROW = ("중 이른 날", "중 이른", "둘 중", "중 빠른", "중 늦은", "중 하나")
CONJUNCTIVE_NARROW = ("모두 충족", "모두 해당", "요소로 구성", "항목으로 구성", "모두 확인")


def without_orders(x: Column) -> Column:
    """A copy of evidence for a prompt: orders and forged fences are replaced."""
    out = F.coalesce(x, F.lit(""))
    for pattern in ORDERS:
        out = F.regexp_replace(out, pattern, MARK)
    for fence, other in FENCES.items():
        out = F.replace(out, F.lit(fence), F.lit(other))
    return out


#: Fixed value: what is shown of a restricted text, around the first 16 digits of its SHA-256.
HIDDEN = ("(비공개 근거 — sha256=", ")")


def redact(x: Column, restricted: Column) -> Column:
    """A restricted text becomes a note with its fingerprint; any other is cleaned for a prompt."""
    note = F.concat(F.lit(HIDDEN[0]), F.substring(F.sha2(F.coalesce(x, F.lit("")), 256), 1, 16), F.lit(HIDDEN[1]))
    return F.when(restricted, note).otherwise(without_orders(x))


def has_tag(note: Column, tag: str, negators: tuple[str, ...] = NEGATORS) -> Column:
    """Whether a tag occurs without a negator wholly inside the 12 characters that follow it."""
    tails = F.slice(F.split(note, rf"\Q{tag}\E", -1), 2, 1_000_000)
    # a tail ends at the next occurrence, so what follows is put together again
    places = F.transform(tails, lambda t, i: F.substring(F.array_join(F.slice(tails, i + 1, 13), tag), 1, 12))
    denied = lambda t: F.exists(F.array(*[F.lit(n) for n in negators]), lambda n: F.contains(t, n))
    return F.coalesce(F.exists(places, lambda t: ~denied(t)), F.lit(False))


def rule_type(evidence: Column, narrow: bool = False) -> Column:
    """SELECTION before CONJUNCTIVE before OTHER, by the wide lists or the narrow ones."""
    names = lambda words: evidence.rlike("|".join(words))
    picks, joins = (SELECTION_NARROW, CONJUNCTIVE_NARROW) if narrow else (SELECTION, CONJUNCTIVE)
    return F.when(names(picks), "SELECTION").when(names(joins), "CONJUNCTIVE").otherwise("OTHER")


def aliased(cite: Column) -> Column:
    """IAS n becomes 1000 + n and IFRS n 1100 + n, but for numbers that have four digits already."""
    shape = r"^\s*(IAS|IFRS)\s*([0-9]+)\s*(.*)$"
    n = F.try_to_number(F.regexp_extract(cite, shape, 2), F.lit("999999999")).cast("long")
    base = F.when(n >= 1000, 0).when(F.regexp_extract(cite, shape, 1) == "IAS", 1000).otherwise(1100)
    return F.when(cite.rlike(shape), F.concat((base + n).cast("string"), F.lit(" "), F.regexp_extract(cite, shape, 3))).otherwise(cite)


# Phrases that abstain.
ABSTAIN = r"확인되지\s*않|근거\s*없|답변\s*불가|판단할\s*수\s*없"


def adapted(cites: Column, standard: Column) -> Column:
    """Citations with aliases resolved and the default standard put before those without one; blank and abstaining ones go."""
    known = F.filter(F.transform(cites, lambda c: aliased(F.trim(c))), lambda c: (F.trim(c) != "") & ~c.rlike(ABSTAIN))
    return F.transform(known, lambda c: F.when(c.rlike(r"^\s*제?\s*[0-9]{4}"), c).otherwise(F.concat(standard, F.lit(" "), c)))


def evidence_paragraphs(x: Column) -> Column:
    """Distinct paragraphs that an evidence text is headed by, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(rf"(?U){PARAGRAPH} (\w+)"), F.lit(1))))


def cited_paragraphs(x: Column) -> Column:
    """Paragraphs that a citation names, without sub-items; else its last number that isn't a four-digit one."""
    bare = F.regexp_replace(x, r"[-–]?\s*\([0-9]+\)", "")
    named = F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"{PARAGRAPH}\s*([0-9]+[A-Za-z]?)"), F.lit(1)))
    numbers = F.filter(F.regexp_extract_all(bare, F.lit(r"\b([0-9]+[A-Za-z]?)\b"), F.lit(1)), lambda n: ~n.rlike("^[0-9]{4}$"))
    return F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(F.try_element_at(numbers, F.lit(-1)))))


def base_citation(x: Column) -> Column:
    """A citation without its sub-items."""
    return F.trim(F.regexp_replace(x, r"\s*\([^)]*\)", ""))


def subitems(x: Column) -> Column:
    """The sub-items of a citation, in order."""
    return F.regexp_extract_all(x, F.lit(r"\(([^)]*)\)"), F.lit(1))


def greedy_object(raw: Column) -> Column:
    """From the first opening to the last closing brace, or null: for output with words around the JSON."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def profile(md: Column) -> Column:
    """struct(levels, rules, links, images) of a Markdown text: levels of headings outside fenced blocks,
    rows that part a table's head, targets of links (linked images too) and of images."""
    def step(held: Column, line: Column) -> Column:
        fence, head = line.rlike(r"^\s*```"), line.rlike(r"^>?\s*#{1,6}\s")
        level = F.length(F.regexp_extract(line, r"^>?\s*(#{1,6})\s", 1))
        inside = F.when(fence, ~held["inside"]).otherwise(held["inside"])
        levels = F.when(head & ~fence & ~held["inside"], F.array_append(held["levels"], level)).otherwise(held["levels"])
        return F.struct(inside.alias("inside"), levels.alias("levels"))

    lines = F.split(md, "\n", -1)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<int>").alias("levels"))
    levels = F.aggregate(lines, start, step, lambda held: held["levels"])
    rules = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^\|[\s:|-]+\|$")))
    found = lambda p: F.regexp_extract_all(md, F.lit(p), F.lit(1))
    return F.struct(levels.alias("levels"), rules.alias("rules"), found(r"(?<!!)\]\(([^)]+)\)").alias("links"), found(r"!\[[^\]]*\]\(([^)]+)\)").alias("images"))


# Words near a number that belong to contacts and imprints.
CONTACT = r"(?i)e-?mail|fax|tel\b|foundation"


def noise(number: Column, context: Column) -> Column:
    """Whether a paragraph number is surely none: above 999, or among contacts.  A lower bound by design."""
    return (F.floor(number) > 999) | F.coalesce(context, F.lit("")).rlike(CONTACT)


def rewritten(x: Column, steps: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(text, missing) after a chain of substitutions (kind regex or text, what, by what).

    ``missing``: the first step whose anchor wasn't there, or null: a document that has drifted
    from its steps is told, not silently left as it was.
    """
    missing = F.lit(None).cast("int")
    for i, (kind, what, put) in enumerate(steps):
        there = x.rlike(what) if kind == "regex" else F.contains(x, F.lit(what))
        missing = F.coalesce(missing, F.when(~there, i))
        x = F.regexp_replace(x, what, put) if kind == "regex" else F.replace(x, F.lit(what), F.lit(put))
    return F.struct(x.alias("text"), missing.alias("missing"))


def number_after(x: Column, anchor: str) -> Column:
    """The decimal number that follows an anchor, or null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(x, rf"\Q{anchor}\E([0-9]+[.][0-9]+)", 1), F.lit("")), F.lit("99999999.99999999")).cast("double")


def iso_time(at: Column, hours: int = 9) -> Column:
    """ISO time to the second at a fixed offset of whole hours."""
    return F.concat(F.date_format(at + F.make_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"{hours:+03d}:00"))
