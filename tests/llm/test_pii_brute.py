"""PII: detection against plain matching; distinctness, coreference and form of the surrogates."""

import re

import regex

from assay.llm import pii

TEXTS = [
    "Mr. Smith (bob@example.com, +1 162-555-6820) met Mrs. Smith; MR. is no name, Mr SMITH is.",
    "Contact BOB@EXAMPLE.COM or bob@example.com; IP 10.1.2.3 and 8.8.8.8; SSN 123-45-6789; card 4111 1111 1111 1111.",
    "господин Иванов и госпожа Иванова, κύριος Παπάς, մուտք պարոն Սարգսյան, ბატონი გელაშვილი, מר כהן, السيد حسن, श्री शर्मा",
    "Call (555) 123-4567, 555-123-4567 or +1 (162) 555-6820. Herr Müller-Lüdenscheidt und Frau Dr. Weber Klein.",
    "nothing here", "", None, "card 4111-1111-1111-1112 and 5500 0000 0000 0004, ssn 987-65-4321 987-65-4321",
]
SCRIPTS = ("Cyrillic", "Greek", "Armenian", "Georgian", "Hebrew", "Arabic", "Devanagari")


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(pii.TYPES):
        found += [(m.start(), order, m.end(), kind, m.group()) for m in regex.finditer(pattern.replace("(?U)", ""), text or "")]
    return sorted(f for f in found if not any(o[1] < f[1] and o[0] < f[2] and f[0] < o[2] for o in found))


def digits(x):
    return re.sub("[^0-9]", "", x)


def test_surrogates(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = {r["doc_id"]: [(e["start"], e["end"], e["kind"], e["match"], e["form"]) for e in r["entities"]] for r in pii.detect(docs).collect()}
    assert {i: [f[:4] for f in v] for i, v in found.items()} == {i: [(a, b, k, m) for a, _, b, k, m in brute(t)] for i, t in enumerate(TEXTS)}
    out = {r["doc_id"]: r["text"] for r in pii.replace(docs).collect()}
    own = {}
    for i, text in enumerate(TEXTS):
        if not found[i]:
            assert out[i] == text
            continue
        at, pattern = 0, ""
        for a, b, *_ in found[i]:
            pattern += re.escape(text[at:a]) + "(.+?)"
            at = b
        got = re.fullmatch(pattern + re.escape(text[at:]), out[i], re.S)
        assert got, out[i]
        for (_, _, kind, match, form), new in zip(found[i], got.groups(), strict=True):
            assert new != match
            if kind in ("ssn", "card"):
                assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", match)
            if kind == "phone":
                assert re.sub("[0-9]", "0", new).startswith(re.sub("[0-9]", "0", match))
            if kind == "name":
                title, old = re.match(r"((?:\S+\.? )+?)(.*)$", match).groups()
                assert new.startswith(title)
                for script in SCRIPTS:
                    assert bool(regex.search(rf"\p{{{script}}}", old)) == bool(regex.search(rf"\p{{{script}}}", new[len(title):])), (match, new)
            same = digits(new) if kind in ("phone", "ssn", "card") else new.lower() if kind != "name" else new.lower().split(" ", 1)[-1]
            assert own.setdefault((kind, form), same) == same  # coreference
    assert len(set(own.values())) == len(own)  # distinctness
    real = {f[4] for v in found.values() for f in v}
    assert not real & set(own.values())


def test_five_thousand_names_settle(spark):
    names = spark.range(5000).selectExpr("'name' as kind", "concat('m|latin|n', id) as form")
    own = pii.retries(names, "k", rounds=12)  # within a few rounds
    got = {r["form"]: r["own"] for r in own.collect()}
    assert len(set(got.values())) == len(got)
