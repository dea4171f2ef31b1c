"""PII: surrogates for more entities than the first attempts have room for, phones without +, more titles."""

from assay.llm import pii


def test_room_for_many(spark):
    names = [("name", f"m|latin|n{i}") for i in range(5000)]
    own = {r["form"]: r["own"] for r in pii.retries(spark.createDataFrame(names, "kind string, form string"), "k").collect()}
    assert own and len(set(own.values())) == len(own) and not set(own.values()) & {f for _, f in names}


def test_national_phones_and_titles(spark):
    texts = ["Call (555) 123-4567 or 555-123-4567 now", "Prof. Dr. Miller met Dr Jones, Frau Dr. Weber", "In 1999-2004 and 12.10.2020, 123-45-6789 1234"]
    got = [r["text"] for r in pii.replace(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert "123-4567" not in got[0]
    a, b = got[0].removeprefix("Call ").removesuffix(" now").split(" or ")
    assert [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()] and a[0] == "(" and a[4:6] == ") "
    assert not any(n in got[1] for n in ("Miller", "Jones", "Weber")) and got[1].startswith("Prof. Dr. ") and ", Frau Dr. " in got[1]
    assert got[2].startswith("In 1999-2004 and 12.10.2020, 9")
