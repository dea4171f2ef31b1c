"""Batches of whole texts become Python objects a few megabytes at a time."""

import pyarrow as pa

from assay.llm import common, quality


def test_slices_hold_every_row_once_and_few_bytes():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": ["word " * 400 + str(i) for i in range(10_000)]})
    got = list(common.slices(iter([batch, batch.slice(0, 0)])))
    assert sum((x["doc_id"].to_pylist() for x in got), []) == list(range(10_000))
    assert max(x.nbytes for x in got) <= common.FRAME * 1.1 and len(got) >= 5
    long = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["x" * (2 * common.FRAME), "y"]})
    assert [x.num_rows for x in common.slices(iter([long]))] == [1, 1]


def test_quality_sorts_few_words_at_a_time(monkeypatch):
    sizes, measure = [], quality._measure
    monkeypatch.setattr(quality, "_measure", lambda ids, texts, lists, rules: sizes.append(sum(map(len, lists))) or measure(ids, texts, lists, rules))

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})
    out = list(quality.keep_good(Docs())(iter([batch])))
    assert sum(x.num_rows for x in out) == 1000 and sum(sizes) == 300_000
    assert max(sizes) <= (1 << 16) + 300
