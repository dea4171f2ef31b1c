import zipfile

from assay.sources import sheets

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="G1" t="inlineStr"><is><t>human_label</t></is></c></row>
<row r="2"><c r="A2" t="inlineStr"><is><t>Q1-A-c1</t></is></c><c r="G2" t="s"><v>1</v></c><c r="AA2"><v>7</v></c></row>
<row r="4"><c r="A4" t="inlineStr"><is><t>Q2-A-c1</t></is></c></row></sheetData></worksheet>"""
STRINGS = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><r><t>S</t></r><r><t>!</t></r></si></sst>'


def test_sheets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "labels.xlsx", "w") as book:
        book.writestr(sheets.FIRST, SHEET)
        book.writestr(sheets.STRINGS, STRINGS)
    cells = sheets.cells(spark, str(tmp_path))
    placed = sheets.by_position(cells, id=0, human=6, n=26).drop("path").collect()
    assert sorted(map(tuple, placed)) == [(2, "Q1-A-c1", "S!", "7"), (4, "Q2-A-c1", None, None)]
    named = sheets.by_header(cells, "id", "human_label", "memo").drop("path").collect()
    assert sorted(map(tuple, named)) == [(2, "Q1-A-c1", "S!", None), (4, "Q2-A-c1", None, None)]
    assert [sheets.column_index(x) for x in ("A1", "Z9", "AA1", "BA3")] == [0, 25, 26, 52]
