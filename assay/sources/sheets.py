"""Label sheets in workbook files (XLSX), as rows of cells.

A workbook is a zip of XML parts, which no Spark source reads; each file is opened in one
task, so many files are read side by side.  A sheet's rows stream through the parser.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_binary

CELLS = "path string, row int, cells map<int, string>"
#: The names of a workbook's parts and of their elements' space.
SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
STRINGS, FIRST = "xl/sharedStrings.xml", "xl/worksheets/sheet1.xml"


def column_index(ref: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{SPACE}t"))


def _rows(content: bytes, part: str) -> Iterator[tuple[int, dict[int, str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(x) for x in ElementTree.fromstring(book.read(STRINGS)).iter(f"{SPACE}si")] if STRINGS in book.namelist() else []
        with book.open(part) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{SPACE}row":
                    continue
                cells = {}
                for c in row.iter(f"{SPACE}c"):
                    value = c.find(f"{SPACE}v")
                    if c.get("t") == "inlineStr":
                        cells[column_index(c.get("r"))] = _text(c)
                    elif value is not None:
                        cells[column_index(c.get("r"))] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield int(row.get("r")), cells
                row.clear()


def cells(spark: SparkSession, path: str, part: str = FIRST) -> DataFrame:
    """(path, row from 1, cells by column index from 0) of the workbooks below a path; empty cells are absent."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                found = list(_rows(content, part))
                yield pd.DataFrame({"path": at, "row": [r for r, _ in found], "cells": [c for _, c in found]})

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return books.select("path", "content").mapInPandas(parse, CELLS)


def by_position(rows: DataFrame, **columns: int) -> DataFrame:
    """Rows from the second on, with columns by their place; a cell that isn't there is null."""
    at = [F.try_element_at("cells", F.lit(i)).alias(name) for name, i in columns.items()]
    return rows.filter("row >= 2").select("path", "row", *at)


def by_header(rows: DataFrame, *names: str) -> DataFrame:
    """Rows from the second on, with columns by their name in the first row; an unknown name is null."""
    heads = rows.filter("row = 1").select(F.col("path").alias("_p"), F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(e["value"], e["key"]))).alias("_h"))
    found = rows.filter("row >= 2").join(heads, F.col("path") == F.col("_p"))
    return found.select("path", "row", *[F.try_element_at("cells", F.try_element_at("_h", F.lit(n))).alias(n) for n in names])


def public(rows: DataFrame) -> DataFrame:
    """Columns whose names don't begin with an underscore."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def leaks(names: list[str]) -> list[str]:
    """Names of columns that would tell a labeller the answer."""
    return [n for n in names if n.startswith("_") or any(word in n.lower() for word in ("gold", "judge", "probe"))]


def leaking(rows: DataFrame, also: str) -> DataFrame:
    """(path, row, name, also) of the filled cells whose header would tell the answer, with the row's cell under ``also``."""
    heads = rows.filter("row = 1").select(F.col("path").alias("_p"), F.explode("cells").alias("_i", "name"))
    told = F.startswith("name", F.lit("_")) | F.lower("name").rlike("gold|judge|probe")
    beside = rows.filter("row = 1").select(F.col("path").alias("_q"), F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(e["value"], e["key"]))).alias("_h"))
    body = rows.filter("row >= 2").join(beside, F.col("path") == F.col("_q")).select("path", "row", F.try_element_at("cells", F.try_element_at("_h", F.lit(also))).alias(also), F.explode("cells").alias("_j", "value"))
    return body.join(heads.filter(told), (F.col("path") == F.col("_p")) & (F.col("_j") == F.col("_i"))).select("path", "row", "name", also)


def blind(rows: DataFrame) -> DataFrame:
    """What a labeller may see."""
    hidden = set(leaks(rows.columns))
    return rows.select(*[c for c in rows.columns if c not in hidden])


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


# The parts that make a zip a workbook.
PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="labels" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _book(names: list[str], rows: list[tuple], choices: dict[str, tuple[str, ...]]) -> bytes:
    """A workbook of one sheet: a header, text cells, and lists that columns may be chosen from."""
    def line(r: int, values: tuple) -> str:
        cells = "".join(f'<c r="{_letters(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(values) if v is not None and v != "")
        return f'<row r="{r}">{cells}</row>'

    lists = "".join(
        f'<dataValidation type="list" allowBlank="1" sqref="{_letters(names.index(n))}2:{_letters(names.index(n))}{len(rows) + 1}"><formula1>"{",".join(c)}"</formula1></dataValidation>' for n, c in choices.items()
    )
    body = "".join(line(i, r) for i, r in enumerate([tuple(names), *rows], 1))
    valid = f'<dataValidations count="{len(choices)}">{lists}</dataValidations>' if choices else ""
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{SPACE[1:-1]}"><sheetData>{body}</sheetData>{valid}</worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, part in PARTS.items():
            book.writestr(name, part)
        book.writestr(FIRST, sheet)
    return out.getvalue()


def write(rows: DataFrame, path: str, choices: dict[str, tuple[str, ...]] | None = None, size: int = 5000) -> None:
    """Rows as workbooks of ``size`` rows at most below ``path``, which every executor must reach.

    A workbook is named by its partition and number, so a task that runs again writes the same.
    """
    names = rows.columns
    parts = rows.select(F.spark_partition_id().alias("_part"), F.struct(*names).alias("r"))

    def books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        part = number = 0

        def one() -> pd.DataFrame:
            return pd.DataFrame({"name": [f"{part:05d}-{number:05d}"], "content": [_book(names, held, choices or {})]})

        for batch in batches:
            for part, r in zip(batch["_part"], batch["r"], strict=True):
                held.append(tuple(r[n] for n in names))
                if len(held) == size:
                    yield one()
                    held, number = [], number + 1
        if held:
            yield one()

    write_binary(parts.mapInPandas(books, "name string, content binary"), path, ".xlsx")


def choices(spark: SparkSession, path: str) -> DataFrame:
    """(path, allowed) of workbooks: the values that a column may be chosen from, comma-joined."""
    def listed(content: pd.Series) -> pd.Series:
        out = []
        for one in content:
            with zipfile.ZipFile(io.BytesIO(one)) as book:
                found = re.search('<formula1>"([^"]*)"</formula1>', book.read(FIRST).decode("utf-8"))
            out.append(found.group(1) if found else None)
        return pd.Series(out, dtype=object)

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return books.select("path", F.pandas_udf(listed, "string")("content").alias("allowed"))
