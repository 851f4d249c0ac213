"""Spreadsheets: a reader for mapping files and workbooks of merged conversations."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: The parts of a workbook with one sheet, and the rows that a sheet can hold.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET_ROWS = 1_048_576
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{RELATIONS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{RELATIONS}"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def write_sheet(names: list[str], rows: Iterable[tuple]) -> bytes:
    """A workbook with one sheet of texts. Nulls are empty cells; characters outside ASCII and
    control characters are written as backslash escapes."""
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in PARTS.items():
            z.writestr(name, body)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for row in [tuple(names), *rows]:
                cells = ["<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v).encode("unicode_escape").decode())}</t></is></c>' for v in row]
                sheet.write(f"<row>{''.join(cells)}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
    return file.getvalue()


def read_sheet(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet, row by row; empty cells are None."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(e) == "si"]
        sheets = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
        first = min(sheets, key=lambda n: (len(n), n))
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(first)).iter() if tag(e) == "row"):
            cells: list[str | None] = []
            for c in (e for e in row if tag(e) == "c"):
                at = len(cells)
                if letters := re.match(r"[A-Z]+", c.get("r", "")):
                    at = 0
                    for letter in letters[0]:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                value = next((v.text for v in c if tag(v) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = text(c)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value
            rows.append(cells)
    return rows


def manual_names(spark: SparkSession, path: str) -> DataFrame:
    """name_from, name_to of a mapping file with the columns Name_from and Name_to, the last row of
    a name winning; no rows where the file is missing. The file is written by hand and read whole."""
    try:
        content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    except AnalysisException:
        return spark.createDataFrame([], "name_from string, name_to string")
    head, *rows = read_sheet(bytes(content)) or [[]]
    at = head.index("Name_from"), head.index("Name_to")
    cell = lambda row, i: row[i] if i < len(row) else None
    names = {cell(r, at[0]): cell(r, at[1]) for r in rows if cell(r, at[0])}
    return spark.createDataFrame(list(names.items()), "name_from string, name_to string")


def workbooks(merged: DataFrame, names: list[str], conversation: str = "conversation_id", position: str = "position", rows: int = 100_000) -> DataFrame:
    """conversation_id (as text), part, content: every conversation as workbooks of at most ``rows`` rows.

    A task holds the rows of one part at a time, so a conversation may have any length.
    """
    size = min(rows, SHEET_ROWS - 1)
    source = merged.select(merged[conversation].cast("string").alias("_conversation"), merged[position].alias("_position"), *[merged[n].cast("string").alias(f"_{i}") for i, n in enumerate(names)])
    source = source.repartition("_conversation").sortWithinPartitions("_conversation", "_position")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, held = None, 0, []
        done = lambda: pd.DataFrame([(key, part, write_sheet(names, held))], columns=["conversation_id", "part", "content"])
        for pdf in batches:
            for conversation, _, *row in pdf.itertuples(index=False, name=None):
                if held and (conversation != key or len(held) == size):
                    yield done()
                    part = part + 1 if conversation == key else 0
                    held = []
                key = conversation
                held.append(tuple(None if pd.isna(v) else v for v in row))
        if held:
            yield done()

    return source.mapInPandas(run, "conversation_id string, part int, content binary")
