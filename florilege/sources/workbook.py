"""Workbooks (.xlsx) with the standard library: sheets of cells, read by tasks and written from small tables."""

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

#: Fixed values of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="r{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _column(reference: str) -> int:
    """The place of a cell's column, from 0: A, B ... Z, AA ..."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _name(place: int) -> str:
    letters = ""
    while place >= 0:
        letters, place = chr(65 + place % 26) + letters, place // 26 - 1
    return letters


def _said(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheets_of(content: bytes, wanted: tuple[str, ...] = ()) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells as text) of a workbook, sheets in its order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_said(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            if wanted and sheet.get("name") not in wanted:
                continue
            target = targets[sheet.get(_ID)]
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                nr = 0
                for _, row in ElementTree.iterparse(part):
                    if row.tag != f"{_MAIN}row":
                        continue
                    nr = int(row.get("r") or nr + 1)
                    cells: list[str | None] = []
                    for c in row.iter(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value = c.find(f"{_MAIN}v")
                        if c.get("t") == "inlineStr":
                            cells[at] = _said(c)
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                    yield sheet.get("name"), nr, cells
                    row.clear()


def read(spark: SparkSession, path: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """(path, sheet, row, cells): the rows of workbooks that hold anything, as text, a workbook per task."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                held: list[tuple] = []
                for sheet, nr, cells in sheets_of(bytes(content), wanted):
                    if any(c is not None for c in cells):
                        held.append((name, sheet, nr, cells))
                    if len(held) >= 5000:
                        yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, sheet string, row long, cells array<string>")


def table_of(cells: DataFrame, sheet: str) -> DataFrame:
    """A sheet of read() as a table: its first row names the columns (Col1, Col2 ... where a name is blank), all text."""
    own = cells.where(F.col("sheet") == sheet)
    head = own.orderBy("path", "row").select("path", "row", "cells").first()
    if head is None:
        raise ValueError(f"no sheet {sheet}, or an empty one")
    names = [c.strip() if c and c.strip() else f"Col{k + 1}" for k, c in enumerate(head["cells"])]
    body = own.where((F.col("path") == head["path"]) & (F.col("row") > head["row"]))
    return body.select(*[F.get("cells", k).alias(n) for k, n in enumerate(names)])


def _sheet_xml(df: DataFrame, rows: int) -> str:
    out = [f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>']
    for nr, row in enumerate([df.columns, *df.limit(rows).toLocalIterator()], 1):
        cells = [f'<c r="{_name(k)}{nr}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub(" ", str(v)))}</t></is></c>' for k, v in enumerate(row) if v is not None]
        out.append(f'<row r="{nr}">{"".join(cells)}</row>')
    return "".join([*out, "</sheetData></worksheet>"])


def write(spark: SparkSession, tables: dict[str, DataFrame], path: str, rows: int = 10_000) -> None:
    """A workbook with a sheet per table, each with its first `rows` rows in the order that the table has."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(tables, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_ID[1:-3]}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", _RELS.format("".join(_REL.format(k, "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(tables) + 1))))
        for k, df in enumerate(tables.values(), 1):
            book.writestr(f"xl/worksheets/sheet{k}.xml", _sheet_xml(df, rows))
    _put(spark, path, buffer.getvalue())


def replace(spark: SparkSession, path: str, tables: dict[str, DataFrame], rows: int = 10_000) -> None:
    """Put sheets into a workbook that is there: those of the same name are replaced, others added at its end; all else stays."""
    content = spark.read.format("binaryFile").load(path).first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
        parts = {name: book.read(name) for name in book.namelist()}
    listed, related = parts["xl/workbook.xml"].decode(), parts["xl/_rels/workbook.xml.rels"].decode()
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(related)}
    sheets = {s.get("name"): targets[s.get(_ID)] for s in ElementTree.fromstring(listed).iter(f"{_MAIN}sheet")}
    used = [int(s.get("sheetId")) for s in ElementTree.fromstring(listed).iter(f"{_MAIN}sheet")]
    for name, df in tables.items():
        if name not in sheets:
            number = 1 + max([0, *used])
            used.append(number)
            sheets[name] = f"worksheets/added{number}.xml"
            listed = listed.replace("</sheets>", f'<sheet xmlns:a="{_ID[1:-3]}" name="{escape(name, {chr(34): "&quot;"})}" sheetId="{number}" a:id="added{number}"/></sheets>')
            related = related.replace("</Relationships>", _REL.format(number, "worksheet", sheets[name]).replace(f'"r{number}"', f'"added{number}"') + "</Relationships>")
            kinds = parts["[Content_Types].xml"].decode()
            parts["[Content_Types].xml"] = kinds.replace("</Types>", f'<Override PartName="/xl/{sheets[name]}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>').encode()
        target = sheets[name]
        parts[target.lstrip("/") if target.startswith("/") else f"xl/{target}"] = _sheet_xml(df, rows).encode()
    parts["xl/workbook.xml"], parts["xl/_rels/workbook.xml.rels"] = listed.encode(), related.encode()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, part in parts.items():
            book.writestr(name, part)
    _put(spark, path, buffer.getvalue())


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
