"""Spreadsheets: a Python data source named xlsx over the zipped first sheet of each file."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kinfold.sources.paths import listed, open_path

SCHEMA = "file string, row int, cells array<string>"
#: Rows that a sheet can hold.
MOST_ROWS = 1 << 20

# The parts of a file that others expect.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PARTS = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _text(node) -> str:
    """The text of a string item: its own runs, without phonetic hints."""
    return "".join(t.text or "" for run in (node, *node.findall(f"{{{_MAIN}}}r")) for t in run.findall(f"{{{_MAIN}}}t"))


def _items(raw, tag: str) -> Iterator:
    """The elements of a tag one after the other; each is forgotten once it was used."""
    for _, node in ElementTree.iterparse(raw):
        if node.tag == f"{{{_MAIN}}}{tag}":
            yield node
            node.clear()


def first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the first sheet of a workbook."""
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{{{_MAIN}}}sheets/{{{_MAIN}}}sheet")
    wanted = sheet.get(f"{{{_RELATIONS}}}id")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("the workbook has no sheet")


def column_number(reference: str) -> int:
    """From 0, of a cell's name such as AB12."""
    n = 0
    for x in re.match("[A-Z]*", reference).group():
        n = 26 * n + ord(x) - 64
    return n - 1


def cell_value(cell, strings: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{{{_MAIN}}}v")
    if kind == "inlineStr":
        inline = cell.find(f"{{{_MAIN}}}is")
        return None if inline is None else _text(inline)
    if value is None or value.text is None:
        return None
    return strings[int(value.text)] if kind == "s" else value.text


def sheet_rows(raw) -> Iterator[tuple[int, list[str | None]]]:
    """Number from 0 and cells of each row of the first sheet that has any; gaps between cells are null."""
    with zipfile.ZipFile(raw) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                strings = [_text(x) for x in _items(part, "si")]
        with book.open(first_sheet(book)) as part:
            at = -1
            for row in _items(part, "row"):
                at = int(row.get("r")) - 1 if row.get("r") else at + 1
                cells: list[str | None] = []
                for cell in row.findall(f"{{{_MAIN}}}c"):
                    place = column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place - len(cells))
                    cells.append(cell_value(cell, strings))
                if cells:
                    yield at, cells


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool | int | float):
        return f"<c><v>{float(value)!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


class SheetSource(DataSource):
    """format("xlsx"): reads a row for each row of every file's first sheet; writes one file for each task.

    A file is one task's work, for its strings stand apart from its cells; a sheet holds MOST_ROWS at most.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(x.path) for x in listed(self.path)] or [InputPartition("")]

    def read(self, partition):
        if partition.value:
            system, _ = open_path(self.path)
            with system.open_input_file(partition.value) as raw:
                for at, cells in sheet_rows(raw):
                    yield partition.value.rsplit("/", 1)[-1], at, cells


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Tasks write hidden files; commit gives them their names, abort deletes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        system, root = open_path(self.path)
        name, held = f"part-{uuid.uuid4().hex}.xlsx", io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in _PARTS.items():
                book.writestr(part, text)
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for n, row in enumerate(iterator):
                    if n == MOST_ROWS:
                        raise ValueError("a sheet can't hold so many rows; repartition them")
                    sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                sheet.write(b"</sheetData></worksheet>")
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/.{self.job}-{name}") as out:
            out.write(held.getbuffer())
        return _Written(name)

    def commit(self, messages):
        system, root = open_path(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if x.type == fs.FileType.File and not x.base_name.startswith(f".{self.job}"):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None:
                system.move(f"{root}/.{self.job}-{m.name}", f"{root}/{m.name}")

    def abort(self, messages):
        system, root = open_path(self.path)
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f".{self.job}"):
                system.delete_file(x.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
