"""Spreadsheets as other programs write them, and as this library does."""

import zipfile

import pytest

from kinfold.sources import parameters, sheets


def test_cells_of_other_writers(spark, tmp_path):
    """Shared strings with runs and phonetic hints, gaps, rows that are missing, a sheet of another name."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="x" sheetId="3" r:id="r7"/><sheet name="y" sheetId="4" r:id="r8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r8" Target="worksheets/b.xml"/><Relationship Id="r7" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>one &amp; two</t></si><si><r><t>ru</t></r><r><t>ns</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>0.5</v></c></row><row r="3"/><row r="5"><c r="B5" t="s"><v>1</v></c><c r="AB5" t="str"><f>x</f><v>y</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    sheets.register(spark)
    rows = sorted(map(tuple, spark.read.format("xlsx").load(str(tmp_path)).collect()))
    assert rows == [("a.xlsx", 1, ["one & two", None, "0.5"]), ("a.xlsx", 4, [None, "runs", *[None] * 25, "y"])]
    assert sheets.column_number("A1") == 0 and sheets.column_number("Z9") == 25 and sheets.column_number("AA1") == 26


@pytest.mark.parametrize("kind", ["xlsx", "csv"])
def test_round_trip(spark, tmp_path, kind):
    given = [("b", 0.25, None if kind == "xlsx" else 1.5), ("a", 1e-9, 2.0)] + ([("<&> é ", None, 3.0)] if kind == "xlsx" else [])
    table = spark.createDataFrame(given, "family string, tc double, sp double")
    for _ in range(2):  # the second time over the first
        parameters.write_sheet(table.repartition(3), str(tmp_path / "out"), kind)
    found = sorted(map(tuple, parameters.read_sheet(spark, str(tmp_path / "out"), kind).collect()), key=lambda r: r[3])
    assert [r[:3] for r in found] == sorted(given, key=lambda r: r[0]) and [r[3] for r in found] == list(range(len(given)))
