"""Workbooks written and read again, and one that another program could have written."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from cartulary.sources import workbook

TEXTS = ["plain", "", " kept ", "a<b>&\"c'", "Gálvez 𝄞", "two\nlines\tand\r\x01", "_x0041_", None]
SCHEMA = "kind string, n long, text string, x double, day date, at timestamp, ok boolean"


def test_round_trip_of_three_sheets(spark, tmp_path):
    rows = [(("red", "green/1", None)[i % 3], i * 10**14, TEXTS[i % 8], i / 7, dt.date(2000, 1, 1) + dt.timedelta(i), dt.datetime(2020, 2, 29, 13, 5, i), i % 2 == 0) for i in range(48)]
    path = f"{tmp_path}/books"
    workbook.write_workbooks(spark.createDataFrame(rows, SCHEMA), path, kind="kind", workbooks=2, rows_per_sheet=5)
    got = workbook.workbook_rows(spark, path)
    assert {r.cells[0] for r in got.where("row = 1").collect()} == {"n"} and got.select("file").distinct().count() == 2
    back = {tuple(r.cells) for r in got.where("row > 1").collect()}
    want = {(str(n), t, None if x is None else repr(x), d.isoformat(), a.isoformat(" "), str(ok).lower()) for _, n, t, x, d, a, ok in rows}
    assert {(int(float(c[0])), c[1], float(c[2]), *c[3:]) for c in back} == {(int(float(c[0])), c[1], float(c[2]), *c[3:]) for c in want}
    names = {r.sheet for r in got.collect()}
    assert {"red", "red (2)", "green_1", "None"} <= names
    assert got.where("row > 1").groupBy("file", "sheet").count().agg(F.max("count")).first()[0] == 5
    workbook.write_workbooks(spark.createDataFrame(rows[:3], SCHEMA), path, workbooks=1)  # replaces all that was there
    assert {r.n: r.kind for r in workbook.read_table(spark, path).collect()} == {"0": "red", "100000000000000": "green/1", "200000000000000": None}
    workbook.write_workbooks(spark.createDataFrame([], SCHEMA), path)
    assert workbook.workbook_rows(spark, path).count() == 0
    with pytest.raises(ValueError, match="no such sheet"):
        workbook.read_table(spark, path)
    assert sorted(p.name for p in (tmp_path / "books").iterdir()) == []


def foreign(path, cells, shared=(), styles="", date1904=False):
    """A workbook of two sheets, made by hand: shared strings, gaps, styles."""
    main, office = workbook.MAIN[1:-1], workbook.LINK[1:-3]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="People" sheetId="7" r:id="a"/><sheet name="Rest" sheetId="8" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="b" Target="worksheets/x.xml"/><Relationship Id="a" Target="/xl/worksheets/y.xml"/></Relationships>')
        z.writestr("xl/worksheets/x.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/y.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{s}</si>" for s in shared)}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')


def test_a_sheet_of_another_program(spark, tmp_path):
    heads = "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABD"))
    one = '<c r="A2"><v>1234567</v></c><c r="B2" t="s"><v>3</v></c><c r="D2" s="1"><v>36526</v></c>'
    two = '<c r="A5" t="str"><v> 7654321 </v></c><c r="D5" s="2"><v>1.5</v></c>'
    bad = '<c r="A6"><v>12</v></c>'
    shared = ["<t>Cédula</t>", "<r><t>Nom</t></r><r><t>bres</t></r><rPh><t>no</t></rPh>", "<t>Fecha Nacimiento</t>", "<t>ana</t>"]
    styles = '<numFmts><numFmt numFmtId="170" formatCode="0&quot;days&quot;"/><numFmt numFmtId="171" formatCode="dd\\-mm"/></numFmts><cellXfs><xf numFmtId="170"/><xf numFmtId="14"/><xf numFmtId="171"/></cellXfs>'
    foreign(tmp_path / "a.xlsx", f'<row r="1">{heads}</row><row r="2">{one}</row><row r="5">{two}</row><row r="6">{bad}</row>', shared, styles)
    got = sorted(workbook.read_sheet(spark, str(tmp_path)).collect())
    assert [r.asDict() for r in got] == [{"id_number": "1234567", "given_names": "ANA", "birth_date": "2000-01-01"}, {"id_number": "7654321", "given_names": got[1].given_names, "birth_date": "1899-12-31 12:00:00"}]
    with pytest.raises(ValueError, match="no such sheet"):
        workbook.read_table(spark, str(tmp_path), "Rest")
    foreign(tmp_path / "b.xlsx", '<row><c t="inlineStr"><is><t>cc</t></is></c></row>', date1904=True)
    with pytest.raises(ValueError, match="differ"):
        workbook.read_table(spark, str(tmp_path))


def test_failed_tasks_leave_nothing(spark, tmp_path):
    long = spark.range(3).select("id", F.expr("if(id = 2, repeat('x', 40000), 'y')").alias("text"))
    with pytest.raises(Exception, match="does not fit a cell"):
        workbook.write_workbooks(long, f"{tmp_path}/books", workbooks=3)
    assert not list(tmp_path.rglob("*.xlsx")) and not list(tmp_path.rglob("_unfinished*"))
