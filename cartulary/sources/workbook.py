"""Workbooks (.xlsx): their cells as rows, and tables as workbooks of a sheet a kind.

Files are read by Spark's own binary source, so any store that Spark reads will do; a task reads one workbook at a
time and gives its rows as it goes. They are written by a data source with a commit: a task writes its workbook under a name
of its own, and only the workbooks of tasks that counted get their final names.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cartulary.sources.tabular import ALIASES, clean_sheet, rename_headers

CELLS = "file string, place int, sheet string, row int, cells array<string>"
#: Rows that a task gives at once.
BATCH = 10_000
#: The format's names of parts, its limits, and its numbers of built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS, MOST_TEXT, MOST_NAME = 1_048_576, 32_767, 31
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
#: Whole numbers from here on are written as text, as spreadsheets keep 15 digits.
EXACT = 10**15
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\r\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    runs = [node, *node.findall(f"{MAIN}r")]
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for run in runs for t in run.findall(f"{MAIN}t")))


def _column(reference: str) -> int:
    """The place of a cell's column, from 0: A1 is 0, AA1 is 26."""
    n = 0
    for letter in reference.rstrip("0123456789"):
        n = n * 26 + ord(letter) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Styles of cells whose numbers are dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)  # noqa: E731  quoted text, colours and escaped letters are no date
    own = {int(n.get("numFmtId")) for n in root.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", plain(n.get("formatCode", "")), re.IGNORECASE)}
    styles = root.find(f"{MAIN}cellXfs")
    return {i for i, s in enumerate(styles if styles is not None else ()) if int(s.get("numFmtId", 0)) in DATE_FORMATS | own}


def _value(cell: ElementTree.Element, strings: list[str], dates: set[int], start: dt.datetime) -> str | None:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        held = cell.find(f"{MAIN}is")
        return None if held is None else _text(held)
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = start + dt.timedelta(microseconds=round(float(raw) * 86_400_000_000))
        return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(" ")
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), raw) if kind == "str" else raw


def _sheet_rows(book: zipfile.ZipFile, heads: bool) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """(place, sheet, row, cells) of all rows with cells; only the first row of each sheet, if heads."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    properties = root.find(f"{MAIN}workbookPr")
    late = properties is not None and properties.get("date1904") in ("1", "true")
    start = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    strings: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{MAIN}si":
                    strings.append(_text(node))
                    node.clear()
    dates = _date_styles(book)
    for place, sheet in enumerate(root.iter(f"{MAIN}sheet"), 1):
        target = parts[sheet.get(LINK)]
        last = 0
        with book.open(target[1:] if target.startswith("/") else f"xl/{target}") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                last = int(node.get("r", last + 1))
                cells: list[str | None] = []
                for cell in node.findall(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = _value(cell, strings, dates, start)
                node.clear()
                if cells:
                    yield place, sheet.get("name"), last, cells
                if heads:
                    break


def workbook_rows(spark: SparkSession, path: str, heads: bool = False) -> DataFrame:
    """(file, place, sheet, row, cells): the rows of all sheets of the workbooks at path, cells as text.

    Dates are ISO, with a time of day if they have one; booleans true and false; a cell without a value is null, and
    so are cells left out between others. Rows without cells are left out. heads: the first row of each sheet only.
    A workbook is read by one task; the format bounds a sheet to 1,048,576 rows, Spark's binary source a file to 2 GB.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    for row in _sheet_rows(book, heads):
                        held.append((file, *row))
                        if len(held) == BATCH:
                            yield pd.DataFrame(held, columns=["file", "place", "sheet", "row", "cells"])
                            held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "place", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(read, CELLS)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of the workbooks at path as a table of text: columns by the first row; the first sheet, if none is named.

    Columns without a header are left out. Workbooks whose headers differ, or none with such a sheet, are an error.
    """
    wanted = F.col("place") == 1 if sheet is None else F.col("sheet") == sheet
    heads = workbook_rows(spark, path, heads=True).where(wanted).select("cells").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError("the workbooks' headers differ" if heads else "no such sheet with a header")
    rows = workbook_rows(spark, path).where(wanted & (F.col("row") > 1))
    return rows.select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(heads[0].cells) if name])


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, aliases: Mapping[str, str] = ALIASES, required: Sequence[str] = ("id_number",)) -> DataFrame:
    """A sheet of records out of workbooks, cleaned: canonical headers, valid ids only, text columns in upper case."""
    return clean_sheet(rename_headers(read_table(spark, path, sheet), aliases, required))


def _written(text: str) -> str:
    return escape(UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _cell(value: object) -> str:
    """A cell's XML; nothing for null. Texts are cut by no one: one beyond the format's limit is an error."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.date):
        moment = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        passed = moment.replace(tzinfo=None) - dt.datetime(1899, 12, 30)
        if moment.year >= 1901:  # earlier days have no number that all spreadsheets agree on
            return f'<c s="{2 if isinstance(value, dt.datetime) else 1}"><v>{passed.days + (passed.seconds + passed.microseconds / 1e6) / 86400!r}</v></c>'
        value = value.isoformat()
    if isinstance(value, float) and value == value and abs(value) != float("inf") or isinstance(value, int) and abs(value) < EXACT:
        return f"<c><v>{value!r}</v></c>"
    text = str(value)
    if len(text.encode("utf-16-le")) // 2 > MOST_TEXT:
        raise ValueError(f"a text of {len(text)} characters does not fit a cell")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_written(text)}</t></is></c>'


def _name(kind: str, used: set[str]) -> str:
    """A sheet's name: allowed characters, at most 31, unlike those before it in any case."""
    nth = 1
    base = re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", kind).strip("'") or "_"
    while True:
        mark = f" ({nth})" if nth > 1 else ""
        name = base[: MOST_NAME - len(mark)] + mark
        if name.lower() not in used:
            used.add(name.lower())
            return name
        nth += 1


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the file under its own name, or none without rows, and its place."""

    file: str | None
    place: int


class WorkbookWriter(DataSourceWriter):
    """Each partition a workbook; rows that follow one another with one kind make a sheet."""

    def __init__(self, options: Mapping[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind"), overwrite
        self.most = int(options.get("rowspersheet", MOST_ROWS - 1))
        self.columns = [f.name for f in schema if f.name != self.kind]
        self.own = f"_unfinished-{uuid.uuid4().hex}"

    def _store(self) -> tuple[stores.FileSystem, str]:
        local = re.sub("^file:(//)?", "", self.path)
        return stores.FileSystem.from_uri(self.path) if "://" in local else (stores.LocalFileSystem(), local)

    def write(self, iterator: Iterator[Row]) -> Written:
        place = TaskContext.get().partitionId()
        first = next(iterator, None)
        if first is None:
            return Written(None, place)
        store, root = self._store()
        store.create_dir(f"{root}/{self.own}", recursive=True)
        file = f"{root}/{self.own}/{uuid.uuid4().hex}"
        with store.open_output_stream(file) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            names: list[str] = []
            used: set[str] = set()
            row: Row | None = first
            while row is not None:
                kind, count = (row[self.kind] if self.kind else "Sheet1"), 0
                names.append(_name(str(kind), used))
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData><row>{"".join(map(_cell, self.columns))}</row>'.encode())
                    while row is not None and count < self.most and (not self.kind or row[self.kind] == kind):
                        sheet.write(f"<row>{''.join(_cell(row[c]) for c in self.columns)}</row>".encode())
                        row, count = next(iterator, None), count + 1
                    sheet.write(b"</sheetData></worksheet>")
            self._finish(book, names)
        return Written(file, place)

    def _finish(self, book: zipfile.ZipFile, names: list[str]) -> None:
        """The parts that name the sheets, their formats and each other."""
        office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        head, numbers = '<?xml version="1.0" encoding="UTF-8"?>', range(1, len(names) + 1)
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in numbers)
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, names, strict=True))
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        formats = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for n in (0, 14, 22))
        styles = f'<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{formats}</cellXfs>'
        for part, xml in {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{MAIN[1:-1]}">{styles}</styleSheet>',
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{overrides}</Types>',
        }.items():
            book.writestr(part, head + xml)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        old = [f.path for f in store.get_file_info(stores.FileSelector(root)) if f.path.endswith(".xlsx")]
        if self.overwrite:
            for path in old:
                store.delete_file(path)
        batch = self.own[-8:]
        for m in messages:
            if m and m.file:
                store.move(m.file, f"{root}/part-{m.place:05d}-{batch}.xlsx")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.own}").type != stores.FileType.NotFound:
            store.delete_dir(f"{root}/{self.own}")


class Workbook(DataSource):
    """df.write.format("workbook"): option kind names the column that tells the sheet, rowsPerSheet its most rows."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema, overwrite)


def write_workbooks(df: DataFrame, path: str, kind: str | None = None, workbooks: int | None = None, mode: str = "overwrite", rows_per_sheet: int = MOST_ROWS - 1) -> None:
    """df as workbooks in the folder path, one a partition with rows: a sheet a value of the column `kind`, headers first.

    workbooks: how many, at most; else as df is partitioned. A kind beyond rows_per_sheet goes on in another sheet.
    Numbers, dates and truth values are cells of their kind, all else is text. A table of no rows writes no workbook. The
    path is a folder that executors share, or a store that pyarrow opens.
    """
    df.sparkSession.dataSource.register(Workbook)
    dealt = df.repartition(workbooks) if workbooks else df
    rows = dealt.sortWithinPartitions(kind) if kind else dealt
    options = {"kind": kind} if kind else {}
    rows.write.format("workbook").mode(mode).options(**options, rowsPerSheet=rows_per_sheet).save(path)
