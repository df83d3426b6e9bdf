"""Workbooks (.xlsx) as a source: many files are read in parallel, one task per file.

A workbook is a small zip of XML; the cells of the first sheet are streamed with the standard
library inside the task, its first row names the columns. A cell's kind comes from the file:
text stays text ("00123"), numbers with a date format are dates, errors are null.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table

# XML namespaces and built-in date formats of the format (ECMA-376).
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
BATCH_ROWS = 4_000  # rows of a sheet that a task hands over at once
CELL_SCHEMA = "path string, line int, names array<string>, kinds array<string>, texts array<string>"

Cell = tuple[str, str]  # kind ("number", "text", "date", "boolean") and text


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or time: a date letter outside of quotes, escapes and colours."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0], flags=re.IGNORECASE)
    return bare.lower() != "general" and bool(re.search(r"[dmyhs]", bare, re.IGNORECASE))


def serial_date(number: float, from_1904: bool = False) -> str | None:
    """Date of a day number as ISO text, to the millisecond; null outside of the calendar.

    The calendar from 1900 counts a 29 February 1900 that did not exist.
    """
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if number >= 60 else 31)
    try:
        return (start + dt.timedelta(milliseconds=round(number * 86_400_000))).isoformat(sep=" ", timespec="milliseconds")
    except OverflowError:
        return None


def _texts(element) -> str:
    """Text of a string item, all runs of it, without phonetic hints."""
    parts = [t.text or "" for t in element.findall(f"{MAIN}t")]
    return "".join(parts + [t.text or "" for run in element.findall(f"{MAIN}r") for t in run.findall(f"{MAIN}t")])


def _stream(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind; each is dropped when the next is asked for."""
    with book.open(name) as source:
        root = None
        for event, element in ElementTree.iterparse(source, ("start", "end")):
            if root is None:
                root = element
            elif event == "end" and element.tag == MAIN + tag:
                yield element
                element.clear()


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
    used = [int(x.get("numFmtId", 0)) for x in styles.findall(f"{MAIN}cellXfs/{MAIN}xf")]
    return {i for i, f in enumerate(used) if (is_date_format(own[f]) if f in own else f in DATE_FORMATS)}


def sheet_rows(content: bytes) -> Iterator[list[Cell | None]]:
    """Rows of the first sheet, cell by cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(item) for item in _stream(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        first = next(workbook.iter(f"{MAIN}sheet")).get(RELATION)
        settings = workbook.find(f"{MAIN}workbookPr")
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(link.get("Target") for link in links if link.get("Id") == first)
        dates = _date_styles(book)

        def read(cell) -> Cell | None:
            kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
            if kind == "inlineStr":
                inline = cell.find(f"{MAIN}is")
                return ("text", _texts(inline)) if inline is not None else None
            if value is None or kind == "e":
                return None
            if kind in ("s", "str"):
                return "text", shared[int(value)] if kind == "s" else value
            if kind == "b":
                return "boolean", "true" if value == "1" else "false"
            if kind == "d":
                return "date", value
            if int(cell.get("s", 0)) in dates:
                shown = serial_date(float(value), from_1904)
                return ("date", shown) if shown else ("number", value)
            return "number", value

        for row in _stream(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}", "row"):
            cells: list[Cell | None] = []
            for cell in row.iter(f"{MAIN}c"):
                at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = read(cell)
            yield cells


def _header(cells: list[Cell | None]) -> list[str | None]:
    """Column names; a name that repeats gets .1, .2 and so on, a column without a name is not read."""
    names: list[str | None] = []
    for cell in cells:
        name, n = cell and cell[1], 0
        while name is not None and name in names:
            n += 1
            name = f"{cell[1]}.{n}"
        names.append(name)
    return names


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"path": pa.string(), "line": pa.int32(), **{c: pa.list_(pa.string()) for c in ("names", "kinds", "texts")}}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))

    for files in batches:
        for path, content in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
            rows, header = [], None
            for line, cells in enumerate(sheet_rows(content)):
                if header is None:
                    header = _header(cells)
                    used = [i for i, name in enumerate(header) if name is not None]
                    rows.append((path, 0, [header[i] for i in used], None, None))
                    continue
                held = [(header[i], *cells[i]) for i in used if i < len(cells) and cells[i] is not None]
                rows.append((path, line, *([h[k] for h in held] for k in range(3))))
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def parse_workbooks(files: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """First sheets of the workbooks in `(path, content)` as one table, columns matched by name.

    Each file is parsed once: its cells are written, and names and kinds are told from that table.
    Without a schema, the names of all files count, in the order of the files and of their first
    rows. A column whose cells are all numbers is double, all dates timestamp_ntz, all booleans
    boolean; any other is text, with its numbers as the file has them.
    """
    parsed = files.select("path", "content").mapInArrow(_cells, CELL_SCHEMA)
    if schema is None:
        parsed = written_table(parsed, "workbooks")
        where = F.when(F.col("line") == 0, F.struct("path", "at"))
        kind = F.get("kinds", "at")
        found = parsed.select("path", "line", "kinds", F.posexplode("names").alias("at", "name")).groupBy("name").agg(
            F.min(where).alias("first"), *[F.count_if(kind == k).alias(k) for k in ("number", "date", "boolean")],
            F.count(kind).alias("cells")).orderBy("first").collect()
        if not found:
            raise ValueError("no workbook with a header")
        kinds = (("number", T.DoubleType()), ("date", T.TimestampNTZType()), ("boolean", T.BooleanType()))
        schema = T.StructType([
            T.StructField(r["name"], next((t for k, t in kinds if r[k] == r["cells"]), T.StringType())) for r in found])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def value(field: T.StructField):
        text = F.get("texts", F.array_position("names", F.lit(field.name)).cast("int") - 1)
        if isinstance(field.dataType, T.StringType):
            return text
        exact = text.try_cast(field.dataType)
        # Whole numbers may be stored as 1E3.
        return F.coalesce(exact, text.try_cast("double").try_cast(field.dataType)) if isinstance(field.dataType, T.IntegralType) else exact

    return parsed.filter("line > 0").select(*[value(f).alias(f.name) for f in schema.fields])


def read_excel(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All workbooks below `path` as one table; see `parse_workbooks`."""
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), schema)
