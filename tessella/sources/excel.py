"""Workbooks (.xlsx) with the standard library: one sheet in, one sheet out.

A sheet has at most 1,048,576 rows, so the driver parses and writes it.
"""

from __future__ import annotations

import datetime as dt
import decimal
import io
import re
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tessella import types
from tessella.errors import ArgumentError, FormatError, UnsupportedError
from tessella.names import ORDER
from tessella.operators.frame import Frame
from tessella.operators.reshape import column_label
from tessella.sources.files import check_path, replacing
from tessella.sources.headers import HeaderMode, column_names, has_header

# Fixed values of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DURATION_FORMATS = {46}
MAX_ROWS, MAX_COLUMNS, MAX_INTEGER = 1_048_576, 16_384, 999_999_999_999_999


@dataclass(frozen=True)
class ExcelReadOptions:
    """``sheet``: a name or a position from 0; the first sheet by default."""

    sheet: str | int | None = None
    header: HeaderMode = HeaderMode.INFER
    names: Sequence[str] | None = None


@dataclass(frozen=True)
class ExcelWriteOptions:
    sheet: str = "Sheet1"
    header: bool = True


def _suffix(path: str) -> str:
    path = check_path(path)
    if not path.lower().endswith(".xlsx"):
        raise UnsupportedError("only .xlsx files are supported")
    return path


def _column_number(reference: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", reference)
    if not m:
        raise FormatError(f"bad cell reference {reference!r}")
    n = 0
    for ch in m[1]:
        n = n * 26 + ord(ch) - 64
    return int(m[2]), n


def _column_letters(n: int) -> str:
    letters = ""
    while n:
        n, r = divmod(n - 1, 26)
        letters = chr(65 + r) + letters
    return letters


class _Book:
    """The parts of a workbook that reading a sheet needs."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.book = self._xml("xl/workbook.xml")
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            raise FormatError(f"not a workbook: {e}") from e
        names = set(self.zip.namelist())
        self.strings = [self._joined(x) for x in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        self.formats = self._formats() if "xl/styles.xml" in names else []
        props = self.book.find(f"{MAIN}workbookPr")
        self.from_1904 = props is not None and props.get("date1904") in ("1", "true")

    def _xml(self, part: str) -> ET.Element:
        return ET.fromstring(self.zip.read(part))

    @staticmethod
    def _joined(x: ET.Element) -> str:
        """All text of an item, without phonetic runs."""
        return "".join(t.text or "" for run in [x, *x.findall(f"{MAIN}r")] for t in run.findall(f"{MAIN}t"))

    def _formats(self) -> list[tuple[int, str]]:
        styles = self._xml("xl/styles.xml")
        custom = {int(x.get("numFmtId", "0")): x.get("formatCode", "") for x in styles.iter(f"{MAIN}numFmt")}
        cells = styles.find(f"{MAIN}cellXfs")
        return [(n := int(x.get("numFmtId", "0")), custom.get(n, "")) for x in (cells if cells is not None else [])]

    def sheet(self, which: str | int | None) -> ET.Element:
        sheets = self.book.findall(f"{MAIN}sheets/{MAIN}sheet")
        if isinstance(which, str):
            found = [s for s in sheets if s.get("name", "").lower() == which.lower()]
        else:
            i = 0 if which is None else which
            found = sheets[i : i + 1] if i >= 0 else []
        if not found:
            raise ArgumentError(f"no sheet {which!r}")
        links = {r.get("Id"): r.get("Target", "") for r in self._xml("xl/_rels/workbook.xml.rels").findall(f"{PACKAGE}Relationship")}
        target = links[found[0].get(f"{REL}id")]
        return self._xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")

    def kind(self, style: int) -> str:
        number, code = self.formats[style] if style < len(self.formats) else (0, "")
        if number in DURATION_FORMATS:
            return "duration"
        if not code:
            return "date" if number in DATE_FORMATS else "number"
        bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code)
        if re.search(r"\[[hms]+\]", bare, re.I):
            return "duration"
        bare = re.sub(r"\[[^\]]*\]", "", bare)
        return "date" if re.search(r"[ymdhs]", bare, re.I) else "number"

    def value(self, c: ET.Element) -> Any:
        """A cell's value; a formula counts with its stored result."""
        t, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if t == "inlineStr":
            item = c.find(f"{MAIN}is")
            return None if item is None else self._joined(item)
        text = None if v is None else v.text
        if t == "e":
            raise FormatError(f"cell {c.get('r')} holds the error {text}")
        if text is None:
            if c.find(f"{MAIN}f") is not None:
                raise FormatError(f"cell {c.get('r')} holds a formula without a stored result")
            return "" if t == "str" and v is not None else None
        if t == "s":
            return self.strings[int(text)]
        if t == "str":
            return text
        if t == "b":
            return text == "1"
        if t == "d":
            return dt.datetime.fromisoformat(text)
        kind = self.kind(int(c.get("s", "0")))
        if kind == "date":
            return _date(float(text), self.from_1904)
        if kind == "duration":
            return column_label(dt.timedelta(days=float(text)))
        return _number(text)


def _date(serial: float, from_1904: bool) -> dt.datetime:
    base = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30) if serial >= 60 else dt.datetime(1899, 12, 31)
    return base + dt.timedelta(milliseconds=round(serial * 86_400_000))


def _number(text: str) -> int | decimal.Decimal | float:
    """int where exact, decimal where the digits round-trip, else double."""
    value = decimal.Decimal(text)
    if value == value.to_integral_value() and abs(value) < 2**63:
        return int(value)
    if abs(value) < decimal.Decimal(2) ** 96 and -value.as_tuple().exponent <= 28:
        return value
    return float(text)


def _cells(book: _Book, sheet: ET.Element) -> dict[tuple[int, int], ET.Element]:
    found: dict[tuple[int, int], ET.Element] = {}
    row_at = 0
    for row in sheet.iter(f"{MAIN}row"):
        row_at = int(row.get("r", row_at + 1))
        column_at = 0
        for c in row.findall(f"{MAIN}c"):
            r, column_at = _column_number(c.get("r")) if c.get("r") else (row_at, column_at + 1)
            if c.find(f"{MAIN}v") is not None or c.find(f"{MAIN}f") is not None or c.find(f"{MAIN}is") is not None:
                found[r, column_at] = c
    return found


def read_excel(spark: SparkSession, path: str, options: ExcelReadOptions | None = None) -> Frame:
    """Read one sheet: the box around all cells with a value or formula; blank cells inside it are null."""
    options = options or ExcelReadOptions()
    path = _suffix(path)
    data = spark.read.format("binaryFile").load(path).select("content").first()
    if data is None:
        raise FileNotFoundError(path)
    book = _Book(bytes(data[0]))
    sheet = book.sheet(options.sheet)
    cells = _cells(book, sheet)
    if not cells:
        raise FormatError("the sheet is empty")
    top, left = min(r for r, _ in cells), min(c for _, c in cells)
    bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
    head = has_header(options.header, options.names)
    if head:
        for m in sheet.iter(f"{MAIN}mergeCell"):
            a = _column_number(m.get("ref", "A1").split(":")[0])
            b = _column_number(m.get("ref", "A1").split(":")[-1])
            if a[0] <= top <= b[0] and a[1] <= right and b[1] >= left:
                raise FormatError("the header holds merged cells")
    grid = [[book.value(cells[r, c]) if (r, c) in cells else None for c in range(left, right + 1)] for r in range(top, bottom + 1)]
    names = column_names(options.header, options.names, right - left + 1, lambda: [None if v is None else _as_text(v) for v in grid[0]])
    rows = grid[1:] if head else grid
    fields, columns = [], []
    for i, name in enumerate(names):
        t, values = _column([r[i] for r in rows])
        fields.append(T.StructField(name, t, None in values or isinstance(t, T.StringType)))
        columns.append(values)
    out = [(*v, i) for i, v in enumerate(zip(*columns, strict=True))]
    return Frame(spark.createDataFrame(out, T.StructType([*fields, T.StructField(ORDER, T.LongType(), False)])))


def _as_text(v: Any) -> str:
    if isinstance(v, bool):
        return "True" if v else "False"
    return v if isinstance(v, str) else column_label(v)


def _column(values: list[Any]) -> tuple[T.DataType, list[Any]]:
    """The narrowest type for all values; columns of mixed kinds become text."""
    there = [v for v in values if v is not None]
    kinds = {bool if isinstance(v, bool) else dt.datetime if isinstance(v, dt.datetime) else str if isinstance(v, str) else int for v in there}
    if not there or kinds == {str}:
        return T.StringType(), values
    if kinds == {bool}:
        return T.BooleanType(), values
    if kinds == {dt.datetime}:
        return T.TimestampNTZType(), values
    if kinds != {int}:
        return T.StringType(), [None if v is None else _as_text(v) for v in values]
    if any(isinstance(v, float) for v in there):
        return T.DoubleType(), [None if v is None else float(v) for v in values]
    if any(isinstance(v, decimal.Decimal) for v in there):
        exact = [None if v is None else decimal.Decimal(v) for v in values]
        scale = max(-v.as_tuple().exponent for v in exact if v is not None)
        return T.DecimalType(38, max(0, scale)), exact
    return (T.IntegerType() if all(types.INT_MIN <= v <= types.INT_MAX for v in there) else T.LongType()), values


def _check_sheet(name: str) -> str:
    if not isinstance(name, str) or not name.strip() or len(name) > 31 or re.search(r"[:\\/?*\[\]]", name) or name[0] == "'" or name[-1] == "'":
        raise ArgumentError(f"{name!r} is not a sheet name")
    return name


def _cell(reference: str, v: Any, name: str) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{reference}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, str):
        if len(v) > 32_767:
            raise UnsupportedError(f"column {name!r}: a text is longer than a cell can hold")
        return f'<c r="{reference}" s="2" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", lambda m: f"_x{ord(m[0]):04X}_", v))}</t></is></c>'
    if isinstance(v, int):
        if abs(v) > MAX_INTEGER:
            raise UnsupportedError(f"column {name!r}: {v} has more digits than a cell can hold")
        return f'<c r="{reference}"><v>{v}</v></c>'
    if isinstance(v, decimal.Decimal):
        if decimal.Decimal(repr(float(v))) != v or len(v.normalize().as_tuple().digits) > 15:
            raise UnsupportedError(f"column {name!r}: {v} can't be stored exactly")
        return f'<c r="{reference}"><v>{format(v, "f")}</v></c>'
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            raise UnsupportedError("NaN and infinity can't be written")
        return f'<c r="{reference}"><v>{v!r}</v></c>'
    if isinstance(v, dt.datetime):
        if not dt.datetime(1900, 1, 1) <= v.replace(tzinfo=None):
            raise UnsupportedError(f"column {name!r}: {v} is before 1900")
        days = v.replace(tzinfo=None) - dt.datetime(1899, 12, 30)
        serial = days.days + days.seconds / 86400 + days.microseconds / 86400e6
        return f'<c r="{reference}" s="1"><v>{serial if serial >= 61 else serial - 1!r}</v></c>'
    raise UnsupportedError(f"column {name!r} holds a value that a cell can't hold")


STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss.000"/></numFmts>'
    '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>'
)


def write_excel(frame: Frame, path: str, options: ExcelWriteOptions | None = None) -> None:
    """Write one sheet in frame order; values that a cell can't hold exactly are refused."""
    options = options or ExcelWriteOptions()
    path, sheet = _suffix(path), _check_sheet(options.sheet)
    for f in frame.schema.fields:
        if isinstance(f.dataType, (*types.COMPLEX, T.BinaryType)):
            raise UnsupportedError(f"column {f.name!r} ({f.dataType.simpleString()}) can't be written")
    names = frame.columns_list
    if len(names) > MAX_COLUMNS:
        raise UnsupportedError("a sheet has at most 16,384 columns")
    letters = [_column_letters(i) for i in range(1, len(names) + 1)]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with replacing(path, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", head + STYLES)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as s:
            s.write(f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            at = 0
            rows = ([names] if options.header else [])
            for row in _chain(rows, frame.iter_rows()):
                at += 1
                if at > MAX_ROWS:
                    raise UnsupportedError("a sheet has at most 1,048,576 rows")
                cells = "".join(_cell(f"{c}{at}", v, n) for c, v, n in zip(letters, row, names, strict=True))
                s.write(f'<row r="{at}">{cells}</row>'.encode())
            s.write(b"</sheetData></worksheet>")


def _chain(first, rest):  # noqa: ANN001, ANN202
    yield from first
    yield from rest
