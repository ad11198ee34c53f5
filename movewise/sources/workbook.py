"""Workbooks (.xlsx) as a data source and sink: a zip of XML, read and written with the standard library.

Reading deals a sheet to tasks by ranges of rows. Each task skips to its rows without taking the rows before
them apart, and then looks up only the shared strings that they name. All columns are text, as CSV gives it:
numbers as they are stored, dates as ISO, booleans as true and false, errors as null. The first row names
the columns; rows without a value are skipped. `_row` is the number of the row in its sheet.

Writing renders rows in the tasks, one file of fragments each, and puts them together in the order of
partitions when all are there: a sheet has at most 1,048,576 rows by its format, and a larger frame is
refused. What a failed task left is not named by any message and goes with the folder of fragments.

Paths are what pyarrow's file systems read: absolute local paths, s3, gs, hdfs.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.shipping import ship

NAME = "movewise_workbook"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
ROWS_A_TASK, BATCH, CHUNK = 50_000, 4096, 1 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:(?!//)", "file://", path).replace("s3a://", "s3://", 1))


# Reading.


def column_of(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or a time: it has one of y, m, d, h, s outside quotes, brackets and escapes."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", code.lower()).replace("general", "")))


def from_serial(value: float, since_1904: bool = False) -> str:
    """A day number with a part of a day, as ISO text. The calendar's day 60 of 1900, which never was, is taken as the day before."""
    day = value + 1462 if since_1904 else value
    moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=day if day >= 61 else day + 1)
    moment = (moment + dt.timedelta(microseconds=500)).replace(microsecond=0) if abs(moment.microsecond - 1_000_000) <= 500 else moment.replace(microsecond=moment.microsecond // 1000 * 1000)
    if 0 <= value < 1:
        return moment.time().isoformat()
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(" ")


class Book:
    """An open workbook: names and parts of its sheets, which cell styles show dates."""

    def __init__(self, path: str) -> None:
        fs, where = open_fs(path)
        self.zip = zipfile.ZipFile(fs.open_input_file(where))
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets: dict[str, str] = {}
        self.since_1904 = False
        for e in root.iter():
            if _local(e.tag) == "workbookPr":
                self.since_1904 = e.get("date1904") in ("1", "true")
            if _local(e.tag) == "sheet":
                to = links[next(v for k, v in e.attrib.items() if _local(k) == "id")]
                self.sheets[e.get("name")] = to.lstrip("/") if to.startswith("/") else f"xl/{to}"
        self.dates = self._dates()

    def _dates(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _local(e.tag) == "numFmt"}
        shown = next((e for e in root if _local(e.tag) == "cellXfs"), ())
        # Numbers of the built-in formats that show dates and times.
        is_date = lambda n: is_date_format(own[n]) if n in own else 14 <= n <= 22 or 45 <= n <= 47
        return {i for i, x in enumerate(shown) if is_date(int(x.get("numFmtId", 0)))}

    def part(self, sheet: str | None) -> str:
        """The part of a sheet by its name or its number from 0; the first without one."""
        if sheet is None or sheet.isdecimal() and sheet not in self.sheets:
            names = list(self.sheets)
            if int(sheet or 0) >= len(names):
                raise ValueError(f"there are {len(names)} sheets, not {int(sheet or 0) + 1}")
            return self.sheets[names[int(sheet or 0)]]
        if sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {list(self.sheets)}")
        return self.sheets[sheet]

    def last_row(self, part: str) -> int | None:
        """What the sheet says its last row is; None where it does not."""
        with self.zip.open(part) as f:
            found = re.search(rb'<(?:\w+:)?dimension\s+ref="(?:[A-Z]+\d+:)?[A-Z]+(\d+)"', f.read(1 << 16))
        return int(found.group(1)) if found else None

    def rows(self, part: str, first: int, beyond: int | None) -> Iterator[tuple[int, ElementTree.Element]]:
        """Rows first <= number < beyond, as elements."""
        with self.zip.open(part) as f:
            buffer = f.read(CHUNK)
            root = re.search(rb"<(\w+:)?worksheet\b[^>]*>", buffer)
            prefix, head, tail = root.group(1) or b"", root.group(), b"</" + (root.group(1) or b"") + b"worksheet>"
            row = re.compile(rb"<" + prefix + rb"row\b([^>]*?)(/>|>(.*?)</" + prefix + rb"row>)", re.S)
            number, at = 0, root.end()
            while True:
                for m in row.finditer(buffer, at):
                    said = re.search(rb'\br="(\d+)"', m.group(1))
                    number, at = int(said.group(1)) if said else number + 1, m.end()
                    if beyond is not None and number >= beyond:
                        return
                    if number >= first:
                        yield number, ElementTree.fromstring(head + m.group() + tail)[0]
                more = f.read(CHUNK)
                if not more:
                    return
                buffer, at = buffer[at:] + more, 0

    def strings(self, wanted: set[int]) -> dict[int, str]:
        """The shared strings of some numbers; the others are passed over as they are read."""
        out: dict[int, str] = {}
        if not wanted:
            return out
        last, n, depth = max(wanted), 0, 0
        with self.zip.open("xl/sharedStrings.xml") as f:
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if _local(e.tag) != "si":
                    continue
                depth += 1 if event == "start" else -1
                if event == "end":
                    if n in wanted:
                        out[n] = _text(e)
                    n += 1
                    e.clear()
                    if n > last:
                        break
        return out

    def cells(self, row: ElementTree.Element) -> dict[int, str | int | None]:
        """Values by column: text, or the number of a shared string."""
        out: dict[int, str | int | None] = {}
        at = -1
        for c in row:
            if _local(c.tag) != "c":
                continue
            at = column_of(c.get("r")) if c.get("r") else at + 1
            kind = c.get("t", "n")
            if kind == "inlineStr":
                out[at] = next((_text(x) for x in c if _local(x.tag) == "is"), None)
                continue
            value = next((x.text for x in c if _local(x.tag) == "v"), None)
            if value is None or kind == "e":
                continue
            if kind == "s":
                out[at] = int(value)
            elif kind == "b":
                out[at] = "true" if value == "1" else "false"
            elif kind == "n" and int(c.get("s", 0)) in self.dates:
                out[at] = from_serial(float(value), self.since_1904)
            else:
                out[at] = _unescaped(value) if kind == "str" else value
        return out


def _unescaped(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m.group(1), 16)), text)


def _text(e: ElementTree.Element) -> str:
    """Text of a string with or without formatted parts, without its phonetic guide."""
    parts = []
    for x in e:
        if _local(x.tag) == "t":
            parts.append(x.text or "")
        elif _local(x.tag) == "r":
            parts += [t.text or "" for t in x if _local(t.tag) == "t"]
    return _unescaped("".join(parts))


@dataclass
class Rows(InputPartition):
    first: int
    beyond: int | None


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.sheet = options["path"], options.get("sheet")
        self.header, self.size = int(options.get("header_row", 1)), int(options.get("rows_per_task", ROWS_A_TASK))
        self.names = schema.fieldNames()

    def partitions(self) -> Sequence[InputPartition]:
        book = Book(self.path)
        last = book.last_row(book.part(self.sheet))
        starts = list(range(self.header + 1, max(last or 0, self.header + 1) + 1, self.size))
        return [Rows(a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]  # the last one takes what the sheet does not announce

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        book = Book(self.path)
        held: list[tuple[int, dict[int, str | int | None]]] = []
        for number, row in book.rows(book.part(self.sheet), partition.first, partition.beyond):
            if cells := {k: v for k, v in book.cells(row).items() if v is not None}:
                held.append((number, cells))
            if len(held) == BATCH:
                yield self._batch(book, held)
                held = []
        yield self._batch(book, held)

    def _batch(self, book: Book, held: list) -> pa.RecordBatch:
        shared = book.strings({v for _, cells in held for v in cells.values() if isinstance(v, int)})
        values = [[shared[v] if isinstance(v, int) else v for v in (cells.get(k) for _, cells in held)] for k in range(len(self.names) - 1)]
        return pa.RecordBatch.from_arrays([*[pa.array(v, pa.string()) for v in values], pa.array([n for n, _ in held], pa.int64())], self.names)


# Writing.

# Number formats, and the columns that take them, by their whole name or its end.
CURRENCY, PERCENT, RATE, INTEGER = "#,##0.00", "0.0%", "0.000", "#,##0"
FORMAT_OF = {
    "net_sales": CURRENCY, "gross_sales": CURRENCY, "impact": CURRENCY, "variance": CURRENCY, "contribution": CURRENCY, "aov": CURRENCY, "units": INTEGER, "orders": INTEGER,
    "wape": RATE, "mae": CURRENCY, "rmse": CURRENCY, "movement": RATE, "priority_score": CURRENCY,
}
FORMAT_OF_END = {"_pct": PERCENT, "_share": PERCENT, "_rate": RATE, "attainment": PERCENT, "_units": INTEGER, "_count": INTEGER, "_sales": CURRENCY, "_target": CURRENCY, "_value": CURRENCY}
WIDEST, NARROWEST, LONGEST_NAME = 60, 10, 31

DAY, MOMENT = "yyyy-mm-dd", "yyyy-mm-dd hh:mm:ss"
STYLES = [None, CURRENCY, PERCENT, RATE, INTEGER, DAY, MOMENT]
HEADER, TITLE, NOTE, WRAPPED = (len(STYLES) + k for k in range(4))


def number_format(column: str) -> str | None:
    """How a number is shown, by what its column's name says it is."""
    name = column.lower()
    return FORMAT_OF.get(name) or next((f for end, f in FORMAT_OF_END.items() if name.endswith(end)), None)


def sheet_name(name: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "-", name[:LONGEST_NAME])


def column_name(k: int) -> str:
    out, k = "", k + 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def to_serial(value: dt.date) -> float:
    since = dt.datetime(1899, 12, 30)
    if not isinstance(value, dt.datetime):
        return float((dt.datetime(value.year, value.month, value.day) - since).days)
    return (value.replace(tzinfo=None) - since) / dt.timedelta(days=1)


def _quoted(text: str) -> str:
    """Text for XML; characters that it cannot hold are written as _xHHHH_, and so is text that looks like that."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m.group()):04X}_", text)
    return escape(text)


def _shown(value: object) -> str:
    return "" if value is None else str(value)


def cell(column: str, row: str, value: object, shown: int | None) -> str:
    """One cell; shown is the style of a number in its column."""
    at = f'<c r="{column}{row}"'
    if value is None or isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return ""
    if isinstance(value, bool):
        return f'{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, decimal.Decimal)):
        style = f' s="{shown}"' if shown else ""
        return f"{at}{style}><v>{value!r}</v></c>" if not isinstance(value, decimal.Decimal) else f"{at}{style}><v>{value}</v></c>"
    if isinstance(value, dt.datetime):
        return f'{at} s="{STYLES.index(MOMENT)}"><v>{to_serial(value)!r}</v></c>'
    if isinstance(value, dt.date):
        return f'{at} s="{STYLES.index(DAY)}"><v>{int(to_serial(value))}</v></c>'
    if isinstance(value, (list, tuple)):
        value = "; ".join(str(v) for v in value)
    elif isinstance(value, dict):
        value = "; ".join(str(v) for v in value)
    return f'{at} t="inlineStr"><is><t xml:space="preserve">{_quoted(str(value))}</t></is></c>'


@dataclass
class Fragment(WriterCommitMessage):
    """Rows of one partition: file, how many, longest text of each column among the first ones."""

    part: int
    file: str
    rows: int
    longest: list[int]


#: Stands for the number of a row until all rows before it are known; XML cannot hold it.
_ROW = "\x00"
_LOOKED_AT = 200


class SheetWriter(DataSourceArrowWriter):
    """Fragments under <path>; commit writes their list, `assemble` makes a workbook of them."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.names = options["path"].rstrip("/"), schema.fieldNames()
        if len(self.names) > MOST_COLUMNS:
            raise ValueError(f"a sheet has at most {MOST_COLUMNS} columns")
        self.sheet = options.get("sheet", "Sheet1")
        self.alone = options.get("alone", "true") == "true"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}" if self.alone else self.path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = open_fs(self.folder)
        fs.create_dir(folder, recursive=True)
        context = TaskContext.get()
        file = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        letters = [column_name(k) for k in range(len(self.names))]
        shown = [STYLES.index(f) if (f := number_format(c)) else None for c in self.names]
        rows, longest = 0, [0] * len(self.names)
        with fs.open_output_stream(file) as out:
            for batch in iterator:
                lines = []
                for values in zip(*[c.to_pylist() for c in batch.columns], strict=True) if batch.num_columns else [()] * batch.num_rows:
                    if rows < _LOOKED_AT:
                        longest = [max(n, len(_shown(v))) for n, v in zip(longest, values, strict=True)]
                    rows += 1
                    lines.append(f'<row r="{_ROW}">' + "".join(cell(a, _ROW, v, s) for a, v, s in zip(letters, values, shown, strict=True)) + "</row>")
                out.write("".join(lines).encode())
        return Fragment(context.partitionId(), file, rows, longest)

    def commit(self, messages: list) -> None:
        fs, folder = open_fs(self.folder)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/sheet.json") as out:
            out.write(json.dumps({"name": self.sheet, "columns": self.names, "parts": [asdict(m) for m in done]}).encode())
        if self.alone:
            assemble(self.path, [self.folder])

    def abort(self, messages: list) -> None:
        _drop(self.folder)


def _drop(folder: str) -> None:
    fs, path = open_fs(folder)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        book, header = Book(self.options["path"]), int(self.options.get("header_row", 1))
        top = next(book.rows(book.part(self.options.get("sheet")), header, header + 1), None)
        cells = book.cells(top[1]) if top else {}
        shared = book.strings({v for v in cells.values() if isinstance(v, int)})
        names = [shared[v] if isinstance(v, int) else v for v in (cells.get(k) for k in range(max(cells, default=-1) + 1))]
        fields = StructType()
        for k, name in enumerate(names):
            fields.add(StructField(name if name is not None else f"Unnamed: {k}", StringType()))
        return fields.add(StructField("_row", LongType()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SheetWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WorkbookSource)


def read_sheet(spark: SparkSession, path: str, sheet: str | int | None = None, header_row: int = 1, ordered: bool = False, rows_per_task: int = ROWS_A_TASK) -> DataFrame:
    """A sheet's columns as text; ordered: with _row."""
    register(spark)
    options = {"header_row": str(header_row), "rows_per_task": str(rows_per_task)} | ({} if sheet is None else {"sheet": str(sheet)})
    df = spark.read.format(NAME).options(**options).load(path)
    return df if ordered else df.drop("_row")


@dataclass
class Cover:
    """The first sheet: what the book is and how to read it."""

    title: str
    description: str
    notes: Sequence[str] = ()


def _plain(cells: Sequence[tuple[int, str, int]], width: int) -> bytes:
    rows = "".join(f'<row r="{n}"><c r="A{n}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_quoted(text)}</t></is></c></row>' for n, text, style in cells)
    return f'{_SHEET}<cols><col min="1" max="1" width="{width}" customWidth="1"/></cols><sheetData>{rows}</sheetData></worksheet>'.encode()


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_SHEET = f'{_XML}<worksheet xmlns="{_MAIN}">'


def _styles() -> str:
    own = [f for f in STYLES if f not in (None, CURRENCY, PERCENT, INTEGER, RATE)]
    number = {None: 0, INTEGER: 3, CURRENCY: 4} | {f: 164 + k for k, f in enumerate([PERCENT, RATE, *own])}
    formats = "".join(f'<numFmt numFmtId="{n}" formatCode="{escape(f)}"/>' for f, n in number.items() if n >= 164)
    xf = lambda n, font=0, fill=0, more="": f'<xf numFmtId="{n}" fontId="{font}" fillId="{fill}" borderId="0" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1"{" applyAlignment=" + chr(34) + "1" + chr(34) + ">" + more + "</xf>" if more else "/>"}'
    cells = [xf(number[f]) for f in STYLES] + [xf(0, 1, 2, '<alignment horizontal="center"/>'), xf(0, 2), xf(0, 3), xf(0, 0, 0, '<alignment wrapText="1" vertical="top"/>')]
    return (
        f'{_XML}<styleSheet xmlns="{_MAIN}"><numFmts count="{len(own) + 2}">{formats}</numFmts>'
        '<fonts count="4"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font><font><b/><sz val="14"/><name val="Calibri"/></font><font><i/><sz val="11"/><color rgb="FF666666"/><name val="Calibri"/></font></fonts>'
        '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF274060"/></patternFill></fill></fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="{len(cells)}">{"".join(cells)}</cellXfs></styleSheet>'
    )


def _write_table(out, sheet: dict, fs: pafs.FileSystem, note: str | None) -> None:
    """A table's sheet: a note, bold names that stay in view, a filter over the rows, and the rows as the tasks rendered them."""
    names, parts = sheet["columns"], sheet["parts"]
    total, top = sum(p["rows"] for p in parts), 3 if note else 1
    if total + top > MOST_ROWS:
        raise ValueError(f"sheet {sheet['name']!r} has {total:,} rows; a sheet holds {MOST_ROWS - top:,}")
    longest, looked = [len(c) for c in names], 0
    for p in parts:
        if looked < _LOOKED_AT:
            longest, looked = [max(a, b) for a, b in zip(longest, p["longest"], strict=True)], looked + p["rows"]
    last = column_name(max(len(names), 1) - 1)
    columns = "".join(f'<col min="{k}" max="{k}" width="{min(WIDEST, max(NARROWEST, n + 2))}" customWidth="1"/>' for k, n in enumerate(longest, 1))
    out.write(
        f'{_SHEET}<dimension ref="A1:{last}{total + top}"/><sheetViews><sheetView workbookViewId="0"><pane ySplit="{top}" topLeftCell="A{top + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f"{f'<cols>{columns}</cols>' if names else ''}<sheetData>".encode()
    )
    if note:
        out.write(f'<row r="1"><c r="A1" s="{NOTE}" t="inlineStr"><is><t xml:space="preserve">{_quoted(note)}</t></is></c></row>'.encode())
    out.write((f'<row r="{top}">' + "".join(f'<c r="{column_name(k)}{top}" s="{HEADER}" t="inlineStr"><is><t xml:space="preserve">{_quoted(c)}</t></is></c>' for k, c in enumerate(names)) + "</row>").encode())
    n = top
    for p in parts:
        with fs.open_input_stream(p["file"]) as rendered:
            rest = b""
            while chunk := rendered.read(CHUNK):
                *whole, rest = (rest + chunk).split(b"</row>")
                for row in whole:
                    n += 1
                    out.write(row.replace(b"\x00", b"%d" % n) + b"</row>")
    out.write(b"</sheetData>" + (f'<autoFilter ref="A{top}:{last}{n}"/>'.encode() if total and names else b"") + b"</worksheet>")


def assemble(path: str, folders: Sequence[str], cover: Cover | None = None, notes: dict[str, str] | None = None) -> None:
    """One workbook of the sheets whose fragments lie in folders, which go; the file appears as a whole or not at all."""
    fs, where = open_fs(path)
    listed = []
    for folder in folders:
        f, at = open_fs(folder)
        with f.open_input_stream(f"{at}/sheet.json") as text:
            listed.append(json.loads(text.read()))
    names: list[str] = ["Read me"] if cover else []
    for sheet in listed:
        name, k = sheet_name(sheet["name"]), 2
        while name.lower() in (n.lower() for n in names):  # names cut to one length may meet
            name, k = f"{sheet_name(sheet['name'])[: LONGEST_NAME - len(str(k)) - 1]} {k}", k + 1
        names.append(name)
    draft = f"{where}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(draft) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
            z.writestr(
                "[Content_Types].xml",
                f'{_XML}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{over}</Types>',
            )
            z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            links = "".join(f'<Relationship Id="rId{k}" Type="{_LINK}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACK}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{_LINK}/styles" Target="styles.xml"/></Relationships>')
            sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets>{sheets}</sheets></workbook>')
            z.writestr("xl/styles.xml", _styles())
            k = 0
            if cover:
                k = 1
                lines = [(1, cover.title, TITLE), (2, f"Generated {dt.datetime.now():%Y-%m-%d %H:%M}", NOTE), (4, cover.description, WRAPPED)]
                if cover.notes:
                    lines += [(6, "Please read before using these figures", TITLE), *[(7 + i, f"- {n}", WRAPPED) for i, n in enumerate(cover.notes)]]
                z.writestr("xl/worksheets/sheet1.xml", _plain(lines, 110))
            for k, sheet in enumerate(listed, k + 1):  # noqa: B020
                with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                    _write_table(out, sheet, fs, (notes or {}).get(sheet["name"]))
        fs.move(draft, where)
    except BaseException:
        if fs.get_file_info(draft).type == pafs.FileType.File:
            fs.delete_file(draft)
        raise
    finally:
        for folder in folders:
            _drop(folder)


def write_workbook(sheets: dict[str, DataFrame], path: str, cover: Cover | None = None, notes: dict[str, str] | None = None) -> None:
    """Sheets in their order, each written by the tasks of its frame; names of columns stay where a sheet is empty."""
    folders = []
    for k, (name, df) in enumerate(sheets.items()):
        register(df.sparkSession)
        folders.append(f"{path}.parts-{uuid.uuid4().hex}-{k}")
        df.write.format(NAME).mode("append").options(sheet=name, alone="false").save(folders[-1])
    assemble(path, folders, cover, notes)
