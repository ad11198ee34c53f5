"""CSV with line breaks inside quoted fields, read by many tasks a file, with line numbers of the whole file.

Spark reads such a file (`multiLine`) as one task, since a break alone does not say whether a record ends
there. Here its text source deals the lines of a file to splits, and each line is a function of two
states: inside a quoted field or not, at its start and at its end. Functions compose, so a first pass gives
one small row for each split: where it ends for either state at its beginning, how many lines it has, how
many records begin in it. A prefix scan over those rows says how each split really begins and which
records and lines it starts with; the second pass joins lines to records, and Spark's own parser takes the
records apart. Only records that lie across the edge of a split are put together by a shuffle, in a
pass over the files that have any.

The driver holds one row of six numbers for each split: some 800,000 for 100 TB. Both passes must see the
same splits, so spark.sql.files.maxPartitionBytes must not change between them; a split that is not known
stops the job.

Rows, columns and order are those of Spark's reader with multiLine and escape='"' for files whose records
end with LF or CRLF: a quote opens a field only at its start; a doubled quote inside one is a quote; what
follows a closing quote up to the delimiter is plain. Empty lines between records are skipped. Compressed
files are one split.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship


def line_ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a quoted field is open after a line, for its state before it."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += len(delimiter)


def _blank(line: str) -> bool:
    return line in ("", "\r")


@dataclass
class _Seen:
    """What a split is for each state at its beginning (index 0: outside a quoted field, 1: inside)."""

    lines: int = 0
    state: tuple[bool, bool] = (False, True)
    records: tuple[int, int] = (0, 0)

    def add(self, line: str, delimiter: str) -> None:
        self.lines += 1
        full = not _blank(line)
        (a, b), (m, n) = self.state, self.records
        self.records = m + (full and not a), n + (full and not b)
        if '"' in line:
            to = line_ends_inside(line, a, delimiter)
            self.state = to, to if a == b else line_ends_inside(line, b, delimiter)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str, int], str]]:
    """((sheet, path, start of the split), line), without the mark that a file may begin with."""
    before = None
    for batch in batches:
        for sheet, path, start, line in zip(*[batch[c].to_pylist() for c in ("sheet", "path", "start", "value")], strict=True):
            split = (sheet, path, start)
            yield split, line.removeprefix("\ufeff") if start == 0 and split != before else line
            before = split


def _summed(delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str, int], _Seen] = {}
        first: dict[tuple[int, str, int], bool] = {}
        for split, line in _lines(batches):
            if split not in seen:
                seen[split], first[split] = _Seen(), line.endswith("\r")
            seen[split].add(line, delimiter)
        rows = [(*split, s.lines, *s.state, *s.records, first[split]) for split, s in seen.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 9
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _SUMMARY.replace(",", "").split()[::2])

    return run


_SUMMARY = "sheet int, path string, start long, lines long, out_ends boolean, in_ends boolean, out_records long, in_records long, crlf boolean"


@dataclass
class Begin:
    """How a split begins: inside a quoted field, number of its first record in the file, of its first line, rows before the file, CRLF."""

    inside: bool
    record: int
    line: int
    before: int
    crlf: bool


def scan(rows: list, header: bool) -> tuple[dict[tuple[int, str, int], Begin], list[str]]:
    """How every split begins, and the files where a record lies across an edge."""
    out: dict[tuple[int, str, int], Begin] = {}
    cut: list[str] = []
    total, file = 0, None
    inside, record, line, crlf = False, 0, 0, False
    for r in sorted(rows, key=lambda r: (r["sheet"], r["path"], r["start"])):
        if (r["sheet"], r["path"]) != file:
            total += max(0, record - header) if file else 0
            file, inside, record, line, crlf = (r["sheet"], r["path"]), False, 0, 0, r["crlf"]
        out[r["sheet"], r["path"], r["start"]] = Begin(inside, record, line, total, crlf)
        if inside and file[1] not in cut[-1:]:
            cut.append(file[1])
        record, line = record + (r["in_records"] if inside else r["out_records"]), line + r["lines"]
        inside = r["in_ends"] if inside else r["out_ends"]
    return out, cut


def _joined(begins, delimiter: str, pieces: bool):
    """Records that lie within their split, or the pieces of all others with the start of their split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = begins.value
        out: list[tuple] = []
        split, held, inside, record, line, opened, crlf, before, whole = None, [], False, 0, 0, 0, False, 0, True

        def close(done: bool) -> None:
            if held and (done and whole) != pieces:
                text = "\n".join(x.removesuffix("\r") for x in held) if crlf else "\n".join(held)
                out.append((before, record - 1, opened, split[2], text))
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], ["before", "n", "_line", "start", "record"])

        for now, text in _lines(batches):
            if now != split:
                close(False)
                if now not in known:
                    raise ValueError(f"split {now} was not there before: has spark.sql.files.maxPartitionBytes changed?")
                split, begin = now, known[now]
                inside, record, line, before, crlf = begin.inside, begin.record, begin.line, begin.before, begin.crlf
                whole, opened = not inside, line + 1
            line += 1
            if not inside:
                if _blank(text):
                    continue
                record, whole, opened = record + 1, True, line
            held.append(text)
            if '"' in text:
                inside = line_ends_inside(text, inside, delimiter)
            if not inside:
                close(True)
                if len(out) >= 4096:
                    yield batch()
        close(False)
        yield batch()

    return run


_JOINED = "before long, n long, _line long, start long, record string"


def records(spark: SparkSession, *paths: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """One row per record: _row (counted over all paths as given, files of one by name, from 0), _line (of its file, from 1), record (its text), n (in its file, from 0: the header, if there is one, has _row null)."""

    def lines(k: int, source) -> DataFrame:
        where = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
        return spark.read.text(source, lineSep="\n").select(F.lit(k).alias("sheet"), *where, "value")

    ship(spark)
    every = reduce(DataFrame.unionByName, [lines(k, p) for k, p in enumerate(paths)])
    begins, cut = scan(every.mapInArrow(_summed(delimiter), _SUMMARY).collect(), header)
    shared = spark.sparkContext.broadcast(begins)
    out = every.mapInArrow(_joined(shared, delimiter, False), _JOINED).drop("start")
    if cut:
        across = every.where(F.col("path").isin(cut)).mapInArrow(_joined(shared, delimiter, True), _JOINED)
        piece = F.sort_array(F.collect_list(F.struct("start", "record")))
        out = out.unionByName(across.groupBy("before", "n").agg(F.min("_line").alias("_line"), F.array_join(F.transform(piece, lambda p: p["record"]), "\n").alias("record")))
    return out.select(F.when(F.col("n") >= int(header), F.col("before") + F.col("n") - int(header)).alias("_row"), "_line", "n", "record")


def read_quoted_csv(spark: SparkSession, *paths: str, schema: str | None = None, header: bool = True, delimiter: str = ",") -> DataFrame:
    """The columns of schema (or of the first file's header, as text), with _row and _line."""
    found = records(spark, *paths, header=header, delimiter=delimiter)
    if schema is None:
        if not header:
            raise ValueError("without a header a schema must say what the columns are")
        top = found.where("n = 0").orderBy("_line").limit(1).collect()
        names = next(csv.reader(io.StringIO(top[0]["record"], newline=""), delimiter=delimiter)) if top else []
        schema = ", ".join(f"`{c}` string" for c in names)
    parsed = found.where(F.col("_row").isNotNull()).select("_row", "_line", F.from_csv("record", schema, {"escape": '"', "sep": delimiter, "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"))
    return parsed.select("r.*", "_row", "_line")
