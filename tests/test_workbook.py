"""Workbooks written and read back, sheets of other writers, and what a sheet cannot hold."""

import datetime as dt
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from movewise.sources import store, workbook

ODD = 'a "b" <c> & é\n line _x000D_ \x01 \r '


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, f"name {k}" if k % 7 else ODD, k / 8 if k % 5 else None, k % 2 == 0, dt.date(2024, 1, 1) + dt.timedelta(k), dt.datetime(2024, 5, 6, 7, 8, k % 60), [str(k), "x"] if k % 3 else None) for k in range(300)]
    return spark.createDataFrame(rows, "k long, name string, fill_rate double, flag boolean, date date, at timestamp, tags array<string>").repartitionByRange(5, "k").sortWithinPartitions("k")


def test_round_trip(spark, tmp_path, table):
    path = str(tmp_path / "book.xlsx")
    workbook.write_workbook({"First [1]": table, "Nothing": table.where("k < 0"), "Third": table.select("k").limit(3)}, path, workbook.Cover("Title & more", "What it is", ["note one"]), {"Third": "About these rows"})
    assert list(workbook.Book(path).sheets) == ["Read me", "First -1-", "Nothing", "Third"]
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]
    for size in (17, 1000):
        back = workbook.read_sheet(spark, path, "First -1-", ordered=True, rows_per_task=size)
        assert back.rdd.getNumPartitions() == (18 if size == 17 else 1)
        got = [tuple(r) for r in back.orderBy("_row").collect()]
        want = [(str(r["k"]), r["name"], None if r["fill_rate"] is None else repr(r["fill_rate"]), str(r["flag"]).lower(), r["date"].isoformat(), str(r["at"]), None if r["tags"] is None else "; ".join(r["tags"]), r["k"] + 2) for r in table.orderBy("k").collect()]
        assert got == want
    none = workbook.read_sheet(spark, path, "Nothing")
    assert none.columns == table.columns and none.count() == 0
    assert [r["k"] for r in workbook.read_sheet(spark, path, "Third", header_row=3).collect()] == ["0", "1", "2"]
    assert store.load_table(spark, path).columns == ["Title & more"]
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_sheet(spark, path, "Fourth").count()


def test_numbers_are_shown_by_their_meaning(spark, tmp_path):
    for column, shown in {"net_sales": "#,##0.00", "fill_rate": "0.000", "change_pct": "0.0%", "wape": "0.000", "order_count": "#,##0", "attainment": "0.0%", "sales_target": "#,##0.00", "share": None, "shareholders": None, "x_units": "#,##0"}.items():
        assert workbook.number_format(column) == shown
    path = str(tmp_path / "x.xlsx")
    spark.range(2).select(F.lit(0.5).alias("fill_rate"), F.lit(1.5).alias("other"), F.lit("a").alias("name_rate")).write.format(workbook.NAME).mode("append").save(path)
    with zipfile.ZipFile(path) as z:
        assert {n for n in z.namelist()} >= {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/styles.xml", "xl/worksheets/sheet1.xml"}
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert '<c r="A2" s="3"><v>0.5</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="inlineStr">' in sheet and 'ySplit="1"' in sheet and '<autoFilter ref="A1:C3"/>' in sheet
        formats = ElementTree.fromstring(z.read("xl/styles.xml"))
        codes = {e.get("numFmtId"): e.get("formatCode") for e in formats.iter() if e.tag.endswith("numFmt")}
        shown = [e.get("numFmtId") for e in next(x for x in formats if x.tag.endswith("cellXfs"))]
        assert codes[shown[3]] == "0.000" and codes[shown[2]] == "0.0%" and shown[1] == "4" and shown[4] == "3"


def test_sheets_of_other_writers(spark, tmp_path):
    """Shared and formatted strings, prefixed tags, unknown attributes, styles of dates, errors, formulas, missing references, no dimension."""
    path = str(tmp_path / "other.xlsx")
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<x:workbook xmlns:x="{main}" xmlns:r="{link}"><x:workbookPr date1904="1"/><x:sheets><x:sheet name="Data" sheetId="1" r:id="a1"/></x:sheets></x:workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a1" Target="/xl/worksheets/s.xml"/></R>')
        z.writestr("xl/styles.xml", f'<s xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="[Red]0.0&quot;days&quot;"/><numFmt numFmtId="171" formatCode="d/m/yy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></s>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>wh</t></r><r><t>en</t></r><rPh><t>no</t></rPh></si><si><t xml:space="preserve"> x </t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f"""<x:worksheet xmlns:x="{main}" xmlns:q="other"><x:sheetData>
<x:row r="1" q:d="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="B1" t="s"><x:v>1</x:v></x:c><x:c r="D1" t="str"><x:f>A1</x:f><x:v>d</x:v></x:c></x:row>
<x:row r="3"><x:c r="A3"><x:v>1.50</x:v></x:c><x:c r="B3" s="1"><x:v>0.5</x:v></x:c><x:c r="C3" t="e"><x:v>#N/A</x:v></x:c><x:c r="D3" t="s"><x:v>2</x:v></x:c></x:row>
<x:row r="4"/><x:row r="5"><x:c t="b"><x:v>1</x:v></x:c><x:c s="3"><x:v>10</x:v></x:c><x:c s="2"><x:v>7</x:v></x:c></x:row>
<x:row r="6"><x:c r="A6" t="e"><x:v>#REF!</x:v></x:c></x:row></x:sheetData></x:worksheet>""")  # fmt: skip
    df = workbook.read_sheet(spark, path, ordered=True)
    assert df.columns == ["id", "when", "Unnamed: 2", "d", "_row"]
    assert [tuple(r) for r in df.collect()] == [("1.50", "12:00:00", None, " x ", 3), ("true", "1904-01-11", "7", None, 5)]


def test_dates():
    assert workbook.from_serial(45292.0) == "2024-01-01" and workbook.from_serial(45292.5) == "2024-01-01 12:00:00" and workbook.from_serial(1) == "1900-01-01" and workbook.from_serial(61) == "1900-03-01"
    for moment in (dt.datetime(2024, 2, 29, 23, 59, 59), dt.datetime(1999, 12, 31), dt.date(2030, 7, 1)):
        assert workbook.from_serial(workbook.to_serial(moment)) == (str(moment) if getattr(moment, "hour", 0) else moment.strftime("%Y-%m-%d"))
    assert [workbook.is_date_format(c) for c in ("yyyy-mm-dd", "0.00", '0 "days"', "[h]:mm", "General", "#,##0_);[Red]")] == [True, False, False, True, False, False]


def test_a_sheet_that_is_too_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 100)
    with pytest.raises(ValueError, match="holds 99"):
        workbook.write_workbook({"x": spark.range(100).toDF("k")}, str(tmp_path / "x.xlsx"))
    assert list(tmp_path.iterdir()) == []


def test_columns():
    assert [workbook.column_of(f"{workbook.column_name(k)}9") for k in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]
