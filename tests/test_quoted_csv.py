"""The splittable CSV reader against Spark's own, whole-file one."""

import os
import random

import pytest

from movewise.operators import clean
from movewise.sources import invoices, quoted_csv, store

SCHEMA = "a string, b string, c string"


def plain(spark, *paths, header=True):
    out = []
    for path in paths:
        for name in sorted(os.listdir(path)) if os.path.isdir(path) else [None]:
            out += [tuple(r) for r in spark.read.csv(f"{path}/{name}" if name else path, schema=SCHEMA, header=header, multiLine=True, escape='"').collect()]
    return out


def split(spark, size, *paths, header=True):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = quoted_csv.read_quoted_csv(spark, *paths, schema=SCHEMA, header=header)
        rows = sorted(df.collect(), key=lambda r: r["_row"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["_row"] for r in rows] == list(range(len(rows)))
    return [(r["a"], r["b"], r["c"]) for r in rows], [r["_line"] for r in rows]


def field(rng):
    kind = rng.random()
    inner = "".join(rng.choice(['""', ",", "\n", "x", "y z", "é", "\n\n", " "]) for _ in range(rng.randint(0, 9)))
    if kind < 0.5:
        return f'"{inner}"'
    return rng.choice(["", "plain", '5" pipe', " padded ", 'a""b', "'", "漢"])


@pytest.mark.parametrize(("newline", "last"), [("\n", True), ("\r\n", False)])
def test_same_rows_whatever_the_splits(spark, tmp_path, newline, last):
    rng = random.Random(len(newline))
    text = newline.join(["a,b,c", *[",".join([str(k), *(field(rng).replace("\n", newline) for _ in range(2))]) for k in range(200)]]) + (newline if last else "")
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    want = plain(spark, str(path))
    assert len(want) == 200
    for size in (200, 1000, 10**6):
        assert split(spark, size, str(path))[0] == want


def test_a_field_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {k}, with a comma" for k in range(120))
    (tmp_path / "x.csv").write_text(f'a,b,c\n1,"{long}",z\n\n2,"y",\n')
    rows, lines = split(spark, 90, str(tmp_path / "x.csv"))
    assert rows == [("1", long, "z"), ("2", "y", None)]
    assert lines == [2, 123]


def test_sheets_in_order(spark, tmp_path):
    for k, folder in enumerate(("second", "first")):
        os.makedirs(tmp_path / folder)
        for part in range(3):
            (tmp_path / folder / f"part-{part}.csv").write_text("a,b,c\n" + "".join(f'{k}{part}{i},"u\nv",w\n' for i in range(5)) if part != 1 else "a,b,c\n")
    paths = [str(tmp_path / "second"), str(tmp_path / "first")]
    assert split(spark, 20, *paths)[0] == plain(spark, *paths)
    assert split(spark, 20, paths[0], header=False)[0] == plain(spark, paths[0], header=False)


def test_marks_empty_files_and_odd_ends(spark, tmp_path):
    for name, text in {"mark": '\ufeff"a",b,c\n1,2,3\n', "empty": "", "head": "a,b,c\n", "open": 'a,b,c\n1,"never closed\n2,3', "blank": "\n\na,b,c\n\n1,,\n\n", "loose": 'a,b,c\n1,"ab"cd\n2,x"y\n3," q" ,r\n'}.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode())
        for size in (5, 1000):
            assert split(spark, size, str(path))[0] == plain(spark, str(path)), name


def test_columns_of_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,"a ""name"", with\nbreak",z\n1,2,3\n')
    df = quoted_csv.read_quoted_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["id", 'a "name", with\nbreak', "z", "_row", "_line"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3", 0, 3)]
    with pytest.raises(ValueError):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "x.csv"), header=False)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n" + "".join(f'{i},"u\nv",w\n' for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert quoted_csv.records(spark, str(tmp_path / "x.csv")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_rows_in_file_order(spark, tmp_path):
    """The first row of a key stays, not the least one, from CSV and from Parquet."""
    rows = [("2026-01-01", "K1", "9", "1"), ("2026-01-01", "K2", "5", "1"), ("2026-01-01", "K1", "1", "1")]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "fact_kam_targets.csv").write_text("date,kam_id,sales_target,order_target\n" + "".join(",".join(r) + "\n" for r in rows))
    spark.createDataFrame(rows, "date string, kam_id string, sales_target string, order_target string").coalesce(1).write.parquet(str(tmp_path / "parquet" / "fact_kam_targets.parquet"))
    for kind in ("csv", "parquet"):
        table = store.load_dataset(spark, str(tmp_path / kind), typed=True, ordered=True)["fact_kam_targets"]
        assert {(r["kam_id"], r["sales_target"]) for r in clean.keep_first(table, ["date", "kam_id"]).collect()} == {("K1", 9.0), ("K2", 5.0)}
    assert store.load_dataset(spark, str(tmp_path / "csv"))["fact_kam_targets"].columns == ["date", "kam_id", "sales_target", "order_target"]


def test_invoice_lines_across_splits(spark, tmp_path):
    line = '{k},A{k},"two\nlines, ""quoted""",1,2010-12-01 08:26:00,2.5,17850.0,United Kingdom\n'
    (tmp_path / "x.csv").write_text(",".join(invoices.RAW) + "\n" + "".join(line.format(k=k) for k in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = invoices.read_raw(spark, str(tmp_path / "x.csv"), str(tmp_path / "x.csv")).orderBy("_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["_row"], r["Invoice"], r["Description"]) for r in rows] == [(k, str(k % 200), 'two\nlines, "quoted"') for k in range(400)]


def test_line_states():
    for line, ends in {"a,b": (False, True), 'a,"b': (True, False), '"': (True, False), '""': (False, True), 'x"y': (False, False), '","': (False, True), '"a""': (True, False), 'a,"b""c",d': (False, False)}.items():
        got = quoted_csv.line_ends_inside(line, False), quoted_csv.line_ends_inside(line, True)
        assert got[0] == ends[0], line
