from movewise.plans import display


def test_labels_and_words(spark):
    df = spark.createDataFrame([("ses", "x_y", "up", 1.0, 2.0, 3)], "model string, likely_driver string, direction string, movement double, change double, some_thing int")
    got = display.labelled(display.in_words(df))
    assert got.columns == ["Method", "Likely driver", "Direction", "Change", "Change (change)", "Some thing"]
    assert tuple(got.first()) == ("Weighted recent average", "X y", "Up", 1.0, 2.0, 3)
    assert {r["term"] for r in display.glossary(spark, ["fill_rate", "variance", "nothing"]).collect()} == {"Fill rate", "Gap"}
    assert set(display.GLOSSARY) <= set(display.COLUMNS.values())


def test_names_for_codes(spark):
    tables = {"dim_kam": spark.createDataFrame([("K1", "Ada"), (None, "nobody")], "kam_id string, kam_name string"), "dim_region": spark.createDataFrame([("R1", "Rome"), ("K1", "other")], "region_code string, city string")}
    df = spark.createDataFrame([("R1 | K1", "K1", "R1", 1), ("R1|K9", "K9", None, 2), (None, None, "R2", 3)], "segment string, kam_id string, region_code string, v int")
    got = sorted((tuple(r) for r in display.for_readers(df, tables).collect()), key=lambda r: r[3])
    assert got == [("Rome · Ada", "Ada", "Rome", 1), ("Rome · K9", "K9", None, 2), (None, None, "R2", 3)]
