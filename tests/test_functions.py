import pytest
from pyspark.sql import functions as F

from pagefold.functions import geometry as g
from pagefold.functions import spelling as s
from pagefold.functions import text as t

BOX_PAIR = "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "key"),
    [
        ("02_2402_234577v1", "2402_234577"), ("2402-234577", "2402_234577"), ("PBANK_2402.234577V12", "2402_234577"), ("pbank_07_2402_234577", "2402_234577"), ("2402_2345771v1", "2402_2345771"), ("02_2402_23457", "02_2402_23457"),
        ("adit_seepage_x_2024", "adit_seepage_x_2024"), ("PBANK_Adit.Seepage-X_2024", "adit_seepage_x_2024"), ("03_adit_seepage_x_2024v2", "adit_seepage_x_2024"), ("adit_v2_2024", "adit_v2_2024"), ("", None), ("  ", None), (None, None),
    ],
)
def test_paper(spark, text, key):
    assert one(spark, text, s.paper) == key


@pytest.mark.parametrize(("path", "key"), [("a/b", "a/b"), (" ./a//b/ ", "a/b"), (".\\a\\.\\b", "a/b"), ("/a/././b/.", "a/b"), ("a/.b/..", "a/.b/.."), ("A/b", "A/b"), (" \t", None), (None, None), ("/", "")])
def test_place(spark, path, key):
    assert one(spark, path, s.place) == key


@pytest.mark.parametrize(("text", "key"), [("Route map-or_Flow ", "route_map_or_flow"), ("UNKNOWN", None), (" ", None), (None, None)])
def test_label(spark, text, key):
    assert one(spark, text, s.label) == key


@pytest.mark.parametrize(
    ("text", "value"),
    [("0.65", 0.65), ("0,6", 0.6), ("65 %", 0.65), ("56.7%", 0.567), ("9.000e-01", 0.9), (".4", 0.4), ("1.000e+00", 1.0), ("120%", None), ("99", None), ("-0.4", None), ("NaN", None), ("n/a", None), ("", None), (None, None), ("1e400", None), ("5e1%", 0.5)],
)
def test_confidence(spark, text, value):
    got = one(spark, text, s.confidence)
    assert (None if got is None else float(got)) == value


def test_equal_confidences_are_equal_however_written(spark):
    rows = spark.createDataFrame([(x,) for x in ("0.567", "56.7 %", "5.67e-1", "0,567")], "v string")
    assert rows.select(s.confidence("v").alias("c")).distinct().count() == 1


def measures(spark, a, b):
    row = spark.createDataFrame([(*map(float, a), *map(float, b))], BOX_PAIR)
    return row.select(*[f("a_", "b_").alias(f.__name__) for f in (g.iou, g.cover_of_first, g.cover_of_smaller, g.inter_area, g.gap, g.ranges_touch, g.same_row)]).first()


def test_measures_of_boxes(spark):
    r = measures(spark, (0, 0, 10, 10), (5, 5, 15, 15))
    assert round(r["iou"], 4) == 0.1429 and r["inter_area"] == 25 and r["cover_of_first"] == 0.25 and r["gap"] == 0
    r = measures(spark, (0, 0, 10, 10), (10, 0, 20, 40))
    assert r["iou"] == 0 and r["ranges_touch"] and r["same_row"]
    r = measures(spark, (0, 0, 10, 10), (2, 2, 4, 4))
    assert r["cover_of_first"] == 0.04 and r["cover_of_smaller"] == 1
    assert measures(spark, (0, 0, 3, 3), (6, 7, 9, 9))["gap"] == 5
    assert measures(spark, (0, 0, 0, 0), (0, 0, 0, 0))["iou"] == 0


def test_a_null_side_makes_measures_null(spark):
    row = spark.createDataFrame([(None, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0)], BOX_PAIR)
    got = row.select(*[f("a_", "b_").alias(f.__name__) for f in (g.iou, g.cover_of_first, g.cover_of_smaller, g.inter_area, g.gap, g.ranges_touch)]).first()
    assert not any(got)


@pytest.mark.parametrize(
    ("line", "role", "number"),
    [
        ("Figure 3.2: Overview", "figure_caption", "3.2"), ("FIG. 4-1", "figure_caption", "4-1"), ("图2A 结构", "figure_caption", "2A"), ("(b)", "subfigure_label", None), ("as in Fig 9 above", "body_reference", "9"), ("Figure 5: " + "x" * 600, "body_reference", "5"), ("Figures of speech", None, None), ("", None, None), (None, None, None),
    ],
)
def test_text_role(spark, line, role, number):
    got = one(spark, line, t.text_role)
    assert (got and got["role"], got and got["number"]) == (role, number)


def test_full_width_sentence_is_no_caption(spark):
    row = spark.createDataFrame([("Figure 3 shows the load", True), ("Figure 3 shows the load", False), ("Figure 3: shows", True)], "v string, w boolean")
    assert [r[0] for r in row.select(t.text_role(F.col("v"), F.col("w"))["role"]).collect()] == ["body_reference", "figure_caption", "figure_caption"]


def test_text_measures(spark):
    row = spark.createDataFrame([("1 2 3 a b c", "x y/z:ü.pdf", "0 10 20 30"), ("", None, "words only")], "a string, b string, c string")
    got = row.select(t.numeric_share(F.col("a")).alias("n"), t.looks_like_table_row(F.col("a")).alias("t"), t.safe_stem(F.col("b")).alias("s"), t.is_scale_text(F.col("c")).alias("c")).collect()
    assert (got[0]["n"], got[0]["t"], got[0]["s"], got[0]["c"]) == (0.5, True, "x_y_z_ü.pdf", True)
    assert (got[1]["n"], got[1]["t"], got[1]["c"]) == (None, False, False)
