import json
import random

import pytest
from pyspark.sql import functions as F

from pagefold.functions import scores, visuals
from pagefold.functions.text import is_full_width, scope_text_score
from pagefold.operators import annotations, evidence, instances, panels, reports
from pagefold.operators.boxjoin import box_join, dense_pages
from pagefold.sources import textdict

ELEMENT = "page_idx bigint, ord int, kind string, x0 double, y0 double, x1 double, y1 double, text string, source string, clipped boolean"


def test_text_atoms_split_parallel_captions(spark):
    line = lambda text, y, bbox=True: {"bbox": [0, y, 50, y + 10] if bbox else None, "spans": [{"text": text[:3], "size": 9, "font": "A"}, {"text": text[3:], "size": 9, "font": "A"}]}
    page = {"blocks": [{"type": 0, "number": 4, "bbox": [0, 0, 90, 30], "lines": [line("Figure 1: a", 0), line("  ", 10), line("Fig. 2 b", 20)]}, {"type": 1, "number": 5, "bbox": [0, 0, 1, 1]}, {"type": 0, "number": 6, "bbox": [0, 40, 90, 60], "lines": [line("Figure 3: c ", 40), line("more", 50)]}, {"type": 0, "number": 7, "bbox": None, "lines": []}, {"type": 0, "number": 8, "bbox": [1, 2], "lines": [line("x", 0, False)]}]}
    df = spark.createDataFrame([(1, json.dumps(page)), (2, "{"), (3, None), (4, "{}"), (5, '{"blocks": []}')], "page_idx bigint, payload string")
    rows = textdict.text_atoms(df).orderBy("page_idx", "ord").collect()
    assert [(r["page_idx"], r["ord"], r["text"], r["block_number"], r["split"], r["line"]) for r in rows] == [(1, 1, "Figure 1: a", 4, True, 0), (1, 2, "Fig. 2 b", 4, True, 2), (1, 3, "Figure 3: c\nmore", 6, False, None), (1, 4, "x", 8, False, None)]
    assert rows[1]["y0"] == 20.0 and rows[3]["x0"] is None
    records = {r["block"]: r for r in textdict.block_records(df, 600.0).collect()}
    assert set(records) == {1, 2, 4} and records[1]["chars"] == 19 and not records[1]["is_single_line"] and records[4]["is_single_line"] and records[4]["x0"] is None
    assert records[2]["block_width_ratio"] == 1.0 and records[2]["line_spacing_ratio"] == round(10 / 9, 4)


@pytest.mark.parametrize(
    "text,want",
    [
        (None, (False, False, False, 0.0)), ("", (False, False, False, 0.0)), ("Figure 2. Overview", (False, False, True, 0.0)), ("Table 3", (False, False, True, 0.0)), ("3 / 12", (False, False, True, 0.95)),
        ("x y", (True, False, False, 0.95)), ("0 10 20 30", (True, False, False, 0.95)), ("Speed (km/h)", (True, False, False, 0.95)), ("(a)", (True, False, False, 0.95)), ("42", (False, False, False, 0.85)), ("b", (False, False, False, 0.75)),
        ("2.1 Methods", (False, False, True, 0.12)), ("the body text of a page that goes on and on", (False, False, True, 0.0)), ("a = b + c d e f g h", (False, False, True, 0.0)),
        ("项目名称", (False, True, True, 0.6)), ("GPT-4V answers", (False, True, True, 0.35)),
    ],
)
def test_annotation_rules(spark, text, want):
    r = annotations.annotation_rules(spark.createDataFrame([(text, "kept")], "t string, axis_of string"), "t").first()
    assert (r["axis"], r["table_cell"], r["excluded"], r["support"]) == want and r["axis_of"] == "kept"
    assert not r["annotates"] or (r["label"] and not r["excluded"])


def test_annotation_rules_on_long_and_empty_tables(spark):
    long = "word 1 " * 200_000
    df = spark.createDataFrame([(long,), (long,)], "t string")
    assert {(r["axis"], r["annotates"], r["excluded"]) for r in annotations.annotation_rules(df, "t").collect()} == {(False, False, True)}
    assert annotations.annotation_rules(df.limit(0), "t").count() == 0


def test_panels_of_a_page(spark):
    rows = [
        (1, 1, "panel_border", 50.0, 50.0, 250.0, 200.0, None, "made", False), (1, 2, "raster_image", 60.0, 60.0, 150.0, 150.0, None, "xref", False), (1, 3, "raster_image", 160.0, 60.0, 240.0, 150.0, None, "text_dict", False),
        (1, 4, "text_block", 60.0, 210.0, 240.0, 225.0, "Figure 7: two images", None, None), (2, 1, "color_band", 10.0, 10.0, 210.0, 30.0, None, None, None), (2, 2, "color_band", 11.0, 300.0, 211.0, 320.0, None, None, None),
        (2, 3, "vector_cluster", 12.0, 35.0, 209.0, 290.0, None, None, None), (3, 1, "raster_image", None, 0.0, 10.0, 10.0, None, None, None), (4, 1, "raster_image", 50.0, 300.0, 450.0, 600.0, None, "xref", True),
    ]
    df = spark.createDataFrame(rows, ELEMENT)
    got = {(r["page_idx"], r["panel_kind"], r["source"]): r for r in panels.propose_panels(df, 600.0, 760.0).collect()}
    assert got[1, "border", 1]["members"] == 3 and got[1, "border", 1]["numbers"] == "7" and not got[1, "border", 1]["multi"]
    assert got[1, "image_cluster", 2]["members"] == 2 and got[1, "image_cluster", 2]["x1"] == 240.0
    assert got[2, "layout_column", 1]["members"] == 3 and got[4, "image_seed", 1]["members"] == 1
    assert not any(p == 3 and k != "border" for p, k, _ in got)
    assert panels.propose_panels(df.limit(0), 600.0, 760.0).count() == 0


def test_full_width_lines_and_scope_scores(spark):
    df = spark.createDataFrame([(20.0, 10.0, 580.0, 30.0, "12 kHz"), (20.0, 10.0, 300.0, 30.0, ""), (None, 10.0, 300.0, 30.0, "Figure 1: x"), (20.0, 10.0, 580.0, 300.0, "word " * 60)], "x0 double, y0 double, x1 double, y1 double, t string")
    got = df.select(is_full_width("", 600.0, 760.0).alias("w"), scope_text_score(F.col("t"), F.lit(20.0), F.lit(0.0), 760.0).alias("s")).collect()
    assert [r["w"] for r in got] == [True, False, False, False]  # an unknown left side is no small margin
    assert got[0]["s"] == pytest.approx(0.45 + 0.28 + 0.34 + 0.34) and got[1]["s"] == -1.0 and got[2]["s"] == -0.8 and got[3]["s"] < 0


def test_reasons_are_merged_in_order(spark):
    df = spark.createDataFrame([(1, 2, ["b", None, "a"]), (1, 1, ["c", "b"]), (1, 3, None), (2, 1, [])], "g int, o int, r array<string>")
    assert [(r["g"], r["reasons"]) for r in evidence.merged_reasons(df, "g", "o", "r").collect()] == [(1, ["c", "b", "a"])]
    assert evidence.active(df, "r").count() == 2
    assert df.select(evidence.marked(F.col("r"), F.array(F.lit("a"), F.lit("")))).first()[0] == ["b", "a"]


def test_a_dense_page_is_cut_into_cells(spark):
    rng = random.Random(4)
    rows = [(0, i, float(x), float(y), float(x + 9), float(y + 9)) for i, (x, y) in enumerate((rng.randrange(5000), rng.randrange(5000)) for _ in range(1500))] + [(1, 0, 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "page_idx bigint, ord int, x0 double, y0 double, x1 double, y1 double")
    assert [r["page_idx"] for r in dense_pages(df).collect()] == [0]
    got = box_join(df, df, reach=12.0)
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] - 12 <= b[4] and b[2] <= a[4] + 12 and a[3] - 12 <= b[5] and b[3] <= a[5] + 12}
    found = [(r["page_idx"], r["a_ord"], r["b_ord"]) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert "_cell" in got._jdf.queryExecution().optimizedPlan().toString()
    line = box_join(df, df, axes="y", where=F.col("a_ord") < F.col("b_ord")).count()
    assert line == sum(1 for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] <= b[5] and b[3] <= a[5])


def test_scores_of_unknown_boxes_are_unknown(spark):
    df = spark.createDataFrame([(None, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0)], ", ".join(f"{p}{c} double" for p in "ab" for c in ("x0", "y0", "x1", "y1")))
    r = df.select(scores.side_loss("a", "b").alias("l"), scores.same_row_affinity("a", "b").alias("r"), scores.retained("a", "b").alias("k"), visuals.is_background("a", 600.0, 760.0).alias("g"), instances.promotion_score("a", "b", F.lit(False)).alias("p")).first()
    assert r["l"] is None and r["k"] is None and not r["g"]


def test_instances_without_visuals_are_compared_by_box(spark):
    df = spark.createDataFrame([(1, 1, 5, [], 0.0, 0.0, 10.0, 10.0), (1, 2, 4, [], 0.0, 0.0, 10.0, 10.0), (1, 3, 4, [7], 0.0, 0.0, 10.0, 8.0), (1, 4, 3, [7], 0.0, 0.0, 10.0, 7.0), (2, 1, 1, None, 0.0, 0.0, 1.0, 1.0)], "page_idx int, ord int, score int, visuals array<int>, x0 double, y0 double, x1 double, y1 double")
    assert {(r["page_idx"], r["ord"]) for r in instances.distinct_instances(df).collect()} == {(1, 1), (1, 3), (2, 1)}
    assert instances.distinct_instances(df.limit(0)).count() == 0


def test_reports_of_nothing(spark):
    pages = spark.createDataFrame([], "page_idx int, gt_count int, prediction_count int, fragmentation double, contamination double, overmerge double, completeness double, match_count int, f1 double")
    r = reports.benchmark_means(pages).first()
    assert r["page_count"] == 0 and r["total_gt_count"] == 0 and r["mean_completeness"] == 0.0
    assert reports.page_problems(pages).count() == 0
    timed = reports.timing(spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), (None, 2.0)], "k string, v double"), "v", "k")
    assert {(r["k"], r["count"], r["p50"], r["p95"]) for r in timed.collect()} == {("a", 2, 2.5, 3.85), (None, 1, 2.0, 2.0)}
