import json

import pytest
from pyspark.errors import AnalysisException

from pagefold.operators.drift import declared_of, departures, file_headers
from pagefold.sources import files
from pagefold.streaming.arrivals import departure_stream, windowed_timings, write_available


def test_label_and_prediction_files_are_read(spark, tmp_path):
    page = {"page_idx": 3, "page_label": "x", "figures": [{"figure_id": "a", "bbox": [0, 0, 10, 10], "logical_group_id": "g", "panel_bboxes": [[0, 0, 1, 1]], "caption_bbox": None}, {"figure_id": "b", "bbox": [1, 2]}]}
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "p_1.json").write_text(json.dumps(page, indent=1))
    rows = files.label_figures(files.read_label_pages(spark, str(tmp_path / "gt"))).orderBy("ord").collect()
    assert [(r["page_id"], r["figure_id"], r["x1"], r["panels"], r["has_caption"]) for r in rows] == [("p_1", "a", 10.0, 1, False), ("p_1", "b", None, 0, False)]
    run = tmp_path / "run" / "pages" / "page_007"
    run.mkdir(parents=True)
    (run / "figures.json").write_text(json.dumps([{"figure_id": "z", "bbox": [0, 0, 2, 2]}, {"figure_id": "y", "bbox": [0, 0, 2, 2], "page_idx": 9}]))
    assert [(r["page_idx"], r["figure_id"]) for r in files.read_predictions(spark, str(tmp_path / "run")).orderBy("ord").collect()] == [(7, "z"), (9, "y")]


def test_index_and_content_lists_are_read(spark, tmp_path):
    (tmp_path / "index.csv").write_text("page_id,candidate_id,doc_id,page_idx,page_label,figure_family,difficulty,classification_confidence,overlay_path,page_dir,shortlist_reason\njm_1,c,d,1,l,f,x,0.5,,p,\"a, \"\"b\"\"\"\n")
    row = files.read_index(spark, str(tmp_path / "index.csv")).first()
    assert (row["page_id"], row["overlay_path"], row["shortlist_reason"]) == ("jm_1", None, 'a, "b"')
    (tmp_path / "a.json").write_text('[{"type": "Image", "page_idx": 1}, {"type": "text", "text": "t"}]')
    (tmp_path / "b.json").write_text('{"content_list": [{"type": "image", "bbox": [1, 2, 3, 4]}]}')
    (tmp_path / "c.json").write_text("{broken")
    got = files.read_content_list(spark, str(tmp_path / "*.json")).orderBy("path", "ord").collect()
    assert [(r["type"], r["page_idx"], r["bbox"]) for r in got] == [("image", 1, None), ("text", None, None), ("image", None, [1, 2, 3, 4])]


def test_tables_are_never_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "page_idx int, ord int")
    files.write_stage(df, str(tmp_path / "t"), "page_idx")
    with pytest.raises(AnalysisException):
        files.write_stage(df, str(tmp_path / "t"))
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["ord"] == "2"


def test_contract_and_report(spark):
    figures = spark.createDataFrame([(1, 2, "b", None, 0.0, 0.0, 2.0, 2.0), (1, 1, "a", "g", 0.0, 0.0, 1.0, 1.0)], "page_idx int, ord int, figure_id string, group_id string, x0 double, y0 double, x1 double, y1 double")
    record = json.loads(files.page_contract(figures).first()["record"])
    assert [(i["figure_id"], i["logical_group_id"]) for i in record["images"]] == [("a", "g"), ("b", "b")]
    rows = spark.createDataFrame([("x", 2, 0.5, 0.5, 0.5), ("y", 1, 1.0, 1.0, 1.0), (None, 3, 0.0, 0.0, 0.0)], "family string, page_count int, precision double, recall double, f1 double")
    text = files.group_report(rows, "By family", "family").first()["value"]
    assert text.index("| y |") < text.index("| x |") and "0.5000" in text


def test_a_stream_finds_what_a_batch_finds(spark, small, tmp_path):
    declared = declared_of(spark.read.parquet(f"{small}/declared_fields.parquet"), "gt")
    batch = spark.read.parquet(f"{small}/gt_files.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        write_available(departure_stream(stream, declared, inner="figures"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    want = departures(file_headers(batch, "file_path", "body", "figures"), declared, "file_path")
    key = lambda df: sorted(map(str, df.select("file_path", "holder", "at", "field_name", "change_type", "found").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want)


def test_windows_close_after_the_watermark(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    write_available(windowed_timings(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.agg({"count": "sum"}).first()[0] <= events.count()
