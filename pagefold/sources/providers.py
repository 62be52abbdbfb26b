"""Layout payloads of four kinds of provider, read into boxes in page space.

Kind a: ``result.layoutParsingResults[0].prunedResult`` with ``parsing_res_list`` of ``block_label`` and ``block_bbox``;
b: ``pages[0]`` with ``dimensions`` and ``images`` of four corners; c: ``layout_details[0]`` of ``label``, ``bbox_2d`` and own
sizes; d: ``json.children``, a tree of ``block_type`` and ``bbox``. Payloads come as ``page_idx, payload``; what can't be
read gives no row. Figures are numbered in the order of the payload. Calling a provider is outside this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.geometry import scaled

PAYLOADS = {
    "a": "result struct<layoutParsingResults: array<struct<prunedResult: struct<width: double, height: double, parsing_res_list: array<struct<block_label: string, block_bbox: array<double>>>>>>>",
    "b": "pages array<struct<dimensions: struct<width: double, height: double>, images: array<struct<top_left_x: double, top_left_y: double, bottom_right_x: double, bottom_right_y: double>>>>",
    "c": "layout_details array<array<struct<label: string, bbox_2d: array<double>, width: double, height: double>>>",
}
#: Levels of the tree that kind d may have.
MAX_DEPTH = 64


def _boxes(rows: DataFrame, box: Column, w: Column, h: Column, page_w: float, page_h: float) -> DataFrame:
    """Scaled boxes of exploded items (``page_idx, at``), numbered per page."""
    from pyspark.sql import Window

    corners = tuple(F.get(box, F.lit(i)) for i in range(4))
    put = scaled(corners, F.coalesce(w, F.lit(0.0)), F.coalesce(h, F.lit(0.0)), F.lit(page_w), F.lit(page_h))
    whole = rows.where((F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull()))
    return whole.select("page_idx", F.row_number().over(Window.partitionBy("page_idx").orderBy("at")).alias("figure"), *[c.alias(n) for c, n in zip(put, ("x0", "y0", "x1", "y1"), strict=True)])


def parse_a(payloads: DataFrame, page_w: float, page_h: float) -> DataFrame:
    p = payloads.select("page_idx", F.get(F.from_json("payload", PAYLOADS["a"])["result"]["layoutParsingResults"], F.lit(0))["prunedResult"].alias("p"))
    rows = p.select("page_idx", "p.width", "p.height", F.posexplode("p.parsing_res_list").alias("at", "i")).where("i.block_label = 'image'")
    return _boxes(rows, F.col("i.block_bbox"), F.col("width"), F.col("height"), page_w, page_h)


def parse_b(payloads: DataFrame, page_w: float, page_h: float) -> DataFrame:
    p = payloads.select("page_idx", F.get(F.from_json("payload", PAYLOADS["b"])["pages"], F.lit(0)).alias("p"))
    rows = p.select("page_idx", "p.dimensions", F.posexplode("p.images").alias("at", "i"))
    box = F.array("i.top_left_x", "i.top_left_y", "i.bottom_right_x", "i.bottom_right_y")
    return _boxes(rows, box, F.col("dimensions.width"), F.col("dimensions.height"), page_w, page_h)


def parse_c(payloads: DataFrame, page_w: float, page_h: float) -> DataFrame:
    p = payloads.select("page_idx", F.get(F.from_json("payload", PAYLOADS["c"])["layout_details"], F.lit(0)).alias("p"))
    rows = p.select("page_idx", F.posexplode("p").alias("at", "i")).where("i.label = 'image' AND i.width IS NOT NULL AND i.height IS NOT NULL")
    return _boxes(rows, F.col("i.bbox_2d"), F.col("i.width"), F.col("i.height"), page_w, page_h)


def parse_d(payloads: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """A walk down the tree, level by level; the path of positions restores its order. The first Page block gives the scale. Trees of more than MAX_DEPTH levels are refused."""
    node = lambda v: F.try_variant_get(v, "$.children", "array<variant>")
    start = payloads.select("page_idx", F.try_parse_json("payload").alias("v"))
    level = start.select("page_idx", F.posexplode(F.try_variant_get("v", "$.json.children", "array<variant>")).alias("n", "v")).select("page_idx", F.array("n").alias("at"), "v")
    walked = None
    for depth in range(MAX_DEPTH):
        own = level.select("page_idx", "at", F.try_variant_get("v", "$.block_type", "string").alias("type"), F.try_variant_get("v", "$.bbox", "array<double>").alias("bbox"))
        walked = own if walked is None else walked.unionByName(own)
        level = level.select("page_idx", "at", F.posexplode(node(F.col("v"))).alias("n", "w")).select("page_idx", F.concat("at", F.array("n")).alias("at"), F.col("w").alias("v"))
        if depth >= 2 and level.isEmpty():
            break
    else:
        if not level.isEmpty():
            raise ValueError(f"a tree has more than {MAX_DEPTH} levels")
    sheet = walked.where("type = 'Page' AND size(bbox) = 4").groupBy("page_idx").agg(F.min_by("bbox", "at").alias("_b"))
    rows = walked.where("type = 'Picture'").join(sheet, "page_idx", "left")
    return _boxes(rows, F.col("bbox"), F.col("_b")[2] - F.col("_b")[0], F.col("_b")[3] - F.col("_b")[1], page_w, page_h)


PARSERS = {"a": parse_a, "b": parse_b, "c": parse_c, "d": parse_d}


def payloads(atoms: DataFrame, kind: str) -> DataFrame:
    """Payloads of each kind made of atoms, in a space twice the page's: to read back what was written."""
    double = [(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    image = F.when(F.col("kind") == "raster_image", "image").otherwise("text").alias("label")
    a = atoms.select("page_idx", F.struct("ord", image, F.array(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"), *double).alias("i"))
    items = a.groupBy("page_idx").agg(F.sort_array(F.collect_list("i")).alias("items"))
    size = lambda w, h: F.struct(F.lit(1200.0).alias(w), F.lit(1520.0).alias(h))
    only = F.filter("items", lambda i: i["label"] == "image")
    if kind == "a":
        body = F.struct(F.struct(F.array(F.struct(F.struct(F.lit(1200.0).alias("width"), F.lit(1520.0).alias("height"), F.transform("items", lambda i: F.struct(i["label"].alias("block_label"), i["box"].alias("block_bbox"))).alias("parsing_res_list")).alias("prunedResult"))).alias("layoutParsingResults")).alias("result"))
    elif kind == "b":
        body = F.struct(F.array(F.struct(size("width", "height").alias("dimensions"), F.transform(only, lambda i: F.struct(i["x0"].alias("top_left_x"), i["y0"].alias("top_left_y"), i["x1"].alias("bottom_right_x"), i["y1"].alias("bottom_right_y"))).alias("images"))).alias("pages"))
    elif kind == "c":
        body = F.struct(F.array(F.transform("items", lambda i: F.struct(i["label"], i["box"].alias("bbox_2d"), F.lit(1200.0).alias("width"), F.lit(1520.0).alias("height")))).alias("layout_details"))
    else:
        leaf = lambda i: F.struct(F.when(i["label"] == "image", "Picture").otherwise("Text").alias("block_type"), i["box"].alias("bbox"))
        page = F.struct(F.lit("Page").alias("block_type"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1200.0), F.lit(1520.0)).alias("bbox"), F.transform("items", lambda i: F.struct(F.lit("Group").alias("block_type"), F.array(leaf(i)).alias("children"))).alias("children"))
        body = F.struct(F.struct(F.array(page).alias("children")).alias("json"))
    return items.select("page_idx", F.to_json(body).alias("payload"))
