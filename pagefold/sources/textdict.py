"""Text dictionaries of pages as JSON: blocks of lines of spans, read into text elements and block records.

A payload is ``{"blocks": [{"type", "number", "bbox", "lines": [{"bbox", "spans": [{"text", "size", "font"}]}]}]}``; blocks
of type 0 are text. Everything about a page stays in its row until its elements come out, so nothing is shuffled. A
payload that can't be read gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.text import CAPTION
from pagefold.functions.values import computed, let
from pagefold.operators.annotations import SPACE

SPAN = "struct<text: string, size: double, font: string>"
PAYLOAD = f"blocks array<struct<type: int, number: int, bbox: array<double>, lines: array<struct<bbox: array<double>, spans: array<{SPAN}>>>>>"
SIDES = ("x0", "y0", "x1", "y1")


def _ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _spans(line: Column) -> Column:
    return F.coalesce(line["spans"], F.array().cast(f"array<{SPAN}>"))


def _line_text(line: Column) -> Column:
    return _ends(F.array_join(F.transform(_spans(line), lambda s: F.coalesce(s["text"], F.lit(""))), ""))


def _box(box: Column) -> list[Column]:
    return [F.when(F.size(box) == 4, F.get(box, F.lit(i))).alias(c) for i, c in enumerate(SIDES)]


def _blocks(payloads: DataFrame, payload: str) -> DataFrame:
    """``page_idx, _b``: the text blocks with their lines (``text``, ``bbox``, ``at``) that have text."""
    read = payloads.select("page_idx", F.filter(F.from_json(payload, PAYLOAD)["blocks"], lambda b: b["type"] == 0).alias("_raw")).where("_raw IS NOT NULL")
    lines = lambda b: F.transform(F.coalesce(b["lines"], F.array().cast(f"array<struct<bbox: array<double>, spans: array<{SPAN}>>>")), lambda l, i: F.struct(_line_text(l).alias("text"), l["bbox"].alias("bbox"), i.alias("at"), l["spans"].alias("spans")))
    return computed(read, _b=F.transform("_raw", lambda b: F.struct(b["number"].alias("number"), b["bbox"].alias("bbox"), lines(b).alias("lines")))).drop("_raw")


def text_atoms(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``page_idx, ord, x0 .. y1, text, block_number, split, line``: a text element per block, in order, numbered from 1.

    A block of two or more lines that all begin with a figure label is several captions side by side: each line is an
    element. Blocks without text fall out.
    """
    some = lambda b: F.filter(b["lines"], lambda l: l["text"] != "")
    one = lambda text, box, number, split, line: F.struct(text.alias("text"), box.alias("bbox"), number.alias("number"), F.lit(split).alias("split"), line.cast("int").alias("line"))

    def atoms(b: Column) -> Column:
        def of(lines: Column) -> Column:
            parted = (F.size(lines) >= 2) & F.forall(lines, lambda l: l["text"].rlike(CAPTION) & l["bbox"].isNotNull())
            whole = F.array(one(F.array_join(F.transform(lines, lambda l: l["text"]), "\n"), b["bbox"], b["number"], False, F.lit(None)))
            return F.when(parted, F.transform(lines, lambda l: one(l["text"], l["bbox"], b["number"], True, l["at"]))).when(F.size(lines) > 0, whole)

        return let(some(b), of)

    every = F.flatten(F.filter(F.transform("_b", atoms), lambda a: a.isNotNull()))
    out = _blocks(payloads, payload).select("page_idx", F.posexplode(every).alias("n", "a"))
    return out.select("page_idx", (F.col("n") + 1).alias("ord"), *_box(F.col("a.bbox")), "a.text", F.col("a.number").alias("block_number"), "a.split", "a.line")


def _dominant(spans: Column, field: str) -> Column:
    """The value that most characters have, the one seen first among equals; an empty span counts as one character."""
    weight = lambda v: F.aggregate(F.filter(spans, lambda s: s[field].eqNullSafe(v)), F.lit(0), lambda n, s: n + F.greatest(F.length(F.coalesce(s["text"], F.lit(""))), F.lit(1)))
    ranked = F.transform(F.array_distinct(F.transform(spans, lambda s: s[field])), lambda v, i: F.struct(weight(v).alias("w"), (-i).alias("i"), v.alias("v")))
    return F.array_max(ranked)["v"]


def block_records(payloads: DataFrame, page_w: float, payload: str = "payload") -> DataFrame:
    """``page_idx, block`` (1, 2, ... over all text blocks), a box, ``text`` and typography of each text block that has text.

    Font and size that most characters have, the variance of sizes around it, the mean distance of line tops over the
    size (1 for a single line), width over the page's widest block, characters per square point and per line, and
    whether it is a single line.
    """
    size = lambda b: F.when(F.size(b["bbox"]) == 4, F.get(b["bbox"], F.lit(2)) - F.get(b["bbox"], F.lit(0)))
    wide = _blocks(payloads, payload).withColumn("_region", F.coalesce(F.array_max(F.transform("_b", size)), F.lit(1.0)))
    rows = wide.select("page_idx", "_region", F.posexplode("_b").alias("n", "b"))
    texts, spans = F.filter(F.transform("b.lines", lambda l: l["text"]), lambda x: x != ""), F.flatten(F.transform("b.lines", _spans))
    tops = F.filter(F.transform("b.lines", lambda l: F.get(l["bbox"], F.lit(1))), lambda y: y.isNotNull())
    rows = computed(rows, _texts=texts, _spans=spans, _tops=tops).where(F.size("_texts") > 0)
    rows = computed(rows, dominant_font_size=F.coalesce(_dominant(F.col("_spans"), "size"), F.lit(0.0)), dominant_font_name=F.coalesce(_dominant(F.col("_spans"), "font"), F.lit("")), chars=F.aggregate("_texts", F.lit(0), lambda n, x: n + F.length(x)))
    count = lambda s: F.greatest(F.length(F.coalesce(s["text"], F.lit(""))), F.lit(1))
    spread = F.aggregate("_spans", F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n")), lambda a, s: F.struct((a["v"] + (s["size"] - F.col("dominant_font_size")) * (s["size"] - F.col("dominant_font_size")) * count(s)).alias("v"), (a["n"] + count(s)).alias("n")))
    box = dict(zip(SIDES, _box(F.col("b.bbox")), strict=True))
    rows = computed(rows, _s=spread, **box)
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    step = (F.array_max("_tops") - F.array_min("_tops")) / (F.size("_tops") - 1)  # the steps between neighbours add up to this
    region = F.when(F.col("_region") > 0, F.col("_region")).otherwise(F.lit(float(page_w)))
    return rows.select(
        "page_idx", (F.col("n") + 1).alias("block"), *SIDES, F.array_join("_texts", "\n").alias("text"), "dominant_font_size", "dominant_font_name", "chars",
        F.round(F.col("_s.v") / F.col("_s.n"), 6).alias("font_size_variance"),
        F.when((F.size("_tops") >= 2) & (F.col("dominant_font_size") > 0), F.round(step / F.col("dominant_font_size"), 4)).otherwise(F.lit(1.0)).alias("line_spacing_ratio"),
        F.round(w / region, 4).alias("block_width_ratio"), F.round(F.col("chars") / (w * h), 6).alias("char_density"),
        F.bround(F.col("chars") / F.size("_texts")).cast("bigint").alias("avg_line_length"), (F.size("_texts") == 1).alias("is_single_line"),
    )


def payloads_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Payloads made of texts: a block per paragraph, every seventh an image, a line per line, two spans per line of over ten characters."""
    line = lambda i: lambda t, j: F.struct(F.array(F.lit(40.0), i * 60.0 + j * 12.0, 40.0 + F.least(F.length(t) * 5.0, F.lit(520.0)), i * 60.0 + j * 12.0 + 10.0).alias("bbox"), F.filter(F.array(
        F.struct(F.substring(t, 1, 10).alias("text"), (F.length(t) % 3 + 9).cast("double").alias("size"), F.lit("Serif").alias("font")),
        F.struct(F.substring(t, 11, 100_000).alias("text"), F.lit(10.0).alias("size"), F.lit("Sans").alias("font")),
    ), lambda s: s["text"] != "").alias("spans"))
    block = lambda p, i: let(F.split(p, "\n"), lambda ls: F.struct(F.when(i % 7 == 6, 1).otherwise(0).alias("type"), i.alias("number"), F.array(F.lit(40.0), i * 60.0, 40.0 + F.least(F.array_max(F.transform(ls, F.length)) * 5.0, F.lit(520.0)), i * 60.0 + F.size(ls) * 12.0).alias("bbox"), F.transform(ls, line(i)).alias("lines")))
    body = F.struct(F.transform(F.split(F.col(text), "\n\n"), block).alias("blocks"))
    return documents.where(F.col(text).isNotNull()).select(F.col(key).alias("page_idx"), F.to_json(body).alias("payload"))
