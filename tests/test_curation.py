import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagefold.operators import drift
from pagefold.operators.orphans import is_orphan, orphan_report, parent_intervals, resolve_references
from pagefold.plans import curation_queries as q

DECLARED = {
    "page": [("page_idx", "integer"), ("page_label", "string"), ("figures", "array of figure"), ("old_page_id", "string")],
    "figure": [("bbox", "array of 4 numbers"), ("panel_bboxes", "array of arrays of 4 numbers"), ("caption_bbox", "array of 4 numbers")],
}


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def fits(v, kind):
    four = lambda x: isinstance(x, list) and len(x) == 4 and all(map(number, x))
    return {
        "integer": lambda: number(v) and float(v).is_integer(), "string": lambda: isinstance(v, str), "array of 4 numbers": lambda: four(v), "array of arrays of 4 numbers": lambda: isinstance(v, list) and all(map(four, v)), "array of figure": lambda: isinstance(v, list) and all(isinstance(x, dict) for x in v),
    }[kind]()


def brute(body, declared):
    """Departures of one body: plain loops."""
    try:
        page = json.loads(body)
    except (TypeError, ValueError):
        return set()
    if not isinstance(page, dict):
        return set()
    figures = page.get("figures") if isinstance(page.get("figures"), list) else []
    out = set()
    for holder, o in [("page", page)] + [("figure", f) for f in figures if isinstance(f, dict)]:
        fields = dict(declared.get(holder, []))
        strange = {k: v for k, v in o.items() if k not in fields}
        for name, kind in sorted(fields.items()):
            if name in o:
                if o[name] is not None and not fits(o[name], kind):
                    out.add((name, "retyped"))
                continue
            if kind == "string":
                able = [k for k, v in strange.items() if name.endswith("page_id") and isinstance(v, str) and re.fullmatch(r"[A-Za-z]+_\d+", v)]
            elif kind.startswith("array of") and kind != "array of figure":
                able = [k for k, v in strange.items() if fits(v, kind) and v]
            else:
                able = []
            if able:
                out.add((name, "renamed"))
                del strange[sorted(able)[0]]
            else:
                out.add((name, "removed"))
        out |= {(k, "added") for k in strange}
    return out


BODIES = [
    '{"page_idx": 1, "page_label": "x", "figures": [], "old_page_id": null}', '{"page_idx": 2.0, "page_label": "x", "figures": null, "old_page_id": "jm_1"}', '{"page_idx": 2e0, "page_label": 5, "figures": {}, "prior": "jm_0002"}', '{"page_idx": "1", "page_label": "x", "figures": [1], "note": "jm 2"}', "", None, "[]", "[{}]", "{", '{"page_idx": 1} trailing', '<<< {"page_idx": 1}', '{"a": 1}{"b": 2}', " \n{}\t", "7", '"x"',
    '{"page_idx": true, "page_label": "", "figures": [{"bbox": [1, 2, 3.5, 4], "panel_bboxes": [], "caption_bbox": null}, {"bbox": [1, 2, 3], "panel_bboxes": [[1, 2, 3, 4], [1, 2, 3, "4"]], "cap": [1, 2, 3, 4]}], "old_page_id": "jm_1"}',
    '{"page_idx": 1.5, "page_label": "ü", "figures": [{"box": [1, 2, 3, 4], "panels": [[1, 2, 3, 4]], "caption_bbox": []}, {"bbox": {"x0": 1}, "panel_bboxes": "x", "caption_bbox": ["1", "2", "3", "4"], "empty": []}], "old_page_id": 7}',
    '{"page_idx": 1, "page_label": "x", "figures": [{"bbox": [1, null, 3, 4], "panel_bboxes": [1, 2, 3, 4], "caption_bbox": [[1, 2, 3, 4]], "deep": {"a": [1]}}], "old_page_id": "jm_1", "flag": true}',
]


def test_departures_equal_plain_loops(spark):
    files = spark.createDataFrame([(str(i), b, "x") for i, b in enumerate(BODIES)], "file_path string, body string, kind string")
    got = drift.departures(drift.file_headers(files, "file_path", "body", "figures"), DECLARED, "file_path")
    found = {(r["file_path"], r["field_name"], r["change_type"]) for r in got.collect()}
    assert found == {(str(i), *c) for i, b in enumerate(BODIES) for c in brute(b, DECLARED)}


def test_departures_of_the_supplied_files(spark, small):
    declared = {}
    for r in spark.read.parquet(f"{small}/declared_fields.parquet").collect():
        declared.setdefault(r["file_kind"], {}).setdefault(r["holder"], []).append((r["field_name"], r["json_type"]))
    want = set()
    for kind in ("gt", "meta"):
        for r in spark.read.parquet(f"{small}/{kind}_files.parquet").collect():
            want |= {(r["file_path"], *c) for c in brute(r["body"], declared[kind])}
    assert {tuple(r) for r in q.p2_found(spark, small).collect()} == want


def test_kinds_promote_to_the_least_kind_above(spark):
    files = spark.createDataFrame([("1", '{"a": 1, "b": [1,2,3,4], "c": null, "d": [], "e": 1}'), ("2", '{"a": 1.5, "b": [[1,2,3,4]], "c": "x", "d": [[1,2,3,4]], "e": "jm_1"}')], "k string, body string")
    got = {r["field_name"]: r["kind"] for r in drift.promoted(drift.file_headers(files, "k", "body")).collect()}
    assert got == {"a": "number", "b": "array", "c": "string", "d": "boxes", "e": "any"}


def test_files_are_cast_to_the_declared_schema(spark):
    files = spark.createDataFrame([(str(i), b) for i, b in enumerate(BODIES)], "k string, body string")
    rows = {r["k"]: r for r in drift.conformed(files, "k", "body", DECLARED, "page", "figures").collect()}
    assert rows["2"]["old_page_id"] == "jm_0002" and rows["1"]["page_idx"] == 2 and "5" not in rows and rows["3"]["rest"] == '{"note":"jm 2"}'
    figures = [(r["k"], r["at"], r["bbox"], r["caption_bbox"]) for r in drift.conformed(files, "k", "body", DECLARED, "figure", "figures").orderBy("k", "at").collect()]
    assert ("15", 2, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]) in figures


def test_values_of_another_shape_are_read_or_kept(spark):
    b = [1.0, 2.5, 3.0, 4.0]
    c = [5.0, 6.0, 7.0, 8.0]
    sides = lambda x: dict(zip(("x0", "y0", "x1", "y1"), x, strict=True))
    line = lambda x, by: by.join(map(str, x))
    captions = [(line(b, ","), b), (f" [{line(b, ', ')}] ", b), (line(b, " "), b), (sides(b), b), ([b], b), ([str(x) for x in b], b), ("see page 1, 2, 3, 4", None), ({"x0": 1}, None), (True, None), ([b, c], None)]
    ten = {f"panel_{i}": [float(i), 2.0, 3.0, 4.0] for i in range(1, 12)}
    panels = [(b + c, [b, c]), (b, [b]), ([sides(b), sides(c)], [b, c]), ([line(b, " "), line(c, " ")], [b, c]), (json.dumps([b, c]), [b, c]), (line(b, ","), [b]), ([[str(x) for x in b]], [b]), (ten, list(ten.values())), (sides(c), [c]), ("none", None), ([1, 2, 3], None), ([sides(b), "x"], None)]
    figures = [({"bbox": b, "panel_bboxes": [], "caption_bbox": v}, "caption_bbox", v, w) for v, w in captions] + [({"bbox": b, "panel_bboxes": v, "caption_bbox": None}, "panel_bboxes", v, w) for v, w in panels]
    files = spark.createDataFrame([("f", json.dumps({"page_idx": 1e30, "page_label": {"a": [1]}, "old_page_id": None, "figures": [f[0] for f in figures]})), ("g", '{"page_idx": 1, "figures": "lost?"}')], "k string, body string")
    rows = drift.conformed(files, "k", "body", DECLARED, "figure", "figures").orderBy("at").collect()
    assert [r[name] for r, (_, name, _, _) in zip(rows, figures, strict=True)] == [w for *_, w in figures]
    assert [json.loads(r["retyped"]) for r in rows] == [{name: v} for _, name, v, _ in figures]
    f, g = drift.conformed(files, "k", "body", DECLARED, "page", "figures").orderBy("k").collect()
    assert json.loads(f["retyped"]) == {"page_idx": 1e30, "page_label": {"a": [1]}} and f["n_figures"] == len(figures) and json.loads(g["retyped"]) == {"figures": "lost?"}


def test_log_counts_files_exactly(spark, tmp_path):
    spark.createDataFrame([("gt", "page", "page_idx", "integer")], "file_kind string, holder string, field_name string, json_type string").write.parquet(f"{tmp_path}/declared_fields.parquet")
    n = 3000
    body = F.when(F.col("id") < n, '{"page_idx": "x"}').otherwise('{"page_idx": 1, "more": 1}')
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + c)
    files = spark.range(n + 2).select(F.concat(F.lit("f"), F.col("id")).alias("file_path"), F.concat(F.lit("b"), F.col("id")).alias("batch"), body.alias("body"), at(-F.col("id")).alias("written_at"))
    files.unionByName(files.where("id < 500")).write.parquet(f"{tmp_path}/gt_files.parquet")
    files.limit(0).write.parquet(f"{tmp_path}/meta_files.parquet")
    rows = {r["change_type"]: r for r in q.p2_log(spark, str(tmp_path)).collect()}
    assert (rows["retyped"]["files"], rows["retyped"]["objects"], rows["retyped"]["first_batch"]) == (n, n + 500, f"b{n - 1}")
    assert (rows["added"]["files"], rows["added"]["objects"], rows["added"]["first_batch"]) == (2, 2, f"b{n + 1}") and rows["added"]["first_at"] < rows["added"]["last_at"]


def test_unknown_declarations_are_refused(spark):
    with pytest.raises(ValueError):
        drift.declared_of(spark.createDataFrame([("gt", "page", "x", "decimal")], "file_kind string, holder string, field_name string, json_type string"), "gt")


def test_references_are_present_late_deleted_or_missing(spark):
    t = lambda d: datetime(2025, 1, d)
    parents = spark.createDataFrame([("a", t(1), None), ("b", t(9), None), ("c", t(1), t(2)), ("c", t(3), t(4)), ("d", t(1), t(2)), ("d", t(3), None), (None, t(1), None), ("e", None, None)], "k string, b timestamp, e timestamp")
    refs = spark.createDataFrame([(k, t(5), i, "x") for i, k in enumerate(["a", "b", "c", "d", "m", None, "e", "a"])] + [("b", None, 9, "x")], "k string, at timestamp, id int, verdict_note string")
    got = {r["id"]: r["verdict"] for r in resolve_references(refs, parent_intervals(parents, "k", "b", "e"), "k", "at", "id").collect()}
    assert got == {0: "present", 1: "late", 2: "deleted", 3: "present", 4: "missing", 6: "present", 7: "present", 9: "present"}
    assert resolve_references(refs.limit(0), parent_intervals(parents.limit(0), "k", "b", "e"), "k", "at", "id").count() == 0
    assert resolve_references(refs, parent_intervals(parents.limit(0), "k", "b", "e"), "k", "at", "id").where(F.col("verdict") == "missing").count() == 8


def test_references_meet_the_intervals_of_their_own_time(spark):
    t = lambda d: datetime(2025, 1, d)
    spans = [("a", t(2), t(4)), ("a", t(8), None), ("a", t(8), None), ("b", t(2), t(6)), ("b", t(3), t(4)), ("b", t(8), t(9)), ("c", None, t(4)), ("d", t(2), t(2)), ("d", t(8), None)]
    parents = spark.createDataFrame(spans, "k string, b timestamp, e timestamp")
    asked = [(k, t(d), f"{k}{d}") for k in "abcd" for d in (1, 2, 3, 4, 5, 8, 9)] + [("b", None, "b-"), ("a", None, "a-")]
    refs = spark.createDataFrame(asked, "k string, at timestamp, id string")

    def want(k, at):
        own = [(b, e) for key, b, e in spans if key == k]
        live = any(e is None for _, e in own)
        if at is None:
            return "present" if live else "deleted"
        if any((b is None or b <= at) and (e is None or at < e) for b, e in own):
            return "present" if live else "lost"
        return "deleted" if not live else "returned" if any(b is None or b <= at for b, _ in own) else "late"

    resolved = resolve_references(refs, parent_intervals(parents, "k", "b", "e"), "k", "at", "id")
    got = {r["id"]: r["verdict"] for r in resolved.collect()}
    assert got == {i: want(k, at) for k, at, i in asked} and (got["a3"], got["a1"], got["a5"], got["b3"], got["b5"], got["b9"]) == ("present", "late", "returned", "lost", "lost", "deleted")
    assert {r["verdict"] for r in resolved.where(is_orphan()).collect()} == {"lost", "deleted"}
    counts = orphan_report(resolved.selectExpr("'t' AS ref_table", "'f' AS ref_field", "at", "verdict"), "at").collect()
    assert all(r["refs"] == r["present"] + r["late"] + r["returned"] + r["lost"] + r["deleted"] + r["missing"] for r in counts)


def test_scans_read_only_the_columns_they_need(spark, small):
    from pagefold.sources.tables import current_pages, table

    plan = current_pages(table(spark, small, "page_index"))._jdf.queryExecution().executedPlan().toString()
    assert "overlay_path" not in plan and "shortlist_reason" not in plan


def test_union_schema_holds_every_value(spark):
    bodies = ['{"a": 1, "b": [1, 2, 3, 4], "C": "x", "c": true, "e": [], "m": {"k": 1}}', '{"a": 2.5, "b": "1,2,3,4", "C": "p_1", "e": [[1, 2, 3, 4]], "m": null, "n": [1, "z", {"q": 2}]}', '{"a": null, "b": null, "k": 7}', "[1]", None]
    files = spark.createDataFrame([(f"f{i}", b) for i, b in enumerate(bodies)], "k string, body string")
    fields = drift.union_fields(drift.promoted(drift.file_headers(files, "k", "body")), "page")
    assert fields == {"C": "string", "a": "number", "b": "any", "c": "boolean", "e": "boxes", "k": "integer", "m": "object", "n": "array"}
    df = drift.unified(files, "k", "body", fields, "page")
    assert df.columns == ["k", "at", "C", "a", "b", "c__2", "e", "k__2", "m", "n"]
    rows = {r["k"]: r for r in df.collect()}
    assert set(rows) == {"f0", "f1", "f2"}
    assert rows["f0"]["a"] == 1.0 and rows["f1"]["a"] == 2.5 and rows["f2"]["a"] is None
    assert rows["f0"]["b"] == "[1,2,3,4]" and rows["f1"]["b"] == "1,2,3,4" and rows["f2"]["b"] is None
    assert rows["f0"]["e"] == [] and rows["f1"]["e"] == [[1, 2, 3, 4]] and rows["f0"]["m"] == {"k": "1"} and rows["f1"]["n"] == ["1", '"z"', '{"q":2}']
    assert rows["f0"]["c__2"] is True and rows["f1"]["c__2"] is None and rows["f2"]["k__2"] == 7
    assert drift.unified(files.limit(0), "k", "body", fields, "page").count() == 0


def test_lattice_says_what_needs_no_promotion():
    assert drift.within("number") == ["null", "integer", "number"] and drift.within("box") == ["null", "box"]
    assert set(drift.within("array")) == {"null", "box", "boxes", "objects", "array", "empty"}
    assert set(drift.within("any")) == {"null", "empty", "any", *drift.ABOVE}


def test_unreadable_bodies_are_listed(spark):
    files = spark.createDataFrame([("a", None), ("b", " \n"), ("c", "{"), ("d", "[1]"), ("e", '{"x": 1}'), ("f", '{"x": 1, "x": 2}'), ("g", '{"x": 1} {}')], "k string, body string")
    assert {r["k"]: r["reason"] for r in drift.unreadable(files, "k", "body").collect()} == {"a": "null", "b": "blank", **dict.fromkeys("cdfg", "not one JSON object")}
