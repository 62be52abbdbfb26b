import random

import pytest
from pyspark.sql import functions as F

from pagefold.operators import groups, matching, pagegraph, reports
from pagefold.operators.boxjoin import box_join, self_pairs
from pagefold.operators.components import connected_components, shared_item_edges
from pagefold.plans.partitioning import key_loads, merge_lookup, ordered_positions

BOXES = "page_idx bigint, ord int, x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n, pages=3, size=300):
    out = []
    for i in range(n):
        x, y = rng.randrange(600), rng.randrange(700)
        out.append((0 if rng.random() < 0.5 else rng.randrange(pages), i, float(x), float(y), float(x + rng.randrange(1, size)), float(y + rng.randrange(1, size))))
    return out


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return w * h / (area(a) + area(b) - w * h)


def cover(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return 0.0 if w <= 0 or h <= 0 else w * h / min(area(a), area(b))


def gap(a, b):
    return (max(b[2] - a[4], a[2] - b[4], 0) ** 2 + max(b[3] - a[5], a[3] - b[5], 0) ** 2) ** 0.5


@pytest.mark.parametrize("weight", [None, "w"])
def test_positions_with_a_group_of_half_the_rows(spark, weight):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "z"]), rng.randrange(50), i, rng.choice([None, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s int, id int, w bigint").repartition(7)
    out = ordered_positions(df, "g", [F.col("s").desc(), F.col("id").asc()], weight).collect()
    assert len(out) == len(rows)
    by = {}
    for g, s, i, w in sorted(rows, key=lambda r: (-r[1], r[2])):
        pos, before = by.get(g, (0, 0))
        by[g] = (pos + 1, before + (w or 0))
        got = next(r for r in out if r["id"] == i) if i % 97 == 0 else None
        if got:
            assert got["group_pos"] == pos and (not weight or got["group_before"] == before)
    for g, (n, _) in by.items():
        assert sorted(r["group_pos"] for r in out if r["g"] == g) == list(range(n))


def test_positions_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, id int")
    assert ordered_positions(df, "g", [F.col("id")]).columns == ["g", "id", "group_pos"]
    assert ordered_positions(df, "g", [F.col("id")]).count() == 0


def test_merge_lookup_spreads_frequent_keys(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(5000)] + [(None, -1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    loads = key_loads(left, "k", "i")
    assert key_loads(left.limit(0), "k") == key_loads(left.where("k IS NULL"), "k") == [{}]
    assert list(loads[0]) == ["hot"] and loads[0]["hot"] >= 2 and loads[1] == {}
    out = merge_lookup(left, right, "k", F.col("i"))
    assert out.count() == 5001 and out.where("v = 1").count() == 2500 and out.where("v = 2").count() == 1
    assert merge_lookup(left, right, "k", F.col("i"), "inner").count() == 2501


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(200):03}", f"n{rng.randrange(200):03}") for _ in range(130)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("p000", None), ("n001", "n001")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    near = {}
    for a, b in edges:
        if b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert set(got) == set(near)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)


def test_no_edges_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_shared_items_link_as_a_star(spark):
    rows = [("x", 1), ("y", 1), ("z", 1), ("y", 2), ("w", 2), ("alone", 3), (None, 1), ("q", None)]
    got = {tuple(r) for r in shared_item_edges(spark.createDataFrame(rows, "n string, i int"), "n", "i").collect()}
    assert got == {("y", "x"), ("z", "x"), ("y", "w")}


@pytest.mark.parametrize("cell,most", [(40.0, 0), (256.0, 50), (5000.0, 0), (256.0, 400)])
def test_box_join_equals_all_pairs(spark, cell, most):
    rows = boxes(random.Random(2), 120)
    df = spark.createDataFrame(rows, BOXES)
    near = F.lit(True)
    got = {(r["a_ord"], r["b_ord"]) for r in box_join(df, df, reach=15.0, where=near, cell=cell, most=most).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] - 15 <= b[4] and b[2] <= a[4] + 15 and a[3] - 15 <= b[5] and b[3] <= a[5] + 15}
    assert got == want
    anti = {r["ord"] for r in box_join(df, df, where=F.col("a_ord") != F.col("b_ord"), how="left_anti", cell=cell, most=most).collect()}
    assert anti == {a[1] for a in rows if not any(a is not b and a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5] for b in rows)}


def test_box_join_ignores_null_boxes_and_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0, "k"), (1, 2, None, 0.0, 5.0, 5.0, "k"), (None, 3, 0.0, 0.0, 5.0, 5.0, "k")], BOXES + ", kind string")
    assert [(r["a_kind"], r["b_kind"], r["a_ord"], r["b_ord"]) for r in box_join(df, df).collect()] == [("k", "k", 1, 1)]
    assert self_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_equals_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    truth, found = boxes(rng, 60, 2), []
    for i, r in enumerate(truth * 2):
        found.append((r[0], i, *[c + rng.randrange(-8, 9) for c in r[2:]]))
    got = {(r["page_idx"], r["gt"], r["pred"]) for r in matching.greedy_match(matching.scored_pairs(spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, BOXES))).collect()}
    pairs = sorted(((-iou(a, b), a[1], b[1], a[0]) for a in truth for b in found if a[0] == b[0] and iou(a, b) >= 0.5))
    want, g, p = set(), set(), set()
    for _, a, b, page in pairs:
        if (page, a) not in g and (page, b) not in p:
            want.add((page, a, b))
            g.add((page, a))
            p.add((page, b))
    assert got == want


def test_metrics_of_two_boxes_and_of_an_empty_page(spark):
    truth = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 60.0, 60.0)], BOXES)
    found = spark.createDataFrame([(1, 0, 0.0, 0.0, 8.0, 8.0), (1, 1, 200.0, 0.0, 210.0, 10.0)], BOXES)
    spine = spark.createDataFrame([(1,), (2,)], "page_idx bigint")
    rows = {r["page_idx"]: r for r in matching.page_counts(spine, truth, found, matching.greedy_match(matching.scored_pairs(truth, found))).collect()}
    assert (rows[1]["recall"], rows[1]["f1"], rows[1]["iou"]) == (0.5, 0.5, 0.64)
    assert (rows[2]["precision"], rows[2]["recall"], rows[2]["f1"]) == (0, 0, 0)


@pytest.mark.parametrize("seed", range(3))
def test_suppression_equals_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    base = boxes(rng, 40, 2)
    rows = [(r[0], i, *[c + rng.randrange(-6, 7) for c in r[2:]], rng.randrange(5)) for i, r in enumerate(base * 3)]
    got = {r["ord"] for r in groups.suppress(spark.createDataFrame(rows, BOXES + ", score int"), [F.col("score").desc(), F.col("ord").asc()]).where("kept").collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if not any(k[0] == r[0] and (iou(k, r) > 0.8 or cover(k, r) > 0.9) for k in kept):
            kept.append(r)
    assert got == {k[1] for k in kept}


def test_clusters_join_over_gaps(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 15.0, 0.0, 25.0, 10.0), (1, 3, 30.0, 0.0, 40.0, 10.0), (1, 4, 300.0, 300.0, 310.0, 310.0), (2, 1, 12.0, 0.0, 14.0, 10.0)]
    got = {(r["page_idx"], r["ord"]): r["cluster"] for r in groups.page_clusters(spark.createDataFrame(rows, BOXES), 6.0).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (2, 1): 1}
    wall = spark.createDataFrame([(1, 9, 11.0, 0.0, 14.0, 10.0)], BOXES)
    got = {(r["page_idx"], r["ord"]): r["cluster"] for r in groups.page_clusters(spark.createDataFrame(rows, BOXES), 6.0, wall).collect()}
    assert got[1, 2] == 2 and got[1, 3] == 2


def test_closure_follows_direction_and_repulsion(spark):
    rows = [(1, 1, 2, "attract", "contains"), (1, 2, 3, "attract", "caption_of"), (1, 3, 1, "attract", "same_row"), (1, 1, 4, "attract", "contains"), (1, 1, 4, "repel", "near_body_text"), (1, 5, 1, "attract", "contains"), (1, 6, 7, "attract", "caption_of"), (1, 6, 8, "attract", "contains"), (1, 8, 7, "attract", "contains")]
    edges = spark.createDataFrame(rows, "page_idx int, source int, target int, polarity string, relation string")
    got = {(r["seed"], r["node"]): r["content"] for r in pagegraph.closure(spark.createDataFrame([(1, s) for s in (1, 5, 4, 6)], "page_idx int, ord int"), edges).collect()}
    assert got == {(1, 2): True, (1, 3): False, (1, 1): True, (5, 1): True, (5, 2): True, (5, 3): False, (6, 7): True, (6, 8): True}


def test_arbitration_prefers_eligible_and_breaks_ties_by_name(spark):
    rows = [(1, "a", "s", 0.9, 0.0, False), (1, "b", "s", 0.5, 0.0, None), (1, "c", "s", 0.5, 0.0, True), (2, "x", "s", 0.1, 0.0, False)]
    got = {r["page_idx"]: r["id"] for r in groups.arbitrate(spark.createDataFrame(rows, "page_idx int, id string, strategy string, score double, priority double, eligible boolean"), ["page_idx"]).collect()}
    assert got == {1: "c", 2: "x"}


def test_timing_percentiles_interpolate(spark):
    r = reports.timing(spark.createDataFrame([(1, x) for x in (0.4, 0.6, 1.0, 2.0)], "k int, v double"), "v", "k").first()
    assert (r["count"], r["p50"], r["p95"], r["max"]) == (4, 0.8, 1.85, 2.0)


def test_typography_takes_the_font_of_most_characters(spark):
    from pagefold.operators.layout import line_spacing, typography

    spans = spark.createDataFrame([(1, 1, "abc", 9.0, "A"), (1, 2, "abcdef", 10.0, "B"), (1, 3, "abc", 9.0, "A"), (1, 4, "", 9.0, "C")], "block int, ord int, text string, size double, font string")
    r = typography(spans, ["block"]).first()
    assert (r["dominant_font_size"], r["dominant_font_name"], r["chars"]) == (9.0, "A", 12)
    lines = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 12.0, 10.0), (1, 3, 24.0, 10.0), (2, 1, 5.0, 10.0)], "block int, ord int, y0 double, font double")
    assert {x["block"]: x["line_spacing_ratio"] for x in line_spacing(lines, ["block"], "font").collect()} == {1: 1.2, 2: 1.0}


def test_providers_ignore_what_they_cannot_read(spark):
    from pagefold.sources.providers import PARSERS

    bad = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "{}"), (5, "[1]"), (6, '{"pages": [], "json": {"children": null}}')], "page_idx int, payload string")
    for parse in PARSERS.values():
        assert parse(bad, 100.0, 100.0).count() == 0
    nested = '{"json": {"children": [{"block_type": "Page", "bbox": [0, 0, 200, 100], "children": [{"block_type": "G", "children": [{"block_type": "Picture", "bbox": [20, 10, 40, 50]}]}, {"block_type": "Picture", "bbox": [0, 0, 10]}]}]}}'
    assert [tuple(r) for r in PARSERS["d"](spark.createDataFrame([(1, nested)], "page_idx int, payload string"), 100.0, 100.0).collect()] == [(1, 1, 10.0, 10.0, 20.0, 50.0)]


def test_too_deep_a_tree_is_refused(spark, monkeypatch):
    from pagefold.sources import providers

    deep = '{"block_type": "Picture", "bbox": [0, 0, 1, 1]}'
    for _ in range(5):
        deep = '{"block_type": "Group", "children": [%s]}' % deep
    payload = spark.createDataFrame([(0, '{"json": {"children": [{"block_type": "Page", "bbox": [0, 0, 10, 10], "children": [%s]}]}}' % deep)], "page_idx int, payload string")
    assert providers.parse_d(payload, 10.0, 10.0).count() == 1
    monkeypatch.setattr(providers, "MAX_DEPTH", 6)
    with pytest.raises(ValueError):
        providers.parse_d(payload, 10.0, 10.0)
