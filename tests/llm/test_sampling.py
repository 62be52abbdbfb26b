import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pagefold.llm.cap import cap_contributors
from pagefold.llm.sample import MAX_CELLS, PARTS, Target, cell_quotas, cell_targets, draw_quotas, margin_report, plan_sample, sample_to_targets
from pagefold.llm.split import QUARANTINE, ComponentStore, related_classes, related_pairs, update_components


def test_cap_keeps_the_best_of_a_dominant_contributor(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, 0.1, 0.5, 0.9]), f"p{i:05}", "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "who string, score double, page string, kept_by string")
    out = cap_contributors(df, "who", [F.col("score").desc_nulls_last(), F.col("page").asc()], cap=7)
    assert "kept_by" in out.columns and out.count() == sum(r[0] is not None for r in rows)
    want = set()
    for who in ("hot", "a", "b"):
        own = sorted((r for r in rows if r[0] == who), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2] for r in own[:7]}
    assert {r["page"] for r in out.where("kept").collect()} == want


def test_cap_by_share_and_on_nothing(spark):
    df = spark.createDataFrame([("a", i) for i in range(8)] + [("b", i) for i in range(2)], "who string, id int")
    assert cap_contributors(df, "who", [F.col("id")], share=0.3).where("kept").groupBy("who").count().orderBy("who").collect() == [("a", 3), ("b", 2)]
    assert cap_contributors(df.limit(0), "who", [F.col("id")], cap=1).count() == 0
    for bad in ({}, {"cap": 1, "share": 0.1}, {"share": 0.0}):
        with pytest.raises(ValueError):
            cap_contributors(df, "who", [F.col("id")], **bad)


def test_needs_meet_pages_and_slack_arcs_expose_what_lacks():
    t = [Target("f", "x", Fraction("0.5"), 0), Target("f", "y", Fraction("0.25"), 0), Target("g", "x", Fraction("0.25"), 9), Target(None, "x", Fraction(0), 1)]
    got = cell_quotas(t, [3, 100, 100, 0], Fraction(20))
    assert [(r["need"], r["own"], r["slack"]) for r in got] == [(10, 3, 7), (5, 5, 0), (9, 9, 0), (1, 0, 1)]
    assert sum(r["quota"] for r in got) == 20 and got[0]["quota"] == 3 and got[2]["quota"] >= 9 and got[3]["quota"] == 0
    got = cell_quotas(t[:2], [1, 2], Fraction(20))
    assert [(r["own"], r["slack"], r["quota"]) for r in got] == [(1, 9, 1), (2, 3, 2)]
    assert cell_quotas([], [], Fraction(5)) == []


def test_floors_lower_the_other_cells():
    wanted = cell_targets([Fraction("0.5"), Fraction("0.4"), Fraction("0.1")], [0, 0, 4], 10)
    assert sum(wanted) == 10 and wanted[2] == 4 and wanted[0] / wanted[1] == Fraction(5, 4)
    assert cell_targets([Fraction(1), Fraction(0)], [8, 8], 10) == [8, 8]
    assert cell_targets([Fraction(0), Fraction(0)], [1, 0], 10) == [1, 0]


def least_margin_error(cells, wanted, floors, have):
    """Brute force over whole quotas: the least that both margins together miss their targets by, floors kept."""
    import itertools

    total, best = sum(wanted), None
    for q in itertools.product(*[range(min(f, h), h + 1) for f, h in zip(floors, have)]):
        if sum(q) != min(total, sum(have)):
            continue
        error = 0
        for side in (0, 1):
            for label in {c[side] for c in cells}:
                error += abs(sum(x - w for c, x, w in zip(cells, q, wanted) if c[side] == label))
        best = error if best is None else min(best, error)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_margins_miss_their_targets_no_more_than_they_must(seed):
    rng = random.Random(seed)
    cells = [(a, b) for a in "fgh"[: rng.randrange(2, 4)] for b in "xyz"[: rng.randrange(2, 3)]]
    wanted = [rng.randrange(0, 4) for _ in cells]
    wanted[0] += 1
    have = [rng.choice([0, 1, 3, 5]) for _ in cells]
    floors = [min(w, rng.randrange(2)) for w in wanted]
    size = sum(wanted)
    got = cell_quotas([Target(a, b, Fraction(w, size), f) for (a, b), w, f in zip(cells, wanted, floors)], have, Fraction(size))
    quotas = [r["quota"] for r in got]
    assert sum(quotas) == min(size, sum(have)) and all(min(f, h) <= q <= h for q, f, h in zip(quotas, floors, have))
    error = sum(abs(sum(q - w for c, q, w in zip(cells, quotas, wanted) if c[side] == label)) for side in (0, 1) for label in {c[side] for c in cells})
    # fractional steps of a margin may round away from its whole target by less than a page a label
    assert error <= least_margin_error(cells, wanted, floors, have) + len({c[0] for c in cells}) + len({c[1] for c in cells})


def test_what_a_cell_lacks_stays_within_both_margins():
    cells = [(a, b) for a in "fgh" for b in "xy"]
    t = [Target(a, b, Fraction(1, 6), 0) for a, b in cells]
    got = {c: r["quota"] for c, r in zip(cells, cell_quotas(t, [40, 900, 900, 900, 900, 900], Fraction(600)), strict=True)}
    assert got["f", "x"] == 40 and got["f", "y"] == 160
    assert got["g", "x"] + got["h", "x"] == 260 and abs(got["g", "x"] - got["h", "x"]) <= 20  # spread over both
    for side in (0, 1):
        for label in {c[side] for c in cells}:
            assert abs(sum(q for c, q in got.items() if c[side] == label) - (200, 300)[side]) <= 1


def test_drawn_quotas_keep_means_and_margins():
    cells = [(a, b) for a in "fg" for b in "xyz"]
    placed = [int(x * PARTS) for x in (0.3, 1.5, 2.2, 0.7, 0.5, 0.8)]
    draws = [draw_quotas(cells, placed, seed) for seed in range(600)]
    for i, p in enumerate(placed):
        assert {d[i] for d in draws} <= {p // PARTS, -(-p // PARTS)}
        assert abs(sum(d[i] for d in draws) / len(draws) - p / PARTS) < 0.08
    assert {d[0] + d[1] + d[2] for d in draws} == {4} and {d[0] + d[3] for d in draws} == {1} and {sum(d) for d in draws} == {6}


def test_sample_follows_its_quotas(spark):
    rows = [(f"p{i}", "f" if i % 3 else "g", "x" if i % 2 else None, "e") for i in range(600)]
    pages = spark.createDataFrame(rows, "page string, fam string, lev string, available string")
    targets = spark.createDataFrame([("F", "X", 0.5, 2), ("G", "X", 0.3, None), ("h", "x", None, 1)], "figure_family string, difficulty string, target_share double, min_pages bigint").withColumns({"kf": F.lower("figure_family"), "kl": F.lower("difficulty")})
    labels, keys = ("fam", "lev"), ("kf", "kl")
    report = plan_sample(pages, targets, labels, keys, 0.2)
    sample = sample_to_targets(pages, report, "page", labels, keys)
    got = {(r["fam"], r["lev"]): r["n"] for r in sample.groupBy("fam", "lev").agg(F.countDistinct("page").alias("n")).collect()}
    by = {r["kf"]: r for r in report.collect()}
    assert by["h"]["own"] == 0 and by["h"]["slack"] == 1 and by["f"]["need"] == 30 and by["g"]["need"] == 18
    assert got == {("f", "x"): by["f"]["quota"], ("g", "x"): by["g"]["quota"]} and sum(got.values()) == 60
    again = sample_to_targets(pages.repartition(5), report, "page", labels, keys)
    assert {r["page"] for r in again.collect()} == {r["page"] for r in sample.collect()}
    margins = {(r["margin"], r["label"]): r["quota"] for r in margin_report(report, "figure_family", "difficulty").collect()}
    assert margins["figure_family", "F"] == by["f"]["quota"]
    nothing = plan_sample(pages.limit(0), targets, labels, keys, 0.2)
    assert sample_to_targets(pages.limit(0), nothing, "page", labels, keys).count() == 0 and {r["own"] for r in nothing.collect()} == {0}


def test_supplied_margins_stay_at_their_targets(spark, small):
    from pagefold.llm.queries import p4_margins

    rows = p4_margins(spark, small).collect()
    lacking = sum(r["lacking"] for r in rows) / 2
    assert rows and all(abs(r["quota"] - r["wanted"]) <= lacking + 1 for r in rows)


def test_too_many_targets_are_refused(spark):
    targets = spark.range(MAX_CELLS + 1).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"), F.lit(0.0).alias("target_share"), F.lit(0).alias("min_pages"))
    with pytest.raises(ValueError):
        plan_sample(spark.createDataFrame([], "page string, f string, l string"), targets, ("f", "l"), ("a", "b"), 0.1)


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def table_of(state):
    return {r["node"]: r for r in state.nodes.collect()}


def test_related_records_share_a_split_and_shares_are_met(spark):
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(700)}", f"p{i}", None) for i in range(4000)] + [("big", f"q{i}", None) for i in range(1500)]
    rows += [(f"d{i + 1}", f"p{j}", None) for i, j in [(rng.randrange(700), rng.randrange(4000)) for _ in range(60)]] + [(None, "p1", None), ("lone", None, None)]
    df = spark.createDataFrame(rows, "doc string, page string, component string")
    out = table_of(update_components(df, "doc", "page", SHARES))
    assert set(out) == {r[0] for r in rows if r[0]}
    holders = {}
    for doc, page, _ in rows:
        if doc and page:
            holders.setdefault(page, set()).add(doc)
    for docs in holders.values():
        assert len({out[d]["split"] for d in docs}) == len({out[d]["component"] for d in docs}) == 1
    total, got = sum(r["rows"] for r in out.values()), {}
    for r in out.values():
        got[r["split"]] = got.get(r["split"], 0) + r["rows"]
    assert total == len(rows) - 1
    for split, share in SHARES.items():
        assert abs(got[split] / total - share) < 0.03


def test_known_components_keep_their_split(spark):
    first = update_components(spark.createDataFrame([(f"d{i}", f"p{i}") for i in range(200)], "doc string, page string"), "doc", "page", SHARES)
    old = table_of(first)
    a = next(d for d in old if old[d]["split"] == "train")
    b = next(d for d in old if old[d]["split"] == "test")
    c = next(d for d in sorted(old, reverse=True) if old[d]["split"] == "train" and d != a)
    batch = [("new1", f"p{a[1:]}"), ("new2", "n"), ("new2", f"p{a[1:]}"), ("bridge", f"p{b[1:]}"), ("bridge", f"p{c[1:]}"), ("fresh", "zz")]
    now = table_of(update_components(spark.createDataFrame(batch, "doc string, page string"), "doc", "page", SHARES, first))
    assert all(now[d]["split"] == old[d]["split"] for d in old)
    assert now["new1"]["split"] == now["new2"]["split"] == "train" and not now["new1"]["conflict"]
    assert now["bridge"]["split"] == QUARANTINE and now[b]["conflict"] and now[c]["conflict"] and now[b]["component"] == now[c]["component"]
    assert now["fresh"]["split"] in SHARES and len(now) == 204
    same = table_of(update_components(spark.createDataFrame([], "doc string, page string"), "doc", "page", SHARES, first))
    assert {d: (r["split"], r["component"], r["rows"]) for d, r in same.items()} == {d: (r["split"], r["component"], r["rows"]) for d, r in old.items()}


def test_the_store_keeps_versions_and_later_runs_find_them(spark, tmp_path):
    store = ComponentStore(spark, f"{tmp_path}/kept")
    assert store.load() is None and store.versions() == []
    rows = lambda *r: spark.createDataFrame(list(r), "doc string, page string")
    first = table_of(store.update(rows(("a", "1"), ("b", "2"), ("b", "2")), "doc", "page", SHARES))
    (tmp_path / "kept" / "v00000002" / "items").mkdir(parents=True)  # an update that was lost
    again = ComponentStore(spark, f"{tmp_path}/kept")
    assert table_of(again.load()) == first and first["b"]["rows"] == 2
    now = table_of(again.update(rows(("c", "1"), ("c", "9")), "doc", "page", SHARES))
    assert now["c"]["component"] == now["a"]["component"] == first["a"]["component"] and now["c"]["split"] == first["a"]["split"]
    assert again.versions() == ["v00000001", "v00000003"]
    again.clean(keep=1)
    assert again.versions() == ["v00000003"] and table_of(again.load()) == now


@pytest.mark.parametrize("seed", range(2))
def test_batches_join_what_one_batch_joins(spark, seed):
    rng = random.Random(seed)
    rows = [(f"d{rng.randrange(60):02}", f"p{rng.randrange(80)}") for _ in range(130)]
    df = spark.createDataFrame(rows, "doc string, page string")
    whole = table_of(update_components(df, "doc", "page", SHARES))
    state = None
    for part in (rows[:40], rows[40:90], rows[90:]):
        state = update_components(spark.createDataFrame(part, "doc string, page string"), "doc", "page", SHARES, state)
    steps = table_of(state)
    classes = lambda t: {frozenset(d for d in t if t[d]["component"] == c) for c in {r["component"] for r in t.values()}}
    assert classes(steps) == classes(whole) and {d: r["rows"] for d, r in steps.items()} == {d: r["rows"] for d, r in whole.items()}


def test_batches_of_the_supplied_pages_keep_splits(spark, small):
    from pagefold.llm.queries import p5_batches

    rows = p5_batches(spark, small).collect()
    assert any(r["first_split"] for r in rows) and any(not r["first_split"] for r in rows)
    assert all(r["first_split"] in (None, r["split"]) for r in rows)
    assert all(r["conflict"] for r in rows if r["split"] == QUARANTINE)
    of = {}
    for r in rows:
        of.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for c, s in of.items() if not any(r["conflict"] for r in rows if r["component"] == c))


def test_pairs_within_components(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("x", 2), ("a", 1)] + [(f"h{i:02}", 3) for i in range(30)], "m string, c int")
    got = {tuple(r) for r in related_pairs(df, "m", "c").collect()}
    assert {p for p in got if not p[0].startswith("h")} == {("a", "b"), ("a", "c"), ("b", "c")} and len(got) == 3 + 30 * 29 // 2
    assert related_pairs(df.limit(0), "m", "c").count() == 0
    links = {r["m"]: (r["c"], r["links"]) for r in related_classes(df, "m", "c").collect()}
    assert links["a"] == (1, 2) and links["x"] == (2, 0) and links["h07"] == (3, 29) and len(links) == 34


def test_pairs_of_the_supplied_pages(spark, small):
    from pagefold.functions.spelling import paper
    from pagefold.llm.queries import p5_found

    rows = spark.read.parquet(f"{small}/page_index.parquet").select("page_id", "doc_id", paper("doc_id").alias("paper")).where("paper IS NOT NULL").collect()
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in rows:
        up[root("d" + r["doc_id"])] = root("k" + r["paper"])
        up[root("d" + r["doc_id"])] = root("p" + r["page_id"])
    docs = sorted({r["doc_id"] for r in rows})
    want = {(a, b) for i, a in enumerate(docs) for b in docs[i + 1 :] if root("d" + a) == root("d" + b)}
    assert {tuple(r) for r in p5_found(spark, small).collect()} == want
