import random

import pytest

from pagefold.operators import ranking


def in_order(n, pairs):
    """The sequential selection: items in order, each against those that are in."""
    kept = []
    for b in range(n):
        against = {a: pairs[a, b] for a in kept if (a, b) in pairs}
        if any(v == "suppressed" for v, _ in against.values()):
            continue
        kept = [a for a in kept if against.get(a, ("both", False))[0] != "displaces"]
        if any(against[a][1] for a in kept if a in against):
            continue
        kept.append(b)
    return set(kept)


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    pages, rows = {}, []
    for page in range(12):
        n = rng.choice([1, 2, 5, 9, 14])
        pairs = {(a, b): (rng.choice(["both", "displaces", "suppressed"]), rng.random() < 0.3) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.35}
        pages[page] = (n, pairs)
        rows += [(page, a, b, v, s) for (a, b), (v, s) in pairs.items() if v != "both" or s]
    items = spark.createDataFrame([(p, r) for p, (n, _) in pages.items() for r in range(n)], "page_idx int, rank int")
    judged = spark.createDataFrame(rows, "page_idx int, a int, b int, verdict string, subsumed boolean")
    got = {}
    for r in ranking.select_in_order(items, judged).collect():
        got.setdefault(r["page_idx"], set()).add(r["rank"])
    assert got == {p: in_order(n, pairs) for p, (n, pairs) in pages.items()}


def test_selection_without_pairs_keeps_all(spark):
    items = spark.createDataFrame([(1, 0), (1, 1)], "page_idx int, rank int")
    judged = spark.createDataFrame([], "page_idx int, a int, b int, verdict string, subsumed boolean")
    assert ranking.select_in_order(items, judged).count() == 2
    assert ranking.select_in_order(items.limit(0), judged).count() == 0


def test_levels_and_scores(spark):
    from pyspark.sql import functions as F

    rows = [("image_cluster", [], 2, None, "L2"), ("image_cluster", [], 1, None, "L1"), ("raster", ["visual_community"], 1, None, "L0"), ("x", ["layout_column"], 1, None, "L2"), ("image_seed", None, None, None, "L1"), ("x", ["path"], 1, None, "L0"), ("x", [], 1, "L2", "L2"), ("x", [], 1, "L9", "L1")]
    df = spark.createDataFrame(rows, "kind string, tags array<string>, n int, given string, want string")
    got = df.select("want", ranking.level(F.col("kind"), F.col("tags"), F.col("n"), F.col("given")).alias("got"), ranking.seed_score(F.col("kind"), F.col("n")).alias("s")).collect()
    assert all(r["want"] == r["got"] for r in got) and got[0]["s"] == 0.3 and got[2]["s"] == 0.1
