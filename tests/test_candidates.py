from pyspark.sql import functions as F

from pagefold.operators import candidates as c

BOXES = "page_idx bigint, ord int, x0 double, y0 double, x1 double, y1 double"


def test_later_near_duplicates_and_tiny_images_fall_out(spark):
    rows = [(1, 1, -5.0, 0.0, 100.0, 100.0), (1, 2, 0.0, 0.0, 100.0, 99.0), (1, 3, 0.0, 0.0, 7.0, 9.0), (1, 4, 40.0, 40.0, 60.0, 60.0), (1, 5, 50.0, 50.0, 160.0, 160.0), (2, 2, 0.0, 0.0, 100.0, 99.0)]
    found = spark.createDataFrame(rows, BOXES).withColumn("source", F.lit("xref"))
    out = c.distinct_images(found, 200.0, 200.0)
    assert {(r["page_idx"], r["ord"], r["x0"]) for r in out.collect()} == {(1, 1, 0.0), (1, 5, 50.0), (2, 2, 0.0)}
    assert c.distinct_images(found.limit(0), 200.0, 200.0).count() == 0
    listed = found.withColumn("source", F.when(F.col("ord") == 2, "text_dict").otherwise("xref"))  # comes first and always stays
    assert {(r["page_idx"], r["ord"]) for r in c.distinct_images(listed, 200.0, 200.0).collect()} == {(1, 2), (1, 5), (2, 2)}


def test_closures_are_scored_and_ranked(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0, 0, "image_seed", 0.9), (1, 2, 0.0, 0.0, 10.0, 10.0, 0, 0, None, 0.9), (1, 3, 0.0, 0.0, 100.0, 50.0, 0, 0, "visual_community", 0.9), (1, 4, 0.0, 0.0, 0.0, 10.0, 9, 9, "border", 0.9), (1, 5, 0.0, 0.0, 10.0, 10.0, 1, 1, "image_seed", 0.1)]
    df = spark.createDataFrame(rows, "page_idx int, seed int, x0 double, y0 double, x1 double, y1 double, nodes bigint, atoms bigint, evidence string, seed_score double")
    df = df.withColumns({"level": F.lit("L2"), "multi": F.lit(False), "captions": F.lit(0), "supported": F.lit(False)})
    got = {r["seed"]: (r["score"], r["rank"]) for r in c.closure_scores(df, 10_000.0).collect()}
    assert got == {2: (0.7, 1), 1: (0.65, 2), 5: (0.5218, 3), 3: (0.05, 4)}
    dear = df.withColumns({"level": F.lit("L1"), "multi": F.col("seed") == 1, "supported": F.lit(True)})
    assert {r["seed"]: r["score"] for r in c.closure_scores(dear, 10_000.0).collect()} == {2: 0.6, 1: -0.35, 5: 0.4218, 3: -1.25}


def test_lifecycle_marks_the_chosen(spark):
    df = spark.createDataFrame([(1, 1, 1.5), (1, 2, 2.5)], "page_idx int, ord int, score double")
    assert {(r["ord"], r["stage"], r["decision"]) for r in c.lifecycle(df, df.where("ord = 2"), "s", "why", 0.5).collect()} == {(1, "s", "suppressed"), (2, "s", "selected")}
    assert {(r["reason"], r["threshold"], r["score"]) for r in c.lifecycle(df, df.where("ord = 2"), "s", "why", 0.5).collect()} == {("why", 0.5, 1.5), (None, 0.5, 2.5)}


def test_dense_fills_make_a_composite(spark):
    fills = [(1, i, 50.0 + 20 * (i % 4), 50.0 + 20 * (i // 4), 62.0 + 20 * (i % 4), 62.0 + 20 * (i // 4), None, True) for i in range(8)]
    few = [(2, i, 50.0 + 15 * i, 50.0, 60.0 + 15 * i, 80.0, None, True) for i in range(4)]
    df = spark.createDataFrame(fills + few, BOXES + ", orientation string, filled boolean")
    assert [(r["page_idx"], r["members"], r["fills"]) for r in c.composites(df, 600.0, 760.0).collect()] == [(1, 8, 8)]
    assert c.composites(df.limit(0), 600.0, 760.0).count() == 0
