"""Ranking of closures: scores, levels, which of two overlapping ones gives way, and the ordered selection among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.geometry import area, cover_of_smaller, inter_area, iou
from pagefold.operators.boxjoin import box_join
from pagefold.plans.partitioning import ordered_positions
from pagefold.plans.shared import checkpointed

# Kinds of evidence by the level they speak for.
PRIMITIVE = ("atom", "image", "raster", "drawing", "vector", "line", "rect", "curve", "path", "text", "text_block")
LOCAL = ("image_seed", "captioned_image_seed", "seed_free_isolated_visual", "localized", "content_branch", "subfigure")
FULL = ("visual_community", "layout_column", "caption_anchor_visual", "semantic_annotation_scope")
FULL_TAGS = (*FULL, "same_figure_group", "caption_scope", "figure_anchor", "caption_anchor")
LOCAL_IMAGES = ("image_cluster", "image_seed", "captioned_image_seed")
SEED_BASE = {"border": 0.0, "layout_column": 0.2, "image_seed": 0.0, "image_cluster": 0.1, "captioned_image_seed": 0.05, "caption_anchor_visual": 0.25, "semantic_annotation_scope": 0.2}
MEMBER_SCORE = 0.1
# Shares and ratios that overlapping closures are judged by.
REDUNDANT_IOU, REDUNDANT_COVER = 0.8, 0.9
FULL_HOLDS, FULL_RATIO, SPAN_COVER = 0.9, 8.0, 0.9
COMMUNITY_RATIO, BORDER_RATIO, LAYOUT_RATIO, LAYOUT_LARGER = 9.0, 6.0, 6.0, 1.15
COMPACT_HOLDS, COMPACT_RATIO, COMPACT_SUPPORT, COMPACT_RICH = 0.82, 7.0, 0.62, 0.42
ALTERNATIVE_SHIFT, ALTERNATIVE_LEAST, SUBSUMED_HOLDS = 0.013, 8.0, 0.88


def seed_score(kind: Column, members: Column) -> Column:
    """The score of a seed by its kind of panel and its number of members."""
    base = F.create_map(*[F.lit(x) for kv in SEED_BASE.items() for x in kv])[kind]
    return F.round(F.coalesce(base, F.lit(0.0)) + members * MEMBER_SCORE, 4)


def level(kind: Column, tags: Column, members: Column, given: Column | None = None) -> Column:
    """L0 (primitive), L1 (local) or L2 (whole figure) of a candidate; ``given`` wins if it is one of these."""
    one_of = lambda values: kind.isin(*values) | F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(v) for v in values])), F.lit(False))
    own = (
        F.when(kind.isin(*PRIMITIVE), "L0")
        .when(one_of(("image_cluster",)), F.when(F.coalesce(members, F.lit(0)) > 1, "L2").otherwise("L1"))
        .when(one_of(FULL), "L2")
        .when(one_of(LOCAL), "L1")
        .when(F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(v) for v in PRIMITIVE])), F.lit(False)), "L0")
        .otherwise("L1")
    )
    return own if given is None else F.when(given.isin("L0", "L1", "L2"), given).otherwise(own)


def _c(p: str, name: str) -> Column:
    return F.col(f"{p}{name}")


def _share(part: Column, p: str) -> Column:
    return part / F.greatest(area(p), F.lit(1.0))


def _effective_level(p: str) -> Column:
    return F.when(_c(p, "kind").isin(*LOCAL_IMAGES), "L1").otherwise(level(_c(p, "kind"), F.array(_c(p, "kind")), _c(p, "members")))


def _one_scope(p: str) -> Column:
    return ~_c(p, "multi") & (F.size(_c(p, "captions")) == 1)


def full_beats_local(f: str, p: str) -> Column:
    """A supported whole figure that holds a local part and isn't far larger."""
    supported = ~_c(f, "multi") & (_c(f, "kind").isin(*FULL_TAGS) | (F.size(_c(f, "captions")) > 0) | _c(f, "numbered"))
    holds = (_share(inter_area(f, p), p) >= FULL_HOLDS) & (_share(area(f), p) <= FULL_RATIO)
    return holds & (_effective_level(f) == "L2") & (_effective_level(p) != "L2") & supported


def community_beats_local(f: str, p: str) -> Column:
    """A visual community without caption that holds local images, or a border with far fewer visuals, and more than rasters."""
    kept = (area(p) > 0) & (area(f) > 0) & (inter_area(f, p) / area(p) >= FULL_HOLDS)
    others = _c(f, "vectors") + _c(f, "borders") + _c(f, "bands")
    visuals = lambda x: _c(x, "rasters") + _c(x, "vectors") + _c(x, "borders") + _c(x, "bands")
    over_images = _c(p, "kind").isin(*LOCAL_IMAGES) & (area(f) / area(p) <= COMMUNITY_RATIO) & (_c(f, "rasters") >= 1) & (others >= 2)
    richer = (_c(f, "rasters") >= 2) & (_c(f, "borders") + _c(f, "vectors") >= 2) & (visuals(f) >= F.greatest(F.lit(4), visuals(p) + 3))
    return (_c(f, "kind") == "visual_community") & kept & F.when(_c(p, "kind") == "border", (area(f) / area(p) <= BORDER_RATIO) & richer).otherwise(over_images)


def community_beats_layout(f: str, p: str) -> Column:
    """A visual community that shares its one caption with a layout column, and has more members or more room."""
    kinds = (_c(f, "kind") == "visual_community") & (_c(p, "kind") == "layout_column")
    same = (F.size(_c(f, "captions")) == 1) & (_c(f, "captions") == _c(p, "captions"))
    ratio = area(f) / area(p)
    return kinds & same & (area(p) > 0) & (cover_of_smaller(f, p) >= FULL_HOLDS) & (ratio <= LAYOUT_RATIO) & ((_c(f, "members") > _c(p, "members")) | (ratio >= LAYOUT_LARGER))


def prefers_full(f: str, p: str) -> Column:
    """``f`` is the whole figure that ``p`` is a part of."""
    plain = community_beats_layout(f, p) | full_beats_local(f, p)
    community = community_beats_local(f, p) | ((F.size(_c(f, "captions")) > 0) & plain)
    return ~_c(f, "multi") & F.when(_c(f, "kind") == "visual_community", community).otherwise(plain)


def scoped_beats_span(f: str, p: str) -> Column:
    """A candidate of one caption within one that spans several."""
    within = (F.size(_c(p, "captions")) == 0) | (F.size(F.array_except(_c(f, "captions"), _c(p, "captions"))) == 0)
    return _c(p, "multi") & _one_scope(f) & within & (cover_of_smaller(f, p) >= SPAN_COVER)


def compact_beats_local(f: str, p: str) -> Column:
    """A compact group found without a seed that holds a local candidate; over a caption's visuals only if these are few or weak."""
    visuals = lambda x: _c(x, "rasters") + _c(x, "vectors") + _c(x, "borders") + _c(x, "bands")
    rich = F.when(visuals(p) > 0, visuals(p) / (visuals(p) + 3.0)).otherwise(F.lit(0.0))
    support = F.least(F.lit(1.0), _c(f, "score") / F.greatest(_c(p, "score"), F.lit(1e-6))) + (1 - rich) * COMPACT_RICH
    kinds = (_c(f, "kind") == "seed_free_compact_visual") & F.when(_c(p, "kind") == "caption_anchor_visual", support >= COMPACT_SUPPORT).otherwise(_c(p, "kind").isin(*LOCAL_IMAGES))
    return kinds & (area(f) > 0) & (area(p) > 0) & (inter_area(f, p) / area(p) >= COMPACT_HOLDS) & (area(f) / area(p) <= COMPACT_RATIO) & (visuals(f) >= 2)


def keeps_alternative(f: str, p: str, page_w: float) -> Column:
    """``f``, a lone image that is the only raster of ``p`` as well, has a box of its own and stays beside it."""
    lone = (_c(f, "provenance") != "seed_free") & _c(f, "kind").isin("image_seed", "captioned_image_seed") & (F.size(_c(f, "sources")) == 1)
    first = F.get(_c(f, "sources"), F.lit(0))
    only = F.array_contains(_c(p, "sources"), first) & (F.size(_c(p, "sources")) > 1) & (_c(p, "raster_ids") == F.array(first))
    least = max(ALTERNATIVE_LEAST, page_w * ALTERNATIVE_SHIFT)
    moved = reduce(lambda x, y: x | y, [F.abs(_c(f, s) - _c(p, s)) >= least for s in ("x0", "y0", "x1", "y1")])
    return lone & F.coalesce(only, F.lit(False)) & moved


def is_subsumed(f: str, p: str) -> Column:
    """``f``, found without a seed, has no atom that ``p`` lacks; unless ``p`` is of images it must hold ``f``'s box too."""
    within = _c(p, "kind").isin(*LOCAL_IMAGES) | (_share(inter_area(p, f), f) >= SUBSUMED_HOLDS)
    return (_c(f, "provenance") == "seed_free") & (_c(p, "provenance") != "seed_free") & (F.size(_c(f, "atoms")) > 0) & within & (F.size(F.array_except(_c(f, "atoms"), _c(p, "atoms"))) == 0)


def verdict(a: str, b: str, page_w: float) -> Column:
    """What happens when ``b`` comes after ``a`` and both overlap: ``both`` stay, ``displaces`` (``a`` goes), ``suppressed`` (``b`` goes)."""
    redundant = (iou(b, a) > REDUNDANT_IOU) | (cover_of_smaller(b, a) > REDUNDANT_COVER)
    return (
        F.when(~redundant, "both")
        .when(keeps_alternative(b, a, page_w), "both")
        .when(scoped_beats_span(b, a), "displaces")
        .when(scoped_beats_span(a, b), "suppressed")
        .when(compact_beats_local(b, a), "displaces")
        .when(compact_beats_local(a, b), "suppressed")
        .when(prefers_full(b, a), F.when(keeps_alternative(a, b, page_w), "both").otherwise("displaces"))
        .otherwise("suppressed")
    )


def rivals(ranked: DataFrame, page_w: float) -> DataFrame:
    """``page_idx, a, b, verdict, subsumed`` of pairs of closures of which ``b`` comes later and that aren't simply both kept; ids are ``rank``."""
    pairs = box_join(ranked, ranked, where=F.col("a_rank") < F.col("b_rank"))
    judged = pairs.select("page_idx", F.col("a_rank").alias("a"), F.col("b_rank").alias("b"), verdict("a_", "b_", page_w).alias("verdict"), F.coalesce(is_subsumed("b_", "a_"), F.lit(False)).alias("subsumed"))
    return judged.where("verdict <> 'both' OR subsumed")


def select_in_order(items: DataFrame, judged: DataFrame) -> DataFrame:
    """The ``page_idx, rank`` that stay when items are taken in order of rank.

    An item is suppressed by a present earlier one that suppresses it. If it isn't, it removes those it displaces; then
    it stays, unless a present one subsumes it. All that decides about an item comes earlier, so rounds decide every
    item whose deciders are decided: the sequential result on all pages at once, and no page is gathered. ``judged``
    has ``a`` (earlier), ``b``, ``verdict`` and ``subsumed``.
    """
    judged = checkpointed(judged)
    moves = judged.where("verdict = 'displaces'").select("page_idx", F.col("b").alias("c"), "a")
    holds = judged.where("verdict = 'suppressed' OR (subsumed AND verdict <> 'displaces')").select("page_idx", "a", "b", (F.col("verdict") == "suppressed").alias("hard"))
    between = holds.join(moves, ["page_idx", "a"]).where("c < b").select("page_idx", "b", F.col("c").alias("x"))
    needs = checkpointed(holds.select("page_idx", "b", F.col("a").alias("x")).union(between).distinct())
    rank = lambda t, c: t.select("page_idx", F.col(c).alias("rank"))
    every = items.select("page_idx", "rank")
    open_ = checkpointed(rank(judged, "b").union(rank(judged, "a")).distinct())
    done = None
    while not open_.isEmpty():
        waits = rank(needs.join(open_.withColumnRenamed("rank", "x"), ["page_idx", "x"], "left_semi"), "b").distinct()
        ready = open_.join(waits, ["page_idx", "rank"], "left_anti")
        if done is None:
            now = ready.select("page_idx", "rank", F.lit(True).alias("entered"), F.lit(True).alias("stayed"))
        else:
            asked = holds.join(ready.withColumnRenamed("rank", "b"), ["page_idx", "b"], "left_semi")
            asked = asked.join(done.where("stayed").select("page_idx", F.col("rank").alias("a")), ["page_idx", "a"], "left_semi")
            took = moves.join(done.where("entered").select("page_idx", F.col("rank").alias("c")), ["page_idx", "c"], "left_semi").groupBy("page_idx", "a").agg(F.min("c").alias("gone_at"))
            present = asked.join(took, ["page_idx", "a"], "left").where("gone_at IS NULL OR gone_at >= b")
            fate = present.groupBy("page_idx", F.col("b").alias("rank")).agg(F.bool_or("hard").alias("hard"))
            now = ready.join(fate, ["page_idx", "rank"], "left").select("page_idx", "rank", (~F.coalesce("hard", F.lit(False))).alias("entered"), F.col("hard").isNull().alias("stayed"))
        now = checkpointed(now)
        done = now if done is None else done.unionByName(now)
        open_ = checkpointed(open_.join(now.select("page_idx", "rank"), ["page_idx", "rank"], "left_anti"))
    if done is None:
        return every
    removed = rank(moves.join(done.where("entered").select("page_idx", F.col("rank").alias("c")), ["page_idx", "c"], "left_semi"), "a").distinct()
    out = rank(done.where("NOT stayed"), "rank").union(removed).distinct()
    return every.join(out, ["page_idx", "rank"], "left_anti")


def rank_closures(scored: DataFrame, page_w: float) -> DataFrame:
    """Scored closures with ``rank`` (0, 1, ... by score, then seed, on each page) and ``kept``.

    ``scored`` has ``page_idx, seed, score, kind, provenance, members, multi, numbered, captions, sources, atoms,
    raster_ids``, counts ``rasters, vectors, borders, bands`` and a box. Rows with a null list count as not overlapping.
    """
    ranked = checkpointed(ordered_positions(scored, "page_idx", [F.col("score").desc(), F.col("seed").asc()]).withColumnRenamed("group_pos", "rank"))
    kept = select_in_order(ranked, rivals(ranked, page_w)).withColumn("kept", F.lit(True))
    return ranked.join(kept, ["page_idx", "rank"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
