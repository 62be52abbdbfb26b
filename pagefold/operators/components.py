"""Connected components of a distributed graph by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.plans.partitioning import adaptive_lookup, key_loads, merge_lookup
from pagefold.plans.shared import checkpointed, stored


def shared_item_edges(df: DataFrame, node: str, item: str) -> DataFrame:
    """Edges ``a, b`` that join all nodes holding one ``item``: a star around the smallest node, never all pairs.

    Items of one node only give no edge. Nulls in either column give none.
    """
    held = df.select(F.col(node).alias("node"), F.col(item).alias("item")).where("node IS NOT NULL AND item IS NOT NULL")
    held = stored(held.distinct())  # read for the holders, the sketch and the join
    return holder_edges(held, held.groupBy("item").agg(F.min("node").alias("holder"), F.max("node").alias("top")))


def holder_edges(held: DataFrame, holders: DataFrame) -> DataFrame:
    """Edges ``a, b`` from each node of ``held(node, item)`` to the item's holder; ``holders`` has ``item, holder, top``, each item once, ``top`` its greatest node in ``held``."""
    hubs = holders.where("holder <> top").select("item", "holder")  # a smallest holder that is also the greatest node is alone
    met = merge_lookup(held.select("node", "item"), hubs, "item", F.col("node"), "inner", key_loads(held, "item")[0])
    return met.where("node <> holder").select(F.col("node").alias("a"), F.col("holder").alias("b")).distinct()


def _jump(parents: DataFrame) -> DataFrame:
    """Parents until each points to a root; every step halves the longest chain."""
    while True:
        target = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_grand"))
        nxt = checkpointed(adaptive_lookup(parents, target, "parent").select("node", F.coalesce("_grand", "parent").alias("_new"), "parent"))
        moved = not nxt.where(F.col("_new") != F.col("parent")).isEmpty()
        parents = nxt.select("node", F.col("_new").alias("parent"))
        if not moved:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``edges(a, b)``.

    Each round hooks every node to its smallest neighbour (combined before the shuffle, so a hub of any degree is one
    aggregate), flattens the trees by pointer jumping, and keeps only edges between different roots. Rounds are
    logarithmic in the number of nodes; state is checkpointed in the shared folder. Loops and repeated edges don't
    matter; edges with a null end are dropped; no edges give an empty table.
    """
    live = checkpointed(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    found = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node"))
    live = live.where("a <> b")
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        parents = checkpointed(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("parent")))
        roots = _jump(parents)
        as_key = lambda c: roots.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}"))
        found = checkpointed(adaptive_lookup(found, as_key("component"), "component").select("node", F.coalesce("_component", "component").alias("component")))
        one = adaptive_lookup(live, as_key("a"), "a").select(F.coalesce("_a", "a").alias("a"), "b")
        two = adaptive_lookup(one, as_key("b"), "b").select("a", F.coalesce("_b", "b").alias("b"))
        live = checkpointed(two.where("a <> b").distinct())
    return found
