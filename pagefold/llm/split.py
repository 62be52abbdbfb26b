"""Splits that keep related records together, on a component table that grows with the data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.operators.components import connected_components, holder_edges
from pagefold.plans.partitioning import adaptive_lookup, ordered_positions
from pagefold.plans.shared import checkpointed, children, remove, stored

#: A new component with more than this share of the new rows is placed on its own; there are 1,000 at most.
LARGE_SHARE = 0.001
QUARANTINE = "quarantine"
TABLE = T.StructType([T.StructField("node", T.StringType()), T.StructField("component", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("split", T.StringType()), T.StructField("conflict", T.BooleanType())])
ITEMS = T.StructType([T.StructField("item", T.StringType()), T.StructField("holder", T.StringType())])


class Components(NamedTuple):
    """The persisted state: ``nodes`` (TABLE) and ``items`` (ITEMS, one node that holds each item)."""

    nodes: DataFrame
    items: DataFrame


class ComponentStore:
    """The component table under a name in a folder that all executors and later runs share.

    Each update is a version ``v00000001, v00000002, ...`` of two parquet tables; a version counts once its nodes, which
    are written last, are complete, so an update that was lost leaves the one before in force. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[str]:
        whole = lambda v: "_SUCCESS" in children(self.spark, f"{self.path}/{v}/nodes")
        return [v for v in children(self.spark, self.path) if v.startswith("v") and whole(v)]

    def load(self) -> Components | None:
        """The latest state; None before the first update."""
        return self._read(known[-1]) if (known := self.versions()) else None

    def _read(self, version: str) -> Components:
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{version}/{name}")
        return Components(read("nodes", TABLE), read("items", ITEMS))

    def update(self, rows: DataFrame, node: str, item: str, shares: dict[str, float]) -> Components:
        """Joins a batch to the latest state and keeps the result as the next version."""
        known = self.load()
        held = [int(v[1:]) for v in children(self.spark, self.path) if v[1:].isdigit()]
        version = f"v{max(held, default=0) + 1:08d}"
        now = update_components(rows, node, item, shares, known)
        now.items.write.parquet(f"{self.path}/{version}/items")
        now.nodes.write.parquet(f"{self.path}/{version}/nodes")
        return self._read(version)

    def clean(self, keep: int = 2) -> None:
        """Removes all but the latest ``keep`` versions and what lost updates left behind."""
        kept = self.versions()[-max(1, keep) :]
        for v in children(self.spark, self.path):
            if v not in kept:
                remove(self.spark, f"{self.path}/{v}")


def _place_new(sizes: DataFrame, shares: dict[str, float], have: dict[str, int]) -> DataFrame:
    """``component, split`` of new components: the large ones one by one to the split that lacks most, the rest by a
    random order cut where the deficits end."""
    spark = sizes.sparkSession
    new = sizes.agg(F.sum("rows")).first()[0] or 0
    total = new + sum(have.values())
    lack = {s: share * total - have.get(s, 0) for s, share in shares.items()}
    large = sizes.where(F.col("rows") > LARGE_SHARE * new).collect()
    fixed = []
    for r in sorted(large, key=lambda r: (-r["rows"], r["component"])):
        to = max(lack, key=lambda s: (lack[s], s))
        fixed.append((r["component"], to))
        lack[to] -= r["rows"]
    small = sizes.where(F.col("rows") <= LARGE_SHARE * new).select("component", "rows", F.lit(0).alias("_all"), F.xxhash64("component").alias("_u"))
    rest = new - sum(r["rows"] for r in large)
    open_ = {s: max(0.0, x) for s, x in lack.items()}
    whole = sum(open_.values()) or 1.0
    upto, split, names = 0.0, F.lit(None).cast("string"), sorted(open_)
    bounds = []
    for s in names:
        upto += open_[s] / whole * rest
        bounds.append((s, upto))
    middle = F.col("group_before") + F.col("rows") / 2
    split = F.lit(max(open_, key=lambda s: (open_[s], s)))
    for s, bound in reversed(bounds):
        split = F.when(middle < bound, F.lit(s)).otherwise(split)
    ordered = ordered_positions(small, "_all", [F.col("_u").asc(), F.col("component").asc()], "rows", cheap=True)
    return ordered.select("component", split.alias("split")).union(spark.createDataFrame(fixed, "component string, split string"))


def update_components(rows: DataFrame, node: str, item: str, shares: dict[str, float], known: Components | None = None) -> Components:
    """The components after ``rows`` (a batch) joined ``known`` (the state before; null at first).

    Nodes that share an item, of this batch or an earlier one, are related, and so are chains of them. Components that
    were known keep their split; a component of new nodes fills the split that lacks most; new nodes that join a known
    component take its split. Where a batch joins known components of different splits, their old nodes keep theirs,
    the new ones come out as ``quarantine``, and all are marked ``conflict``. ``rows`` counts rows of all batches. Rows
    with a null node are dropped, a null item relates nothing. An empty batch gives the state as it was. The batch is
    read once; the result is written to the shared folder and read from there, so it outlives executors.
    """
    if not shares or any(x < 0 for x in shares.values()) or QUARANTINE in shares:
        raise ValueError("shares are named and not negative")
    batch = rows.select(F.col(node).cast("string").alias("node"), F.col(item).cast("string").alias("item")).where("node IS NOT NULL")
    batch = stored(batch.groupBy("node", "item").agg(F.count(F.lit(1)).alias("n")))  # repeated rows are one
    held = batch.where("item IS NOT NULL")
    holders = held.groupBy("item").agg(F.min("node").alias("low"), F.max("node").alias("top"))
    if known is None:
        holders = stored(holders.select("item", F.col("low").alias("holder"), "top"))
        edges = holder_edges(held, holders)
    else:
        # an item's holder of an earlier batch stays; all its nodes of this batch are tied to it
        holders = stored(holders.join(known.items, "item", "full").select("item", F.coalesce("holder", "low").alias("holder"), "low", "top"))
        tied = F.when(F.col("low") == F.col("top"), F.when(F.col("holder") != F.col("low"), F.col("low"))).otherwise(F.when(F.col("holder") == F.col("top"), F.col("low")).otherwise(F.col("top")))
        edges = holder_edges(held, holders.where("low IS NOT NULL").select("item", "holder", F.coalesce(tied, "holder").alias("top")))
        for c, other in (("a", "b"), ("b", "a")):
            now = known.nodes.select(F.col("node").alias(c), F.col("component").alias("_c"))
            edges = adaptive_lookup(edges, now, c).select(other, F.coalesce("_c", c).alias(c))
    joined = connected_components(edges.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    every = batch.groupBy("node").agg(F.sum("n").alias("_new"))
    if known is None:
        every = every.select("node", F.col("node").alias("component"), F.col("_new").alias("rows"), F.lit(None).cast("string").alias("_split"), F.lit(None).cast("boolean").alias("_conflict"))
    else:
        old = known.nodes.select("node", "component", F.col("rows").alias("_old"), F.col("split").alias("_split"), F.col("conflict").alias("_conflict"))
        every = old.join(every, "node", "full").select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("_old", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("rows"), "_split", "_conflict")
    every = adaptive_lookup(every, joined, "component")
    every = stored(every.select("node", F.coalesce("_to", "component").alias("component"), "rows", "_split", "_conflict"))
    settled = F.col("_split") != QUARANTINE
    whole = every.groupBy("component").agg(
        F.sum("rows").alias("rows"), F.min(F.when(settled, F.col("_split"))).alias("_lo"), F.max(F.when(settled, F.col("_split"))).alias("_hi"), F.coalesce(F.bool_or("_conflict"), F.lit(False)).alias("_was")
    )
    whole = checkpointed(whole)
    have = {} if known is None else {r["_split"]: r["n"] for r in every.groupBy("_split").agg(F.sum("rows").alias("n")).where(F.col("_split").isin(list(shares))).collect()}
    placed = _place_new(whole.where("_lo IS NULL").select("component", "rows"), shares, have)
    clash = (F.col("_lo") != F.col("_hi")) | F.col("_was")
    state = whole.where("_lo IS NOT NULL").select("component", F.when(clash, QUARANTINE).otherwise(F.col("_lo")).alias("_take"), clash.alias("conflict"))
    state = state.union(placed.select("component", "split", F.lit(False)))
    out = adaptive_lookup(every, state, "component").select("node", "component", "rows", F.coalesce("_split", "_take").alias("split"), "conflict")
    return Components(stored(out, "components"), holders.select("item", "holder"))


def related_classes(members: DataFrame, member: str, component: str) -> DataFrame:
    """One row per different ``member``: its class and the number of other members in it. Repeated rows count once, null members and classes are dropped."""
    one = stored(members.select(member, component).where(F.col(member).isNotNull() & F.col(component).isNotNull()).distinct())
    sizes = one.groupBy(component).agg((F.count(F.lit(1)) - 1).alias("links"))
    return adaptive_lookup(one, sizes, component).select(member, component, "links")


def related_pairs(members: DataFrame, member: str, component: str) -> DataFrame:
    """Pairs ``(member_a, member_b)``, smaller first, of different members of a component.

    For consumers that ask for pairs; ``related_classes`` says the same in one row per member. Classes of one member
    fall out before the join, hot classes are cut by the adaptive skew join.
    """
    one = related_classes(members, member, component).where("links > 0").select(F.col(component).alias("_c"), F.col(member).alias(f"{member}_a"))
    one = stored(one)
    two = one.select("_c", F.col(f"{member}_a").alias(f"{member}_b"))
    return one.join(two.hint("merge"), "_c").where(F.col(f"{member}_a") < F.col(f"{member}_b")).select(f"{member}_a", f"{member}_b")
