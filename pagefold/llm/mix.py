"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.plans.partitioning import ordered_positions
from pagefold.plans.shared import stored
from pagefold.sources.tables import fixed_rows

#: Sources that one mix takes; their targets and totals are held on the driver.
MAX_SOURCES = 5_000
#: Straight pieces of all schedules together; they are broadcast.
MAX_PIECES = 100_000
#: How far weights drift over the training by default: the heaviest source begins at 1 + RAMP / 2 of its weight.
RAMP = 0.5


def default_schedules(weights: dict[str, float], ramp: float = RAMP) -> dict[str, list[tuple[float, float]]]:
    """Knots ``(time, relative weight)`` per source: heavy sources fade and light ones grow, in a straight line.

    At each time the weights add up to the same total, and each source's mean over time is its target.
    """
    order = sorted(weights, key=lambda s: (weights[s], s))
    rank = {s: i / max(1, len(order) - 1) for i, s in enumerate(order)}
    total = sum(weights.values()) or 1.0
    middle = sum(weights[s] * rank[s] for s in order) / total
    return {s: [(0.0, 1 + ramp * (rank[s] - middle)), (1.0, 1 - ramp * (rank[s] - middle))] for s in order}


def integrate(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """Pieces ``(t0, t1, w0, w1, c0, c1)`` of a piecewise-linear weight from time 0 to 1; c is its integral, scaled to end at 1."""
    knots = sorted(knots)
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule has knots from time 0 to 1 and weights that aren't negative")
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    if not (whole := sum(area)):
        raise ValueError("a schedule needs some weight")
    out, c = [], 0.0
    for (a, b), x in zip(zip(knots, knots[1:], strict=False), area, strict=True):
        out.append((a[0], b[0], a[1] / whole, b[1] / whole, c, c + x / whole))
        c += x / whole
    return out


def plan_mix(sizes: DataFrame, targets: DataFrame, share: float) -> list[dict]:
    """One dict per target: ``source, key, weight, repeats, tokens, demand, reach, documents``.

    ``sizes`` has ``key`` (source, null for none) and ``n_tokens``. Demand is weight x ``share`` x the tokens of all rows,
    compared exactly as written in decimal; a source's reach is its tokens ``max_repeats`` times or the demand, the
    smaller. Totals are combined before the shuffle and kept for targets only.
    """
    rows = fixed_rows(targets.select("source", "key", "target_weight", "max_repeats").orderBy("source"), "targets", MAX_SOURCES)
    keys = sizes.sparkSession.createDataFrame([(k, True) for k in dict.fromkeys(r["key"] for r in rows) if k is not None], "key string, _on boolean")
    sums = sizes.join(F.broadcast(keys), "key", "left").groupBy(F.when(F.col("_on"), F.col("key")).alias("key")).agg(F.sum("n_tokens").alias("t"), F.count_if(F.col("n_tokens") > 0).alias("d"))
    of = {r["key"]: (r["t"] or 0, r["d"]) for r in sums.collect()}
    whole = sum(t for t, _ in of.values())
    out = []
    for r in rows:
        tokens, documents = of.get(r["key"], (0, 0)) if r["key"] is not None else (0, 0)
        repeats, weight = max(0, r["max_repeats"] or 0), Fraction(str(r["target_weight"] or 0))
        demand = weight * Fraction(str(share)) * whole
        out.append({"source": r["source"], "key": r["key"], "weight": weight, "repeats": repeats, "tokens": tokens, "documents": documents, "asked": Fraction(str(share)) * whole, "demand": demand, "reach": min(demand, Fraction(repeats * tokens))})
    return out


def mix_documents(sizes: DataFrame, key: str, plan: list[dict], schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 5) -> DataFrame:
    """Training order: ``key, source, copy, n_tokens, position`` sorted by position in [0, 1).

    Each source's documents stand in a seeded random order, copy after copy, with their running sum of tokens; a copy
    is drawn while its middle lies within the source's reach, so no document occurs more than ``max_repeats`` times.
    Its running sum over the reach is the source's cumulative demand, and inverting the integrated weight schedule
    gives the time at which the curriculum asks for it. A global range sort by that time mixes the sources. Documents
    of no target or without tokens aren't drawn. Running sums come from a range sort, so one source may hold any share.
    """
    spark = sizes.sparkSession
    weights = {p["key"]: float(p["weight"]) for p in plan if p["key"] is not None and p["reach"] > 0}
    chosen = default_schedules(weights) | {k: v for k, v in (schedules or {}).items() if k in weights}
    rows = {p["key"]: (p["key"], p["source"], float(p["reach"]), int(p["tokens"]), int(p["repeats"])) for p in plan if p["key"] in weights}
    reach = spark.createDataFrame(list(rows.values()), "_key string, source string, _reach double, _tokens long, _repeats int")
    pieces = [(k, *piece) for k, knots in chosen.items() for piece in integrate(knots)]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"schedules have more than {MAX_PIECES} pieces")
    bends = spark.createDataFrame(pieces, T.StructType([T.StructField("_k", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("_t0", "_t1", "_w0", "_w1", "_c0", "_c1")]]))
    own = sizes.select(F.col(key).alias("_id"), "key", "n_tokens").where("n_tokens > 0")
    own = own.join(F.broadcast(reach.select("_key")), F.col("key") == F.col("_key"), "left_semi").withColumn("_u", F.xxhash64(F.lit(seed), F.col("_id")))
    run = ordered_positions(own, "key", [F.col("_u").asc(), F.col("_id").asc()], "n_tokens", cheap=True).drop("_u", "group_pos")
    drawn = run.join(F.broadcast(reach), F.col("key") == F.col("_key"))
    middle = F.col("group_before") + F.col("n_tokens") / 2
    copies = F.least(F.col("_repeats"), F.floor((F.col("_reach") - middle) / F.col("_tokens")).cast("int") + 1)
    drawn = drawn.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    at = F.least(((F.col("copy") - 1) * F.col("_tokens") + middle) / F.col("_reach"), F.lit(1 - 2**-40))
    drawn = drawn.withColumn("_y", at).join(F.broadcast(bends), (F.col("key") == F.col("_k")) & (F.col("_y") >= F.col("_c0")) & (F.col("_y") < F.col("_c1")))
    # inside a piece the integral is w0 x + (w1 - w0) x^2 / (2 span): its root in the form that has no cancellation
    span, y = F.col("_t1") - F.col("_t0"), F.col("_y") - F.col("_c0")
    slope = (F.col("_w1") - F.col("_w0")) / span
    x = F.try_divide(2 * y, F.col("_w0") + F.sqrt(F.greatest(F.col("_w0") * F.col("_w0") + 2 * slope * y, F.lit(0.0))))
    placed = drawn.withColumn("position", F.col("_t0") + F.least(F.coalesce(x, F.lit(0.0)), span))
    return placed.select(F.col("_id").alias(key), "source", "copy", "n_tokens", "position").orderBy("position", "source", key, "copy")


def mix_report(mixed: DataFrame, plan: list[dict], share: float) -> DataFrame:
    """A row per target, measured on the ``mixed`` table: what was asked for, what was drawn, and ``short``.

    ``target_share`` is the weight; ``share_of_target`` the drawn tokens over the whole size asked for (``share`` of
    all tokens), ``actual_share`` over all drawn tokens: sources that fall short leave the mix smaller than asked for,
    so that the others' actual shares lie above their weights. A source is ``short`` if every copy of all its documents
    was drawn and they still are fewer tokens than its demand. Sources without documents have zeros. ``mixed`` is read
    twice: give it stored.
    """
    spark = mixed.sparkSession
    head = spark.createDataFrame(
        [(p["source"], float(p["weight"]), p["repeats"], p["documents"], p["tokens"], float(p["demand"]), math.ceil(p["demand"])) for p in plan],
        "source string, target_share double, max_repeats int, documents long, tokens long, demand double, _least long",
    )
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("drawn"), F.sum("n_tokens").alias("drawn_tokens"), F.max("copy").alias("most_copies"))  # a row per target
    drawn = mixed.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    asked = float(plan[0]["asked"]) if plan else 0.0
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = head.join(F.broadcast(got), "source", "left").withColumns({c: zero(F.col(c)) for c in ("drawn", "drawn_tokens", "most_copies")})
    part = lambda whole: F.coalesce(F.try_divide("drawn_tokens", F.lit(float(whole))), F.lit(0.0))
    short = (F.col("drawn_tokens") == F.col("max_repeats") * F.col("tokens")) & (F.col("drawn_tokens") < F.col("_least"))
    return out.withColumns({"share_of_target": part(asked), "actual_share": part(drawn), "short": short}).drop("_least")


def token_sizes(documents: DataFrame, key: str, source, count) -> DataFrame:
    """``key, key of the source, n_tokens`` of all documents, computed once and kept in the shared folder."""
    return stored(count(documents.select(key, source.alias("key"), "text"), "text"))
