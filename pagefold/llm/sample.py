"""A sample that follows target proportions of cross-classified cells."""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.plans.partitioning import ordered_positions
from pagefold.sources.tables import fixed_rows

#: Target cells that one call takes; the flow network over them is solved on the driver. More are refused.
MAX_CELLS = 2_000
#: Parts of a page that flows are counted in; quotas of cells are fractions until they are drawn.
PARTS = 1_000
#: Steps in which a cell or margin moves away from its target, each a tenth of it and dearer than the one before.
STEPS = 10


@dataclass(frozen=True)
class Target:
    """One target cell: its two labels as keys (None matches nothing), share of the sample and floor."""

    first: str | None
    second: str | None
    share: Fraction
    floor: int


class _Flow:
    """Min-cost flow by shortest paths and blocking flows on a small network with whole capacities and costs of 0 or more."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.cap, self.cost = [], [], []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def run(self, s: int, t: int, amount: int) -> int:
        """Sends up to ``amount``; the rest, for which there is no path, comes back."""
        height = [0] * len(self.out)
        while amount:
            far: list[float] = [math.inf] * len(self.out)
            far[s], queue = 0, [(0, s)]
            while queue:
                d, x = heapq.heappop(queue)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.cap[e] and (n := d + self.cost[e] + height[x] - height[y]) < far[y]:
                        far[y] = n
                        heapq.heappush(queue, (n, y))
            if far[t] == math.inf:
                return amount
            top = max(f for f in far if f < math.inf)
            height = [h + int(f if f < math.inf else top) for h, f in zip(height, far, strict=True)]
            nxt, blocked = [0] * len(self.out), [False] * len(self.out)
            while amount and (path := self._tight_path(s, t, height, nxt, blocked)):
                most = min(amount, *(self.cap[e] for e in path))
                amount -= most
                for e in path:
                    self.cap[e] -= most
                    self.cap[e ^ 1] += most
        return 0

    def _tight_path(self, s: int, t: int, height: list[int], nxt: list[int], blocked: list[bool]) -> list[int]:
        """A path of open arcs without reduced cost; nodes from which none leads on are left out of later searches."""
        path, at, on = [], s, {s}
        while at != t:
            while nxt[at] < len(self.out[at]):
                e = self.out[at][nxt[at]]
                y = self.to[e]
                if self.cap[e] and not blocked[y] and y not in on and self.cost[e] + height[at] == height[y]:
                    break
                nxt[at] += 1
            else:
                blocked[at] = True
                if not path:
                    return []
                on.discard(at)
                at = self.to[path.pop() ^ 1]
                continue
            path.append(e)
            at = y
            on.add(at)
        return path


def cell_targets(shares: list[Fraction], floors: list[int], size: int) -> list[Fraction]:
    """Pages wanted of each cell: its floor or its part of what is left, the greater; the whole is ``size`` (the floors, if they are more)."""
    if sum(floors) >= size:
        return [Fraction(f) for f in floors]
    fixed: set[int] = set()
    while True:
        rest, of = size - sum(floors[i] for i in fixed), sum(s for i, s in enumerate(shares) if i not in fixed)
        level = Fraction(rest) / of if of else Fraction(0)
        under = {i for i, s in enumerate(shares) if i not in fixed and s * level < floors[i]}
        if not under:
            return [Fraction(floors[i]) if i in fixed else s * level for i, s in enumerate(shares)]
        fixed |= under


def _whole(parts: list[Fraction], total: int) -> list[int]:
    """Whole numbers near ``parts`` that add up to ``total``: the largest remainders are rounded up."""
    low = [math.floor(p) for p in parts]
    order = sorted(range(len(parts)), key=lambda i: (low[i] - parts[i], i))
    for i in order[: max(0, total - sum(low))]:
        low[i] += 1
    return low


def _network(cells: list[tuple], wanted: list[int], floors: list[int], have: list[int], spill: bool) -> tuple[list[int], list[int]]:
    """``(placed, slack)`` per cell, in parts of a page.

    Source, first labels, second labels, sink: arcs from the source and to the sink carry the margins, what cells of a
    label want together; arcs between the labels are the cells, as wide as their pages. With ``spill`` an arc may carry
    more than wanted, up to the pages there are, and a margin may be passed; both in steps, so that what one cell lacks
    spreads over others in proportion. Dearest is to leave out a floor, then to pass a margin, then to move a cell.
    Without it each cell's slack arc carries what the cell lacks.
    """
    firsts, seconds = list(dict.fromkeys(a for a, _ in cells)), list(dict.fromkeys(b for _, b in cells))
    at_first, at_second = {a: 2 + i for i, a in enumerate(firsts)}, {b: 2 + len(firsts) + i for i, b in enumerate(seconds)}
    turns = len(firsts) + len(seconds) + 2
    middle = 1 + STEPS  # cost of a cell at its target: costs below it draw, above it repel
    margin = 2 * middle * turns
    floor = margin * (STEPS + 1) * turns
    flow = _Flow(2 + len(firsts) + len(seconds))
    steps = lambda n: [max(1, n // STEPS)] * STEPS
    for side, at, way in ((0, at_first, lambda x: (0, x)), (1, at_second, lambda x: (x, 1))):
        for label, node in at.items():
            whole = sum(w for c, w in zip(cells, wanted, strict=True) if c[side] == label)
            flow.arc(*way(node), whole, 0)
            if spill:
                for k, n in enumerate([*steps(whole)[:-1], sum(have)], 1):
                    flow.arc(*way(node), n, margin * k)
    arcs: list[list[int]] = []
    slack = []
    for (a, b), w, f, h in zip(cells, wanted, floors, have, strict=True):
        x, y, own = at_first[a], at_second[b], min(w, h)
        kept = min(f, own)
        mine = [flow.arc(x, y, kept, 0)]
        left = own - kept
        if not spill:
            mine.append(flow.arc(x, y, left, 0))
            slack.append(flow.arc(x, y, w - own, floor))
        else:
            for k, n in enumerate(steps(left)):  # the first steps are the last to go
                n = min(n, left) if k < STEPS - 1 else left
                mine.append(flow.arc(x, y, n, floor + 1 + k))
                left -= n
            left = h - own
            for k, n in enumerate(steps(max(w, PARTS)), 1):
                n = min(n, left) if k < STEPS else left
                mine.append(flow.arc(x, y, n, floor + middle + k))
                left -= n
        arcs.append(mine)
    flow.run(0, 1, sum(wanted))
    return [sum(flow.used(e) for e in mine) for mine in arcs], [flow.used(e) for e in slack]


def draw_quotas(cells: list[tuple], placed: list[int], seed: int) -> list[int]:
    """Whole quotas drawn at random: each cell's mean is its placed fraction, and no cell, margin or total moves by a whole page.

    Fractional arcs of the flow always close cycles. A cycle is shifted one way or the other, with odds that keep the
    means, until one of its arcs is whole; every draw settles an arc.
    """
    rng = random.Random(seed)
    ends = [(("first", a), ("second", b)) for a, b in cells]
    value = list(placed)
    for side, name in enumerate(("first", "second")):  # margins: arcs from and to one hub, as the whole is whole
        for label in dict.fromkeys(c[side] for c in cells):
            ends.append((("hub", None), (name, label)) if side == 0 else ((name, label), ("hub", None)))
            value.append(sum(p for c, p in zip(cells, placed, strict=True) if c[side] == label))
    near: dict[tuple, set[int]] = {}
    for e, arc in enumerate(ends):
        for n in arc if value[e] % PARTS else ():
            near.setdefault(n, set()).add(e)
    while start := next((n for n, held in near.items() if held), None):
        path, seen, at, came = [], {start: 0}, start, None
        while True:
            e = min(x for x in near[at] if x != came)
            forth = ends[e][0] == at
            path.append((e, 1 if forth else -1))
            at, came = ends[e][forth], e
            if at in seen:
                path = path[seen[at] :]
                break
            seen[at] = len(path)
        up = min(-w * value[e] % PARTS for e, w in path)
        down = min(w * value[e] % PARTS for e, w in path)
        shift = up if rng.random() * (up + down) < down else -down
        for e, w in path:
            value[e] += w * shift
            if value[e] % PARTS == 0:
                for n in ends[e]:
                    near[n].discard(e)
    return [v // PARTS for v in value[: len(cells)]]


def cell_quotas(targets: list[Target], available: list[int], size: Fraction, seed: int = 17) -> list[dict]:
    """Quotas of target cells by two min-cost flows; a row per target with ``need, available, own, slack, wanted, quota``.

    ``need`` is the greater of floor and share x ``size``, rounded up. The first flow sends each need to its own cell or
    over its slack arc: ``own < need`` is a target that cannot be met, ``slack`` what it lacks. The second one places
    the sample: cells want floors and shares of ``size`` (floors lower the other cells; if they are more than
    ``size``, the sample is that large), and what a cell lacks goes to others so that both margins stay at
    their targets as far as pages allow. Whole quotas are drawn from its fractions. Targets with the same labels are one
    cell: its shares and the greatest floor, and each target's row shows the cell's quota.
    """
    need = [max(t.floor, math.ceil(t.share * size)) for t in targets]
    cells = list(dict.fromkeys((t.first, t.second) for t in targets))
    if not cells:
        return []
    _, lack = _network([(i, i) for i in range(len(targets))], need, need, available, spill=False)
    of = lambda c: [i for i, t in enumerate(targets) if (t.first, t.second) == c]
    members = {c: of(c) for c in cells}
    floors = [max(targets[i].floor for i in members[c]) for c in cells]
    have = [available[members[c][0]] for c in cells]
    wanted = cell_targets([sum((targets[i].share for i in members[c]), Fraction(0)) for c in cells], floors, math.floor(size + Fraction(1, 2)))
    parts = _whole([w * PARTS for w in wanted], int(sum(wanted)) * PARTS)
    placed, _ = _network(cells, parts, [f * PARTS for f in floors], [h * PARTS for h in have], spill=True)
    quota = dict(zip(cells, draw_quotas(cells, placed, seed), strict=True))
    want = dict(zip(cells, wanted, strict=True))
    return [
        {"need": need[i], "available": available[i], "own": need[i] - lack[i], "slack": lack[i], "wanted": float(want[t.first, t.second]), "quota": quota[t.first, t.second]}
        for i, t in enumerate(targets)
    ]


REPORT = [T.StructField(c, T.DoubleType() if c == "wanted" else T.LongType()) for c in ("need", "available", "own", "slack", "wanted", "quota")]


def plan_sample(pages: DataFrame, targets: DataFrame, labels: tuple[str, str], target_keys: tuple[str, str], share: float, seed: int = 17) -> DataFrame:
    """The report: the columns of ``targets`` and ``need, available, own, slack, wanted, quota`` per target.

    ``pages`` has the two ``labels`` (null: no label); ``targets`` the columns ``target_keys`` (keys of the labels),
    ``target_share`` and ``min_pages``; nulls there count as 0. The sample's size is ``share`` of all pages with both
    labels. Counts per cell are combined before the shuffle and restricted to target cells, so the driver sees
    MAX_CELLS + 1 rows at most. Targets without pages come out with 0; an empty table meets no target above 0.
    """
    spark, (a, b), (ka, kb) = pages.sparkSession, labels, target_keys
    rows = fixed_rows(targets.orderBy(*[F.col(c).asc_nulls_first() for c in targets.columns]), "targets", MAX_CELLS)
    wanted = [Target(r[ka], r[kb], Fraction(str(r["target_share"] or 0)), int(r["min_pages"] or 0)) for r in rows]
    cells = list(dict.fromkeys((t.first, t.second) for t in wanted if t.first is not None and t.second is not None))
    counts = {r["_cell"]: r["count"] for r in _placed(pages.select(a, b), labels, cells).groupBy("_cell").count().collect()}
    of = {c: counts.get(i, 0) for i, c in enumerate(cells)}
    found = cell_quotas(wanted, [of.get((t.first, t.second), 0) for t in wanted], Fraction(str(share)) * sum(counts.values()), seed)
    return spark.createDataFrame([(*r, *f.values()) for r, f in zip(rows, found, strict=True)], T.StructType([*targets.schema.fields, *REPORT]))


def _placed(pages: DataFrame, labels: tuple[str, str], cells: list[tuple]) -> DataFrame:
    """Pages with both labels and the number of their target cell, null for none."""
    (a, b), spark = labels, pages.sparkSession
    numbered = spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(cells)], f"`{a}` string, `{b}` string, _cell int")
    return pages.where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(F.broadcast(numbered), [a, b], "left")


def sample_to_targets(pages: DataFrame, report: DataFrame, key: str, labels: tuple[str, str], target_keys: tuple[str, str], seed: int = 17) -> DataFrame:
    """``key`` and labels of the pages drawn at random within the quotas of ``report`` (from ``plan_sample``).

    ``key`` is unique. Pages of no target cell are never drawn. The draw ranks each cell by a seeded hash over a range
    sort, so a cell of any size is spread over many tasks.
    """
    spark, (a, b), (ka, kb) = pages.sparkSession, labels, target_keys
    quota = {(r[ka], r[kb]): r["quota"] for r in fixed_rows(report, "targets", MAX_CELLS) if r[ka] is not None and r[kb] is not None}
    cells = list(quota)
    quotas = spark.createDataFrame([(i, quota[c]) for i, c in enumerate(cells)], "_cell int, _quota long")
    drawable = _placed(pages.select(key, a, b), labels, cells).where(F.col("_cell").isNotNull()).withColumn("_u", F.xxhash64(F.lit(seed), F.col(key)))
    ranked = ordered_positions(drawable, "_cell", [F.col("_u").asc(), F.col(key).asc()])
    return ranked.join(F.broadcast(quotas), "_cell").where(F.col("group_pos") < F.col("_quota")).select(key, a, b)


def margin_report(report: DataFrame, first: str, second: str) -> DataFrame:
    """``margin, label, wanted, quota, lacking`` of each label: what its cells want, got, and lack of pages of their own."""
    cells = report.groupBy(first, second).agg(F.first("wanted").alias("wanted"), F.first("quota").alias("quota"), F.sum("slack").alias("lacking"))
    one = lambda name: cells.groupBy(F.lit(name).alias("margin"), F.col(name).alias("label")).agg(F.round(F.sum("wanted"), 6).alias("wanted"), F.sum("quota").alias("quota"), F.sum("lacking").alias("lacking"))
    return one(first).unionByName(one(second))
