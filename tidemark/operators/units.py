"""Quantities in different units and scales, converted to common units.

Conversions are edges of a graph: ``canonical = a * x + b``. The shortest composition from
every unit to the canonical one of its kind is computed once: on the driver for a unit table of a checked
size, beyond it by rounds of DataFrame joins with the same result. Every cycle is checked for
consistency, and rows are converted by an equi-join on the source unit.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.storage import stash

#: A unit table of more edges isn't collected: its compositions are found by joins.
MAX_EDGES = 100_000
TOLERANCE = 1e-9
SCHEMA = "kind string, unit string, target string, a double, b double"


@dataclass
class UnitGraph:
    """Affine conversions between named units; ``edges[u][v] = (a, b)`` reads v = a * u + b."""

    edges: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)

    def add(self, source: str, target: str, a: float, b: float = 0.0) -> None:
        """Add a conversion and its inverse; a factor of zero or a non-finite one is refused."""
        if not (math.isfinite(a) and math.isfinite(b)) or a == 0:
            raise ValueError(f"no usable conversion from {source} to {target}: {a}, {b}")
        self.edges.setdefault(source, {})[target] = (a, b)
        self.edges.setdefault(target, {}).setdefault(source, (1 / a, -b / a))

    def to(self, target: str, tolerance: float = TOLERANCE) -> dict[str, tuple[float, float]]:
        """Shortest compositions of every reachable unit to ``target``.

        Breadth-first, so the fewest edges win. Every edge that is not on such a path closes
        a cycle; if going round it changes a value by more than ``tolerance`` (relative), the
        table contradicts itself and ValueError is raised.
        """
        best = {target: (1.0, 0.0)}
        queue = deque([target])
        while queue:
            unit = queue.popleft()
            a, b = best[unit]
            for other, (c, d) in self.edges.get(unit, {}).items():
                if other not in best:
                    inverse = (1 / c, -d / c)
                    best[other] = (a * inverse[0], a * inverse[1] + b)
                    queue.append(other)
        for unit, (a, b) in best.items():
            for other, (c, d) in self.edges.get(unit, {}).items():
                e, f = best[other]
                for x in (0.0, 1.0, 100.0):
                    direct, around = a * x + b, e * (c * x + d) + f
                    if abs(direct - around) > tolerance * max(1.0, abs(direct)):
                        raise ValueError(f"inconsistent cycle through {unit} and {other}: {direct} and {around}")
        return best


def conversions(spark: SparkSession, units: DataFrame, targets: dict[str, str], extra: list[tuple[str, str, str, float, float]] = ()) -> DataFrame:
    """The closure as a table ``kind, unit, target, a, b``.

    ``units`` has ``kind, code, factor``: one unit of ``code`` is ``factor`` of the kind's
    target. ``extra`` adds edges (kind, source, target, a, b). Rows with a null field are left
    out; an empty table gives the identity of each target.
    """
    known = units.select("kind", "code", "factor").dropna()
    rows = known.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        return _joined(spark, known, targets, extra)
    out = []
    for kind, target in targets.items():
        graph = UnitGraph()
        for row in rows:
            if row.kind == kind and row.code != target:
                graph.add(row.code, target, row.factor)
        for k, source, to, a, b in extra:
            if k == kind:
                graph.add(source, to, a, b)
        out += [(kind, unit, target, a, b) for unit, (a, b) in sorted(graph.to(target).items())]
    return spark.createDataFrame(out, SCHEMA)


def _joined(spark: SparkSession, units: DataFrame, targets: dict[str, str], extra: list[tuple[str, str, str, float, float]]) -> DataFrame:
    """As ``conversions``, by joins: each round takes in the units one edge further from the targets."""
    c = F.col
    goal = spark.createDataFrame(list(targets.items()), "kind string, target string")
    star = units.join(goal, "kind").where(c("code") != c("target")).select("kind", c("code").alias("u"), c("target").alias("v"), c("factor").cast("double").alias("a"), F.lit(0.0).alias("b"))
    more = spark.createDataFrame([e for e in extra if e[0] in targets], "kind string, u string, v string, a double, b double")
    one = star.unionByName(more)
    if one.where((c("a") == 0) | F.isnan("a") | F.isnan("b") | (F.abs("a") == float("inf")) | (F.abs("b") == float("inf"))).limit(1).count():
        raise ValueError("a conversion with a factor of zero or one that is not finite")
    back = one.select("kind", c("v").alias("u"), c("u").alias("v"), (1 / c("a")).alias("a"), (-c("b") / c("a")).alias("b"))
    edges = stash(one.unionByName(back), "unit-edges")
    found = stash(goal.select("kind", c("target").alias("unit"), "target", F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), "units")
    frontier = found
    while True:
        near = frontier.alias("f").join(edges.alias("e"), (c("f.kind") == c("e.kind")) & (c("f.unit") == c("e.v")))
        step = near.select("f.kind", c("e.u").alias("unit"), "f.target", (c("f.a") * c("e.a")).alias("a"), (c("f.a") * c("e.b") + c("f.b")).alias("b"))
        fresh = step.join(found.select("kind", "unit"), ["kind", "unit"], "left_anti").groupBy("kind", "unit", "target").agg(F.min(F.struct("a", "b")).alias("x"))
        frontier = stash(fresh.select("kind", "unit", "target", "x.a", "x.b"), "units")
        if not frontier.limit(1).count():
            break
        found = stash(found.unionByName(frontier), "units")
    both = edges.alias("e").join(found.alias("u"), (c("e.kind") == c("u.kind")) & (c("e.u") == c("u.unit"))).join(found.alias("v"), (c("e.kind") == c("v.kind")) & (c("e.v") == c("v.unit")))
    apart = F.lit(False)
    for x in (0.0, 1.0, 100.0):
        direct, around = c("u.a") * x + c("u.b"), c("v.a") * (c("e.a") * x + c("e.b")) + c("v.b")
        apart |= F.abs(direct - around) > TOLERANCE * F.greatest(F.lit(1.0), F.abs(direct))
    wrong = both.where(apart).select("e.u", "e.v").first()
    if wrong:
        raise ValueError(f"inconsistent cycle through {wrong[0]} and {wrong[1]}")
    return found
