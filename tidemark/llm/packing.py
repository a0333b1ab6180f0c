"""Documents packed into containers of fixed capacity: hierarchical multi-length packing.

Sizes are whole numbers up to the capacity, so the plan is made from their histogram, which has
at most ``capacity`` rows at any scale.

* Routing: a size belongs to the smallest tier (capacity, a half, a quarter, an eighth) that holds it.
* Packing: tiers are packed from the longest to the shortest. A container of a tier is made of as many
  windows as the tier goes into the capacity; each window is opened with the largest size left in
  the tier, and its gap is filled with the largest sizes that still fit, from shorter tiers.
* Gaps: what the windows of a container leave over is contiguous, and is filled once more, from the
  same tier or shorter ones.
* A filled container is a pattern, repeated as often as the counts allow, so every pattern uses up at
  least one size.
* Balance: containers are numbered by load, heaviest first, and dealt to step groups to and fro, so
  groups get the same number of containers and nearly the same tokens.

Documents then find their slot by their rank within their size; ranks are computed in salted buckets
whose number grows with the rows, so one size may hold any share of them.

Only a document above the capacity is split: into full containers and one remainder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.tokens import VOCABULARY, token_counts
from tidemark.storage import stash

CAPACITY = 2048
#: Containers of one training step.
STEP = 64
#: Buckets of one size, and rows from which there are more.
SALTS = 64
ROWS_PER_SALT = 1 << 22


def tier_of(size: int, capacity: int = CAPACITY) -> int:
    """The smallest of capacity, capacity/2, capacity/4 and capacity/8 that holds ``size``."""
    tier = capacity
    for _ in range(3):
        if size * 2 <= tier:
            tier //= 2
    return tier


class _Left:
    """Sizes that are left, with the largest one up to any bound."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.count = np.zeros(capacity + 1, np.int64)
        for size, count in histogram.items():
            self.count[size] = count
        self.below = np.maximum.accumulate(np.where(self.count > 0, np.arange(capacity + 1), 0))

    def largest(self, bound: int, taken: dict[int, int]) -> int:
        """The largest size up to ``bound`` that is left beside what a pattern has taken; 0 if there is none."""
        size = int(self.below[bound]) if bound > 0 else 0
        while size and self.count[size] <= taken.get(size, 0):
            size = int(self.below[size - 1])
        return size

    def use(self, size: int, count: int) -> None:
        self.count[size] -= count
        if not self.count[size]:
            i, smaller = size, self.below[size - 1]
            while i < len(self.below) and self.below[i] == size:
                self.below[i] = smaller
                i += 1


def _pattern(left: _Left, tier: int, capacity: int) -> list[tuple[int, int, int]]:
    """One container of a tier: (size, copies, offset)."""
    taken: dict[int, int] = {}
    out: list[tuple[int, int, int]] = []
    used = 0

    def put(size: int, copies: int) -> None:
        nonlocal used
        out.append((size, copies, used))
        taken[size] = taken.get(size, 0) + copies
        used += size * copies

    def fill(gap: int) -> None:
        while size := left.largest(gap, taken):
            copies = min(gap // size, int(left.count[size]) - taken.get(size, 0))
            put(size, copies)
            gap -= size * copies

    for _ in range(capacity // tier):
        opening = left.largest(tier, taken)
        if not opening or tier_of(opening, capacity) != tier:
            break
        put(opening, 1)
        fill(tier - opening)
    fill(capacity - used)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots and number of containers for a histogram of sizes.

    A slot is (size, first rank, copies per container, first container, containers, offset):
    documents of ``size`` with ranks from ``first rank`` on fill ``copies`` places from
    ``offset`` on in each of the containers. The slot at offset 0 opened the container, so its tier
    is the container's. Containers are numbered by load, heaviest first. Sizes outside 1..capacity
    are refused.
    """
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("a size must be between 1 and the capacity")
    left = _Left(histogram, capacity)
    patterns: list[tuple[int, list[tuple[int, int, int]]]] = []
    for tier in sorted({tier_of(s, capacity) for s in histogram}, reverse=True):
        while tier_of(left.largest(tier, {}), capacity) == tier and left.largest(tier, {}):
            places = _pattern(left, tier, capacity)
            taken: dict[int, int] = {}
            for size, copies, _ in places:
                taken[size] = taken.get(size, 0) + copies
            times = min(int(left.count[s]) // n for s, n in taken.items())
            for size, n in taken.items():
                left.use(size, n * times)
            patterns.append((times, places))
    patterns.sort(key=lambda p: -sum(size * copies for size, copies, _ in p[1]))
    used = np.zeros(capacity + 1, np.int64)
    slots, containers = [], 0
    for times, places in patterns:
        for size, copies, offset in places:
            slots.append((size, int(used[size]), copies, containers, times, offset))
            used[size] += copies * times
        containers += times
    return slots, containers


def dealt(container: np.ndarray, groups: int) -> np.ndarray:
    """The step group of each container: to and fro over the groups."""
    at = container % (2 * groups)
    return np.where(at < groups, at, 2 * groups - 1 - at)


def pieces(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, size)``: a document is one piece unless it exceeds the capacity."""
    sizes = token_counts(documents.where(F.col("text") != ""), vocabulary).where("tokens > 0")
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)).alias("piece")
    return sizes.select("doc_id", "tokens", number).select(
        "doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("size")
    )


def packed(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, tokens, tier, window, container, offset, step_group)``.

    ``tier`` is the document's own, ``window`` that of the container. Null and empty texts are left
    out; an empty table gives an empty result. Repeated doc_ids are packed once per row.
    """
    table = stash(pieces(documents, vocabulary, capacity), "pieces")
    histogram = {r["size"]: r["count"] for r in table.groupBy("size").count().collect()}  # at most ``capacity`` rows
    slots, containers = plan(histogram, capacity)
    window = {s[3]: tier_of(s[0], capacity) for s in slots if s[5] == 0}
    arrays = np.array([(*s, window[s[3]]) for s in sorted(slots, key=lambda s: (s[0], s[1]))], np.int64).reshape(-1, 7)
    groups = max(1, -(-containers // STEP))
    shared = table.sparkSession.sparkContext.broadcast(arrays)  # bounded by the capacity, not by the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        key = slot[:, 0] << 40 | slot[:, 1]
        tiers = np.array([tier_of(s, capacity) for s in range(capacity + 1)])
        for batch in batches:
            size = batch.column("size").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, size << 40 | rank, "right") - 1
            inside = rank - slot[at, 1]
            container = slot[at, 3] + inside // slot[at, 2]
            offset = slot[at, 5] + inside % slot[at, 2] * size
            numbers = (size, tiers[size], slot[at, 6], container, offset, dealt(container, groups))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), *map(pa.array, numbers)], names=_PACKED)

    salts = max(SALTS, sum(histogram.values()) // ROWS_PER_SALT)
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")
    begin = counts.select("size", "salt", before.alias("begin"))  # one row per bucket
    inside = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("inside", inside).join(begin, ["size", "salt"]).withColumn("rank", (F.col("begin") + F.col("inside")).cast("long"))
    return ranked.select("doc_id", "piece", "size", "rank").mapInArrow(place, "doc_id long, piece int, " + ", ".join(f"{n} long" for n in _PACKED[2:]))


_PACKED = ["doc_id", "piece", "tokens", "tier", "window", "container", "offset", "step_group"]


def packing_report(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row for all (tier 0) and one per tier of containers.

    ``containers, pieces, tokens``, the least number of containers possible, the share filled, and
    over the step groups of full length the largest relative deviation of a group's tokens from their mean.
    """
    each = packed(documents, vocabulary, capacity).groupBy("container", "window", "step_group").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"))
    each = stash(each, "containers")
    levels = each.select(F.explode(F.array(F.lit(0).cast("long"), F.col("window"))).alias("tier"), "t", "p")
    zero = F.lit(0).cast("long")
    total = each.agg(zero.alias("tier"), F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("p"), zero).alias("pieces"), F.coalesce(F.sum("t"), zero).alias("tokens"))
    by_tier = levels.where("tier > 0").groupBy("tier").agg(F.count(F.lit(1)).alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"))
    group = each.groupBy("step_group").agg(F.sum("t").alias("g"), F.count(F.lit(1)).alias("n"))
    full = group.where(F.col("n") == group.agg(F.max("n")).scalar())
    mean = F.avg("g")
    off = full.agg(F.round(F.greatest(F.max("g") - mean, mean - F.min("g")) / mean, 4).alias("largest_deviation"))
    rows = total.withColumn("largest_deviation", off.scalar()).unionByName(by_tier, allowMissingColumns=True)
    least = F.ceil(F.col("tokens") / capacity)
    filled = F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 4)
    return rows.select("tier", "containers", "pieces", "tokens", least.alias("least_containers"), filled.alias("filled"), "largest_deviation").orderBy("tier")
