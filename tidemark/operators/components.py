"""Connected components of (member, key) incidence by hooking and pointer jumping.

No group is ever gathered in one place: a key is reduced to the smallest label it has seen
(partial aggregation), and hot keys are salted, so a key that a third of all rows carry
costs a few rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.storage import remove, stash

SALTS = 32


def hook(incidence: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` with u > v that connect the members of each key.

    ``incidence`` has ``member`` (long) and ``key`` (long). Members are hooked to the smallest
    member of their (key, salt) bucket and the buckets to the smallest of the key, so the
    edges are as many as the incidences and no join sees a hot key.
    """
    salted = incidence.where(F.col("key").isNotNull()).select("key", "member", F.pmod(F.xxhash64("member"), F.lit(SALTS)).alias("salt"))
    local = salted.groupBy("key", "salt").agg(F.min("member").alias("low"), F.count(F.lit(1)).alias("n"))
    per_key = local.groupBy("key").agg(F.min("low").alias("root"), F.collect_list("low").alias("lows"), F.sum("n").alias("n"))
    shared = per_key.where("n > 1")
    up = shared.select(F.explode("lows").alias("u"), F.col("root").alias("v"))
    # only buckets of two or more members need the second kind of edge
    crowded = local.where("n > 1").select("key", "salt", "low")
    down = salted.join(crowded, ["key", "salt"]).select(F.col("member").alias("u"), F.col("low").alias("v"))
    return up.unionByName(down).where("u > v").distinct()


def components(edges: DataFrame, name: str = "components", max_rounds: int = 50) -> DataFrame:
    """``(member, root)`` for every node that has an edge; root is the smallest node of its component.

    Alternates two steps on the edges u -> v (v < u) until nothing changes: each node points
    to the smallest node it is linked to (its other links move to that node), then pointers
    are jumped. Every round writes its table to shared storage, so a lost executor costs one
    round at most. Edges only ever shrink in number; rounds are logarithmic in the longest
    chain.
    """
    kept: list[str] = []
    spark = edges.sparkSession
    current = stash(edges, name, kept)
    for _ in range(max_rounds):
        parent = current.groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("n"))
        busy = parent.where("n > 1")
        # links of u other than to its parent are handed to the parent: (v, p) with v > p
        moved = current.join(busy.select("u", "p"), "u").where("v > p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        tree = parent.select("u", F.col("p").alias("v"))
        # jump: u -> p becomes u -> p's parent where p has one
        jumped = (
            tree.alias("a").join(tree.alias("b"), F.col("a.v") == F.col("b.u"), "left")
            .select(F.col("a.u").alias("u"), F.coalesce(F.col("b.v"), F.col("a.v")).alias("v"), F.col("b.u").isNotNull().alias("changed"))
        )
        # a node whose parent moved must still reach that parent
        linked = jumped.select("u", "v", "changed").unionByName(moved.select("u", "v", F.lit(True).alias("changed")))
        after = linked.groupBy("u", "v").agg(F.max("changed").alias("changed"))
        step = stash(after, name, kept)
        more = step.where("changed").limit(1).count() > 0
        remove(spark, kept.pop(0))
        current = step.select("u", "v")
        if not more:
            return current.select(F.col("u").alias("member"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
