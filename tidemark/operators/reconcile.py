"""Snapshots of two writers reconciled against their common base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

Conflict = Callable[[Column, Column], Column]


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str, conflict: Conflict) -> DataFrame:
    """``(key, value)`` after a three-way merge; a missing row is a value of its own.

    Unchanged locally: remote wins. Unchanged remotely, or changed alike: local wins. Deleted on
    either side against a change: deleted. Else ``conflict(local, remote)``. One shuffle: the
    three snapshots are tagged, united and reduced by key.
    """
    tagged = [d.select(F.col(key), F.lit(name).alias("__side"), F.struct(F.col(value)).alias("__v")) for name, d in (("b", base), ("l", local), ("r", remote))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    one = lambda s: F.max(F.when(F.col("__side") == s, F.col("__v"))).alias(s)
    m = rows.groupBy(key).agg(one("b"), one("l"), one("r"))
    b, lo, r = F.col("b"), F.col("l"), F.col("r")
    merged = (
        F.when(lo.eqNullSafe(b), r)
        .when(r.eqNullSafe(b) | lo.eqNullSafe(r), lo)
        .when(lo.isNull() | r.isNull(), F.lit(None))
        .otherwise(F.struct(conflict(lo[value], r[value]).alias(value)))
    )
    return m.withColumn("__m", merged).where(F.col("__m").isNotNull()).select(key, F.col(f"__m.{value}").alias(value))


def merge_acks(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, at: str) -> DataFrame:
    """Acknowledgements: the later of both; one holder's counts only if it isn't the unchanged base (else the other pruned it)."""
    rows = base.select(key, F.lit("b").alias("s"), at).unionByName(local.select(key, F.lit("l").alias("s"), at)).unionByName(remote.select(key, F.lit("r").alias("s"), at))
    side = lambda s: F.max(F.when(F.col("s") == s, F.col(at))).alias(s)
    m = rows.groupBy(key).agg(side("b"), side("l"), side("r"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    only = F.coalesce("l", "r")
    kept = F.when(both, F.greatest("l", "r")).when(only.isNotNull() & ~only.eqNullSafe(F.col("b")), only)
    return m.select(key, kept.alias(at)).where(F.col(at).isNotNull())


def merge_pending(conflicts: DataFrame, key: str, order: list[Column], most: list[str], least: list[str], payload: list[str]) -> DataFrame:
    """One row per key of rows that both writers hold: payload of the newest by ``order``, maxima and minima of the counters."""
    newest = F.max_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__p")
    m = conflicts.groupBy(key).agg(newest, *[F.max(c).alias(c) for c in most], *[F.min(c).alias(c) for c in least])
    return m.select(key, "__p.*", *most, *least)


def newest(rows: DataFrame, key: str, stamps: list[str], tie: Column) -> DataFrame:
    """Per key the row whose latest stamp is latest."""
    latest = F.greatest(*[F.coalesce(F.col(s), F.lit("1970-01-01").cast("timestamp")) for s in stamps])
    w = Window.partitionBy(key).orderBy(latest.desc(), tie)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def bounded(rows: DataFrame, partition: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each partition; Spark prunes each task's rows before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def grow_only(snapshots: list[DataFrame], key: str, at: str, horizon_days: int) -> DataFrame:
    """Union of append-only ledgers, the latest stamp per key, within ``horizon_days`` of the newest."""
    united = snapshots[0]
    for s in snapshots[1:]:
        united = united.unionByName(s)
    merged = united.groupBy(key).agg(F.max(at).alias(at))
    newest_at = merged.agg(F.max(at)).scalar()
    return merged.where(F.col(at) >= newest_at - F.expr(f"interval {horizon_days} days"))
