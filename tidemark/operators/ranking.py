"""Stable ranking, fair interleaving, budgets and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.storage import stash


def ranked(rows: DataFrame, order: list[Column], ordinal: str, limit: int | None = None) -> DataFrame:
    """Rows in order, ties in input order; with ``limit`` only the top rows (no full sort)."""
    out = rows.orderBy(*order, F.col(ordinal).asc())
    return out.limit(limit) if limit is not None else out


def numbered(rows: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the place, from 1, of each row among those of its key, in an order without ties.

    As ``row_number``, but a key may hold any share of the rows: they are cut into ranges of (key, order),
    numbered inside each range, and the counts of the ranges before are added. Null is a key like any other.
    """
    cut = stash(rows.repartitionByRange(F.col(key), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("__range", key).orderBy(*order))
    counts = cut.groupBy(F.col("__range").alias("__r"), F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__key").orderBy("__r")) - F.col("__n")).drop("__n")  # one row per key and range
    placed = cut.withColumn("__inside", inside).join(before, (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__key")))
    return placed.withColumn(out, F.col("__inside") + F.col("__before")).drop("__range", "__r", "__key", "__inside", "__before")


def round_robin(rows: DataFrame, track: str, order: list[Column], ordinal: str) -> DataFrame:
    """Add ``turn`` (place within its track) and ``track_rank`` (tracks by first appearance); order by both to interleave."""
    first = rows.groupBy(track).agg(F.min(ordinal).alias("__f"))
    ranks = first.select(F.col(track).alias("__t"), F.row_number().over(Window.orderBy("__f")).alias("track_rank"))  # one row per track
    return numbered(rows, track, [*order, F.col(ordinal).asc()], "turn").join(ranks, F.col(track).eqNullSafe(F.col("__t"))).drop("__t")


def aging_priority(rank: Column, waited_seconds: Column, hours: int) -> Column:
    """Rank that falls by one for every ``hours`` waited, not below zero."""
    return F.greatest(F.lit(0), rank - (waited_seconds / (3600 * hours)).cast("int"))


def failure_runs(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Add ``run``: failures in a row up to and including this one, 0 where it didn't fail."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    staged = rows.withColumn("__fail", F.when(failed, 1).otherwise(0)).withColumn("__island", island)
    inside = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return staged.withColumn("run", F.sum("__fail").over(inside)).drop("__fail", "__island")


def within_budget(rows: DataFrame, partition: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows while the cost of those before stays below the budget."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("spent_before") < budget)


def rotated(place: Column, offset: Column, size: Column) -> Column:
    """Place after the list was shifted by ``offset``."""
    return F.pmod(place - offset, size)


def fair_shares(budget: int, queries: int) -> list[int]:
    """What each of the remaining queries may spend: at least 1, else an even part of what is left."""
    left, out = budget, []
    for i in range(queries):
        share = max(1, left // (queries - i))
        out.append(share)
        left = max(0, left - share)
    return out


def first_pages(rows: DataFrame, partition: list[str], page: str) -> DataFrame:
    """Rows on the first page of their partition key that shows them."""
    w = Window.partitionBy(*partition)
    return rows.withColumn("__p", F.min(page).over(w)).where(F.col("__p") == F.col(page)).drop("__p")


def batches(place: Column, size: int) -> Column:
    """Batch number, from 0, of a row by its place from 1."""
    return F.floor((place - 1) / size).cast("bigint")
