"""Watermarks, cadence gates, time-to-live, quotas, controllers and retries over keyed state tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def due(last: Column, now: Column, seconds: Column | int) -> Column:
    """Whether an interval has passed since ``last``; never done, or done in the future, counts as due."""
    age = F.unix_micros(now) - F.unix_micros(last)
    limit = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("bigint") * 1_000_000
    return ~F.coalesce((age >= 0) & (age < limit), F.lit(False))


def attempt_due(last_attempt: Column, last_success: Column, now: Column, seconds: int) -> Column:
    """As ``due``, by the last attempt, else the last success."""
    return due(F.coalesce(last_attempt, last_success), now, seconds)


def advanced(outcomes: DataFrame, key: str, ok: Column, at: str, previous: DataFrame | None = None) -> DataFrame:
    """Watermark per key: moves to the latest time only if every outcome is good, else stays."""
    moved = outcomes.groupBy(key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("complete"), F.max(at).alias("latest"))
    if previous is None:
        return moved.where("complete").select(key, F.col("latest").alias("last_success"))
    p = previous.select(key, F.col("last_success").alias("__old"))
    joined = p.join(moved, key, "full_outer")
    return joined.select(key, F.when(F.col("complete"), F.col("latest")).otherwise(F.col("__old")).alias("last_success")).where("last_success is not null")


def cadence(base_hours: int, idle_hours: int, yielded: Column) -> Column:
    """Hours between runs: the longer of both where the last run yielded nothing."""
    return F.when(F.coalesce(yielded, F.lit(0)) == 0, F.greatest(F.lit(base_hours), F.lit(idle_hours))).otherwise(F.lit(base_hours))


def look_back(last: Column, now: Column, base_hours: int, most_hours: int = 720, margin: int = 24) -> Column:
    """Hours to look back: the gap and a margin, between base and most; base where nothing is known."""
    elapsed = (F.unix_timestamp(now) - F.unix_timestamp(last)) / 3600
    return F.least(F.lit(most_hours), F.greatest(F.lit(base_hours), F.coalesce((elapsed + margin).cast("int"), F.lit(base_hours))))


def fresh(fetched_at: Column, now: Column, ttl_seconds: int) -> Column:
    """Whether a cached row may be used: 0 <= age < ttl; a ttl of 0 admits nothing."""
    age = F.unix_micros(now) - F.unix_micros(fetched_at)
    return F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False))


def cached(rows: DataFrame, cache: DataFrame, url: str, now: Column, ttl_seconds: int, payload: list[str]) -> DataFrame:
    """Rows with the payload of a fresh cache entry, or null."""
    usable = cache.where(fresh(F.col("fetched_at"), now, ttl_seconds)).select(F.col(url), *payload)
    return rows.join(usable, url, "left")


def admitted(requests: DataFrame, key: str, at: str, most: int, days: int, spacing_seconds: int) -> DataFrame:
    """Add ``admitted`` and ``denial`` by a rolling quota: at most ``most`` in ``days``, ``spacing_seconds`` apart.

    A request depends on those admitted before it, so each key is a sequential fold. Requests
    stream through sorted by key and time; the state is the admissions of the last ``days``, at
    most ``most`` of them, so a key of any size needs no more memory than that.
    """
    columns = requests.columns
    schema = requests.schema.add("admitted", "boolean").add("denial", "string")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), []
        for part in parts:
            yes, why = [], []
            for k, t in zip(part[key], part[at]):
                if k != current:
                    current, held = k, []
                held = [h for h in held if (t - h).total_seconds() < days * 86400]
                denial = "rolling_exhausted" if len(held) >= most else "minimum_interval" if held and (t - held[-1]).total_seconds() < spacing_seconds else None
                if denial is None:
                    held.append(t)
                yes.append(denial is None)
                why.append(denial)
            yield part.assign(admitted=yes, denial=why)

    ordered = requests.where(F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at, *[c for c in columns if c not in (key, at)])
    return ordered.mapInPandas(fold, schema)


def aimd(limit: Column, delay: Column, attempted: Column, succeeded: Column, trouble: Column, pending: Column, least: int, most: int, base_delay: float, most_delay: float) -> tuple[Column, Column]:
    """Next (limit, delay): halve and double on trouble; +4 and -0.5 s after full success, the limit only if it was used up and work is left."""
    good = ~trouble & (attempted > 0) & (succeeded == attempted)
    next_limit = F.when(trouble, F.greatest(F.lit(least), F.floor(limit / 2))).when(good & (attempted >= limit) & (pending > 0), F.least(F.lit(most), limit + 4)).otherwise(limit)
    next_delay = F.when(trouble, F.least(F.lit(most_delay), delay * 2)).when(good, F.greatest(F.lit(base_delay), delay - 0.5)).otherwise(delay)
    return next_limit.cast("int"), next_delay.cast("double")


def back_off(attempts: Column, base_seconds: int = 300, most_seconds: int = 86400, cap: int = 8) -> Column:
    """Seconds until the next try, after ``attempts`` have been counted."""
    return F.least(F.lit(most_seconds), F.lit(base_seconds) * F.pow(F.lit(2), F.least(attempts, F.lit(cap)))).cast("bigint")


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(rule, violations)``: rows for which a check isn't true, one pass for all checks."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in checks]))
    return counted.select(pairs.alias("x")).select("x.rule", "x.violations")


def next_status(status: Column, outcome: Column, attempts: Column, most: int) -> Column:
    """Where an item goes after an attempt: done, closed, exhausted or pending; final states stay."""
    return (
        F.when(status.isin("done", "closed", "exhausted"), status).when(outcome == "success", "done").when(outcome == "gone", "closed")
        .when(attempts >= most, "exhausted").otherwise("pending")
    )


def build_queue(queue: DataFrame, cards: DataFrame, key: str, now: Column, retention_hours: int, most_attempts: int, keep: int) -> DataFrame:
    """The next queue: expired and irrelevant entries out, exhausted ones marked, new cards in, the best ``keep`` by priority.

    ``queue`` has ``key, attempts, priority, queued_at``; ``cards`` has ``key, priority, relevant``.
    A card refreshes its entry's priority; one that isn't relevant removes it.
    """
    held = queue.where(F.unix_micros(now) - F.unix_micros("queued_at") < retention_hours * 3600 * 1_000_000)
    c = cards.select(key, F.col("priority").alias("__p"), F.col("relevant").alias("__r"))
    joined = held.join(c, key, "full_outer").where(F.coalesce("__r", F.lit(True)))
    merged = joined.select(
        key, F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("__p", "priority").alias("priority"), F.coalesce("queued_at", now).alias("queued_at"),
        F.when(F.coalesce("attempts", F.lit(0)) >= most_attempts, "exhausted").otherwise("pending").alias("status"),
    )
    return merged.orderBy("priority", "queued_at", key).limit(keep)


def admission(reservations: DataFrame, key: str, at: str, now: Column, most: int, days: int, spacing_hours: int, account: DataFrame | None = None, reserve: int = 0) -> DataFrame:
    """``(key, recent, denial)``: whether one more request of each key may be made now; null denial admits it.

    The first that applies: clock_ahead (a reservation lies in the future), rolling_exhausted,
    minimum_interval, credit_reserve, hourly_limit. ``account`` has ``key, remaining, hour_used, hour_limit``;
    a key without a row there isn't limited by it.
    """
    t, limit = F.unix_micros(at), F.unix_micros(now)
    held = reservations.groupBy(key).agg(F.max(t).alias("__last"), F.count_if((t > limit - days * 86_400_000_000) & (t <= limit)).alias("recent"))
    if account is not None:
        held = held.join(account.select(F.col(key).alias("__k"), "remaining", "hour_used", "hour_limit"), F.col(key) == F.col("__k"), "left")
    denial = (
        F.when(F.col("__last") > limit, "clock_ahead").when(F.col("recent") >= most, "rolling_exhausted")
        .when(limit - F.col("__last") < spacing_hours * 3_600_000_000, "minimum_interval")
    )
    if account is not None:
        denial = denial.when(F.col("remaining") <= reserve, "credit_reserve").when(F.col("hour_used") >= F.col("hour_limit"), "hourly_limit")
    return held.select(key, "recent", denial.alias("denial"))
