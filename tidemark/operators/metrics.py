"""Yield, coverage, health and evaluation of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Outcomes that count as good.
GOOD = ("success", "valid_empty")


def code_histogram(rows: DataFrame, *arrays: str) -> DataFrame:
    """``(code, n)`` over the codes of all given arrays, repeated ones included."""
    return rows.select(F.explode(F.concat(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def query_yield(outcomes: DataFrame, jobs: DataFrame, query: str = "query_id") -> DataFrame:
    """Per query: requests, raw rows, seconds, distinct jobs, and both rates; per minute is null at 0 s."""
    o = outcomes.groupBy(query).agg(F.count(F.lit(1)).alias("requests"), F.sum("raw").alias("raw"), F.round(F.sum("duration_seconds"), 3).alias("seconds"))
    j = jobs.groupBy(query).agg(F.count_distinct("job_id").alias("jobs"))
    joined = o.join(j, query, "left").withColumn("jobs", F.coalesce("jobs", F.lit(0).cast("bigint")))
    return joined.select(
        "*",
        F.round(F.when(F.col("requests") > 0, F.col("jobs") / F.col("requests")).otherwise(0.0), 4).alias("per_request"),
        F.round(F.when(F.col("seconds") > 0, F.col("jobs") * 60 / F.col("seconds")), 4).alias("per_minute"),
    )


def coverage(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, good, partial and failed outcomes and converted rows per source and phase."""
    status = F.col("status")
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(status.isin(*GOOD)).alias("good"), F.count_if(status == "partial").alias("partial"),
        F.count_if(~status.isin(*GOOD, "partial", "skipped")).alias("failed"), F.sum("converted").alias("converted"), F.count_distinct("query_id").alias("queries"),
    )


def source_status(outcomes: DataFrame, key: str) -> DataFrame:
    """skipped, unverified, success, valid_empty, partial or failed for each source."""
    s = F.col("status")
    tried = s != "skipped"
    a = outcomes.groupBy(key).agg(
        F.count_if(tried).alias("tried"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s.isin(*GOOD)).alias("good"),
        F.sum(F.when(s.isin(*GOOD), F.col("converted")).otherwise(0)).alias("from_good"), F.sum(F.when(tried, F.col("converted")).otherwise(0)).alias("converted"),
    )
    verdict = (
        F.when((F.col("tried") == 0) & (F.col("skipped") > 0), "skipped").when(F.col("tried") == 0, "unverified")
        .when((F.col("good") == F.col("tried")) & (F.col("from_good") > 0), "success").when(F.col("good") == F.col("tried"), "valid_empty")
        .when((F.col("good") > 0) | (F.col("converted") > 0), "partial").otherwise("failed")
    )
    return a.select(key, verdict.alias("source_status"))


def health(sources: DataFrame, run: str) -> DataFrame:
    """degraded, healthy or idle for each run, from its sources' states."""
    bad = F.bool_or(F.col("source_status").isin("failed", "partial"))
    good = F.bool_or(F.col("source_status").isin(*GOOD))
    return sources.groupBy(run).agg(F.when(bad, "degraded").when(good, "healthy").otherwise("idle").alias("health"))


def problems(outcomes: DataFrame) -> DataFrame:
    """``(site, status, reason, n)`` of everything that isn't good, reasons in one spelling."""
    return (
        outcomes.where(~F.col("status").isin(*GOOD))
        .groupBy("site", "status", F.coalesce(F.lower(F.trim("reason")), F.lit("")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion(rows: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """``(expected, actual, n)``."""
    return rows.groupBy(expected.alias("expected"), actual.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, expected: Column, actual: Column, positive: str) -> DataFrame:
    """One row: cases, agreement, precision and recall of ``positive``; ratios of nothing are null."""
    tp = F.count_if((expected == positive) & (actual == positive))
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.try_divide(F.count_if(expected == actual), F.count(F.lit(1))), 4).alias("agreement"),
        F.round(F.try_divide(tp, F.count_if(actual == positive)), 4).alias("precision"), F.round(F.try_divide(tp, F.count_if(expected == positive)), 4).alias("recall"),
    )


def assessment(outcomes: DataFrame, run: str, ignored: dict[str, list[str]]) -> DataFrame:
    """``(run, state, reasons)``: failed if nothing worked, degraded if a counted source didn't, else ok.

    ``ignored`` maps a column to values whose failures don't count (a site, a phase).
    """
    counted = F.lit(True)
    for column, values in ignored.items():
        counted = counted & ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    good, bad = F.col("status").isin(*GOOD), ~F.col("status").isin(*GOOD, "skipped")
    a = outcomes.groupBy(run).agg(F.bool_or(good).alias("g"), F.sort_array(F.collect_set(F.when(bad & counted, F.concat_ws(":", "site", "status")))).alias("reasons"))
    return a.select(run, F.when(~F.col("g"), "failed").when(F.size("reasons") > 0, "degraded").otherwise("ok").alias("state"), "reasons")


def precision_at(rows: DataFrame, order: list[Column], k: int, relevant: Column) -> DataFrame:
    """One row: how many of the first ``k`` rows there are, and the share of relevant ones; null for none."""
    top = rows.orderBy(*order).limit(k)
    return top.agg(F.count(F.lit(1)).alias("shown"), F.round(F.try_divide(F.count_if(relevant), F.count(F.lit(1))), 4).alias("precision"))


def delivery_counts(outcomes: DataFrame, run: str, key: str) -> DataFrame:
    """Per run: distinct keys delivered, and failed without a delivery in the run, permanent failures among them."""
    best = outcomes.groupBy(run, key).agg(F.bool_or(F.col("status") == "delivered").alias("done"), F.bool_or(F.col("status") == "permanent_failure").alias("lost"))
    done = F.coalesce("done", F.lit(False))
    return best.groupBy(run).agg(F.count_if(done).alias("delivered"), F.count_if(~done).alias("failed"), F.count_if(~done & F.coalesce("lost", F.lit(False))).alias("permanent"))


def queue_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: entries before, added, left, removed, and pending and exhausted ones after."""
    b, a = before.select(F.col(key).alias("__b")).distinct(), after.select(F.col(key).alias("__a"), "status")
    j = b.join(a, F.col("__b") == F.col("__a"), "full_outer")
    return j.agg(
        F.count("__b").alias("initial"), F.count_if(F.col("__b").isNull()).alias("enqueued"), F.count_if(F.col("__a").isNull()).alias("removed"),
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "exhausted").alias("exhausted"),
    )
