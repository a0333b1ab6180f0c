"""Live, replay and evaluation runs over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.functions import text
from tidemark.operators import identity, metrics, ranking, rules, state
from tidemark.sources import replay, sinks
from tidemark.storage import stash


@dataclass
class Run:
    """Tables of one run; ``postings`` are merged, ``new`` are eligible and unseen, ``due`` is what to deliver, in order of ``turn``."""

    postings: DataFrame
    decisions: DataFrame
    ranked: DataFrame
    counts: DataFrame
    histogram: DataFrame
    new: DataFrame
    pending: DataFrame
    retired: DataFrame
    due: DataFrame


def normalize_postings(raw: DataFrame) -> DataFrame:
    """Clean text fields, canonical URL, stable and legacy ids; rows without title or platform are dropped."""
    c = F.col
    clean = {n: text.clean_text(c(n)) for n in ("title", "company", "location", "platform", "description")}
    rows = raw.withColumns(clean | {"url": text.canonical_url(c("url"))}).where((c("title") != "") & (c("platform") != ""))
    legacy = text.legacy_id(c("title"), c("company"), c("url"), c("platform"))
    return rows.withColumns({
        "job_id": F.coalesce(F.when(text.clean_text(c("job_id")) != "", c("job_id")), text.stable_id(c("platform"), c("source_id"), c("url"))),
        "aliases": F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(legacy))),
        "description_status": F.when(c("description") == "", "missing").otherwise(F.coalesce("description_status", F.lit("full"))),
    })


def fan_in(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes): the rows of all sources in order, and ``(source, status, reason, rows)``.

    Each source is read to its end by itself; one that fails gives an outcome row and no posting.
    ``ordinal`` numbers the rows, sources in the order given.
    """
    rows, outcomes = spark.createDataFrame([], T.StructType([*replay.POSTING.fields, T.StructField(ordinal, T.LongType())])), []
    types = {f.name: f.dataType for f in rows.schema}
    for number, (name, reader) in enumerate(readers.items()):
        try:
            part = reader().withColumn(ordinal, F.monotonically_increasing_id() + F.lit(number << 48))
            part = stash(part.withColumns({c: F.col(c).cast(types[c]) for c in part.columns if c in types}), "source")
            found = part.count()
            rows = rows.unionByName(part, allowMissingColumns=True)
            outcomes.append((name, "success" if found else "valid_empty", None, found))
        except Exception as error:  # noqa: BLE001  a source must not end the run
            outcomes.append((name, "failed", type(error).__name__, 0))
    return rows, spark.createDataFrame(outcomes, "source string, status string, reason string, rows long")


def merge(rows: DataFrame, ordinal: str) -> DataFrame:
    """Normalised postings with one id or destination as one, by the ordered fold; ``merged`` counts them."""
    c = F.col
    added = {n: F.lit(None).cast(t) for n, t in (("evidence_warnings", "array<string>"), ("work_mode", "string"), ("is_remote", "boolean"), ("source_id", "string"), ("source_urls", "array<string>"), ("application_url", "string")) if n not in rows.columns}
    rows = rows.withColumns(added)
    there = text.canonical_url(c("application_url"))
    last = F.lower(F.element_at(F.split(F.regexp_replace(there, "[?].*$", ""), "/"), -1))
    urls = F.array(F.concat(F.lit("url:"), c("url")), F.when(~last.isin(*text.GENERAL_PAGES), F.concat(F.lit("url:"), there)))
    keys = F.concat(F.array("job_id"), F.sort_array(F.array_distinct(F.array_compact(urls))))
    native = rows.withColumn("source_id", text.clean_text(c("source_id")))
    survivors = stash(identity.greedy_fold(native, ordinal, keys, ("platform", "source_id")), "survivors")
    return identity.merge_rows(rows, ordinal, survivors)


def run(
    raw: DataFrame, ordinal: str, checks: list[rules.Rule], scores: list[rules.Score], order: list[Column], seen: DataFrame | None = None, top: int = 20,
    pending: DataFrame | None = None, now: Column | None = None, pending_days: int = 7, eligible: tuple[str, ...] = ("qualified", "review"),
) -> Run:
    """Normalise, merge, decide, rank and count; take unseen candidates into ``pending``, look at it again, and pick what is due.

    ``seen`` has ``identity``; ``pending`` has the posting's columns and ``status, queued_at, attempts,
    next_retry_at``. Stored entries are refreshed by all candidates and decided again even where no
    source has rows; those seen, expired or rejected are retired. What is decided is written once.
    """
    spark = raw.sparkSession
    now = F.current_timestamp() if now is None else now
    rows = merge(normalize_postings(raw), ordinal)
    best_first = [rules.tier_rank(F.col("tier")).desc(), F.col("score").desc(), *order]
    placed = rules.decide(rows, checks, scores).orderBy(*best_first, F.col(ordinal).asc()).withColumn("place", F.monotonically_increasing_id())
    placed = stash(placed, "decisions")
    postings, decisions = placed.select(*rows.columns), placed.drop("place")
    counts = decisions.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    best = ranking.ranked(decisions.where("tier <> 'rejected'"), best_first, ordinal, top)
    seen = spark.createDataFrame([], "identity string") if seen is None else seen
    ids = F.concat(F.array("job_id"), F.col("aliases"))
    fresh = identity.unseen(placed.where(F.col("tier").isin(*eligible)), ids, "place", "place", seen, "identity")
    new = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("job_id").orderBy("place"))).where("__n = 1").drop("__n")

    queue = {"status": F.lit("pending"), "queued_at": now, "attempts": F.lit(0).cast("bigint"), "next_retry_at": F.lit(0).cast("timestamp")}
    payload = [c for c in rows.columns if c != "job_id"]
    if pending is None:
        pending = postings.limit(0).withColumns(queue)
    # each step is written, as the next looks into it several times
    refreshed = stash(identity.rekeyed(pending, placed, "job_id", "aliases", "place", payload).drop("held"), "refreshed")
    held = stash(identity.rekeyed(refreshed, new, "job_id", "aliases", "place", payload, queue).drop("held"), "pending")
    again = rules.decide(held.where((F.col("status") != sinks.PERMANENT) & (F.coalesce("next_retry_at", F.lit(0).cast("timestamp")) <= now)), checks, scores)
    known = again.select("job_id", F.explode(ids).alias("identity")).join(seen.select("identity").distinct(), "identity", "left_semi").select("job_id").distinct()
    expired = F.unix_micros(now) - F.unix_micros("queued_at") > pending_days * 86_400_000_000
    judged = again.join(known.withColumnRenamed("job_id", "__k"), F.col("job_id") == F.col("__k"), "left")
    out = F.coalesce(F.col("__k").isNotNull() | expired | (F.col("tier") == rules.TIERS[0]), F.lit(False))
    judged = stash(judged.withColumn("__out", out).drop("__k"), "judged")
    retired = judged.where("__out").select("job_id")
    left = held.join(retired, "job_id", "left_anti")
    due = ranking.ranked(judged.where(~F.col("__out") & F.col("tier").isin(*eligible)).drop("__out"), best_first, ordinal, top)
    due = due.withColumn("turn", F.row_number().over(Window.orderBy(*best_first, F.col(ordinal).asc())))  # at most ``top`` rows
    return Run(postings, decisions, best, counts, metrics.code_histogram(decisions, "reasons", "gaps"), new.drop("place"), left, retired, due)


def deliver(done: Run, seen: DataFrame | None, send: Callable[[list[dict]], tuple[int | None, bool]], now: Column, size: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, seen, outcomes) after what is due was sent, once, in batches of ``size``.

    What was delivered leaves pending and is seen under its id and aliases; what wasn't stays
    with its status, one more attempt and the time of the next.
    """
    due = stash(done.due, "due")
    outcomes = stash(sinks.deliver(due.coalesce(1), "job_id", "turn", send, size), "outcomes")
    o = outcomes.select(F.col("job_id").alias("__k"), F.col("status").alias("__status"))
    joined = done.pending.join(o, F.col("job_id") == F.col("__k"), "left").where(~F.col("__status").eqNullSafe(F.lit(sinks.DELIVERED)))
    attempts = F.col("attempts") + F.when(F.col("__k").isNotNull(), 1).otherwise(0)
    later = F.timestamp_micros(F.unix_micros(now) + state.back_off(attempts) * 1_000_000)
    failed = {"status": F.coalesce("__status", "status"), "attempts": attempts, "next_retry_at": F.when(F.col("__k").isNotNull(), later).otherwise(F.col("next_retry_at"))}
    pending = joined.withColumns(failed).drop("__k", "__status")
    there = due.join(outcomes.where(F.col("status") == sinks.DELIVERED).select("job_id"), "job_id", "left_semi")
    told = there.select(F.explode(F.concat(F.array("job_id"), F.col("aliases"))).alias("identity"), F.unix_timestamp(now).cast("double").alias("seen_at"))
    if seen is not None:
        told = seen.select("identity", F.col("seen_at").cast("double")).unionByName(told)
    return pending, told.groupBy("identity").agg(F.max("seen_at").alias("seen_at")), outcomes
