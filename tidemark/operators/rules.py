"""Declarative, ordered rules that give every row a tier, a score, reasons and gaps.

A rule is a condition and an effect; all rules of a table are compiled into one projection of
built-in expressions, so a table of any size is decided in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

REJECT, REVIEW, NOTE, GAP = "reject", "review", "note", "gap"
TIERS = ("rejected", "review", "qualified")


@dataclass(frozen=True)
class Rule:
    """``when`` true adds ``code`` to the reasons (reject, note) or gaps (review, gap).

    A reject makes the row rejected, a review lowers it to review and its confidence to limited.
    A review adds its code once, a gap always; null conditions count as false.
    """

    code: str
    effect: str
    when: Column


@dataclass(frozen=True)
class Score:
    """Points given where ``when`` holds."""

    points: Column
    when: Column


def decide(rows: DataFrame, rules: list[Rule], scores: list[Score] = ()) -> DataFrame:
    """Add ``tier, score, confidence, reasons, gaps``, with codes in rule order."""
    holds = lambda r: F.coalesce(r.when, F.lit(False))
    fired = F.array_compact(F.array(*[F.when(holds(r), F.struct(F.lit(r.effect).alias("effect"), F.lit(r.code).alias("code"))) for r in rules]))
    staged = rows.withColumn("__fired", fired)
    codes = lambda *effects: F.transform(F.filter("__fired", lambda x: x["effect"].isin(*effects)), lambda x: x["code"])
    any_of = lambda effect: F.exists("__fired", lambda x: x["effect"] == effect)
    seen = F.filter("__fired", lambda x: x["effect"].isin(REVIEW, GAP))
    gaps = F.aggregate(
        seen, F.array().cast("array<string>"),
        lambda acc, x: F.when((x["effect"] == REVIEW) & F.array_contains(acc, x["code"]), acc).otherwise(F.array_append(acc, x["code"])),
    )
    total = F.lit(0)
    for s in scores:
        total = total + F.when(F.coalesce(s.when, F.lit(False)), s.points).otherwise(0)
    return staged.select(
        *rows.columns,
        F.when(any_of(REJECT), TIERS[0]).when(any_of(REVIEW), TIERS[1]).otherwise(TIERS[2]).alias("tier"),
        total.cast("int").alias("score"),
        F.when(any_of(REVIEW), "limited").otherwise("high").alias("confidence"),
        codes(REJECT, NOTE).alias("reasons"),
        gaps.alias("gaps"),
    )


def tier_rank(tier: Column) -> Column:
    """0 rejected, 1 review, 2 qualified."""
    return F.when(tier == TIERS[2], 2).when(tier == TIERS[1], 1).otherwise(0)


def share_score(met: Column, total: Column, points: int) -> Column:
    """``points`` in proportion, half to even; nothing asked gives nothing."""
    return F.when(total > 0, F.bround(met * F.lit(float(points)) / total)).otherwise(0).cast("int")


def groups_met(groups: Column, known: Column) -> Column:
    """How many of the groups of alternatives (array of arrays) share a value with ``known``; null groups count as none."""
    return F.size(F.filter(F.coalesce(groups, F.array().cast("array<array<string>>")), lambda g: F.arrays_overlap(g, known)))


def any_sentence(text: Column, needs: str, without: str | None = None) -> Column:
    """How many sentences match ``needs`` and don't match ``without``; null texts have none."""
    sentences = F.split(F.coalesce(F.lower(text), F.lit("")), r"(?<=[.!?])\s+|[\n;]")
    hit = lambda s: s.rlike(needs) if without is None else s.rlike(needs) & ~s.rlike(without)
    return F.size(F.filter(sentences, hit))


def freshness(posted: Column, expires: Column, now: Column, days: int) -> Column:
    """closed, stale, future, unknown or fresh; more than a day ahead counts as future."""
    return (
        F.when(expires < now, "closed").when(posted.isNull(), "unknown").when(posted > now + F.expr("interval 1 day"), "future")
        .when(posted < now - F.expr(f"interval {days} days"), "stale").otherwise("fresh")
    )


def single_code(text: Column, codes: list[str]) -> Column:
    """The one code that a text names; null if it names none or several."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(codes)})\b"), F.lit(1)), F.upper))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def first_contact(text: Column, unless: str) -> Column:
    """The first e-mail address of a text that doesn't match ``unless``."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))
    return F.get(F.filter(found, lambda x: ~x.rlike(unless)), F.lit(0))
