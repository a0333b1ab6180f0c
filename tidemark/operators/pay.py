"""Pay in many currencies, periods and scales as US dollars per year."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.pay import NOTHING, currency, period, read_pay
from tidemark.operators.units import conversions

# Scales as conversions into each other.
SCALE_EDGES = [
    ("scale", "hundredth", "one", 0.01, 0.0), ("scale", "thousand", "one", 1000.0, 0.0), ("scale", "lakh", "thousand", 100.0, 0.0),
    ("scale", "million", "lakh", 10.0, 0.0), ("scale", "crore", "lakh", 100.0, 0.0), ("scale", "crore", "million", 10.0, 0.0),
]
TARGETS = {"currency": "USD", "period": "year", "scale": "one"}

FIELDS = "posting_no long, lo double, hi double, lo_scale string, hi_scale string, currency string, period string"
_ARROW = pa.schema([("posting_no", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), *[(n, pa.string()) for n in ("lo_scale", "hi_scale", "currency", "period")]])


def _finite(x: float | None) -> float | None:
    return x if x is not None and x == x and abs(x) != float("inf") else None


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns and text of each row as bounds with their scales, currency and period; rows without an amount are left out."""
    for batch in batches:
        out: list[tuple] = []
        for no, low, high, money, interval, text, home in zip(*[batch.column(i).to_pylist() for i in range(7)]):
            low, high = _finite(low), _finite(high)
            lo, hi, lo_scale, hi_scale, remark, code, unit = read_pay(text, home) if text else NOTHING
            if low is not None or high is not None:
                lo, hi, lo_scale, hi_scale = low, high, remark, remark
                code = currency(money, home) or code
            else:
                code = code or currency(money, home)
            unit = unit or period(interval)
            if lo is not None or hi is not None:
                out.append((no, lo, hi, lo_scale or "one", hi_scale or "one", code, unit))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, _ARROW.types)], schema=_ARROW)


def stated_pay(postings: DataFrame, platforms: DataFrame, pay_units: DataFrame) -> DataFrame:
    """``posting_no, lo, hi, currency, period`` of every row with an amount, and the conversions ``ca, cb, pa`` of its units.

    Bounds are in whole units of the currency; a unit that is missing or that ``pay_units`` doesn't
    know has null conversions.
    """
    spark = postings.sparkSession
    homes = platforms.select(F.lower(F.trim("platform")).alias("__p"), F.col("home_currency").alias("__home")).dropDuplicates(["__p"])
    rows = (
        postings.where(F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull() | F.col("salary_text").rlike(r"\d"))
        .withColumn("__p", F.lower(F.trim("platform")))
        .join(homes, "__p", "left")
        .select("posting_no", "salary_min", "salary_max", "salary_currency", "salary_interval", "salary_text", "__home")
    )
    table = conversions(spark, pay_units, TARGETS, SCALE_EDGES)
    of = lambda kind, key, a, b: table.where(F.col("kind") == kind).select(F.col("unit").alias(key), F.col("a").alias(a), F.col("b").alias(b))
    stated = rows.mapInArrow(_bounds, FIELDS)
    scaled = stated.join(of("scale", "lo_scale", "la", "lb"), "lo_scale").join(of("scale", "hi_scale", "ha", "hb"), "hi_scale")
    whole = scaled.select("posting_no", (F.col("lo") * F.col("la") + F.col("lb")).alias("lo"), (F.col("hi") * F.col("ha") + F.col("hb")).alias("hi"), "currency", "period")
    ordered = whole.withColumns({"lo": F.when((F.col("lo") > F.col("hi")), F.col("hi")).otherwise(F.col("lo")), "hi": F.when((F.col("lo") > F.col("hi")), F.col("lo")).otherwise(F.col("hi"))})
    return ordered.join(of("currency", "currency", "ca", "cb"), "currency", "left").join(of("period", "period", "pa", "pb"), "period", "left")


def found_pay(postings: DataFrame, platforms: DataFrame, pay_units: DataFrame) -> DataFrame:
    """Rows whose fields together give an amount, a currency and a period.

    Columns come first; remarks in the text about scale and period apply to them. Bounds are
    whole US dollars per year, lower bound first, -1 where a bound isn't stated. NaN counts as
    null; texts are read whole; rows without amount, currency or period, and those whose units
    ``pay_units`` doesn't know, give no row (``unread_pay`` counts them); empty tables give an
    empty result.
    """
    known = stated_pay(postings, platforms, pay_units).where("ca is not null and pa is not null")
    year = lambda c: (F.col(c) * F.col("ca") + F.col("cb")) * F.col("pa") + F.col("pb")
    usd = lambda c: F.coalesce(F.round(year(c)).cast("bigint"), F.lit(-1).cast("bigint"))
    return known.select("posting_no", usd("lo").alias("usd_year_min"), usd("hi").alias("usd_year_max"))


def unread_pay(postings: DataFrame, platforms: DataFrame, pay_units: DataFrame) -> DataFrame:
    """``(reason, unit, n)``: rows with an amount that give no pay, by what is missing or unknown."""
    rows = stated_pay(postings, platforms, pay_units).where("ca is null or pa is null")
    reason = F.when(F.col("currency").isNull(), "no currency").when(F.col("ca").isNull(), "unknown currency").when(F.col("period").isNull(), "no period").otherwise("unknown period")
    unit = F.when(F.col("ca").isNull(), F.col("currency")).otherwise(F.col("period"))
    return rows.groupBy(reason.alias("reason"), unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"))
