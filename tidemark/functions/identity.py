"""Keys that say two captured rows are the same listing: ids and the listing a URL opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What stands in an id field where there is no id.
PLACEHOLDERS = ("", "unknown", "n/a", "na", "none", "null", "nan", "nat", "<na>", "-", "--", "?", "tbd", "undefined", "nil", "not available")


def clean_id(value: Column) -> Column:
    """An id without blanks and in lower case; null for a placeholder."""
    bare = F.lower(F.regexp_replace(value, r"[\s ​]+", ""))
    return F.when(~bare.isin(*[p.replace(" ", "") for p in PLACEHOLDERS]), bare)


def ids_of(job_id: Column, aliases: Column) -> Column:
    """Distinct clean ids of a row (job_id and aliases); an empty array where there are none."""
    raw = F.concat(F.array(job_id), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(raw, clean_id), lambda x: x.isNotNull()))


def with_listing_key(rows: DataFrame, platforms: DataFrame, url: str = "url", out: str = "listing") -> DataFrame:
    """Add ``out``: the listing that ``url`` opens, or null if it opens none.

    Scheme, letter case of the host, a leading ``www.`` or ``m.``, port, fragment, a trailing
    slash and parameters that don't choose the listing don't matter. ``listing_key`` of
    ``platforms`` says which piece names the listing; on other hosts it is the whole path.
    A path without a listing number (four digits in a row) is a general page: null.
    """
    rules = platforms.select(F.lower("host").alias("__host"), F.col("listing_key").alias("__rule")).dropna().dropDuplicates(["__host"])
    text = F.trim(F.regexp_replace(F.col(url), r"[\s ]+", ""))
    bare = F.regexp_replace(text, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//", "")
    authority = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@|:\d*$|\.$", ""), r"^(?:(?:www\d?|m|mobile)\.)+", "")
    staged = rows.withColumn("__bare", bare).withColumn("__host", host).join(rules, "__host", "left")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("__bare", r"^[^/?#]*([^?#]*)", 1), "/+", "/"), "/$", "")
    whole = F.when(path.rlike(r"\d{4}"), path)
    number = F.regexp_extract(path, r"(\d+)$", 1)
    name = F.regexp_extract("__rule", r"^parameter (\S+)$", 1)
    query = F.regexp_extract("__bare", r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "[&;]"), lambda p: F.lower(F.substring_index(p, "=", 1)) == F.lower(name))
    parameter = F.substring_index(F.get(pairs, F.lit(0)), "=", -1)
    piece = (
        F.when(F.col("__rule").isNull() | (F.col("__rule") == "whole path"), whole)
        .when(F.col("__rule") == "number ending the path", number)
        .when(name != "", F.coalesce(parameter, F.lit("")))
    )
    key = F.when((F.col("__host") != "") & (piece != ""), F.concat(F.lit("url|"), F.col("__host"), F.lit("|"), piece))
    return staged.withColumn(out, key).drop("__bare", "__host", "__rule")
