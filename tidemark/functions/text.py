"""Column functions that clean and normalise text, URLs and identities."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Tokens that stand for no value.
NULL_TOKENS = ("nan", "nat", "none", "<na>", "null")
# URL parameters that only track.
TRACKING = ("trk", "trackingid", "refid")
# Last path segments of a company's general page.
GENERAL_PAGES = ("", "careers", "jobs", "positions", "apply")


def strip(value: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def clean_text(value: Column) -> Column:
    """Stripped text; empty for null and for null tokens in any case."""
    text = strip(value)
    return F.when(text.isNull() | F.lower(text).isin(*NULL_TOKENS), "").otherwise(text)


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", t).lower()
        return re.sub(r"\s+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip()

    return values.map(one)


def normalized(value: Column) -> Column:
    """Lower case without accents (NFKD), white space collapsed.

    Plain ASCII, the common case, never leaves the JVM: the Python function sees only null there.
    """
    text = clean_text(value)
    odd = text.rlike(r"[^\x00-\x7F]")
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.coalesce(_fold(F.when(odd, text)), plain)


def optional_bool(value: Column) -> Column:
    """True, false or null for the six spellings that mean something."""
    text = F.lower(clean_text(value))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)


def optional_number(value: Column) -> Column:
    """A finite number or null."""
    number = strip(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def iso_instant(value: Column) -> Column:
    """An ISO-8601 date or time as UTC; without offset it counts as UTC; anything else is null."""
    text = clean_text(value)
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(shape, text.try_cast("timestamp"))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(value: Column, collapse: tuple[tuple[str, str, str], ...] = ()) -> Column:
    """One spelling of a listing URL, or null if it isn't one.

    http and https only, no user info, no white space; lower-case host, no default port, no
    trailing slash, no fragment, no tracking parameters, the others sorted; always https.
    ``collapse`` holds (host, path pattern, replacement) for hosts whose path is shortened.
    """
    text = clean_text(value)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(text, r"^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^([^:@]+)(?::\d*)?$", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    path = F.regexp_replace(F.regexp_extract(text, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING))
    joined = F.array_join(F.transform(F.sort_array(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    for suffix, pattern, replacement in collapse:
        there = ((host == suffix) | host.endswith("." + suffix)) & path.rlike(pattern)
        joined = F.when(there, "").otherwise(joined)
        path = F.when(there, F.regexp_replace(path, pattern, replacement)).otherwise(path)
    place = F.concat(host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)))
    url = F.concat(F.lit("https://"), place, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(scheme.isin("http", "https") & (host != "") & ~text.rlike(r"(?U)\s"), url)


def url_host(value: Column) -> Column:
    """Lower-case host of a URL without user info and port."""
    return F.lower(F.regexp_replace(F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^[^@]*@|:\d*$", ""))


def host_allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    host = url_host(url)
    hits = [(host == d) | host.endswith("." + d) for d in domains]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out & url.rlike(r"(?i)^https?://")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def legacy_id(title: Column, company: Column, url: Column, platform: Column) -> Column:
    """First 16 hex digits of the hash of the lower-cased parts and the stripped URL."""
    raw = F.concat_ws("_", F.lower(_text(platform)), F.lower(_text(title)), F.lower(_text(company)), strip(_text(url)))
    return F.substring(F.sha2(raw, 256), 1, 16)


def stable_id(platform: Column, source_id: Column, url: Column) -> Column:
    """Namespace and first 24 hex digits of the hash of the native id, else of the URL."""
    native = F.when(_text(source_id) != "", source_id).otherwise(_text(url))
    return F.concat(F.regexp_replace(F.lower(_text(platform)), "[^a-z0-9]", ""), F.lit(":"), F.substring(F.sha2(native, 256), 1, 24))


def query_key(source: Column, query: Column) -> Column:
    """Source and first 20 hex digits of the hash of the query."""
    return F.concat(source, F.lit(":"), F.substring(F.sha2(_text(query), 256), 1, 20))


# How texts speak of the mode of work.
NOT_REMOTE = (
    r"\b(?:no|not|non)[ -]?remote\b|\b(?:remote(?: work)?|work from home)\s+(?:is\s+)?(?:not (?:permitted|allowed|available|offered)|unavailable)\b"
    r"|\b(?:on[ -]?site|in[ -]?office)\s+only\b"
)
REMOTE_ROLE = (
    r"\b(?:fully|100%|work(?:ing)?)\s+remote\b|\bremote\s+(?:role|position|job|work|opportunity)\b|\b(?:role|position|job)\s+is\s+remote\b|\bwork from home\b|\bwfh\b"
)
ON_SITE = r"\bon[ -]?site\b|\bin[ -]?office\b"


def work_mode(heading: Column, body: Column, reported: Column) -> Column:
    """on_site, hybrid, remote or unknown from normalised heading and body; negations come first."""
    text = F.concat_ws(" ", heading, body)
    return (
        F.when(text.rlike(NOT_REMOTE), "on_site")
        .when(text.rlike(r"\bhybrid\b"), "hybrid")
        .when(reported == F.lit(False), "on_site")
        .when((reported == F.lit(True)) | heading.rlike(r"\bremote\b") | body.rlike(REMOTE_ROLE), "remote")
        .when(text.rlike(ON_SITE), "on_site")
        .otherwise("unknown")
    )


def terms_in(text: Column, terms: dict[str, list[str]]) -> Column:
    """Sorted names of the terms of which an alias stands in the text as a word of [a-z0-9].

    One projection whatever the number of terms; aliases are regular expressions.
    """
    tests = [F.when(text.rlike(rf"(?<![a-z0-9])(?:{'|'.join(aliases)})(?![a-z0-9])"), F.lit(name)) for name, aliases in sorted(terms.items())]
    return F.array_compact(F.array(*tests))


def title_key(value: Column) -> Column:
    """Letters and digits of the normalised title, for equality."""
    return F.trim(F.regexp_replace(normalized(value), "[^a-z0-9]+", " "))


def snowflake(value: Column) -> Column:
    """Whether the text is a numeric id of at most 22 digits."""
    return F.coalesce(value.rlike(r"^[0-9]{1,22}$"), F.lit(False))


def display(value: Column, limit: int) -> Column:
    """Text safe to show: markup escaped, mentions broken by a zero-width blank, cut to ``limit``."""
    escaped = F.regexp_replace(clean_text(value), r"([\\`*_{}\[\]()#+.!|>~-])", r"\\$1")
    return F.left(F.replace(escaped, F.lit("@"), F.lit("@​")), F.lit(limit))


def sanitize(value: Column) -> Column:
    """E-mail addresses and the query part of URLs taken out of a report string."""
    no_mail = F.regexp_replace(value, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")
    return F.regexp_replace(no_mail, r"(https?://[^\s?#]+)[?#]\S*", "$1")
