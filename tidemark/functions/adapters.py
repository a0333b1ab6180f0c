"""Column functions that turn what a source returns into fields of a record; all lists are the caller's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tidemark.functions.text import canonical_url, clean_text, host_allowed, optional_bool, url_host


def first_link(links: Column) -> Column:
    """The first of several links that is a listing URL, in canonical form; null if none is."""
    return F.get(F.filter(F.transform(links, lambda u: canonical_url(u)), lambda u: u.isNotNull()), F.lit(0))


def salary_evidence(source: Column, currency: Column, direct: str = "direct_data") -> Column:
    """disclosed where the source states pay itself, inferred where only a currency is known, else unknown."""
    return F.when(clean_text(source) == direct, "disclosed").when(clean_text(currency) != "", "inferred").otherwise("unknown")


def reported_remote(flag: Column, site: Column, silent: Sequence[str]) -> Column:
    """The flag as reported; a no of a site that only leaves remote work unmentioned is null."""
    value = optional_bool(flag)
    return F.when(~(F.lower(site).isin(*silent) & ~value) | value.isNull() | site.isNull(), value)


def plan_id(prefix: Column, *parts: Column) -> Column:
    """Identity of a planned search: the prefix and 16 hex digits of the hash of its parts."""
    return F.concat(prefix, F.lit(":"), F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), F.lit(16)))


def employer_posting(url: Column, providers: Sequence[tuple[str, Sequence[str], str]]) -> Column:
    """(provider, board, id) that an application URL names exactly; null if it names none.

    ``providers`` holds (name, hosts, path pattern with the groups board and id).
    """
    canonical = canonical_url(url)
    path = F.regexp_extract(canonical, r"^https://[^/?]*([^?]*)", 1)
    out = F.lit(None)
    for name, hosts, pattern in reversed(providers):
        there = url_host(canonical).isin(*hosts) & path.rlike(f"^{pattern}$")
        parts = [F.lit(name).alias("provider"), F.regexp_extract(path, f"^{pattern}$", 1).alias("board"), F.regexp_extract(path, f"^{pattern}$", 2).alias("id")]
        out = F.when(there, F.struct(*parts)).otherwise(out)
    return out


def simplified(query: Column, places: Sequence[str], skills: Sequence[str], site: str, skill: str, tail: str) -> Column:
    """A plainer variant of a search: its site, the first known place and skill, and ``tail``."""
    first = lambda words, default: F.coalesce(*[F.when(F.lower(query).contains(w.lower()), w) for w in words], F.lit(default))
    found = F.regexp_extract(query, r"(site:\S+)", 1)
    return F.concat_ws(" ", F.when(found != "", found).otherwise(F.lit(site)), first(places, None), first(skills, skill), F.lit(tail))


def post_url(url: Column, domains: list[str], prefixes: Sequence[str]) -> Column:
    """Whether a URL opens a post: an allowed host and a path that begins with one of the prefixes."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | path.startswith(p)
    return F.coalesce(host_allowed(url, domains) & begins, F.lit(False))


def recent(posted: Column, now: Column, days: int) -> Column:
    """Whether a post is from the last ``days`` whole days; unknown and future dates aren't recent."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(posted)) / 86_400_000_000)
    return F.coalesce(age.between(0, days), F.lit(False))
