"""Queries of the problems tagged llm, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from tidemark.llm import canonical, forest, neardup, packing, pii, subjects, survivors, tokens
from tidemark.llm.sql import SQL
from tidemark.storage import table

__all__ = ["QUERIES", "SQL"]


def _q(build, *tables):
    return lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables])


QUERIES = {
    "p2_found": _q(forest.found_listings, "postings", "platforms"),
    "p2_near": _q(forest.near_listings, "postings"),
    "p3_found": _q(neardup.found_reposts, "postings"),
    "p3_groups": _q(neardup.repost_groups, "postings"),
    "p4_found": _q(canonical.found_canonical, "postings", "places", "role_titles"),
    "p4_matches": _q(canonical.all_matches, "postings", "places", "role_titles"),
    "p5_found": _q(survivors.found_survivors, "postings", "platforms", "date_sources"),
    "p5_judged": _q(survivors.judged_values, "postings", "platforms", "date_sources"),
    "p5_quality": _q(survivors.source_quality, "postings", "platforms", "date_sources"),
    "p6_found": _q(pii.found_mentions, "postings"),
    "p6_redacted": _q(pii.redacted, "postings"),
    "p8_ids": _q(tokens.token_ids, "documents"),
    "p10_found": _q(subjects.found_subjects, "documents", "subject_labels"),
    "p9_packing": _q(packing.packed, "documents"),
    "p9_report": _q(packing.packing_report, "documents"),
}
