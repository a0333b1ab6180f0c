"""Scans of recorded records: replay files, feeds, pages; bad records are counted, never fatal."""

from __future__ import annotations

import json
import re
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.markup import embedded_json, jsonld_objects, locations
from tidemark.functions.text import host_allowed

#: The fields a recorded posting may have; others are dropped.
POSTING = T.StructType()
for _name in (
    "job_id", "source_id", "platform", "url", "application_url", "title", "company", "location", "candidate_locations", "work_mode", "description", "description_status", "kind",
    "date_posted", "posted_at", "expires_at", "first_seen_at", "date_source", "active_status", "salary_currency", "salary_interval", "salary_text", "query_id", "search_track",
):
    POSTING = POSTING.add(_name, T.StringType())
POSTING = POSTING.add("is_remote", T.BooleanType()).add("aliases", T.ArrayType(T.StringType())).add("source_urls", T.ArrayType(T.StringType()))
POSTING = POSTING.add("salary_min", T.DoubleType()).add("salary_max", T.DoubleType())
_OBJECTS = T.StructType().add("objects", T.ArrayType(T.StringType()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _records(contents: pd.Series) -> pd.Series:
    """Each record of a file as JSON text: a list, or the list under ``jobs`` or ``candidates``; a nested ``job`` is unwrapped."""

    def one(text: str) -> list[str]:
        try:
            data = json.loads(text)
        except ValueError:
            return ["!"]
        rows = data if isinstance(data, list) else next((data[k] for k in ("jobs", "candidates") if isinstance(data.get(k), list)), []) if isinstance(data, dict) else []
        return [json.dumps(r.get("job", r)) if isinstance(r, dict) else "!" for r in rows]

    return contents.map(one)


def read_replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, rejects): records with a title and a platform, and one row (path, record) per bad one.

    One file is one task's unit of work; records are spread before they are parsed.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), _records("value").alias("records"))
    rows = files.select("path", F.explode("records").alias("record")).withColumn("p", F.from_json("record", POSTING, {"mode": "PERMISSIVE"}))
    good = F.coalesce((F.trim("p.title") != "") & (F.trim("p.platform") != ""), F.lit(False)) & (F.col("record") != "!")
    return rows.where(good).select("p.*"), rows.where(~good).select("path", "record")


def read_feed(spark: SparkSession, path: str, domains: list[str], limit: int) -> DataFrame:
    """Rows of JSON feeds (``jobs`` lists) on allowed hosts; the limit counts the raw rows of a file."""
    row = T.StructType().add("id", T.StringType()).add("title", T.StringType()).add("company_name", T.StringType()).add("url", T.StringType())
    row = row.add("description", T.StringType()).add("publication_date", T.StringType()).add("candidate_required_location", T.StringType())
    feed = spark.read.schema(T.StructType().add("jobs", T.ArrayType(row))).option("multiLine", True).json(path)
    rows = feed.select(F.explode(F.slice("jobs", 1, limit)).alias("j")).select("j.*")
    return rows.where(host_allowed(F.col("url"), domains) & (F.trim("title") != ""))


def parse_rss(text: str, limit: int) -> list[dict]:
    """Items of an RSS feed: ``Company: Role`` titles split, RFC 822 dates as ISO; broken XML gives none."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    out = []
    for item in list(root.iter("item"))[:limit]:
        get = lambda name, item=item: (item.findtext(name) or "").strip()
        company, colon, role = get("title").partition(":")
        try:
            stamp = parsedate_to_datetime(get("pubDate")).isoformat()
        except ValueError:
            stamp = ""
        out.append({"title": role.strip() if colon else company.strip(), "company": company.strip() if colon else "", "url": get("link"), "description": get("description"), "posted_at": stamp})
    return [r for r in out if r["title"] and r["url"].startswith(("http://", "https://"))]


def parse_listing(page: str, variable: str = "listing") -> tuple[str, list[dict]]:
    """(how, rows) of a listing page: the embedded object, else JSON-LD, else marked-up cards.

    An embedded object that reports zero results is a valid empty page; a page without any of the
    three could not be parsed.
    """
    blob = embedded_json(page, variable)
    if blob is not None:
        response = json.loads(blob)
        response = response.get("response", response) if isinstance(response, dict) else {}
        buckets = response.get("jobs") or {}
        rows = [r for b in (buckets.values() if isinstance(buckets, dict) else [buckets]) for r in (b or []) if isinstance(r, dict)]
        if rows or response.get("numFound") == 0:
            return ("embedded" if rows else "valid_empty"), rows
    found = [o for o in jsonld_objects(page) if o.get("@type") == "JobPosting"]
    if found:
        name = lambda o: (o.get("hiringOrganization") or {}).get("name") if isinstance(o.get("hiringOrganization"), dict) else o.get("hiringOrganization")
        return "jsonld", [{"title": o.get("title"), "company": name(o), "location": locations(o.get("jobLocation")), "url": o.get("url"), "posted_at": o.get("datePosted")} for o in found]
    cards = re.findall(r'<article[^>]*class="[^"]*\bjob\b[^"]*"[^>]*>.*?<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', page or "", re.S)
    return ("cards", [{"title": re.sub(r"<[^>]+>|\s+", " ", t).strip(), "url": u} for u, t in cards]) if cards else ("parse_failed", [])


def next_offset(current: int, offered: object, most: int = 10_000) -> int | None:
    """The next page's offset if it is a whole number, larger than the current one and not above ``most``."""
    return offered if isinstance(offered, int) and not isinstance(offered, bool) and current < offered <= most else None
