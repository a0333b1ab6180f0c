"""A search as a Python data source: one partition per query, a time limit inside each, outcomes as rows.

By default pages come from files; a live fetcher must be passed in explicitly.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Query(InputPartition):
    """One search: keyword, track and site."""

    keyword: str
    track: str
    site: str


def classify(status: int | None, text: str = "") -> str:
    """Outcome of a response: success, http_429, blocked, not_found, http_5xx, challenge, timeout or failed."""
    if status is None:
        return "timeout" if "timed out" in text.lower() else "failed"
    if any(mark in text.lower() for mark in ("captcha", "unusual traffic", "verify you are human")):
        return "challenge"
    return "success" if 200 <= status < 300 else "http_429" if status == 429 else "blocked" if status in (401, 403) else "not_found" if status == 404 else "http_5xx" if status >= 500 else "failed"


class FileReader(DataSourceReader):
    """Reads ``<path>/<site>/<track>/<keyword>.jsonl`` for each query."""

    def __init__(self, options: dict) -> None:
        self.root, self.seconds = options["path"], float(options.get("timeout", "30"))
        self.limit = int(options.get("results", "1000"))
        self.queries = [Query(*q) for q in json.loads(options["queries"])]

    def partitions(self) -> list[Query]:
        return self.queries

    def read(self, partition: Query) -> Iterator[tuple]:
        deadline = time.monotonic() + self.seconds
        path = Path(self.root) / partition.site / partition.track / f"{partition.keyword}.jsonl"
        common = (partition.site, partition.track, partition.keyword)
        if not path.exists():
            yield (*common, "failed", None, None, "missing")
            return
        n = bad = 0
        with path.open(encoding="utf-8") as lines:
            for line in lines:
                if n >= self.limit:
                    break
                if time.monotonic() > deadline:
                    yield (*common, "partial", None, None, "timeout")
                    return
                n += 1
                try:
                    row = json.loads(line)
                    yield (*common, "row", str(row["title"]), str(row["url"]), None)
                except (ValueError, KeyError, TypeError):
                    bad += 1
        yield (*common, "success" if n > bad else "valid_empty" if not n else "failed", None, None, f"{bad} invalid" if bad else None)


class ListingSource(DataSource):
    """``spark.read.format("listing").option("path", ...).option("queries", json)``."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "site string, search_track string, keyword string, outcome string, title string, url string, reason string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FileReader(dict(self.options))


def plan(keywords: list[str], tracks: list[str], sites: list[str], allowed: Callable[[str, str], bool] = lambda track, site: True) -> str:
    """Every keyword, track and site that belong together, as the ``queries`` option."""
    return json.dumps([(k, t, s) for k in keywords for t in tracks for s in sites if allowed(t, s)])
