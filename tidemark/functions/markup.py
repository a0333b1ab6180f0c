"""Text and records out of HTML, JSON-LD, embedded JSON and feeds; Arrow functions on the standard parser."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F, types as T

BLOCKS = {"p", "div", "li", "ul", "ol", "br", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "dd", "dt"}
SILENT = {"script", "style", "template", "noscript"}


class _Text(HTMLParser):
    def __init__(self, blocks: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.silent = blocks, [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if self.blocks and tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT and self.silent > 0
        if self.blocks and tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def html_text(markup: str | None, blocks: bool = True) -> str:
    """Text of a page; with ``blocks`` one line per block, else one line. Escaped markup is read up to two levels deep."""
    text = markup or ""
    for _ in range(2):
        if re.search(r"&lt;/?[a-z]", text, re.I):
            text = html.unescape(text)
    parser = _Text(blocks)
    parser.feed(text)
    parser.close()
    lines = [re.sub(r"\s+", " ", line).strip() for line in "".join(parser.parts if blocks else [" ".join(parser.parts)]).split("\n")]
    return "\n".join(line for line in lines if line) if blocks else " ".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def block_text(values: pd.Series) -> pd.Series:
    """``html_text`` with block boundaries kept; null becomes empty."""
    return values.map(lambda v: html_text(v) if isinstance(v, str) else "")


@F.pandas_udf(T.StringType())
def flat_text(values: pd.Series) -> pd.Series:
    """``html_text`` on one line; null becomes empty."""
    return values.map(lambda v: html_text(v, False) if isinstance(v, str) else "")


class _Scripts(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.open, self.found = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "script" and (dict(attrs).get("type") or "").lower() == "application/ld+json":
            self.open = True
            self.found.append("")

    def handle_endtag(self, tag):
        self.open = self.open and tag != "script"

    def handle_data(self, data):
        if self.open:
            self.found[-1] += data


def jsonld_objects(page: str | None) -> list[dict]:
    """Every object of a page's JSON-LD, through graphs and item lists; broken blocks are skipped."""
    parser = _Scripts()
    parser.feed(page or "")
    out: list[dict] = []
    for block in parser.found:
        try:
            stack = [json.loads(block)]
        except ValueError:
            continue
        while stack:
            item = stack.pop()
            if isinstance(item, list):
                stack.extend(reversed(item))
            elif isinstance(item, dict):
                out.append(item)
                stack.extend(item[k] for k in ("item", "itemListElement", "@graph") if isinstance(item.get(k), (dict, list)))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def jsonld(values: pd.Series) -> pd.Series:
    """JSON-LD objects of a page, each as a JSON string."""
    return values.map(lambda v: [json.dumps(o, sort_keys=True) for o in jsonld_objects(v if isinstance(v, str) else None)])


def embedded_json(page: str | None, name: str) -> str | None:
    """The object assigned to a script variable; read, never run."""
    m = re.search(rf"\b{re.escape(name)}\s*=\s*(?=[\[{{])", page or "")
    if not m:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(page, m.end())[0], sort_keys=True)
    except ValueError:
        return None


def locations(value) -> str:
    """A schema.org location of any shape as one line."""
    if isinstance(value, list):
        return "; ".join(dict.fromkeys(x for x in map(locations, value) if x))
    if isinstance(value, dict):
        inner = value.get("address", value.get("name") if "address" not in value and "addressLocality" not in value else None)
        if isinstance(inner, (dict, list)):
            return locations(inner)
        parts = [value.get(k) for k in ("addressLocality", "addressRegion", "addressCountry")]
        parts = [p.get("name") if isinstance(p, dict) else p for p in parts]
        return ", ".join(str(p).strip() for p in parts if p) or (str(inner).strip() if inner else "")
    return str(value).strip() if value else ""
