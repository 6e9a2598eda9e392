"""robots.txt and sitemaps that are already in a column."""

from __future__ import annotations

import gzip
import io
import zlib
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagescope.functions.schema import BOOL, DOUBLE, STR, array, struct

# Tokens of AI crawlers; bounds of a sitemap scan.
AI_CRAWLERS = ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "PerplexityBot", "Google-Extended", "CCBot", "Applebot-Extended"]
MAX_SITEMAP_BYTES, MAX_SITEMAP_URLS, MAX_CHILDREN = 2 * 1024 * 1024, 500, 3
ROBOTS = struct(allowed=BOOL, determinable=BOOL, ai=T.MapType(STR, BOOL), crawl_delay=DOUBLE, sitemaps=array(STR))
SITEMAP = struct(pages=array(STR), children=array(STR))


def read_robots(status: int | None, text: str | None, url: str | None, agent: str) -> dict:
    """An error or 5xx refuses; 4xx allows all; a text that cannot be read allows all but determines nothing."""
    none = {"allowed": True, "determinable": True, "ai": [(t, True) for t in AI_CRAWLERS], "crawl_delay": None, "sitemaps": []}
    if status is None or status >= 500:
        return {"allowed": False, "determinable": False, "ai": [], "crawl_delay": None, "sitemaps": []}
    if status >= 400:
        return none
    parser = RobotFileParser()
    try:
        parser.parse((text or "").splitlines())
        delay = parser.crawl_delay(agent)
        return {
            "allowed": parser.can_fetch(agent, url or "/"),
            "determinable": True,
            "ai": [(t, parser.can_fetch(t, url or "/")) for t in AI_CRAWLERS],
            "crawl_delay": None if delay is None else float(delay),
            "sitemaps": parser.site_maps() or [],
        }
    except (ValueError, TypeError):
        return {**none, "determinable": False, "ai": []}


def robots(status: Column, text: Column, url: Column, agent: str = "PagescopeBot") -> Column:
    def run(s: pa.Array, t: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array([read_robots(*row, agent) for row in zip(s.to_pylist(), t.to_pylist(), u.to_pylist(), strict=True)], to_arrow_type(ROBOTS))

    return F.arrow_udf(run, ROBOTS)(status, text, url)


def blocked_crawlers(ai: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(ai, lambda _, v: ~v)))


def read_sitemap(raw: bytes | None) -> dict:
    """Locations of a urlset as pages, of an index as children; anything unreadable is empty."""
    none = {"pages": [], "children": []}
    try:
        data = raw or b""
        if data[:2] == b"\x1f\x8b":
            data = gzip.GzipFile(fileobj=io.BytesIO(data)).read(MAX_SITEMAP_BYTES + 1)
        root = ElementTree.fromstring(data[:MAX_SITEMAP_BYTES])
    except (ElementTree.ParseError, OSError, EOFError, zlib.error, ValueError):
        return none
    bare = lambda e: e.tag.rpartition("}")[2].lower()
    found = [e.text.strip() for e in root.iter() if bare(e) == "loc" and e.text and e.text.strip()][:MAX_SITEMAP_URLS]
    return {**none, "children" if bare(root) == "sitemapindex" else "pages": found}


def sitemap(raw: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([read_sitemap(x) for x in a.to_pylist()], to_arrow_type(SITEMAP)), SITEMAP)(raw)
