"""URL functions: column expressions for crawl URLs, an Arrow function for hrefs as found on pages."""

from __future__ import annotations

import ipaddress
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EXCLUDED = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".zip", ".mp4", ".mp3", ".css", ".js", ".xml", ".json"]
MAX_DEPTH, MAX_PAGES = 2, 5
HOST_STOPS = ["www", "com", "org", "net", "co", "uk", "io", "gov", "edu", "us", "de", "fr"]


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(host_of(a) == host_of(b), F.lit(False))


def path_depth(url: Column) -> Column:
    """Number of path segments; 99 if the URL cannot be read."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path.isNull(), 99).otherwise(F.size(F.filter(F.split(path, "/"), lambda x: x != "")))


def normalize_url(url: Column) -> Column:
    """Without fragment; an empty path becomes /."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]+)\?", r"$1/?"))


def excluded_extension(url: Column) -> Column:
    pattern = "(?i)(" + "|".join(e.replace(".", r"\.") for e in EXCLUDED) + ")$"
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")).rlike(pattern), F.lit(False))


def is_auditable(url: Column, home: Column) -> Column:
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https"), F.lit(False)) & same_site(url, home) & ~excluded_extension(url) & (path_depth(url) <= MAX_DEPTH)


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/@]*@", "$1[REDACTED]@")


def url_problem(url: Column) -> Column:
    """Why a URL may not be fetched: scheme, userinfo, host or port; null if it may."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    host = F.coalesce(part("HOST"), F.lit(""))
    return (
        F.when(~F.coalesce(F.lower(part("PROTOCOL")).isin("http", "https"), F.lit(False)), "scheme")
        .when(F.coalesce(part("USERINFO"), F.lit("")) != "", "userinfo")
        .when((host == "") | (F.length(host) > 253) | F.exists(F.split(host, r"\."), lambda x: F.length(x) > 63), "host")
        .when((port != "") & ~port.isin("80", "443"), "port")
    )


def host_suffixes(host: Column) -> Column:
    """a.b.c -> a.b.c, b.c, c: a join on these finds a domain list's entry for the host or for a parent of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _joined(base: pa.Array, href: pa.Array) -> pa.Array:
    out = []
    for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True):
        try:
            url = urldefrag(urljoin(b or "", h or ""))[0]
            parts = urlsplit(url)
            out.append({"url": url, "scheme": parts.scheme.lower(), "host": (parts.hostname or "").removeprefix("www."), "path": parts.path})
        except ValueError:
            out.append(None)
    return pa.array(out, pa.struct([("url", pa.string()), ("scheme", pa.string()), ("host", pa.string()), ("path", pa.string())]))


def url_join(base: Column, href: Column) -> Column:
    """The absolute URL of an href and its parts; null where it cannot be read."""
    return F.arrow_udf(_joined, "url string, scheme string, host string, path string")(base, href)


def _embedded(ip):
    if ip.version == 4:
        return [ip]
    found = [ip]
    if ip.ipv4_mapped:
        found.append(ip.ipv4_mapped)
    if ip.sixtofour:
        found.append(ip.sixtofour)
    if ip.teredo:
        found += list(ip.teredo)
    if ip in ipaddress.ip_network("64:ff9b::/96"):
        found.append(ipaddress.ip_address(int(ip) & 0xFFFFFFFF))
    return found


def safe_ip(text: str | None) -> bool:
    """A public unicast address, also in every address that it embeds."""
    try:
        ip = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return False
    bad = lambda x: x.is_private or x.is_loopback or x.is_link_local or x.is_reserved or x.is_multicast or x.is_unspecified or str(x) == "169.254.169.254"
    inner = _embedded(ip)
    return not any(bad(x) for x in (inner[1:] if len(inner) > 1 and ip in ipaddress.ip_network("64:ff9b::/96") else inner))


def is_safe_ip(ip: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([safe_ip(x) for x in a.to_pylist()], pa.bool_()), "boolean")(ip)
