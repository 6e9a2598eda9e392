"""A guarded HTTP source: one partition a host, GET only, every hop checked, errors as a column.

    spark.dataSource.register(HttpPages)
    spark.read.format("pagescope_http").option("urls", "https://a.example/ https://b.example/").load()
"""

from __future__ import annotations

import http.client
import socket
import ssl
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from pagescope.functions.urls import host_of, safe_ip

# Bounds of a fetch.
MAX_BODY, MAX_INFLATED, MAX_REDIRECTS, CONNECT_S, READ_S = 5 * 1024 * 1024, 20 * 1024 * 1024, 5, 10, 15
HTML_TYPES = ("text/html", "application/xhtml+xml")
DECODABLE = ("gzip", "x-gzip", "deflate", "identity")
SCHEMA = "url string, final_url string, status int, content_type string, headers map<string,string>, html string, byte_size long, error_kind string, fetch_ms long"


class Refused(Exception):
    """A fetch that must not go on; kind is one of unsafe_url, too_large, content_type, content_encoding, tls, timeout, network, fetch."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


@dataclass
class Response:
    status: int
    headers: dict = field(default_factory=dict)
    read: Callable[[int], bytes] = lambda n: b""
    close: Callable[[], None] = lambda: None


def check_url(url: str, resolve=None) -> tuple[str, str, int, str]:
    """(scheme, host, port, address) of a URL that may be fetched; every address of the host must be public."""
    try:
        parts = urlsplit(url)
        port = parts.port or (443 if parts.scheme == "https" else 80)
    except ValueError as e:
        raise Refused("unsafe_url", str(e)) from e
    host = (parts.hostname or "").rstrip(".")
    if parts.scheme not in ("http", "https") or parts.username or parts.password or not host or port not in (80, 443):
        raise Refused("unsafe_url", "scheme, credentials, host or port")
    if len(host) > 253 or any(not 0 < len(x) <= 63 for x in host.split(".")):
        raise Refused("unsafe_url", "host name")
    try:
        found = (resolve or _addresses)(host, port)
    except OSError as e:
        raise Refused("network", "the host does not resolve") from e
    if not found or not all(safe_ip(a) for a in found):
        raise Refused("unsafe_url", "the host resolves to a private address")
    return parts.scheme, host, port, found[0]


def _addresses(host: str, port: int) -> list[str]:
    return [a[4][0] for a in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]


def _connect(scheme: str, host: str, port: int, address: str, target: str, agent: str) -> Response:
    """A request to the very address that was checked."""
    sock = socket.create_connection((address, port), CONNECT_S)
    try:
        sock.settimeout(READ_S)
        if scheme == "https":
            sock = ssl.create_default_context().wrap_socket(sock, server_hostname=host)
        link = http.client.HTTPConnection(host, port)
        link.sock = sock
        link.request("GET", target, headers={"User-Agent": agent, "Accept": "text/html,*/*;q=0.1", "Accept-Encoding": "gzip, deflate"})
        got = link.getresponse()
    except BaseException:
        sock.close()
        raise

    def close() -> None:
        got.close()
        link.close()

    return Response(got.status, {k.lower(): v for k, v in got.getheaders()}, got.read, close)


def read_capped(r: Response, deadline: float) -> bytes:
    """The decoded body; refuses by declared length before reading, by real length while reading."""
    declared = r.headers.get("content-length", "")
    if declared.isdigit() and int(declared) > MAX_BODY:
        raise Refused("too_large")
    coding = [c.strip().lower() for c in r.headers.get("content-encoding", "").split(",") if c.strip()]
    if any(c not in DECODABLE for c in coding):
        raise Refused("content_encoding")
    unpack = zlib.decompressobj(47) if any(c != "identity" for c in coding) else None
    wire, out = 0, bytearray()
    while chunk := r.read(64 * 1024):
        wire += len(chunk)
        try:
            out += unpack.decompress(chunk, MAX_INFLATED + 1 - len(out)) if unpack else chunk
        except zlib.error as e:
            raise Refused("content_encoding", str(e)) from e
        if wire > MAX_BODY or len(out) > MAX_INFLATED or (unpack and unpack.unconsumed_tail):
            raise Refused("too_large")
        if time.monotonic() > deadline:
            raise Refused("timeout")
    return bytes(out)


def safe_get(url: str, agent: str = "PagescopeBot/0.1", budget_s: float = 30.0, connect=_connect, resolve=None, types=HTML_TYPES) -> dict:
    """One row of SCHEMA; never raises."""
    began, at, seen = time.monotonic(), url, set()
    row = dict.fromkeys(("status", "content_type", "html", "byte_size", "error_kind"), None) | {"url": url, "final_url": url, "headers": {}}
    r = None
    try:
        for _ in range(MAX_REDIRECTS + 1):
            if r is not None:
                r.close()
            if at in seen:
                raise Refused("fetch", "redirects form a loop")
            seen.add(at)
            scheme, host, port, address = check_url(at, resolve)
            parts = urlsplit(at)
            r = connect(scheme, host, port, address, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), agent)
            row |= {"status": r.status, "final_url": at, "headers": r.headers, "content_type": r.headers.get("content-type")}
            if r.status in (301, 302, 303, 307, 308) and r.headers.get("location"):
                at = urljoin(at, r.headers["location"])
                continue
            if types and (row["content_type"] or "").split(";")[0].strip().lower() not in types:
                raise Refused("content_type")
            body = read_capped(r, began + budget_s)
            row |= {"html": body.decode("utf-8", "replace"), "byte_size": len(body)}
            break
        else:
            raise Refused("fetch", "too many redirects")
    except Refused as e:
        row["error_kind"] = e.kind
    except ssl.SSLError:
        row["error_kind"] = "tls"
    except TimeoutError:
        row["error_kind"] = "timeout"
    except (OSError, http.client.HTTPException):
        row["error_kind"] = "network"
    except Exception:
        row["error_kind"] = "unexpected"
    finally:
        if r is not None:
            r.close()
    return row | {"fetch_ms": int((time.monotonic() - began) * 1000)}


_COLUMNS = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]


def fetch_table(urls: DataFrame, hosts: int | None = None, agent: str = "PagescopeBot/0.1", get: Callable[..., dict] = safe_get, types=HTML_TYPES, budget_s: float = 270.0) -> DataFrame:
    """url (and delay, seconds between two requests to a host) -> a row of SCHEMA each, fetched where the rows are.

    URLs of a host are fetched one after the other in one task, in the order of place if
    there is one. What is left when the host's budget of seconds is spent has the error
    `budget`. Repeated URLs are fetched once.
    """
    for name, kind in (("delay", "double"), ("place", "long")):
        if name not in urls.columns:
            urls = urls.withColumn(name, F.lit(None).cast(kind))
    rows = urls.groupBy("url").agg(F.max("delay").alias("delay"), F.min("place").alias("place")).withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    parts = hosts or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "host").sortWithinPartitions("host", F.asc_nulls_last("place"), "url").select("host", "url", "delay")

    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, began = None, 0.0
        for batch in it:
            for host, url, delay in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host != at:
                    at, began = host, time.monotonic()
                elif delay:
                    time.sleep(min(delay, max(0.0, budget_s - (time.monotonic() - began))))
                if time.monotonic() - began >= budget_s:
                    row = dict.fromkeys(_COLUMNS) | {"url": url, "final_url": url, "headers": {}, "error_kind": "budget"}
                else:
                    row = get(url, agent=agent, types=types)
                yield pa.RecordBatch.from_pylist([{c: list(row[c].items()) if c == "headers" else row[c] for c in _COLUMNS}], schema)

    return rows.mapInArrow(batches, SCHEMA)


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagescope_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options.get("urls", "").split())


class _HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _HttpReader(DataSourceReader):
    """Pages of one host are fetched one after the other."""

    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).hostname or "", []).append(u)
        return [_HostPartition(v) for v in hosts.values()]

    def read(self, partition: _HostPartition):
        for u in partition.urls:
            row = safe_get(u)
            yield tuple(row[c] for c in _COLUMNS)
