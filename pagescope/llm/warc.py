"""WARC archives: writing, the monolithic-gzip normaliser with its offset index, reading.

A writer that gzips a whole file as one stream leaves no way into its middle. The
normaliser inflates such a stream once, chunk by chunk, rewrites every record as a
gzip member of its own and writes a sidecar index with a line for each record:
offset, length of the member, WARC-Record-ID. Readers go from index to record.

Records of equal payloads: the one with the smallest page_id is a response, the
others are revisits that name it and carry no payload.

Defined cases: a null html is an empty payload; payloads of any length; repeated
rows of one page_id and payload give one record each, all of the same type; a null
page_id is a response that no other refers to and stays null; an
empty table gives no archive and no row; a null url is an empty target URI; other
columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescope.llm import storage

LEVEL, CHUNK = 5, 1 << 20
#: Payload bytes after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
END = b"\r\n\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit, without payload."""
    target = " ".join((url or "").split())
    name = f"<urn:page:{page_id}>" if refers_to is None else f"<urn:page:{page_id}:revisit>"
    block = b"" if refers_to is not None else payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Target-URI", target),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a WARC record does not begin here")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, each byte inflated once, CHUNK at a time."""
    unpack = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield unpack.decompress(chunk, CHUNK)
            chunk = unpack.unconsumed_tail
            if unpack.eof:
                chunk = unpack.unused_data
                unpack = zlib.decompressobj(31)
    yield unpack.flush()


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of an inflated stream; holds one record at a time."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        for part in stream:
            if part:
                if at:
                    del held[:at]
                    at = 0
                held += part
                return True
        return False

    while True:
        seen = 0
        while (cut := held.find(END, at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                if bytes(held[at:]).strip():
                    raise ValueError("the archive ends inside a record")
                return
        fields = parse_head(bytes(held[at:cut]))
        size = cut - at + 4 + int(fields["content-length"]) + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[at : at + size])
        at += size


def normalise(chunks: Iterator[bytes], index: list[str]) -> Iterator[bytes]:
    """Members of the records of a gzip stream; adds a line a record to index."""
    offset = 0
    for fields, whole in records(inflate(chunks)):
        member = gzip.compress(whole, LEVEL, mtime=0)
        index.append(f"{offset}\t{len(member)}\t{fields.get('warc-record-id', '')}")
        offset += len(member)
        yield member


def read_chunks(system, path: str) -> Iterator[bytes]:
    with system.open_input_stream(path, compression=None) as f:
        while chunk := f.read(CHUNK):
            yield chunk


def row_of(whole: bytes) -> tuple:
    """What a record says of its page; a response's digest comes from the payload that was read."""
    cut = whole.index(END)
    fields = parse_head(whole[:cut])
    page = int(fields["x-page-id"]) if fields.get("x-page-id") else None
    if fields["warc-type"] == "revisit":
        return page, int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), "revisit", int(fields["x-refers-to-page"])
    payload = whole[cut + 4 : cut + 4 + int(fields["content-length"])]
    return page, len(payload), digest(payload), "response", None


# ---- over tables --------------------------------------------------------------


def choose_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of least_bytes or more the smallest page_id is the response.

    Digests are grouped and joined in small rows, so a hot digest moves no html;
    the html moves once, by page_id.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(F.encode(payload, "UTF-8")).alias("_d"))
    marks = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "_d")
    first = marks.groupBy("_d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_copies")).filter("_copies > 1").drop("_copies")
    again = marks.join(first, "_d").filter("refers_to < page_id").distinct()
    return rows.join(again, ["page_id", "_d"], "left").select("page_id", "url", "html", "refers_to")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of one gzip stream each; returns archive, n_records (lazily)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_folder(folder)
        part, made = TaskContext.get().partitionId(), []

        def rows():
            for batch in it:
                for at in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)

        source, last = rows(), [None]

        def stream():
            pack, held = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
            for page_id, url, html, refers_to in source:
                payload = html.encode("utf-8", "replace")
                yield pack.compress(record(page_id, url, payload, refers_to))
                last[0] += 1
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    break
            yield pack.flush()

        while True:
            last[0] = 0
            name = f"pages-{part:06d}-{len(made):05d}.warc.gz"
            first = next(source, None)
            if first is None:
                break
            source = _chain(first, source)
            storage.put_file(system, f"{root}/{name}", stream())
            made.append((name, last[0]))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "n_records"])

    return pages.mapInArrow(batches, "archive string, n_records long")


def _chain(first, rest):
    yield first
    yield from rest


def normalise_archives(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrites each archive in folder to target, record by record, with an index beside it; returns archive, n_records."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_folder(folder)
        out_system, out_root = storage.open_folder(target)
        for batch in it:
            for name in batch.column(0).to_pylist():
                index: list[str] = []
                storage.put_file(out_system, f"{out_root}/{name}", normalise(read_chunks(system, f"{root}/{name}"), index))
                storage.put_file(out_system, f"{out_root}/{name}.idx", [("\n".join(index) + "\n").encode()])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], ["archive", "n_records"])

    return archives.select("archive").mapInArrow(batches, "archive string, n_records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row a record of normalised archives, each read by its place in the index."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_folder(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in it:
            for name in batch.column(0).to_pylist():
                lines = b"".join(read_chunks(system, f"{root}/{name}.idx")).decode().splitlines()
                with system.open_input_file(f"{root}/{name}") as f:
                    for i in range(0, len(lines), 1000):
                        rows = []
                        for line in lines[i : i + 1000]:
                            offset, size, _ = line.split("\t", 2)
                            f.seek(int(offset))
                            rows.append(row_of(gzip.decompress(f.read(int(size)))))
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    return archives.select("archive").mapInArrow(batches, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as archives, normalises them, reads them back; the monolithic files go when they are rewritten."""
    spark: SparkSession = pages.sparkSession
    folder = folder or storage.new_path(spark, "warc")
    parts = storage.shuffle_partitions(spark)
    mono = storage.materialise(write_monolithic(choose_types(pages), f"{folder}/monolithic"), "warc-list")
    done = storage.materialise(normalise_archives(mono.repartition(parts, "archive"), f"{folder}/monolithic", f"{folder}/records"), "warc-list")
    storage.drop_path(spark, f"{folder}/monolithic")
    return read_archives(done.repartition(parts, "archive"), f"{folder}/records")
