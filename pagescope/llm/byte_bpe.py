"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a pre-token that is a
token itself. Tier 2: any other pre-token is a doubly linked list of bytes whose
neighbouring pairs wait in a heap ordered by (rank, place); the best pair merges
until none is left.

Defined cases: a null text is empty; an empty text has no ids and decodes to no
bytes; texts are handled whole at any length; repeated rows give repeated rows;
an empty table gives an empty table; other columns of the input are kept, and one
named like an output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modulus of the displaced hash; far above any vocabulary's size.
PRIME = 4294967291
#: Pre-tokens that a worker remembers; then it starts anew. Bounds memory only.
REMEMBERED = 600_000
#: For texts of ASCII and Latin letters the pattern below finds the same pieces as
#: SIMPLE_FOR does, with Python's faster engine.
SIMPLE_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _BLANK = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", " \t-\r"
SIMPLE = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+").findall
SIMPLE_NOT = re.compile(f"[^\\t-\\r -~{_LETTER}]").search


class _Memo(dict):
    """A dict that computes what it lacks."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        self[key] = value = self.compute(key)
        return value



def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots, one displacement for about two keys.

    Buckets are placed by falling size; each takes the first displacement that
    sends its keys to free slots.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // 2)
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            b, x, y = self._parts(key)
            groups.setdefault(b, []).append((x, y, i))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        spare: list[int] = []
        for b, group in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(group) == 1 and not spare:
                spare = np.flatnonzero(free).tolist()
            if len(group) == 1:  # any free slot will do: solve for the displacement that leads there
                x, y, i = group[0]
                p = spare.pop()
                self.shift[b] = (p - x) * pow(y, -1, PRIME) % PRIME
                self.slot_of[p] = i
                continue
            d = 0
            while True:
                places = {(x + d * y) % PRIME % n for x, y, _ in group}
                if len(places) == len(group) and all(free[p] for p in places):
                    break
                d += 1
            for x, y, i in group:
                p = (x + d * y) % PRIME % n
                free[p], self.slot_of[p] = False, i
            self.shift[b] = d
        self._shift, self._slots = self.shift.tolist(), self.slot_of.tolist()

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFFFF, (h >> 72) % (PRIME - 1) + 1

    def candidate(self, key: bytes) -> int:
        """The only key number that key can have; the caller compares the keys."""
        b, x, y = self._parts(key)
        d = self._shift[b]
        return self._slots[(x + d * y) % PRIME % self.size]


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.whole = PerfectHash(tokens)
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.simple = pattern == SIMPLE_FOR
        self.decimal = [str(i) for i in range(len(tokens))]
        self.packed = _Memo(lambda piece: np.array(self.piece_ids(piece.encode("utf-8", "replace")), "<i4").tobytes())

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, in order."""
        return SIMPLE(text) if self.simple and not SIMPLE_NOT(text) else self.pattern.findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Tier 2: ids of bytes that are no token as a whole."""
        rank_of, n = self.ranks.get, len(piece)
        wide = n.bit_length()
        low, both = (1 << wide) - 1, 2 * wide
        end = list(range(1, n + 1))  # where the part that begins here ends; 0: merged into another
        before = list(range(-1, n - 1))
        heap = []  # rank, first byte, end byte in one number
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                heap.append(r << both | i << wide | i + 2)
        heapify(heap)
        while heap:
            best = heappop(heap)
            stop, i = best & low, best >> wide & low
            middle = end[i]
            if middle == 0 or middle >= n or end[middle] != stop:
                continue  # one of the two has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                r = rank_of(piece[i : end[stop]])
                if r is not None:
                    heappush(heap, r << both | i << wide | end[stop])
            p = before[i]
            if p >= 0:
                r = rank_of(piece[p:stop])
                if r is not None:
                    heappush(heap, r << both | p << wide | stop)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def piece_ids(self, piece: bytes) -> list[int]:
        i = self.whole.candidate(piece)
        return [i] if self.tokens[i] == piece else self.merge(piece)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.piece_ids(piece.encode("utf-8", "replace"))]

    def id_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(self.packed) > REMEMBERED:
            self.packed.clear()
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the decimal ids, digest of the bytes that the ids decode to."""
        ids = np.frombuffer(self.id_bytes(text), "<i4").tolist()
        spelled = " ".join(map(self.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each worker process; the file is small and of fixed size."""
    return ByteBpe(load_ranks(path), pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of the whole text as an array of int."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [bpe.id_bytes(t or "") for t in part.column(text).to_pylist()]
                flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                offsets = pa.array(np.cumsum([0, *map(len, packed)]) // 4, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat)], [*part.schema.names, ids])

    base = docs.drop(ids)
    return base.mapInArrow(batches, base.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode_column(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids decode to; null ids decode to no bytes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in it:
            new = pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            keep = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), new], [*keep, out])

    base = docs.drop(out)
    return base.mapInArrow(batches, base.withColumn(out, F.lit(None).cast("binary")).schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text and decodes its ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [bpe.digests(t or "") for t in part.column(1).to_pylist()]
                n, ids, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
