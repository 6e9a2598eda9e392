"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of bytes other than space and \\x09-\\x0D. The hash of a
word is a polynomial over a random 64-bit value for each byte, taken from running
sums, then mixed; equal words have equal hashes anywhere, and different ones
differ but for a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_EXACT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


_cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, 1 << max(n - 1, 1).bit_length())
    if size not in _cached:
        _cached.clear()
        _cached[size] = (_powers(_P, size), _powers(_PINV, size))
    return _cached[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of consecutive texts: hash, first byte, end byte; first[i]:first[i+1] are the words of text i."""

    __slots__ = ("ends", "first", "hashes", "starts")

    def __init__(self, hashes, starts, ends, first):
        self.hashes, self.starts, self.ends, self.first = hashes, starts, ends, first


def split_words(buf: np.ndarray, offsets: np.ndarray, fold_case: bool) -> Words:
    """buf: UTF-8 bytes; offsets: where each text begins, and the end. fold_case: A-Z count as a-z."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    letter = ~_SPACE[buf]
    left = np.empty(n, bool)
    left[0] = True
    np.logical_not(letter[:-1], out=left[1:])
    starts = np.flatnonzero(letter & (left | edge[:n]))
    right = np.empty(n, bool)
    right[-1] = True
    np.logical_not(letter[1:], out=right[:-1])
    ends = np.flatnonzero(letter & (right | edge[1:])) + 1
    powers, inverse = _tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_FOLDED if fold_case else _EXACT)[buf] * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def ngrams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of k consecutive words for each position, and which positions have k words of one text."""
    h, n = words.hashes, len(words.hashes)
    whole = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), whole
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
    out = np.zeros(n, np.uint64)
    out[: n - k + 1] = mix(acc)
    last = np.repeat(words.first[1:], np.diff(words.first))
    whole = np.arange(n) + k <= last
    return out, whole


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits an Arrow string array into (first row, end row, bytes, offsets) of about size bytes each; nulls are empty.

    A longer text makes a slice of its own.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    rows = len(texts)
    if rows == 0:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + rows + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null's bytes, if any, do not count
        texts = pa.array(["" if v is None else v for v in texts.to_pylist()], pa.large_string())
        yield from text_slices(texts, size)
        return
    at = 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end, buf[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
