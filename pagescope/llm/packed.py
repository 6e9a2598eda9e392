"""Shuffles of many small numbers as few large rows.

A task sorts what it has by bucket and sends each bucket one row of packed arrays;
whoever owns the bucket reads them back as numpy arrays. Such a row costs Spark as
little as any other, so a number costs its own bytes and a share of a sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Numbers that a task holds before it sends them.
HELD = 1 << 20


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket from the high bits of 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in names)])


def send(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that has any; arrays are as long as bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b, prepend=-1))
    ends = np.append(cuts[1:], len(b))
    columns = [pa.array(b[cuts], pa.int32())]
    for a in arrays.values():
        a = np.ascontiguousarray(a[order])
        raw, w = a.tobytes(), a.dtype.itemsize
        columns.append(pa.array([raw[w * s : w * e] for s, e in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", *arrays])


def each_bucket(df: DataFrame, buckets: int, kinds: dict[str, str], work: Callable[[int, dict[str, np.ndarray]], Iterator[pa.RecordBatch]], out: T.StructType | str) -> DataFrame:
    """Gathers the rows of each bucket and gives work(bucket, arrays); one bucket is in memory at a time."""
    names = list(kinds)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, {n: [] for n in names}

        def done():
            arrays = {n: np.frombuffer(b"".join(parts[n]), kinds[n]) for n in names}
            for n in names:
                parts[n].clear()
            return work(at, arrays)

        for batch in it:
            for row in range(batch.num_rows):
                b = batch.column(0)[row].as_py()
                if b != at:
                    if at is not None:
                        yield from done()
                    at = b
                for i, n in enumerate(names):
                    parts[n].append(batch.column(i + 1)[row].as_py())
        if at is not None:
            yield from done()

    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(batches, out)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins and ends."""
    begins = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return begins, np.append(begins[1:], len(sorted_values))
