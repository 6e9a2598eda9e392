"""Substring dedup: long word sequences that repeat, found on a sparse de Bruijn graph.

Words are runs of anything but \\x20 and \\x09-\\x0D, unchanged. A window is `window`
consecutive words of one document. A window repeats if its words also start
anywhere else, in the same document or another.

1. Nodes are the K-word grams that are the smallest hash of some REACH grams in a
   row; an edge is the text from one node to the next of a document. Which node
   begins where depends on the words there alone, so equal windows hold equal edges,
   one at least. Every document sends its edges, as hashes in packed arrays, to
   buckets by the hash; edges that occur once leave.
2. Repeated edges compact: joins count the distinct successors and predecessors of
   each edge; where an edge has one way on and the next one way back, the two are
   one path. A document's stretch of a path is known by its edges; joins tell
   stretches that two sources share from those of one.
3. Stretches go back to their texts by a key of the row, and the words there decide.
   A shared stretch of a window or more is verified by a digest of its words. Windows
   that hang over the ends of stretches or lie in one that no other source has, and
   those of one speaker for each shared stretch, are compared one by one. The nodes
   that a window's own rows of grams choose are the same wherever its words stand, so
   a repeated window has all edges between them in one run of stretches; windows
   without are not looked at.
4. Verified spans go back to the texts; words in a span are removed.

Edges are 64-bit hashes and only choose candidates. Spans count as equal by 128-bit
digests of their words, windows by 64-bit hashes within an edge.

Defined cases: a null or empty text has no words; a text of fewer words than a
window keeps all; texts are read whole; repeated rows are copies of one another,
so their windows repeat; rows of one doc_id or of none are told apart by their
texts; an empty table gives no rows; columns other than doc_id and text are not
read. A window has from K + 1 to 65,000 words; others raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescope.llm import packed, storage
from pagescope.llm.words import _tables, mix, ngrams, split_words, text_slices

WINDOW, K = 35, 5
#: A row: 96 bits of doc_id and text.
_ROW = ["a", "b"]


def reach_of(window: int) -> int:
    """Grams in a row of which one is a node: two such rows apart fit in a window."""
    if not K < window <= 65_000:
        raise ValueError(f"a window of {window} words; from {K + 1} to 65000 are possible")
    return (window - K + 1) // 2


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the smallest of width values from there on, the first of equals."""
    n = len(h)
    best, size = np.arange(n), 1
    while size < width:
        step = min(size, width - size)
        m = len(best) - step
        left, right = best[:m], best[step : step + m]
        best = np.where(h[left] <= h[right], left, right)
        size += step
    return best


class Walk:
    """The walks of consecutive texts: words; nodes (first word, text); edges (node where it begins, hash); the node that each row of grams chooses."""

    __slots__ = ("_sums", "chooses", "edge", "inverse", "key", "node", "number", "of", "words")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int):
        self.words = words = split_words(buf, offsets, fold_case=False)
        n, reach = len(words.hashes), reach_of(window)
        sizes = np.diff(words.first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        last = words.first[owner + 1]
        grams, _ = ngrams(words, K)
        least = _leftmost_least(grams, reach) if n >= reach else np.zeros(0, np.int64)
        at = np.arange(len(least))
        self.chooses = np.flatnonzero((at + reach + K - 1 <= last[: len(least)]) & (sizes[owner[: len(least)]] >= window))
        node, of = least[self.chooses], owner[self.chooses]
        new = np.append(True, (node[1:] != node[:-1]) | (of[1:] != of[:-1])) if len(node) else np.zeros(0, bool)
        self.number = np.cumsum(new) - 1
        self.node, self.of = node[new], of[new]
        powers, self.inverse = _tables(n + 1)
        self._sums = np.empty(n + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum(words.hashes * powers[:n], out=self._sums[1:])
        self.edge = np.flatnonzero(self.of[1:] == self.of[:-1]) if len(self.of) else np.zeros(0, np.int64)
        s, e = self.node[self.edge], self.node[self.edge + 1] + K if len(self.edge) else self.edge
        self.key = self.hashes(s, e) + (e - s).astype(np.uint64)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words begin .. end."""
        return mix((self._sums[end] - self._sums[begin]) * self.inverse[begin])


# ---- 1. edges that repeat ------------------------------------------------------

_EDGES = {"key": "<u8", "a": "<i8", "b": "<i4", "first": "<u4", "size": "<u2"}


def _send_edges(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return packed.send(packed.bucket_of(arrays[0], buckets), {n: x.astype(t) for (n, t), x in zip(_EDGES.items(), arrays, strict=True)})

        for batch in it:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, _, buf, offsets in text_slices(batch.column(2)):
                walk = Walk(buf, offsets, window)
                if len(walk.edge):
                    begin, row = walk.node[walk.edge], walk.of[walk.edge]
                    held.append((walk.key, a[at + row], b[at + row], begin - walk.words.first[row], walk.node[walk.edge + 1] + K - begin))
                    size += len(begin)
                    if size >= packed.HELD // 4:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.select(*_ROW, "text").mapInArrow(batches, packed.schema(list(_EDGES)))


def _repeated_edges(_, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(x["key"], kind="stable")
    key = x["key"][order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    columns = [x["key"][order].view(np.int64), x["a"][order], x["b"][order], x["first"][order]]
    by = np.lexsort(columns[::-1])  # equal rows have equal edges: once is enough
    columns = [c[by] for c in columns]
    new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) if len(by) else np.zeros(0, bool)
    edge, a, b, first = (c[new] for c in columns)
    last = first.astype(np.int64) + x["size"][order][by][new]
    for i in range(0, len(edge), 1 << 16):
        p = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(a[p]), pa.array(b[p]), pa.array(edge[p]), pa.array(first[p].astype(np.int32)), pa.array(last[p], pa.int32())], ["a", "b", "edge", "first", "last"])


# ---- 2. compaction -------------------------------------------------------------


def compact(occurrences: DataFrame, window: int = WINDOW, folder: str | None = None) -> DataFrame:
    """a, b, edge, first, last of repeated edges -> a, b, run, path, first, last, shared, speaks: a row for each stretch of a nonbranching path.

    Stretches of a run follow one another; path is a hash of the stretch's edges;
    shared: another source has the same stretch, of a window or more; speaks: the
    first of them. Joins are between tables in the folder, so that adaptive execution
    can split an edge or a path that stands in very many documents.
    """
    spark = occurrences.sparkSession
    folder = folder or storage.new_path(spark, "compaction")
    order = Window.partitionBy(*_ROW).orderBy("first")
    follows = F.lead("first").over(order) == F.col("last") - K
    steps = storage.materialise(occurrences.withColumn("next", F.when(follows, F.lead("edge").over(order))), "", f"{folder}/linked")
    ways = steps.filter("next IS NOT NULL").select("edge", "next").distinct()
    on = ways.groupBy("edge").agg(F.count("*").alias("ways"), F.min("next").alias("next")).filter("ways = 1")
    back = ways.groupBy("next").agg(F.count("*").alias("ways")).filter("ways = 1").select("next")
    plain = storage.materialise(on.join(back, "next", "left_semi").select(F.col("edge").alias("_e"), F.col("next").alias("_n")), "", f"{folder}/plain")
    joined = steps.join(plain, (F.col("edge") == F.col("_e")) & (F.col("next") == F.col("_n")), "left")
    before = F.lag(F.struct("next", F.col("_n").isNotNull().alias("plain"))).over(order)
    marks = joined.select(*_ROW, "edge", "first", "last", F.coalesce(before["next"].isNull(), F.lit(True)).cast("int").alias("new_run"), (~F.coalesce(before["plain"], F.lit(False))).cast("int").alias("new_path"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marks.select(*_ROW, "edge", "first", "last", F.sum("new_run").over(upto).cast("int").alias("run"), F.sum("new_path").over(upto).alias("stretch"))
    edges = F.transform(F.array_sort(F.collect_list(F.struct("first", "edge"))), lambda x: x["edge"])
    stretches = runs.groupBy(*_ROW, "run", "stretch").agg(F.xxhash64(edges).alias("path"), F.min("first").alias("first"), F.max("last").alias("last")).drop("stretch")
    stretches = storage.materialise(stretches, "", f"{folder}/stretches")
    long = F.col("last") - F.col("first") >= window
    place = F.struct(*_ROW, "first")
    shared = stretches.filter(long).groupBy("path").agg(F.count("*").alias("n"), F.min(place).alias("_s")).filter("n > 1").select(F.col("path").alias("_p"), "_s")
    shared = storage.materialise(shared, "", f"{folder}/shared")
    out = stretches.join(shared, (F.col("path") == F.col("_p")) & long, "left")
    return out.withColumns({"shared": F.col("_p").isNotNull(), "speaks": F.coalesce(F.col("_s") == place, F.lit(False))}).drop("_p", "_s")


# ---- 3. words decide -------------------------------------------------------------

_SPANS = {"key": "<u8", "a": "<i8", "b": "<i4", "first": "<u4", "count": "<u2", "size": "<u4"}


def candidates(walk: Walk, raw: bytes, row: np.ndarray, first: np.ndarray, last: np.ndarray, run: np.ndarray, shared: np.ndarray, speaks: np.ndarray, window: int):
    """What the words of stretches say: (key, text, first word, windows, words of each) of groups, and a value for each window.

    Stretches are in order of text and place. A shared stretch is one group of one
    value, a digest of its words; windows with all their edges in one run come in
    groups by the edge that they choose.
    """
    words = walk.words
    lo, hi = words.first[row] + first, words.first[row] + last
    new = np.append(True, (row[1:] != row[:-1]) | (run[1:] != run[:-1]))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    left, right = (np.minimum(np.searchsorted(walk.node, x), len(walk.node) - 1) for x in (lo[head], hi[tail] - K))
    of_edge = np.zeros(len(walk.node) + 1, np.int64)  # the run of the edge that begins at a node, 0 for none
    np.add.at(of_edge, left, np.arange(1, len(head) + 1))
    np.add.at(of_edge, right, -np.arange(1, len(head) + 1))
    of_edge = np.cumsum(of_edge)
    change = np.cumsum(np.append(0, of_edge[1:] != of_edge[:-1]))
    rank = np.flatnonzero(walk.chooses + window <= words.first[walk.of[walk.number] + 1]) if len(walk.chooses) else np.zeros(0, np.int64)
    begin, end = walk.number[rank], walk.number[rank + window - K + 1 - reach_of(window)] - 1  # first and last edge that the window's rows choose
    rank = rank[(of_edge[begin] > 0) & (change[begin] == change[end])]
    inside = np.zeros(len(words.hashes) + 2, np.int64)
    whole = np.flatnonzero(shared)
    silent = np.flatnonzero(shared & ~speaks)
    np.add.at(inside, lo[silent], 1)
    np.add.at(inside, hi[silent] - window + 1, -1)
    rank = rank[np.cumsum(inside)[walk.chooses[rank]] == 0]
    at, number = walk.chooses[rank], walk.number[rank]
    digests = np.zeros((len(whole), 2), "<u8")
    for i, w in enumerate(whole.tolist()):
        part = b" ".join(raw[words.starts[lo[w]] : words.ends[hi[w] - 1]].split())
        digests[i] = np.frombuffer(hashlib.blake2b(part, digest_size=16).digest(), "<u8")
    new = np.append(True, (number[1:] != number[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    cut = np.flatnonzero(new)
    count = np.diff(np.append(cut, len(at)))
    edge = np.searchsorted(walk.edge, number[cut])
    owner = walk.of[number[cut]]
    groups = (
        np.concatenate([digests[:, 0], walk.key[edge]]), np.concatenate([row[whole], owner]), np.concatenate([first[whole], at[cut] - words.first[owner]]),
        np.concatenate([np.ones(len(whole), np.int64), count]), np.concatenate([(hi - lo)[whole], np.full(len(cut), window)]),
    )
    return groups, np.concatenate([digests[:, 1], walk.hashes(at, at + window)])


def _send_spans(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """rows: a, b, text, stretches (in order of place)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            *one, value = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            one = {n: x.astype(t) for (n, t), x in zip(_SPANS.items(), one, strict=True)}
            count = one["count"].astype(np.int64)
            bucket = packed.bucket_of(one["key"], buckets)
            order = np.argsort(bucket, kind="stable")
            upto, span = np.cumsum(count) - count, count[order]
            spots = np.arange(int(span.sum())) + np.repeat(upto[order] - (np.cumsum(span) - span), span)
            b, value = bucket[order], value[spots].astype("<u8")
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(cuts[1:], len(b))
            upto = np.append(0, np.cumsum(span))
            columns = [pa.array(b[cuts], pa.int32())]
            columns += [pa.array([x[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary()) for x in (v[order] for v in one.values())]
            columns.append(pa.array([value[upto[s] : upto[e]].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["bucket", *_SPANS, "value"])

        for batch in it:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            place, flat = lists.offsets.to_numpy(), lists.values
            first, last, run, shared, speaks = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("first", "last", "run", "shared", "speaks"))
            for at, end, buf, offsets in text_slices(batch.column(2)):
                p = slice(place[at], place[end])
                if place[at] == place[end]:
                    continue
                row = np.repeat(np.arange(end - at), np.diff(place[at : end + 1]))
                walk = Walk(buf, offsets, window)
                groups, value = candidates(walk, buf.tobytes(), row, first[p].astype(np.int64), last[p].astype(np.int64), run[p], shared[p], speaks[p], window)
                key, owner, *rest = groups
                if len(key):
                    held.append((key, a[at + owner], b[at + owner], *rest, value))
                    size += len(value) + 4 * len(key)
                if size >= packed.HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.mapInArrow(batches, packed.schema([*_SPANS, "value"]))


def _repeated_spans(_, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of the windows and digests of a bucket those that occur twice or more; neighbours of an edge as one span."""
    order = np.argsort(x["key"], kind="stable")
    key = x["key"][order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    again[:-1] |= again[1:]
    order, key = order[again], key[again]
    if not len(order):
        return
    count = x["count"].astype(np.int64)
    begin = (np.cumsum(count) - count)[order]
    count = count[order]
    offset = np.cumsum(count) - count
    spots = np.arange(int(count.sum())) + np.repeat(begin - offset, count)
    group = np.repeat(np.cumsum(np.append(True, key[1:] != key[:-1])) - 1, count)
    value = x["value"][spots]
    by = np.lexsort((value, group))
    g, v = group[by], value[by]
    same = np.append(False, (g[1:] == g[:-1]) & (v[1:] == v[:-1]))
    same[:-1] |= same[1:]
    repeats = np.zeros(len(by), bool)
    repeats[by] = same
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - offset[owner] + x["first"][order][owner].astype(np.int64)
    hit = np.flatnonzero(repeats)
    if not len(hit):
        return
    new = np.append(True, (owner[hit][1:] != owner[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1))
    cut = np.flatnonzero(new)
    stop = np.append(cut[1:], len(hit)) - 1
    e = owner[hit][cut]
    first, last = place[hit][cut], place[hit][stop] + x["size"][order][e]
    for i in range(0, len(e), 1 << 16):
        p = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x["a"][order][e[p]]), pa.array(x["b"][order][e[p]]), pa.array(first[p], pa.int32()), pa.array(last[p], pa.int32())], ["a", "b", "first", "last"])


# ---- all -------------------------------------------------------------------------


def with_row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, a, b: equal rows have equal keys."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.withColumns({"a": F.xxhash64("doc_id", "text"), "b": F.hash("text", "doc_id")})


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, b, first, last: word spans of texts all of whose words are covered by repeated windows."""
    spark = docs.sparkSession
    reach_of(window)
    buckets = storage.shuffle_partitions(spark)
    texts = with_row_keys(docs)
    paths = [storage.new_path(spark, name) for name in ("repeated-edges", "compaction", "stretches")]
    found = packed.each_bucket(_send_edges(texts, window, buckets), buckets, _EDGES, _repeated_edges, "a long, b int, edge long, first int, last int")
    found = storage.materialise(found, "", paths[0])
    storage.release_shuffles(spark)
    stretches = compact(found, window, paths[1]).groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("first", "last", "run", "shared", "speaks"))).alias("stretches"))
    stretches = storage.materialise(stretches, "", paths[2])
    storage.release_shuffles(spark)
    rows = texts.join(stretches, _ROW).select(*_ROW, "text", "stretches")
    spans = packed.each_bucket(_send_spans(rows, window, buckets), buckets, {**_SPANS, "value": "<u8"}, _repeated_spans, "a long, b int, first int, last int")
    spans = storage.materialise(spans, "repeated-spans")
    for path in paths:  # nothing reads them any more
        storage.drop_path(spark, path)
    storage.release_shuffles(spark)
    return spans


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space)."""
    return _remove(docs, window, "kept string", lambda kept: kept.decode("utf-8", "replace"))


def digest_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return _remove(docs, window, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _remove(docs: DataFrame, window: int, last: str, finish) -> DataFrame:
    spans = repeated_spans(docs, window).groupBy(*_ROW).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = spans.select(*_ROW, F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts"))
    rows = with_row_keys(docs).join(spans, _ROW, "left").select("doc_id", "text", "firsts", "lasts")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                n, gone, out = [], [], []
                for text, firsts, lasts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "replace").split()
                    n.append(len(words))
                    if firsts:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, firsts, 1)
                        np.add.at(change, lasts, -1)
                        keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                        gone.append(len(words) - len(keep))
                        words = [words[i] for i in keep.tolist()]
                    else:
                        gone.append(0)
                    out.append(finish(b" ".join(words)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", last.split()[0]])

    return rows.mapInArrow(batches, f"doc_id long, n_words long, n_removed long, {last}")
