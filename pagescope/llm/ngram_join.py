"""N-gram Jaccard join over prefix trees, and its groups of linked documents.

A document's set holds its distinct k-word shingles as 64-bit hashes (A-Z in lower
case, words are runs of anything but \\x20 and \\x09-\\x0D); with fewer words, the
whole sequence as one. Documents of equal sets form a class; classes link when
100 * intersection >= percent * union.

1. Every class sends its hashes to hash buckets, which count the classes of each
   (packed arrays: a hash costs about its 8 bytes). Hashes of a single class link
   nothing and go no further; the others return with a rank by frequency.
2. In the global order (rare first) the first n - ceil(percent * n) + 1 hashes of a
   set of n are its prefix: linked sets share a prefix hash. A class whose prefix
   holds single hashes only is done. Components over shared prefix hashes are
   families; no link leaves its family.
3. Each family's sets stand in a trie by global order. All sets descend it at once,
   with one running overlap for each and shared prefixes counted once; a set leaves
   a subtree when overlap plus what remains on either side cannot reach the bound.
   A family is split in bands of set sizes, each of which spans the ratio that linked
   sets may have, so that a set meets its own band and the next one only; a band beyond
   FAMILY_SETS sets or FAMILY_HASHES hashes is split in blocks, and each pair of blocks
   that may link is a task. Only links that join two components so far leave a task,
   so n sets send n - 1 links at most, never their pairs.
4. Components of those links are the groups.

Defined cases: a null text, or one without words, has an empty set and links with
nothing; texts are read whole; repeated rows of one doc_id are copies of one
another or two texts of one name, both fine; an empty table gives no rows; a null
doc_id is kept, linked as others are, but never the name of a component unless
alone; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescope.llm import packed, storage
from pagescope.llm.components import connected_components
from pagescope.llm.words import mix, ngrams, split_words, text_slices

#: A family with more sets or hashes is split in blocks of at most so many.
FAMILY_SETS, FAMILY_HASHES = 500, 400_000
#: Classes that a task remembers to have sent; beyond, copies may be sent again. Bounds memory only.
REMEMBERED = 1 << 20


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, buf, offsets in text_slices(texts):
        words = split_words(buf, offsets, fold_case=True)
        grams, whole = ngrams(words, k)
        first = words.first.tolist()
        for s, e in zip(first[:-1], first[1:], strict=True):
            if e - s >= k:
                yield np.unique(grams[s:e][whole[s:e]])
            elif e > s:
                own = np.uint64(e - s)
                for h in words.hashes[s:e]:
                    own = mix(np.array([own], np.uint64) + h)[0]
                yield np.array([own], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def class_of(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text: equal rows have equal keys."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def signatures(docs: DataFrame, k: int, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set); row, the key, if keyed."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs).alias("row")) if keyed else _slim(docs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, names = [], []
            for h in shingle_sets(batch.column(1), k):
                n.append(len(h))
                names.append(class_of(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), *batch.columns[2:]], ["doc_id", "n_shingles", "class", *batch.schema.names[2:]])

    return slim.mapInArrow(batches, "doc_id long, n_shingles long, class long" + (", row long" if keyed else ""))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_SETS = {"hash": "<u8", "name": "<i8", "count": "<u4"}
_SHARED = {"hash": "<u8", "rank": "<u1", "name": "<i8", "count": "<u4", "n": "<u4"}


def _send_runs(bucket: np.ndarray, name: np.ndarray, arrays: dict[str, np.ndarray], extra: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of packed arrays in which names of consecutive entries are told once, with how many they have."""
    order = np.lexsort((name, bucket))
    b, c = bucket[order], name[order]
    cuts = np.flatnonzero(np.diff(b, prepend=-1))
    ends = np.append(cuts[1:], len(b)).tolist()
    change = np.flatnonzero((np.diff(b, prepend=-1) != 0) | np.append(True, c[1:] != c[:-1]))
    count = np.diff(np.append(change, len(b))).astype("<u4")
    at = np.searchsorted(change, np.append(cuts, len(b))).tolist()
    runs = c[change].astype("<i8")
    sorted_arrays = {k: np.ascontiguousarray(v[order]) for k, v in arrays.items()}
    rows = range(len(cuts))
    columns = [pa.array(b[cuts], pa.int32())]
    columns += [pa.array([v[cuts[i] : ends[i]].tobytes() for i in rows], pa.binary()) for v in sorted_arrays.values()]
    columns += [pa.array([runs[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([count[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())]
    names = ["bucket", *arrays, "name", "count"]
    for k in extra or {}:
        columns.append(pa.array([b""] * len(cuts), pa.binary()))
        names.append(k)
    return pa.RecordBatch.from_arrays(columns, names)


def _send_sets(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """The hashes of each class to the buckets of the hashes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size, seen = [], [], 0, set()

        def flush():
            nonlocal size
            if held:
                hashes = np.concatenate(held)
                owner = np.repeat(np.array(names, np.int64), [len(h) for h in held])
                yield _send_runs(packed.bucket_of(hashes, buckets), owner, {"hash": hashes})
            held.clear()
            names.clear()
            size = 0

        for batch in it:
            for h in shingle_sets(batch.column(1), k):
                if len(h):
                    name = class_of(h)
                    if name not in seen:
                        seen.add(name)
                        held.append(h)
                        names.append(name)
                        size += len(h)
                        if size >= packed.HELD:
                            yield from flush()
                if len(seen) > REMEMBERED:
                    seen.clear()
        yield from flush()

    return _slim(docs).mapInArrow(batches, packed.schema(["hash", "name", "count"]))


def _class_bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return packed.bucket_of(mix(names.view(np.uint64)), buckets)


def _shared_hashes(buckets: int):
    """Of a bucket: the hashes of two classes or more, with a rank by frequency, to the buckets of their classes."""

    def work(_, a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, owner = a["hash"], np.repeat(a["name"], a["count"])
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[:-1] |= again[1:]
        hashes, owner = hashes[again], owner[again]
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        if not len(hashes):
            return
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
        hashes, owner = hashes[new], owner[new]
        begins, ends = packed.runs(hashes)
        size = ends - begins
        rank = np.repeat(np.minimum(255, 8 * np.log2(size)).astype(np.uint8), size)
        keep = np.repeat(size > 1, size)
        hashes, owner, rank = hashes[keep], owner[keep], rank[keep]
        for i in range(0, len(hashes), packed.HELD):
            part = slice(i, i + packed.HELD)
            yield _send_runs(_class_bucket(owner[part], buckets), owner[part], {"hash": hashes[part], "rank": rank[part]}, {"n": None})

    return work


def _sizes(signed: DataFrame, buckets: int) -> DataFrame:
    """The size of each class, to its bucket, in the form of _shared_hashes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("<u4")
            if len(names):
                sent = packed.send(_class_bucket(names, buckets), {"name": names, "count": np.zeros(len(names), "<u4"), "n": n})
                none = pa.array([b""] * sent.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([sent.column(0), none, none, *sent.columns[1:]], ["bucket", "hash", "rank", "name", "count", "n"])

    classes = signed.filter("class IS NOT NULL").groupBy("class").agg(F.max("n_shingles").alias("n"))
    return classes.mapInArrow(batches, packed.schema(list(_SHARED)))


def _candidates(percent: int):
    """Of a bucket of classes: those that may link, with the hashes they share and those of their prefix."""

    def work(_, a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        told = a["count"] == 0
        names, n = a["name"][told], a["n"].astype(np.int64)
        order = np.argsort(names)
        names, n = names[order], n[order]
        owner = np.repeat(a["name"], a["count"])
        order = np.lexsort((a["hash"], a["rank"], owner))
        owner, hashes = owner[order], a["hash"][order]
        begins, ends = packed.runs(owner)
        size = n[np.searchsorted(names, owner[begins])] if len(begins) else begins
        need = -(-percent * size // 100)
        prefix = (size - need + 1) - (size - (ends - begins))  # its single hashes come first
        good = np.flatnonzero(prefix > 0)
        for i in range(0, len(good), 1000):
            g = good[i : i + 1000].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[begins[g]]), pa.array(size[g], pa.int64()), pa.array(ends[g] - begins[g], pa.int64()), pa.array([hashes[begins[x] : ends[x]].tobytes() for x in g], pa.binary()), pa.array(prefix[g], pa.int64())],
                ["class", "n", "m", "hashes", "prefix"],
            )

    return work


def _prefix_links(candidates: DataFrame, buckets: int) -> DataFrame:
    """a, b: classes that share a prefix hash, as links to the smallest class of each hash."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = [np.frombuffer(h, "<u8", p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            if parts:
                hashes = np.concatenate(parts)
                yield packed.send(packed.bucket_of(hashes, buckets), {"hash": hashes, "name": np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts])})

    def work(_, a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((a["name"], a["hash"]))
        hashes, names = a["hash"][order], a["name"][order]
        begins, ends = packed.runs(hashes)
        least = np.repeat(names[begins], ends - begins)
        pairs = np.unique(np.stack([least, names])[:, least != names], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    sent = candidates.select("class", "hashes", "prefix").mapInArrow(send, packed.schema(["hash", "name"]))
    return packed.each_bucket(sent, buckets, {"hash": "<u8", "name": "<i8"}, work, "a long, b long").distinct()


# ---- one family, or one pair of its blocks ------------------------------------


class _Trie:
    """Sets in lexicographic order of their ranks: the leaves of a trie, with the depth that each shares with the next."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.common = []
        for x, y in zip(self.sets, self.sets[1:], strict=False):
            k = min(len(x), len(y))
            differ = np.flatnonzero(x[:k] != y[:k])
            self.common.append(int(differ[0]) if len(differ) else k)
        self.common.append(0)


def family_links(names: np.ndarray, n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components, as pairs of names. side 0 and 1: only sets of different sides meet; all 0: all meet."""
    total = len(sets)
    flat = np.concatenate(sets)
    _, token, counts = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(counts), np.int64)
    place[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))  # rare first
    singles = int((counts == 1).sum())
    owner = np.repeat(np.arange(total), [len(s) for s in sets])
    rank = place[token]
    both = rank >= singles  # a hash of one set here adds to no overlap
    rank, owner = rank[both] - singles, owner[both]
    width = max(1, len(counts) - singles)
    order = np.lexsort((rank, owner))
    rank, owner = rank[order], owner[order]
    first = np.searchsorted(owner, np.arange(total + 1))
    ranks = [rank[first[i] : first[i + 1]] for i in range(total)]
    two_sides = bool(side.any())
    asked = np.flatnonzero(side == 1) if two_sides else np.arange(total)
    leaves = np.flatnonzero(side == 0)
    # Which asked sets hold each rank.
    mask = np.zeros(total, bool)
    mask[asked] = True
    number = np.full(total, -1)
    number[asked] = np.arange(len(asked))
    sel = mask[owner]
    by_rank = np.argsort(rank[sel], kind="stable")
    holders = number[owner[sel][by_rank]].astype(np.int32)
    start = np.searchsorted(rank[sel][by_rank], np.arange(width + 1))
    keys = number[owner[sel]] * width + rank[sel]
    key_first = np.searchsorted(keys, np.arange(len(asked) + 1) * width)
    asked_size, asked_n = np.diff(key_first), n[asked]
    trie = _Trie([ranks[i] for i in leaves])
    leaf_of = leaves[trie.order]
    common = np.array(trie.common)
    sizes = np.array([len(s) for s in trie.sets])
    component = np.arange(total)
    links: list[tuple[int, int]] = []

    def descend(state, tokens, least_n, most_left):
        """Adds tokens to the overlaps; drops asked sets that cannot reach the bound with a leaf below."""
        active, overlap = state
        at, step = 0, 16
        while at < len(tokens) and len(active):
            part = tokens[at : at + step]
            at += len(part)
            step *= 2
            span = start[part + 1] - start[part]
            spots = np.arange(int(span.sum())) + np.repeat(start[part] - (np.cumsum(span) - span), span)
            overlap = overlap + np.bincount(holders[spots], minlength=len(asked))[active]
            left = key_first[active] + asked_size[active] - np.searchsorted(keys, active * width + part[-1], side="right")
            reach = overlap + np.minimum(left, most_left + len(tokens) - at)
            able = reach * (100 + percent) >= percent * (asked_n[active] + least_n)
            if not able.all():
                active, overlap = active[able], overlap[able]
        return active, overlap

    stack = [(0, (np.arange(len(asked)), np.zeros(len(asked), np.int64)))]
    leaf_n = n[leaf_of]
    for i, tokens in enumerate(trie.sets):
        before = common[i - 1] if i else 0
        while stack[-1][0] > before:
            stack.pop()
        depth, state = stack[-1]
        marks = [before] if before > depth else []
        if common[i] > before:
            marks.append(int(common[i]))
        for mark in marks:  # a node from which later leaves branch off
            stop = i + int(np.argmax(common[i:] < mark)) + 1
            state = descend(state, tokens[depth:mark], int(leaf_n[i:stop].min()), int(sizes[i:stop].max()) - mark)
            stack.append((mark, state))
            depth = mark
        active, overlap = descend(state, tokens[depth:], int(leaf_n[i]), 0)
        me = leaf_of[i]
        linked = asked[active[overlap * (100 + percent) >= percent * (asked_n[active] + leaf_n[i])]]
        new, spot = np.unique(component[linked], return_index=True)
        for c, other in zip(new.tolist(), linked[spot].tolist(), strict=True):
            if component[me] != c:
                links.append((int(names[me]), int(names[other])))
                low, high = sorted((int(component[me]), c))
                component[component == high] = low
    return links


def _links_of_blocks(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """a, b: links of each (family, i, j)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            if len(held) > 1:
                names, n, side = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 3))
                found = family_links(names, n, [np.frombuffer(h[2], "<u8") for h in held], side, percent)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            held.clear()

        for batch in it:
            for s in range(0, batch.num_rows, 256):
                for family, i, j, *row in zip(*(c.to_pylist() for c in batch.slice(s, 256).columns), strict=True):
                    if (family, i, j) != at:
                        yield from done()
                        at = (family, i, j)
                    held.append(row)
        yield from done()

    keys = ["family", "i", "j"]  # i and j: band and block
    return rows.select(*keys, "class", "n", "hashes", "side").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(batches, "a long, b long")


def class_links(docs: DataFrame, signed: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between classes that connect each group of linked classes."""
    spark = docs.sparkSession
    buckets = storage.shuffle_partitions(spark)
    sent = _send_sets(docs, k, buckets)
    shared = packed.each_bucket(sent, buckets, _SETS, _shared_hashes(buckets), packed.schema(list(_SHARED)))
    both = shared.unionByName(_sizes(signed, buckets))
    out = T.StructType.fromDDL("class long, n long, m long, hashes binary, prefix long")
    candidates = storage.materialise(packed.each_bucket(both, buckets, _SHARED, _candidates(percent), out), "candidates")
    storage.release_shuffles(spark)
    families = connected_components(_prefix_links(candidates, buckets)).withColumnRenamed("component", "family")
    rows = candidates.join(families.withColumnRenamed("node", "class"), "class")
    # Linked sets of sizes x <= y have percent * y <= 100 * x: they lie in one band of that ratio or in two neighbouring ones.
    # The ratio is a little wider than that, so that no rounding of a logarithm puts two bands between them.
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) + 1e-6)).cast("long"))
    weight = rows.groupBy("family", "band").agg(F.count("*").alias("sets"), F.sum("m").alias("held"))
    large = (F.sum("sets") > FAMILY_SETS) | (F.sum("held") > FAMILY_HASHES)
    whole = weight.groupBy("family").agg(large.alias("large"))
    blocks = weight.join(whole.filter("large"), "family", "left_semi").select("family", "band", F.greatest(F.ceil(F.col("sets") / FAMILY_SETS), F.ceil(F.col("held") / FAMILY_HASHES)).cast("int").alias("blocks"))
    after = blocks.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("after"))
    before = blocks.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("before"))
    deal = storage.materialise(blocks.join(after, ["family", "band"], "left").join(before, ["family", "band"], "left"), "blocks")
    rows = rows.join(deal, ["family", "band"], "left")  # families within the limits are one block
    rows = rows.withColumns({"band": F.when(F.col("blocks").isNull(), 0).otherwise(F.col("band")), "blocks": F.coalesce("blocks", F.lit(1))})
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    name = lambda band, i: F.struct(band.alias("band"), i.alias("block"))
    count = lambda c: F.sequence(F.lit(0), F.coalesce(c, F.lit(0)) - 1)
    others = lambda shift, c: F.when(F.coalesce(c, F.lit(0)) > 0, F.transform(count(c), lambda i: name(F.col("band") + shift, i))).otherwise(F.expr("array()"))
    rows = rows.withColumn("own", name(F.col("band"), own)).withColumn("other", F.explode(F.concat(others(-1, F.col("before")), others(0, F.col("blocks")), others(1, F.col("after")))))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.when(F.col("own") > F.col("other"), 1).otherwise(0)})
    return _links_of_blocks(rows, percent, buckets)


def _named(docs: DataFrame, signed: DataFrame, k: int, percent: int, least: Column, name: str) -> DataFrame:
    """class and, as name, the least of the rows of all classes linked to it."""
    spark = docs.sparkSession
    with storage.scope(spark):  # candidates, families and labels are of no use once the groups are known
        groups = storage.materialise(connected_components(class_links(docs, signed, k, percent)).withColumnRenamed("node", "class"), "", storage.new_path(spark, "groups"))
    classes = signed.filter("class IS NOT NULL").groupBy("class").agg(F.min(least).alias("least"))
    classes = classes.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return classes.join(classes.groupBy("component").agg(F.min("least").alias(name)), "component").select("class", name)


def linked_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class, component_id (the smallest doc_id reachable by links, itself included)."""
    signed = storage.materialise(signatures(docs, k), "signatures")
    out = signed.join(_named(docs, signed, k, percent, F.col("doc_id"), "component_id"), "class", "left")
    return out.select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """All columns of one row of each group; rows without words stay.

    The row with the smallest doc_id stays, one without doc_id only where no other is
    in the group; of several with that doc_id the one with the smallest key, a hash of
    doc_id and text, and of equal keys the one with the smallest other columns.
    """
    signed = storage.materialise(signatures(docs, k, keyed=True), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    told = signed.join(_named(docs, signed, k, percent, first, "stays"), "class")
    away = told.filter("row <> stays.row").select(F.col("row").alias("_away")).distinct()
    equal = storage.materialise(told.filter("row = stays.row").groupBy("row").count().filter("count > 1").select(F.col("row").alias("_away")), "equal-rows")
    key = row_key(docs)
    if equal.isEmpty():
        return docs.join(away, key == away["_away"], "left_anti")
    kept = docs.join(away.unionByName(equal), key == F.col("_away"), "left_anti")
    again = docs.join(equal, key == F.col("_away")).groupBy("_away").agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*")
    return kept.unionByName(again)
