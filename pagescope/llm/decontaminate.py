"""Benchmark decontamination by a broadcast set of normalised n-grams. Built-in functions only.

Normalised words: A-Z in lower case, maximal runs of digits, a-z and anything
beyond ASCII. A window is WINDOW consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. Every window of a training text is
hashed by combining hashes of one, two, four and eight words; the set of benchmark
hashes picks the places to verify, where the words themselves are compared.

The set goes to the executors only up to MOST_WINDOWS windows. Beyond that hashes
and places alone are shuffled and joined with the benchmark's, and only the places
that are left return to their texts for the words; the tables joined lie in the
shared folder, so that adaptive execution can split a hash that stands very often.

Defined cases: a null or empty text has no words and no hit; a null item text has
no window; equal items each count; texts are scanned whole; each row is a document
of its own, whatever its doc_id, repeated or null; empty tables give empty or clean
results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescope.llm import storage
from pagescope.llm.hashes import folded, with_runs

WINDOW, MOST_WINDOWS = 10, 100_000
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised_words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.filter(F.split(folded(F.coalesce(text.cast("string"), F.lit(""))), _APART), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, words, hash: the distinct windows of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normalised_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    spots = items.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    return spots.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("words")).distinct()


def _hash_of(windows: DataFrame, size: int) -> DataFrame:
    """The windows of that size with their hash, made as the texts' are."""
    return with_runs(windows.filter(F.col("size") == size), "words", size, "_h").select("item_id", "size", "words", F.element_at("_h", 1).alias("hash"))


def _places(size: int, own: list[int] | None) -> Column:
    """Windows of a text whose hash is among own, or all of them: size, at (from 1), hash."""
    hashes = F.col(f"_at{size}")
    if own is None:
        return F.transform(hashes, lambda h, i: F.struct(F.lit(size).alias("size"), (i + 1).alias("at"), h.alias("hash")))
    at = F.filter(F.transform(hashes, lambda h, i: F.when(h.isin(own), i + 1)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.element_at(hashes, i).alias("hash")))


def _near(found: DataFrame, hashed: DataFrame) -> DataFrame:
    """Keeps of _spots those whose hash occurs in the benchmark, by joins; rows are told by two hashes of doc_id and words."""
    keyed = found.withColumns({"_a": F.xxhash64("doc_id", "w"), "_b": F.hash("w", "doc_id")})
    own = storage.materialise(hashed.select("size", "hash").distinct(), "benchmark-hashes")
    spots = keyed.select("_a", "_b", F.explode("_spots").alias("s")).select("_a", "_b", "s.size", "s.at", "s.hash")
    near = spots.join(own, ["size", "hash"], "left_semi").groupBy("_a", "_b").agg(F.collect_set(F.struct("size", "at", "hash")).alias("_near"))
    out = keyed.drop("_spots").join(near, ["_a", "_b"], "left")
    return out.select("doc_id", "n_words", "w", F.coalesce("_near", F.array().cast("array<struct<size:int,at:int,hash:bigint>>")).alias("_spots"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array), contaminated: one row a document."""
    windows = benchmark_windows(benchmark, window)
    counts = windows.groupBy("size").agg(F.count("*").alias("n"), F.countDistinct("words").alias("d")).collect()  # at most `window` rows
    sizes = sorted(r["size"] for r in counts)
    small = sum(r["n"] for r in counts) <= MOST_WINDOWS
    texts = docs.select(F.col("doc_id"), normalised_words(F.col("text")).alias("w"))
    texts = texts.select("doc_id", F.size("w").cast("long").alias("n_words"), "w")
    if not sizes:
        return texts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))

    hashed = None
    for size in sizes:
        part = _hash_of(windows, size)
        hashed = part if hashed is None else hashed.unionByName(part)

    found = texts
    spots = []
    for size in sizes:
        found = with_runs(found, "w", size, f"_at{size}")
        own = None
        if small:  # the hashes that occur in the benchmark: a set of checked size
            own = [r["hash"] for r in hashed.filter(F.col("size") == size).select("hash").distinct().collect()]
        spots.append(_places(size, own))
    found = found.select("doc_id", "n_words", "w", F.concat(*spots).alias("_spots"))
    if not small:
        found = _near(found, hashed)
    spelled = F.transform("_spots", lambda s: F.struct(s["size"].alias("size"), s["at"].alias("at"), s["hash"].alias("hash"), F.slice(F.col("w"), s["at"], s["size"]).alias("words")))
    found = found.select("doc_id", "n_words", spelled.alias("_spots"))
    keyed = found.withColumn("_row", F.monotonically_increasing_id())
    rows = keyed.select("doc_id", "n_words", "_row", F.explode_outer("_spots").alias("s")).select("doc_id", "n_words", "_row", "s.size", "s.at", "s.hash", F.col("s.words").alias("seen"))
    bench = hashed.groupBy("size", "hash", "words").agg(F.collect_set("item_id").alias("ids"))
    bench = F.broadcast(bench) if small else storage.materialise(bench, "benchmark-windows")
    rows = rows.join(bench.select(F.col("size").alias("_s"), F.col("hash").alias("_h"), "words", "ids"), (F.col("size") == F.col("_s")) & (F.col("hash") == F.col("_h")) & (F.col("seen") == F.col("words")), "left")
    spans = rows.groupBy("_row", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("ids").isNotNull(), F.struct("at", "size"))).alias("spots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    out = spans.select("doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), "items")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def digest_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = hits(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns, that hold no benchmark window, told by a hash of doc_id and text. The dirty keys stay in a table, not on the driver."""
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    dirty = hits(docs.select(key.alias("doc_id"), "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(dirty, key == dirty["_dirty"], "left_anti")
