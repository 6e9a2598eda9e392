"""Document fingerprints: one-permutation MinHash, densified, packed. Built-in functions only.

Each shingle of SHINGLE words is hashed once. The high bits of the hash choose one
of BINS bins, which keeps its smallest hash. An empty bin borrows the value of the
first filled bin in its own fixed pseudo-random order of all bins (optimal
densification: each empty bin draws anew, independent of its neighbours). The
fingerprint is the low BITS bits of each bin in hexadecimal. Two bins agree by
chance in 2^-BITS of the cases, which the likeness takes out.

Words are runs of anything but \\x20 and \\x09-\\x0D, A-Z in lower case. Defined cases: a
text of fewer words than SHINGLE has one shingle, all its words; a text without
words, or null, has a fingerprint of zeros; equal fingerprints have likeness 1;
texts are read whole; rows of equal doc_id follow one another by text; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescope.llm.hashes import folded, with_runs

SHINGLE, BINS, BITS = 5, 128, 8


def _ranks(bins: int) -> list[int]:
    """For bin b at b * bins + p: which place bin p has in the order, from a fixed linear generator, in which b asks the others."""
    out, state = [0] * (bins * bins), 0x2545F491
    for b in range(bins):
        order = [i for i in range(bins) if i != b]
        for i in range(len(order) - 1, 0, -1):
            state = (state * 1103515245 + 12345) & 0x7FFFFFFF
            j = (state >> 8) % (i + 1)
            order[i], order[j] = order[j], order[i]
        for rank, p in enumerate(order):
            out[b * bins + p] = rank
    return out


def _words(text: Column) -> Column:
    bare = F.btrim(folded(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of the text column."""
    shift = 64 - BINS.bit_length() + 1
    df = df.withColumn("_w", _words(F.col(text)))
    df = with_runs(df, "_w", SHINGLE, "_h")
    df = df.withColumn("_h", F.when(F.size("_h") > 0, F.col("_h")).when(F.size("_w") > 0, F.array(F.xxhash64("_w")))).drop("_w")
    # Smallest hash of each bin: with all hashes and the largest value of each bin sorted, the first of each bin.
    # Bins follow the signed order of hashes; where the largest value is the first, the bin is empty.
    ends = [((b - BINS // 2 + 1) << shift) - 1 for b in range(BINS)]
    df = df.withColumn("_h", F.sort_array(F.concat("_h", F.lit(ends))))
    df = df.withColumn("_h", F.filter("_h", lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get("_h", i - 1), shift))))
    largest = F.lit((1 << shift) - 1)
    empty = lambda h: h.bitwiseAND(largest) == largest
    filled = F.filter(F.transform("_h", lambda h, i: F.struct(i.alias("p"), h.alias("h"))), lambda x: ~empty(x["h"]))
    df = df.withColumn("_f", filled)
    ranks = F.lit(_ranks(BINS))
    donor = lambda b: F.array_min(F.transform("_f", lambda x: F.struct(F.get(ranks, b * BINS + x["p"]).alias("r"), x["h"].alias("h"))))["h"]
    dense = F.when(F.size("_f") == BINS, F.col("_h")).otherwise(F.transform("_h", lambda h, b: F.when(empty(h), donor(b)).otherwise(h)))
    low = F.lit([f"{v:0{BITS // 4}x}" for v in range(1 << BITS)])
    packed = F.array_join(F.transform(dense, lambda h: F.get(low, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))), "")
    return df.withColumn(out, F.coalesce(packed, F.lit("0" * (BINS * BITS // 4)))).drop("_h", "_f")


def likeness(left: Column, right: Column) -> Column:
    """Estimate of the Jaccard similarity of two fingerprints, without the bins that agree by chance; 0 to 1."""
    chance = 2.0**-BITS
    bins = lambda x: F.regexp_extract_all(x, F.lit(f"({'.' * (BITS // 4)})"), F.lit(1))
    same = F.size(F.filter(F.zip_with(bins(left), bins(right), lambda a, b: a == b), lambda x: x))
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))


def _apart(n: int) -> list[int]:
    """n numbers that repartition(n, number) sends to n partitions, one each."""
    found: dict[int, int] = {}
    for i in range(1_000_000):
        found.setdefault(_murmur3(i) % n, i)
        if len(found) == n:
            break
    return [found[i] for i in sorted(found)]


def _murmur3(value: int, seed: int = 42) -> int:
    """Hash by which Spark deals an int, as a signed number."""
    mask, rotate = 0xFFFFFFFF, lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    k = rotate(value * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h = (rotate(seed ^ k, 13) * 5 + 0xE6546B64) & mask
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def with_next(docs: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Adds next_<column>: the value of the next row in ascending doc_id, after the last the first.

    Rows are dealt by range of doc_id, with bounds from quantiles, so that a window
    runs within each range. Of each range the rows with its first doc_id go as
    guests to the end of the range before it, so its last row finds them too: one
    shuffle, and `parts` ids on the driver.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = docs.select(F.percentile_approx(key, F.lit([i / parts for i in range(1, parts)]), 10_000).alias("b")).first()["b"] if parts > 1 else None
    bounds = sorted(set(bounds or []))
    span = F.size(F.filter(F.lit(bounds), lambda b: b <= key)) if bounds else F.lit(0)
    firsts = docs.groupBy(span.alias("s")).agg(F.min(key).alias("k")).orderBy("s").collect()
    rows = docs.withColumn("_span", span).withColumn("_guest", F.lit(False))
    if firsts:
        before = {r["k"]: firsts[i - 1]["s"] for i, r in enumerate(firsts)}
        to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), key)
        rows = rows.unionByName(docs.filter(key.isin(list(before))).withColumn("_span", to).withColumn("_guest", F.lit(True)))
    # A range a task: hashes of the ranges' numbers would fall together, so each has a number whose hash is its own.
    keys = _apart(len(bounds) + 1)
    rows = rows.withColumn("_span", F.element_at(F.lit(keys), F.col("_span") + 1)).repartition(len(keys), "_span")
    inside = Window.partitionBy("_span").orderBy("_guest", F.col("doc_id").asc_nulls_first(), *[F.col(c) for c in columns])
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(inside))
    return rows.filter(~F.col("_guest")).drop("_span", "_guest")


def fingerprints(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, n_chars, the edited text's digest, both fingerprints, both likenesses."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(own, "text", "fingerprint"), ["text", "fingerprint"], parts)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
