"""Hashes of runs of words, as column expressions of built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; for a text of ASCII alone that is its lower case, which is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def joined(left: Column, right: Column, gap: int) -> Column:
    """Hash of left[i] and right[i + gap]; the last entries, which lack the right one, have no meaning."""
    return F.zip_with(left, F.slice(right, F.lit(gap + 1), F.size(right)), lambda a, b: F.xxhash64(a, b))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def run_plan(k: int) -> list[tuple[str, str, int, str]]:
    """Steps (left, right, gap, name) that make hashes of k words from hashes of one: powers of two, then their sums."""
    steps, size = [], 1
    while size * 2 <= k:
        steps.append((f"h{size}", f"h{size}", size, f"h{size * 2}"))
        size *= 2
    have, rest = size, k - size
    while rest:
        part = 1 << (rest.bit_length() - 1)
        steps.append((f"h{have}", f"h{part}", have, f"h{have + part}"))
        have, rest = have + part, rest - part
    return steps


def with_runs(df, words: str, k: int, out: str, drop_words: bool = False):
    """Adds the array of hashes of k consecutive words of the array column words."""
    mark = "_run_"
    df = df.withColumn(f"{mark}h1", word_hashes(F.col(words)))
    for left, right, gap, name in run_plan(k):
        df = df.withColumn(f"{mark}{name}", joined(F.col(f"{mark}{left}"), F.col(f"{mark}{right}"), gap))
    whole = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return df.withColumn(out, F.slice(f"{mark}h{k}", F.lit(1), whole)).drop(*[c for c in df.columns if c.startswith(mark)], *([words] if drop_words else []))
