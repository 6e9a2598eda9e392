"""Language identification by the nearest of several centroids a language.

A text is a normalised TF-IDF vector of its hashed letter bigrams and trigrams
(lower case; anything but a letter is a blank). Each language has up to CLUSTERS
centroids from spherical k-means; the prediction is the language of the centroid
with the largest cosine. A text too far from its centroid is marked as rejected:
the least cosine is calibrated on the learning rows of about its length.

Every learning row counts and every label is learned. Document frequencies,
centroids and least cosines come from all learning rows; k-means only starts from
a sample of at most SAMPLE rows a language, those with the smallest hash of doc_id.
Labels of at least one in MOST_LANGUAGES learning rows are in one dense table.
The rest, however many, is fitted label by label and compared through sparse
blocks of about BLOCK_ENTRIES weights: one goes with the dense table, each
further one takes a pass of its own over the documents.

Defined cases: a text that is null or has no letter is `und` with score 0, and
rejected, and teaches nothing; without any learning row every text is `und`; long
texts are read whole; equal texts get equal results; of equal cosines that of the
dense table wins, then the first part's, then the first label's; an empty table gives
an empty table; other columns are kept, and one named like an output column is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescope.llm.storage import drop_path, extended, materialise, new_path

BITS = 14
DIMS = 1 << BITS
#: Rows a language from which k-means starts, centroids a language, rounds of k-means at most, seedings tried.
SAMPLE, CLUSTERS, ROUNDS, SEEDINGS = 128, 3, 12, 6
#: Least rows of a cluster, as a share of an even one.
LEAST_SHARE = 0.2
MOST_LANGUAGES = 1000
#: Rounds over all rows end when the sum of their cosines grows by no more than this share.
LEAST_GAIN = 1e-3
BLOCK_ENTRIES = 4_000_000
#: Weights are summed as whole numbers of 1 / ONE, so that sums do not depend on the order of the rows; steps of a cosine when its quantile is taken.
ONE, STEPS = 1 << 30, 4096
#: A text is rejected below REJECT_SHARE of the cosine that all but REJECT_QUANTILE of the learning rows of its length
#: (the power of two of its number of different n-grams) reach; where there are fewer than FLOOR_ROWS of a
#: length, the floor of the next shorter length holds; below all of them it is LEAST_COSINE, which texts in other
#: letters do not reach.
REJECT_SHARE, REJECT_QUANTILE, FLOOR_ROWS, LEAST_COSINE = 0.25, 0.02, 16, 0.03


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Dimensions and how often each occurs; None without any letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    c = np.zeros(len(points) + 2, np.uint32)
    np.multiply(points, letter, out=c[1:-1])
    live = letter | np.append(letter[1:], False)
    two = (c[1:-1] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    three = (c[:-2] * np.uint32(0xC2B2AE3D) + c[1:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
    n = np.bincount(np.concatenate([two[live], three[letter]]), minlength=DIMS)
    dims = np.flatnonzero(n)
    return dims, n[dims]


def weigh(dims: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF weights."""
    v = np.log1p(n) * idf[dims]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


class Block:
    """Centroids of rare labels by dimension: those of dimension d are owner[start[d] : start[d + 1]], with their weights."""

    def __init__(self, rows: list):
        """rows: lang, cluster, dims, weights of each centroid."""
        rows = sorted(rows, key=lambda r: (r["lang"], r["cluster"]))
        self.langs = [r["lang"] for r in rows]
        dims = [np.frombuffer(r["dims"], "<i2") for r in rows]
        every = np.concatenate(dims)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(d) for d in dims])[order]
        self.weights = np.concatenate([np.frombuffer(r["weights"], "<f4") for r in rows])[order]
        self.start = np.searchsorted(every[order], np.arange(DIMS + 1))

    def nearest(self, dims: np.ndarray, v: np.ndarray) -> tuple[str, float]:
        first, many = self.start[dims], self.start[dims + 1] - self.start[dims]
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        cos = np.bincount(self.owner[at], self.weights[at] * np.repeat(v, many), len(self.langs))
        best = int(np.argmax(cos))
        return self.langs[best], min(1.0, float(cos[best]))


class Centroids:
    """idf: a weight for each dimension; table: dimensions x centroids; langs: of each centroid; floors: least accepted cosine for each length.

    block: the rare labels, or the first part of them; others: a table with the centroids of the further parts, which stays with the driver.
    """

    def __init__(self, idf, table, langs, floors, block=None, others=None, parts=1):
        self.idf, self.table, self.langs, self.floors, self.block, self.others, self.parts = idf, table, langs, floors, block, others, parts

    def further(self) -> Iterator[Centroids]:
        """Models of the further parts alone, one at a time."""
        for i in range(1, self.parts):
            yield Centroids(self.idf, self.table[:, :0], [], self.floors, _block(self.others, i))

    def alone(self) -> Centroids:
        """What a worker gets."""
        return Centroids(self.idf, self.table, self.langs, self.floors, self.block)

    def nearer(self, text: str | None, lang: str = "und", score: float = -1.0, rejected: bool = True) -> tuple[str, float, bool]:
        """The prediction, unless a nearer one is known already; a score below 0 if there is none."""
        found = counts(text) if text and (self.langs or self.block) else None
        if found is None:
            return lang, score, rejected
        dims, n = found
        v = weigh(dims, n, self.idf)
        if self.langs:
            cos = v @ self.table[dims]
            best = int(np.argmax(cos))
            if (near := min(1.0, max(0.0, float(cos[best])))) > score:
                lang, score = self.langs[best], near
        if self.block:
            other, near = self.block.nearest(dims, v)
            if near > score:
                lang, score = other, near
        return lang, score, bool(score < self.floors[_length(dims)])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        lang, score, rejected = self.nearer(text)
        for m in self.further():
            lang, score, rejected = m.nearer(text, lang, score, rejected)
        return lang, max(0.0, score), rejected


def _length(dims: np.ndarray) -> int:
    return len(dims).bit_length() - 1


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _cluster(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from several seedings by distance (k-means++): the closest fit of those whose clusters all have rows enough.

    Where every seeding leaves a cluster of odd rows, clusters below the least size go and their rows join the others.
    """
    random, least = np.random.default_rng(len(rows)), LEAST_SHARE * len(rows) / k
    fits = []
    for _ in range(SEEDINGS):
        c = rows[random.integers(len(rows), size=1)]
        while len(c) < k:
            far = np.maximum(0.0, 1.0 - (rows @ c.T).max(1).astype(np.float64)) ** 2
            if far.sum() <= 1e-9:
                break  # the rows are no more than so many
            c = np.vstack([c, rows[random.choice(len(rows), p=far / far.sum())]])
        for _ in range(ROUNDS):
            own = np.argmax(rows @ c.T, 1)
            c = _unit(np.vstack([rows[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
        sizes = np.bincount(np.argmax(rows @ c.T, 1), minlength=len(c))
        fits.append((bool(sizes.min() >= least), float((rows @ c.T).max(1).mean()), c[sizes >= max(1.0, least)]))
    c = max(fits, key=lambda f: f[:2])[2]
    own = np.argmax(rows @ c.T, 1)
    return c, own


def _refine(c: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after rounds over all rows (dimensions, weights), and each row's cosine with its own."""
    before = 0.0
    for _ in range(ROUNDS):
        cosines = [c[:, dims] @ w for dims, w in rows]
        sums = np.zeros(c.shape)
        for cos, (dims, w) in zip(cosines, rows, strict=True):
            sums[int(np.argmax(cos)), dims] += w
        norms = np.linalg.norm(sums, axis=1)
        if norms.sum() <= before * (1 + LEAST_GAIN):
            break
        before = norms.sum()
        c = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], c).astype(np.float32)
    return c, np.array([(c[:, dims] @ w).max() for dims, w in rows])


def _bin(length, cos):
    """The place of a row in a histogram by length and cosine."""
    return length * (STEPS + 1) + np.clip(np.floor(np.asarray(cos) * STEPS), 0, STEPS).astype(np.int64)


def _floors(histogram: np.ndarray) -> np.ndarray:
    """The least accepted cosine for each length."""
    rows = histogram.reshape(-1, STEPS + 1)
    out = np.full(len(rows), LEAST_COSINE)
    for k in np.flatnonzero(rows.sum(1) >= FLOOR_ROWS).tolist():
        upto = np.cumsum(rows[k])
        out[k] = REJECT_SHARE * float(np.searchsorted(upto, REJECT_QUANTILE * upto[-1], "right")) / STEPS
    return np.maximum.accumulate(np.maximum(out, LEAST_COSINE))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Centroids:
    """Learns from the rows that are not held out and whose language is known."""
    known = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id)).alias("place")
    )

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in it:
            for t in batch.column(0).to_pylist():
                if t and (found := counts(t)):
                    df[found[0]] += 1
                    n += 1
        dims = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *dims], pa.int32()), pa.array([n, *df[dims]], pa.int64())], ["dim", "n"])

    totals = dict(known.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect())  # DIMS rows at most
    rows = totals.pop(-1, 0) or 0
    df = np.zeros(DIMS)
    df[list(totals)] = list(totals.values())
    idf = np.log((1 + rows) / (1 + df)) + 1

    table, langs, histogram = np.zeros((DIMS, 0), np.float32), [], np.zeros(_BINS, np.int64)
    block, others, parts = None, None, 1
    if rows:
        labels = known.groupBy("lang").agg(F.count(F.when(F.col("text").rlike(r"\p{L}"), 1)).alias("n"))
        often = F.col("n") * MOST_LANGUAGES >= rows  # so many at most
        found = labels.agg(F.count("*").alias("labels"), F.collect_list(F.when(often, F.struct("lang", "n"))).alias("often")).first()
        sizes = {r["lang"]: r["n"] for r in found["often"]}
        if sizes:
            table, langs, histogram = _fit_often(known.filter(F.col("lang").isin(list(sizes))), sizes, idf)
        if found["labels"] > len(sizes):
            path = new_path(docs.sparkSession, "language-centroids")
            others, parts, more = _fit_rare(known.filter(~F.col("lang").isin(list(sizes))) if sizes else known, idf, path)
            block, histogram = _block(others, 0), histogram + more
            if parts == 1:
                others = None
                drop_path(docs.sparkSession, path)
    return Centroids(idf.astype(np.float32), table, langs, _floors(histogram), block, others, parts)


_BINS = (DIMS.bit_length() + 1) * (STEPS + 1)
_ROWS = "lang string, cluster int, dims binary, weights binary"


def _vectors(known: DataFrame, idf: np.ndarray) -> DataFrame:
    """lang, place, dims, weights of the rows with a letter."""

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [counts(t) if t else None for t in batch.column(1).to_pylist()]
            keep = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64())), pa.array([found[i][0].astype("<i2").tobytes() for i in keep], pa.binary()), pa.array([weigh(*found[i], idf).astype("<f4").tobytes() for i in keep], pa.binary())],
                ["lang", "place", "dims", "weights"],
            )

    return known.mapInArrow(vectors, "lang string, place long, dims binary, weights binary")


def _start(vectors: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Centroids of the SAMPLE rows with the smallest places of a language, and all its rows in that order."""
    rows = sorted(zip(*(vectors.column(c).to_pylist() for c in ("place", "dims", "weights")), strict=True))
    rows = [(np.frombuffer(d, "<i2"), np.frombuffer(w, "<f4")) for _, d, w in rows]
    dense = np.zeros((min(SAMPLE, len(rows)), DIMS), np.float32)
    for i, (dims, weights) in enumerate(rows[:SAMPLE]):
        dense[i, dims] = weights
    return _cluster(dense, CLUSTERS)[0], rows


def _packed(lang: str, centroids: np.ndarray) -> list[tuple]:
    """Rows of centroids: lang, cluster, dims, weights."""
    return [(lang, j, np.flatnonzero(c).astype("<i2").tobytes(), c[np.flatnonzero(c)].astype("<f4").tobytes()) for j, c in enumerate(centroids)]


def _as_table(rows: list[tuple]) -> pa.Table:
    lang, cluster, dims, weights = zip(*rows, strict=True)
    return pa.table({"lang": pa.array(lang, pa.string()), "cluster": pa.array(cluster, pa.int32()), "dims": pa.array(dims, pa.binary()), "weights": pa.array(weights, pa.binary())})


def _fit_often(known: DataFrame, sizes: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Centroids (dimensions x centroids) and their labels, and the histogram of all rows: k-means from a sample, then rounds over all rows."""
    spark = known.sparkSession
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2 * SAMPLE / n)))])
    near = known.filter((F.col("place") / F.lit(2.0**64) + 0.5) < F.element_at(share, F.col("lang")))  # about 2 * SAMPLE rows a language
    seeds = _vectors(near, idf).groupBy("lang").applyInArrow(lambda t: _as_table(_packed(t.column("lang")[0].as_py(), _start(t)[0])), _ROWS).collect()
    seeds.sort(key=lambda r: (r["lang"], r["cluster"]))
    langs = [r["lang"] for r in seeds]
    table = np.zeros((DIMS, len(seeds)), np.float32)
    for j, r in enumerate(seeds):
        table[np.frombuffer(r["dims"], "<i2"), j] = np.frombuffer(r["weights"], "<f4")
    spans = {k: slice(langs.index(k), langs.index(k) + langs.count(k)) for k in set(langs)}
    histogram, before = np.zeros(_BINS, np.int64), 0.0
    for turn in range(ROUNDS + 1):
        shared = spark.sparkContext.broadcast((idf, table, spans))

        def sums(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            idf, table, spans = shared.value
            total: dict[int, np.ndarray] = {}
            bins = np.zeros(_BINS, np.int64)
            for batch in it:
                for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not t or lang not in spans or not (found := counts(t)):
                        continue
                    dims, v, own = found[0], weigh(*found, idf).astype(np.float32), spans[lang]
                    cos = v @ table[dims, own]
                    best = int(np.argmax(cos))
                    if own.start + best not in total:
                        total[own.start + best] = np.zeros(DIMS, np.int64)
                    total[own.start + best][dims] += np.rint(v * np.float64(ONE)).astype(np.int64)
                    bins[_bin(_length(dims), cos[best])] += 1
            total[-1] = bins
            live = {j: np.flatnonzero(s) for j, s in total.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([d.astype("<i4").tobytes() for d in live.values()], pa.binary()), pa.array([total[j][d].astype("<i8").tobytes() for j, d in live.items()], pa.binary())],
                ["centroid", "at", "sums"],
            )

        def add(parts: pa.Table) -> pa.Table:
            total = np.zeros(max(DIMS, _BINS), np.int64)
            for at, s in zip(parts.column("at").to_pylist(), parts.column("sums").to_pylist(), strict=True):
                total[np.frombuffer(at, "<i4")] += np.frombuffer(s, "<i8")
            live = np.flatnonzero(total)
            return pa.table({"centroid": parts.column("centroid").slice(0, 1), "at": pa.array([live.astype("<i4").tobytes()], pa.binary()), "sums": pa.array([total[live].astype("<i8").tobytes()], pa.binary())})

        schema = "centroid int, at binary, sums binary"
        found = {r["centroid"]: (np.frombuffer(r["at"], "<i4"), np.frombuffer(r["sums"], "<i8")) for r in known.select("lang", "text").mapInArrow(sums, schema).groupBy("centroid").applyInArrow(add, schema).collect()}
        shared.destroy()
        at, n = found.pop(-1, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
        histogram = np.zeros(_BINS, np.int64)
        histogram[at] = n
        norms = {j: float(np.linalg.norm(s / ONE)) for j, (_, s) in found.items()}
        if turn == ROUNDS or sum(norms.values()) <= before * (1 + LEAST_GAIN):
            break  # the histogram is that of this table
        before = sum(norms.values())
        new = table.copy()
        for j, (at, s) in found.items():
            new[:, j] = 0
            new[at, j] = s / ONE / norms[j]
        table = new
    return table, langs, histogram


def _fit_rare(known: DataFrame, idf: np.ndarray, path: str) -> tuple[DataFrame, int, np.ndarray]:
    """A table of the centroids of each label with their part, the number of parts, and the histogram of all rows."""

    def fit_label(vectors: pa.Table) -> pa.Table:
        c, rows = _start(vectors)
        c, cosines = _refine(c, rows)
        bins, n = np.unique(_bin(np.array([_length(dims) for dims, _ in rows]), cosines), return_counts=True)
        lang = vectors.column("lang")[0].as_py()
        return _as_table([*_packed(lang, c), (lang, -1, bins.astype("<i4").tobytes(), n.astype("<i8").tobytes())])

    fitted = materialise(_vectors(known, idf).groupBy("lang").applyInArrow(fit_label, _ROWS), "language-centroids", path)

    def bins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BINS, np.int64)
        for batch in it:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(total[live], pa.int64())], ["bin", "n"])

    histogram = np.zeros(_BINS, np.int64)
    for at, n in fitted.filter("cluster < 0").select("dims", "weights").mapInArrow(bins, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():
        histogram[at] = n
    centroids = fitted.filter("cluster >= 0")
    entries = centroids.agg(F.sum(F.length("dims"))).first()[0] or 0
    parts = max(1, -(-(entries // 2) // BLOCK_ENTRIES))
    return centroids.withColumn("part", F.pmod(F.xxhash64("lang", "cluster"), F.lit(parts))), parts, histogram


def _block(centroids: DataFrame, part: int) -> Block | None:
    rows = centroids.filter(F.col("part") == part).select("lang", "cluster", "dims", "weights").collect()  # about BLOCK_ENTRIES weights
    return Block(rows) if rows else None


_NAMES = ["lang_pred", "score", "rejected"]


def _nearest(docs: DataFrame, shared: Broadcast, text: str, names: list[str], known: bool) -> DataFrame:
    """Adds the prediction of a model that fits a worker as columns of those names, or, where known, puts a nearer one in their place."""
    where, kept = docs.columns.index(text), [i for i, c in enumerate(docs.columns) if not known or c not in names]
    at = [docs.columns.index(c) for c in names] if known else []

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            rows = [m.nearer(*r) for r in zip(*(batch.column(i).to_pylist() for i in (where, *at)), strict=True)]
            new = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(v, k) for v, k in zip(new, (pa.string(), pa.float64(), pa.bool_()), strict=True))], [*(batch.schema.names[i] for i in kept), *names])

    base = docs.drop(*names) if known else docs
    return docs.mapInArrow(batches, extended(base.schema, "{} string, {} double, {} boolean".format(*(f"`{n}`" for n in names))))


def _predicted(docs: DataFrame, model: Centroids, text: str, names: list[str]) -> DataFrame:
    """Adds the prediction; each further part of the model is compared in a pass of its own, whose result is written."""
    spark, before = docs.sparkSession, None
    shared = spark.sparkContext.broadcast(model.alone())
    out = _nearest(docs, shared, text, names, False)
    for m in model.further():
        path = new_path(spark, "language-nearest")
        written = materialise(out, "language-nearest", path)
        shared.destroy()
        if before:
            drop_path(spark, before)
        before, shared = path, spark.sparkContext.broadcast(m)
        out = _nearest(written, shared, text, names, True)
    return out.withColumn(names[1], F.greatest(names[1], F.lit(0.0)))


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the cosine, 0 to 1) and rejected. What a worker holds of the model is bounded by its parameters."""
    return _predicted(docs.drop(*_NAMES), model, text, _NAMES)


def keep_known(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The rows, all columns, whose language the model does not reject."""
    if model.parts > 1:
        names = [f"{n}_{uuid.uuid4().hex}" for n in _NAMES]
        return _predicted(docs, model, text, names).filter(~F.col(names[2])).drop(*names)
    where = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model.alone())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            yield batch.filter(pa.array([not m.predict(t)[2] for t in batch.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
