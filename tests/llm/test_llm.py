"""Each operator against a brute-force version, with nulls, empty and long texts, ties, empty tables and clashing columns."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagescope.llm import byte_bpe, chat_format, decontaminate, fingerprint, language_id, ngram_join, secret_scan, substring_dedup, token_files, warc
from pagescope.llm.components import connected_components

RANKS = P.path("byte_bpe_50k.tiktoken")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return [w.decode() for w in (s or "").encode().split()]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    make = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(n))
    base = make(120)
    near = [" ".join(w if r.random() > p else "zz" for w in base.split()) for p in (0.005, 0.01, 0.02, 0.03, 0.05, 0.2) for _ in range(3)]
    return [base, base, base.upper(), *near, make(30), make(3), "a", "A", "", None, " \t\n", make(9000), base + "\n" + make(60), make(40) + " " + base, "x\x1cy\xa0z 日本語 <|endoftext|> 's", "1 2 3"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 101, t, "en" if i % 2 else "fr", "s", len(t or ""), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")


def test_byte_bpe(docs):
    ranks = {t: i for i, t in enumerate(byte_bpe.load_ranks(RANKS))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.token_digests(docs, RANKS, P.PATTERN).collect()}
    back = byte_bpe.decode_column(byte_bpe.encode_column(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    for r in back.collect():
        ids = own.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and bytes(r["decoded"]) == (r["text"] or "").encode()
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or ""))
    assert byte_bpe.token_digests(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    assert [h.candidate(k) for k in keys] == list(range(3000)) and sorted(h.slot_of) == list(range(3000))


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 3000), (5, 80, 3000), (4, 85, 4)])
def test_ngram_join(docs, texts, k, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAMILY_SETS", block)  # 4: families split in pairs of blocks
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], k, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked_groups(docs, k, percent).collect()}
    assert got == want
    kept = ngram_join.keep_one(docs, k, percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == docs.columns


def test_rows_are_kept_and_dropped_by_row(spark):
    one, two, leak = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one, "x"), (1, one, "y"), (1, one + " z", "x"), (2, one, "x"), (None, one, "x"), (2, two, "x"), (None, two + " z", "x"), (None, "q r s t u v", "x"), (None, "q r s t u v", "x"), (4, None, "x"), (4, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in ngram_join.keep_one(d, 5, 80).collect()]
    assert sum((r[1] or "").startswith("a0") for r in got) == 1 and all(r[0] == 1 for r in got if (r[1] or "").startswith("a0"))
    assert sorted((r for r in got if not (r[1] or "").startswith("a0")), key=str) == sorted([(2, two, "x"), (None, "q r s t u v", "x"), (4, None, "x"), (4, None, "x")], key=str)
    bench = spark.createDataFrame([("i", leak)], "item_id string, text string")
    d = spark.createDataFrame([(1, "clean"), (1, leak), (None, leak), (None, "clean"), (2, leak), (3, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.drop_contaminated(d, bench).collect()), key=str) == sorted([(1, "clean"), (None, "clean"), (3, None)], key=str)


def test_ngram_join_empty(docs):
    assert ngram_join.linked_groups(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for l in links for x in l}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for l in links if l[0] != l[1] for x in l}


def test_components_read_links_once(spark):
    """Links that come out differently each time they are computed, as those of a task whose rows come in another order."""
    pairs = spark.range(200).select((F.col("id") * 2).alias("x"))
    flip = F.rand() < 0.5
    links = pairs.select(F.when(flip, F.struct(F.col("x").alias("a"), (F.col("x") + 1).alias("b"))).otherwise(F.struct((F.col("x") + 1).alias("a"), F.col("x").alias("b"))).alias("l")).select("l.*")
    more = pairs.select(F.when(F.rand() < 0.5, F.col("x")).otherwise(F.col("x") + 1).alias("a"), ((F.floor(F.col("x") / 10) * 10) + 1000).cast("long").alias("b"))
    got = {r["node"]: r["component"] for r in connected_components(links.unionByName(more)).collect()}
    assert all(got[x] == got[x + 1] for x in range(0, 400, 2)) and len(set(got.values())) == 40


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup(spark, texts, window):
    many = [*texts, "a " * 100, "a " * 34, "a " * 35, texts[0][:300] + " q " + texts[0][200:]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(many)], "doc_id long, text string")
    ws = [words(t) for t in many]
    seen = collections.Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    for r in substring_dedup.digest_rows(d, window).collect():
        w = ws[r["doc_id"]]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert substring_dedup.digest_rows(d.limit(0)).count() == 0


def removed(rows, window):
    """What brute force removes: row -> (words, removed, kept)."""
    ws = [words(t) for t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


@pytest.mark.parametrize(("window", "letters"), [(35, 400), (12, 30), (8, 4), (6, 2)])
def test_substring_dedup_of_patchworks(spark, window, letters):
    """Texts pasted from parts of one another: branches, cycles, parts of paths, runs of one word."""
    r = random.Random(window)
    pool = [[str(r.randrange(letters)) for _ in range(150)] for _ in range(6)] + [["x"] * 90, ["x", "y"] * 60]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            i = r.randrange(len(p))
            parts += [*p[i : i + r.randint(1, 80)], *(f"u{r.randrange(10**9)}" for _ in range(r.randint(0, 3)))]
        rows.append(r.choice([" ", "\n", "  "]).join(parts))
    rows += rows[:3]
    d = spark.createDataFrame([(i if i % 5 else None, t, 1, "mine") for i, t in enumerate(rows)] + [(None, rows[0], 1, "mine")] * 2, "doc_id long, text string, a int, firsts string")
    want = collections.Counter((i if i % 5 else None, *v) for i, v in enumerate(removed([*rows, rows[0], rows[0]], window)[: len(rows)])) + collections.Counter({(None, *removed([*rows, rows[0], rows[0]], window)[0]): 2})
    assert collections.Counter(tuple(x) for x in substring_dedup.digest_rows(d, window).collect()) == want


def test_substring_dedup_finds_spans_through_paths(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(200))
    d = spark.createDataFrame([(1, text), (2, "a " + text), (3, text + " b")], "doc_id long, text string")
    gone = lambda: {r["doc_id"]: r["n_removed"] for r in substring_dedup.digest_rows(d).collect()}
    assert gone() == {1: 200, 2: 200, 3: 200}
    monkeypatch.setattr(substring_dedup, "compact", lambda found, window, folder=None: found.select("a", "b", F.col("first").alias("run"), F.col("edge").alias("path"), "first", "last", F.lit(False).alias("shared"), F.lit(False).alias("speaks")))
    assert all(n < 200 for n in gone().values())  # edges by themselves do not reach


def test_byte_bpe_repeats_rows_and_replaces_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "a b", "x"), (2, None, "x")], "doc_id long, text string, ids string").withColumn("decoded", F.lit(3))
    back = byte_bpe.decode_column(byte_bpe.encode_column(d, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in back) == [(0, b"a b"), (1, b"a b"), (1, b"a b"), (2, b"")]
    got = byte_bpe.token_digests(d, RANKS, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in got) == [(0, 2, sha("a b")), (1, 2, sha("a b")), (1, 2, sha("a b")), (2, 0, sha(""))]


def test_ngram_join_of_repeated_and_missing_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(7, one), (7, one), (7, two), (None, one), (None, two + " c"), (3, two), (None, "alone by itself now yes"), (9, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("mine")).withColumn("component_id", F.lit(0))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked_groups(d, 4, 85).collect())
    assert got == collections.Counter([(7, 47, 7), (7, 47, 7), (7, 47, 3), (None, 47, 7), (None, 48, 3), (3, 47, 3), (None, 2, None), (9, 0, 9), (None, 0, None)])


def test_decontaminate_takes_rows_as_documents(spark):
    leak = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([("i", leak), ("j", leak), ("j", "w0")], "item_id string, text string").withColumn("hash", F.lit(1))
    d = spark.createDataFrame([(1, leak), (1, leak), (1, "clean"), (None, leak), (None, None)], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("size", F.lit(1))
    got = collections.Counter(tuple(r) for r in decontaminate.hits(d, bench).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")).collect())
    assert got == collections.Counter({(1, 12, 12, "i,j"): 2, (1, 1, 0, ""): 1, (None, 12, 12, "i,j"): 1, (None, 0, 0, ""): 1})


def test_chat_format_of_repeated_nodes_and_ties(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 1, None, "user", "p", 0.0), (1, 2, 1, "assistant", "x", 0.5), (1, 3, 1, "assistant", "y", 0.5), (1, 3, 1, "assistant", "y", 0.5), (2, 1, None, None, None, None)]
    d = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    for n, c in enumerate(("leaf", "place", "length", "up", "total", "formatted")):
        d = d.withColumn(c, F.lit(n))
    got = {(r["tree"], r["leaf"]): [tuple(t) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_paths(d)).collect()}
    assert got == {(1, 2): [("user", "p"), ("assistant", "x")], (1, 3): [("user", "p"), ("assistant", "y")], (2, 1): [("", "")]}
    assert [(r["tree"], r["leaf"]) for r in chat_format.format_paths(d, best=1).orderBy("tree").collect()] == [(1, 2), (2, 1)]


def test_chat_format_ranks_branches_as_sql(spark):
    """The best two paths of random reply trees, against a recursive query."""
    import duckdb
    import pandas as pd

    r = random.Random(8)
    rows = [(t, n, r.randrange(n) if n and r.random() < 0.95 else None, "assistant" if n % 2 else "user", f"t{t}n{n}<", round(r.random(), 3)) for t in range(25) for n in range(r.randint(1, 40))]
    d = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    nodes = pd.DataFrame(rows, columns=["tree", "node", "parent", "role", "text", "score"])
    want = duckdb.sql("""WITH RECURSIVE n AS (SELECT * FROM nodes), p AS (SELECT tree, node, score AS total, 1 AS length, text AS said FROM n WHERE parent IS NULL
        UNION ALL SELECT n.tree, n.node, p.total + n.score, p.length + 1, p.said || '|' || n.text FROM n JOIN p ON n.tree = p.tree AND n.parent = p.node),
        l AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tree = p.tree AND n.parent = p.node))
        SELECT tree, node, said FROM l QUALIFY row_number() OVER (PARTITION BY tree ORDER BY round(total / length, 9) DESC, node) <= 2""").fetchall()
    got = chat_format.read_back(chat_format.format_paths(d, best=2)).collect()
    assert sorted((x["tree"], x["leaf"], "|".join(t["text"] for t in x["turns"])) for x in got) == sorted(want)


def test_warc_of_repeated_and_missing_ids(spark):
    rows = [(4, "u", "x"), (4, "v", "x"), (2, "u", "x"), (2, "u", "x"), (None, "u", "x"), (None, None, "only"), (6, "u", "only")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1))
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(d).collect())
    assert got == collections.Counter({(4, "revisit", 2): 2, (2, "response", None): 2, (None, "response", None): 2, (6, "response", None): 1})


@pytest.mark.parametrize("window", [0, 5, 65_001])
def test_substring_dedup_refuses_windows(docs, window):
    with pytest.raises(ValueError):
        substring_dedup.digest_rows(docs, window)
    assert substring_dedup.reach_of(600) == 298


def test_decontaminate(spark, docs, texts, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(texts[0].split()[20:45])), (2, "A"), (3, None), (4, ""), (5, "A"), (10, "1-2 3")], "item_id long, text string")
    split = lambda t: [w for w in "".join(c if c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in lower(t or "")).split(" ") if w]
    wins = {}
    for r in bench.collect():
        w = split(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else []:
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(r["item_id"]))
    want = {}
    for r in docs.collect():
        w = split(r["text"])
        hit, items = set(), set()
        for g, ids in wins.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    items |= ids
        want[r["doc_id"]] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
    for limit in (100_000, 0):  # the broadcast set, and the shuffled way beyond its size
        monkeypatch.setattr(decontaminate, "MOST_WINDOWS", limit)
        assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest_rows(docs, bench).collect()} == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]} and kept.columns == docs.columns
    assert decontaminate.digest_rows(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.digest_rows(docs.limit(0), bench).count() == 0


def test_chat_format(spark):
    rows = [(1, 1, None, "user", "hi \\0 < [x]\n<|im_end|>\n", 0.5), (1, 2, 1, "assistant", "a", 0.9), (1, 3, 1, "assistant", "b", 0.1), (1, 4, 3, "us\ner", "c", 1.0), (1, 5, 4, "assistant", None, 1.0), (2, 7, 99, "user", "", None), (3, 1, 2, "u", "cycle", 0.0), (3, 2, 1, "u", "cycle", 0.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): ([tuple(t) for t in r["turns"]], r["loss_text"]) for r in chat_format.read_back(chat_format.format_paths(nodes)).collect()}
    first = ("user", rows[0][4])
    assert got == {(1, 2): ([first, ("assistant", "a")], "a"), (1, 5): ([first, ("assistant", "b"), ("us\ner", "c"), ("assistant", "")], "b"), (2, 7): ([("user", "")], "")}
    assert [r["leaf"] for r in chat_format.format_paths(nodes, best=1).orderBy("tree").collect()] == [2, 7]
    assert chat_format.format_paths(nodes.limit(0)).count() == 0
    chain = spark.createDataFrame([(9, i, i - 1 if i else None, "assistant", f"t{i}", 0.0) for i in range(37)], nodes.schema)
    assert chat_format.read_back(chat_format.format_paths(chain)).first()["loss_text"] == "".join(f"t{i}" for i in range(37))


def test_fingerprint(docs, texts):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = sorted(fingerprint.fingerprints(docs, 4).collect(), key=lambda r: r["doc_id"])
    errors = []
    by_text = {}
    for i, (r, (d, t)) in enumerate(zip(got, rows, strict=True)):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, len(t), sha(edited))
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == 256
        shingles = lambda x: (lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))(words(lower(x)))
        for value, other in ((r["near_edited"], edited), (r["near_next"], nxt)):
            a, b = shingles(t), shingles(other)
            assert 0 <= value <= 1
            if len(a) > 60 and len(b) > 60:
                errors.append(abs(value - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.05 and max(errors) < 0.2
    assert fingerprint.fingerprints(docs.limit(0), 4).count() == 0


def plain_fingerprint(text):
    """One-permutation MinHash without any sorting trick: the smallest hash a bin, then donors in each bin's own order."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    long = lambda h: h.to_bytes(8, "little")
    w = words(lower(text))
    ones = [of(x.encode(), 42) for x in w]
    pair = lambda a, b: of(long(b), of(long(a), 42))
    hashes = []
    for i in range(len(w) - 4):
        two, three = pair(ones[i], ones[i + 1]), pair(ones[i + 2], ones[i + 3])
        hashes.append(pair(pair(two, three), ones[i + 4]))
    if w and not hashes:
        seed = 42
        for x in w:
            seed = of(x.encode(), seed)
        hashes = [seed]
    bins = [None] * 128
    for h in map(signed, hashes):
        b = (h >> 57) + 64
        bins[b] = h if bins[b] is None else min(bins[b], h)
    if not hashes:
        return "0" * 256
    ranks = fingerprint._ranks(128)
    full = [p for p in range(128) if bins[p] is not None]
    dense = [bins[b] if bins[b] is not None else bins[min(full, key=lambda p: ranks[b * 128 + p])] for b in range(128)]
    return "".join(f"{h & 255:02x}" for h in dense)


def test_fingerprint_equals_a_plain_one(spark, texts):
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*texts, *texts[:3], "one", "a b c d", "a b c d e f"])] + [(3, "again"), (3, "again"), (-(2**63), "least")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("mine")).withColumn("_span", F.lit(1))
    got = fingerprint.fingerprints(d, 4).select("doc_id", "fingerprint", "n_chars").collect()
    want = collections.Counter((i, plain_fingerprint(t or ""), len(t or "")) for i, t in rows)
    assert collections.Counter(map(tuple, got)) == want
    r = random.Random(5)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):  # the estimate has no bias worth the name, chance agreement taken out
        pairs = []
        for n in range(60):
            base = [f"{r.random()}" for _ in range(400)]
            keep = int(400 * share)
            pairs.append((n, " ".join(base), " ".join(base[:keep] + [f"{r.random()}" for _ in range(400 - keep)])))
        p = fingerprint.with_fingerprint(fingerprint.with_fingerprint(spark.createDataFrame(pairs, "n int, a string, b string"), "a", "fa"), "b", "fb")
        sets = lambda t: {tuple(t.split()[j : j + 5]) for j in range(396)}
        true = {n: len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for n, a, b in pairs}
        errors.append(np.mean([x["v"] - true[x["n"]] for x in p.select("n", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("v")).collect()]))
    assert max(map(abs, errors)) < 0.02


def test_apart_sends_each_number_to_a_partition(spark):
    for n in (1, 2, 7, 51):
        d = spark.createDataFrame([(i,) for i in fingerprint._apart(n)], "k int").repartition(n, "k")
        assert sorted(r[0] for r in d.select(F.spark_partition_id()).collect()) == list(range(n))


def test_language_id(spark):
    r = random.Random(1)
    words_of = {"en": ["the", "and", "with", "house", "thing"], "fr": ["le", "être", "où", "maison", "chose"], "de": ["der", "und", "straße", "haus", "ding"]}
    rows = [(i, " ".join(r.choice(words_of[l]) for _ in range(20)), l) for i, l in enumerate(["en", "fr", "de"] * 40)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !?", "fr"), (503, "the and house " * 5000, None), (None, "le être", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = language_id.fit(d)
    got = {x["doc_id"]: x for x in language_id.identify(d, model).collect()}
    right = [got[i]["lang_pred"] == l for i, _, l in rows[:120] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(right) > 0.97 and all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "und", "en"]
    kept = language_id.keep_known(d, model)
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} == set(got) - {500, 501, 502}
    empty = language_id.fit(d.limit(0))
    assert {x["lang_pred"] for x in language_id.identify(d, empty).collect()} == {"und"}
    assert language_id.identify(d.limit(0), model).count() == 0


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "xqzv kjwq zzxk vbnm qqwx jklz pvqx wxyz kkjq zxvq mnbv qzqz xwvk jqkx " * 8,
]


def test_language_id_on_whole_tables(spark):
    """Held-out accuracy on rows that no label of was seen, rejection of languages never learned, clean rows kept."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(d)
    rows = language_id.identify(d, model).collect()
    told = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"] and r["lang_pred"] != "und"]
    assert len(told) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in told]) >= 0.97
    assert np.mean([r["rejected"] for r in rows if r["text"]]) < 0.01
    away = spark.createDataFrame(list(enumerate(FOREIGN)), "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.identify(away, model).collect()) and language_id.keep_known(away, model).count() == 0
    for i in range(0, 400, 37):  # the prediction by brute force: cosines with every centroid
        text = rows[i]["text"] or ""
        v, c = np.zeros(language_id.DIMS), language_id.counts(text)
        if c:
            v[c[0]] = np.log1p(c[1]) * model.idf[c[0]]
            cos = model.table.T @ (v / np.linalg.norm(v))
            assert rows[i]["lang_pred"] == model.langs[int(np.argmax(cos))] and abs(rows[i]["score"] - max(0, cos.max())) < 1e-4


def test_clusters_are_kinds_not_odd_rows():
    r = np.random.default_rng(2)
    kinds = np.repeat(np.eye(3, 50), 40, 0) + r.random((120, 50)) * 0.1
    odd = np.vstack([kinds, np.eye(50)[40:42]])
    c, own = language_id._cluster((odd / np.linalg.norm(odd, axis=1, keepdims=True)).astype(np.float32), 3)
    assert len(c) == 3 and np.bincount(own).min() >= 39
    same = np.ones((9, 4), np.float32) / 2
    assert len(language_id._cluster(same, 3)[0]) == 1


def test_rare_labels_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 10)
    rows = [(i, "the house and the thing", "en") for i in range(60)] + [(100 + i, f"junk {i}", f"junk{i}") for i in range(30)]
    assert set(language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == {"en"}


def test_every_label_is_learned(spark, monkeypatch):
    """Labels below the bound of the dense table, in one sparse part or in many, against all of them in the dense table."""
    r = random.Random(5)
    words_of = {"en": ["the", "and", "with", "house", "thing"], "fr": ["le", "être", "où", "maison", "chose"], "und": ["og", "kvæld", "snø", "hytte", "fjord"], "fi": ["kissa", "yö", "talo", "metsä", "järvi"], "hu": ["ház", "erdő", "kutya", "szép", "nagyon"]}
    kinds = ["en", "fr"] * 150 + ["und", "fi", "hu"] * 12
    rows = [(i, " ".join(r.choice(words_of[k]) for _ in range(15)), k) for i, k in enumerate(kinds)]
    rows += [(900, None, "xx"), (901, "12 !", "yy"), (902, "12 !", None), (903, "", "en"), (904, "Ω ж 字", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rejected", F.lit("mine"))
    whole = language_id.fit(d)
    assert set(whole.langs) == set(words_of) and whole.block is None
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 10)
    for entries in (language_id.BLOCK_ENTRIES, 400):
        monkeypatch.setattr(language_id, "BLOCK_ENTRIES", entries)
        model = language_id.fit(d)
        assert set(model.langs) == {"en", "fr"} and (model.parts > 1) == (entries == 400)
        got = {x["doc_id"]: x for x in language_id.identify(d, model).collect()}
        assert all(got[i]["lang_pred"] == k for i, k in enumerate(kinds)) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903))
        for i, text, _ in rows:
            lang, score, rejected = whole.predict(text)
            for one in [tuple(got[i][c] for c in ("lang_pred", "score", "rejected")), *([model.predict(text)] if i % 111 == 0 else [])]:
                assert (one[0], one[2]) == (lang, rejected) and abs(one[1] - score) < 1e-4
        kept = language_id.keep_known(d, model)
        assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if not x["rejected"]}
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    assert {x["doc_id"]: x["lang_pred"] for x in language_id.identify(d, language_id.fit(d)).collect() if x["doc_id"] < 900} == dict(enumerate(kinds))


def test_centroids_hold_every_learning_row(spark):
    """Each n-gram of each learning row has weight in its language, and centroids are the means of the rows nearest to them."""
    r = random.Random(6)
    rows = [(i, f"the house and {''.join(r.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(9))} thing", "en") for i in range(900)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sums = np.zeros(model.table.shape)
    for i, text, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            dims, n = language_id.counts(text)
            assert (model.table[dims].max(1) > 0).all()
            v = language_id.weigh(dims, n, model.idf)
            sums[dims, int(np.argmax(v @ model.table[dims]))] += v
    assert ((model.table * sums).sum(0) / np.linalg.norm(sums, axis=0)).min() > 0.98


def test_secret_scan(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    rows = [f"é {key} x", 'Token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "password: short", "passwd=abcdef", "0123456789abcdef01234567", "bearer Zx81kQp0Vv72mNw4 here", "the secret of a bakery is internationalisation2", None, "", "a" * 100_000 + " apikey:abcdefg1"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumn("spans", F.lit(0))
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(d).collect()}
    assert got[0]["spans"] == "access:2:22" and got[0]["n_access"] == 1
    assert got[1]["spans"] == "assign:0:49,hex:9:49" and got[1]["base_sha256"] == sha("assign:0:49,hex:9:49")
    assert [got[i]["spans"] for i in (2, 3, 4)] == ["", "assign:0:13", "hex:0:24"]
    assert got[5]["spans"].startswith("novel:7:") and got[5]["n_assign"] == 0 and got[6]["spans"] == ""
    assert got[7]["base_sha256"] == got[8]["base_sha256"] == sha("") and got[9]["spans"] == "hex:0:100000,assign:100001:100016"
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(d.drop("spans")).collect()}
    assert clean[0] == "é [SECRET] x" and clean[1] == "[SECRET]\"" and clean[6] == rows[6] and clean[7] is None


def test_secret_scan_finds_repeated_keys():
    key = "Zx81kQp0Vv72mNw4Hs63LtRb95YcGd27JfUeAo8K"
    line = f"curl -H 'Authorization: Bearer {key}' https://a.example/\n"
    for text, n in ((line * 2, 2), (line + "x " * 85 + line, 2), (line + f"curl https://a.example/?access_key={key}\n", 2), (line * 20, 20)):
        spans = secret_scan.scan(text)[1]
        assert len(spans) == n and key not in secret_scan.redact(text, spans)


def test_secret_scan_finds_long_keys_of_small_alphabets():
    r = random.Random(5)
    for letters, sizes in (("0123456789ABCDEF", (64, 88, 256, 500)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (52, 172, 500)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (43, 300, 500))):
        for n in sizes:
            for _ in range(10):
                text = f"authorization: Bearer {''.join(r.choices(letters, k=n))} end"
                assert secret_scan.scan(text)[1] == [(22, 3, 22 + n)]


def test_secret_scan_keeps_long_keys_whole():
    r = random.Random(3)
    blob = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1200))
    assert secret_scan.scan(f"private_key blob {blob} end")[1] == [(17, 3, 1217)]
    assert secret_scan.redact(f"x private_key {blob}", secret_scan.scan(f"x private_key {blob}")[1]) == "x private_key [SECRET]"
    # a base span further on takes only its own part
    text = f"bearer {blob[:700]}-{'ab12' * 8}-{blob[700:]}"
    assert secret_scan.redact(text, secret_scan.scan(text)[1]) == "bearer [SECRET][SECRET][SECRET]"
    # a word within a run: what follows it is judged apart
    text = f"authorization: bearer_token_token_token_token_token_token_token={blob[:20]}"
    assert blob[:20] not in secret_scan.redact(text, secret_scan.scan(text)[1])
    text = f"bearer token internationalisation token {blob[:20]}"
    assert secret_scan.redact(text, secret_scan.scan(text)[1]) == "bearer token internationalisation token [SECRET]"
    assert secret_scan.scan("bearer" * 100_000)[1] == []


def test_secret_scan_finds_keys_of_one_kind():
    r = random.Random(9)
    keys = ["qzxjvkwpqmznbvxtrhgdlcfy", "WQZXJKVBNMPLRTYHGFDS", *("".join(r.choices("0123456789", k=n)) for n in (16, 20, 23))]
    assert all(secret_scan.scan(f"bearer {k} x")[1] == [(7, 3, 7 + len(k))] for k in keys)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        assert sum(len(secret_scan.scan(f"bearer {''.join(r.choices(letters, k=24))} x")[1]) for _ in range(100)) >= 97
    words = ["internationalisation", "Geschwindigkeitsbegrenzung", "constitutionnellement", "responsabilidades", "get_user_name_by_account", "CONTENT_SECURITY_POLICY", "/docs/reference/configuration/", "2024-01-15-10-30-00", "----------------------", "navigation-container-wrapper"]
    assert [w for w in words if secret_scan.scan(f"the bearer of {w} x")[1]] == []


def test_token_files(spark, docs):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["a <|endoftext|> b<|startoftext|>", "É́ ΑΣ x\x1cy\xa0z\x85q 日本 it's 'llama I'LL ẞ ﬁ ½ ª 've'", "×÷ÀÖØÞßàÿ 'É's''s 1'2", "'", None, ""]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "no id"), (None, "no id"), (3, "twice"), (-1, "less")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("start", F.lit("mine"))
    for d in (docs, more):
        at, left = 0, collections.Counter((x["doc_id"], x["text"] or "") for x in d.collect())
        place = lambda i: (i is not None, i)
        got = sorted(token_files.token_files(d, P.path("word_bpe_49k.json"), 2).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((i for i, _ in left.elements()), key=place)
        for r in got:
            ids = {(i, t): [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in left if i == r["doc_id"]}
            key = next(k for k, v in ids.items() if zlib.crc32(np.array(v, "<u4").tobytes()) == r["ids_crc32"])
            assert (r["start"], r["n_tokens"]) == (at, len(ids[key]))
            at += r["n_tokens"]
            left -= collections.Counter([key])
        assert not left
    assert token_files.token_files(docs.limit(0), P.path("word_bpe_49k.json"), 2).count() == 0


def test_pieces_are_the_library_s():
    tok, coder, r = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_files.tokenizer(P.path("word_bpe_49k.json")), random.Random(4)
    texts = ["".join(r.choice(c) for _ in range(r.randint(0, 30))) for c in ("''srtlvemd1 2-\t\nÀéABS&", "'stlve \x1c\x00×é日ΣA") for _ in range(3000)]
    assert [np.frombuffer(x, coder.dtype).tolist() for part in coder.encode(pa.array(texts)) for x in part] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_huffman_codes():
    r = np.random.default_rng(5)
    for n, bits in ((1, 4), (2, 1), (200, 8), (3000, 14)):
        counts = (r.pareto(0.6, n) * 5 + 1).astype(np.int64)
        lengths = token_files.code_lengths(counts, bits)
        assert lengths.max() <= bits and sum(2.0 ** -lengths.astype(float)) <= 1
        ids = r.choice(n, 5000, p=counts / counts.sum()).astype(np.uint32)
        data, offsets = token_files.pack(ids, lengths, token_files.canonical(lengths), 64)
        assert (token_files.unpack(data, offsets, len(ids), lengths, 64) == ids).all()
        assert (token_files.unpack(data, offsets, len(ids), lengths, 64, 3, 2) == ids[192:320]).all()


def test_warc(spark, tmp_path):
    rows = [(5, "u", "x"), (3, "u", "x"), (9, None, None), (8, "a", ""), (1, "q r", "é" * 300_000), (2, "z", "é" * 300_000), (7, "w", "WARC/1.1\r\n\r\n")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("mine"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(d, f"file://{tmp_path}/w").collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        data = (h or "").encode()
        main = first.setdefault(data, i)
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if main == i else "revisit", None if main == i else main)
    for f in (tmp_path / "w/records").glob("*.gz"):
        whole = f.read_bytes()
        lines = [x.split("\t") for x in (f.parent / f"{f.name}.idx").read_text().splitlines()]
        assert all(gzip.decompress(whole[int(o) : int(o) + int(n)]).startswith(b"WARC/1.1") for o, n, _ in lines) and sum(int(n) for _, n, _ in lines) == len(whole)
    assert warc.archive_pages(d.limit(0)).count() == 0


def test_inflate_reads_members_and_monoliths():
    parts = [b"a" * 3_000_000, b"b", b""]
    for data in (gzip.compress(b"".join(parts)), b"".join(gzip.compress(p) for p in parts)):
        chunks = [data[i : i + 1000] for i in range(0, len(data), 1000)]
        assert b"".join(warc.inflate(iter(chunks))) == b"".join(parts)


def base_spans(text):
    """The contract's patterns, by the letter."""
    import re

    found = [(m.start(), 0, m.end()) for m in re.finditer("((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def test_secret_scan_base_spans_on_whole_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    kinds = ("assign", "access", "hex")
    for r in secret_scan.find_secrets(d.select("doc_id", "text")).collect():
        want = base_spans(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        said = [f"{kinds[k]}:{s}:{e}" for s, k, e in want]
        assert r["base_sha256"] == sha(",".join(said)) and set(said) <= set(r["spans"].split(","))| {""}
    assert secret_scan.find_secrets(d.select("doc_id", "text").limit(0)).count() == 0


@pytest.mark.parametrize("letters", ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_secret_scan_recall_of_planted_keys(letters):
    r = random.Random(len(letters))
    for n in (20, 32, 64, 200, 1000, 2000):
        found = 0
        for i in range(40):
            head = f"line {i} of the file: Authorization: Bearer "
            found += any(s <= len(head) and e >= len(head) + n for s, _, e in secret_scan.scan(f"{head}{''.join(r.choices(letters, k=n))} and more")[1])
        assert found >= 36, (letters, n, found)


def brute_pipeline(docs, bench, learned):
    """documents -> {(doc_id, text): ids} by plain Python; learned tells which texts the language model keeps."""
    split = lambda t: [w for w in "".join(c if c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in lower(t or "")).split(" ") if w]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.load_ranks(RANKS))}, special_tokens={})
    rows = [r for r in docs if learned(r[1])]
    groups = brute_groups([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
    best = {}
    for i, r in enumerate(rows):
        if groups[i][0]:
            best.setdefault(groups[i][1], []).append((r[0] is None, r[0] or 0, i))
    keep = {min(g)[2] for g in best.values()} | {i for i in range(len(rows)) if not groups[i][0]}
    rows = [r for i, r in enumerate(rows) if i in keep]
    windows = {tuple(w[i : i + min(10, len(w))]) for t in bench if (w := split(t)) for i in range(len(w) - min(10, len(w)) + 1)}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    rows = [r for r in rows if clean(split(r[1]))]
    return collections.Counter((r[0], tuple(own.encode_ordinary(secret_scan.redact(r[1], secret_scan.scan(r[1])[1])))) for r in rows)


def test_pipeline_from_documents_to_ids(spark, tmp_path):
    """The whole pipeline on a part of the test table, with ties, repeated rows, missing ids and clashing columns, against brute force."""
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in some]
    rows += [(None, rows[3][1], "en"), (rows[5][0], rows[9][1], "fr"), (7777, rows[4][1] + " more", "en"), (8888, "password: hunter2hunter2 " + rows[6][1], "en"), (9999, None, "en"), (9998, "", None), (9997, "123 !!", "de"), *[(i, FOREIGN[i % 4], None) for i in (5000, 5001)]]
    bench = [" ".join(rows[8][1].split()[2:14]), None, ""]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n, c in enumerate(("source", "n_chars", "lang_pred", "rejected", "class", "row", "_away", "_dirty", "spans", "w")):
        d = d.withColumn(c, F.lit(n))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(bench)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute_pipeline(rows, bench, lambda t: not model.predict(t)[2]) and sum(got.values()) > 50


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "d e a c b a e d c b a b"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, rows, str(tmp_path))
        assert new.columns == docs.columns
        assert {r["doc_id"] for r in new.collect()} <= {r["doc_id"] for r in rows.collect()}
        rows = new
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in rows.collect()}
