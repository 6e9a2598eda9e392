"""Token-ID files: canonical length-limited Huffman codes of ids from global counts.

File: magic, then a header (lengths of all sections), the code lengths, the index
of documents, the bit offset of each block, the bits. A block holds BLOCK ids and
decodes on its own from its bit offset; blocks decode side by side, each step
taking one id of every block from a table over the next MAX_BITS bits.

Defined cases: a null or empty text has only the end id; ids of documents are in
ascending doc_id order, rows of equal doc_id one after the other in no set order;
a null doc_id comes first and stays null; strings of special tokens in a text are
those tokens, as in the plain call of the library; an empty table gives no file and no row; texts are encoded whole;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescope.llm import storage
from pagescope.llm.words import text_slices

MAGIC = b"PSHUFF01"
#: Longest code; ids in a block; ids after which a new file begins.
MAX_BITS, BLOCK, FILE_IDS = 18, 512, 1 << 20
#: Pieces that a worker remembers the ids of; then it starts anew. Bounds memory only.
REMEMBERED = 400_000
#: Bytes of text split and given back at once.
SLICE = 2 << 20


# ---- code lengths -------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most max_bits bits, by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    rows, level = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(max_bits - 1):
        rows.append(is_leaf)
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        level, is_leaf = both[place], place < n
    rows.append(is_leaf)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(rows):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = previous = 0
    sizes = lengths[order].tolist()
    for i, size in zip(order.tolist(), sizes, strict=True):
        code <<= size - previous
        codes[i], previous = code, size
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next `bits` bits: id and code length."""
    bits = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.int64(1) << (bits - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    total = int(span.sum())
    ids[:total], sizes[:total] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, sizes, bits


# ---- bits ---------------------------------------------------------------------


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, and the bit offset of each block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        code = codes[ids]
        word, room = begins >> 6, 64 - (begins & 63)
        over = size - room  # bits that go to the next word
        left = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(left, first)
        split = np.flatnonzero(over > 0)
        words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    return words.astype(">u8").tobytes(), begins[::block].astype(np.int64)


def unpack(data: bytes, offsets: np.ndarray, n: int, lengths: np.ndarray, block: int = BLOCK, first_block: int = 0, blocks: int | None = None) -> np.ndarray:
    """Ids of the blocks first_block .. first_block + blocks; n: ids in all blocks."""
    blocks = len(offsets) - first_block if blocks is None else blocks
    if blocks <= 0 or n == 0:
        return np.zeros(0, np.uint32)
    ids, sizes, bits = _table(lengths.tobytes())
    low = int(offsets[first_block]) >> 3
    high = int(offsets[first_block + blocks]) // 8 + 1 if first_block + blocks < len(offsets) else len(data)
    raw = np.zeros(high - low + 8, np.uint32)
    raw[: high - low] = np.frombuffer(data, np.uint8, high - low, low)
    next_bits = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
    at = offsets[first_block : first_block + blocks] - 8 * low
    count = np.full(blocks, block, np.int64)
    if first_block + blocks == len(offsets):
        count[-1] = n - (len(offsets) - 1) * block
    out = np.zeros((block, blocks), np.uint32)
    mask = np.uint32((1 << bits) - 1)
    live = blocks
    for step in range(int(count.max())):
        if step == count[-1]:
            live = blocks - 1
        p = at[:live]
        value = (next_bits[p >> 3] >> (32 - bits - (p & 7)).astype(np.uint32)) & mask
        out[step, :live] = ids[value]
        at[:live] += sizes[value]
    flat = out.T.ravel()
    return flat if count[-1] == block else flat[: (blocks - 1) * block + count[-1]]


@lru_cache(maxsize=2)
def _table(lengths: bytes):
    return decode_table(np.frombuffer(lengths, np.uint8))


# ---- files --------------------------------------------------------------------

_HEADER = struct.Struct("<8sqqqqqqqq")  # magic; part; ids of the part before this file; documents; those without doc_id, which come first; ids; block; bytes of code lengths; bytes of bits
#: File of the ids before each part, as 64-bit integers: what a part's files add to have the place among all ids.
STARTS = "starts.bin"


def file_parts(part: int, before: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> list[bytes]:
    bits, offsets = pack(ids, lengths, codes)
    book = zlib.compress(lengths.tobytes(), 6)
    nulls = doc_ids.count(None)
    known = np.array([0] * nulls + doc_ids[nulls:], "<i8")
    return [_HEADER.pack(MAGIC, part, before, len(doc_ids), nulls, len(ids), BLOCK, len(book), len(bits)), book, known.tobytes(), sizes.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), bits]


def parse_file(data: bytes):
    """(part, ids of the part before it, doc_ids as an Arrow array, ids of each document, all ids) of a file."""
    magic, part, before, docs, nulls, n, block, book, bits = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEADER.size
    lengths = np.frombuffer(zlib.decompress(data[at : at + book]), np.uint8)
    at += book
    doc_ids = pa.array(np.frombuffer(data, "<i8", docs, at), mask=np.arange(docs) < nulls)
    sizes = np.frombuffer(data, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    blocks = -(-n // block)
    offsets = np.frombuffer(data, "<i8", blocks, at)
    body = data[at + 8 * blocks : at + 8 * blocks + bits]
    step = 4096
    found = [unpack(body, offsets, n, lengths, block, i, min(step, blocks - i)) for i in range(0, blocks, step)]
    return part, before, doc_ids, sizes, np.concatenate(found) if found else np.zeros(0, np.uint32)


# ---- tokens -------------------------------------------------------------------


_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"  # the library's lower case and composition of these are Python's
_PIECES = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r {_LETTERS}0-9]+").findall
_NOT_PLAIN = re.compile(f"[^\t-\r -~{_LETTERS}]").search
_WORDS = re.compile("[^\t-\r ]+").findall

#: Kinds of bytes; _LEAD begins the UTF-8 form of the letters beyond ASCII above.
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER, _LEAD = 0, 1, 2, 3, 4, 0xC3


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[0x21:0x7F] = _SIGN
    out[[0x20, *range(0x09, 0x0E)]] = _BLANK
    out[48:58] = _DIGIT
    out[[*range(65, 91), *range(97, 123), _LEAD]] = _LETTER
    return out


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def plain_pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, where each piece or run of blanks begins (and the end), and which texts are plain.

    Pieces of a text that is not plain mean nothing.
    """
    n = len(buf)
    low, kind = _LOWER[buf], _KIND[buf]
    tail = np.flatnonzero(buf[:-1] == _LEAD) + 1
    of = buf[tail]
    kind[tail] = np.where((of == 0x97) | (of == 0xB7), _OTHER, _LETTER)  # the signs of multiplication and division
    low[tail[of < 0x9F]] += 32
    begins = np.empty(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
    begins[1:n] |= kind[1:] == _DIGIT
    begins[offsets] = True
    begins[0] = begins[n] = True
    at = np.flatnonzero(begins[:n] & (buf == 39))  # an apostrophe that no sign precedes may begin 's, 're and the like
    if len(at):
        edge = np.zeros(n + 3, bool)
        edge[offsets] = True
        edge[n:] = True
        ahead = np.append(low, np.zeros(2, np.uint8))
        one, two = ahead[at + 1], ahead[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ~edge[at + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for found, size in ((short, 2), (long, 3)):
            i = at[found & ~edge[at + 1]]
            begins[i + 1] = False
            begins[i + size] = True
    plain = np.ones(len(offsets) - 1, bool)
    plain[np.searchsorted(offsets, np.flatnonzero(kind == _OTHER), side="right") - 1] = False
    return low, np.flatnonzero(begins), plain


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class WordTokenizer:
    """A tokenizers file that lower-cases, drops white space and whose tokens end pieces.

    The library splits a text into pieces (a run of letters, a digit, a run of signs)
    and encodes each by itself, so a worker asks it for each distinct piece once. Plain
    texts are split here; of others each word with another character is one piece. Runs
    of letters go to the library many at a time, as one text, and piece ends tell their
    ids apart. A text with a string of a special token goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size < 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special) or b"(?!)").search
        self._forget()

    def _forget(self) -> None:
        self.number_of = _Numbers()
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Keeps the ids of new pieces, which are in the order of their numbers; blanks have none."""
        texts = [p.decode() for p in pieces]
        found: dict[str, np.ndarray] = {}
        runs, others = [], []
        for t in texts:
            (runs if t.isalpha() and not _NOT_PLAIN(t) else others).append(t)
        for i in range(0, len(runs), 512):
            part = runs[i : i + 512]
            ids = self._ids([" ".join(part)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("a run of letters is more than one piece")
            at = 0
            for run, stop in zip(part, stops.tolist(), strict=True):
                found[run] = ids[at:stop]
                at = stop
        found.update(zip(others, self._ids(others), strict=True))
        new = [found[t] for t in texts]
        size = np.array([len(x) for x in new], np.int64)
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.concatenate([self.flat, *new])

    def _lookup(self, pieces: pa.Array, per_text: np.ndarray) -> list[bytes]:
        """Ids of texts that are per_text pieces each, one after the other."""
        coded = pieces.dictionary_encode()
        if len(self.number_of) > REMEMBERED:
            self._forget()
        _, places, data = coded.dictionary.buffers()
        cuts = np.frombuffer(places, np.int64, len(coded.dictionary) + 1).tolist()
        raw = data.to_pybytes() if data is not None else b""
        distinct = [raw[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
        known = len(self.number_of)
        number = np.fromiter(map(self.number_of.__getitem__, distinct), np.int64, len(distinct))
        try:
            self._learn([distinct[i] for i in np.flatnonzero(number >= known).tolist()])
        except BaseException:
            self._forget()  # numbers without ids must not stay in a worker that lives on
            raise
        number = number[coded.indices.to_numpy()]
        size = self.size[number]
        upto = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(self.begin[number] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cuts = (upto[np.append(0, np.cumsum(per_text))] * self.width).tolist()
        return [ids[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]

    def _encode_other(self, text: str) -> bytes:
        pieces = [p.encode() for word in _WORDS(text) for p in ([word] if _NOT_PLAIN(word) else _PIECES(word.lower()))]
        return self._lookup(pa.array(pieces, pa.large_binary()), np.array([len(pieces)]))[0]

    def encode(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """Ids of each text as little-endian integers of dtype, many texts at a time; a null is empty."""
        for first, _, buf, offsets in text_slices(texts, SLICE):
            if len(buf) == 0:
                yield [b""] * (len(offsets) - 1)
                continue
            low, cuts, plain = plain_pieces(buf, offsets)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(low)])
            place = np.searchsorted(cuts, offsets)
            if not plain.all():  # their pieces are left out
                use = np.repeat(plain, np.diff(place))
                pieces = pieces.filter(pa.array(use))
            ids = self._lookup(pieces, np.where(plain, np.diff(place), 0))
            special = {int(np.searchsorted(offsets, m, side="right")) - 1 for m in self._special_places(buf)}
            for i in {*np.flatnonzero(~plain).tolist(), *special}:
                text = texts[first + i].as_py()
                ids[i] = self._ids([text])[0].tobytes() if i in special else self._encode_other(text)
            yield ids

    def _special_places(self, buf: np.ndarray) -> Iterator[int]:
        raw, m = buf.tobytes(), None
        while m := self.special(raw, m.end() if m else 0):
            yield m.start()


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def encode_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary: little-endian integers of the tokenizer's dtype) of each whole text with the end id."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in it:
            at = 0
            for ids in coder.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "ids"])
                at += len(ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int, dtype: str) -> np.ndarray:
    """How often each id occurs in the column ids: at most one row an id comes to the driver."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                joined = np.frombuffer(b"".join(batch.column(0).slice(at, 512).to_pylist()), dtype)
                total += np.bincount(joined, minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(batches, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_files(tokens: DataFrame, folder: str, lengths: np.ndarray, dtype: str) -> DataFrame:
    """Writes tokens, sorted by range partitions of doc_id, and returns part, file, n_ids (lazily)."""
    codes, width = canonical(lengths), np.dtype(dtype).itemsize

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_folder(folder)
        part = TaskContext.get().partitionId()
        names, sizes = [], []
        doc_ids, ids, held, before = [], [], 0, 0

        def flush():
            nonlocal doc_ids, ids, held, before
            if doc_ids:
                name = f"tokens-{part:06d}-{len(names):05d}.bin"
                n = np.array([len(x) // width for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), dtype)
                storage.put_file(system, f"{root}/{name}", file_parts(part, before, doc_ids, n, flat, lengths, codes))
                names.append(name)
                sizes.append(len(flat))
                before += len(flat)
            doc_ids, ids, held = [], [], 0

        for batch in it:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(d)
                ids.append(x.as_py())
                held += len(ids[-1]) // width
                if held >= FILE_IDS:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["part", "file", "n_ids"])

    return tokens.mapInArrow(batches, "part int, file string, n_ids long")


def write_starts(files: DataFrame, folder: str) -> int:
    """Writes the ids before each part into the folder, from a row a part; the number of parts."""
    totals = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())
    size = np.zeros(max(totals, default=-1) + 1, np.int64)
    size[list(totals)] = list(totals.values())
    system, root = storage.open_folder(folder)
    storage.put_file(system, f"{root}/{STARTS}", [(np.cumsum(size) - size).astype("<i8").tobytes()])
    return len(totals)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that are named in the column file."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.open_folder(folder)
        starts = None
        for batch in it:
            for name in batch.column(0).to_pylist():
                if starts is None:
                    with system.open_input_file(f"{root}/{STARTS}") as f:
                        starts = np.frombuffer(f.read(), "<i8")
                with system.open_input_file(f"{root}/{name}") as f:
                    part, before, doc_ids, sizes, ids = parse_file(f.read())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[part] + before + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file").mapInArrow(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes docs, writes the files into folder and reads them back."""
    spark = docs.sparkSession
    folder = folder or storage.new_path(spark, "token-files")
    coder = tokenizer(path)
    held = storage.new_path(spark, "token-ids")
    tokens = storage.materialise(encode_ids(docs, path, end_id), "", held)
    vocabulary = max(coder.tokenizer.get_vocab_size(), end_id + 1)
    lengths = code_lengths(id_counts(tokens, vocabulary, coder.dtype))
    parts = storage.shuffle_partitions(spark)
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    files = storage.materialise(write_files(ordered, folder, lengths, coder.dtype), "token-index")
    storage.drop_path(spark, held)  # the files have them now
    used = write_starts(files, folder)
    return read_files(files.repartition(max(1, min(used, parts)), "file"), folder)
