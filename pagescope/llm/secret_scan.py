"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

Three patterns find what has a known shape. The method adds strings that follow a
sensitive word and that zstandard, primed with identifiers and with the text
around the string, cannot shorten: the bytes that such a string adds are measured
against those of a random string of its length and alphabet, since the entropy coder
shortens long random strings too. Copies of the string in that text are blanked out first, so
that a repeated key is judged as if it stood once.

zstandard cannot shorten a single long word or identifier either, so that only strings
are measured that are mixed (digits, capitals and small letters take turns four times),
all digits, or whose letters follow one another as in no words. Left out are strings
under 16 characters, pass phrases of words, and digits with signs between them (dates)
or with few letters that do not take turns.

Spans are code points, end exclusive. A candidate begins within REACH characters of
a sensitive word and goes on to its own end at any length. Defined cases: a null or empty text has no
spans; texts are scanned whole at any length; repeated rows give repeated rows;
an empty table gives an empty table; other columns are kept, and one named like
an output column is replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescope.llm.storage import extended

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # finds what HEX finds with 24 characters or more
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SENSITIVE = re.compile(r"(?i:password|passwd|secret|token|api_?key|credential|private_?key|bearer|authorization|access_?key)", re.ASCII)
SENSITIVE_WORDS = (*ASSIGN_WORDS, b"credential", b"private", b"bearer", b"authorization", b"accesskey", b"access_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
PARTS = (re.compile(r"[A-Za-z0-9+/_-]{16,}"), re.compile(r"[A-Za-z0-9]{16,}"))
#: Characters after a sensitive word in which a candidate begins; characters of surrounding text that prime the dictionary on each side.
REACH, AROUND = 48, 256
#: Least share of the bytes of a random string that must remain as new bytes.
NOVELTY = 0.8
#: Alphabets of keys by size; signs of a candidate beside them; random strings drawn for a length; the length from which bytes grow in proportion.
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (_DIGITS, _DIGITS + _LOW[:6], _DIGITS + _UP[:6], _LOW, _UP, _LOW + "234567", _UP + "234567", _LOW + _DIGITS, _UP + _DIGITS, _LOW + _UP, _LOW + _UP + _DIGITS)
SIGNS, DRAWS, SETTLED = frozenset("+/_=-"), 4, 4096
#: Turns between kinds of characters that make a string mixed; bits that letters of one kind must have on average after the letter before, and pairs to tell by.
MIXED, SCATTERED, LEAST_PAIRS = 4, 4.8, 6
#: Identifiers that prime every dictionary.
IDENTIFIERS = (
    b"password passwd secret token api_key apikey access_key private_key public_key credential credentials bearer authorization "
    b"client_id client_secret session_id user_name username email config configuration settings environment variable default example "
    b"placeholder your_key_here changeme undefined function return import export class static const string boolean integer "
    b"getElementById addEventListener application/json content-type text/html charset utf-8 https://www.example.com/index.html "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx"
)
#: Bits of each letter after each letter in words of source code and of four languages, a row of 26 hexadecimal digits for each first letter.
_BITS = (
    "95449758596343a5934366776936563877358267469446499957395738935a4468289563589a7a4675278928857647954647887a"
    "47436568798453757334867579486633792aa477379455498a6a487727543a846447a446478a87298728983a766638a564598a68"
    "5645555a9a844246954395a7a53a6828a84a58a825a7572a8a6a48662767398475668636684a79377527893a8387379855579a49"
    "2586289839865733a857599a7a48433538496686479833668a797644866969644254a345455899387737864a8387348354587a5a"
    "788788a888a676a885670888aa375527693a665546954467795a58472774396667548742487969386727942a966746a345587858"
    "5456465a58934364a3439899a9288917783a9977479788878988277536a4399684389347996699463635963a956863a652887667"
    "655646784a9544539533765976476817873aa6674aa6776a6a77"
)
PAIR_BITS = {a + b: int(_BITS[26 * i + j], 16) for i, a in enumerate(_LOW) for j, b in enumerate(_LOW)}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEX_MAP = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))
_RUN = b"x" * 24

Span = tuple[int, int, int]  # start, number of the kind, end


def surroundings(text: str, start: int, end: int) -> str:
    """AROUND characters on each side of text[start:end], its copies and those of its parts that could be candidates blanked out."""
    own, n = text[start:end], end - start
    before, after = text[max(0, start - AROUND - n) : start], text[end : end + AROUND + n]  # a copy may reach over the edge
    for part in (own, *PARTS[0].findall(own), *PARTS[1].findall(own)):
        before, after = before.replace(part, " " * len(part)), after.replace(part, " " * len(part))
    return before[-AROUND:] + "\n" + after[:AROUND]


def added(own: bytes, around: bytes = b"") -> int:
    """Bytes that a string adds to the identifiers and what stands around it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(own)) - len(packer.compress(b""))


@lru_cache(maxsize=100_000)
def needed(alphabet: str, n: int) -> float:
    """Bytes that random strings of n characters of an alphabet add to the identifiers; from SETTLED characters on in proportion."""
    if n > SETTLED:
        return needed(alphabet, SETTLED) * n / SETTLED
    r = random.Random(n)
    return sum(added("".join(r.choices(alphabet, k=n)).encode()) for _ in range(DRAWS)) / DRAWS


def alphabet_of(token: str) -> str:
    """The smallest alphabet with all letters and digits of the token; signs between them do not count."""
    own = set(token) - SIGNS
    return next(a for a in ALPHABETS if own <= set(a))


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that text[start:end] adds to its surroundings, without its own copies, and the identifiers, by what a random string of its length and alphabet adds."""
    own = text[start:end]
    around = surroundings(text, start, end).encode("utf-8", "replace")
    return added(own.encode(), around) / max(1, needed(alphabet_of(own), end - start))


def mixed(token: str) -> bool:
    """Digits, capitals and small letters take turns at least MIXED times: words and numbers in words do not."""
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 for c in token if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= MIXED


def scattered(token: str) -> bool:
    """Only digits, or letters that follow one another as they do not in words: strings of one kind of characters, which do not take turns."""
    if token.strip("=").isdigit():
        return True
    bits = [PAIR_BITS[a + b] for w in WORDS.findall(token) for w in [w.lower()] for a, b in zip(w, w[1:], strict=False)]
    return len(bits) >= LEAST_PAIRS and sum(bits) >= SCATTERED * len(bits)


def base_spans(text: str, data: bytes, low: bytes) -> list[Span]:
    """Spans of the three patterns; data: the text in UTF-8, low: in lower case."""
    found: list[Span] = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _RUN in data.translate(_HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def apart(start: int, end: int, base: list[Span], at: int) -> Iterator[tuple[int, int]]:
    """The parts of start to end of a candidate's least length that no base span covers; base spans before at end before start."""
    while at < len(base) and base[at][0] < end:
        s, _, e = base[at]
        if s - start >= LEAST:
            yield start, s
        start, at = max(start, e), at + 1
    if end - start >= LEAST:
        yield start, end


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Candidates that begin within REACH of a sensitive word, each to its own end.

    Words within a run that is already told give the piece up to the next word (of
    LEAST characters at least), so that the work stays in proportion to the text.
    """
    words = [(w.start(), w.end()) for w in SENSITIVE.finditer(text)]
    starts = [s for s, _ in words]
    done = 0  # the end of the last run
    for _, here in words:
        limit = here + REACH
        if here < done:
            after = bisect_left(starts, here + LEAST)
            stop = min(done, starts[after] if after < len(starts) else done)
            if m := CANDIDATE.match(text, here, stop):
                yield here, m.end()
        here = max(here, done)
        while m := CANDIDATE.search(text, here, min(len(text), limit + LEAST)):
            here = done = CANDIDATE.match(text, m.start()).end()
            yield m.start(), done


def novel_spans(text: str, low: bytes, base: list[Span]) -> list[Span]:
    """Candidates near a sensitive word, apart from base spans, that the dictionary cannot shorten."""
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    found: list[Span] = []
    at = told = 0
    for first, last in pieces(text):
        if last <= told:
            continue
        while at < len(base) and base[at][2] <= first:
            at += 1
        for start, end in apart(first, last, base, at):
            if (mixed(text[start:end]) or scattered(text[start:end])) and novelty(text, start, end) >= NOVELTY:
                found.append((start, 3, end))
                told = max(told, end)
    return found


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start and kind."""
    data = text.encode("utf-8", "replace")
    low = data.lower()
    base = base_spans(text, data, low)
    more = novel_spans(text, low, base)
    return base, sorted(base + more) if more else base


def spell(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each pattern, the digest of the base spans, and all spans."""
    base = docs.drop(*_NAMES)
    where = base.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for t in batch.column(where).to_pylist():
                found, spans = scan(t or "")
                n = [0, 0, 0]
                for _, k, _ in found:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(spell(found).encode()).hexdigest(), spell(spans)))
            new = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(new, kinds, strict=True))], [*batch.schema.names, *_NAMES])

    return base.mapInArrow(batches, extended(base.schema, OUT))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by the mark; a column n_chars is counted anew."""
    where = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            new = [None if t is None else redact(t, scan(t)[1], mark) for t in batch.column(where).to_pylist()]
            columns = list(batch.columns)
            columns[where] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(batches, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
