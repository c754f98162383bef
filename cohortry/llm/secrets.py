"""Secret scans: three fixed patterns, and dictionary-primed zstandard novelty.

Fixed patterns give the base spans: assignments to a sensitive name, access keys, long hexadecimal strings. Novelty adds
strings near a sensitive word that no pattern names. A candidate is a run of 16 or more characters of keys and tokens,
with letters and digits, that starts within ``reach`` characters after a sensitive word. It is compressed with
zstandard, primed with the text around it and with a dictionary of identifiers; the bytes that it adds, against those
that its characters would need if they were random, are its novelty. Names and paths are mostly known already, secrets
are not.

The identifier dictionary holds the word-like strings that stand near sensitive words in the most different surroundings
of the corpus: all documents are scanned, counted by string and surroundings, so that copies of a document count once, and
the dictionary is filled up to ``dictionary_bytes``. It is the only thing that is broadcast. A string that is not made of
words, as a key or a token, never becomes an identifier, so a secret is reported however many documents repeat it; the
limit of surroundings follows the number of documents. An identifier that the dictionary has no room for is judged by its
surroundings alone: that may report a name, and never hides a secret.

Defined results: NULL and empty texts have no spans. Offsets are code points, ends exclusive. Spans are sorted by start,
then by kind in the order of ``KINDS``. A novel span never overlaps a base span. Repeated rows get a row each. Of equally
frequent identifiers the smaller ones in code point order come into the dictionary first. Texts of any length are scanned
whole. An empty table gives an empty dictionary and an empty result. Only the text is read; other columns stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.words import text_buffers

KINDS = ("assign", "access", "hex", "novel")
SPANS = "array<struct<kind: string, start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(
    r"passw|passphrase|pwd|secret|token|api[_ -]?key|credential|bearer|authori[sz]ation|private[_ -]?key|access[_ -]?key|signature",
    re.IGNORECASE | re.ASCII)
_STEMS = (b"passw", b"passphrase", b"pwd", b"secret", b"token", b"api", b"credential", b"bearer", b"authori", b"private", b"access", b"signature", b"akia")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLUSTER = re.compile(r"[b-df-hj-np-tv-xz]{4}", re.IGNORECASE | re.ASCII)
_DIGITS = re.compile(r"[0-9]+")
_VOWELS = frozenset("aeiouyAEIOUY")


@dataclass(frozen=True)
class ScanParameters:
    """``around``: characters on either side that prime the compressor; ``novelty``: least share of the bytes that random
    characters of the same classes would need; ``surroundings``, and ``per_million`` of the documents: how many different
    ones make a word-like string an identifier; ``words``: least share of a word-like string's characters in its words."""

    reach: int = 48
    around: int = 2048
    novelty: float = 0.85
    surroundings: int = 8
    per_million: int = 20
    words: float = 0.6
    dictionary_bytes: int = 32768


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, leftmost and without overlap within a kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    # maximal runs: looking for the long ones gives the same spans as dropping the short ones
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _random_bytes(s: str) -> float:
    """How many bytes the string would need if its characters were random ones of the classes that it uses."""
    size = sum(n for n, used in ((10, any(c.isdigit() for c in s)), (26, any(c.islower() for c in s)),
                                 (26, any(c.isupper() for c in s)), (6, not s.isalnum())) if used)
    if set(s) <= set("0123456789abcdef"):
        size = 16
    return len(s) * math.log2(max(size, 2)) / 8


def novelty(candidate: str, surroundings: str, dictionary: bytes) -> float:
    """The bytes that the candidate adds to what is around it and to the identifiers, as a share of random ones."""
    primer = dictionary + surroundings.replace(candidate, "").encode("utf-8", "replace")
    options = {"level": 12, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(primer) >= 8:
        options["dict_data"] = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(**options)
    added = len(press.compress(candidate.encode())) - len(press.compress(b""))
    return added / _random_bytes(candidate)


def novel_spans(text: str, base: list[tuple[str, int, int]], dictionary: bytes, p: ScanParameters) -> list[tuple[str, int, int]]:
    """Incompressible strings near sensitive words, outside the base spans."""
    out = []
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
            continue
        if any(a < end and start < b for _, a, b in base) or not _SENSITIVE.search(text, max(0, start - p.reach), start):
            continue
        around = text[max(0, start - p.around):start] + text[end:end + p.around]
        if novelty(s, around, dictionary) >= p.novelty:
            out.append(("novel", start, end))
    return out


def word_like(s: str, share: float = 0.6) -> bool:
    """Whether most of a string lies in runs of letters that may be words: four or more, with vowels and consonants,
    but not four consonants in a row; random characters also have more groups of digits than names do."""
    if len(_DIGITS.findall(s)) > 1 + len(s) // 16:
        return False
    long = 0
    for m in _PART.finditer(s):
        n = m.end() - m.start()
        if n >= 4 and 0.2 <= sum(c in _VOWELS for c in m[0]) / n <= 0.7 and not _CLUSTER.search(m[0]):
            long += n
    return long >= share * len(s)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts of a buffer that can hold a span: a sensitive stem, or 24 hexadecimal digits in a row."""
    lower = data.tobytes().lower()
    places = []
    for stem in _STEMS:
        at = lower.find(stem)
        while at >= 0:
            places.append(at)
            at = lower.find(stem, at + 1)
    digits = np.zeros(256, bool)
    digits[[*b"0123456789abcdef"]] = True
    gaps = np.concatenate([[-1], np.flatnonzero(~digits[data]), [len(data)]])
    long = np.flatnonzero(np.diff(gaps) > 24)
    found = [np.searchsorted(offsets, places, "right") - 1]
    for first, last in zip(gaps[long] + 1, gaps[long + 1] - 1):
        found.append(np.arange(np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, last, "right")))
    return np.unique(np.concatenate(found)).astype(np.int64)


def spans_of(text: str, dictionary: bytes, p: ScanParameters) -> list[tuple[str, int, int]]:
    """All spans of a text."""
    base = base_spans(text)
    return ordered(base + novel_spans(text, base, dictionary, p))


def identifier_dictionary(docs: DataFrame, parameters: ScanParameters | None = None) -> bytes:
    """The word-like strings near sensitive words that have the most different surroundings, the most frequent last."""
    p = parameters or ScanParameters()
    least = max(p.surroundings, docs.count() * p.per_million // 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for row, data, offsets in text_buffers(column):
                names, contexts = [], []
                for i in _suspects(data, offsets).tolist():
                    text = column[row + i].as_py()
                    for m in _SENSITIVE.finditer(text):
                        for x in _IDENTIFIER.finditer(text, max(0, m.start() - p.reach), m.end() + p.reach):
                            if not word_like(x[0], p.words):
                                continue
                            names.append(x[0])
                            contexts.append(text[max(0, x.start() - 24):x.start()] + "\0" + text[x.end():x.end() + 24])
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(contexts, pa.string())], ["name", "context"])

    strings = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "name string, context string")
    counts = (
        strings.select("name", F.xxhash64("context").alias("context")).distinct()
        .groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        .orderBy(F.desc("n"), "name").limit(p.dictionary_bytes // 8)
    )
    out, size = [], 0
    for r in counts.collect():
        size += len(r.name) + 1
        if size > p.dictionary_bytes:
            break
        out.append(r.name)
    return "\n".join(reversed(out)).encode()


def _per_text(docs: DataFrame, text: str, dictionary: bytes, p: ScanParameters, make, kind: str, arrow: pa.DataType, empty) -> Column:
    """A column made from each suspect text and its spans; other texts get ``empty(text)``."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            spans: dict[int, list] = {}
            for row, data, offsets in text_buffers(column):
                for i in _suspects(data, offsets).tolist():
                    content = column[row + i].as_py()
                    if content and (found := spans_of(content, dictionary, p)):
                        spans[row + i] = found
            yield make(column, spans, arrow, empty)

    return F.arrow_udf(run, kind)(F.col(text).cast("string"))


def _as_structs(column: pa.Array, spans: dict[int, list], arrow: pa.DataType, empty) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans.get(i, empty)] for i in range(len(column))], arrow)


def _as_texts(column: pa.Array, spans: dict[int, list], arrow: pa.DataType, mark: str) -> pa.Array:
    if not spans:
        return column.cast(arrow)
    rows = np.array(sorted(spans))
    texts = []
    for i in rows.tolist():
        text, parts, at = column[i].as_py(), [], 0
        for _, start, end in spans[i]:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        texts.append("".join([*parts, text[at:]]))
    chosen = np.zeros(len(column), bool)
    chosen[rows] = True
    return pa.compute.replace_with_mask(column.cast(arrow), pa.array(chosen), pa.array(texts, arrow))


def secret_spans(docs: DataFrame, dictionary: bytes, parameters: ScanParameters | None = None, text: str = "text") -> Column:
    """All spans of each text as an array column."""
    return _per_text(docs, text, dictionary, parameters or ScanParameters(), _as_structs, SPANS, _SPANS, ())


def redacted(docs: DataFrame, dictionary: bytes, parameters: ScanParameters | None = None, text: str = "text",
             mark: str = "[secret]") -> Column:
    """Each text with its spans replaced by a mark; other texts, NULL among them, stay as they are."""
    return _per_text(docs, text, dictionary, parameters or ScanParameters(), _as_texts, "string", pa.string(), mark)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
