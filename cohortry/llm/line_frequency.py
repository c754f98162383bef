"""Quality rules: counts of a text by itself, and lines that many documents of a host share.

The lines of every document are normalised (A-Z lower-cased, every digit read as 0, white space between words as one
space, none at the ends) and hashed to 64 bits. For each host and line the different documents are counted, where
documents with equal texts are one: a copied page is a matter of deduplication, and its lines are no boilerplate for
having been copied. Near copies count one each. A line is common on its host if at least ``least_documents`` documents and
at least ``per_mille`` of a thousand documents of the host have it. Common lines are removed. A document is depleted, and
rejected, if fewer than ``least_words`` words are left or more than ``most_removed`` percent of its words are gone.

Texts are read once; what is kept of each is a row of counts and its line hashes, written to the shared folder. Counting
is two hash aggregations, first of (host, line, document), so that a line in a third of all documents is spread over all
tasks, then of partial counts. Common lines are joined, not broadcast: a bitmap of fixed size only thins out the rows.

Defined results: NULL and empty texts have no words and no lines and fail the base rules. NULL is a host of its own.
Repeated rows, and rows that share a doc_id, get a row each and count as one document where their texts are equal. Ties
don't arise: limits are reached or not. A text of any length is processed whole (a very long one in a slice of its own).
An empty table gives an empty result. Columns other than the host, the text and ``keep`` are not read; a name in ``keep``
that is also a result's name raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import flat_lists, is_present, presence_bits, stored, work_folder
from cohortry.llm.words import WordHasher, mix, odd_factor, text_buffers

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", "n_common_lines", "n_common_words", "kept")
_LINES = "array<struct<line: long, words: int>>"
_SALT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LineRules:
    """The limits; every comparison is one of whole numbers."""

    least_documents: int = 10
    per_mille: int = 10
    least_words: int = 20
    most_removed: int = 50
    most_repeated: int = 30


def _within(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal values of one owner."""
    return mix(values + (owner.astype(np.uint64) + np.uint64(1)) * _SALT)


class _Reader:
    """The counts and lines of the texts of a byte buffer."""

    def __init__(self) -> None:
        self.exact, self.loose = WordHasher(fold=False), WordHasher(digits=True)
        self.symbol = np.zeros(256, bool)
        self.symbol[[*SYMBOLS]] = True

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A hash of each whole text."""
        return self.exact.hashes(self.exact.lower[data], offsets[:-1], offsets[1:])

    def lines(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line that is not empty at the end of a text."""
        starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
        starts = starts[starts < len(data)]
        following = np.append(starts[1:], len(data))
        ends = following - (data[following - 1] == 10) if len(starts) else following[:0]
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def line_words(self, data: np.ndarray, offsets: np.ndarray, line_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each line as a sequence of normalised words, and its number of words."""
        starts, ends, _ = self.loose.spans(data, offsets)
        hashes = self.loose.hashes(self.loose.lower[data], starts, ends)
        at = np.searchsorted(starts, np.append(line_starts, len(data)))
        return self.loose.hashes(hashes, at[:-1], at[1:]), np.diff(at)

    def repeated(self, data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many words of each text lie in windows that the text has twice or more."""
        words, _ = self.exact.words(data, offsets)
        covered = np.zeros(len(words) + 1, np.int64)
        n = len(words) - WINDOW + 1
        if n > 0:
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
            window = np.zeros(n, np.uint64)
            for k in range(WINDOW):
                window += words[k:n + k] * odd_factor(k)
            _, which, times = np.unique(_within(window[inside], owner[inside]), return_inverse=True, return_counts=True)
            again = inside[times[which] > 1]
            np.add.at(covered, again, 1)
            np.add.at(covered, again + WINDOW, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        return np.diff(total[first])

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The counts of each text, and its lines: how many, their hashes, their words."""

        def of_text(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return np.diff(total[offsets])

        _, _, first = self.exact.spans(data, offsets)
        starts, ends, owner = self.lines(data, offsets)
        hashes, words = self.line_words(data, offsets, starts)
        raw = self.exact.hashes(self.exact.lower[data], starts, ends)
        full = words > 0
        owner, hashes, words, raw = owner[full], hashes[full], words[full], raw[full]
        texts = len(offsets) - 1
        _, once = np.unique(_within(raw, owner), return_index=True)
        counts = {
            "n_words": np.diff(first), "word_chars": of_text(~self.exact.space[data] & ((data & 0xC0) != 0x80)),
            "n_symbols": of_text(self.symbol[data]),
            "n_dup_lines": np.bincount(owner, minlength=texts) - np.bincount(owner[once], minlength=texts),
            "n_repeat_words": self.repeated(data, offsets, first),
        }
        _, at, which = np.unique(_within(hashes, owner), return_index=True, return_inverse=True)
        summed = np.bincount(which, weights=words, minlength=len(at)).astype(np.int32)
        order = np.argsort(owner[at], kind="stable")
        return counts, np.bincount(owner[at], minlength=texts), hashes[at][order], summed[order]


def measured(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """One row per document: ``row`` (the columns to keep), hashes of its host and text, counts, distinct lines."""
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.xxhash64(F.col(f"`{host}`").cast("string")).alias("host"),
                         F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([chosen.schema["row"]])
    for name in ("host", "doc", *COUNTS):
        schema.add(name, "long")
    schema.add("lines", T._parse_datatype_string(_LINES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            for row, data, offsets in text_buffers(batch.column("text")):
                counts, sizes, lines, words = reader.measure(data, offsets)
                part = batch.slice(row, len(sizes))
                pairs = pa.StructArray.from_arrays([pa.array(lines.view(np.int64)), pa.array(words)], ["line", "words"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("host"), pa.array(reader.documents(data, offsets).view(np.int64)),
                     *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], flat_lists(pairs, sizes, pairs.type)], schema.names)

    return chosen.mapInArrow(run, schema)


def common_lines(facts: DataFrame, rules: LineRules) -> DataFrame:
    """(host, line) of the lines that reach the limits of their host."""
    lines = facts.select("host", "doc", F.explode("lines.line").alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= rules.least_documents)
    hosts = facts.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    return counts.join(hosts, "host").where(1000 * F.col("n") >= rules.per_mille * F.col("documents")).select("host", "line")


def _removed(facts: DataFrame, common: DataFrame) -> DataFrame:
    """(host, doc) of the documents with common lines: how many, their words, and their hashes."""
    bits = presence_bits(common.select(F.xxhash64("host", "line").alias("h")))
    lines = facts.select("host", "doc", F.explode("lines").alias("l")).select("host", "doc", "l.line", "l.words")
    lines = lines.where(is_present(lines, F.xxhash64("host", "line"), bits))
    return lines.join(common, ["host", "line"]).distinct().groupBy("host", "doc").agg(
        F.count("*").alias("n_common_lines"), F.sum("words").alias("n_common_words"), F.collect_list("line").alias("common"))


def audited(docs: DataFrame, keep: list[str], rules: LineRules | None = None, host: str = "source", text: str = "text") -> DataFrame:
    """The columns to keep, the counts, the verdicts and the hashes of the removed lines (``host``, ``doc``, ``common``)."""
    rules = rules or LineRules()
    if clash := {c.lower() for c in keep} & {*RESULTS, "host_hash", "doc_hash", "common"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    folder = work_folder(docs.sparkSession)
    facts = stored(measured(docs, keep, host, text), f"{folder}/facts")
    common = stored(common_lines(facts, rules), f"{folder}/common")
    removed = stored(_removed(facts, common), f"{folder}/removed")
    n, gone = F.col("n_words"), F.coalesce("n_common_words", F.lit(0))
    failed = (n < 20) | (100 * F.col("n_repeat_words") > rules.most_repeated * n)
    depleted = (n - gone < rules.least_words) | (100 * gone > rules.most_removed * n)
    return facts.drop("lines").join(removed, ["host", "doc"], "left").select(
        "row.*", *COUNTS, failed.alias("base_failed"), F.coalesce("n_common_lines", F.lit(0)).alias("n_common_lines"),
        gone.alias("n_common_words"), (~failed & ~depleted).alias("kept"), F.col("host").alias("host_hash"), F.col("doc").alias("doc_hash"), "common")


def _document_hash(text: Column) -> Column:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _Reader()
        for column in columns:
            found = [reader.documents(data, offsets) for _, data, offsets in text_buffers(column)]
            yield pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))

    return F.arrow_udf(run, "long")(text)


def _without(text: Column, lines: Column) -> Column:
    """Each text without the lines whose hashes are listed."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        reader = _Reader()
        for texts, listed in columns:
            out = []
            for row, data, offsets in text_buffers(texts):
                starts, ends, owner = reader.lines(data, offsets)
                hashes, _ = reader.line_words(data, offsets, starts)
                at = np.searchsorted(owner, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    mine = slice(at[i], at[i + 1])
                    gone = np.isin(hashes[mine].view(np.int64), np.asarray(listed[row + i].as_py() or [], np.int64))
                    kept = zip(starts[mine][~gone].tolist(), ends[mine][~gone].tolist())
                    parts = [data[a:b].tobytes().decode() for a, b in kept]
                    if offsets[i + 1] > offsets[i] and data[offsets[i + 1] - 1] == 10:
                        parts.append("")  # what follows the last line break
                    out.append("\n".join(parts))
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, lines)


def cleaned(docs: DataFrame, rules: LineRules | None = None, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, without their common lines; the columns of ``docs`` as they were.

    Only texts that lose lines are moved: a bitmap of fixed size tells which rows need a look, a join decides.
    """
    plain = docs.select(F.col(f"`{host}`").alias("source"), F.col(f"`{text}`").alias("text"))
    found = audited(plain, ["source"], rules).where("NOT kept OR n_common_lines > 0").select("host_hash", "doc_hash", "kept", "common").distinct()
    found = stored(found, f"{work_folder(docs.sparkSession)}/verdicts")
    pack = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{host}`").cast("string")).alias("host_hash"),
                       _document_hash(F.col(f"`{text}`").cast("string")).alias("doc_hash"))
    touched = is_present(pack, F.xxhash64("host_hash", "doc_hash"), presence_bits(found.select(F.xxhash64("host_hash", "doc_hash").alias("h"))))
    rest = pack.where(touched).join(found, ["host_hash", "doc_hash"], "left").where("kept IS NULL OR kept")
    fixed = rest.select("row", F.when(F.col("common").isNotNull(), _without(F.col(f"row.`{text}`").cast("string"), F.col("common"))).alias("fixed"))
    columns = [F.coalesce(F.col("fixed"), F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return pack.where(~touched).select("row.*").union(fixed.select(*columns))
