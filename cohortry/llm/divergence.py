"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Terms are maximal runs of letters and of characters beyond ASCII, A-Z lower-cased. Each language keeps the terms that
occur in ``least_documents`` of its documents. Every (language, source) group and every language gives a kept term the
share 1 + floor(scale * (count + added) / (N + added * V)), in whole numbers; N is the sum of the counts, V the number of
kept terms. ``pairs`` sums the differences of two sources over all kept terms, ``typical`` lists the terms that a source
has more of than its language.

* Length-bucketed packing. Terms of up to 8 bytes are one uint64, of up to 16 bytes two, big end first; both kinds are
  radix-sorted by 16-bit digits (stable, so documents stay in order) and run-counted in numpy. Longer terms go to buckets
  of widths 32, 64, 128, ... bytes, sorted as bytes. Counts of many slices are merged before a task emits them, so a source
  with a third of all rows sends one row per term and task.
* Two scans. The first counts the documents of each (language, term), the second the occurrences in each (language, source),
  of kept terms only: a bitmap sized by the number of kept terms thins out the rows, a join on (language, term) decides.
* Pairs. Sources and terms are dealt into blocks of bounded size; a task holds the shares of two blocks of sources for one
  block of terms. Terms that neither source has need no row: they differ by the difference of the empty shares. A language
  with few sources has one block of them, and nothing is copied. The result itself has a row for every pair.

Defined results: NULL text, language and source read as ''. A document without terms still makes its group occur. Every row
is a document, repeated ones too. A language without kept terms has pairs of value 0 and no typical terms. Equal values are
ranked by item in byte order. Texts and terms of any length are taken whole. An empty table gives an empty result. Only the
three named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import presence_bits, present, stored, work_folder
from cohortry.llm.words import WordHasher, mix, odd_factor, text_buffers

#: Bytes that no term has.
_GAPS = [*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: The first n of eight bytes, big end first.
_FIRST = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(9)], np.uint64)


@dataclass(frozen=True)
class AuditParameters:
    """``sources_per_block`` and ``terms_per_block`` bound a task's memory and change no result."""

    least_documents: int = 30
    added: int = 5
    scale: int = 1_000_000_000
    top: int = 50
    sources_per_block: int = 256
    terms_per_block: int = 1024


def radix_order(*words: np.ndarray) -> np.ndarray:
    """The stable order of rows of uint64 words, the first word counting most, by 16-bit digits."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


class TermPacker:
    """Finds the terms of byte buffers and packs them by length."""

    def __init__(self) -> None:
        self.reader = WordHasher()
        self.reader.space[:] = False
        self.reader.space[_GAPS] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 32

    def terms(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each term."""
        starts, ends, first = self.reader.spans(data, offsets)
        return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first))

    def packed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length class that occurs: which terms it has, and their words (rows of one, two, four, ... uint64)."""
        lengths = ends - starts
        wide = np.concatenate([self.lower[data], np.zeros(16, np.uint8)])
        at = np.ndarray((len(data) + 9,), ">u8", wide, strides=(1,))
        short = np.flatnonzero(lengths <= 8)
        if len(short):
            yield short, (at[starts[short]].astype(np.uint64) & _FIRST[lengths[short]])[:, None]
        middle = np.flatnonzero((lengths > 8) & (lengths <= 16))
        if len(middle):
            s = starts[middle]
            yield middle, np.stack([at[s].astype(np.uint64), at[s + 8].astype(np.uint64) & _FIRST[lengths[middle] - 8]], axis=1)
        width = 32
        while width < 2 * (lengths.max() if len(lengths) else 0):
            some = np.flatnonzero((lengths > width // 2) & (lengths <= width))
            if len(some):
                rows = np.zeros((len(some), width), np.uint8)
                for k, i in enumerate(some.tolist()):
                    rows[k, :lengths[i]] = wide[starts[i]:ends[i]]
                yield some, rows.view(">u8").astype(np.uint64)
            width *= 2


def term_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each packed term, the same whatever the width it is packed in."""
    total = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        total += words[:, k] * odd_factor(k)
    return mix(total)


def _sorted_order(words: np.ndarray) -> np.ndarray:
    if words.shape[1] <= 2:
        return radix_order(*words.T)
    rows = np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}").ravel()
    return np.argsort(rows, kind="stable")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= (c[1:] != c[:-1]) if c.ndim == 1 else (c[1:] != c[:-1]).any(axis=1)
    return new


def _summed(words: np.ndarray, group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each term and group."""
    order = np.argsort(group, kind="stable")
    order = order[_sorted_order(words[order])]
    words, group, n = words[order], group[order], n[order]
    at = np.flatnonzero(_changes(words, group))
    return words[at], group[at], np.add.reduceat(n, at) if len(at) else n


def _strings(words: np.ndarray) -> pa.Array:
    """Packed terms as strings."""
    raw = np.ascontiguousarray(words.astype(">u8")).view(np.uint8).reshape(len(words), -1)
    used = raw != 0
    offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(raw[used]))


class _Tally:
    """The counts of a task by length class, merged when they have grown."""

    def __init__(self, limit: int = 1 << 19) -> None:
        self.limit, self.held = limit, {}

    def add(self, words: np.ndarray, group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Take rows in; returns rows to emit where too many have gathered."""
        size, parts = self.held.setdefault(words.shape[1], [0, []])
        parts.append((words, group, n))
        self.held[words.shape[1]][0] = size + len(n)
        if words.size + size * words.shape[1] < 2 * self.limit:
            return None
        merged = _summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        self.held[words.shape[1]] = [len(merged[2]), [merged]]
        if merged[0].size < self.limit:
            return None
        return self.held.pop(words.shape[1])[1][0]

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, parts in self.held.values():
            yield _summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        self.held = {}


def term_counts(docs: DataFrame, by: list[str], documents: bool, bits: np.ndarray | None = None, slice_bytes: int = 1 << 21) -> DataFrame:
    """(the columns of ``by``, term, n): documents with a term, or its occurrences; one row per task, group and term.

    With ``bits`` only terms with their bit set are counted.
    """
    held_bits = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tally, codes = TermPacker(), _Tally(), {}

        def emitted(words: np.ndarray, group: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            names = [pa.array([key[k] for key in codes], pa.string()).take(pa.array(group)) for k in range(len(by))]
            return pa.RecordBatch.from_arrays([*names, _strings(words), pa.array(n)], [*by, "term", "n"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in by])
            group_of = np.array([codes.setdefault(k, len(codes)) for k in keys], np.int64)
            for row, data, offsets in text_buffers(batch.column("text"), slice_bytes):
                starts, ends, text = packer.terms(data, offsets)
                for which, words in packer.packed(data, starts, ends):
                    order = _sorted_order(words)
                    words, doc = words[order], text[which][order]
                    at = np.flatnonzero(_changes(words, doc))
                    n = np.ones(len(at), np.int64) if documents else np.diff(np.append(at, len(doc)))
                    words, group = words[at], group_of[row + doc[at]]
                    if held_bits.value is not None:
                        good = present(held_bits.value, term_hashes(words))
                        words, group, n = words[good], group[good], n[good]
                    full = tally.add(*_summed(words, group, n)) if len(n) else None
                    if full is not None:
                        yield emitted(*full)
        for full in tally.rest():
            yield emitted(*full)

    schema = "".join(f"`{c}` string, " for c in by) + "term string, n long"
    return docs.select(*by, "text").mapInArrow(run, schema)


def _hash_of(term: Column) -> Column:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = TermPacker()
        for column in columns:
            out = np.zeros(len(column), np.uint64)
            for row, data, offsets in text_buffers(column):
                for which, words in packer.packed(data, offsets[:-1], offsets[1:]):
                    out[row + which] = term_hashes(words)
            yield pa.array(out.view(np.int64))

    return F.arrow_udf(run, "long")(term)


@dataclass(frozen=True)
class Shares:
    """``cells``: lang, source, term, n, share, lang_share of each term that a source has; ``groups``: lang, source, empty
    (the share of a term that it doesn't have), terms (V of the language), sources (of the language)."""

    cells: DataFrame
    groups: DataFrame
    parameters: AuditParameters


def shares(docs: DataFrame, parameters: AuditParameters | None = None, lang: str = "lang", source: str = "source", text: str = "text") -> Shares:
    """Count the terms of all documents and give each group and language its shares."""
    p = parameters or AuditParameters()
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    folder = work_folder(docs.sparkSession)
    kept = term_counts(docs, ["lang"], True).groupBy("lang", "term").agg(F.sum("n").alias("documents"))
    kept = stored(kept.where(F.col("documents") >= p.least_documents).select("lang", "term"), f"{folder}/kept")
    log2_bits = min(28, max(20, math.ceil(math.log2(kept.count() + 1)) + 5))
    bits = presence_bits(kept.select(_hash_of(F.col("term")).alias("h")), log2_bits)
    counts = term_counts(docs, ["lang", "source"], False, bits).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = counts.join(kept, ["lang", "term"]).withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term")))
    counts = stored(counts, f"{folder}/counts")
    groups = docs.select("lang", "source").distinct().join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").fillna(0, ["size"])
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").fillna(0, ["terms"])
    groups = groups.join(langs, "lang")

    def share(n: str, size: str) -> Column:
        return F.expr(f"1 + (cast({n} + {p.added} as decimal(20, 0)) * {p.scale}) div nullif(cast({size} as decimal(20, 0)) + {p.added} * terms, 0)")

    groups = stored(groups.withColumn("empty", F.coalesce(share("0L", "size"), F.lit(0))), f"{folder}/groups")
    cells = counts.join(groups, ["lang", "source"]).withColumn("share", share("n", "size")).withColumn("lang_share", share("lang_n", "lang_size"))
    return Shares(stored(cells.select("lang", "source", "term", "n", "share", "lang_share"), f"{folder}/cells"),
                  groups.select("lang", "source", "empty", "terms", "sources"), p)


def typical(found: Shares) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has more of than its language, the ``top`` of each."""
    more = found.cells.where("share > lang_share").select("lang", "source", F.col("term").alias("item"), F.expr("share - lang_share").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= found.parameters.top)


def _distances(key: tuple, rows: pa.Table) -> pa.Table:
    """The differences of the sources of two blocks over one block of terms."""
    lang, block, low, high = (k.as_py() for k in key)
    base = rows.filter(pc.is_null(rows["term"]))
    names, tile = base["source"], base["tile"].to_numpy()
    empty, terms = base["share"].to_numpy(), base["terms"].to_numpy()
    some = rows.filter(pc.is_valid(rows["term"]))
    term = some["term"].combine_chunks().dictionary_encode() if len(some) else None
    dense = np.repeat(empty[:, None], len(term.dictionary) if term else 0, axis=1)
    if term:
        dense[pc.index_in(some["source"], names).to_numpy(), term.indices.to_numpy()] = some["share"].to_numpy()
    left, right, value = [], [], []
    for a in np.flatnonzero(tile == low).tolist():
        others = np.arange(a + 1, len(tile)) if low == high else np.flatnonzero(tile == high)
        apart = np.abs(empty[others] - empty[a])
        value.append(np.abs(dense[others] - dense[a]).sum(axis=1) + ((terms[a] if block == 0 else 0) - dense.shape[1]) * apart)
        left.append(np.full(len(others), a))
        right.append(others)
    left, right, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right, value))
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "a": names.take(pa.array(left)), "b": names.take(pa.array(right)), "value": pa.array(value)})


def pairs(found: Shares) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language by the sum of all differences of shares."""
    p = found.parameters
    tiles, blocks = F.ceil(F.col("sources") / p.sources_per_block), F.greatest(F.lit(1), F.ceil(F.col("terms") / p.terms_per_block))
    groups = found.groups.select("lang", "source", "empty", "terms", tiles.alias("tiles"), blocks.alias("blocks"),
                                 F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"))
    cells = found.cells.select("lang", "source", "term", "share").join(groups, ["lang", "source"])
    columns = ["lang", "source", "terms", "tiles", "tile", F.col("block").cast("int").alias("block"), "term", "share"]
    rows = cells.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select(*columns).union(
        groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        .withColumn("term", F.lit(None).cast("string")).withColumn("share", F.col("empty")).select(*columns))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)))
    rows = rows.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other", "tiles")
    made = rows.groupBy("lang", "block", "low", "high").applyInArrow(_distances, "lang string, a string, b string, value long")
    summed = made.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                            F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "pair.source", "pair.item", "value").withColumn("rank", F.row_number().over(order))


def audited(docs: DataFrame, parameters: AuditParameters | None = None, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Both parts in one table: lang, source, part (``pair`` or ``term``), item, value, rank."""
    found = shares(docs, parameters, lang, source, text)
    parts = [f.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, f in (("pair", pairs(found)), ("term", typical(found)))]
    return parts[0].union(parts[1])
