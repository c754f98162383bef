"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: every slot is a bitmask with one bit a language, and the
AND of an n-gram's slots gives all languages that contain it at once. A text's n-grams are looked up, the bits are
counted per language, each count is corrected for the false positives that the fill of that language's slice predicts,
and the language that explains most n-grams wins; ties go to the language with more training n-grams, then by name.

N-grams are 3 and 4 bytes of lower-cased words with their borders; anything but letters and bytes from 0x80 is a border.
A language contains an n-gram if at least ``least_rate`` of its n-grams are that one and its rate is not below ``share``
of the highest rate any language has; so a language contributes at most ``1 / least_rate`` n-grams whatever the corpus,
and the filter, of fixed size, is all that is broadcast. Counting covers all training texts and is aggregated per task
before it is shuffled.

Defined results: a text that is NULL or has no letter is ``und`` with score 0. Without training texts every text is
``und``. A text of which no n-gram is known gets the language with most training n-grams and score 0. Rows that repeat
train and are predicted each. A text of any length is taken whole; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored, work_folder
from cohortry.llm.words import mix, text_buffers

UNKNOWN = "und"
_SIZES = (3, 4)


@dataclass(frozen=True)
class FilterParameters:
    """``log2_slots`` and ``hashes`` shape the filter; ``least_rate`` and ``share`` say when a language contains an n-gram."""

    log2_slots: int = 21
    hashes: int = 2
    least_rate: float = 2e-6
    share: float = 0.2


@dataclass(frozen=True)
class LanguageFilter:
    """Languages in order of preference on ties, slots as rows of 64-bit words, and the false-positive rate of each language."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    hashes: int


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of some texts, and the text each belongs to."""
    fold = np.zeros(256, np.uint8)
    for first in (0x41, 0x61):
        fold[first:first + 26] = np.arange(0x61, 0x7B)
    fold[0x80:] = np.arange(0x80, 0x100)
    lengths = np.diff(offsets)
    letters = np.insert(fold[data], offsets[:-1], 0)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0
    keep[:1] = True  # the border before the first text, whichever text a slice begins with
    letters, owner = np.append(letters[keep], np.uint8(0)), np.append(owner[keep], np.int32(0))
    codes, texts = [], []
    inner = letters != 0
    for size in _SIZES:
        n = len(letters) - size + 1
        if n <= 0:
            continue
        whole = inner[1:n + 1].copy()
        for k in range(2, size - 1):
            whole &= inner[k:n + k]
        code = np.full(n, size << 40, np.uint64)
        for k in range(size):
            code |= letters[k:n + k].astype(np.uint64) << np.uint64(8 * k)
        codes.append(code[whole])
        texts.append(owner[1:n + 1][whole])
    return (np.concatenate(codes), np.concatenate(texts)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal codes."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count[order], first) if len(first) else count


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram counts of each language in a task's texts."""
    held: dict[str, tuple[list, list]] = {}

    def rows(name: str) -> pa.RecordBatch:
        code, count = _counted(*held[name])
        return pa.record_batch([pa.array([name] * len(code)), pa.array(code.astype(np.int64)), pa.array(count)],
                               ["language", "ngram", "c"])

    for batch in batches:
        languages = np.array(batch.column("lang").to_pylist(), object)
        for row, data, offsets in text_buffers(batch.column("text")):
            code, text = ngrams(data, offsets)
            names = languages[row:row + len(offsets) - 1]
            for name in set(names):
                chosen = np.sort(code[(names == name)[text]])
                first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(chosen) else np.zeros(0, np.int64)
                codes, counts = held.setdefault(name, ([], []))
                codes.append(chosen[first])
                counts.append(np.diff(np.append(first, len(chosen))))
                if sum(map(len, codes)) > 1 << 20:
                    merged = _counted(codes, counts)
                    held[name] = ([merged[0]], [merged[1]])
                    if len(merged[0]) > 1 << 19:
                        yield rows(name)
                        del held[name]
    for name in held:
        yield rows(name)


def fit(texts: DataFrame, parameters: FilterParameters | None = None) -> LanguageFilter:
    """Build the filter from the columns text and lang; rows with a NULL in either are left out."""
    p = parameters or FilterParameters()
    spark = texts.sparkSession
    rows = texts.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    counts = stored(
        rows.mapInArrow(_count_ngrams, "language string, ngram long, c long").groupBy("language", "ngram").agg(F.sum("c").alias("c")),
        f"{work_folder(spark)}/ngrams",
    )
    totals = counts.groupBy("language").agg(F.sum("c").alias("total"))
    languages = [r.language for r in totals.orderBy(F.desc("total"), "language").collect()]
    words = max(1, -(-len(languages) // 64))
    slots = np.zeros((1 << p.log2_slots, words), np.uint64)
    if not languages:
        return LanguageFilter([], slots, np.zeros(0), p.hashes)

    rates = counts.join(F.broadcast(totals), "language").withColumn("rate", F.col("c") / F.col("total"))
    highest = rates.groupBy("ngram").agg(F.max("rate").alias("highest"), F.collect_list(F.struct("language", "rate")).alias("all"))
    kept = (
        highest.select("ngram", "highest", F.explode("all").alias("one"))
        .where((F.col("one.rate") >= p.least_rate) & (F.col("one.rate") >= p.share * F.col("highest")))
        .select("ngram", F.col("one.language").alias("language"))
    )
    index = {name: i for i, name in enumerate(languages)}

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([index[x] for x in batch.column("language").to_pylist()], np.int64)
            places = slot_numbers(batch.column("ngram").to_numpy().astype(np.uint64), p.hashes, p.log2_slots)
            bits = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            for place in places:
                yield pa.record_batch([pa.array(place), pa.array(at // 64), pa.array(bits)], ["slot", "word", "bits"])

    got = kept.mapInArrow(marks, "slot long, word long, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots[got["slot"].to_numpy(), got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    fill = np.array([(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageFilter(languages, slots, np.minimum(fill ** p.hashes, 0.999), p.hashes)


def slot_numbers(codes: np.ndarray, hashes: int, log2_slots: int) -> list[np.ndarray]:
    """The slots of each n-gram."""
    h, out = mix(codes), []
    for _ in range(hashes):
        out.append((h >> np.uint64(64 - log2_slots)).astype(np.int64))
        h = mix(h)
    return out


def explained(data: np.ndarray, offsets: np.ndarray, model: LanguageFilter) -> np.ndarray:
    """For each text and language, the share of n-grams that the language explains beyond false positives."""
    n, log2_slots = len(offsets) - 1, len(model.slots).bit_length() - 1
    code, text = ngrams(data, offsets)
    masks = None
    for place in slot_numbers(code, model.hashes, log2_slots):
        masks = model.slots[place] if masks is None else masks & model.slots[place]
    total = np.bincount(text, minlength=n)
    out = np.zeros((n, len(model.languages)))
    for i, rate in enumerate(model.false_rate):
        hits = np.bincount(text, weights=(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=n)
        out[:, i] = (hits - total * rate) / ((1 - rate) * np.maximum(total, 1))
    return np.clip(out, 0, 1)


def predicted(docs: DataFrame, model: LanguageFilter, text: str = "text") -> Column:
    """A struct column ``language, score`` for a column of texts."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.false_rate, model.hashes))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = LanguageFilter(*held.value)
        names = np.array([*known.languages, UNKNOWN], object)
        for column in columns:
            best, score = np.full(len(column), len(names) - 1), np.zeros(len(column))
            if known.languages:
                for row, data, offsets in text_buffers(column):
                    part = explained(data, offsets, known)
                    at = part.argmax(axis=1)
                    best[row:row + len(at)], score[row:row + len(at)] = at, part[np.arange(len(at)), at]
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["language", "score"])

    guess = F.arrow_udf(run, "language string, score double")(F.col(text).cast("string"))
    nothing = F.struct(F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("score"))
    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    return F.when(letters, guess).otherwise(nothing)


def held_out(fold: int, remainder: int, key: str = "doc_id") -> Column:
    """Rows outside the training folds by the checksum of their id; a NULL id is never trained on."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % fold == remainder, F.lit(True))
