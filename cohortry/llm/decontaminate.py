"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into overlapping passages of TF-IDF weights over hashed terms; term weights come from the
document frequencies of the whole corpus. A randomised SVD of the passage matrix, whose products are summed over Spark
tasks, gives a latent basis of fixed size (terms x rank). Every window of every document is projected into it, compared
with all passages by cosine, and each candidate is checked exactly: the longest common subsequence of the item's words
with the words around the window, and, for paraphrases that keep only part of the item, the same for the item's answer
(its last words).

Windows have the length class of the items that they are compared with (32, 16 or 8 words), so that a short item is not
diluted by its neighbours; all classes add up the same sums of a quarter block. Documents are only scanned, never
shuffled. The cosine is one over the benchmark's terms, so rare or foreign words around an item don't weigh; only windows
without any benchmark term are skipped. Of the candidates, those are aligned whose surroundings hold as many words of the
item as an alignment needs: first counted in blocks of words, then by the item's positions. Both are upper bounds of the
alignment, so they lose nothing. Items are the stated query set; they are broadcast in blocks of ``block_items``. Sums of
counters and matrix products have a fixed size for every task.

Defined results: NULL or empty documents hold no leak. Items that are NULL or have fewer than ``least_words`` words are too
short to tell a leak and are not searched. Repeated items are searched once; an item and a document are reported once,
with their best alignment. A NULL doc_id or item_id is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import column_sums
from cohortry.llm.words import WordHasher, text_buffers

LEAKS = "array<struct<item_id: long, cosine: double, lcs_words: int, item_words: int, answer_words: int>>"
_BOUND, _BOUND_CELLS = 8, 1 << 23  # words of a block, and counts held at once, when words of items are counted
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_words", pa.int32()),
                             ("item_words", pa.int32()), ("answer_words", pa.int32())]))


@dataclass(frozen=True)
class LeakParameters:
    """``block`` words (a multiple of four) make half a window of the largest class; passages start every ``step`` words. ``cosine`` is the
    least cosine of a window and a passage. An alignment of ``sure`` of the item's words is a
    leak; from ``possible`` on it is one if ``answered`` of the last ``answer`` words are aligned as well."""

    log2_terms: int = 16
    rank: int = 128
    extra: int = 8
    block: int = 16
    step: int = 8
    cosine: float = 0.45
    least_words: int = 8
    sure: float = 0.75
    possible: float = 0.5
    answer: int = 8
    answered: float = 0.6
    block_items: int = 4096


@dataclass(frozen=True)
class LatentIndex:
    """Term weights, the latent basis (its rows are the terms that occur in the benchmark, in order), which terms these are,
    and the item blocks (ids and word hashes)."""

    weights: np.ndarray
    basis: np.ndarray
    inside: np.ndarray
    blocks: list[list[tuple[int | None, np.ndarray]]]
    parameters: LeakParameters


def _word_lists(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    hasher = WordHasher()
    for batch in batches:
        for row, data, offsets in text_buffers(batch.column(name)):
            words, first = hasher.words(data, offsets)
            yield batch, row, [words[a:b] for a, b in zip(first[:-1], first[1:])]


def _document_frequencies(p: LeakParameters):
    """Per task, in how many documents each hashed term occurs; the last entry counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        terms = 1 << p.log2_terms
        out = np.zeros(terms + 1, np.float64)
        for _, _, lists in _word_lists(batches):
            found = [np.unique(words & np.uint64(terms - 1)) for words in lists if len(words)]
            out[terms] += len(lists)
            if found:
                out[:terms] += np.bincount(np.concatenate(found).astype(np.int64), minlength=terms)
        yield out

    return run


def passages(words: np.ndarray, p: LeakParameters) -> list[np.ndarray]:
    """Overlapping runs of two blocks of words."""
    size = 2 * p.block
    if len(words) <= size:
        return [words]
    starts = [*range(0, len(words) - size, p.step), len(words) - size]
    return [words[s:s + size] for s in starts]


def window_size(words: int, p: LeakParameters) -> int:
    """The length of the windows that are compared with an item: the least class that it doesn't exceed by half."""
    return next((size for size in (p.block // 2, p.block) if 2 * words < 3 * size), 2 * p.block)


def _matrix(lists: list[np.ndarray], weights: np.ndarray, p: LeakParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages' TF-IDF rows of unit length: row numbers, terms and values of the entries."""
    rows, terms, values = [], [], []
    for words in lists:
        if len(words) < p.least_words:
            continue
        for passage in passages(words, p):
            term, count = np.unique((passage & np.uint64(len(weights) - 1)).astype(np.int64), return_counts=True)
            value = weights[term] * count
            norm = np.sqrt((value ** 2).sum())
            rows.append(np.full(len(term), len(rows)))
            terms.append(term)
            values.append(value / norm if norm else value)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(values)


def _times(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sparse rows times a dense basis; entries are in row order."""
    if not len(rows):
        return np.zeros((0, basis.shape[1]))
    return np.add.reduceat(basis[terms] * values[:, None], np.flatnonzero(np.append(True, rows[1:] != rows[:-1])), axis=0)


def _products(p: LeakParameters, weights, place, basis, small: bool):
    """Per task, A'(A Q) of its passages A, or (A Q)'(A Q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        q = basis.value
        out = np.zeros((q.shape[1], q.shape[1]) if small else q.shape)
        for _, _, lists in _word_lists(batches):
            rows, terms, values = _matrix(lists, weights.value, p)
            terms = place.value[terms]
            y = _times(rows, terms, values, q)
            if small:
                out += y.T @ y
            else:
                order = np.argsort(terms, kind="stable")
                held = terms[order]
                first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else held
                if len(held):
                    out[held[first]] += np.add.reduceat(y[rows[order]] * values[order, None], first, axis=0)
        yield out.ravel()

    return run


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, by way of their small Gram matrix, twice for precision;
    directions without weight are left out."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(z.T @ z)
        strong = values > 1e-9 * max(values.max(), 1e-30)
        if not strong.any():  # no passages
            return np.zeros((len(z), 1), np.float32)
        z = z @ (vectors[:, strong] / np.sqrt(values[strong])).astype(np.float32)
    return z


def randomised_basis(items: DataFrame, weights: np.ndarray, inside: np.ndarray, p: LeakParameters) -> np.ndarray:
    """The leading right singular vectors (terms of the benchmark x rank) of the passage matrix: a random start, one power
    step, and an eigenproblem of the small matrix. Tasks hold their passages; only sums of bounded size leave them."""
    context = items.sparkSession.sparkContext
    place = np.where(inside, np.cumsum(inside) - 1, 0).astype(np.int64)
    held, places = context.broadcast(weights), context.broadcast(place)
    q = np.random.default_rng(20).standard_normal((max(1, int(inside.sum())), p.rank + p.extra)).astype(np.float32)
    for _ in range(2):
        q = _orthonormal(column_sums(items, _products(p, held, places, context.broadcast(q), False), q.size, np.float32).reshape(q.shape))
    gram = column_sums(items, _products(p, held, places, context.broadcast(q), True), q.shape[1] ** 2).reshape(q.shape[1], -1)
    values, vectors = np.linalg.eigh(gram)
    strong = np.argsort(values)[::-1][:p.rank]
    return (q @ vectors[:, strong]).astype(np.float32)


def build_index(docs: DataFrame, benchmark: DataFrame, parameters: LeakParameters | None = None) -> LatentIndex:
    """Weigh terms over all documents (column text) and index the benchmark (columns item_id, text)."""
    p = parameters or LeakParameters()
    terms = 1 << p.log2_terms
    counts = column_sums(docs.select(F.col("text").cast("string").alias("text")), _document_frequencies(p), terms + 1)
    weights = np.log((counts[terms] + 1) / (counts[:terms] + 1)).clip(0).astype(np.float32) + np.float32(0.01)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text IS NOT NULL").distinct()
    inside = np.zeros(terms, bool)
    blocks = []
    n_blocks = -(-items.count() // p.block_items)
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        got = part.toArrow().combine_chunks()
        block = []
        for batch, row, lists in _word_lists(iter(got.to_batches())):
            ids = batch.column("item_id").slice(row, len(lists)).to_pylist()
            block += [(i, words) for i, words in zip(ids, lists) if len(words) >= p.least_words]
        for _, words in block:
            inside[(words & np.uint64(terms - 1)).astype(np.int64)] = True
        blocks.append(block)
    return LatentIndex(weights, randomised_basis(items, weights, inside, p), inside, blocks, p)


def common_words(item: np.ndarray, region: np.ndarray) -> int:
    """The length of the longest common subsequence, with the item's positions as bits of one integer."""
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    left = full
    for word in region.tolist():
        hit = left & places.get(word, 0)
        if hit:
            left = ((left + hit) | (left - hit)) & full
    return len(item) - left.bit_count()


@dataclass(frozen=True)
class Searched:
    """A block of items as workers search for it.

    ``place`` gives the row of an inside term in ``basis``, whose rows are weighted, and -1, the last row, which is zero, for
    other terms. ``vocabulary``
    holds the items' words; ``keys`` (item, word) and ``masks``, the positions of the word in the item as bits, are sorted
    for lookups. Items of more than 64 words have no masks. ``classes`` has the length of windows, and the latent passages
    and their items, of each length class.
    """

    weights: np.ndarray
    place: np.ndarray
    basis: np.ndarray
    items: list[tuple[int | None, np.ndarray]]
    classes: list[tuple[int, np.ndarray, np.ndarray]]
    vocabulary: np.ndarray
    keys: np.ndarray
    masks: np.ndarray

    @classmethod
    def of(cls, index: LatentIndex, items: list[tuple[int | None, np.ndarray]]) -> Searched:
        p, terms = index.parameters, np.flatnonzero(index.inside)
        rows, columns, values = _matrix([words for _, words in items], index.weights, p)
        place = np.full(len(index.weights), -1, np.int32)
        place[terms] = np.arange(len(terms))
        latent = _times(rows, place[columns], values, index.basis).astype(np.float32)
        latent /= np.maximum(np.sqrt((latent ** 2).sum(axis=1, keepdims=True)), 1e-12)
        every = [words for _, words in items]
        vocabulary = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        masks: dict[int, int] = {}
        for i, words in enumerate(every):
            if len(words) <= 64:
                for k, w in enumerate(np.searchsorted(vocabulary, words).tolist()):
                    masks[i * len(vocabulary) + w] = masks.get(i * len(vocabulary) + w, 0) | 1 << k
        keys = np.array(sorted(masks), np.int64)
        owner = np.array([i for i, words in enumerate(every) for _ in passages(words, p)], np.int64)
        sizes = np.array([window_size(len(words), p) for words in every], np.int64)[owner]
        classes = [(int(size), latent[sizes == size], owner[sizes == size]) for size in np.unique(sizes)]
        basis = np.zeros((len(terms) + 1, index.basis.shape[1]), np.float32)
        basis[:-1] = index.basis[:len(terms)] * index.weights[terms, None]
        return cls(index.weights, place, basis, items, classes, vocabulary,
                   keys, np.array([masks[k] for k in keys.tolist()], np.uint64))

    def word_numbers(self, words: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, -1 if it is in no item; ``inside`` tells which can be."""
        out = np.full(len(words), -1, np.int64)
        some = np.flatnonzero(inside)
        at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == words[some], at, -1)
        return out

    def may_align(self, numbers: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each region holds ``least`` words of its item, counted in whole blocks of ``_BOUND`` words around it."""
        out = np.zeros(len(item), bool)
        blocks = -(-len(numbers) // _BOUND)
        padded = np.full(blocks * _BOUND, -1, np.int64)
        padded[:len(numbers)] = numbers
        a, b = low // _BOUND, -(-high // _BOUND)
        n, words = len(self.vocabulary), [np.unique(np.searchsorted(self.vocabulary, w)) for _, w in self.items]
        step = max(1, _BOUND_CELLS // blocks)  # items counted at once, so that long texts take no more memory
        for start in range(0, len(self.items), step):
            some = np.flatnonzero((item >= start) & (item < start + step))
            if not len(some):
                continue
            group = words[start:start + step]
            member = np.zeros((n + 1, len(group)), np.uint8)  # the last row is that of foreign words
            for k, own in enumerate(group):
                member[own, k] = 1
            counts = np.zeros((blocks, len(group)), np.uint8)
            for k in range(_BOUND):
                counts += member[padded[k::_BOUND]]
            total = np.zeros((blocks + 1, len(group)), np.int32)
            np.cumsum(counts, axis=0, out=total[1:])
            column = item[some] - start
            out[some] = total[b[some], column] - total[a[some], column] >= least[some]
        return out

    def common_lengths(self, words: np.ndarray, numbers: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray,
                       least: np.ndarray) -> np.ndarray:
        """``common_words`` of many items and regions at once: one step a word of the region, over all of them.
        Zero where fewer than ``least`` positions of the item have their word in the region."""
        sizes = self.sizes()[item]
        out = np.zeros(len(item), np.int64)
        for k in np.flatnonzero(sizes > 64).tolist():
            out[k] = common_words(self.items[item[k]][1], words[low[k]:high[k]])
        short = np.flatnonzero(sizes <= 64)
        short = short[np.argsort((high - low)[short], kind="stable")]
        for at in range(0, len(short), 4096):
            some = short[at:at + 4096]
            mask = self._masks(numbers, item[some], low[some], high[some])
            enough = np.bitwise_count(np.bitwise_or.reduce(mask, axis=1)) >= least[some]
            some, mask = some[enough], mask[enough]
            full = (np.uint64(2) << (sizes[some] - 1).astype(np.uint64)) - np.uint64(1)
            left = full.copy()
            for j in range(mask.shape[1]):
                hit = left & mask[:, j]
                left = ((left + hit) | (left - hit)) & full
            out[some] = sizes[some] - np.bitwise_count(left)
        return out

    def _masks(self, numbers: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The positions in its item of each word of each region, one row a region."""
        where = low[:, None] + np.arange((high - low).max())
        number = np.where(where < high[:, None], numbers[np.minimum(where, len(numbers) - 1)], -1)
        cell = np.flatnonzero(number >= 0)
        key = item[cell // number.shape[1]] * len(self.vocabulary) + number.ravel()[cell]
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        mask = np.zeros(number.size, np.uint64)
        mask[cell] = np.where(self.keys[spot] == key, self.masks[spot], np.uint64(0))
        return mask.reshape(number.shape)

    def sizes(self) -> np.ndarray:
        """The words of each item."""
        return np.array([len(words) for _, words in self.items], np.int64)


def leaks(index: LatentIndex, block: int, docs: DataFrame, text: str = "text") -> Column:
    """The items of one block that each text leaks, as an array column."""
    p = index.parameters
    held = docs.sparkSession.sparkContext.broadcast(astuple_shallow(Searched.of(index, index.blocks[block])))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searched, hasher = Searched(*held.value), WordHasher()
        for column in columns:
            out: list[list] = [[] for _ in range(len(column))]
            for row, data, offsets in text_buffers(column):
                words, first = hasher.words(data, offsets)
                for text_no, found in _leaks_of(words, first, searched, p):
                    out[row + text_no] = found
            yield pa.array(out, _LEAKS)

    return F.arrow_udf(run, LEAKS)(F.col(text).cast("string"))


def astuple_shallow(value) -> tuple:
    """The fields of a dataclass; a broadcast value must not need its class to be importable."""
    return tuple(getattr(value, name) for name in value.__dataclass_fields__)


def _near(first: np.ndarray, place_of: np.ndarray, m: Searched, p: LeakParameters) -> tuple[np.ndarray, ...]:
    """The windows close to a passage of their length class: text, start and length of each, the passage's item and cosine."""
    quarter = p.block // 4
    held = -(-np.diff(first) // p.block)
    owner = np.repeat(np.arange(len(held)), held)  # the text of each block
    at = p.block * (np.cumsum(held) - held)  # the place of each text's first word when its last block is filled up
    places = np.full(p.block * len(owner), -1, np.int32)
    places[np.arange(len(place_of)) + np.repeat(at - first[:-1], np.diff(first))] = place_of
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.float32),)]
    for low in range(0, len(owner), 1024):
        high = min(low + 1024, len(owner))
        some = places[p.block * low:p.block * (high + 1)]  # and the block that the last window ends in
        sums = np.zeros((len(some) // quarter, m.basis.shape[1]), np.float32)
        for k in range(quarter):
            sums += m.basis[some[k::quarter]]
        for size, latent, owners in m.classes:
            step = size // 2
            blocks = sums.reshape(-1, step // quarter, sums.shape[1]).sum(axis=1)
            text = np.repeat(owner[low:high + 1], p.block // step)
            n = (high - low) * p.block // step
            vectors = blocks[:n].copy()
            joined = np.flatnonzero(text[1:] == text[:-1])
            joined = joined[joined < n]
            vectors[joined] += blocks[joined + 1]
            length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            full = np.flatnonzero(length > 0)
            cosine = (vectors[full] / length[full, None]) @ latent.T
            cell = np.flatnonzero(cosine >= p.cosine)
            w, c = full[cell // len(latent)], cell % len(latent)
            t = text[w]
            found.append((t, first[t] + p.block * low + step * w - at[t], np.full(len(w), size), owners[c], cosine.ravel()[cell]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _leaks_of(words: np.ndarray, first: np.ndarray, m: Searched, p: LeakParameters) -> Iterator[tuple[int, list]]:
    """The leaks of each text of a buffer."""
    if not len(words) or not m.classes:
        return
    place_of = m.place[(words & np.uint64(len(m.weights) - 1)).astype(np.int64)]
    numbers = m.word_numbers(words, place_of >= 0)
    text, start, width, item, close = _near(first, place_of, m, p)
    sizes = m.sizes()[item]
    low = np.maximum(first[text], start - sizes)
    high = np.minimum(first[text + 1], start + width + sizes)
    some = np.flatnonzero(m.may_align(numbers, item, low, high, p.possible * sizes))
    some = some[np.lexsort((-close[some], item[some], start[some]))]  # of an item's passages the closest
    same = (start[some[1:]] == start[some[:-1]]) & (item[some[1:]] == item[some[:-1]])
    some = some[np.append(True, ~same)[:len(some)]]
    text, item, close, sizes, low, high = (x[some] for x in (text, item, close, sizes, low, high))
    got = m.common_lengths(words, numbers, item, low, high, p.possible * sizes)
    best: dict[tuple[int, int], tuple] = {}
    for k in np.flatnonzero(got >= p.possible * sizes).tolist():
        tail = m.items[item[k]][1][-p.answer:]
        answer = common_words(tail, words[low[k]:high[k]])
        if got[k] >= p.sure * sizes[k] or answer >= p.answered * len(tail):
            key = int(text[k]), int(item[k])
            best[key] = max(best.get(key, ()), (int(got[k]), float(close[k]), answer))
    found: dict[int, list] = {}
    for (t, i), (common, cosine, answer) in sorted(best.items()):
        item_id, item_words = m.items[i]
        found.setdefault(t, []).append({"item_id": item_id, "cosine": round(cosine, 4), "lcs_words": common,
                                        "item_words": len(item_words), "answer_words": answer})
    yield from found.items()


def find_leaks(docs: DataFrame, benchmark: DataFrame, parameters: LeakParameters | None = None) -> DataFrame:
    """One row per document and leaked item: ``doc_id, item_id, cosine, lcs_words, item_words, answer_words``."""
    texts = docs.select("doc_id", "text")
    index = build_index(texts, benchmark, parameters)
    parts = [texts.select("doc_id", F.explode(leaks(index, k, texts)).alias("leak")).select("doc_id", "leak.*")
             for k in range(len(index.blocks))]
    if not parts:
        return texts.where("false").select("doc_id", F.explode(F.lit(None).cast(LEAKS)).alias("leak")).select("doc_id", "leak.*")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, parameters: LeakParameters | None = None) -> DataFrame:
    """The documents, with all their columns, that leak no item."""
    index = build_index(docs, benchmark, parameters)
    for k in range(len(index.blocks)):
        docs = docs.where(F.size(leaks(index, k, docs)) == 0)
    return docs
