"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are the lower-cased words of a text and one end. The model is a set of sorted arrays in the shared folder, which
workers memory-map: the sorted 64-bit hashes of all training tokens (a token's place is its number), their counts and
continuation counts, and for each context number the sorted numbers and counts of its followers. Arrays are cut into
shards by hash, or by context number; every shard is merged and written by one task, under its final name only when it
is complete, so a repeated task changes nothing.

Counting is aggregated per task and sent in packed blocks (sorted keys as byte planes of their differences), one for each
shard; the number of shards follows the tokens. A group holds one shard, in which a context has at most as many
followers as there are distinct tokens. Scoring scans the documents once without a shuffle: numbers and follower counts
are looked up in the memory-mapped arrays by binary search.

No count and no number is cut off: a pair's key takes the bits that the number of different tokens needs, and counts that
do not fit 32 bits stand beside the others.

Where the shared folder is a mounted path the arrays are mapped in place; from other stores a worker copies a shard to an
unnamed temporary file first. Every text is counted and scored as a whole.

Defined results: NULL counts as empty; an empty text is one token, the end. Without training texts nothing is known and
every token has probability 1. Rows that repeat a document count, and are scored, each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import work_folder
from cohortry.llm.words import WordHasher, text_buffers

_END = np.uint64(0xD1B54A32D192ED03)
_PER_SHARD = 1 << 21
_SLICE = 1 << 23
#: From this count on a pair's count stands in an array of its own.
_LARGE = 0xFFFFFFFF


@dataclass(frozen=True)
class Model:
    """Where the arrays are, their shards, the training totals and the discounts of both levels (for counts 1, 2, 3+)."""

    folder: str
    hash_bits: int
    offsets: list[int]
    shards: int
    tokens: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_classes: tuple[int, int, int]
    pairs: int

    @property
    def vocabulary(self) -> int:
        return self.offsets[-1]


class Arrays:
    """Named arrays in a folder that driver and workers share."""

    def __init__(self, folder: str) -> None:
        self.store, self.path = pa.fs.FileSystem.from_uri(folder)

    def write(self, name: str, values: np.ndarray) -> None:
        """Write an array; its name appears when it is complete."""
        part = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        self.store.create_dir(self.path, recursive=True)
        with self.store.open_output_stream(part) as out:
            out.write(np.ascontiguousarray(values).tobytes())
        self.store.move(part, f"{self.path}/{name}")

    def read(self, name: str, kind: type) -> np.ndarray:
        """Memory-map an array."""
        path = f"{self.path}/{name}"
        size = self.store.get_file_info(path).size
        if not size:
            return np.zeros(0, kind)
        if isinstance(self.store, pa.fs.LocalFileSystem):
            return np.memmap(path, kind, "r")
        copy = tempfile.TemporaryFile()  # noqa: SIM115  has no name; goes with the mapping
        with self.store.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                copy.write(block)
        copy.flush()
        return np.memmap(copy, kind, "r")


def tokens_of(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of some texts, each text's words and an end, and where each text begins (one entry more)."""
    words, first = hasher.words(data, offsets)
    texts = np.arange(len(offsets))
    out = np.full(len(words) + len(offsets) - 1, _END, np.uint64)
    out[np.arange(len(words)) + np.repeat(texts[:-1], np.diff(first))] = words
    return out, first + texts


def _unique(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts as one compressed block."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    sizes = counts.astype(np.uint64).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([steps.T.ravel(), sizes.T.ravel()]).tobytes())


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a block."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    half = len(planes) // 2
    steps, sizes = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel() for x in (planes[:half], planes[half:]))
    return np.cumsum(steps, dtype=np.uint64), sizes.astype(np.int64)


class _Gatherer:
    """Counts keys and gives them out as packed blocks of shards when many are held."""

    def __init__(self, bounds: np.ndarray, first: int = 0, limit: int = 1 << 22) -> None:
        self.bounds, self.first, self.limit, self.held = bounds, first, limit, []

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(_unique(keys))
        if sum(len(k) for k, _ in self.held) > self.limit:
            self.held = [_unique(*map(np.concatenate, zip(*self.held)))]
            if len(self.held[0][0]) > self.limit * 3 // 4:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield blocks(*_unique(*map(np.concatenate, zip(*self.held))), self.bounds, self.first)
        self.held = []


def blocks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """Rows (shard, block) of sorted keys; shard first + k takes the keys from bounds[k] on."""
    at = np.append(np.searchsorted(keys, bounds), len(keys))
    rows = [(first + k, pack(keys[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "block"])


def _merged(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    parts = [unpack(x.as_py()) for x in rows.column("block")]
    keys, counts = _unique(*map(np.concatenate, zip(*parts)))
    return rows.column("shard")[0].as_py(), keys, counts


_BLOCKS = "shard int, block binary"
_STATS = "shard int, block binary, n long, total long, ones long, twos long, threes long, fours long"


def _stats(shard: int | None, counts: np.ndarray, n: int) -> pa.Table:
    """The number of keys, their total, and how many have a count of 1 to 4."""
    row = {"shard": shard, "block": None, "n": n, "total": int(counts.sum())}
    row |= {name: int((counts == k).sum()) for k, name in enumerate(("ones", "twos", "threes", "fours"), 1)}
    schema = pa.schema([("shard", pa.int32()), ("block", pa.binary()), *((c, pa.int64()) for c in ("n", "total", "ones", "twos", "threes", "fours"))])
    return pa.Table.from_pylist([row], schema)


def _count_words(hash_bits: int):
    bounds = (np.arange(1 << hash_bits, dtype=np.uint64) << np.uint64(64 - hash_bits)) if hash_bits else np.zeros(1, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, gathered = WordHasher(), _Gatherer(bounds)
        for batch in batches:
            for _, data, offsets in text_buffers(batch.column("text"), _SLICE):
                yield from gathered.add(tokens_of(hasher, data, offsets)[0])
        yield from gathered.flush()

    return run


def _write_words(folder: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(rows)
        arrays = Arrays(folder)
        arrays.write(f"word-{shard}", keys)
        arrays.write(f"count-{shard}", counts)
        return _stats(shard, counts, len(keys))

    return run


class Numbers:
    """The numbers of tokens: their places in the sorted hashes."""

    def __init__(self, folder: str, hash_bits: int, offsets: list[int]) -> None:
        self.arrays, self.bits, self.offsets = Arrays(folder), hash_bits, np.array(offsets)
        self.words = [self.arrays.read(f"word-{k}", np.uint64) if offsets[k + 1] > offsets[k] else np.zeros(0, np.uint64)
                      for k in range(len(offsets) - 1)]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is unknown."""
        numbers, back = self.distinct(hashes)
        return numbers[back]

    def distinct(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the distinct hashes, and the place of each hash among those."""
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        at = np.searchsorted(distinct, np.arange(len(self.words), dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else [0]
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(distinct)])):
            words, asked = self.words[k], distinct[a:b]
            if len(words) and b > a:
                place = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                out[a:b] = np.where(words[place] == asked, place + self.offsets[k], -1)
        return out, back


def _contexts(numbers: np.ndarray, begins: np.ndarray, begin: int) -> np.ndarray:
    """The number before each token; that of the begin at the head of a text."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[begins[:-1]] = begin
    return out


def _bounds(vocabulary: int, shards: int) -> np.ndarray:
    """The first context number of each shard; the begin has the number after the last token's."""
    return (np.arange(shards) * (vocabulary + 1)) // shards


def _number_type(vocabulary: int) -> type:
    """What holds a token's number, or a count of different tokens."""
    return np.uint32 if vocabulary < 0xFFFFFFFF else np.int64


def _pair_keys(vocabulary: int, shards: int) -> tuple[int, int]:
    """How a pair is one key of 64 bits: the bits of the token, and how many shards have contexts for the other bits.

    Contexts count from the first one of such a group of shards. Up to 2**32 different tokens all shards are one group.
    """
    bits = max(1, vocabulary.bit_length())
    room = (1 << 64 - bits) * shards // (vocabulary + 1)
    if room < 2 and shards > 1:
        raise OverflowError(f"{vocabulary} different tokens in {shards} shards are more than a pair's key can tell apart")
    return bits, min(shards, max(1, room - 1))


def _count_pairs(folder: str, hash_bits: int, offsets: list[int], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, numbers = WordHasher(), Numbers(folder, hash_bits, offsets)
        low, (bits, span) = _bounds(offsets[-1], shards), _pair_keys(offsets[-1], shards)
        firsts = range(0, shards, span)
        gathered = [_Gatherer((low[g:g + span] - low[g]).astype(np.uint64) << np.uint64(bits), g, (1 << 22) // len(firsts)) for g in firsts]
        for batch in batches:
            for _, data, texts in text_buffers(batch.column("text"), _SLICE):
                hashes, begins = tokens_of(hasher, data, texts)
                own = numbers.of(hashes)
                contexts = _contexts(own, begins, offsets[-1])
                group = np.searchsorted(low[::span], contexts, "right") - 1
                for k, held in enumerate(gathered):
                    here = group == k
                    yield from held.add((contexts[here] - low[k * span]).astype(np.uint64) << np.uint64(bits) | own[here].astype(np.uint64))
        for held in gathered:
            yield from held.flush()

    return run


def _write_pairs(folder: str, vocabulary: int, shards: int):
    """Write the followers of a shard's contexts; give its statistics, and how many contexts each token followed."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(rows)
        bounds = np.append(_bounds(vocabulary, shards), vocabulary + 1)
        low, high = bounds[shard], bounds[shard + 1]
        bits, span = _pair_keys(vocabulary, shards)
        context = (keys >> np.uint64(bits)).astype(np.int64) + bounds[shard // span * span]
        word, number = keys & np.uint64((1 << bits) - 1), _number_type(vocabulary)
        arrays = Arrays(folder)
        start = np.searchsorted(context, np.arange(low, high + 1))
        arrays.write(f"start-{shard}", start.astype(np.int64))
        arrays.write(f"follower-{shard}", word.astype(number))
        arrays.write(f"pair-{shard}", np.minimum(counts, _LARGE).astype(np.uint32))
        large = np.flatnonzero(counts >= _LARGE)  # these few counts stand beside the others
        if len(large):
            arrays.write(f"large-{shard}", np.stack([large, counts[large]]))
        place = context - low
        sums = [np.bincount(place, weights=w, minlength=high - low).astype(number)
                for w in (counts == 1, counts == 2, counts >= 3)]
        arrays.write(f"total-{shard}", np.bincount(place, weights=counts, minlength=high - low).astype(np.uint64))
        arrays.write(f"classes-{shard}", np.stack(sums, axis=1))
        made = blocks(*_unique(word), bounds[:-1].astype(np.uint64))
        out = pa.Table.from_batches([made])
        none = pa.nulls(len(out), pa.int64())
        for name in ("n", "total", "ones", "twos", "threes", "fours"):
            out = out.append_column(name, none)
        return pa.concat_tables([_stats(None, counts, len(keys)), out])

    return run


def _write_continuations(folder: str, vocabulary: int, shards: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(rows)
        bounds = np.append(_bounds(vocabulary, shards), vocabulary + 1)
        dense = np.zeros(bounds[shard + 1] - bounds[shard], _number_type(vocabulary))
        dense[keys.astype(np.int64) - bounds[shard]] = counts
        Arrays(folder).write(f"continuation-{shard}", dense)
        return _stats(shard, counts, len(keys))

    return run


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts from the counts of counts; fixed ones where a class is empty."""
    if not (ones and twos and threes and fours):
        return 0.5, 0.75, 1.0
    y = ones / (ones + 2 * twos)
    found = 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count the training documents and write the model's arrays."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    folder = f"{work_folder(spark)}/arrays"
    size = texts.agg(F.sum(F.length("text")), F.count("*")).first()
    shards = 1 << max(4, int(((size[0] or 0) // 6 + size[1]) // _PER_SHARD).bit_length())
    bits = shards.bit_length() - 1

    words = texts.mapInArrow(_count_words(bits), _BLOCKS).groupBy("shard").applyInArrow(_write_words(folder), _STATS)
    found = {r.shard: r for r in words.select("shard", "n", "total").collect()}
    offsets = [0, *np.cumsum([found[k].n if k in found else 0 for k in range(shards)]).tolist()]
    tokens = sum(r.total for r in found.values())

    pairs = texts.mapInArrow(_count_pairs(folder, bits, offsets, shards), _BLOCKS)
    path = f"{work_folder(spark)}/pairs"
    pairs.groupBy("shard").applyInArrow(_write_pairs(folder, offsets[-1], shards), _STATS).write.parquet(path)
    made = spark.read.schema(_STATS).parquet(path)
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("ones", "twos", "threes", "fours")]
    of_pairs = made.where("shard IS NULL").agg(*sums).first()
    continued = made.where("shard IS NOT NULL").select("shard", "block").groupBy("shard").applyInArrow(
        _write_continuations(folder, offsets[-1], shards), _STATS)
    n, total, *of_words = continued.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), *sums).first()
    return Model(folder, bits, offsets, shards, tokens, discounts(*of_pairs), discounts(*of_words),
                 (of_words[0], of_words[1], n - of_words[0] - of_words[1]), total)


class Scorer:
    """Looks tokens and pairs up in the memory-mapped arrays."""

    def __init__(self, model: Model) -> None:
        self.model, self.numbers = model, Numbers(model.folder, model.hash_bits, model.offsets)
        arrays, shards = self.numbers.arrays, range(model.shards)
        known = [model.offsets[k + 1] > model.offsets[k] for k in shards]
        self.counts = [arrays.read(f"count-{k}", np.int64) if known[k] else np.zeros(0, np.int64) for k in shards]
        self.bounds = np.append(_bounds(model.vocabulary, model.shards), model.vocabulary + 1)
        self.opened: dict[tuple[str, int], np.ndarray] = {}

    def array(self, name: str, shard: int, kind: type) -> np.ndarray:
        """An array of a shard; a shard without pairs has none."""
        if (name, shard) not in self.opened:
            info = self.numbers.arrays
            exists = info.store.get_file_info(f"{info.path}/{name}-{shard}").type == pa.fs.FileType.File
            self.opened[name, shard] = info.read(f"{name}-{shard}", kind) if exists else np.zeros(0, kind)
        return self.opened[name, shard]

    def word_counts(self, numbers: np.ndarray) -> np.ndarray:
        """The training count of each token, 0 if it is unknown."""
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.model.offsets, numbers, "right") - 1
        for k in np.unique(shard[numbers >= 0]):
            here = (shard == k) & (numbers >= 0)
            out[here] = self.counts[k][numbers[here] - self.model.offsets[k]]
        return out

    def continuation(self, numbers: np.ndarray) -> np.ndarray:
        """The lower-order probability of each token number, also of unknown ones."""
        m = self.model
        left = sum(d * n for d, n in zip(m.word_discounts, m.word_classes)) / m.pairs
        out = np.full(len(numbers), left / (m.vocabulary + 1))
        shard = np.searchsorted(self.bounds, numbers, "right") - 1
        for k in np.unique(shard[numbers >= 0]):
            here = (shard == k) & (numbers >= 0)
            dense = self.array("continuation", k, _number_type(m.vocabulary))
            if len(dense):
                n = dense[numbers[here] - self.bounds[k]].astype(np.float64)
                out[here] += np.maximum(n - np.choose(np.clip(n.astype(np.int64), 1, 3) - 1, m.word_discounts), 0) / m.pairs
        return out

    def probability(self, contexts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The interpolated probability of each token number after its context; -1 is unknown. Sorted pairs are quicker."""
        m, lower = self.model, self.continuation(numbers)
        out = lower.copy()
        shard = np.searchsorted(self.bounds, contexts, "right") - 1
        for k in np.unique(shard[contexts >= 0]):
            here = np.flatnonzero((shard == k) & (contexts >= 0))
            start = self.array("start", k, np.int64)
            if not len(start):
                continue
            place = contexts[here] - self.bounds[k]
            total = self.array("total", k, np.uint64)[place].astype(np.float64)
            seen = total > 0
            here, place, total = here[seen], place[seen], total[seen]
            number = _number_type(m.vocabulary)
            classes = self.array("classes", k, number).reshape(-1, 3)[place].astype(np.float64)
            followers, counts = self.array("follower", k, number), self.array("pair", k, np.uint32)
            asked = numbers[here]
            low, high = start[place].copy(), start[place + 1]
            end = high.copy()
            active = np.arange(len(here))
            while len(active):
                middle = (low[active] + high[active]) >> 1
                less = followers[middle] < asked[active]
                low[active[less]] = middle[less] + 1
                high[active[~less]] = middle[~less]
                active = active[low[active] < high[active]]
            found = low < end
            found[found] = followers[low[found]] == asked[found]
            count = np.zeros(len(here))
            count[found] = counts[low[found]]
            beyond = np.flatnonzero(count == _LARGE)
            if len(beyond):
                at, exact = self.array("large", k, np.int64).reshape(2, -1)
                count[beyond] = exact[np.searchsorted(at, low[beyond])]
            less = np.choose(np.clip(count.astype(np.int64), 1, 3) - 1, m.pair_discounts)
            out[here] = np.maximum(count - less, 0) / total + classes @ np.array(m.pair_discounts) / total * lower[here]
        return out

    def score(self, hashes: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, base score and the model's log10 probability."""
        m = self.model
        numbers, place = self.numbers.distinct(hashes)
        counts = self.word_counts(numbers)[place]
        base = np.log10((counts + 1) / (m.tokens + m.vocabulary + 1))
        if m.tokens:
            # a pair is two places among the distinct tokens of this slice, where the begin comes last
            before = _contexts(place, begins, len(numbers))
            pair, back = np.unique(before.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64), return_inverse=True)
            contexts = np.append(numbers, m.vocabulary)[(pair >> np.uint64(32)).astype(np.int64)]
            chance = self.probability(contexts, numbers[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            logs = np.log10(chance)[back]
        else:
            logs = np.zeros(len(place))
        heads = begins[:-1]
        return {"n_tokens": np.diff(begins), "n_known": np.add.reduceat((counts > 0).astype(np.int64), heads),
                "base_score": np.add.reduceat(base, heads), "score": np.add.reduceat(logs, heads)}


def scores(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns with ``n_tokens, n_known, base_score, score`` of each row's whole text."""
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, scorer = WordHasher(), None
        for batch in batches:
            scorer = scorer or Scorer(model)
            for row, data, offsets in text_buffers(batch.column("text"), _SLICE):
                got = scorer.score(*tokens_of(hasher, data, offsets))
                own = [batch.column(k).slice(row, len(offsets) - 1) for k in keys]
                yield pa.record_batch([*own, *(pa.array(got[n]) for n in names)], [*keys, *names])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double")
