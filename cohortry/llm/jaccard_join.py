"""N-gram Jaccard join: near duplicates by token-combination prefixes.

A document is the set of its distinct word shingles. Two documents link when
``100 * |A and B| >= percent * |A or B|``.

Method. Shingles are ordered from rare to frequent and put into classes. A prefix of each set is indexed: shingles of
the rare class one by one, shingles of more frequent classes as combinations of k (pairs, then triples) within small
subclasses, so that a passage which many documents share makes no common key by itself. As a subclass gives no key
until k of its shingles are in the prefix, the prefix is extended until, whichever shingles a linked document may lack,
some subclass keeps k common ones. Linked documents therefore always share a key; everything else is only speed:

* frequencies come from a counter table of fixed size over all documents; class limits lie above its mean load;
* sets that are equal are one set from the start (its smallest doc_id stands for it);
* keys of a single set are dropped after a pre-aggregated count, so only shared keys are joined;
* within a key, members are first paired with the member that has the fewest rare shingles (in a group of edited copies
  the original), verified, and components formed; then members of different components are paired. Bitmaps of each set
  bound the overlap in the join condition, so few pairs are emitted. No pair that could link two components is left out.

Verification first compares outlines of the sets, bitmaps of a length in proportion, which bound the overlap; then it
intersects the whole sets.

Defined results: NULL or empty text, or text without words, has an empty set and links with nothing. Rows that repeat a
doc_id are one node, with the links of each of its texts. A NULL doc_id gets its set size and a NULL component. Texts of
any length are taken whole; equal shingle hashes are equal shingles. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import flat_lists, present, presence_bits, stored, work_folder
from cohortry.llm.graph import components
from cohortry.llm.words import WordHasher, mix, odd_factor, shingles, text_buffers

_BITMAP = [f"b{i}" for i in range(8)]


@dataclass(frozen=True)
class JoinParameters:
    """``size``: words of a shingle; ``percent``: least similarity; ``log2_counters``: size of the frequency table;
    ``pairs_from``, ``triples_from``: documents above the usual load from which shingles are indexed as pairs, triples."""

    size: int = 5
    percent: int = 80
    log2_counters: int = 20
    pairs_from: int = 32
    triples_from: int = 4096


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """The sorted distinct shingles of each row, slice by slice."""
    hasher = WordHasher()
    for batch in batches:
        for row, data, offsets in text_buffers(batch.column("text")):
            words, first = hasher.words(data, offsets)
            yield batch, row, [np.unique(shingles(words[a:b], size)) for a, b in zip(first[:-1], first[1:])]


def _keys_and_counts(p: JoinParameters):
    """Per document: set size and digest of its set. Per task: how many documents hold shingles of each counter."""
    block = 1 << min(14, p.log2_counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << p.log2_counters, np.int64)
        names = ["doc_id", "n_shingles", "set_key", "block", "counts"]
        some = False
        for batch, row, sets in _sets(batches, p.size):
            some = True
            ids = batch.column("doc_id").slice(row, len(sets)).cast(pa.int64())
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()),
                                   pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        if some:
            blocks = [counts[i:i + block].tobytes() for i in range(0, len(counts), block)]
            n = len(blocks)
            yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()),
                                   pa.array(range(n), pa.int32()), pa.array(blocks, pa.binary())], names)

    return run


def _add_blocks(key: tuple, batches: Iterator[pa.Table]) -> pa.Table:
    """Sum the counter blocks of a group."""
    total = None
    for value in batches.column("counts").to_pylist():
        value = np.frombuffer(value, np.int64)
        total = value.copy() if total is None else total + value
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _frequency_table(scan: DataFrame, p: JoinParameters) -> np.ndarray:
    """The summed counters; two levels, so that no group holds a block of every task."""
    blocks = scan.where("block IS NOT NULL").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("lot"))
    schema = "block int, counts binary"
    part = blocks.groupBy("block", "lot").applyInArrow(_add_blocks, schema)
    rows = part.groupBy("block").applyInArrow(_add_blocks, schema).toArrow()
    out = np.zeros(1 << p.log2_counters, np.int64)
    for b, value in zip(rows["block"].to_pylist(), rows["counts"].to_pylist()):
        value = np.frombuffer(value, np.int64)
        out[b * len(value):(b + 1) * len(value)] = value
    return out


def _classes(counts: np.ndarray, p: JoinParameters) -> np.ndarray:
    """The class of the shingles of each counter: 1 singly, 2 in pairs, 3 in triples."""
    load = counts.mean() if len(counts) else 0.0
    usual = load + 6 * np.sqrt(load)
    return (1 + (counts > usual + p.pairs_from) + (counts > usual + p.triples_from)).astype(np.int8)


def prefix_keys(s: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set (sorted hashes) whose shingles have the given classes.

    Sizes fall into schemes of a factor of two; a pair meets in the scheme of its larger set, so a set is indexed in its
    own scheme and, if it may be the smaller one of a pair there, in the next. In a scheme of up to 63 shingles every
    shingle is indexed singly; in larger ones there are so few subclasses that the extended prefix always fits the set.
    """
    n = len(s)
    out = []
    own = n.bit_length() - 1
    missing = n - -(-percent * n // 100)
    missing_small = n - -(-2 * percent * n // (100 + percent))
    for scheme, lacking in {(n * 100 // percent).bit_length() - 1: missing_small, own: missing}.items():
        need = lacking + 1
        classes = level if scheme > 5 else np.ones(n, np.int8)
        rare = s[classes == 1]
        out.append(rare[:need])
        need -= len(rare)
        if need <= 0:
            continue
        subclasses = np.uint64(max(1, (1 << scheme) // 16))
        groups: dict[tuple[int, int], list[int]] = {}
        for k in (2, 3):
            chosen = s[classes == k]
            for h, g in zip(chosen.tolist(), (mix(chosen) % subclasses).tolist()):
                if need <= 0:
                    break
                members = groups.setdefault((k, g), [])
                members.append(h)
                need -= len(members) >= k
        for (k, g), members in groups.items():
            if len(members) >= k:
                combos = np.array(list(combinations(members, k)), np.uint64)
                key = np.full(len(combos), 0x51ED270B * (k + 1) + scheme, np.uint64)
                for i in range(k):
                    key = mix(key + combos[:, i] * odd_factor(i + 7))
                out.append(key)
    return np.unique(np.concatenate(out))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """512 bits with one set for each shingle."""
    out = np.zeros(8, np.uint64)
    h = s * odd_factor(40)
    np.bitwise_or.at(out, (h >> np.uint64(61)).astype(np.int64), np.uint64(1) << ((h >> np.uint64(55)) & np.uint64(63)))
    return out.view(np.int64)


def _signatures(p: JoinParameters, classes, shared=None):
    """Rows of keys: all with the digest's first 64 bits, or only keys that may be shared, with what joining them needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, bits = classes.value, shared.value if shared else None
        for batch, row, sets in _sets(batches, p.size):
            ids = batch.column("doc_id").slice(row, len(sets)).cast(pa.int64())
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            kept, keys, digests, info = [], [], [], []
            for i, s in enumerate(sets):
                if not len(s) or not valid[i]:
                    continue
                level = level_of[(s & np.uint64(len(level_of) - 1)).astype(np.int64)]
                found = prefix_keys(s, level, p.percent)
                if bits is not None:
                    found = found[present(bits, found)]
                    if not len(found):
                        continue
                    info.append((len(s), int((level == 1).sum()), *_bitmap(s).tolist()))
                digests.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True))
                kept.append(i)
                keys.append(found)
            sizes = np.array([len(k) for k in keys], np.int64)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            if bits is None:
                yield pa.record_batch([pa.array(flat), pa.array(np.repeat(np.array(digests, np.int64), sizes))], ["key", "digest"])
            else:
                wide = np.array(info, np.int64).reshape(len(info), 10)
                columns = [pa.array(flat), pa.array(np.repeat(ids[np.array(kept, np.int64)], sizes))]
                columns += [pa.array(np.repeat(wide[:, c], sizes)) for c in range(10)]
                yield pa.record_batch(columns, ["key", "id", "n", "rare", *_BITMAP])

    return run


def _outline(s: np.ndarray) -> bytes:
    """A bitmap of two to four bits for each shingle: the set's size class decides its length."""
    bits = 2 << max(3, (len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _overlap_bound(x: bytes, y: bytes, n: int, m: int) -> int:
    """No two sets with these outlines and sizes have more shingles in common."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        longer = np.unpackbits(max(a, b, key=len)).reshape(-1, 2).any(axis=1)
        a, b = (np.packbits(longer), b) if len(a) > len(b) else (a, np.packbits(longer))
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def _set_rows(p: JoinParameters, wanted, outline: bool):
    """The whole sets, or their sizes and outlines, of the documents whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value

        def needed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64())
                mask = ids.is_valid().to_numpy(zero_copy_only=False) & present(bits, batch.column("h").to_numpy())
                yield batch.filter(pa.array(mask))

        for batch, row, sets in _sets(needed(), p.size):
            ids = batch.column("doc_id").slice(row, len(sets)).cast(pa.int64())
            sizes = np.array([len(s) for s in sets], np.int64)
            if outline:
                outlines = pa.array([_outline(s) if len(s) else b"" for s in sets], pa.binary())
                yield pa.record_batch([ids, pa.array(sizes), outlines], ["id", "n", "outline"])
            else:
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.record_batch([ids, flat_lists(flat, sizes, pa.int64())], ["id", "members"])

    return run


def _rows_of(pairs: DataFrame, texts: DataFrame, p: JoinParameters, outline: bool) -> DataFrame:
    """The sets or outlines of all documents in the pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = pairs.sparkSession.sparkContext.broadcast(presence_bits(ends.select(F.xxhash64("id").alias("h"))))
    kind = "id long, n long, outline binary" if outline else "id long, members array<long>"
    rows = texts.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_set_rows(p, wanted, outline), kind)
    return rows.join(ends.distinct(), "id", "left_semi").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, p: JoinParameters, path: str) -> DataFrame:
    """The pairs (a, b) of set representatives that link: outlines rule out most others, whole sets are intersected."""
    q = p.percent

    def reach(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x, y, n, m in columns:
            yield pa.array([(100 + q) * _overlap_bound(*row) >= q * (row[2] + row[3])
                            for row in zip(x.to_pylist(), y.to_pylist(), n.to_pylist(), m.to_pylist())], pa.bool_())

    outlines = _rows_of(pairs, texts, p, True)
    close = stored(
        pairs.join(outlines.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("outline").alias("x")), "a")
        .join(outlines.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("outline").alias("y")), "b")
        .where(F.arrow_udf(reach, "boolean")("x", "y", "n", "m")).select("a", "b").distinct(),
        path,
    )
    sets = _rows_of(close, texts, p, False)
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return (
        close.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        .where(F.lit(100) * common >= F.lit(q) * union)
        .select("a", "b").distinct()
    )


def _may_link(p: JoinParameters):
    """The condition on the columns of ``l`` and ``r`` without which they can't link: sizes and bitmaps."""
    def lacks(x: str, y: str) -> str:
        return " + ".join(f"bit_count({x}.{b} & ~{y}.{b})" for b in _BITMAP)

    q = p.percent
    return F.expr(
        f"100 * least(l.n, r.n) >= {q} * greatest(l.n, r.n)"
        f" AND {100 + q} * (l.n - ({lacks('l', 'r')})) >= {q} * (l.n + r.n)"
        f" AND {100 + q} * (r.n - ({lacks('r', 'l')})) >= {q} * (l.n + r.n)"
    )


def _of_one_id(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of a doc_id that occurs with several."""
    several = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("doc_id").agg(
        F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id")
    sets = rows.join(several, "doc_id").join(reps, "set_key").select("doc_id", "set_id").distinct()
    least = sets.groupBy("doc_id").agg(F.min("set_id").alias("a"))
    return sets.join(least, "doc_id").select("a", F.col("set_id").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, parameters: JoinParameters | None = None, links: bool = False):
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, set_id``.

    ``component_id`` is the smallest doc_id that links reach, ``set_id`` the smallest doc_id with an equal set. With
    ``links=True`` also the verified links (a, b) between sets that joined the components.
    """
    p = parameters or JoinParameters()
    if not 50 < p.percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    folder = work_folder(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    scan = stored(texts.mapInArrow(_keys_and_counts(p), "doc_id long, n_shingles long, set_key string, block int, counts binary"),
                  f"{folder}/scan")
    rows = scan.where("block IS NULL").select("doc_id", "n_shingles", "set_key")
    reps = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("set_id"))
    classes = spark.sparkContext.broadcast(_classes(_frequency_table(scan, p), p))

    shared = stored(
        texts.mapInArrow(_signatures(p, classes), "key long, digest long")
        .groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        .where("low <> high").select("key"),
        f"{folder}/shared",
    )
    bits = spark.sparkContext.broadcast(presence_bits(shared, 26))
    schema = "key long, id long, n long, rare long, " + ", ".join(f"{b} long" for b in _BITMAP)
    members = stored(
        texts.mapInArrow(_signatures(p, classes, bits), schema)
        .join(shared, "key", "left_semi")
        .join(reps.select(F.col("set_id").alias("id")), "id", "left_semi")
        .distinct(),
        f"{folder}/members",
    )

    leaders = members.groupBy("key").agg(F.min(F.struct("rare", "id", "n", *_BITMAP)).alias("first")).select("key", "first.*")
    first = stored(
        leaders.alias("l").join(members.alias("r"), F.expr("l.key = r.key AND l.id <> r.id") & _may_link(p))
        .select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct(),
        f"{folder}/pairs-1",
    )
    found = stored(_verified(first, texts, p, f"{folder}/close-1"), f"{folder}/links-1")
    same = stored(_of_one_id(rows, reps), f"{folder}/same-id")
    roots = components(found.union(same), f"{folder}/roots-1")

    labelled = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = labelled.join(mixed, "key", "left_semi")
    second = stored(
        rest.alias("l").join(rest.alias("r"), F.expr("l.key = r.key AND l.id < r.id AND l.root <> r.root") & _may_link(p))
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
        .join(first, ["a", "b"], "left_anti"),
        f"{folder}/pairs-2",
    )
    more = stored(_verified(second, texts, p, f"{folder}/close-2"), f"{folder}/links-2")
    every = found.union(more)
    if not more.isEmpty():
        roots = components(every.union(same), f"{folder}/roots-2")

    named = reps.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_key", "set_id", F.coalesce("root", "set_id").alias("root"))
    out = rows.join(named, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id")).cast("long").alias("component_id"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
    )
    return (out, every) if links else out
