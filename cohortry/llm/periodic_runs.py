"""Periodic run detection: recompression grammars whose LCE queries extend candidates of a harmonic grid.

A run is a stretch of words with smallest period q (words q apart are equal), of ``least_length`` words or more and at
least three periods long, that no neighbouring word extends keeping the period.

* Candidates. A run of period p that is three periods long holds a multiple i of p with the words i, i + p and i + 2p
  in it. Over all p these are n/1 + n/2 + n/3 + ... places of a text: the harmonic grid. A place stays a candidate
  if a few of the words from i on equal those one period later.
* Exact extension. The texts that have candidates are compressed into one run-length grammar: maximal blocks of one symbol
  become a symbol, then pairs from a two-part split of the alphabet become a symbol, alternately, until little is left. The
  same words get the same symbols wherever they stand, apart from the edges, so the longest common extension of two
  places is found by climbing the grammar while the symbols agree and descending where they part. Both directions use the
  same grammar. No suffix array is built.
* Of the intervals found, each is kept once, with its smallest period: an interval of three periods or more with a smaller
  period has that one as a divisor, and is found with it as well.

Words are told apart by 64-bit hashes of their bytes (A-Z as they are). The grammar is built for a slice of about
``slice_bytes`` of texts, or for one longer text; candidates are made and extended a chunk at a time, and of a row of places
one period apart only the first is extended as long as its interval covers the others. So memory follows the slice.

Defined results: NULL and empty texts have no words, no runs and the empty collapsed text. Runs come by start, then
period; the same stretch is one run. Repeated rows get a row each. A text of any length is processed whole. An empty table
gives an empty result. Only the text and the columns to keep are read; a kept column named like a result raises
ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import flat_lists
from cohortry.llm.words import WordHasher, mix, odd_factor, text_buffers

RUNS = "array<struct<start: long, length: long, period: long>>"
RESULTS = ("n_words", "runs", "collapsed")


class Grammar:
    """A run-length grammar of a sequence of symbols by recompression; its first and last symbol occur once.

    Level 0 is the sequence. A symbol of level k stands for neighbours of level k - 1, from ``first[k][x]`` up to
    ``first[k][x + 1]``; ``blocks[k]`` tells block from pair levels.
    """

    def __init__(self, symbols: np.ndarray, small: int = 16) -> None:
        self.symbols, self.first, self.parent, self.blocks = [symbols], [None], [], [False]
        self.names = int(symbols.max()) + 1 if len(symbols) else 0
        rounds = 0
        while len(self.symbols[-1]) > small and rounds < 256:
            self._compress_blocks()
            self._compress_pairs(rounds)
            rounds += 1
        self.parent.append(None)

    def _name(self, keys: np.ndarray) -> np.ndarray:
        """New symbols for the given keys, equal ones for equal keys."""
        distinct, which = np.unique(keys, return_inverse=True)
        self.names += len(distinct)
        return which + (self.names - len(distinct))

    def _add(self, symbols: np.ndarray, starts: np.ndarray, block: bool) -> None:
        below = len(self.symbols[-1])
        parent = np.zeros(below, np.int64)
        parent[starts[1:]] = 1
        self.parent.append(np.cumsum(parent))
        self.symbols.append(symbols)
        self.first.append(np.append(starts, below))
        self.blocks.append(block)

    def _compress_blocks(self) -> None:
        s = self.symbols[-1]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) == len(s):
            return
        lengths = np.diff(np.append(starts, len(s)))
        new, long = s[starts].copy(), lengths > 1
        new[long] = self._name(new[long] * (len(s) + 1) + lengths[long])
        self._add(new, starts, True)

    def _compress_pairs(self, turn: int) -> None:
        s = self.symbols[-1]
        left = mix(s.astype(np.uint64) * odd_factor(turn) + odd_factor(turn + 1)) & np.uint64(1) == 1
        forward, backward = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        pairs = np.flatnonzero(forward if forward.sum() >= backward.sum() else backward)
        if not len(pairs):
            return
        begins = np.ones(len(s), bool)
        begins[pairs + 1] = False
        new = s.copy()
        new[pairs] = self._name(s[pairs] * self.names + s[pairs + 1])
        starts = np.flatnonzero(begins)
        self._add(new[starts], starts, False)

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols from i and from j on are equal; backward: how many before i and before j. i < j."""
        step = 1 if forward else -1
        a, b = (i.copy(), j.copy()) if forward else (i - 1, j - 1)
        found = np.full(len(i), -1, np.int64)  # the level at which the two sides part
        top = len(self.symbols) - 1

        def rest(k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The parents one level up, and how many of their symbols are still ahead."""
            up = self.parent[k][at]
            return up, (self.first[k + 1][up + 1] - at if forward else at - self.first[k + 1][up] + 1)

        going = np.arange(len(i))
        for k in range(top + 1):
            s = self.symbols[k]
            while len(going):
                differ = s[a[going]] != s[b[going]]
                found[going[differ]] = k
                going = going[~differ]
                if k < top:
                    break
                a[going] += step
                b[going] += step
            if not len(going):
                break
            x, y = a[going], b[going]
            (ux, rx), (uy, ry) = rest(k, x), rest(k, y)
            width = np.diff(self.first[k + 1])
            inside = (rx < width[ux]) | (ry < width[uy])
            move = np.where(inside, np.minimum(rx, ry), 0) * step
            a[going], b[going] = x + move, y + move
            differ = s[a[going]] != s[b[going]]
            found[going[differ]] = k
            going = going[~differ]
            a[going], b[going] = self.parent[k][a[going]], self.parent[k][b[going]]
        for k in range(top, 0, -1):
            down = np.flatnonzero(found >= k)
            if not len(down):
                continue
            x, y, first = a[down], b[down], self.first[k]
            more = np.ones(len(down), np.int64)
            if self.blocks[k]:
                more = np.minimum(first[x + 1] - first[x], first[y + 1] - first[y])
            x, y = (first[x], first[y]) if forward else (first[x + 1] - 1, first[y + 1] - 1)
            same = self.symbols[k - 1][x] == self.symbols[k - 1][y]
            a[down], b[down] = x + same * more * step, y + same * more * step
        return a - i if forward else i - 1 - a


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, its index repeated ``counts[k]`` times beside 0, 1, 2, ..."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return owner, np.arange(len(owner)) - (ends - counts)[owner]


def grid_candidates(words: np.ndarray, first: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place (index into ``words``) and period of the grid places whose next words come back a period later."""
    sizes = np.diff(first)
    text, p = _spread(sizes // 3)
    p = p + 1
    places = (sizes[text] - 2 * p - 1) // p + 1
    done = np.concatenate([[0], np.cumsum(places)])
    for begin in range(0, int(done[-1]), chunk):
        end = min(begin + chunk, int(done[-1]))
        low, high = np.searchsorted(done, begin, "right") - 1, np.searchsorted(done, end, "left")
        from_ = np.maximum(done[low:high], begin)
        owner, turn = _spread(np.minimum(done[low + 1:high + 1], end) - from_)
        owner_period = p[low:high][owner]
        place = first[text[low:high]][owner] + (turn + (from_ - done[low:high])[owner]) * owner_period
        keep = np.arange(len(place))
        for offset in (0, 1, 2, 3):
            q = owner_period[keep]
            at = place[keep] + np.minimum(offset, q)
            good = words[at] == words[at + q]
            if offset == 0:
                good &= words[at] == words[at + 2 * q]
            keep = keep[good]
        yield text[low:high][owner[keep]], place[keep], owner_period[keep]


def find_runs(words: np.ndarray, first: np.ndarray, least_length: int = 24, most_held: int = 1 << 21) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of all runs of a row of texts, by text, start and period.

    ``words`` are values that are equal for equal words, ``first`` the index of the first word of each text, with the end.
    """
    held, parts, texts = 0, [], [np.zeros(0, np.int64)]
    for part in grid_candidates(words, first):
        texts.append(np.unique(part[0]))
        held += len(part[0])
        parts.append(part)
        if held > most_held:
            parts.clear()  # a very repetitive slice: its candidates are made again, a chunk at a time
    has = np.unique(np.concatenate(texts))
    if not len(has):
        return has, has, has, has
    sizes = first[has + 1] - first[has]
    owner, turn = _spread(sizes)
    _, symbols = np.unique(words[first[has][owner] + turn], return_inverse=True)
    at = np.cumsum(sizes + 1) - sizes  # where each text begins in the sequence; a symbol of its own stands before it
    row = len(symbols) + np.arange(int(sizes.sum()) + len(has) + 1)
    row[at[owner] + turn] = symbols
    grammar = Grammar(row, small=2 * len(has) + 8)
    found = [np.zeros((4, 0), np.int64)]
    for text, place, p in parts if held <= most_held else grid_candidates(words, first):
        which = np.searchsorted(has, text)
        i = at[which] + place - first[text]
        while len(i):
            # the first of a row of places one period apart answers for those that its interval covers
            head = np.ones(len(i), bool)
            head[1:] = (p[1:] != p[:-1]) | (i[1:] - i[:-1] != p[1:])
            x, q = i[head], p[head]
            start = x - grammar.common(x, x + q, forward=False)
            end = x + q + grammar.common(x, x + q)
            good = end - start >= np.maximum(least_length, 3 * q)
            t = which[head]
            found.append(np.unique(np.stack([has[t], start - at[t], end - start, q])[:, good], axis=1))
            of = np.cumsum(head) - 1
            left = (i < start[of]) | (i + p >= end[of])
            i, p, which = i[left], p[left], which[left]
    all_found = np.unique(np.concatenate(found, axis=1), axis=1)  # by text, start, length, period
    new = np.ones(all_found.shape[1], bool)
    new[1:] = (all_found[:3, 1:] != all_found[:3, :-1]).any(axis=0)
    t, start, length, p = all_found[:, new]
    order = np.lexsort((p, start, t))
    return t[order], start[order], length[order], p[order]


def _collapsed(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text joined by one space."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[kept]
    begin, end = starts[kept], ends[kept]
    change = np.zeros(len(data) + 1, np.int8)
    change[begin] += 1
    np.subtract.at(change, end, 1)
    chosen = np.cumsum(change[:-1], dtype=np.int8) > 0
    gaps = end[:-1][owner[:-1] == owner[1:]]
    chosen[gaps] = True
    out = data.copy()
    out[gaps] = 0x20
    sizes = np.concatenate([[0], np.cumsum(chosen)])[offsets]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray((sizes - sizes[0]).astype(np.int32))), pa.py_buffer(out[chosen]))


def with_runs(docs: DataFrame, keep: list[str], text: str | Column = "text", least_length: int = 24, slice_bytes: int = 1 << 20) -> DataFrame:
    """The columns to keep, the number of words, all runs and the text without their repetitions.

    Of each run the first period stays; the words that are left are joined by one space.
    """
    if clash := {c.lower() for c in keep} & {*RESULTS}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    source = F.col(f"`{text}`") if isinstance(text, str) else text
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), source.cast("string").alias("text"))
    schema = T.StructType([chosen.schema["row"]]).add("n_words", "long").add("runs", T._parse_datatype_string(RUNS)).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=False)
        for batch in batches:
            for row, data, offsets in text_buffers(batch.column("text"), slice_bytes):
                starts, ends, first = hasher.spans(data, offsets)
                words = hasher.hashes(hasher.lower[data], starts, ends)
                t, start, length, period = find_runs(words, first, least_length)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, first[t] + start + period, 1)
                np.add.at(depth, first[t] + start + length, -1)
                kept = np.cumsum(depth[:-1]) == 0
                texts = len(offsets) - 1
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(row, texts), pa.array(np.diff(first)), flat_lists(runs, np.bincount(t, minlength=texts), runs.type),
                     _collapsed(data, offsets, starts, ends, first, kept)], schema.names)

    return chosen.mapInArrow(run, schema).select("row.*", *RESULTS)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length/period; of equal ones the first. NULL where there is none."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
