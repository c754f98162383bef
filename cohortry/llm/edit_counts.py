"""Token counts that follow edits.

Each document has a segment tree over its pre-tokens: a leaf holds a run of whole pre-tokens, its characters and its
tokens, an inner node the sums of its two halves. Leaves end at the first place behind ``_LEAF`` characters at which a
pre-token ends whatever stands around. Edits are located by descending the character sums. Only the leaves that they touch
are encoded anew, with a little context before them, and on until an old leaf boundary behind them is such a place of the
new text too: from there on the pre-tokens are the old ones, as the pattern never looks back. Edits that touch the same
leaves are one region. The sums above the changed leaves are updated.

Trees are a column beside the text, so they can be stored, and later edits need neither a count from scratch nor a
shuffle beyond bringing a document's edits to its row. Nothing is kept between documents.

Defined results: a NULL text is empty and has no tokens. Edits are ``(start, end, replacement)`` in code points of the
text they apply to, without overlap, in any order (of equal starts the order given); ends beyond the text count as its
end, a NULL replacement as empty, a NULL list as none. Repeated rows get a row each. Texts of any length are taken whole;
a run without such a place is one leaf. An empty table gives an empty result. Other columns stay; one that is named like a
result (``tree``, ``edits``, ``recoded``) is replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE = "struct<chars: array<int>, tokens: array<int>>"
_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
EDITS = "array<struct<start: int, end: int, replacement: string>>"
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))

#: The pre-token pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where a pre-token ends whatever stands around: before white space, between ASCII letters and digits.
_BOUNDARY = re.compile(r"(?<=\S)(?=[\t-\r ])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Characters before an edit that are encoded with it, so that the boundary before them stays one.
_CONTEXT = 4
_LEAF = 256


class PieceCounter:
    """Counts the tokens of runs of whole pre-tokens; ``ranks`` is the content of a file of token ranks."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def leaves(self, text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
        """The leaves from one pre-token boundary to another, as (end, tokens)."""
        end = len(text) if end is None else end
        while start < end:
            cut = _BOUNDARY.search(text, start + _LEAF, end)
            stop = cut.start() if cut else end
            yield stop, len(self.encoding.encode_ordinary(text[start:stop]))
            start = stop


class SegmentTree:
    """Sums of characters and tokens over leaves; the leaves are the second half of the arrays."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def of(cls, leaves: list[tuple[int, int]]) -> SegmentTree:
        """A tree over (characters, tokens) of leaves, with some empty ones to fill a power of two."""
        size = 1 << max(0, (len(leaves) - 1).bit_length())
        out = cls([0] * (2 * size), [0] * (2 * size))
        for k, (chars, tokens) in enumerate(leaves):
            out.chars[size + k], out.tokens[size + k] = chars, tokens
        for node in range(size - 1, 0, -1):
            out.chars[node] = out.chars[2 * node] + out.chars[2 * node + 1]
            out.tokens[node] = out.tokens[2 * node] + out.tokens[2 * node + 1]
        return out

    def locate(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last one with text, and where it begins."""
        if position >= self.chars[1]:
            position = self.chars[1] - 1
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.chars[node] <= position:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Change a leaf and the sums above it."""
        node = self.size + leaf
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, text: str, start: int, end: int, replacement: str, counter: PieceCounter) -> tuple[str, SegmentTree, int]:
        """The text and the tree after an edit, and how many characters were encoded anew."""
        return self.edit_all(text, [(start, end, replacement)], counter)

    def edit_all(self, text: str, edits: list[tuple[int, int, str]], counter: PieceCounter) -> tuple[str, SegmentTree, int]:
        """The text and the tree after some edits, given in order and without overlap, and how many characters were encoded anew.

        The new text is put together once. Edits that touch the same leaves are one region, which is encoded once.
        """
        parts, at = [], 0
        edits = [(min(max(a, 0), len(text)), min(max(b, a, 0), len(text)), r) for a, b, r in edits]
        for start, end, replacement in edits:
            parts += [text[at:start], replacement]
            at = end
        new = "".join([*parts, text[at:]])
        if not text:
            return new, SegmentTree.of(_sizes(counter.leaves(new), 0)), len(new)
        regions, shift, k, recoded = [], 0, 0, 0
        while k < len(edits):
            first, low = self.locate(max(0, edits[k][0] - _CONTEXT))
            begin, last, stop = low + shift, first, low + self.chars[self.size + first]
            while True:
                while k < len(edits) and edits[k][0] - _CONTEXT < stop:
                    start, end, replacement = edits[k]
                    shift += len(replacement) - (end - start)
                    k += 1
                    if end > stop:
                        last, at = self.locate(end)
                        stop = at + self.chars[self.size + last]
                # the old pre-tokens behind a boundary are those of the new text
                if stop >= self.chars[1] or _BOUNDARY.match(new, stop + shift):
                    break
                last += 1
                stop += self.chars[self.size + last]
            last = self.size - 1 if stop >= self.chars[1] else last
            regions.append((first, last, _sizes(counter.leaves(new, begin, stop + shift), begin)))
            recoded += stop + shift - begin
        if any(len(made) > 4 * (last - first + 1) for first, last, made in regions):
            out, at = [], 0
            old = list(zip(self.chars[self.size:], self.tokens[self.size:]))
            for first, last, made in regions:
                out += [*old[at:first], *made]
                at = last + 1
            return new, SegmentTree.of([x for x in [*out, *old[at:]] if x[0]]), recoded
        for first, last, made in regions:
            room = last - first + 1
            for j in range(room):
                part = made[j * len(made) // room:(j + 1) * len(made) // room]
                self.put(first + j, sum(c for c, _ in part), sum(t for _, t in part))
        return new, self, recoded


def _sizes(leaves: Iterator[tuple[int, int]], start: int) -> list[tuple[int, int]]:
    """(characters, tokens) of leaves given by their ends."""
    out = []
    for end, tokens in leaves:
        out.append((end - start, tokens))
        start = end
    return out


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _schema(frame: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in frame.dtypes), more])


def _extended(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *names])


def build(docs: DataFrame, ranks: bytes) -> DataFrame:
    """``docs`` (with a column text) and ``tree``, each text's segment tree."""
    held, docs = docs.sparkSession.sparkContext.broadcast(ranks), docs.drop("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(held.value)
        for batch in _sliced(batches):
            trees = [SegmentTree.of(_sizes(counter.leaves(t or ""), 0)) for t in batch.column("text").to_pylist()]
            yield _extended(batch, ["tree"], [pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], _TREE)])

    return docs.mapInArrow(run, _schema(docs, f"tree {TREE}"))


def update(rows: DataFrame, ranks: bytes) -> DataFrame:
    """``rows`` (with columns text, tree, edits), text and tree edited, and ``recoded``, the characters encoded anew."""
    held, rows = rows.sparkSession.sparkContext.broadcast(ranks), rows.drop("recoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(held.value)
        for batch in _sliced(batches):
            texts, trees, sizes = [], [], []
            for text, tree, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits"))):
                now, held_tree, recoded = text or "", SegmentTree(tree["chars"], tree["tokens"]), 0
                if edits:
                    listed = [(e["start"], e["end"], e["replacement"] or "") for e in sorted(edits, key=lambda e: e["start"])]
                    now, held_tree, recoded = held_tree.edit_all(now, listed, counter)
                texts.append(now)
                trees.append({"chars": held_tree.chars, "tokens": held_tree.tokens})
                sizes.append(recoded)
            out = dict(zip(batch.schema.names, batch.columns))
            out |= {"text": pa.array(texts, pa.string()), "tree": pa.array(trees, _TREE), "recoded": pa.array(sizes, pa.int64())}
            yield pa.record_batch(list(out.values()), list(out))

    return rows.mapInArrow(run, _schema(rows, "recoded long"))


def n_tokens(tree: str = "tree") -> Column:
    """The tokens of a text by its tree's root."""
    return F.get(F.col(tree)["tokens"], 1).cast("long")


def pattern_edits(docs: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """``docs`` and ``edits``: every match of a pattern in the column text is replaced."""

    docs = docs.drop("edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern)
        for batch in _sliced(batches):
            edits = [[{"start": m.start(), "end": m.end(), "replacement": replacement} for m in find.finditer(t or "")]
                     for t in batch.column("text").to_pylist()]
            yield _extended(batch, ["edits"], [pa.array(edits, _EDITS)])

    return docs.mapInArrow(run, _schema(docs, f"edits {EDITS}"))
