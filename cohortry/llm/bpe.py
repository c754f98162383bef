"""BPE encoding and decoding of whole texts by tree concatenation.

Texts are cut at white space, which no token crosses, and new pieces are encoded with the library's own tokenizer and
kept for the task; plain text (ASCII without apostrophes, and letters below U+0130) is cut into lower-cased pre-tokens at
once. A pre-token longer than ``leaf`` characters is cut into leaves; where a run without white space is longer than
``spread`` leaves, Spark encodes them in parallel as rows of their own. Neighbouring leaves are then concatenated as a tree:
a window of tokens around the join is encoded anew and grows until its first token is the left side's token at that
place and its last token the right side's. A token sequence is the encoding of its text exactly if each adjacent pair
is, so that agreement on both sides makes the whole join exact.

The tokenizer's file is a parameter; its content (a few MB) is broadcast, so workers need no copy. Only a leaf or one
document's tokens are held by a task.

Defined results: NULL counts as empty; an empty text has no tokens and decodes to "". Special tokens in a text are
recognised as the library does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from cohortry.llm.words import give_back

ENCODED = "n_tokens long, ids string, decoded string"
LEAF = 4096
#: A run of so many leaves is spread over tasks; a shorter one is cut and concatenated in the task of its document.
SPREAD = 16
_KEPT_PIECES = 300_000
#: The letters below U+0130, which composition leaves alone and which Python lower-cases as the library does.
_LETTERS = "a-zªµºß-öø-į"
_PLAIN = re.compile(rf"[\t-\r !-&(-~{_LETTERS}À-ÖØ-Þ]*")
#: The pre-tokens of lower-cased plain text: letters, one digit, other signs (the tokenizer's pattern without its apostrophes).
_PLAIN_TOKENS = re.compile(rf"[{_LETTERS}]+|[0-9]|[!-&(-/:-@\[-`{{-~]+")
#: The split of the pre-tokenizer for which these hold (a fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PieceEncoder:
    """Encodes texts piece by piece with a tokenizer given as its file's content."""

    def __init__(self, content: str) -> None:
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        if spec.get("decoder") is not None or spec["model"]["type"] != "BPE":
            raise ValueError("a BPE tokenizer is needed whose tokens are decoded one by one")
        self.spec = spec["model"]
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.pieces = re.compile(r"[^\t-\r ]+")
        self.kept: dict[str, bytes] = {}  # ids as four bytes each, which takes far less memory than texts
        self.inner = None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.ends = np.array([n.endswith(self.spec["end_of_word_suffix"] or "\0") for n in self.names])
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and splits[:1] == [_SPLIT]

    def spelled(self, coded: bytes) -> tuple[str, str, int]:
        """Ids and decoded text of coded ids, and their number."""
        ids = np.frombuffer(coded, np.uint32).tolist()
        return " ".join([self.numbers[i] for i in ids]), " ".join([self.names[i] for i in ids]), len(ids)

    def library(self, piece: str) -> bytes:
        """The coded ids of a piece."""
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.uint32).tobytes()

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens (kept as parts) and at white space; plain text into its pre-tokens.

        Pre-tokens have fewer different texts than the words with their capitals and signs.
        """
        if self.special is None or not self.special.search(text):
            if self.plain and _PLAIN.fullmatch(text):
                return _PLAIN_TOKENS.findall(text.lower())
            return self.pieces.findall(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.pieces.findall(part)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces together, as words of one text, and keep them."""
        single = [p for p in pieces if self.plain and _PLAIN_TOKENS.fullmatch(p)]
        for low in range(0, len(single), 4096):
            part = single[low:low + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            bounds = np.flatnonzero(self.ends[ids]) + 1  # the last token of a pre-token bears the mark of a word's end
            if len(bounds) != len(part):
                raise ValueError("a pre-token is not encoded as one word")
            coded, bounds = ids.tobytes(), [0, *(4 * bounds).tolist()]
            self.kept.update(zip(part, [coded[a:b] for a, b in zip(bounds, bounds[1:])]))
        for piece in pieces if not single else set(pieces).difference(single):
            self.kept[piece] = self.library(piece)

    def encode_all(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Ids and decoded text of whole texts, and the number of tokens."""
        parts = [self.parts(text) for text in texts]
        every = set().union(*parts)
        long = {piece: self.library(piece) if len(piece) <= LEAF else self.coded(piece)
                for piece in every if len(piece) > 64 or piece[0] == "<" and self.special and self.special.fullmatch(piece)}
        every.difference_update(long)
        new = list(every.difference(self.kept))
        if len(self.kept) + len(new) > _KEPT_PIECES:
            self.kept.clear()
            new = list(every)
        self.learn(new)
        kept = self.kept
        if long:
            return [self.spelled(b"".join([long[x] if x in long else kept[x] for x in pieces])) for pieces in parts]
        return [self.spelled(b"".join(map(kept.__getitem__, pieces))) for pieces in parts]

    def encode(self, text: str) -> tuple[str, str, int]:
        """Ids and decoded text of a whole text, and the number of tokens."""
        return self.encode_all([text])[0]

    def long_tokens(self, piece: str) -> list[str]:
        """The pre-tokens of a long piece."""
        return [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]

    def tokens(self, text: str, last: bool) -> list[str]:
        """The tokens of a part of a pre-token; only its last part takes the mark of a word's end."""
        if not text:
            return []
        if last:
            return [t.value for t in self.tokenizer.model.tokenize(text)]
        if self.inner is None:
            self.inner = models.BPE(vocab=self.spec["vocab"], merges=[tuple(m) for m in self.spec["merges"]])
        return [t.value for t in self.inner.tokenize(text)]

    def join(self, left: list[str], right: list[str], last: bool) -> list[str]:
        """The tokens of two neighbouring parts together; ``last`` if the right part ends its pre-token."""
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            at_end = last and j == len(right)
            window = [*left[i:], *right[:j]]
            if at_end:
                window[-1] = window[-1].removesuffix(self.spec["end_of_word_suffix"] or "\0")
            again = self.tokens("".join(window), at_end)
            starts = i == 0 or bool(again) and again[0] == left[i]
            ends = j == len(right) or bool(again) and again[-1] == right[j - 1]
            if starts and ends:
                return left[:i] + again + right[j:]
            width *= 2

    def tree(self, leaves: list[list[str]]) -> list[str]:
        """Concatenate the tokens of the leaves of one pre-token, neighbours first."""
        level = [(tokens, k == len(leaves) - 1) for k, tokens in enumerate(leaves)]
        while len(level) > 1:
            up = [(self.join(level[k][0], level[k + 1][0], level[k + 1][1]), level[k + 1][1]) for k in range(0, len(level) - 1, 2)]
            level = up + level[len(up) * 2:]
        return level[0][0] if level else []

    def coded(self, piece: str, leaf: int = LEAF) -> bytes:
        """The coded ids of a long piece, all its leaves in this task."""
        out = []
        for word in self.long_tokens(piece):
            cuts = leaves_of(word, leaf)
            out += self.tree([self.tokens(s, k == len(cuts) - 1) for k, s in enumerate(cuts)])
        return self.named(out)

    def joined(self, piece: str, leaf: int = LEAF) -> tuple[str, str, int]:
        """Ids and decoded text of a long piece, and the number of tokens."""
        return self.spelled(self.coded(piece, leaf))

    def named(self, tokens: list[str]) -> bytes:
        """The coded ids of tokens."""
        return np.array([self.tokenizer.token_to_id(t) for t in tokens], np.uint32).tobytes()


def leaves_of(text: str, leaf: int) -> list[str]:
    """A text in parts of ``leaf`` characters."""
    return [text[k:k + leaf] for k in range(0, len(text), leaf)]


def _encode_rows(content, keys: list[str]):
    """Rows of the key columns with the encoding of their text, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(content.value)
        for batch in batches:
            texts = batch.column("text")
            low = 0
            while low < len(texts):
                held, size = [], 0
                while low + len(held) < len(texts) and size < 1 << 20:
                    held.append(texts[low + len(held)].as_py() or "")
                    size += len(held[-1])
                rows = encoder.encode_all(held)
                columns = [batch.column(k).slice(low, len(rows)) for k in keys]
                columns += [pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string()),
                            pa.array([r[1] for r in rows], pa.string())]
                yield pa.record_batch(columns, [*keys, "n_tokens", "ids", "decoded"])
                low += len(rows)
            give_back()

    return run


def _cut(content, leaf: int):
    """A long text as rows: runs of ordinary pieces, and the leaves of each long pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(content.value)
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                rows, plain = [], []

                def flush() -> None:
                    if plain:
                        rows.append((len(rows), 0, 0, " ".join(plain)))
                        plain.clear()

                for part in encoder.parts(text):
                    if len(part) <= leaf:
                        plain.append(part)
                        continue
                    flush()
                    for word in encoder.long_tokens(part):
                        cuts = leaves_of(word, leaf)
                        at = len(rows)
                        rows += [(at, k, len(cuts), s) for k, s in enumerate(cuts)]
                flush()
                yield pa.record_batch(
                    [pa.array([digest] * len(rows)), *(pa.array([r[c] for r in rows], pa.int32()) for c in range(3)),
                     pa.array([r[3] for r in rows], pa.string())], ["digest", "part", "leaf", "leaves", "content"])

    return run


def _encode_leaves(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(content.value)
        for batch in batches:
            made = []
            for leaf, leaves, text in zip(*(batch.column(c).to_pylist() for c in ("leaf", "leaves", "content"))):
                made.append(encoder.tokens(text, leaf == leaves - 1) if leaves else list(encoder.encode(text)[:2]))
            yield pa.record_batch([*(batch.column(c) for c in ("digest", "part", "leaf", "leaves")), pa.array(made, pa.list_(pa.string()))],
                                  ["digest", "part", "leaf", "leaves", "tokens"])

    return run


def _concatenate(content):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        encoder = PieceEncoder(content.value)
        parts: dict[int, list] = {}
        for r in sorted(rows.to_pylist(), key=lambda r: (r["part"], r["leaf"])):
            parts.setdefault(r["part"], []).append(r)
        out = []
        for held in parts.values():
            if held[0]["leaves"]:
                out.append(encoder.spelled(encoder.named(encoder.tree([r["tokens"] for r in held]))))
            else:
                ids, decoded = held[0]["tokens"]
                out.append((ids, decoded, len(ids.split())))
        out = [x for x in out if x[2]]
        return pa.table({"digest": pa.array([key[0].as_py()]), "n_tokens": pa.array([sum(x[2] for x in out)], pa.int64()),
                         "ids": pa.array([" ".join(x[0] for x in out)]), "decoded": pa.array([" ".join(x[1] for x in out)])})

    return run


def encode(docs: DataFrame, content: str, keys: list[str], text: str = "text", leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """The key columns with ``n_tokens``, ``ids`` (decimal, joined by one space) and ``decoded`` of each row's whole text.

    ``content`` is the tokenizer's file. Texts with a run of more than ``spread`` leaves without white space have their leaves
    spread over tasks; equal ones among them are encoded once.
    """
    held = docs.sparkSession.sparkContext.broadcast(content)
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    most = spread * leaf
    # the length spares most texts the search
    long = (F.length("text") > most) & F.col("text").rlike(rf"[^\t-\r ]{{{most + 1}}}")
    short = rows.where(~long).mapInArrow(_encode_rows(held, keys), f"{kinds}, {ENCODED}")
    far = rows.where(long).withColumn("digest", F.sha2("text", 256))
    made = (
        far.groupBy("digest").agg(F.first("text").alias("text"))
        .mapInArrow(_cut(held, leaf), "digest string, part int, leaf int, leaves int, content string")
        .repartition("digest", "part", "leaf")
        .mapInArrow(_encode_leaves(held), "digest string, part int, leaf int, leaves int, tokens array<string>")
        .groupBy("digest").applyInArrow(_concatenate(held), f"digest string, {ENCODED}")
    )
    return short.union(far.drop("text").join(made, "digest").select(*keys, "n_tokens", "ids", "decoded"))
