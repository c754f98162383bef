import hashlib
import random

import pytest

from cohortry.llm import bpe
from cohortry.llm.queries import tokenizer_file

CONTENT = tokenizer_file("word_bpe_49k.json")
rng = random.Random(7)
LONG = "".join(rng.choice("abcdeinrst") for _ in range(20_000))
TEXTS = ["", "  ", "Hello, World!  it's", "a<|endoftext|>b <|startoftext|>c", "x\x1cy z\u0085q", "Ünïcödé İ ſ ẞ", " ́combining", LONG,
         f"before {LONG[:9000]}, after\n{LONG[9000:15000]}<|endoftext|>{LONG[:5000]} end", "日本語" * 3000, "😀" * 3000, "don't " * 3000]


@pytest.fixture(scope="module")
def encoder():
    return bpe.PieceEncoder(CONTENT)


def wanted(encoder, text):
    ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), encoder.tokenizer.decode(ids, skip_special_tokens=False), len(ids)


def test_pieces_equal_the_library(encoder):
    assert encoder.encode_all(TEXTS) == [wanted(encoder, t) for t in TEXTS]


def test_plain_and_odd_texts_equal_the_library(encoder):
    alphabets = ["ab C", "aZ09 .,", "it's ", "éÀß ö", "x\u0149İ ı", "a²½ª µº×÷", "\x1c\x85\xa0a ", "'S 't'LL", "日 aé", "e\u0301 E\u0308x", "<|endoftext|> a", "<|{~ `["]
    texts = ["".join(rng.choice(rng.choice(alphabets)) if k % 3 else rng.choice("ab .") for _ in range(rng.randrange(40))) for k in range(3000)]
    texts += ["".join(rng.choice(a) for _ in range(30)) for a in alphabets for _ in range(50)]
    for low in range(0, len(texts), 200):
        part = texts[low:low + 200]
        assert encoder.encode_all(part) == [wanted(encoder, t) for t in part]


def test_joined_leaves_equal_the_library(encoder):
    for _ in range(300):
        alphabet = rng.choice(["ab", "the", "aeinrst", "ühß日本é", "x1.-_", "😀a"])
        piece = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300)))
        assert encoder.joined(piece, rng.choice([1, 2, 3, 7, 16, 50])) == wanted(encoder, piece)


def test_parallel_way_equals_the_library(documents, encoder):
    rows = [*enumerate(TEXTS), (90, None), (None, LONG), (7, LONG)]
    docs = documents(rows, extra=True)
    for leaf, spread in ((bpe.LEAF, bpe.SPREAD), (bpe.LEAF, 1), (500, 1), (500, 10)):
        made = bpe.encode(docs, CONTENT, ["doc_id"], leaf=leaf, spread=spread)
        got = sorted(((r.doc_id, r.ids, r.decoded, r.n_tokens) for r in made.collect()), key=repr)
        assert got == sorted(((i, *wanted(encoder, t)) for i, t in rows), key=repr)
    assert bpe.encode(docs.where("false"), CONTENT, ["doc_id"]).collect() == []


def test_the_store_may_be_cleared(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT_PIECES", 50)
    small = bpe.PieceEncoder(CONTENT)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(100)) for _ in range(20)]
    assert [r for t in texts for r in small.encode_all([t])] == [wanted(encoder, t) for t in texts]


def test_query_digests(spark, encoder):
    from cohortry.llm.queries import QUERIES

    directory = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op9_bpe_tree_concatenation"](spark, directory).collect():
        ids, decoded, n = wanted(encoder, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, sha(ids), sha(decoded))
