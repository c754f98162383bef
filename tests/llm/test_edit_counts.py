import random
import re

import pytest

from cohortry.llm import edit_counts
from cohortry.llm.edit_counts import PieceCounter, SegmentTree
from cohortry.llm.queries import tokenizer_file

RANKS = tokenizer_file("byte_bpe_50k.tiktoken").encode()


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(RANKS)


def full(counter, text):
    return len(counter.encoding.encode_ordinary(text or ""))


@pytest.mark.parametrize("leaf", [1, 5, 40, 256])
def test_edited_trees_equal_counting_anew(counter, monkeypatch, leaf):
    monkeypatch.setattr(edit_counts, "_LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(150):
        alphabet = rng.choice(["ab  '", "don't we'll  \n x1", "é日 \t..", "word  words 123 "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(500)))
        tree = SegmentTree.of(edit_counts._sizes(counter.leaves(text), 0))
        for _ in range(8):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 40]))
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 60])))
            wanted = text[:a] + new + text[b:]
            text, tree, _ = tree.edit(text, a, b, new, counter)
            assert (text, tree.tokens[1], tree.chars[1]) == (wanted, full(counter, wanted), len(wanted))
            for node in range(1, tree.size):
                assert tree.tokens[node] == tree.tokens[2 * node] + tree.tokens[2 * node + 1]


@pytest.mark.parametrize("leaf", [1, 5, 40, 256])
def test_many_edits_at_once_equal_counting_anew(counter, monkeypatch, leaf):
    monkeypatch.setattr(edit_counts, "_LEAF", leaf)
    rng = random.Random(100 + leaf)
    for _ in range(200):
        alphabet = rng.choice(["ab  '", "don't we'll  \n x1", "é日 \t..", "word  words 123 ", "ab\x1c!\x85 ", "'s'll 've"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(600)))
        tree = SegmentTree.of(edit_counts._sizes(counter.leaves(text), 0))
        for _ in range(3):
            cuts = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randrange(8)))
            edits = [(a, b, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 30])))) for a, b in zip(cuts[::2], cuts[1::2])]
            wanted, at = "", 0
            for a, b, new in edits:
                wanted, at = wanted + text[at:a] + new, b
            wanted += text[at:]
            text, tree, _ = tree.edit_all(text, edits, counter)
            assert (text, tree.tokens[1], tree.chars[1]) == (wanted, full(counter, wanted), len(wanted))


def test_many_edits_of_a_long_text_take_one_pass(counter):
    text = "word #### and 12345678 more " * 20_000
    edits = [(m.start(), m.end(), "*") for m in re.finditer(r"#+|[0-9]{6,}", text)]
    tree = SegmentTree.of(edit_counts._sizes(counter.leaves(text), 0))
    new, tree, recoded = tree.edit_all(text, edits, counter)
    assert tree.tokens[1] == full(counter, new) and recoded <= len(new)


def test_only_the_region_is_encoded(counter):
    text = "some plain words and more " * 4000
    tree = SegmentTree.of(edit_counts._sizes(counter.leaves(text), 0))
    new, tree, recoded = tree.edit(text, 50_000, 50_004, "x", counter)
    assert recoded < 2000 and tree.tokens[1] == full(counter, new)


def test_columns(spark, documents, counter):
    texts = [None, "", "no edit here", "a ### b 1234567 c", "$$$ first and last &&&", "x ** " * 20_000, "###"]
    docs = documents([*enumerate(texts), (None, texts[3]), (3, texts[3])], extra=True).selectExpr("*", "1 AS recoded", "2 AS chars")
    rows = edit_counts.build(edit_counts.pattern_edits(docs, r"[#$%&*!]{2,}|[0-9]{6,}", "*"), RANKS)
    first = rows.withColumn("n_tokens", edit_counts.n_tokens())
    got = edit_counts.update(first, RANKS).withColumn("after", edit_counts.n_tokens()).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        old = texts[r.doc_id if r.doc_id is not None else 3]
        assert r.n_tokens == full(counter, old) and r.after == full(counter, r.text)
    given = docs.where("doc_id = 2").drop("edits").selectExpr("*", "array(named_struct('start', 3, 'end', 999, 'replacement', cast(null as string))) AS edits")
    assert [r.text for r in edit_counts.update(edit_counts.build(given, RANKS), RANKS).collect()] == ["no "]
    assert edit_counts.update(rows.where("false"), RANKS).collect() == []


def test_query_counts(spark, counter):
    from cohortry.llm.queries import QUERIES

    directory = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    for r in QUERIES["op5_edit_aware_counts"](spark, directory).collect():
        new, n = re.subn(r"[#$%&*!]{2,}|[0-9]{6,}", "*", texts[r.doc_id])
        assert (r.n_tokens, r.n_edits, r.n_tokens_after, r.n_chars_after) == (full(counter, texts[r.doc_id]), n, full(counter, new), len(new))
