import random

import numpy as np
import pytest

from brute import duplicate_components
from cohortry.llm.jaccard_join import JoinParameters, near_duplicates, prefix_keys


def found(frame, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, **more).collect()}


def corpus(seed, n=160):
    """Texts with copies, edited copies, chains of edits, shared passages and odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + rng.choice(["an", "or", "is", "um"]) + str(rng.randrange(40))
    shared = [" ".join(word() for _ in range(60)) for _ in range(2)]
    texts = [None, "", "  \t ", "one", "ONE", "two words", "a b c d e", "a b c d e a b c d e"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.4 or len(texts) < 12:
            texts.append(" ".join(word() for _ in range(rng.choice([6, 30, 80, 150, 300]))))
        elif kind < 0.5:
            texts.append(rng.choice(texts))
        elif kind < 0.65:
            texts.append(f"{rng.choice(shared)} {' '.join(word() for _ in range(rng.choice([3, 15, 200])))}")
        else:
            w = (rng.choice(texts) or "x").split() or ["x"]
            for _ in range(max(1, len(w) // rng.choice([15, 30, 60]))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    return texts


@pytest.mark.parametrize("parameters", [JoinParameters(), JoinParameters(log2_counters=12, pairs_from=1, triples_from=8)])
def test_equals_comparing_every_pair(documents, parameters):
    texts = dict(enumerate(corpus(len(repr(parameters)))))
    assert found(documents(list(texts.items()), extra=True), parameters=parameters) == duplicate_components(texts)


def test_repeated_rows_missing_ids_and_long_texts(documents):
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (2, "A B C D E F G"), (None, "a b c d e f g"), (9, long), (8, long + " end"), (1, None)]
    got = [tuple(r)[:3] for r in near_duplicates(documents(rows)).collect()]
    size = 7919
    assert sorted(got, key=repr) == sorted(
        [(5, 3, 2), (5, 3, 2), (2, 3, 2), (None, 3, None), (9, size, 8), (8, size + 1, 8), (1, 0, 1)], key=repr)


def test_texts_of_one_id_are_one_node(documents):
    a, b = "a b c d e f g", "h i j k l m n"
    assert sorted(tuple(r)[:3] for r in near_duplicates(documents([(5, a), (5, b), (3, b), (7, a)])).collect()) == [
        (3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 3, 3)]
    got = near_duplicates(documents([(9, a), (9, b), (8, b + " x"), (4, "o p q r s t"), (None, a), (9, None)])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(9, 9), (9, 9), (8, 8), (4, 4), (None, None), (9, 9)], key=repr)


def test_empty_table(documents):
    assert near_duplicates(documents([]).where("false")).collect() == []


def test_linked_sets_share_a_key():
    """The filter's guarantee: whatever the classes, sets that link have a key in common."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        universe = rng.integers(0, 2**63, 2 * n + 4, dtype=np.uint64)
        level = dict(zip(universe.tolist(), rng.choice([1, 2, 3], len(universe), p=rng.dirichlet([1, 1, 1]))))
        x = set(universe[:n].tolist())
        drop = int(rng.integers(0, n // 5 + 1))
        y = set(list(x)[drop:]) | set(universe[n:n + int(rng.integers(0, n // 5 + 1))].tolist())
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        keys = [set(prefix_keys(s, np.array([level[h] for h in s.tolist()], np.int8), 80).tolist())
                for s in (np.array(sorted(z), np.uint64) for z in (x, y))]
        assert keys[0] & keys[1]
