import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brute import KneserNey, words
from cohortry.llm import kneser_ney

rng = random.Random(11)
VOCABULARY = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
TEXTS = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([1, 5, 40, 200]))) for _ in range(60)]
TEXTS += ["", None, "  \t", "UPPER Case", TEXTS[0], TEXTS[0], "x " * 30_000]


def test_equals_the_plain_model(documents):
    model = kneser_ney.fit(documents(TEXTS, extra=True))
    plain = KneserNey(TEXTS)
    asked = [*TEXTS, "never seen words here", "w1 never w1"]
    rows = kneser_ney.scores(documents(asked, extra=True), model, ["doc_id"]).collect()
    assert (model.tokens, model.vocabulary) == (sum(plain.count.values()), len(plain.count))
    assert len(rows) == len(asked)
    for r in rows:
        tokens = [*words(asked[r.doc_id]), "</s>"]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(t in plain.count for t in tokens))
        assert r.base_score == pytest.approx(plain.base(asked[r.doc_id]), rel=1e-9)
        assert r.score == pytest.approx(plain.score(asked[r.doc_id]), rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    plain = KneserNey(TEXTS)
    for context in ("<s>", "w1", "upper", "unknown"):
        known = sum(plain.chance(context, w) for w in plain.count)
        assert known + plain.chance(context, "never seen") == pytest.approx(1)


def test_without_training_texts(documents):
    model = kneser_ney.fit(documents([]).where("false"))
    rows = kneser_ney.scores(documents(["a b", None]), model, ["doc_id"]).collect()
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in rows) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    full = kneser_ney.fit(documents(["a b"]))
    assert kneser_ney.scores(documents([]).where("false"), full, ["doc_id"]).collect() == []


def test_blocks_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    counts = np.arange(len(keys))
    back = kneser_ney.unpack(kneser_ney.pack(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()


def test_more_than_2_32_tokens_and_counts(tmp_path):
    vocabulary, shards = 5 * 2**32 + 3, 1 << 16
    bits, span = kneser_ney._pair_keys(vocabulary, shards)
    assert bits == 35 and 1 < span < shards and kneser_ney._pair_keys(2**31, 64) == (32, 64)
    bounds = np.append(kneser_ney._bounds(vocabulary, shards), vocabulary + 1)
    assert (bounds[np.minimum(np.arange(0, shards, span) + span, shards)] - bounds[np.arange(0, shards, span)]).max() <= 1 << 64 - bits
    shard = shards - 2  # neither the first nor the last of its group
    group, context = bounds[shard // span * span], int(bounds[shard]) + 5
    # followers that are equal in their low 32 bits, and a count beyond 32 bits
    seen = {7: 2, 7 + 2**32: 1, 7 + 2**33: 3 * 2**32, vocabulary - 1: 2**32 - 1}
    keys = (np.uint64(context - group) << np.uint64(bits)) | np.array(list(seen), np.uint64)
    made = kneser_ney.blocks(keys, np.array(list(seen.values())), (bounds[shard:shard + 1] - group).astype(np.uint64) << np.uint64(bits), shard)
    folder = f"file://{tmp_path}/arrays"
    out = kneser_ney._write_pairs(folder, vocabulary, shards)((None,), pa.Table.from_batches([made]))
    assert out["total"][0].as_py() == sum(seen.values())
    assert sorted(out["shard"].drop_null().to_pylist()) == sorted({int(np.searchsorted(bounds, w, "right")) - 1 for w in seen})
    offsets = [*range(0, vocabulary, -(-vocabulary // shards)), vocabulary]
    offsets += [vocabulary] * (shards + 1 - len(offsets))
    model = kneser_ney.Model(folder, 16, offsets, shards, 10, (0.5, 0.75, 1.0), (0.5, 0.75, 1.0), (1, 0, 0), 4)
    asked = np.array([*seen, 8, -1])
    scorer = kneser_ney.Scorer(model)
    lower = scorer.continuation(asked)
    total, discount = sum(seen.values()), {1: 0.5, 2: 0.75}
    rest = (0.5 + 0.75 + 2 * 1.0) / total
    counts = [*seen.values(), 0, 0]
    want = [(c - discount.get(c, 1.0 if c else 0)) / total + rest * b for c, b in zip(counts, lower)]
    assert scorer.probability(np.full(len(asked), context), asked) == pytest.approx(want, rel=1e-12)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    from cohortry.llm.queries import QUERIES

    rows = QUERIES["op7_kneser_ney_scores"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
