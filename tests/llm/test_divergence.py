import collections
import random
import re

import numpy as np
import pytest

from cohortry.llm import divergence
from cohortry.llm.divergence import AuditParameters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, p):
    """All rows of the audit of (lang, source, text) rows."""
    rows = [(lang or "", source or "", text) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        documents = collections.Counter(t for r in mine for t in set(terms(r[2])))
        kept = sorted(t for t, n in documents.items() if n >= p.least_documents)
        counts = {s: collections.Counter() for s in {r[1] for r in mine}}
        for _, source, text in mine:
            counts[source].update(t for t in terms(text) if documents[t] >= p.least_documents)

        def share(count):
            size = sum(count[t] for t in kept)
            return {t: 1 + p.scale * (count[t] + p.added) // (size + p.added * len(kept)) for t in kept}

        shares, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in counts if o != s]
            more = [(shares[s][t] - whole[t], t) for t in kept if counts[s][t] and shares[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", more, p.top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["a", "The", "of", "Straße", "été", "\U0001f600x", "exactly8", "Exactly16letters", "seventeenletters1", "x" * 33, "y" * 64, "z" * 65,
             "zz" * 300, "nine_char", "ninechars", "abcdefgh", "abcdefghi", " ", "q" * 5000] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(150):
        some = rng.sample(words, 12)
        text = rng.choice([" ", "-", "\n0"]).join(rng.choice(some) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "S2", "é", None, "s5", "s6"]), text))
    return [*rows, ("fr", "s1", None), ("fr", "s2", "123 - _"), ("de", "empty", ""), ("en", "s1", "loud " * 30_000), *rows[:5]]


@pytest.fixture(scope="module")
def frame(spark):
    docs = spark.createDataFrame(corpus(), "lang string, source string, text string")
    for name in ("term", "n", "documents", "block", "tile", "a", "b", "value", "rank", "item", "doc_id"):
        docs = docs.selectExpr("*", f"1 AS `{name}`")
    return docs.repartition(4)


@pytest.mark.parametrize("p", [AuditParameters(least_documents=4), AuditParameters(3, 2, 1000, 4, 2, 5)])
def test_audit_equals_the_plain_version(frame, p):
    got = divergence.audited(frame, p)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain(corpus(), p)


def test_odd_tables(frame):
    assert divergence.audited(frame.where("false")).collect() == []
    got = divergence.audited(frame.where("lang = 'fr'")).collect()
    assert sorted((r.source, r.part, r.item, r.value, r.rank) for r in got) == [("s1", "pair", "s2", 0, 1), ("s2", "pair", "s1", 0, 1)]


def test_packing_and_sorting():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(c) for c in rng.choice([97, 98, 233, 0x1F600], rng.integers(1, 40))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    seen = []
    for which, words in divergence.TermPacker().packed(data, ends - [len(r) for r in raw], ends):
        assert divergence._strings(words).to_pylist() == [texts[i] for i in which]
        order = divergence._sorted_order(words)
        assert [raw[i] for i in which[order]] == sorted(raw[i] for i in which)
        seen += which.tolist()
    assert sorted(seen) == list(range(500))
