import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cohortry.llm import periodic_runs
from cohortry.llm.queries import QUERIES


def plain_runs(words, least=24):
    """[(start, period, length)] by comparing all words of every period."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        k = 0
        while k < len(words) - p:
            end = k
            while end < len(words) - p and words[end] == words[end + p]:
                end += 1
            if end - k + p >= max(least, 3 * p) and end > k:
                found.setdefault((k, end - k + p), p)
            k = max(end, k + 1)
    return sorted((s, p, n) for (s, n), p in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    letters = rng.choice([1, 2, 3, 6, 60])
    words = [rng.randrange(letters) for _ in range(rng.randrange(80))]
    for _ in range(rng.randrange(3)):
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (base * 60)[:rng.randrange(60)]
    return words


@pytest.mark.parametrize("most_held", [0, 1 << 21])
def test_runs_equal_all_comparisons(most_held):
    rng = random.Random(4)
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        first = np.cumsum([0, *map(len, texts)])
        words = np.array([w for t in texts for w in t], np.uint64)
        found = periodic_runs.find_runs(words, first, most_held=most_held)
        for k, text in enumerate(texts):
            mine = [(int(s), int(p), int(n)) for t, s, n, p in zip(*found) if t == k]
            assert mine == plain_runs(text), text


def test_common_extensions_of_a_grammar():
    rng = random.Random(9)
    for _ in range(60):
        row = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(2, 120))]
        row = np.array([90, *row, 91])
        grammar = periodic_runs.Grammar(row, small=rng.choice([2, 30]))
        i, j = np.array([(i, j) for j in range(1, len(row)) for i in range(1, j)] or [(0, 1)]).T
        ahead, before = grammar.common(i, j), grammar.common(i, j, forward=False)
        for a, b, n, m in zip(i.tolist(), j.tolist(), ahead.tolist(), before.tolist()):
            assert (row[a:a + n] == row[b:b + n]).all() and row[a + n] != row[b + n] or b + n == len(row)
            assert (row[a - m:a] == row[b - m:b]).all() and (a == m or row[a - m - 1] != row[b - m - 1])


def test_very_repetitive_text_in_small_memory():
    text, start, length, period = periodic_runs.find_runs(np.zeros(60_000, np.uint64), np.array([0, 60_000]), most_held=1000)
    assert (text.tolist(), start.tolist(), length.tolist(), period.tolist()) == ([0], [0], [60_000], [1])


def test_columns(documents):
    rng = random.Random(3)
    rows = [(k, " \n".join(f"w{w}" for w in random_words(rng))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "a b " * 30), (103, "a b " * 30), (103, "a b " * 30),
             (104, "é \U0001f600 " * 20_000), (105, "  lead " + "x y z " * 9 + "tail  ")]
    got = periodic_runs.with_runs(documents(rows, extra=True), ["doc_id"]).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        if r.doc_id == 104:
            assert [tuple(x) for x in r.runs] == [(0, 40_000, 2)] and r.collapsed == "é \U0001f600"
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        runs = plain_runs(words)
        assert r.n_words == len(words) and [(x.start, x.period, x.length) for x in r.runs] == runs
        assert r.collapsed == plain_collapsed(words, runs)
    with pytest.raises(ValueError):
        periodic_runs.with_runs(documents(["x"]).selectExpr("doc_id AS runs", "text"), ["runs"])
    assert periodic_runs.with_runs(documents(["x"]).where("false"), ["doc_id"]).collect() == []


def test_query_against_the_plain_version(spark):
    directory = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    got = QUERIES["op12_periodic_runs"](spark, directory).collect()
    assert len(got) == len(texts) and any(r.n_runs for r in got)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        listed = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        best = max(runs, key=lambda x: (x[2] / x[1], -x[0], -x[1]), default=None)
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
