import collections
import random
import re

import pytest

from cohortry.llm import line_frequency
from cohortry.llm.line_frequency import LineRules

DIGITS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain(rows, rules):
    """{(id, text): verdict} of (id, text, host) rows, and the cleaned text of each."""
    texts = collections.defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
    seen = collections.Counter()
    for host, some in texts.items():
        for text in some:
            seen.update({(host, " ".join(words(x)).translate(DIGITS)) for x in text.split("\n") if words(x)})
    out = {}
    for i, text, host in rows:
        t = text or ""
        w = words(t)
        windows = collections.defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k:k + 8])].append(k)
        again = {k + d for at in windows.values() if len(at) > 1 for k in at for d in range(8)}
        full = [x for x in t.split("\n") if words(x)]
        limit = max(rules.least_documents, -(-rules.per_mille * len(texts[host]) // 1000))
        common = [x for x in full if seen[host, " ".join(words(x)).translate(DIGITS)] >= limit]
        gone = sum(len(words(x)) for x in common)
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        kept = not failed and len(w) - gone >= rules.least_words and 100 * gone <= rules.most_removed * len(w)
        out[i, text] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again),
                        failed, gone, kept, "\n".join(x for x in t.split("\n") if x not in common) if common else text)
    return out


def corpus():
    rng = random.Random(6)
    lines = [" ".join(rng.choice("alpha beta Gamma delta é€ #x <b> 12 9 $".split()) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    rows = []
    for k in range(160):
        own = [rng.choice(lines) for _ in range(rng.randrange(0, 9))]
        own += ["Page %d of 10" % k, "  Share\tthis \x0b article ", "a fixed footer of the site with ten words in it"][:rng.randrange(4)]
        if rng.random() < 0.2:
            own += own
        rng.shuffle(own)
        rows.append((k, "\n".join(own) + rng.choice(["", "\n", "\n\n", " \r\n"]), rng.choice(["h1", "h1", "h2", None])))
    rows += [(1000 + k, "the same copied page on and on " * 5 + "\nits second line", "h3") for k in range(30)]
    rows += [(2000, None, "h1"), (2001, "", None), (2002, " \n\n\t", "h2"), (None, "x " * 30, "h1"), (2003, "y " * 30, "h1"), (2003, "z z2 " * 30, "h1"),
             (2004, "very long text %d " * 20_000, "h1"), (rows[0])]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    for name in ("host", "doc", "line", "lines", "words", "l", "n", "common", "documents", "row", "kept", "host_hash", "fixed"):
        docs = docs.selectExpr("*", f"1 AS `{name}`")
    return docs.repartition(5)


RULES = LineRules(least_documents=5, per_mille=100)


@pytest.mark.parametrize("rules", [RULES, LineRules()])
def test_verdicts_equal_the_plain_version(frame, rules):
    want = plain(corpus(), rules)
    got = line_frequency.audited(frame.withColumn("t", frame.text), ["doc_id", "t"], rules).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert tuple(r[c] for c in (*line_frequency.COUNTS, "base_failed", "n_common_words", "kept")) == want[r.doc_id, r.t][:8], r.t
    assert rules is not RULES or len({r.kept for r in got if not r.base_failed}) == 2


def test_copies_of_a_page_are_no_boilerplate(frame):
    found = line_frequency.audited(frame, ["doc_id"], RULES).where("doc_id BETWEEN 1000 AND 1029").collect()
    assert len(found) == 30 and {r.n_common_words for r in found} == {0}


def test_cleaned_texts(frame):
    want = plain(corpus(), RULES)
    got = line_frequency.cleaned(frame, RULES)
    assert got.columns == frame.columns
    left = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert left == collections.Counter((i, want[i, t][8]) for i, t, _ in corpus() if want[i, t][7])


def test_odd_tables(frame):
    assert line_frequency.audited(frame.where("false"), ["doc_id"]).collect() == []
    assert line_frequency.cleaned(frame.where("false")).collect() == []
    with pytest.raises(ValueError):
        line_frequency.audited(frame, ["doc_id", "kept"])
