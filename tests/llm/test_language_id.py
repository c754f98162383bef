import random
from collections import Counter

import numpy as np

from cohortry.llm import language_id

DE = "der hund und die katze sind nicht im garten aber das haus ist schön und groß"
EN = "the dog and the cat are not in the garden but the house is nice and large"


def guesses(frame, model):
    rows = frame.withColumn("guess", language_id.predicted(frame, model)).select("doc_id", "guess").collect()
    return {r.doc_id: (r.guess.language, r.guess.score) for r in rows}


def test_learns_and_names_what_it_cannot_read(documents):
    train = documents([(k, t, g) for k, (t, g) in enumerate([(DE, "de"), (EN, "en"), (EN, None), (None, "fr")] * 3)], extra=True)
    model = language_id.fit(train)
    assert sorted(model.languages) == ["de", "en"]
    asked = documents([(1, "die katze ist im haus"), (2, "THE CAT IS IN THE HOUSE " * 20_000), (3, None), (4, ""), (5, "12 !? 34"), (6, "Ж"), (None, EN)], extra=True)
    got = guesses(asked, model)
    assert [got[k][0] for k in (1, 2, 3, 4, 5, None)] == ["de", "en", "und", "und", "und", "en"]
    assert got[6][0] in model.languages and got[6][1] == 0
    assert all(0 <= s <= 1 for _, s in got.values())


def test_without_training_texts(documents):
    model = language_id.fit(documents([]).where("false"))
    assert guesses(documents([(1, EN)]), model) == {1: ("und", 0.0)}
    assert guesses(documents([]).where("false"), model) == {}


def plain_ngrams(text):
    """The n-grams of a text as byte strings, word by word."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    bordered = [b" " + w + b" " for w in folded.split(b" ") if w]
    return [w[k:k + n] for n in (3, 4) for w in bordered for k in range(len(w) - n + 1)]


def plain_sets(training, p):
    """The n-grams that each language contains, languages with most training n-grams first."""
    counts = {}
    for text, lang in training:
        counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    rates = {g: {n: c / counts[g].total() for n, c in counts[g].items()} for g in counts}
    highest = {n: max(r.get(n, 0) for r in rates.values()) for r in rates.values() for n in r}
    return {g: {n for n, r in rates[g].items() if r >= p.least_rate and r >= p.share * highest[n]}
            for g in sorted(counts, key=lambda g: (-counts[g].total(), g))}


def test_equals_plain_sets(documents):
    rng = random.Random(4)
    letters = {"de": "etaoinshrdluäöü", "en": "etaoinshrdlu", "fr": "etaoinshéèç", "pl": "etaoinząęł"}
    stock = {g: ["".join(rng.choices(alphabet, k=rng.choice([1, 2, 3, 6, 9]))) for _ in range(60)] for g, alphabet in letters.items()}

    def text(g, n):
        return rng.choice(["", " ", "...", "7"]) + rng.choice([" ", ", ", " 3 - "]).join(w.title() for w in rng.choices(stock[g], k=n))

    training = [(text(g, 40), g) for g in letters for _ in range(12)] + [(text("en", 30), "de")]
    training += training[:5]  # repeated rows count
    p = language_id.FilterParameters(share=0.3)
    model = language_id.fit(documents([(k, t, g) for k, (t, g) in enumerate(training)], extra=True), p)
    sets = plain_sets(training, p)
    assert model.languages == list(sets)
    asked = [text(g, n) for g in letters for n in (1, 2, 5, 30, 300)] + [f"{text('de', 9)} {text('pl', 9)}", "q", EN, EN]
    for frame in (documents(asked), documents(asked).repartition(len(asked))):  # a slice's first text is like any other
        got = guesses(frame, model)
        for k, t in enumerate(asked):
            grams = plain_ngrams(t)
            shares = {g: sum(n in held for n in grams) / len(grams) for g, held in sets.items()}
            assert abs(shares[got[k][0]] - max(shares.values())) < 1e-3 and abs(got[k][1] - max(shares.values())) < 1e-3, t


def test_ties_go_to_the_larger_language_then_by_name(documents):
    for first, second, want in ((2, 1, "b"), (1, 2, "a"), (1, 1, "a")):
        rows = [(EN, "b")] * first + [(EN, "a")] * second
        model = language_id.fit(documents([(k, t, g) for k, (t, g) in enumerate(rows)]))
        assert guesses(documents([(1, EN), (2, EN)]), model) == {1: (want, 1.0), 2: (want, 1.0)}


def test_false_positives_are_corrected():
    """Random n-grams explain nothing, however full the filter is."""
    rng = np.random.default_rng(1)
    slots = rng.integers(0, 2**62, (1 << 10, 1), dtype=np.uint64) & np.uint64(3)
    fill = np.array([(slots >> np.uint64(k) & np.uint64(1)).mean() for k in range(2)])
    model = language_id.LanguageFilter(["a", "b"], slots, fill**2, 2)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000)).encode()
    assert language_id.explained(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model).max() < 0.05


def test_held_out_accuracy(spark):
    from cohortry.llm.queries import QUERIES

    directory = "/root/testdata/sf0.001"
    got = QUERIES["op8_language_id"](spark, directory).join(spark.read.parquet(f"{directory}/documents.parquet"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 0
