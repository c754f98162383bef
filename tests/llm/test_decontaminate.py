import random

from brute import words
from cohortry.llm.decontaminate import LeakParameters, clean_documents, common_words, find_leaks

rng = random.Random(9)
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ke", "mo", "tu") for b in ("ra", "li", "so", "ne") for c in range(12)]


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


ITEMS = {k: text(rng.choice([12, 20, 40, 90])) for k in range(12)}
SMALL = LeakParameters(log2_terms=12, rank=16)


def test_finds_whole_and_edited_items_and_nothing_else(spark, documents):
    swapped = words(ITEMS[3])
    for k in range(1, len(swapped) - 8, 5):
        swapped[k] = "other"
    rows = [(k, text(200)) for k in range(40)]
    rows += [(100, f"{text(150)} {ITEMS[0]} {text(90)}"), (101, ITEMS[1].upper()), (102, f"{text(33)}\n{' '.join(swapped)}\n{text(20)}"),
             (103, f"{ITEMS[2]} {text(30)} {ITEMS[4]} {ITEMS[4]}"), (104, None), (105, ""), (106, f"{text(30_000)} {ITEMS[5]} {text(30_000)}"),
             (None, ITEMS[6]), (100, f"{text(150)} {ITEMS[0]} {text(90)}")]
    items = [(k, t) for k, t in ITEMS.items()] + [(50, None), (51, "too short"), (0, ITEMS[0]), (None, ITEMS[7])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    frame = documents(rows, extra=True)
    got = sorted(((r.doc_id, r.item_id) for r in find_leaks(frame, benchmark, SMALL).collect()), key=repr)
    assert got == sorted([(100, 0), (100, 0), (101, 1), (102, 3), (103, 2), (103, 4), (106, 5), (None, 6)], key=repr)
    blocks = LeakParameters(log2_terms=12, rank=16, block_items=5)
    assert sorted(((r.doc_id, r.item_id) for r in find_leaks(frame, benchmark, blocks).collect()), key=repr) == got
    clean = clean_documents(frame, benchmark, SMALL)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [*range(40), 104, 105]


def test_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b c")])
    assert find_leaks(docs, nothing, SMALL).collect() == []
    assert clean_documents(docs, nothing, SMALL).count() == 1
    assert find_leaks(docs.where("false"), nothing.union(spark.createDataFrame([(1, ITEMS[0])], nothing.schema)), SMALL).collect() == []


def test_common_words_is_the_longest_common_subsequence():
    import numpy as np

    for _ in range(200):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))], np.uint64)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(0, 12))], np.uint64)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_words(a, b) == table[-1][-1]


def test_bounds_of_an_alignment_lose_none():
    """Counts in blocks and positions of the item are never below the alignment itself, for items of any length."""
    import numpy as np

    from cohortry.llm.decontaminate import LatentIndex, Searched

    p = LeakParameters(log2_terms=12, rank=4)
    numbers = np.random.default_rng(3)
    words = numbers.integers(0, 400, 3000).astype(np.uint64)
    items = [(k, numbers.integers(0, 200, n).astype(np.uint64)) for k, n in enumerate([8, 12, 20, 64, 65, 120])]
    inside = np.zeros(1 << 12, bool)
    inside[:200] = True
    searched = Searched.of(LatentIndex(np.ones(1 << 12, np.float32), np.ones((200, 4), np.float32), inside, [items], p), items)
    item = np.repeat(np.arange(len(items)), 50)
    low = numbers.integers(0, 2700, len(item))
    high = low + numbers.integers(1, 300, len(item))
    held = searched.word_numbers(words, words < 200)
    exact = np.array([common_words(items[i][1], words[a:b]) for i, a, b in zip(item, low, high)])
    assert searched.may_align(held, item, low, high, exact).all()
    assert not searched.may_align(held, item, low, high, np.full(len(item), 10**6)).any()
    assert (searched.common_lengths(words, held, item, low, high, exact) == exact).all()


def test_finds_altered_items_as_a_search_without_the_cosine(spark):
    """Items of which 60 to 85 % of the words are kept, the last ones whole, put into given documents: recall of the latent
    search against one that aligns every window."""
    directory = "/root/testdata/sf0.001"
    benchmark = spark.read.parquet(f"{directory}/benchmark.parquet")
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    texts = [words(r.text) for r in spark.read.parquet(f"{directory}/documents.parquet").orderBy("doc_id").limit(len(items)).collect()]
    own = random.Random(4)
    rows = []
    for (item_id, item), around in zip(items, texts):
        share = own.uniform(0.6, 0.85)
        body = [w if own.random() < share else f"zq{own.randrange(10**6)}" for w in item[:-8]] + item[-8:]
        cut = own.randrange(len(around) + 1)
        rows.append((item_id, " ".join([*around[:cut], *body, *around[cut:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found(parameters):
        return {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark, parameters).collect() if r.doc_id == r.item_id}

    every = found(LeakParameters(cosine=-1.0))
    assert len(every) >= 0.9 * len(items)
    assert len(found(LeakParameters()) & every) >= 0.97 * len(every)


def test_finds_the_planted_items(spark):
    """On the given tables: every document with most of an item's five-word runs, and no other."""
    from cohortry.llm.queries import QUERIES

    directory = "/root/testdata/sf0.001"
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{directory}/benchmark.parquet").collect()}
    runs = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    planted = {(d, i) for d, w in docs.items() for i, r in runs.items()
               if r and len(r & {tuple(w[k:k + 5]) for k in range(len(w) - 4)}) >= 0.6 * len(r)}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op4_benchmark_decontamination"](spark, directory).collect()} == planted


def test_finds_short_items_among_words_seen_nowhere_else(spark, documents):
    """Items of 8 to 20 words, verbatim among rare words and among words of the benchmark."""
    short = {k: text(8 + k) for k in range(13)}
    fresh = iter(range(10**6))

    def rare(n):
        return " ".join(f"zq{next(fresh)}x" for _ in range(n))

    rows = [(k, f"{rare(37 + k)} {t} {rare(41)}") for k, t in short.items()]
    rows += [(100 + k, f"{text(37 + k)} {t} {text(41)}") for k, t in short.items()] + [(200 + k, text(120)) for k in range(200)]
    rows += [(500 + k, rare(120)) for k in range(20)]
    benchmark = spark.createDataFrame([*short.items(), *((50 + k, t) for k, t in ITEMS.items())], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents(rows), benchmark, LeakParameters(log2_terms=16, rank=64)).collect()}
    assert got == {(k, k) for k in short} | {(100 + k, k) for k in short}
