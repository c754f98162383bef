import corpus_pipeline
from brute import duplicate_components
from cohortry.llm import bpe, secrets
from cohortry.llm.queries import tokenizer_file

DIRECTORY = "/root/testdata/sf0.001"
WORDS = "the of and to in is that it was for with on as are this by from have not but what all were when there can an your which their".split()


def prose(k, n=60):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1) + i * i % (k + 3)) % len(WORDS)] + ("s" * (i % 2)) for i in range(n))


def test_stages_keep_columns_and_take_effect(spark, documents):
    item = [r for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect() if r.item_id == 0][0].text
    rows = [(k, prose(k)) for k in range(1, 9)]
    rows += [(20, prose(1)), (21, prose(2) + " tail"), (22, None), (23, "12 34 --"), (24, f"{prose(11)} {item}"),
             (25, f"{prose(12)} password = hunter2secret"), (None, prose(13)), (3, prose(3)), (26, "")]
    docs = documents(rows, extra=True)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, DIRECTORY)
        assert docs_after.columns == docs.columns
        seen[name] = {r.doc_id for r in docs_after.collect()}
        docs = docs_after
    everything = {r[0] for r in rows}
    assert seen["language_id"] == everything - {22, 23, 26}
    assert seen["ngram_jaccard_join"] == seen["language_id"] - {20, 21}
    assert seen["benchmark_decontamination"] == seen["ngram_jaccard_join"] - {24}
    kept = docs.collect()
    assert {r.doc_id for r in kept} == seen["benchmark_decontamination"] and len(kept) == len(seen["benchmark_decontamination"])
    for r in kept:
        assert r.n_chars == len(r.text) and "hunter2" not in r.text
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY).collect()
    encoder = bpe.PieceEncoder(tokenizer_file("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in last} == {r.doc_id: encoder.encode(r.text)[0] for r in kept}


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, documents):
    a, b = prose(1), prose(2)
    rows = [(1, a), (2, a), (2, b), (2, b), (None, prose(3)), (None, prose(3)), (None, prose(4)), (7, prose(4)), (None, None), (8, "--")]
    got = corpus_pipeline.keep_one_of_each(spark, documents(rows, extra=True), DIRECTORY)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(1, a), (2, b), (None, prose(3)), (7, prose(4)), (None, None), (8, "--")], key=repr)


def test_empty_documents(spark, documents):
    docs = documents([]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIRECTORY)
        assert docs.collect() == []


def test_run_keeps_one_of_each_group_and_every_clean_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect()]
    letters = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    first = {i for i, (_, root) in duplicate_components(letters).items() if i == root}
    clean = {i for i in first if not any(item in docs[i] for item in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIRECTORY).collect()}
    assert set(got) == clean
    encoder = bpe.PieceEncoder(tokenizer_file("word_bpe_49k.json"))
    whole = [i for i in clean if not secrets.spans_of(docs[i], b"", secrets.ScanParameters())]
    assert whole and all(got[i].ids == encoder.encode(docs[i])[0] for i in whole)
