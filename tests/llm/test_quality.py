import numpy as np

from cohortry.llm import quality

GOOD = "the quick story tells of many things and people who live well"
BAD = "BUY!!! $$$ ### CLICK&&& %%% WIN!!!"


def make(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for name in ("place", "good", "views", "quality"):
        docs = docs.selectExpr("*", f"1 AS `{name}`")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_learns_scores_everything_and_defines_odd_rows(spark):
    rows = [(k, f"{BAD if k % 4 == 0 else GOOD} {k} " * (1 + k % 5), f"site{k % 4}", "en") for k in range(200)]
    rows += [(300, None, None, None), (301, "", "site1", None), (None, GOOD, "site1", "en"), (302, GOOD * 5000, "site1", "en"), (7, rows[7][1], "site3", "en")]
    labels = [(k, int(k % 4 != 0)) for k in range(120)] + [(5, 1), (5, None), (999, 1), (None, 0)]
    docs, known = make(spark, rows, labels)
    got = quality.scored(docs, quality.fit(docs, known)).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: r for r in got}
    assert np.mean([held[k].keep == (k % 4 != 0) for k in range(120, 200)]) >= 0.95
    assert held[302].keep and held[None].keep
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))


def test_one_class_no_labels_and_empty_tables(spark):
    docs, one = make(spark, [(1, GOOD, "s", "en"), (2, BAD, "s", "en")], [(1, 1)])
    assert {r.score for r in quality.scored(docs, quality.fit(docs, one)).collect()} == {1.0}
    assert {r.score for r in quality.scored(docs, quality.fit(docs, one.where("false"))).collect()} == {0.5}
    nothing = docs.where("false")
    assert quality.scored(nothing, quality.fit(nothing, one)).collect() == []


def test_a_view_teaches_the_other():
    """The second view can't learn from two labels of each class; the first view's guesses on the pool show it how."""
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 400).astype(float)
    text = truth[:, None] * 4 + rng.normal(0, 0.3, (400, 3))
    meta = np.column_stack([truth + rng.normal(0, 0.2, 400), rng.normal(0, 3, (400, 30))])
    good = np.full(400, np.nan)
    some = np.concatenate([np.flatnonzero(truth == c)[:8] for c in (0, 1)])
    good[some] = truth[some]
    places = np.arange(400)

    def accuracy(rounds):
        model = quality.co_train(good, text, meta, places, quality.CoTraining(rounds=rounds, handed=0.1))
        z = (meta - model.meta_scale[0]) / model.meta_scale[1] @ model.meta[:-1] + model.meta[-1]
        return ((z > 0) == truth).mean()

    assert accuracy(5) > max(accuracy(0), 0.9)


def test_held_out_accuracy(spark):
    """Fit on half of the given labels, test on the others."""
    directory = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in rows]) >= 0.95


def test_every_unlabelled_document_takes_part(spark):
    """Far more unlabelled rows than any fixed pool: sums run over all of them, also rows without a doc_id."""
    from pyspark.sql import functions as F

    many = spark.range(12_000).select(
        F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 4 == 0, F.lit(BAD)).otherwise(F.lit(GOOD)), F.lit(" "), F.col("id")).alias("text"),
        F.concat(F.lit("site"), F.col("id") % 4).alias("source"), F.lit("en").alias("lang"))
    docs = many.union(spark.createDataFrame([(None, GOOD, "site1", "en")], "doc_id long, text string, source string, lang string"))
    known = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(200)] + [(90_000 + k, 1) for k in range(50)], "doc_id long, quality int")
    seen = []
    sums_over = quality._sums_over

    def counted(pool):
        seen.append(pool.count())
        return sums_over(pool)

    quality._sums_over = counted
    try:
        model = quality.fit(docs, known, quality.CoTraining(rounds=1, steps=1))
    finally:
        quality._sums_over = sums_over
    assert seen == [12_001 - 200] and model.constant is None
