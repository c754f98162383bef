import itertools
import random

import pytest

from cohortry.operators import agreement, semantic


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(4)
    out = []
    for i in range(120):
        true = rng.randint(1, 5)
        votes = [min(5, max(1, true + rng.choice((-1, 0, 0, 0, 1)))) for _ in range(3)]
        if i % 7 == 0:
            votes[2] = None
        out.append((i, *votes))
    return out


@pytest.fixture(scope="module")
def wide(spark, rated):
    return spark.createDataFrame(rated, "item int, a int, b int, c int").repartition(4)


@pytest.fixture(scope="module")
def long(wide):
    return wide.unpivot("item", ["a", "b", "c"], "rater", "rating")


def kappa(pairs, weight):
    n = len(pairs)
    seen = sum(weight(i, j) for i, j in pairs) / n
    chance = sum(weight(i, j) for (i, _), (_, j) in itertools.product(pairs, pairs)) / n**2
    return 1 - seen / chance


def test_two_raters(wide, rated):
    pairs = [(a, b) for _, a, b, _ in rated]
    assert agreement.cohen_kappa(wide, "a", "b").first()["kappa"] == pytest.approx(kappa(pairs, lambda i, j: i != j))
    assert agreement.weighted_kappa(wide, "a", "b").first()["kappa"] == pytest.approx(kappa(pairs, lambda i, j: (i - j) ** 2))
    assert agreement.agreement_rate(wide, "a", "b").first()["agreement"] == pytest.approx(sum(a == b for a, b in pairs) / 120)


def test_missing_ratings_are_left_out(wide, rated):
    pairs = [(a, c) for _, a, _, c in rated if c is not None]
    row = agreement.cohen_kappa(wide, "a", "c").first()
    assert row["n_items"] == len(pairs) and row["kappa"] == pytest.approx(kappa(pairs, lambda i, j: i != j))


def test_fleiss(long, rated):
    full = [votes for _, *votes in rated if None not in votes]
    p = sum((sum(v.count(c) ** 2 for c in range(1, 6)) - 3) / 6 for v in full) / len(full)
    e = sum((sum(v.count(c) for v in full) / (3 * len(full))) ** 2 for c in range(1, 6))
    row = agreement.fleiss_kappa(long, "item", "rating", 3).first()
    assert row["n_items"] == len(full) and row["kappa"] == pytest.approx((p - e) / (1 - e))


def test_krippendorff(long, rated):
    units = [[v for v in votes if v is not None] for _, *votes in rated]
    n = sum(map(len, units))
    do = sum(sum(a != b for a, b in itertools.permutations(u, 2)) / (len(u) - 1) for u in units) / n
    flat = [v for u in units for v in u]
    de = sum(a != b for a, b in itertools.permutations(flat, 2)) / (n * (n - 1))
    row = agreement.krippendorff_alpha(long, "item", "rating").first()
    assert row["n_ratings"] == n and row["alpha"] == pytest.approx(1 - do / de)


def test_icc(long, rated):
    full = [votes for _, *votes in rated if None not in votes]
    grand = sum(map(sum, full)) / (3 * len(full))
    msb = 3 * sum((sum(v) / 3 - grand) ** 2 for v in full) / (len(full) - 1)
    msw = sum((x - sum(v) / 3) ** 2 for v in full for x in v) / (2 * len(full))
    row = agreement.icc(long, "item", "rating", 3).first()
    assert row["icc"] == pytest.approx((msb - msw) / (msb + 2 * msw))


def test_no_variance_is_null(spark):
    same = spark.createDataFrame([(1, 2, 2), (2, 2, 2)], "item int, a int, b int")
    assert agreement.cohen_kappa(same, "a", "b").first()["kappa"] is None
    assert agreement.weighted_kappa(same, "a", "b").first()["kappa"] is None
    long = same.unpivot("item", ["a", "b"], "r", "rating")
    assert agreement.fleiss_kappa(long, "item", "rating", 2).first()["kappa"] is None
    assert agreement.krippendorff_alpha(long, "item", "rating").first()["alpha"] is None


def test_vectors(spark):
    df = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.9, 0.1]), (3, "g", [0.0, 1.0]), (4, "h", [0.0, 0.0])],
                               "id int, grp string, v array<double>")
    centre = {r["grp"]: r["centroid"] for r in semantic.centroids(df, "grp", "v").collect()}
    assert centre["g"] == pytest.approx([1.9 / 3, 1.1 / 3])
    far = semantic.semantic_outliers(df, "id", "grp", "v", 1).where("grp = 'g'").first()
    assert far["id"] == 3
    assert semantic.centroid_similarity(df, "id", "grp", "v").where("id = 4").first()["similarity"] is None
