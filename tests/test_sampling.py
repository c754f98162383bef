import hashlib

import pytest
from pyspark.sql import functions as F

from cohortry.operators import profile_state, sampling


def plain(ids, seed, n):
    keys = {i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest() for i in set(ids) if i is not None}
    return [(i, k, r) for r, (k, i) in enumerate(sorted((k, i) for i, k in keys.items()), 1)][:n]


@pytest.fixture(scope="module")
def visits(spark):
    """A third of the rows under one id, every other id several times, some rows without id."""
    ids = [0] * 4000 + [None] * 100 + [k % 5000 for k in range(8000)]
    return spark.createDataFrame([(i, k, "s%d" % (k % 3)) for k, i in enumerate(ids)], "id long, row long, part string").repartition(6)


@pytest.mark.parametrize("n", [0, 1, 20, 700, 4999, 5000, 9000])
def test_bottom_k_is_exact(visits, n):
    ids = [r["id"] for r in visits.select("id").collect()]
    got = sampling.bottom_k(visits, "id", 3, n).orderBy("sample_rank").collect()
    assert [tuple(r) for r in got] == plain(ids, 3, n)


@pytest.mark.parametrize("population", [1, 5000, 10_000_000])
def test_a_wrong_population_changes_nothing(visits, population):
    got = sampling.bottom_k(visits, "id", 3, 50, F.lit(population)).orderBy("sample_rank").collect()
    assert [r["id"] for r in got] == [i for i, _, _ in plain(range(5000), 3, 50)]


def test_the_shuffle_follows_the_sample(spark):
    ids = spark.range(200_000).selectExpr("id", "id % 7 AS more").unionAll(spark.range(200_000).selectExpr("id", "id % 7 AS more"))
    keyed = ids.select("id").withColumn("sample_key", F.md5(F.concat(F.col("id").cast("string"), F.lit("|5"))))
    passed, _ = sampling.below_threshold(keyed, 100, entity="id")
    assert 100 <= passed.distinct().count() <= 250
    plan = sampling.bottom_k(ids, "id", 5, 100)
    assert plan.count() == 100
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    below = text.index("substring(md5")
    assert "Filter" in text[:below] and text.index("Aggregate") < below  # rows are dropped below the distinct


def test_population_from_a_stored_state(visits):
    states = profile_state.profile_states(visits, ["id"], by=["part"])
    known = profile_state.state_profile(profile_state.merge_states(states)).select("distinct_count").scalar()
    got = sampling.bottom_k(visits, "id", 8, 30, known).orderBy("sample_rank").collect()
    assert [tuple(r) for r in got] == plain(range(5000), 8, 30)


def test_samples_of_parts_merge(visits):
    states = sampling.bottom_states(visits, "id", 3, 40, ["part"])
    assert {r["part"]: r["count"] for r in states.groupBy("part").count().collect()} == {"s0": 40, "s1": 40, "s2": 40}
    halves = sampling.merge_bottom(states.where("part = 's0'"), "id", 40).union(sampling.merge_bottom(states.where("part <> 's0'"), "id", 40))
    merged = sampling.merge_bottom(halves, "id", 40)
    assert {(r["id"], r["sample_key"]) for r in merged.collect()} == {(i, k) for i, k, _ in plain(range(5000), 3, 40)}
    text = states._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and text.rindex("WindowGroupLimit") > text.index("Exchange")
    assert sampling.bottom_states(visits.where("false"), "id", 3, 40).collect() == []
