import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import distributions, quantiles
from cohortry.operators.skew import null_safe_join, sequence_within_key, top_per_group


@pytest.fixture(scope="module")
def fact(spark):
    """A third of the rows under one key, a tenth without key."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        draw = rng.random()
        key = None if draw < 0.1 else 0 if draw < 0.45 else rng.randrange(1, 200)
        rows.append((i, key, i // 10))
    return spark.createDataFrame(rows, "id long, k int, t long").repartition(6)


def test_sequence_within_key(fact):
    # rows without a key are a key, rows without a time come last
    timed = fact.withColumn("t", F.when(F.col("id") % 11 != 0, F.col("t")))
    found = sequence_within_key(timed, ["k"], ["t", "id"], F.floor(F.col("t") / 7), "pos").collect()
    assert len(found) == 3000
    expected = {}
    for r in sorted(timed.collect(), key=lambda r: (r["k"] is None, r["k"] or 0, r["t"] is None, r["t"] or 0, r["id"])):
        expected.setdefault(r["k"], []).append(r["id"])
    positions = {(r["k"], r["pos"]): r["id"] for r in found}
    assert positions == {(k, i): v for k, ids in expected.items() for i, v in enumerate(ids)}


def test_null_safe_join(spark, fact):
    sizes = fact.groupBy("k").count()
    assert {r["k"]: r["count"] for r in null_safe_join(fact, sizes, ["k"]).collect()} == {r["k"]: r["count"] for r in sizes.collect()}


def test_top_per_group(fact):
    rows = top_per_group(fact, ["k"], [F.col("id").desc()], 2, "r").where("k = 0").orderBy("r").collect()
    best = sorted((r["id"] for r in fact.where("k = 0").collect()), reverse=True)[:2]
    assert [r["id"] for r in rows] == best


def test_top_per_group_prunes_before_the_shuffle(fact):
    plan = top_per_group(fact, ["k"], [F.col("id").desc()], 2, "r")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("shape", ["spread", "heavy", "few", "one"])
def test_sliced_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.lognormal(3, 2, 4001),
        "heavy": np.concatenate([np.full(1500, 7.25), rng.normal(0, 5, 2500)]),
        "few": rng.integers(0, 4, 1000).astype(float),
        "one": np.array([3.5]),
    }[shape]
    rest = [1.0, 2.0] + [None] * (len(values) - 2) if len(values) > 1 else [1.0]
    df = spark.createDataFrame([(float(v), y) for v, y in zip(values, rest, strict=True)], "x double, y double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    # a coarse sketch must not change the answer
    for accuracy, margin in ((10_000, None), (3, 0.01)):
        rows = {r["column"]: r for r in quantiles.sliced_quantiles(df.repartition(5), ["x", "y"], probs, accuracy, margin).collect()}
        for i, p in enumerate(probs):
            assert rows["x"][f"q{i}"] == pytest.approx(np.quantile(values, p), abs=1e-9)
        assert rows["x"]["n"] == len(values) and rows["x"]["minimum"] == values.min()
        assert rows["y"]["q2"] == (1.5 if len(values) > 1 else 1.0) and rows["y"]["n"] == min(2, len(values))


def test_minority_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), "common" if rng.random() < 0.4 else f"s{int(rng.paretovariate(0.6)) % 60}") for i in range(800)]
    df = spark.createDataFrame(rows, "id int, g string, mark string").repartition(5)
    counts = {}
    for _, g, m in rows:
        counts[g, m] = counts.get((g, m), 0) + 1
    for k in (1, 2, 5):
        found = {(r["id"], r["signature_count"]) for r in distributions.minority_candidates(df, ["g"], "mark", "id", k).collect()}
        assert found == {(i, counts[g, m]) for i, g, m in rows if counts[g, m] <= k}
    for q in (0.0, 0.5, 1.0):
        rare = set()
        for (g, m), n in counts.items():
            group = [c for (h, _), c in counts.items() if h == g]
            if sum(c < n for c in group) / max(len(group) - 1, 1) <= q:
                rare.add((g, m))
        found = {r["id"] for r in distributions.minority_by_quantile(df, ["g"], "mark", "id", q).collect()}
        assert found == {i for i, g, m in rows if (g, m) in rare}
