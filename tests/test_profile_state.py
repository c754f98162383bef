import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry import workflow
from cohortry.operators import profile_state, quantiles
from cohortry.spec import TableSpec


def rows():
    rng = random.Random(11)
    out = []
    for k in range(6000):
        x = None if rng.random() < 0.1 else rng.lognormvariate(2, 3) * rng.choice([1, 1, 1, -1])
        out.append((k, rng.choice("abc"), x, rng.choice(["red", "red", "green", None]), f"id{k % 3000}"))
    return out


@pytest.fixture(scope="module")
def fact(spark):
    return spark.createDataFrame(rows(), "k int, part string, x double, colour string, name string").repartition(7)


def test_merged_halves_equal_the_whole(spark, fact):
    parts = profile_state.profile_states(fact, ["x"], ["colour", "name"], by=["part"])
    assert parts.count() == 9
    halves = profile_state.merge_states(parts.where("part = 'a'")).unionByName(profile_state.merge_states(parts.where("part <> 'a'")))
    got = {r["column"]: r for r in profile_state.state_profile(profile_state.merge_states(halves), (0.1, 0.5, 0.95), 2).collect()}
    whole = {r["column"]: r for r in profile_state.state_profile(profile_state.profile_states(fact, ["x"], ["colour", "name"]), (0.5,), 2).collect()}
    values = np.array([r[2] for r in rows() if r[2] is not None])
    x = got["x"]
    assert (x["n_rows"], x["n"], x["minimum"], x["maximum"]) == (6000, len(values), values.min(), values.max())
    assert x["mean"] == pytest.approx(values.mean()) and x["null_ratio"] == pytest.approx(1 - len(values) / 6000)
    for i, p in enumerate((0.1, 0.5, 0.95)):
        assert abs((values <= x[f"q{i}"]).mean() - p) < 2 * profile_state.rank_error(1000)
    for c in ("x", "colour", "name"):
        exact = {"x": len(set(values)), "colour": 2, "name": 3000}[c]
        assert got[c]["distinct_count"] == whole[c]["distinct_count"] == exact or abs(got[c]["distinct_count"] - exact) < 0.06 * exact
    reds, greens = (sum(r[3] == c for r in rows()) for c in ("red", "green"))
    assert [tuple(t) for t in got["colour"]["top"]] == [("red", reds), ("green", greens)]
    assert got["colour"]["n"] == reds + greens and (got["colour"]["minimum"], got["colour"]["maximum"]) == (3, 5)


def test_empty_and_odd_columns(spark, fact):
    empty = profile_state.profile_states(fact.where("false"), ["x"], ["colour"])
    for r in profile_state.state_profile(empty).collect():
        assert (r["n_rows"], r["n"], r["mean"], r["q0"], r["distinct_count"], r["top"]) == (0, 0, None, None, 0, [])
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "x double")
    r = profile_state.state_profile(profile_state.profile_states(odd, ["x"])).first()
    assert (r["n_rows"], r["n"], r["minimum"]) == (6, 5, float("-inf"))
    nothing = spark.createDataFrame([(float("nan"),)] * 3, "x double")
    assert np.isnan(quantiles.sliced_quantiles(nothing, ["x"], [0.5]).first()["q0"])


def test_exact_quantiles_from_stored_states(tmp_path, fact):
    spec = TableSpec(id_column="k", range_column="x", list_fields={"colours": "colour"})
    workflow.save_profile_states(fact.where("part <> 'c'"), spec, str(tmp_path), ["part"])
    workflow.save_profile_states(fact.where("part = 'c'"), spec, str(tmp_path), ["part"])
    states = fact.sparkSession.read.parquet(f"{tmp_path}/profile_states")
    assert states.select("part").distinct().count() == 3
    values = [r[2] for r in rows() if r[2] is not None]
    found = quantiles.sliced_quantiles(fact, ["x"], [0.0, 0.3, 0.5, 0.99], states=profile_state.merge_states(states)).first()
    assert [found[f"q{i}"] for i in range(4)] == pytest.approx([np.quantile(values, p) for p in (0.0, 0.3, 0.5, 0.99)])
    stored = {r["column"]: r for r in workflow.stored_profile(fact.sparkSession, str(tmp_path)).collect()}
    assert stored["x"]["n"] == len(values) and stored["colour"]["distinct_count"] == 2
    assert workflow.stored_profile(fact.sparkSession, str(tmp_path), ["part"]).count() == 6


@pytest.mark.parametrize("rounds,buckets", [(0, 4), (1, 4), (2, 4), (3, 2), (2, 1000)])
@pytest.mark.parametrize("shape", ["skewed", "wide", "infinite"])
def test_narrowing_is_exact_and_bounded(spark, rounds, buckets, shape):
    rng = np.random.default_rng(2)
    values = {
        "skewed": np.concatenate([np.full(3000, 5.0), rng.integers(0, 100, 1500).astype(float)]),
        "wide": np.concatenate([rng.normal(0, 1, 1000) * 10.0 ** rng.integers(-300, 300, 1000), np.zeros(501)]),
        "infinite": np.concatenate([np.full(40, -np.inf), rng.normal(0, 1, 101), np.full(60, np.inf)]),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    probs = [0.02, 0.5, 0.7]
    found = quantiles.sliced_quantiles(df, ["x"], probs, 80, rounds=rounds, buckets=buckets).first()
    ordered = np.sort(values)
    for i, p in enumerate(probs):
        at = (len(values) - 1) * p
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        want = low if low == high else low + (high - low) * (at - np.floor(at))
        assert found[f"q{i}"] == pytest.approx(want, rel=1e-9) or np.isnan(found[f"q{i}"]) and np.isinf(low)


def test_quantiles_run_no_job_while_planned(fact):
    spark = fact.sparkSession
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    quantiles.sliced_quantiles(fact, ["x"], [0.5])
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
