"""Plan shapes that the scaling rests on."""

import re

import pytest
from pyspark.sql import functions as F

from cohortry.plans.catalog import QUERIES
from cohortry.operators import checks, cohort, compare, distributions, profile, responses
from cohortry.plans.tables import PARTS, PEOPLE, table
from cohortry.sources.readers import scan
from cohortry.spec import CohortFilter, Question, Run, SamplingSpec

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_filters_reach_the_scan(spark):
    wanted = CohortFilter(PARTS, minimum=10, maximum=20, values={"types": ("SMALL", "LARGE")}, search="bolt")
    text = plan(scan(spark, f"{DATA}/part.parquet", ["p_partkey"], wanted))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for part in ("GreaterThanOrEqual(p_size,10)", "LessThanOrEqual(p_size,20)", "In(p_type", "StringContains(p_name,bolt)"):
        assert part in pushed
    assert "p_retailprice" not in text and "p_brand" not in text


def test_a_sample_sorts_only_the_buckets_it_needs(spark):
    text = plan(cohort.draw_sample(table(spark, DATA, "customer"), CohortFilter(PEOPLE, minimum=0), SamplingSpec(20, 1)))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text
    # the join with the needed buckets lies below the ranking
    assert text.index("row_number()") < text.index("Join")


def test_joins_need_no_count_of_the_fact(spark):
    fact = table(spark, DATA, "lineitem")
    text = plan(checks.check_orphans(fact, "l_linenumber", "l_orderkey", table(spark, DATA, "orders"), "o_orderkey"))
    assert text.count("lineitem") <= 1 and text.count("FileScan") == 2


def test_shifts_and_items_scan_once(spark):
    clicks = table(spark, DATA, "events").withColumn("items", F.split("props", "k"))
    for df in (distributions.distribution_shift(clicks, ["user_id"], "event_type", "event_type", "view", "click"),
               distributions.item_frequency(clicks, ["user_id"], "items")):
        assert plan(df).count("FileScan") == 1 and "Join" not in plan(df)


def test_categorical_profiles_scan_once(spark):
    columns = ("p_name", "p_brand", "p_type")
    part = table(spark, DATA, "part")
    assert plan(profile.categorical_profile(part, columns)).count("FileScan") == 1
    # counts feed the ranking and the totals through one exchange
    text = final_plan(profile.value_frequencies(part, columns, 3))
    assert text.count("FileScan") == 1 and "ReusedExchange" in text and "WindowGroupLimit" in text


def test_texts_are_not_shuffled(spark):
    text = plan(profile.text_profile(table(spark, DATA, "documents"), ("text",)))
    for exchange in re.findall(r"Exchange hashpartitioning\((.*?)\)", text):
        assert "text#" not in exchange


def test_questions_are_exploded_without_a_join(spark):
    contexts = table(spark, DATA, "customer").withColumnRenamed("c_custkey", "persona_id")
    run = Run("project_p", "run_1", "cohort_c", "scenario_s", "question_set_m", 1)
    text = plan(responses.plan_responses(contexts, [Question("a", "?"), Question("b", "?")], run))
    assert "Join" not in text and "CartesianProduct" not in text and "Exchange" not in text


def test_pairs_join_on_keys(spark):
    df = spark.range(10).select(
        F.lit("r").alias("run_id"), F.col("id").alias("agent_id"), F.lit("q").alias("question_id"), F.lit("ORIGINAL").alias("question_type"),
        F.lit(None).cast("string").alias("repeat_of_question_id"), F.col("id").alias("response_id"), F.lit("s").alias("stance"),
    )
    text = plan(compare.repeat_pairs(df))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_everything(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
