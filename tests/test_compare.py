import pytest
from pyspark.sql import functions as F

from cohortry.operators import compare, design, distributions, review
from cohortry.spec import Recipe

SCHEMA = (
    "run_id string, agent_id string, question_id string, question_type string, repeat_of_question_id string, response_id string, "
    "stance string, stance_score int, concerns array<string>, acceptance_conditions array<string>, response_text string"
)


@pytest.fixture(scope="module")
def answers(spark):
    q, r = "question_q", "question_r"
    def pair(agent, n, first, second):
        rows = []
        for i, (stance, score, concerns) in enumerate((first, second)):
            rows.append(("run_1", agent, (q, r)[i], ("ORIGINAL", "SAME_QUESTION_REPEAT")[i], (None, q)[i], f"response_{n}{i}",
                         stance, score, concerns, ["x"] if stance else None, f"text {n}{i}"))
        return rows
    rows = pair("p1", 1, ("oppose", 2, ["price", "time"]), ("neutral", 3, ["price"]))
    rows += pair("p2", 2, ("support", 5, ["a"]), ("support", 4, ["a"]))
    rows += pair("p3", 3, ("support", 4, []), ("oppose", 1, []))
    rows += pair("p4", 4, ("support", 4, ["a"]), (None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def evaluated(answers):
    return compare.evaluate_pairs(compare.repeat_pairs(answers))


def test_evaluation(evaluated):
    rows = {r["agent_id"]: r for r in evaluated.collect()}
    flags = ("stance_match", "stance_score_delta", "contradiction_candidate", "needs_human_review")
    assert [tuple(rows[p][f] for f in flags) for p in ("p1", "p2", "p3", "p4")] == [
        (False, 1, False, True), (True, -1, False, False), (False, -3, True, True), (None, None, None, None)]
    assert rows["p1"]["concern_overlap"] == 0.5 and rows["p2"]["concern_overlap"] == 1.0
    assert rows["p3"]["concern_overlap"] is None and rows["p4"]["concern_overlap"] is None
    assert rows["p1"]["response_text_a"] == "text 10" and rows["p1"]["response_text_b"] == "text 11"


def test_links_from_a_question_table(answers, spark):
    links = spark.createDataFrame([("question_r", "question_q")], "question_id string, repeat_of_question_id string")
    pairs = compare.repeat_pairs(answers.drop("repeat_of_question_id"), links)
    assert pairs.count() == 4


def test_projects_do_not_mix(answers):
    first = answers.where("question_type = 'ORIGINAL'").withColumn("project_id", F.lit("project_a"))
    second = answers.where("question_type <> 'ORIGINAL'").withColumn("project_id", F.lit("project_b"))
    assert compare.repeat_pairs(first.union(second)).count() == 0


def test_follow_up_records(evaluated):
    chosen = compare.follow_up_candidates(evaluated.withColumn("project_id", F.lit("project_a")))
    rows = compare.follow_up_records(chosen, F.lit("Why did you change?"), F.lit("2026-07-20 12:00:00").cast("timestamp")).collect()
    assert {r["parent_response_id"] for r in rows} == {"response_10", "response_30"} and len({r["follow_up_id"] for r in rows}) == 2
    assert all(r["response_id"] is None and r["question_id"].startswith("question_") for r in rows)


def test_consistency_and_changes(evaluated, answers):
    row = compare.consistency(evaluated, ["run_id"]).first()
    assert (row["n_pairs"], row["n_match"], row["n_contradiction"], row["n_review"]) == (3, 1, 1, 2)
    assert row["stance_consistency"] == pytest.approx(1 / 3)
    assert {r["agent_id"] for r in compare.changed_agents(answers, ["agent_id"]).collect()} == {"p1", "p3"}


def test_change_reason(evaluated):
    reasons = {r["agent_id"]: r["change_reason"] for r in compare.change_reason(evaluated).collect()}
    assert reasons == {"p1": "unexplained", "p2": "unchanged", "p3": "unexplained", "p4": None}
    framed = evaluated.withColumn("question_type_b", F.lit("FRAMING_CHANGE"))
    assert compare.change_reason(framed).where("agent_id = 'p1'").first()["change_reason"] == "condition_changed"


def test_metric_rows(evaluated):
    long = compare.metric_results_long(evaluated, ["stance_match", "stance_score_delta"])
    rows = {(r["comparison_id"], r["metric_name"]): r for r in long.collect()}
    ids = {r["agent_id"]: r["comparison_id"] for r in evaluated.collect()}
    assert len(rows) == 4 * 6
    assert rows[ids["p1"], "stance_match"]["value"] == 0.0 and rows[ids["p1"], "stance_match"]["status"] == "computed"
    assert rows[ids["p4"], "stance_match"]["status"] == "error" and rows[ids["p4"], "stance_match"]["value"] is None
    unknown = rows[ids["p1"], "semantic_similarity"]
    assert unknown["status"] == "not_computed" and unknown["value"] is None and "vectors" in unknown["details"]
    summary = {r["metric_name"]: r for r in compare.metric_summary(long, []).collect()}
    assert summary["stance_match"]["n_rows"] == 4 and summary["stance_match"]["n_computed"] == 3


def test_recipe(evaluated):
    recipe = Recipe("r1", ("run_id",), ("stance_match", "stance_score_delta"), filters={"agent_id": ("p1", "p2")})
    rows = {r["metric_name"]: (r["n"], r["value"]) for r in compare.run_recipe(evaluated, recipe).collect()}
    assert rows == {"stance_match": (2, 0.5), "stance_score_delta": (2, 0.0)}


def test_condition_pairs(answers):
    both = answers.withColumn("condition", F.when(F.col("question_type") == "ORIGINAL", "BASE").otherwise("NEW"))
    pairs = compare.condition_pairs(both, "condition", "BASE", on=["agent_id"])
    found = {r["agent_id"]: (r["condition"], r["stance_a"], r["stance_b"]) for r in pairs.collect()}
    assert found["p1"] == ("NEW", "oppose", "neutral") and len(found) == 4


def test_follow_ups(evaluated, answers, spark):
    more = evaluated.unionByName(evaluated.where("agent_id = 'p1'").withColumn("comparison_id", F.lit("comparison_zz")))
    chosen = {r["agent_id"] for r in compare.follow_up_candidates(more).collect()}
    assert chosen == {"p1", "p3"} and compare.follow_up_candidates(more).count() == 2
    records = spark.createDataFrame([("follow_up_1", "response_10"), ("follow_up_2", "response_10"), ("follow_up_3", "nowhere")],
                                    "follow_up_id string, parent_response_id string")
    linked = compare.link_follow_ups(answers, records).collect()
    assert {(r["follow_up_id"], r["parent_stance"]) for r in linked} == {("follow_up_1", "oppose"), ("follow_up_2", "oppose")}


def test_packet_hides_the_agent(evaluated):
    packet = review.review_packet(evaluated, seed=3, per_stratum=1, salt="s")
    rows = {r["stratum"]: r for r in packet.collect()}
    assert set(rows) == {"kept", "flipped", "shifted", "no_answer"}
    assert "agent_id" not in packet.columns and rows["kept"]["review_status"] == "not_reviewed"
    assert rows["kept"]["human_contradiction"] is None and len(rows["kept"]["anonymized_agent_id"]) == 64


def test_strata(evaluated):
    apart = evaluated.withColumn("concern_overlap", F.lit(0.0)).withColumn("minority", F.col("agent_id") == "p1")
    found = dict(map(tuple, apart.select("agent_id", review.pair_stratum(apart)).collect()))
    assert found == {"p1": "minority", "p2": "metric_conflict", "p3": "flipped", "p4": "no_answer"}


def test_distribution_levels_and_null_segments(spark):
    df = spark.createDataFrame([("s", "a", "A"), ("s", None, "A"), ("o", None, "B"), ("o", "a", "B")],
                               "stance string, seg string, var string")
    rows = distributions.stance_distribution(df, "stance", "seg", "var").collect()
    overall = {r["stance"]: r["share"] for r in rows if r["level"] == "overall"}
    assert overall == {"s": 0.5, "o": 0.5}
    null_segment = {r["stance"]: r["n"] for r in rows if r["level"] == "segment" and r["seg"] is None}
    assert null_segment == {"s": 1, "o": 1}
    totals = {}
    for r in rows:
        totals[r["level"], r["seg"], r["var"]] = totals.get((r["level"], r["seg"], r["var"]), 0) + r["share"]
    assert all(abs(t - 1) < 1e-12 for t in totals.values())


def test_shift_and_items(spark):
    df = spark.createDataFrame([("x", "s")] * 3 + [("x", "o")] + [("y", "s"), ("y", "n")], "c string, stance string")
    shift = distributions.distribution_shift(df, [], "stance", "c", "x", "y").first()
    assert shift["total_variation"] == pytest.approx((0.25 + 0.25 + 0.5) / 2)
    items = spark.createDataFrame([("g", ["a", "b", "a"]), ("g", ["a"]), ("g", None)], "g string, items array<string>")
    found = {r["item"]: (r["n"], r["share"]) for r in distributions.item_frequency(items, ["g"], "items").collect()}
    assert found["a"] == (2, pytest.approx(2 / 3)) and found["b"] == (1, pytest.approx(1 / 3))
    gaps = spark.createDataFrame([(None, ["a"]), (None, []), ("g", [None])], "g string, items array<string>")
    assert {tuple(r) for r in distributions.item_frequency(gaps, ["g"], "items").collect()} == {(None, "a", 1, 0.5), ("g", None, 1, 1.0)}
    same = spark.createDataFrame([(c, g, s) for c in "xy" for g in ("g", None) for s in ("s", None)], "c string, g string, stance string")
    assert {r["g"]: r["total_variation"] for r in distributions.distribution_shift(same, ["g"], "stance", "c", "x", "y").collect()} == {"g": 0.0, None: 0.0}


def test_text_measures(spark):
    df = spark.createDataFrame([("I am 30 and live in Busan", "부산", "busan", 30), (None, "a", "b", 1)], "t string, r string, c string, age int")
    used = [r["attribute_usage"] for r in compare.with_attribute_usage(df, "t", ["r", "c", "age"]).collect()]
    assert used == [2, 0]
    score = compare.with_lexicon_scores(df, "t", {"s": "[0-9]+"}).collect()
    assert score[0]["s"] == pytest.approx(100 / 7) and score[1]["s"] is None
    conflict = compare.fact_conflicts(df.withColumn("home", F.lit("Seoul")), "t", "live in (seoul|busan)", "home", ["seoul", "busan"])
    assert [r["stated_value"] for r in conflict.collect()] == ["busan"]


def test_matrix_and_specs(spark):
    designs = spark.createDataFrame([("d", ["A", "B", "A"], ["P1", "P2"])], "design_id string, v array<string>, l array<string>")
    cells = design.condition_matrix(designs, ["design_id"], ["v", "l"])
    assert cells.count() == 4 and cells.select("condition_id").distinct().count() == 4
    specs = spark.createDataFrame([("A|x|y",), ("D|x",), ("A",)], "s string")
    rows = [tuple(r) for r in design.split_variant_spec(specs, "s", ("A", "B", "C")).collect()]
    assert rows[0] == ("A|x|y", "A", "x|y", None) and rows[1][3] == "unsupported variant label" and "LABEL" in rows[2][3]
    asked = spark.createDataFrame([("q|ORIGINAL|t",), ("q|SAME_QUESTION_REPEAT|t|o",), ("q|FOLLOW_UP_LIMITED|t",), ("q|t",), ("a|ORIGINAL|b|c|d",)], "s string")
    problems = [r["problem"] for r in design.split_question_spec(asked, "s").collect()]
    assert problems[:2] == [None, None] and "unsupported" in problems[2] and "must use" in problems[3] and "must use" in problems[4]


def test_history_and_listing(spark):
    rows = [("a", i, f"r{i}") for i in range(6)] + [("b", 1, "r9")]
    df = spark.createDataFrame(rows, "agent_id string, t int, response_id string")
    placed = review.agent_histories(df, ["t"], F.floor(F.col("t") / 2))
    assert {(r["response_id"], r["history_index"]) for r in placed.collect()} == {(f"r{i}", i) for i in range(6)} | {("r9", 0)}
    assert [r["t"] for r in review.agent_history(df, "a", ["t"]).collect()] == list(range(6))
    assert review.filter_responses(df, {"agent_id": ["a"], "t": [1, 2]}, {"response_id": "r"}).count() == 2
