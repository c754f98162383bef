import pytest

from cohortry import workflow
from cohortry.operators.responses import ResponseGenerationError
from cohortry.sources import schemas, writers
from cohortry.spec import CohortRequest, Run, persona_spec

SPEC = persona_spec()
RUN = Run("project_p", "run_1", "cohort_c", "scenario_s", "question_set_m", seed=7)
REQUEST = CohortRequest.from_dict(
    {"name": "men", "filters": {"sexes": ["남자"]}, "sampling": {"sample_size": 4, "seed": 42, "method": "deterministic_random"}}, SPEC)
NOW = "2026-07-20 12:00:00"


def refusing(agent=None):
    """A generator that fails for one agent; an inner function, so that it travels to the workers by value."""
    def generator(cell):
        if cell["agent_id"] == agent:
            raise ResponseGenerationError("no")
        return cell["region"], {"stance": "neutral", "stance_score": 3, "reasoning_summary": "r", "concerns": [], "acceptance_conditions": []}

    return generator


def store_plan(spark, out, with_scenario=True):
    """The records that a run names."""
    at = f"timestamp'{NOW}' AS created_at"
    records = {
        "project": f"'project_p' AS project_id, 'n' AS name, 'g' AS research_goal, 'c' AS non_claim, {at}",
        "question_set": "'project_p' AS project_id, 'question_set_m' AS question_set_id, 'n' AS name, array("
        "named_struct('question_id', 'question_o', 'question_text', 'Agree?', 'question_type', 'ORIGINAL', 'repeat_of_question_id', cast(null as string)), "
        "named_struct('question_id', 'question_r', 'question_text', 'Agree?', 'question_type', 'SAME_QUESTION_REPEAT', 'repeat_of_question_id', 'question_o')"
        f") AS questions, {at}",
        "scenario": f"'project_p' AS project_id, '{'scenario_s' if with_scenario else 'scenario_x'}' AS scenario_id, 't' AS title, "
        f"array(named_struct('variant_id', 'scenario_s_a', 'label', 'A', 'text', 'x')) AS variants, {at}",
    }
    for kind, row in records.items():
        writers.write_records(spark.sql(f"SELECT {row}"), kind, out)


def csv(spark, path):
    return spark.read.option("header", True).csv(path)


def test_all_steps(spark, people, tmp_path):
    out = str(tmp_path)
    path = workflow.save_cohort(people, REQUEST, out, "people.parquet", NOW)
    stored = spark.read.schema(schemas.COHORT).json(f"{path}/manifest").first()
    assert stored["source"]["path"] == "people.parquet" and stored["source"]["row_count"] == 8 and stored["source"]["fingerprint"]
    assert stored["filters"]["sexes"] == "['남자']" and stored["sampling"]["seed"] == 42 and stored["matching_count"] == 5
    members = [r["persona_id"] for r in workflow.load_cohort(spark, path, "uuid").orderBy("sample_rank").collect()]
    assert len(members) == 4 and [r["uuid"] for r in csv(spark, f"{path}/sample_ids").collect()] == members
    assert "first_name" not in csv(spark, f"{path}/sample_preview").columns

    generator = refusing(members[0])
    with pytest.raises(ValueError, match="no stored scenario scenario_s"):
        store_plan(spark, out, with_scenario=False)
        workflow.run_questions(people, SPEC, path, RUN, out, NOW, generator)
    store_plan(spark, out)
    workflow.run_questions(people, SPEC, path, RUN, out, NOW, generator)
    rows = workflow.read_run(spark, out, RUN).collect()
    assert len(rows) == 8 and sum(r["status"] == "error" for r in rows) == 2
    record = spark.read.schema(schemas.RUN).json(f"{out}/run").first()
    assert record["repeat_count"] == 2 and record["generation_config"]["model"] == "mock-model"

    second = Run("project_p", "run_2", "cohort_c", "scenario_s", "question_set_m", seed=8)
    workflow.run_questions(people, SPEC, path, second, out, NOW, refusing())
    assert sorted(r["run_id"] for r in spark.read.schema(schemas.RUN).json(f"{out}/run").collect()) == ["run_1", "run_2"]

    workflow.compare_run(spark, out, RUN, NOW)
    comparisons = spark.read.schema(schemas.COMPARISON).parquet(f"{out}/comparisons").collect()
    assert len(comparisons) == 4 and {c["human_evaluation"]["review_status"] for c in comparisons} == {"not_reviewed"}

    matrix = spark.createDataFrame([("design_d", "P1")], "design_id string, persona_context_level string")
    workflow.export_run(spark, out, RUN, "design_d", conditions=matrix)
    exports = f"{out}/exports/project_p/run_1"
    assert csv(spark, f"{exports}/responses_long").count() == 8 and csv(spark, f"{exports}/condition_matrix").count() == 1
    long = csv(spark, f"{exports}/metric_results_long")
    assert long.where("status = 'not_computed'").count() == 16 and long.first()["design_id"] == "design_d"
    assert "agent_id" not in csv(spark, f"{exports}/human_eval_sample").columns


def test_user_generator(spark, people, tmp_path):
    out = str(tmp_path)
    path = workflow.save_cohort(people, REQUEST, out)

    store_plan(spark, out)
    workflow.run_questions(people, SPEC, path, RUN, out, NOW, refusing())
    assert {r["stance"] for r in workflow.read_run(spark, out, RUN).collect()} == {"neutral"}


def test_refused_cohort(people, tmp_path):
    big = CohortRequest.from_dict({"name": "n", "filters": {"regions": ["광주"]}, "sampling": {"sample_size": 3, "seed": 1}}, SPEC)
    with pytest.raises(ValueError, match="larger than matching count"):
        workflow.save_cohort(people, big, str(tmp_path))


def test_inspection_and_profile(spark, people, tmp_path):
    workflow.inspect_table(people, f"{tmp_path}/i", ["uuid"])
    columns = {r["column"]: r for r in spark.read.json(f"{tmp_path}/i/columns").collect()}
    assert columns["first_name"]["privacy_risk"] and columns["age"]["data_type"] == "bigint"
    sample = spark.read.json(f"{tmp_path}/i/sample").collect()
    assert len(sample) == 5 and {r["first_name"] for r in sample} == {"***MASKED***"}
    workflow.profile_table(people, SPEC, f"{tmp_path}/p", top_n=3)
    tidy = csv(spark, f"{tmp_path}/p/profile_csv")
    assert tidy.where("section = 'categorical' AND column = 'region' AND value = '대전'").first()["count"] == "4"
    assert tidy.where("metric = 'mean_length'").first()["count"] == "6.0"
    assert tidy.where("section = 'big_five' AND column = 'openness' AND value = 'parseable_ratio'").count() == 1
