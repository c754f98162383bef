import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortry.operators import cohort, context, responses
from cohortry.operators.compare import flatten_responses
from cohortry.operators.responses import ResponseGenerationError
from cohortry.spec import CohortFilter, Question, Run, SamplingSpec, persona_spec, require_questions, require_variants

SPEC = persona_spec()
QUESTIONS = (
    Question("question_first", "Do you agree?"),
    Question("question_again", "Do you agree?", "SAME_QUESTION_REPEAT", "question_first"),
)
RUN = Run("project_trial", "run_7a", "cohort_trial", "scenario_tax", "question_set_m", 7)


def test_levels_are_nested(people):
    columns = {level: context.build_context(people, SPEC, level).columns for level in context.LEVELS}
    assert len(columns["P1"]) == 15 and len(columns["P2"]) == 26
    assert columns["P2"][:15] == columns["P1"] and columns["P3"] == [*columns["P2"], "narratives"]


def test_contexts_follow_sample_order(people):
    sample = cohort.draw_sample(people, CohortFilter(SPEC), SamplingSpec(4, 42))
    rows = context.build_context(people, SPEC, "P1", sample).orderBy("sample_rank").collect()
    assert [r["persona_id"] for r in rows] == [r["uuid"] for r in sample.orderBy("sample_rank").collect()]


def test_narratives_keep_order_and_skip_nulls(people):
    told = people.withColumn("detailed_persona", F.when(F.col("uuid") != "n02", "long story"))
    rows = {r["persona_id"]: r["narratives"] for r in context.build_context(told, SPEC, "P3").collect()}
    assert [tuple(n) for n in rows["n01"]] == [("persona", "a tale"), ("detailed_persona", "long story")]
    assert [tuple(n) for n in rows["n02"]] == [("persona", "a tale")]
    long = context.narratives_long(told, "uuid", ("persona", "detailed_persona")).where("persona_id = 'n01'").orderBy("position")
    assert [(r["position"], r["field_name"]) for r in long.collect()] == [(0, "persona"), (1, "detailed_persona")]


def test_missing_columns_and_ids(people, spark):
    with pytest.raises(ValueError, match="missing required P1 columns: bachelors_field"):
        context.build_context(people.drop("bachelors_field"), SPEC, "P1")
    with pytest.raises(ValueError, match="missing required P3 columns: professional_persona"):
        context.build_context(people.drop("persona"), SPEC, "P3")
    sample = spark.createDataFrame([("n01", 1), ("gone", 2)], "uuid string, sample_rank bigint")
    with pytest.raises(ValueError, match="Missing sampled personas: gone"):
        context.require_complete(people, SPEC, sample)
    context.require_complete(people, SPEC, sample.where("uuid = 'n01'"))
    with pytest.raises(ValueError, match="more than once: n01"):
        context.require_complete(people.union(people), SPEC, sample.where("uuid = 'n01'"))


@pytest.fixture(scope="module")
def cells(people, spark):
    contexts = context.build_context(people.where("uuid IN ('n01', 'n02')"), SPEC, "P1")
    return responses.plan_responses(contexts, QUESTIONS, RUN)


def refusing(agent):
    """A generator that fails for one agent; an inner function, so that it travels to the workers by value."""
    def generator(cell):
        if cell["agent_id"] == agent:
            raise ResponseGenerationError("no answer")
        return "fine", {"stance": "support", "stance_score": 5, "reasoning_summary": "r", "concerns": ["a"], "acceptance_conditions": []}

    return generator


def test_expansion(cells):
    rows = cells.orderBy("agent_id", "repeat_index").collect()
    assert [r["repeat_index"] for r in rows] == [0, 1, 0, 1]
    text = f"{RUN.run_id}|n01|question_first|0"
    assert rows[0]["response_id"] == "response_" + hashlib.sha256(text.encode()).hexdigest()[:12]


def test_follow_ups_are_refused(people):
    contexts = context.build_context(people, SPEC, "P1")
    bad = responses.expand_questions(contexts, [Question("question_x", "?", "FOLLOW_UP_LIMITED")])
    with pytest.raises(PySparkException, match="Unsupported question type"):
        bad.collect()


@pytest.mark.parametrize(
    ("questions", "message"),
    [
        ([], "at least one"),
        ([Question("q", "?"), Question("q", "?")], "duplicate question_id"),
        ([Question("q", "?", "SAME_QUESTION_REPEAT")], "names the question it repeats"),
        ([Question("q", "?", "ORIGINAL", "q")], "names the question it repeats"),
        ([Question("q", "?", "SAME_QUESTION_REPEAT", "z")], "z is not an original"),
        ([Question("q", "")], "must not be empty"),
    ],
)
def test_question_sets_are_checked(questions, message):
    with pytest.raises(ValueError, match=message):
        require_questions(questions)


def test_runs_and_variants_are_checked():
    with pytest.raises(ValueError, match="invalid run_id"):
        Run("project_p", "wrong", "cohort_c", "scenario_s", "question_set_m", 1)
    with pytest.raises(ValueError, match="temperature"):
        Run("project_p", "run_1", "cohort_c", "scenario_s", "question_set_m", 1, temperature=2.5)
    for variants in ([], [("A", "x"), ("A", "y")], [("D", "x")], [("A", "")]):
        with pytest.raises(ValueError, match="variants need"):
            require_variants(variants)


def test_generator_errors_become_rows(cells):
    filled = responses.generate_responses(cells, refusing("n02"))
    rows = flatten_responses(filled).orderBy("agent_id", "repeat_index").collect()
    assert [(r["status"], r["error_type"], r["stance"]) for r in rows] == [
        ("success", None, "support"), ("success", None, "support"), ("error", "ResponseGenerationError", None), ("error", "ResponseGenerationError", None)]
    assert rows[0]["concerns"] == ["a"] and rows[0]["response_text"] == "fine"


def test_faults_of_the_program_end_the_run(cells):
    def broken(cell):
        return cell["no such column"]

    with pytest.raises(PySparkException, match="no such column"):
        responses.generate_responses(cells, broken).collect()
    named = responses.generate_responses(cells, broken, (KeyError,)).collect()
    assert {(r["status"], r["error_type"]) for r in named} == {("error", "KeyError")}


@pytest.mark.parametrize("empty", [(None, None), ("", {"stance": "support"}), ("text", None), ("text", {})])
def test_an_empty_answer_is_an_error(cells, empty):
    rows = responses.generate_responses(cells, lambda cell: empty).collect()
    assert {(r["status"], r["error_type"], r["response_text"]) for r in rows} == {("error", "EmptyResponseError", None)}


def test_generators_see_nulls_and_whole_numbers(spark):
    cells = spark.createDataFrame([(1, 5), (2, None)], "agent_id long, level int")

    def show(cell):
        return repr(cell["level"]), {"stance": "neutral", "stance_score": 3, "reasoning_summary": None, "concerns": [], "acceptance_conditions": []}

    rows = responses.generate_responses(cells, show).collect()
    assert {r["agent_id"]: r["response_text"] for r in rows} == {1: "5", 2: "None"}


def test_a_stored_question_set_of_any_size(spark, people):
    contexts = context.build_context(people, SPEC, "P1")
    table = spark.range(12_000).selectExpr("'question_set_m' AS question_set_id", "concat('question_', id) AS question_id", "'?' AS question_text",
                                           "'ORIGINAL' AS question_type", "cast(null as string) AS repeat_of_question_id")
    other = table.withColumn("question_set_id", F.lit("question_set_o"))
    rows = responses.expand_question_table(contexts, table.union(other), "question_set_m")
    assert rows.count() == 8 * 12_000 and rows.select("persona_id", "question_id").distinct().count() == 8 * 12_000


def test_retry_and_summary(cells):
    filled = responses.generate_responses(cells, refusing("n02"))
    assert {r["agent_id"] for r in responses.retry_set(cells, filled).collect()} == {"n02"}
    elsewhere = filled.withColumn("project_id", F.lit("project_other"))
    assert responses.retry_set(cells, elsewhere).count() == 4
    part = filled.where("NOT (agent_id = 'n01' AND repeat_index = 1)")
    assert responses.retry_set(cells, part).count() == 3
    row = responses.run_summary(cells, part).first()
    assert (row["planned"], row["stored"], row["succeeded"], row["failed"], row["error_types"]) == (4, 3, 1, 2, 1)


def test_repeat_count(spark):
    df = spark.createDataFrame([("s1", "ORIGINAL"), ("s1", "SAME_QUESTION_REPEAT"), ("s2", "ORIGINAL")],
                               "question_set_id string, question_type string")
    assert dict(map(tuple, responses.repeat_count(df).collect())) == {"s1": 2, "s2": 1}
