import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortry.operators import checks, cohort, inspect
from cohortry.sources import readers, schemas, writers
from cohortry.spec import CohortFilter, CohortRequest, SamplingSpec, TableSpec, persona_spec

NOW = "2026-07-20T12:00:00Z"
CONFIG = {"model": "mock-model", "temperature": 0.3, "prompt_version": "prompt_v1"}


def response(number, stance, score, question, kind, run="run_7a", **changes):
    row = {
        "project_id": "project_trial", "cohort_id": "cohort_trial", "agent_id": "n01",
        "scenario_id": "scenario_tax", "question_id": question, "run_id": run, "response_id": f"response_{number}",
        "repeat_index": 0 if kind == "ORIGINAL" else 1, "question_type": kind, "response_text": "글",
        "structured_response": {"stance": stance, "stance_score": score, "reasoning_summary": "r", "concerns": ["price"],
                                "acceptance_conditions": []},
        "generation_config": CONFIG, "status": "success", "error_type": None, "created_at": NOW,
    }
    return row | changes


ROWS = [
    response("001", "oppose", 2, "question_o", "ORIGINAL"),
    response("002", "neutral", 3, "question_r", "SAME_QUESTION_REPEAT"),
    response("003", None, None, "question_o", "ORIGINAL", status="error", error_type="X", response_text=None, structured_response=None),
]


@pytest.fixture
def stored(spark, tmp_path):
    path = tmp_path / "responses.jsonl"
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in ROWS) + "\n\n", encoding="utf-8")
    return readers.read_responses(spark, str(path))


def test_responses_round_trip(spark, stored, tmp_path):
    assert [r[schemas.CORRUPT] for r in stored.collect()] == [None] * 3
    clean = stored.drop(schemas.CORRUPT)
    for kind in ("json", "parquet"):
        path = writers.write_responses(clean, str(tmp_path / kind), "project_trial", "run_7a", kind)
        source = spark.read.schema(schemas.RESPONSE).format(kind).load(path)
        back = source.select(*clean.columns)
        assert sorted(map(str, back.collect())) == sorted(map(str, clean.collect()))
    # rewriting one run keeps the others
    other = clean.withColumn("run_id", F.lit("run_b"))
    writers.write_responses(other, str(tmp_path / "json"), "project_trial", "run_b", "json")
    assert spark.read.json(str(tmp_path / "json" / "responses")).count() == 6


def test_unreadable_lines_are_kept(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps(ROWS[0]) + "\nnot json\n", encoding="utf-8")
    rows = readers.read_responses(spark, str(path)).collect()
    assert [r[schemas.CORRUPT] for r in rows] == [None, "not json"]


def test_scope_is_enforced(stored, tmp_path):
    with pytest.raises(PySparkException, match="run_id of response_.* does not match"):
        writers.write_responses(stored, str(tmp_path), "project_trial", "run_other")
    with pytest.raises(ValueError, match="invalid project_id"):
        writers.write_responses(stored, str(tmp_path), "../up", "run_7a")


def test_comparisons_array(spark, tmp_path):
    row = {
        "comparison_id": "comparison_001", "project_id": "project_trial", "run_id": "run_1", "agent_id": "a", "response_a_id": "response_1",
        "response_b_id": "response_2", "question_relation": "SAME_QUESTION_REPEAT",
        "automatic_evaluation": {"stance_match": False, "stance_score_delta": 1, "contradiction_candidate": False, "needs_human_review": True},
        "human_evaluation": {"review_status": "not_reviewed"}, "created_at": NOW,
    }
    (tmp_path / "c.json").write_text(json.dumps([row, row | {"comparison_id": "comparison_002", "response_b_id": "response_1"}], indent=2))
    table = readers.read_records(spark, "comparison", str(tmp_path / "c.json")).drop(schemas.CORRUPT)
    assert table.count() == 2 and table.first()["automatic_evaluation"]["stance_score_delta"] == 1
    bad = checks.check_pair_distinct(table, "comparison_id", "response_a_id", "response_b_id").collect()
    assert [r["key"] for r in bad] == ["comparison_002"]
    with pytest.raises(PySparkException, match="compared with itself"):
        writers.write_comparisons(table, str(tmp_path), "project_trial", "run_1")
    path = writers.write_comparisons(table.where("comparison_id = 'comparison_001'"), str(tmp_path), "project_trial", "run_1")
    assert spark.read.schema(schemas.COMPARISON).parquet(path).count() == 1


@pytest.mark.parametrize(("change", "message"), [
    ("named_struct('status', 'error')", "error without error_type"), ("named_struct('status', 'lost')", "unknown status"),
    ("named_struct('response_text', cast(null as string))", "success without payload"), ("named_struct('error_type', 'X')", "success with error_type"),
    ("named_struct('question_type', 'OTHER')", "unknown question type"), ("named_struct('response_id', 'r 1')", "invalid response_id"),
])
def test_bad_responses_are_refused(stored, tmp_path, change, message):
    clean = stored.drop(schemas.CORRUPT)
    fields = clean.selectExpr(f"{change} AS c").schema["c"].dataType.fieldNames()
    bad = clean.withColumns({f: F.expr(f"{change}.{f}") for f in fields})
    with pytest.raises(PySparkException, match=message):
        writers.write_responses(bad, str(tmp_path), "project_trial", "run_7a")


def test_dimension_records(spark, tmp_path):
    scenario = {"project_id": "project_p", "scenario_id": "scenario_s", "title": "t", "created_at": NOW,
                "variants": [{"variant_id": "scenario_s_a", "label": "A", "text": "x"}, {"variant_id": "scenario_s_b", "label": "B", "text": "y"}]}
    questions = {"project_id": "project_p", "question_set_id": "question_set_m", "name": "n", "created_at": NOW, "questions": [
        {"question_id": "question_o", "question_text": "?", "question_type": "ORIGINAL"},
        {"question_id": "question_r", "question_text": "?", "question_type": "SAME_QUESTION_REPEAT", "repeat_of_question_id": "question_o"}]}
    (tmp_path / "s.json").write_text(json.dumps(scenario, indent=2))
    (tmp_path / "q.json").write_text(json.dumps(questions, indent=2))
    scenarios = readers.read_records(spark, "scenario", str(tmp_path / "s.json")).drop(schemas.CORRUPT)
    assert [r["label"] for r in readers.variant_rows(scenarios).collect()] == ["A", "B"]
    sets = readers.read_records(spark, "question_set", str(tmp_path / "q.json"))
    rows = readers.question_rows(sets)
    assert checks.check_repeat_link(rows).count() == 0 and checks.check_unique(rows, ["question_set_id", "question_id"]).count() == 0
    path = writers.write_records(scenarios, "scenario", str(tmp_path / "out"))
    assert readers.read_lines(spark, "scenario", path).first()["title"] == "t"
    # a second record of the project leaves the first one where it is
    writers.write_records(scenarios.withColumn("scenario_id", F.lit("scenario_two")), "scenario", str(tmp_path / "out"))
    assert sorted(r["scenario_id"] for r in readers.read_lines(spark, "scenario", path).collect()) == ["scenario_s", "scenario_two"]
    with pytest.raises(PySparkException, match="invalid scenario_id"):
        writers.write_records(scenarios.withColumn("scenario_id", F.lit("no")), "scenario", str(tmp_path / "out"))


def test_cohort_files(spark, people, tmp_path):
    spec = persona_spec()
    wanted, sampling = CohortFilter(spec, values={"sexes": ("남자",)}), SamplingSpec(3, 42)
    sample = cohort.draw_sample(people, wanted, sampling)
    writers.write_sample_ids(sample, "uuid", str(tmp_path / "ids"))
    ids = [r["uuid"] for r in spark.read.option("header", True).csv(str(tmp_path / "ids")).collect()]
    assert ids == [r["uuid"] for r in sample.orderBy("sample_rank").collect()]
    writers.write_preview(cohort.preview(people, sample, "uuid", spec.preview), str(tmp_path / "preview"))
    assert spark.read.option("header", True).csv(str(tmp_path / "preview")).columns == list(spec.preview)
    manifest = cohort.manifest(people, CohortRequest("n", wanted, sampling), sample, inspect.dataset_fingerprint(people))
    assert manifest.first()["sampled"] == 3


def test_members_of_a_large_cohort(spark, tmp_path):
    entities = spark.range(70_000).withColumnRenamed("id", "uuid")
    cohort.draw_sample(entities, CohortFilter(TableSpec(id_column="uuid")), SamplingSpec(60_000, 3)).write.parquet(str(tmp_path / "sample"))
    members = readers.cohort_members(spark, str(tmp_path), "uuid")
    assert members.count() == 60_000 and members.select("persona_id").distinct().count() == 60_000


def test_request_file(spark, tmp_path):
    path = tmp_path / "request.json"
    path.write_text(json.dumps({"name": "n", "filters": {"age_min": 60, "sexes": ["여자"], "big_five_filters": {"openness": {"t_score_min": 55}}},
                                "sampling": {"sample_size": 20, "seed": 42, "method": "deterministic_random"}}), encoding="utf-8")
    request = readers.read_request(spark, str(path), persona_spec())
    assert request.filters.minimum == 60 and request.filters.traits["openness"].score_min == 55 and request.sampling.seed == 42


def test_exports(spark, stored, tmp_path):
    path = writers.write_export(stored.drop(schemas.CORRUPT), str(tmp_path), "responses_long", {"design_id": "d1", "run_id": "run_7a"})
    other = writers.write_export(stored.drop(schemas.CORRUPT), str(tmp_path), "responses_long", {"design_id": "d1", "run_id": "run_8"})
    assert path != other and spark.read.option("header", True).csv(other).count() == 3
    with pytest.raises(ValueError, match="never exported: postcode"):
        writers.write_export(stored.withColumn("postcode", F.lit("1")), str(tmp_path), "x", {})
    rows = spark.read.option("header", True).csv(path)
    assert rows.columns[0] == "design_id" and rows.columns[-1] == "export_schema_version" and rows.columns.count("run_id") == 1
    assert json.loads(rows.where("response_id = 'response_001'").first()["generation_config"])["model"] == "mock-model"


def test_profile_files(spark, tmp_path):
    tidy = spark.createDataFrame([("age", "age", "mean", 1.5, None, "mean"), ("big_five", "o", "x", None, None, "example")],
                                 "section string, column string, value string, count double, ratio double, metric string")
    writers.write_profile_csv(tidy, str(tmp_path / "profile"))
    assert spark.read.option("header", True).csv(str(tmp_path / "profile")).where("section = 'age'").first()["count"] == "1.5"


def test_status_rules(spark, stored):
    clean = stored.drop(schemas.CORRUPT)
    assert checks.check_status_payload(clean).count() == 0
    broken = clean.withColumn("error_type", F.lit("X")).withColumn("status", F.lit("success"))
    details = {r["key"]: r["detail"] for r in checks.check_status_payload(broken).collect()}
    assert details == {"response_001": "success with error_type", "response_002": "success with error_type", "response_003": "success without payload"}
    bare = clean.where("status = 'error'").withColumn("error_type", F.lit(None).cast("string"))
    assert [r["detail"] for r in checks.check_status_payload(bare).collect()] == ["error without error_type"]


def test_remaining_rules(spark):
    df = spark.createDataFrame([("project_a", "run_1", 5, 1, "x", None), ("Project_a", "run_2", 1, 9, "", 3.0)],
                               "project_id string, run_id string, lo int, hi int, t string, temp double")
    assert [r["detail"] for r in checks.check_id_pattern(df, "run_id", {"project_id": r"^project_[a-z0-9._-]+$"}).collect()] == ["project_id"]
    assert [r["key"] for r in checks.check_range_order(df, "run_id", "lo", "hi").collect()] == ["run_1"]
    bounds = checks.check_bounds(df, "run_id", {"temp": (0, 2), "t": (1, None), "hi": (1, 5)}).collect()
    assert {(r["key"], r["detail"]) for r in bounds} == {("run_2", "temp"), ("run_2", "t"), ("run_2", "hi")}
    assert [r["detail"] for r in checks.check_scope(df, "run_id", {"project_id": "project_a", "run_id": "run_1"}).collect()] == ["project_id,run_id"]
    assert checks.check_vocabulary(df, "run_id", {"t": ("x",)}).first()["detail"] == "t="
    orphans = checks.check_orphans(df, "run_id", "lo", spark.createDataFrame([(1,)], "id int"), "id")
    assert [r["key"] for r in orphans.collect()] == ["run_1"]
    spec = TableSpec("run_id", base_context=("run_id", "gone"), narratives=("n",), trait_columns=("o",))
    found = {tuple(r) for r in checks.missing_columns(df, spec).collect()}
    assert found == {("P1", "gone"), ("P2", "gone"), ("P3", "gone"), ("P3", "n"), ("trait", "o")}


def test_repeat_links(spark):
    rows = [
        ("s", "o", "ORIGINAL", None), ("s", "r", "SAME_QUESTION_REPEAT", "o"), ("s", "a", "SAME_QUESTION_REPEAT", None),
        ("s", "b", "ORIGINAL", "o"), ("s", "c", "SAME_QUESTION_REPEAT", "zz"), ("s", "d", "SAME_QUESTION_REPEAT", "r"),
        ("t", "e", "SAME_QUESTION_REPEAT", "o"),
    ]
    df = spark.createDataFrame(rows, "question_set_id string, question_id string, question_type string, repeat_of_question_id string")
    found = {r["key"]: r["detail"] for r in checks.check_repeat_link(df).collect()}
    assert found == {"s|a": "link required", "s|b": "link not allowed", "s|c": "target not in set", "s|d": "target is not an original",
                     "t|e": "target not in set"}


def test_variant_metadata(spark):
    rows = [("v1", "PARAPHRASE", {"original_question_id": "q", "paraphrase_text": "t"}), ("v2", "ORIGINAL", {"base_question_id": "q", "base_question_text": "t"}),
            ("v3", "WHAT", {})]
    df = spark.createDataFrame(rows, "variant_id string, kind string, meta map<string,string>")
    found = {(r["key"], r["detail"]) for r in checks.check_variant_metadata(df, "variant_id", "kind", "meta").collect()}
    assert found == {("v1", "meaning_preservation_rule"), ("v3", "unknown type")}
