import os

import pytest
from pyspark.sql import functions as F

from cohortry import workflow
from cohortry.operators import compare, responses
from cohortry.operators.responses import ResponseGenerationError
from cohortry.sources import schemas, store, writers
from test_workflow import NOW, REQUEST, RUN, SPEC, store_plan


def recording(folder, broken=None, refused=None):
    """A generator that leaves a file for every question it is asked, and breaks at one agent."""
    def generator(cell):
        if cell["agent_id"] == broken:
            raise RuntimeError("worker gone")
        name = f"{folder}/{cell['agent_id']}-{cell['question_id']}"
        with open(name, "a", encoding="utf-8") as file:
            file.write("x")
        if cell["agent_id"] == refused:
            raise ResponseGenerationError("no")
        return cell["region"], {"stance": "neutral", "stance_score": 3, "reasoning_summary": "r", "concerns": [], "acceptance_conditions": []}

    return generator


def test_a_rerun_asks_no_committed_lot_again(spark, people, tmp_path):
    out, asked = str(tmp_path), tmp_path / "asked"
    asked.mkdir()
    path = workflow.save_cohort(people, REQUEST, out)
    store_plan(spark, out)
    members = [r["persona_id"] for r in workflow.load_cohort(spark, path, "uuid").collect()]
    lots = 5
    lot_of = {r["id"]: r["_lot"] for r in store.in_lots(spark.createDataFrame([(m,) for m in members], "id string"), "id", lots).collect()}
    last = max(members, key=lambda m: lot_of[m])
    with pytest.raises(Exception, match="worker gone"):
        workflow.run_questions(people, SPEC, path, RUN, out, NOW, recording(str(asked), broken=last), lots=lots)
    done = {r["lot"] for r in store.committed(spark, f"{out}/response_lots", RUN.project_id, RUN.run_id)}
    assert done == set(range(lot_of[last]))
    before = {m for m in members if lot_of[m] in done}
    refused = members[0] if members[0] not in before else last
    workflow.run_questions(people, SPEC, path, RUN, out, NOW, recording(str(asked), refused=refused), lots=lots)
    for name in os.listdir(asked):
        if name.rsplit("-question_", 1)[0] in before:
            assert (asked / name).read_text() == "x", name
    rows = workflow.read_run(spark, out, RUN).collect()
    assert sorted({r["agent_id"] for r in rows}) == sorted(members) and len(rows) == 2 * len(members)
    # the log has what the writes observed
    seen = store.run_metrics(spark, f"{out}/response_lots", RUN.project_id, RUN.run_id)
    frame = workflow.read_run(spark, out, RUN)
    summary = responses.run_summary(frame, frame).first()
    assert seen == {c: summary[c] for c in ("stored", "succeeded", "failed", "error_types")} and seen["failed"] == 2
    # a third start has nothing to ask
    workflow.run_questions(people, SPEC, path, RUN, out, NOW, recording(str(asked), broken=last), lots=lots)


@pytest.fixture
def answers(spark):
    def make(text, n=4, run="run_1"):
        rows = [("project_p", "cohort_c", f"a{k}", "scenario_s", "question_o", run, f"response_{k:012d}", 0, "ORIGINAL", text,
                 ("neutral", 3, "r", [], []), None, "success", None, None) for k in range(n)]
        return spark.createDataFrame(rows, schemas.RESPONSE)

    return make


def test_a_failed_rewrite_leaves_the_old_run(spark, tmp_path, answers):
    root = str(tmp_path)
    assert store.committed(spark, root, "project_p", "run_1") == []
    store.commit(answers("old"), root, "project_p", "run_1")
    store.commit(answers("other", run="run_2"), root, "project_p", "run_2")
    broken = writers.checked_responses(answers("new").withColumn("response_text", F.when(F.col("agent_id") != "a3", "new")), "project_p", "run_1")
    with pytest.raises(Exception, match="success without payload"):
        store.commit(broken, root, "project_p", "run_1")

    def texts():
        return sorted(r["response_text"] for r in store.read_committed(spark, root, "project_p", "run_1", schemas.RESPONSE).collect())

    assert texts() == ["old"] * 4
    store.commit(answers("new", 3), root, "project_p", "run_1", file_format="json")
    assert texts() == ["new"] * 3
    for lot in range(2):  # lots take the place of the whole, once there are any
        store.commit(answers(f"lot {lot}", 1), root, "project_p", "run_1", lot, 2)
    assert texts() == ["lot 0", "lot 1"]
    files = store.read_committed(spark, root, "project_p", "run_1", schemas.RESPONSE).inputFiles()
    assert len({os.path.dirname(f) for f in files}) == 2  # no other run's files are opened
    assert store.read_committed(spark, root, "project_x", "run_1", schemas.RESPONSE).collect() == []


def test_runs_of_a_condition_open_their_files_only(spark, tmp_path, answers):
    root = str(tmp_path)
    assert store.read_runs(spark, root, schemas.RESPONSE).collect() == [] and store.run_table(spark, root).collect() == []
    store.commit(answers("old", 9), root, "project_p", "run_1")
    for lot in range(2):
        store.commit(answers("lot", 3), root, "project_p", "run_1", lot, 2)
    store.commit(answers("json", 2, "run_2"), root, "project_p", "run_2", file_format="json")
    store.commit(answers("other", 1), root, "project_q", "run_1")
    found = store.read_runs(spark, root, schemas.RESPONSE, F.col("project_id") == "project_p")
    assert sorted(r["response_text"] for r in found.collect()) == ["json"] * 2 + ["lot"] * 6
    one = store.read_runs(spark, root, schemas.RESPONSE, F.col("run_id") == "run_2")
    assert len({os.path.dirname(f) for f in one.inputFiles()}) == 1 and one.count() == 2
    assert store.read_runs(spark, root, schemas.RESPONSE).count() == 9
    seen = {(r["project_id"], r["run_id"]): r for r in store.run_table(spark, root).collect()}
    assert {k: (r["lots"], r["committed_lots"], r["stored"], r["failed"]) for k, r in seen.items()} == {
        ("project_p", "run_1"): (2, 2, 6, 0), ("project_p", "run_2"): (1, 1, 2, 0), ("project_q", "run_1"): (1, 1, 1, 0)}


def test_a_run_in_json_lines_is_read(spark, tmp_path, answers):
    writers.write_responses(answers("text"), str(tmp_path), "project_p", "run_1", "json")
    rows = workflow.read_run(spark, str(tmp_path), RUN, "json").collect()
    assert len(rows) == 4 and {r["stance"] for r in rows} == {"neutral"}


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    rows = []
    for k in range(3000):
        agent = 0 if k % 3 == 0 else k
        rows.append(("project_p", "run_1", agent, f"question_{k}", "ORIGINAL", None, f"response_{k}", k % 3))
        if k % 2:
            rows.append(("project_p", "run_1", agent, f"question_{k}_again", "SAME_QUESTION_REPEAT", f"question_{k}", f"response_{k}r", k % 2))
    frame = spark.createDataFrame(rows, "project_id string, run_id string, agent_id long, question_id string, question_type string, "
                                        "repeat_of_question_id string, response_id string, stance int")
    path = str(tmp_path_factory.mktemp("fact"))
    return frame, store.save_fact(frame, "fact_test", path, 6), path


def test_pairs_of_a_stored_fact_need_no_exchange(spark, fact):
    frame, stored, path = fact
    pairs = store.fact_pairs(stored, ["response_id", "stance"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = {(r["response_id_a"], r["response_id_b"]) for r in compare.repeat_pairs(frame).collect()}
    assert {(r["response_id_a"], r["response_id_b"]) for r in pairs.collect()} == want and len(want) == 1500
    # an agent with a third of the rows is spread over the buckets
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes)
    spark.sql("CREATE DATABASE IF NOT EXISTS other")
    again = store.open_fact(spark, "other.fact_again", path, 6)
    assert "Exchange" not in store.fact_pairs(again, ["stance"])._jdf.queryExecution().executedPlan().toString()
    assert again.count() == stored.count()


def test_tracing_a_stored_fact_exchanges_no_fact_row(spark, fact):
    _, stored, _ = fact
    runs = spark.createDataFrame([("project_p", "run_1", "set_1", "P1")], "project_id string, run_id string, question_set_id string, level string")
    scenarios = spark.createDataFrame([("project_p", "s", "title")], "project_id string, scenario_id string, title string")
    questions = stored.select("project_id", F.lit("set_1").alias("question_set_id"), "question_id", F.lit("why?").alias("question_text"))
    contexts = stored.select(F.col("agent_id").alias("persona_id"), F.lit("x").alias("region")).distinct()
    traced = responses.trace_responses(
        stored.withColumn("scenario_id", F.lit("s")), F.broadcast(runs), F.broadcast(scenarios), F.broadcast(questions), F.broadcast(contexts))
    lines = traced._jdf.queryExecution().executedPlan().toString().splitlines()
    # the fact is the outermost scan: every exchange stands below a broadcast of another side
    depth = {k: len(line) - len(line.lstrip(" :+-")) for k, line in enumerate(lines)}
    for k, line in enumerate(lines):
        if "Exchange" in line and "BroadcastExchange" not in line:
            assert any("BroadcastExchange" in lines[j] and depth[j] < depth[k] for j in range(k)), line
    assert traced.count() == stored.count() and not any("SortMergeJoin" in line for line in lines)
