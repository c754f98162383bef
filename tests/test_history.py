import datetime
import os

import pytest
from pyspark.sql import functions as F

from cohortry.operators import review
from cohortry.sources import history

START = datetime.datetime(2026, 1, 1)
SCHEMA = "agent_id long, response_id string, question_id string, created_at timestamp, text string"


def rows_of(n, first=0):
    """A third of the rows are agent 7's, a few have no agent, a few no time."""
    out = []
    for k in range(first, first + n):
        agent = None if k % 50 == 1 else 7 if k % 3 == 0 else k % 200
        when = None if k % 70 == 2 else START + datetime.timedelta(hours=k)
        out.append((agent, f"r{k:05d}", f"q{k % 40 * 2}", when, "text " * 5))
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("history"))
    frame = spark.createDataFrame(rows_of(6000), SCHEMA)
    history.save_history(frame, path, 24)
    return frame, path


def ids(frame):
    return sorted(r["response_id"] for r in frame.select("response_id").collect())


def data_files(path):
    return [name for _, _, names in os.walk(f"{path}/data") for name in names if name.endswith(".parquet")]


def test_one_history_reads_few_files(spark, stored):
    frame, path = stored
    assert len(data_files(path)) >= 20
    for agent in (40, 133, 199):
        found = history.read_history(spark, path, [agent])
        assert ids(found) == ids(frame.where(F.col("agent_id") == agent)) and len(found.inputFiles()) <= 2
    assert ids(history.read_history(spark, path, [133, None])) == ids(frame.where("agent_id = 133 OR agent_id IS NULL"))
    assert ids(history.read_history(spark, path, [None])) == ids(frame.where("agent_id IS NULL"))
    assert ids(history.read_history(spark, path)) == ids(frame)
    ordered = review.agent_history(history.read_history(spark, path, [40]), 40, ["created_at", "response_id"])
    assert [r["response_id"] for r in ordered.collect()] == [
        r["response_id"] for r in review.agent_history(frame, 40, ["created_at", "response_id"]).collect()]


def test_a_hot_agent_is_spread_and_asked_by_time(spark, stored):
    frame, path = stored
    all_of = history.history_files(spark, path, [7])
    assert 6 <= len(all_of) <= 12
    sizes = [r["_rows"] for r in history.file_index(spark, path).collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    since, until = START + datetime.timedelta(hours=3000), START + datetime.timedelta(hours=3200)
    found = history.read_history(spark, path, [7], since, until)
    assert ids(found) == ids(frame.where((F.col("agent_id") == 7) & (F.col("created_at") >= since) & (F.col("created_at") < until)))
    assert 1 <= len(found.inputFiles()) <= 4
    assert ids(history.read_history(spark, path, None, since, until)) == ids(
        frame.where((F.col("created_at") >= since) & (F.col("created_at") < until)))


def test_nothing_that_fits(spark, stored):
    _, path = stored
    assert history.read_history(spark, path, [10**9]).collect() == [] and history.history_files(spark, path, [10**9]) == []
    assert history.read_history(spark, path, []).collect() == []
    assert history.history_files(spark, f"{path}-none") == []
    with pytest.raises(ValueError, match="no history"):
        history.read_history(spark, f"{path}-none")


def scanned_rows(frame):
    """The rows that the scan of a frame gave to the plan."""
    frame._jdf.queryExecution().executedPlan()
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.queryExecution().toRdd().count()
    text, nodes = 0, [plan]
    while nodes:
        node = nodes.pop()
        if "scan" in node.nodeName().lower():
            text += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return text


def test_a_value_that_is_in_no_row_group_is_not_read(spark, stored):
    _, path = stored
    rows = history.read_history(spark, path)
    # odd questions lie between the stored ones, so only the filters of the column can rule the groups out
    assert scanned_rows(rows.where("question_id = 'q41'")) == 0
    assert scanned_rows(rows.where("question_id = 'q40'")) > 0


def test_later_writes_and_compaction(spark, tmp_path):
    path, order = str(tmp_path), ("created_at", "response_id")
    history.save_history(spark.createDataFrame([], SCHEMA), path, 4)
    assert history.history_files(spark, path) == []
    early, late = spark.createDataFrame(rows_of(900), SCHEMA), spark.createDataFrame(rows_of(900, 900), SCHEMA)
    history.save_history(early, path, 6)
    before = set(history.history_files(spark, path))
    history.save_history(late, path, 6)
    assert ids(history.read_history(spark, path)) == ids(early.union(late)) and before < set(history.history_files(spark, path))
    # data without its line in the index is not seen
    late.write.parquet(f"{path}/data/unfinished")
    assert ids(history.read_history(spark, path)) == ids(early.union(late))
    history.compact(spark, path, 8, order=order)
    assert ids(history.read_history(spark, path)) == ids(early.union(late))
    assert not before & set(history.history_files(spark, path)) and len(history.history_files(spark, path, [40])) <= 2
