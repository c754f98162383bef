import re
from collections import Counter

import pytest

from cohortry.operators import checks, rules
from cohortry.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["table_name", "rule", "key", "detail", "n_rows"]


def found(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def answers(spark):
    rows = [("a1", "q1", "yes", 3, None), ("a1", "q1", "yes", 3, None), ("a2", "q9", "maybe", 11, "p"), ("a3", None, None, None, "q"),
            (None, "q2", "no", -1, None), (None, "q3", "no", 2, "k")]
    return spark.createDataFrame(rows, "response_id string, question_id string, stance string, score int, `rule` string")


@pytest.fixture(scope="module")
def questions(spark):
    rows = [("q1", "ORIGINAL", None), ("q2", "REPEAT", "q1"), ("q3", "REPEAT", "q2"), ("q4", "REPEAT", "q7"), (None, "ORIGINAL", None)]
    return spark.createDataFrame(rows, "question_id string, question_type string, repeat_of string")


def plan_of(answers, questions):
    return rules.violations({
        "answers": rules.RuledTable(answers, "response_id", [
            rules.vocabulary({"stance": ("yes", "no")}), rules.bounds({"score": (0, 10)}), rules.Unique(["response_id"]),
            rules.Link(["question_id"], "questions", ["question_id"], rule="question"),
        ]),
        "questions": rules.RuledTable(questions, "question_id", [
            rules.Unique(["question_id"]),
            rules.Link(["repeat_of"], "questions", ["question_id"], "question_type = 'ORIGINAL'", "repeat"),
        ]),
    })


def test_row_rules_keys_and_links_of_two_tables(answers, questions):
    assert found(plan_of(answers, questions)) == Counter([
        ("answers", "vocabulary", "a2", "stance=maybe", 1), ("answers", "bounds", "a2", "score", 1), ("answers", "bounds", "", "score", 1),
        ("answers", "unique", "a1", "2", 2), ("answers", "unique", "", "2", 2), ("answers", "question", "q9", "no parent", 1),
        ("questions", "repeat", "q2", "unsuitable parent", 1), ("questions", "repeat", "q7", "no parent", 1),
    ])


def test_repeated_rows_are_counted_and_empty_tables_have_no_parents(answers, questions):
    twice = found(plan_of(answers.union(answers), questions.where("false")))
    assert twice["answers", "vocabulary", "a2", "stance=maybe", 2] == 1
    assert twice["answers", "question", "q1", "no parent", 4] == 1
    assert twice["answers", "unique", "a1", "4", 4] == 1
    assert found(plan_of(answers.where("false"), questions.where("false"))) == Counter()


def test_keys_of_several_columns_do_not_run_together(spark):
    pairs = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a")], "x string, `key` string")
    assert found(rules.violations({"t": rules.RuledTable(pairs, ["x", "key"], [rules.Unique(["x", "key"])])})) == Counter()


def test_each_rule_finds_what_its_own_check_finds(spark):
    rows = [(1, "p", "r", "success", "t", None, None), (2, "p", "s", "success", None, "x", None), (3, "o", "s", "error", None, None, None),
            (4, None, "r", "error", None, None, "timeout"), (5, "p", "r", "success", "t", "x", "timeout")]
    frame = spark.createDataFrame(rows, "id int, project_id string, run_id string, status string, response_text string, "
                                        "structured_response string, error_type string")
    kinds = spark.createDataFrame([(1, "FRAMING_CHANGE", {"frame_label": "x"}), (2, "other", {}), (3, None, None)],
                                  "id int, kind string, metadata map<string, string>")
    scope, patterns = {"project_id": "p", "run_id": "r"}, {"project_id": "^p$", "run_id": "^r$"}
    both = [
        (frame, rules.status_payload(), checks.check_status_payload(frame, "id")),
        (frame, rules.scope(scope), checks.check_scope(frame, "id", scope)),
        (frame, rules.id_pattern(patterns), checks.check_id_pattern(frame, "id", patterns)),
        (frame, rules.pair_distinct("project_id", "response_text"), checks.check_pair_distinct(frame, "id", "project_id", "response_text")),
        (frame, rules.range_order("run_id", "project_id"), checks.check_range_order(frame, "id", "run_id", "project_id")),
        (kinds, rules.variant_metadata("kind", "metadata"), checks.check_variant_metadata(kinds, "id", "kind", "metadata")),
    ]
    for df, rule, alone in both:
        got = rules.violations({"t": rules.RuledTable(df, "id", [rule])})
        assert sorted(tuple(r)[1:4] for r in got.collect()) == sorted(tuple(r) for r in alone.collect())


def test_refuses_links_of_other_types_and_repeated_names(answers, questions):
    link = rules.Link(["score"], "questions", ["question_id"])
    with pytest.raises(ValueError, match="different types"):
        rules.violations({"answers": rules.RuledTable(answers, "response_id", [link]), "questions": rules.RuledTable(questions, "question_id")})
    with pytest.raises(ValueError, match="different names"):
        rules.violations({"answers": rules.RuledTable(answers, "response_id", [rules.Unique(["score"]), rules.Unique(["stance"])])})
    with pytest.raises(ValueError, match="no rules"):
        rules.violations({"answers": rules.RuledTable(answers, "response_id")})


def test_one_scan_a_table_one_shuffle_and_a_hot_link_is_one_row_a_task(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    report = QUERIES["integrity_report"](spark, SMALL)
    plan = report._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*?/(\w+)\.parquet", plan)
    assert Counter(scans) == Counter(["orders", "lineitem", "customer", "documents", "pages", "part"])
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Join" not in plan
    documents = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*documents\.parquet", plan).group(1)
    assert {c.split("#")[0] for c in documents.split(",")} == {"doc_id", "text", "n_chars"}
    # 100,000 children of one missing parent are counted before the shuffle
    path = str(tmp_path / "hot")
    spark.range(0, 100_000, 1, 4).selectExpr("id", "7L AS parent").write.parquet(path)
    hot = rules.violations({
        "child": rules.RuledTable(spark.read.parquet(path), "id", [rules.Link(["parent"], "owner", ["id"])]),
        "owner": rules.RuledTable(spark.range(5), "id"),
    })
    assert found(hot) == Counter([("child", "orphan", "7", "no parent", 100_000)])
    counted = hot._jdf.queryExecution().executedPlan().toString()
    assert counted.index("Exchange hashpartitioning") < counted.rindex("HashAggregate")  # a partial count below the shuffle


def test_entries_are_compiled_and_spilled_counts_are_sorted_by_a_part_of_the_key(spark):
    """What made the seconds grow faster than the rows: interpreted lambdas, and sorting by names that are alike in every entry."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = QUERIES["integrity_report"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "lambda" not in below and "array<string>" not in below
    grouped = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan)
    assert len(grouped) == 2 and all(re.match(r"n0#\d+L, n1#\d+L, slot#", keys) for keys in grouped)


def test_fixed_rules_are_counted_beside_the_unique_key(spark):
    """Repeated and NULL keys, rules that say the same or share a name, numbers and texts as keys: rows as one entry each gives."""
    rows = [(1, "a", 5, 1), (1, "a", 5, 9), (2, "b", 0, None), (None, "c", 7, 3), (None, "c", 7, 3), (3, None, None, 2), (3, None, 1, 0)]
    frame = spark.createDataFrame(rows, "id int, t string, low int, high int")
    row_rules = [
        rules.range_order("low", "high"), rules.condition("small", "low < 1", "low"), rules.condition("small", "high < 1", "high"),
        rules.condition("twice", "low > 4", "same"), rules.condition("twice", "high > 2", "same"),
        rules.vocabulary({"t": ("a",)}), rules.condition("vocabulary", "low = 0", "t=b"),
    ]
    for key in (["id"], ["t"], ["id", "t"]):
        want = Counter()
        for i, t, low, high in rows:
            name = "|".join(str(v) for v in ({"id": i, "t": t}[k] for k in key) if v is not None)
            low_, high_ = low is not None, high is not None
            said = [("range_order", "low > high")] * (low_ and high_ and low > high) + [("small", "low")] * (low_ and low < 1)
            said += [("small", "high")] * (high_ and high < 1) + [("twice", "same")] * (low_ and low > 4) + [("twice", "same")] * (high_ and high > 2)
            said += [("vocabulary", f"t={t}")] * (t not in (None, "a")) + [("vocabulary", "t=b")] * (low == 0)
            want.update(("t", *s[:1], name, *s[1:]) for s in said)
        keys = Counter(tuple({"id": r[0], "t": r[1]}[k] for k in key) for r in rows)
        single = Counter((*k, n) for k, n in want.items())
        repeated = Counter(("t", "unique", "|".join(str(v) for v in k if v is not None), str(n), n) for k, n in keys.items() if n > 1)
        table = rules.RuledTable(frame, key, [*row_rules, rules.Unique(key)])
        assert found(rules.violations({"t": table})) == single + repeated
        assert found(rules.violations({"t": rules.RuledTable(frame, key, row_rules)})) == single
        other = rules.RuledTable(frame, key, [rules.Unique(["low"], "low"), *row_rules, rules.Unique(key)])
        assert found(rules.violations({"t": other})) - found(rules.violations({"t": rules.RuledTable(frame, key, [rules.Unique(["low"], "low")])})) == single + repeated
