import hashlib

import pytest

from cohortry import vocab
from cohortry.operators import inspect, profile


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        ("female", "Seoul", "A", 19, "college", "active", "low", "normal", "high", "same text"),
        ("male", "Busan", "B", 35, "high", "inactive", "middle", "normal", "medium", "same text"),
        ("female", "Seoul", "A", 67, "college", "active", "high", "high", "low", "other"),
        ("female", "Jeju", "C", 40, "grad", "active", "middle", "low", "high", "longer text here"),
    ]
    return spark.createDataFrame(
        rows, "sex string, region string, district string, age bigint, education_level string, "
        "economic_activity_status string, income_bracket string, bmi_status string, openness string, persona string")


def test_value_frequencies(small):
    rows = profile.value_frequencies(small, ["sex", "region"], 2).collect()
    found = {(r["column"], r["rank"]): (r["value"], r["count"], r["ratio"]) for r in rows}
    assert found == {
        ("sex", 1): ("female", 3, 0.75), ("sex", 2): ("male", 1, 0.25),
        ("region", 1): ("Seoul", 2, 0.5), ("region", 2): ("Busan", 1, 0.25),
    }


def test_categorical_profile(small):
    rows = {r["column"]: r for r in profile.categorical_profile(small, ["sex", "income_bracket"], limit=2).collect()}
    assert rows["sex"]["distinct_count"] == 2 and rows["sex"]["selectable"]
    assert rows["income_bracket"]["note"] == vocab.NOTE_ORDERED and not rows["income_bracket"]["selectable"]


def test_age(small):
    row = profile.numeric_profile(small, ["age"]).first()
    assert (row["minimum"], row["maximum"], row["mean"], row["median"]) == (19, 67, 40.25, 37.5)
    decades = [(r["label"], r["count"], r["ratio"]) for r in profile.decade_histogram(small, "age").orderBy("decade").collect()]
    assert decades == [(f"{d}s", 1, 0.25) for d in (10, 30, 40, 60)]


def test_traits_and_texts(small):
    trait = profile.parseability_profile(small, ["openness"]).first()
    assert trait["parseable_ratio"] == 0 and not trait["numeric_parseable"] and trait["examples"] == ["high", "low", "medium"]
    text = profile.text_profile(small, ["persona"]).first()
    assert text["mean_length"] == 9.75 and text["p95_length"] == pytest.approx(14.95) and text["max_length"] == 16
    assert text["duplicate_row_ratio"] == 0.25 and text["top_exact_value_ratio"] == 0.5


def test_parse_diagnostics(people):
    row = profile.json_parse_diagnostics(people, ["openness"]).first()
    assert (row["row_count"], row["parse_success_count"], row["parse_failure_count"]) == (8, 7, 1)


def test_number_texts(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "1d", "1f", "0x1", "", "abc", "NaN", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    row = profile.parseability_profile(df, ["v"]).first()
    assert row["parseable_ratio"] == 0.5 and row["distinct_count"] == 10


def test_tidy(small):
    tidy = profile.profile_tidy(small, vocab.PROFILE_CATEGORICALS, "age", vocab.TRAIT_COLUMNS, vocab.NARRATIVE_COLUMNS, 2)
    rows = {(r["section"], r["column"], r["value"]): (r["count"], r["ratio"], r["metric"]) for r in tidy.collect()}
    assert rows["categorical", "sex", "distinct_count"] == (2.0, None, None)
    assert rows["categorical", "sex", "female"] == (3.0, 0.75, "frequency")
    assert rows["age", "age", "median"] == (37.5, None, "median")
    assert rows["age", "age", "40s"] == (1.0, 0.25, "decade")
    assert rows["big_five", "openness", "parseable_ratio"] == (None, 0.0, None)
    assert rows["big_five", "openness", "high"] == (None, None, "example")
    assert rows["narrative", "persona", "duplicate_row_ratio"] == (0.25, None, "duplicate_row_ratio")
    assert ("categorical", "housing_type", "distinct_count") not in rows


def test_empty_table(small):
    empty = small.where("false")
    assert tuple(profile.json_parse_diagnostics(empty, ["openness"]).first()) == ("openness", 0, 0, 0, None)
    assert tuple(profile.text_length_profile(empty, ["persona"]).first()) == ("persona", None, None, None, None, None)
    assert tuple(profile.categorical_profile(empty, ["sex"]).first()) == ("sex", 0, True, vocab.NOTE_SELECTABLE)
    assert tuple(profile.parseability_profile(empty, ["openness"]).first()) == ("openness", 0, 0.0, False, [])
    assert tuple(profile.text_duplicate_profile(empty, ["persona"]).first()) == ("persona", 0, None, None)
    assert tuple(profile.numeric_profile(empty, ["age"]).first()) == ("age", 0, None, None, None, None)
    assert inspect.null_profile(empty).first()["null_ratio"] == 0.0


def test_columns_without_values_keep_their_row(small):
    gaps = small.selectExpr("*", "cast(null as double) AS height", "cast(null as string) AS note")
    rows = {r["column"]: r for r in profile.numeric_profile(gaps, ["age", "height"]).collect()}
    assert rows["age"]["n"] == 4 and rows["height"]["n"] == 0 and rows["height"]["median"] is None
    lengths = {r["column"]: r["max_length"] for r in profile.text_length_profile(gaps, ["persona", "note"]).collect()}
    assert lengths == {"persona": 16, "note": None}


@pytest.fixture(scope="module")
def inspected(spark):
    rows = [
        ("p1", 25, "female", "Kim A", "Seoul detail", 0.5, "story one"),
        ("p2", 40, "male", "Lee B", None, 0.7, "story two"),
        ("p3", None, "female", "Park C", "Busan detail", None, "story three"),
    ]
    return spark.createDataFrame(
        rows, "persona_id string, age bigint, gender string, name string, address string, openness double, persona_story string")


def test_inspection(inspected):
    shape = inspect.table_shape(inspected).first()
    assert (shape["n_rows"], shape["n_columns"]) == (3, 7)
    rows = {r["column"]: r for r in inspect.inspect_columns(inspected).collect()}
    assert rows["age"]["null_count"] == 1 and rows["age"]["null_ratio"] == pytest.approx(1 / 3)
    assert rows["name"]["privacy_risk"] and rows["address"]["privacy_risk"] and not rows["gender"]["privacy_risk"]
    assert rows["persona_id"]["categories"] == ["persona_id", "narrative"]
    groups = {r["category"]: r["columns"] for r in inspect.candidate_groups(inspect.inspect_columns(inspected)).collect()}
    assert groups["persona_id"] == ["persona_id"] and "age" in groups["demographic"]
    assert groups["big_five"] == ["openness"] and "persona_story" in groups["narrative"]


def test_masking(inspected):
    rows = inspect.masked_sample(inspected, ["persona_id"], 3).collect()
    assert [r["name"] for r in rows] == ["***MASKED***"] * 3
    assert [r["address"] for r in rows] == ["***MASKED***", None, "***MASKED***"]
    assert [r["persona_story"] for r in rows] == ["story one", "story two", "story three"]
    assert inspect.masked_sample(inspected, ["persona_id"], -5).count() == 0


def test_display_cells(spark):
    df = spark.sql("SELECT X'0aff' AS b, CAST(1.50 AS DECIMAL(5,2)) AS d, DATE'2024-02-03' AS day, "
                   "TIMESTAMP'2024-02-03 04:05:06.5' AS t, 7 AS n")
    assert tuple(inspect.mask_table(df, []).first()) == ("0aff", "1.50", "2024-02-03", "2024-02-03T04:05:06.500000", 7)


def test_whole_word_classes(spark):
    df = spark.createDataFrame([(1, 2)], "page_id int, ethnicity int")
    loose = {r["column"]: r["categories"] for r in inspect.inspect_columns(df).collect()}
    strict = {r["column"]: r["categories"] for r in inspect.inspect_columns(df, whole_words=True).collect()}
    assert loose == {"page_id": ["persona_id", "demographic"], "ethnicity": ["sensitive_or_identifying"]}
    assert strict == {"page_id": ["persona_id"], "ethnicity": []}


def test_fingerprints(spark, people, tmp_path):
    first = inspect.dataset_fingerprint(people).first()
    assert inspect.dataset_fingerprint(people.repartition(4)).first() == first
    assert inspect.dataset_fingerprint(people.limit(5)).first() != first
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "b 100% 글.txt").write_bytes(b"abc" * 1_000_000)
    rows = {r["size_bytes"]: r["sha256"] for r in inspect.file_fingerprints(spark, str(tmp_path)).collect()}
    assert rows == {n: hashlib.sha256(b"abc" * (n // 3)).hexdigest() for n in (3, 3_000_000)}
