import hashlib
import json

import pytest

from cohortry.operators import cohort, inspect, options
from cohortry.spec import CohortFilter, CohortRequest, SamplingSpec, TableSpec, TraitFilter, persona_spec

SPEC = persona_spec()


def count(df, **parts):
    return cohort.matching_count(df, CohortFilter(SPEC, **parts)).first()[0]


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        ({}, 8),
        ({"minimum": 45, "maximum": 67}, 4),
        ({"values": {"sexes": ("여자", "남자")}}, 8),
        ({"values": {"sexes": ("남자",), "regions": ("대전",)}}, 2),
        ({"values": {"regions": ("대전",), "districts": ("서구", "중구")}}, 3),
        ({"values": {"income_brackets": ("해당없음",)}}, 2),
        ({"traits": {"openness": TraitFilter(score_min=60, labels=("높음",))}}, 2),
        ({"traits": {"openness": TraitFilter(score_min=1)}}, 7),
        ({"values": {"occupations": ("요리사",)}}, 3),
        ({"search": "리사"}, 3),
        ({"search": "%"}, 0),
    ],
)
def test_filters(people, parts, expected):
    assert count(people, **parts) == expected


def test_unknown_values_are_refused():
    with pytest.raises(ValueError, match="Big Five trait"):
        CohortFilter(SPEC, traits={"unknown": TraitFilter(labels=("높음",))})
    with pytest.raises(ValueError, match="Unsupported sex value"):
        CohortFilter(SPEC, values={"sexes": ("female",)})
    with pytest.raises(ValueError, match="Unsupported filter field"):
        CohortFilter(SPEC, values={"names": ("A",)})
    with pytest.raises(ValueError, match="age_min cannot"):
        CohortFilter(SPEC, minimum=50, maximum=40)
    with pytest.raises(ValueError, match="score_min"):
        TraitFilter(60, 50)
    with pytest.raises(ValueError, match="at least 1"):
        SamplingSpec(0, 1)


def ids(df, size=3, seed=42, **kwargs):
    wanted = CohortFilter(SPEC, values={"sexes": ("남자",)})
    rows = cohort.draw_sample(df, wanted, SamplingSpec(size, seed), **kwargs).orderBy("sample_rank").collect()
    assert [r["sample_rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["uuid"] for r in rows]


def test_sample_is_the_md5_order(people):
    men = ["n01", "n03", "n04", "n06", "n07"]
    expected = sorted(men, key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
    assert ids(people) == expected[:3]
    assert ids(people.repartition(7)) == expected[:3]
    assert ids(people.union(people)) == expected[:3]
    assert ids(people, seed=43) != expected[:3]


@pytest.mark.parametrize("size", [1, 700, 5000])
def test_samples_of_any_size_are_a_prefix_of_one_order(spark, size):
    entities = spark.range(5000).withColumnRenamed("id", "uuid")
    drawn = cohort.draw_sample(entities, CohortFilter(TableSpec(id_column="uuid")), SamplingSpec(size, 9)).collect()
    expected = sorted(range(5000), key=lambda i: hashlib.md5(f"{i}|9".encode()).hexdigest())[:size]
    assert [r["uuid"] for r in sorted(drawn, key=lambda r: r["sample_rank"])] == expected
    assert sorted(r["sample_rank"] for r in drawn) == list(range(1, size + 1))


def test_guards(people):
    with pytest.raises(ValueError, match="larger than matching count"):
        cohort.require_feasible(people, CohortFilter(SPEC, values={"regions": ("광주",)}), SamplingSpec(3, 1))
    with pytest.raises(ValueError, match="matching count is zero"):
        cohort.require_feasible(people, CohortFilter(SPEC, values={"regions": ("제주",)}), SamplingSpec(1, 1))
    # duplicates do not count as further entities
    with pytest.raises(ValueError, match="larger than matching count"):
        cohort.require_feasible(people.union(people), CohortFilter(SPEC), SamplingSpec(9, 1))


def test_preview_is_safe_and_ordered(people):
    wanted = CohortFilter(SPEC, values={"sexes": ("남자",)})
    sample = cohort.draw_sample(people, wanted, SamplingSpec(3, 42))
    shown = cohort.preview(people, sample, "uuid", SPEC.preview, limit=2)
    assert [r["uuid"] for r in shown.collect()] == ids(people)[:2]
    assert not {"first_name", "street_name", "persona"} & set(shown.columns)
    assert cohort.preview(people, sample, "uuid", SPEC.preview, limit=-1).count() == 0
    with pytest.raises(ValueError, match="never exported: street_name"):
        cohort.preview(people, sample, "uuid", ("uuid", "street_name"))
    assert cohort.safe_projection(people, ("uuid", "first_name", "age")).columns == ["uuid", "age"]


def test_manifest_is_stable(people):
    request = CohortRequest.from_dict(
        {"name": "n", "filters": {"age_min": 60, "age_max": 79, "sexes": ["남자"]},
         "sampling": {"sample_size": 2, "seed": 42, "method": "deterministic_random"}}, SPEC)
    fingerprint = inspect.dataset_fingerprint(people)
    def row(df):
        sample = cohort.draw_sample(df, request.filters, request.sampling)
        return cohort.manifest(df, request, sample, inspect.dataset_fingerprint(df)).first()

    first, second = row(people), row(people.repartition(3))
    assert first == second
    assert first["matching_count"] == 3 and first["row_count"] == 8 and first["sampled"] == 2
    canonical = json.loads(first["canonical_filter_json"])
    assert canonical["age_min"] == 60 and canonical["sexes"] == ["남자"] and canonical["regions"] == []
    assert "occupation_search" not in canonical and canonical["big_five_filters"] == {}
    text = f"{fingerprint.first()['fingerprint']}|{first['canonical_filter_json']}|" + '{"sample_size":2,"seed":42,"method":"deterministic_random"}'
    assert first["cohort_id"] == "cohort_" + hashlib.sha256(text.encode()).hexdigest()[:16]
    assert first["human_readable_filter"] == "age >= 60; age <= 79; sex in (남자)"
    assert CohortFilter(SPEC).summary() == "all synthetic personas"


def test_options(people):
    assert [r[0] for r in options.option_values(people, "region").collect()] == ["광주", "대전", "울산"]
    assert [tuple(r) for r in options.option_value_counts(people, "region").collect()] == [("대전", 4), ("광주", 2), ("울산", 2)]
    assert [r[0] for r in options.dependent_options(people, "region", "district", ("대전",)).collect()] == ["서구", "유성구", "중구"]
    assert [r[0] for r in options.option_search(people, "occupation", "리사").collect()] == ["요리사"]
    with pytest.raises(ValueError, match="not present in selected regions"):
        options.require_children(people, "region", "district", ("대전",), ("북구",))
    options.require_children(people, "region", "district", ("대전",), ("중구",))
    with pytest.raises(ValueError, match="Unsupported option column"):
        options.option_values(people, "first_name", SPEC.list_fields.values())


def test_ordered_vocabulary(people, spark):
    order = SPEC.vocabularies["income_bracket"]
    assert (order.index("해당없음"), order.index("1000만원이상")) == (0, 10)
    found = [tuple(r) for r in options.ordinal_observed(people, "income_bracket", order).collect()]
    assert [f[1] for f in found] == ["해당없음", "85~150만원", "150~250만원", "250~350만원", "350~450만원", "450~550만원"]
    assert [f[0] for f in found] == [0, 2, 3, 4, 5, 6]


def test_null_options_stay_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "v string")
    assert [r[0] for r in options.option_values(df, "v").collect()] == ["a", None]
