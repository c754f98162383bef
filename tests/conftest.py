import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortry.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shuffle_partitions=3)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """Eight invented personas: three regions, two sexes, every kind of readable and unreadable trait text."""
    def trait(score, label):
        return f'{{"t_score": {score}, "label": "{label}", "description": "-"}}'

    rows = [
        # id, first name, street, age, sex, region, district, occupation, income, openness
        ("n01", "Ara", "Way 3", 31, "남자", "대전", "서구", "교사", "250~350만원", trait(62, "높음")),
        ("n02", "Bom", "Way 8", 52, "여자", "대전", "중구", "요리사", "350~450만원", trait(35, "낮음")),
        ("n03", "Chan", "Lane 1", 67, "남자", "광주", "북구", "해당 없음", "해당없음", trait(51, "보통")),
        ("n04", "Dal", "Lane 2", 74, "남자", "광주", "북구", "화가", "85~150만원", "{broken"),
        ("n05", "Eun", "Road 5", 23, "여자", "울산", "남구", "요리사", "150~250만원", trait(58, "높음")),
        ("n06", "Ga", "Road 6", 45, "남자", "대전", "서구", "요리사", "450~550만원", trait(47, "보통")),
        ("n07", "Ha", "Road 7", 61, "남자", "울산", "남구", "어부", "해당없음", trait(71, "높음")),
        ("n08", "In", "Way 9", 38, "여자", "대전", "유성구", "연구원", "350~450만원", trait(20, "낮음")),
    ]
    names = ["uuid", "first_name", "street_name", "age", "sex", "region", "district", "occupation", "income_bracket", "openness"]
    rest = {
        "marital_status": "미혼", "education_level": "대학원", "bachelors_field": "공학", "family_type": "1인", "housing_type": "주택",
        "housing_tenure": "전세", "military_status": "해당없음", "economic_activity_status": "취업자", "bmi_status": "과체중",
        "blood_pressure_status": "주의", "blood_sugar_status": "당뇨", "waist_status": "정상", "smoking_status": "금연",
        "drinking_status": "비음주", "conscientiousness": trait(50, "보통"), "extraversion": trait(50, "보통"),
        "agreeableness": trait(50, "보통"), "neuroticism": trait(50, "보통"), "persona": "a tale",
    }
    kinds = ", ".join(f"`{c}` {'bigint' if c == 'age' else 'string'}" for c in [*names, *rest])
    return spark.createDataFrame([(*row, *rest.values()) for row in rows], kinds)
