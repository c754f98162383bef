"""Fixed values of the persona data model.

Everything here is data: column names, closed vocabularies, word lists and id patterns that results depend on. Operators
take a ``TableSpec`` (see ``spec.py``) or plain arguments, with values of this module as defaults.
"""

from __future__ import annotations

# --- fixed values: persona table columns -------------------------------------------------------------------------

ID_COLUMN = "uuid"

# Columns that identify a person and are never exported.
EXCLUDED_COLUMNS = (
    "first_name", "middle_name", "last_name", "street_number", "street_name", "unit", "city", "postcode",
)

NARRATIVE_COLUMNS = (
    "professional_persona", "finance_persona", "healthcare_persona", "sports_persona", "arts_persona",
    "travel_persona", "culinary_persona", "persona", "detailed_persona", "family_persona",
)

PREVIEW_COLUMNS = (
    "uuid", "age", "sex", "region", "district", "marital_status", "education_level", "occupation",
    "economic_activity_status", "income_bracket", "bmi_status", "blood_pressure_status", "blood_sugar_status",
    "smoking_status", "drinking_status",
)

BASE_CONTEXT_COLUMNS = (
    "uuid", "age", "sex", "region", "district", "marital_status", "education_level", "bachelors_field",
    "occupation", "family_type", "housing_type", "housing_tenure", "military_status",
    "economic_activity_status", "income_bracket",
)

HEALTH_COLUMNS = (
    "bmi_status", "blood_pressure_status", "blood_sugar_status", "waist_status", "smoking_status",
    "drinking_status",
)

TRAIT_COLUMNS = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")

# Filter request field -> table column, in request order.
LIST_FIELDS = {
    "sexes": "sex",
    "regions": "region",
    "districts": "district",
    "marital_statuses": "marital_status",
    "education_levels": "education_level",
    "bachelors_fields": "bachelors_field",
    "occupations": "occupation",
    "family_types": "family_type",
    "housing_types": "housing_type",
    "housing_tenures": "housing_tenure",
    "military_statuses": "military_status",
    "economic_activity_statuses": "economic_activity_status",
    "income_brackets": "income_bracket",
    "bmi_statuses": "bmi_status",
    "blood_pressure_statuses": "blood_pressure_status",
    "blood_sugar_statuses": "blood_sugar_status",
    "waist_statuses": "waist_status",
    "smoking_statuses": "smoking_status",
    "drinking_statuses": "drinking_status",
}

# --- fixed values: closed vocabularies ---------------------------------------------------------------------------

INCOME_ORDER = (
    "해당없음", "85만원미만", "85~150만원", "150~250만원", "250~350만원", "350~450만원", "450~550만원",
    "550~650만원", "650~800만원", "800~1000만원", "1000만원이상",
)

VOCABULARIES = {
    "sex": ("여자", "남자"),
    "education_level": ("고등학교", "4년제 대학교", "2~3년제 전문대학", "중학교", "초등학교", "대학원", "무학"),
    "economic_activity_status": ("취업자", "비경제활동인구", "실업자"),
    "income_bracket": INCOME_ORDER,
    "bmi_status": ("정상", "비만", "과체중", "고도비만", "저체중"),
    "blood_pressure_status": ("정상", "주의", "고혈압전단계", "고혈압", "저혈압"),
    "blood_sugar_status": ("정상", "공복혈당장애", "당뇨"),
    "waist_status": ("정상", "복부비만"),
    "smoking_status": ("비흡연", "현재흡연", "금연"),
    "drinking_status": ("음주", "비음주"),
}

# --- fixed values: column-name word lists for the classifier ------------------------------------------------------

COLUMN_PATTERNS = {
    "persona_id": ("persona_id", "personaid", "person_id", "uuid", "식별자"),
    "demographic": ("age", "gender", "sex", "region", "birth", "연령", "나이", "성별", "지역", "거주"),
    "socioeconomic": (
        "job", "occupation", "income", "education", "economic", "employment", "직업", "소득", "학력", "고용",
    ),
    "health": (
        "health", "disease", "disability", "medical", "bmi", "blood", "waist", "smoking", "drinking",
        "건강", "질병", "장애", "의료",
    ),
    "big_five": (
        "openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism", "big_five", "bigfive",
        "개방성", "성실성", "외향성", "우호성", "신경성",
    ),
    "narrative": (
        "narrative", "story", "bio", "description", "profile", "persona", "서사", "스토리", "소개", "설명",
    ),
    "sensitive_or_identifying": (
        "name", "address", "street", "postcode", "unit", "city", "phone", "mobile", "email", "contact", "resident",
        "이름", "성명", "주소", "상세주소", "전화", "휴대폰", "연락처", "이메일", "주민",
    ),
}
ID_CATEGORY = "persona_id"
PRIVACY_CATEGORY = "sensitive_or_identifying"
MASK_TEXT = "***MASKED***"

# --- fixed values: response model ---------------------------------------------------------------------------------

STANCES = ("support", "neutral", "oppose")
QUESTION_TYPES = ("ORIGINAL", "SAME_QUESTION_REPEAT", "FOLLOW_UP_LIMITED")
VARIANT_LABELS = ("A", "B", "C")
RESPONSE_STATUSES = ("success", "error")
REVIEW_STATUSES = ("not_reviewed", "reviewed")
RELATIONS = ("SAME_QUESTION_REPEAT", "FOLLOW_UP_LIMITED")
GENERATION_ERROR = "ResponseGenerationError"

# Question types whose wording or setting differs from the original, so that a changed answer has a stated reason.
CHANGED_CONDITION_TYPES = ("FRAMING_CHANGE", "CONTEXT_CHANGE", "SOCIAL_PRESSURE")

# Required metadata of each question-variant type.
VARIANT_REQUIREMENTS = {
    "ORIGINAL": ("base_question_id", "base_question_text"),
    "SAME_QUESTION_REPEAT": ("original_question_id", "repeat_index"),
    "PARAPHRASE": ("original_question_id", "paraphrase_text", "meaning_preservation_rule"),
    "FRAMING_CHANGE": ("frame_label", "framing_direction", "modified_text"),
    "CONTEXT_CHANGE": ("context_payload", "source"),
    "SOCIAL_PRESSURE": ("pressure_source", "pressure_level", "pressure_text"),
    "MODEL_CONDITION_CHANGE": ("model_condition_id", "model_label", "generation_metadata"),
}

# Metrics that need a model or vectors and are therefore reported as not computed.
UNCOMPUTED_METRICS = {
    "semantic_similarity": "needs vectors of the answers",
    "nli_contradiction": "needs an inference model",
    "llm_judge_contradiction": "needs a judging model",
    "llm_judge_reason_retention": "needs a judging model",
}

ID_PATTERNS = {
    "project_id": r"^project_[a-z0-9._-]+$",
    "cohort_id": r"^cohort_[A-Za-z0-9._-]+$",
    "scenario_id": r"^scenario_[A-Za-z0-9._-]+$",
    "question_set_id": r"^question_set_[A-Za-z0-9._-]+$",
    "question_id": r"^question_[A-Za-z0-9._-]+$",
    "run_id": r"^run_[A-Za-z0-9._-]+$",
    "response_id": r"^response_[A-Za-z0-9._-]+$",
    "comparison_id": r"^comparison_[A-Za-z0-9._-]+$",
    "follow_up_id": r"^follow_up_[A-Za-z0-9._-]+$",
}

# --- fixed values: profile report ----------------------------------------------------------------------------------

PROFILE_CATEGORICALS = (
    "sex", "region", "district", "marital_status", "education_level", "bachelors_field", "occupation",
    "family_type", "housing_type", "housing_tenure", "military_status", "economic_activity_status",
    "income_bracket", *HEALTH_COLUMNS,
)
SELECTABLE_LIMIT = 100
NOTE_ORDERED = "Review value order before using as an ordered cohort filter."
NOTE_TOO_MANY = "Too many distinct values for direct select UI; normalize or search."
NOTE_SELECTABLE = "Suitable for direct filter UI after research-team label review."
