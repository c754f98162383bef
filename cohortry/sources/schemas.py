"""Schemas of the stored experiment records, as DDL text."""

from __future__ import annotations

CORRUPT = "_corrupt_record"

GENERATION_CONFIG = "struct<model:string,temperature:double,prompt_version:string>"
STRUCTURED_RESPONSE = (
    "struct<stance:string,stance_score:int,reasoning_summary:string,concerns:array<string>,"
    "acceptance_conditions:array<string>>"
)

PROJECT = "project_id string, name string, research_goal string, non_claim string, created_at timestamp"
SCENARIO = (
    "project_id string, scenario_id string, title string, "
    "variants array<struct<variant_id:string,label:string,text:string>>, created_at timestamp"
)
QUESTION_SET = (
    "project_id string, question_set_id string, name string, "
    "questions array<struct<question_id:string,question_text:string,question_type:string,repeat_of_question_id:string>>, "
    "created_at timestamp"
)
RUN = (
    "project_id string, run_id string, cohort_id string, scenario_id string, question_set_id string, "
    f"persona_context_level string, generation_config {GENERATION_CONFIG}, seed bigint, repeat_count int, "
    "created_at timestamp"
)
RESPONSE = (
    "project_id string, cohort_id string, agent_id string, scenario_id string, question_id string, run_id string, "
    "response_id string, repeat_index int, question_type string, response_text string, "
    f"structured_response {STRUCTURED_RESPONSE}, generation_config {GENERATION_CONFIG}, status string, "
    "error_type string, created_at timestamp"
)
RESPONSE_COLUMNS = (
    "project_id", "cohort_id", "agent_id", "scenario_id", "question_id", "run_id", "response_id", "repeat_index",
    "question_type", "response_text", "structured_response", "generation_config", "status", "error_type", "created_at",
)
COMPARISON = (
    "comparison_id string, project_id string, run_id string, agent_id string, response_a_id string, "
    "response_b_id string, question_relation string, "
    "automatic_evaluation struct<stance_match:boolean,stance_score_delta:int,contradiction_candidate:boolean,"
    "needs_human_review:boolean>, "
    "human_evaluation struct<review_status:string,stance_consistency:string,contradiction:string,"
    "justified_change:string,reviewer_confidence:string>, created_at timestamp"
)
FOLLOW_UP = (
    "follow_up_id string, project_id string, run_id string, parent_response_id string, agent_id string, "
    "question_id string, question_text string, response_id string, created_at timestamp"
)
COHORT = (
    "cohort_id string, name string, source struct<path:string,sha256:string,fingerprint:string,row_count:bigint>, "
    "filters map<string,string>, canonical_filter_json string, filter_hash string, human_readable_filter string, "
    "matching_count bigint, sampling struct<sample_size:bigint,seed:bigint,method:string>, "
    "sampled bigint, sample_path string, created_at timestamp"
)

RECORDS = {
    "project": PROJECT,
    "scenario": SCENARIO,
    "question_set": QUESTION_SET,
    "run": RUN,
    "comparison": COMPARISON,
    "follow_up": FOLLOW_UP,
    "cohort": COHORT,
}
