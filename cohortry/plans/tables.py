"""Roles that the given tables play, as DataFrames and as SQL ``WITH`` parts for the twins.

people     customer with its nation and region: the entity table
panel      orders of two periods: the response table
clicks     events as responses: agent = user, stance by event type, score in the JSON text
documents  long texts with labels: narratives and raters
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry import vocab
from cohortry.functions.hashing import choose, digest_byte, digest_id
from cohortry.functions.json_fields import json_integer
from cohortry.operators import compare, responses
from cohortry.spec import Question, Run, TableSpec


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def r6(column: Column) -> Column:
    """Ratio rounded for comparison."""
    return F.round(column, 6)


# --- people ----------------------------------------------------------------------------------------------------------

PEOPLE = TableSpec(
    id_column="c_custkey",
    range_column="c_acctbal",
    list_fields={"regions": "r_name", "nations": "n_name", "segments": "c_mktsegment"},
    search_column="c_name",
    vocabularies={"c_mktsegment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
    base_context=("c_custkey", "r_name", "n_name", "c_mktsegment"),
    extended_context=("c_acctbal",),
    preview=("c_custkey", "r_name", "n_name", "c_mktsegment", "c_acctbal"),
)


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers with nation and region names; Spark broadcasts the two dimension tables when they are small."""
    nations = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name", "r_name"
    )


PEOPLE_SQL = """people AS (
  SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PARTS = TableSpec(
    id_column="p_partkey", range_column="p_size", list_fields={"brands": "p_brand", "types": "p_type"},
    search_column="p_name",
)
EVENTS = TableSpec(id_column="event_id", range_column="value", trait_columns=("props", "trait"), score_key="k")
DOCUMENTS = TableSpec(
    id_column="doc_id",
    base_context=("doc_id", "lang", "source"),
    extended_context=("n_chars", "quality", "toxic"),
    narratives=("text", "quality_note", "toxic_note"),
)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels, if any, and two short notes derived from them."""
    labelled = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return labelled.withColumn("quality_note", F.when(F.col("quality") == 1, "kept for quality")).withColumn(
        "toxic_note", F.when(F.col("toxic") == 1, "flagged as toxic")
    )


DOCUMENTS_SQL = """docs AS (
  SELECT d.*, l.quality, l.toxic,
         CASE WHEN l.quality = 1 THEN 'kept for quality' END AS quality_note,
         CASE WHEN l.toxic = 1 THEN 'flagged as toxic' END AS toxic_note
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

# --- panel -----------------------------------------------------------------------------------------------------------

QUESTIONS = (
    Question("question_price", "Is the price change acceptable?"),
    Question("question_price_again", "Is the price change acceptable?", "SAME_QUESTION_REPEAT", "question_price"),
    Question("question_service", "Is the new service useful?"),
    Question("question_service_again", "Is the new service useful?", "SAME_QUESTION_REPEAT", "question_service"),
)
RUN = Run("project_panel", "run_001", "cohort_all", "scenario_market", "question_set_main", seed=7)


def matrix_cells(spark: SparkSession, d: str, run: Run = RUN) -> DataFrame:
    """Planned cells: every person x every question."""
    return responses.plan_responses(people(spark, d).withColumnRenamed("c_custkey", "persona_id"), QUESTIONS, run)


def byte_sql(digest: str, index: int) -> str:
    return f"('0x' || substr({digest}, {2 * index + 1}, 2))::INTEGER"


def choose_sql(values, number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{number} % {len(values)} + 1]"


_QUESTION_ROWS = ",\n    ".join(
    f"('{q.question_id}', '{q.question_text}', '{q.question_type}', "
    + (f"'{q.repeat_of_question_id}'" if q.repeat_of_question_id else "NULL") + ")"
    for q in QUESTIONS
)


def cells_sql(run: Run = RUN, name: str = "cells") -> str:
    return f"""{name} AS (
  SELECT '{run.project_id}' AS project_id, '{run.run_id}' AS run_id, c_custkey AS agent_id, p.* EXCLUDE (c_custkey), q.*,
         CASE q.question_type WHEN 'ORIGINAL' THEN 0 ELSE 1 END AS repeat_index,
         'response_' || substr(sha256('{run.run_id}|' || c_custkey || '|' || q.question_id || '|'
           || CASE q.question_type WHEN 'ORIGINAL' THEN 0 ELSE 1 END), 1, 12) AS response_id
  FROM people p CROSS JOIN (VALUES
    {_QUESTION_ROWS}) q(question_id, question_text, question_type, repeat_of_question_id))"""


# the same questions in later orders, asked under another condition
PRESSURE = Run("project_panel", "run_002", "cohort_all", "scenario_pressure", "question_set_main", seed=8, context_level="P1")
LATER = "1998-04-17"
STATUS_STANCES = {"F": "support", "O": "neutral", "P": "oppose"}


def both_runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as responses: the agent is the customer, the question is the priority, and of the orders that a customer
    places with one priority the second, fourth and so on repeat the one before.

    Orders before and after a date are two runs. The order's status is the stance, its price the score, the flags and the
    states of its lines the named items. Customers with a negative balance give no answer.
    """
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("concerns"), F.array_sort(F.collect_set("l_linestatus")).alias("conditions"))
    first = F.col("o_orderdate") < F.lit(LATER).cast("timestamp_ntz")
    placed = table(spark, d, "orders").withColumn("run_id", F.when(first, RUN.run_id).otherwise(PRESSURE.run_id))
    of_priority = Window.partitionBy("o_custkey", "o_orderpriority", "run_id").orderBy("o_orderdate", "o_orderkey")
    asked = placed.withColumn("turn", F.row_number().over(of_priority) - 1).withColumn("repeat_index", F.col("turn") % 2)
    topic = F.concat(F.lit("question_"), F.substring("o_orderpriority", 1, 1), F.lit("_"), F.floor(F.col("turn") / 2).cast("string"))
    again, ok = F.col("repeat_index") == 1, F.col("c_acctbal") >= 0
    items = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("concerns", "conditions")}
    status = F.col("o_orderstatus")
    stance = F.coalesce(*[F.when(status == s, F.lit(v)) for s, v in STATUS_STANCES.items()])
    question_type = F.when(again, "SAME_QUESTION_REPEAT").otherwise("ORIGINAL")
    text = F.concat(status, F.lit(": "), F.array_join(items["concerns"], ", "), F.lit(" / "), F.array_join(items["conditions"], ", "))
    rows = asked.join(people(spark, d), F.col("o_custkey") == F.col("c_custkey")).join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    named = rows.select(
        F.lit(RUN.project_id).alias("project_id"), F.lit(RUN.cohort_id).alias("cohort_id"), "run_id",
        F.when(F.col("run_id") == RUN.run_id, RUN.scenario_id).otherwise(PRESSURE.scenario_id).alias("scenario_id"),
        F.when(F.col("run_id") == RUN.run_id, "ORIGINAL").otherwise("SOCIAL_PRESSURE").alias("condition"),
        F.col("o_custkey").alias("agent_id"), "r_name", "n_name", "c_mktsegment", "c_acctbal",
        F.when(again, F.concat(topic, F.lit("_again"))).otherwise(topic).alias("question_id"),
        F.concat(F.lit("How did the "), "o_orderpriority", F.lit(" order go?")).alias("question_text"),
        question_type.alias("question_type"), F.when(again, topic).alias("repeat_of_question_id"), "repeat_index",
        F.when(ok, stance).alias("stance"),
        F.when(ok, F.least(F.lit(5), 1 + F.floor(F.col("o_totalprice") / 100_000))).cast("int").alias("stance_score"),
        F.when(ok, items["concerns"]).alias("concerns"), F.when(ok, items["conditions"]).alias("acceptance_conditions"),
        F.when(ok, F.concat_ws(" ", "r_name", "c_mktsegment", question_type)).alias("reasoning_summary"),
        F.when(ok, text).alias("response_text"), F.when(ok, "success").otherwise("error").alias("status"),
        F.when(~ok, vocab.GENERATION_ERROR).alias("error_type"),
    )
    return named.withColumn("response_id", digest_id("response_", 12, *[F.col(c) for c in responses.ID_PARTS]))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """The first run, with flat answer columns and error rows."""
    return both_runs(spark, d).where(F.col("run_id") == RUN.run_id)


def panel_cells(spark: SparkSession, d: str) -> DataFrame:
    """What was asked in the first run, answered or not."""
    return panel(spark, d).select(*responses.RESPONSE_KEY, "response_id")


def panel_nested(spark: SparkSession, d: str) -> DataFrame:
    """The first run with nested payload and error rows."""
    return responses.nest_responses(panel(spark, d))


_STANCE_SQL = "CASE o_orderstatus " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in STATUS_STANCES.items()) + " END"
BOTH_RUNS_SQL = f"""{PEOPLE_SQL},
flags AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS concerns0, list_sort(list_distinct(list(l_linestatus))) AS conditions0
  FROM lineitem GROUP BY l_orderkey),
placed AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '{LATER}' THEN '{RUN.run_id}' ELSE '{PRESSURE.run_id}' END AS run_id FROM orders),
turns AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey, o_orderpriority, run_id ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER AS turn
  FROM placed),
asked AS (SELECT *, 'question_' || substr(o_orderpriority, 1, 1) || '_' || (turn // 2) AS topic, turn % 2 AS repeat_index FROM turns),
worded AS (
  SELECT '{RUN.project_id}' AS project_id, run_id, CASE run_id WHEN '{RUN.run_id}' THEN 'ORIGINAL' ELSE 'SOCIAL_PRESSURE' END AS condition,
         o_custkey AS agent_id, r_name, n_name, c_mktsegment, c_acctbal, repeat_index, o_orderstatus, o_totalprice,
         CASE repeat_index WHEN 1 THEN topic || '_again' ELSE topic END AS question_id,
         'How did the ' || o_orderpriority || ' order go?' AS question_text,
         CASE repeat_index WHEN 1 THEN 'SAME_QUESTION_REPEAT' ELSE 'ORIGINAL' END AS question_type,
         CASE repeat_index WHEN 1 THEN topic END AS repeat_of_question_id,
         coalesce(concerns0, []::VARCHAR[]) AS concerns0, coalesce(conditions0, []::VARCHAR[]) AS conditions0
  FROM asked JOIN people ON o_custkey = c_custkey LEFT JOIN flags ON o_orderkey = l_orderkey),
both_runs AS (
  SELECT * EXCLUDE (concerns0, conditions0),
    'response_' || substr(sha256(run_id || '|' || agent_id || '|' || question_id || '|' || repeat_index), 1, 12) AS response_id,
    CASE WHEN c_acctbal >= 0 THEN {_STANCE_SQL} END AS stance,
    CASE WHEN c_acctbal >= 0 THEN least(5, 1 + floor(o_totalprice / 100000))::INTEGER END AS stance_score,
    CASE WHEN c_acctbal >= 0 THEN concerns0 END AS concerns,
    CASE WHEN c_acctbal >= 0 THEN conditions0 END AS acceptance_conditions,
    CASE WHEN c_acctbal >= 0 THEN r_name || ' ' || c_mktsegment || ' ' || question_type END AS reasoning_summary,
    CASE WHEN c_acctbal >= 0 THEN o_orderstatus || ': ' || coalesce(array_to_string(concerns0, ', '), '') || ' / '
      || coalesce(array_to_string(conditions0, ', '), '') END AS response_text,
    CASE WHEN c_acctbal >= 0 THEN 'success' ELSE 'error' END AS status,
    CASE WHEN c_acctbal < 0 THEN '{vocab.GENERATION_ERROR}' END AS error_type
  FROM worded)"""
PANEL_SQL = f"""{BOTH_RUNS_SQL},
panel AS (SELECT * FROM both_runs WHERE run_id = '{RUN.run_id}')"""

PAIRS_SQL = f"""{PANEL_SQL},
pairs AS (
  SELECT a.project_id, a.run_id, a.agent_id, a.question_id AS root_question_id, a.r_name, a.c_mktsegment,
         a.response_id AS response_id_a, b.response_id AS response_id_b,
         a.stance AS stance_a, b.stance AS stance_b, a.stance_score AS stance_score_a, b.stance_score AS stance_score_b,
         a.response_text AS response_text_a, b.response_text AS response_text_b,
         a.concerns AS concerns_a, b.concerns AS concerns_b,
         a.reasoning_summary AS reasoning_summary_a, b.reasoning_summary AS reasoning_summary_b,
         a.acceptance_conditions AS acceptance_conditions_a, b.acceptance_conditions AS acceptance_conditions_b,
         b.question_type AS question_type_b
  FROM panel a JOIN panel b
    ON a.run_id = b.run_id AND a.agent_id = b.agent_id AND b.repeat_of_question_id = a.question_id
  WHERE a.question_type = 'ORIGINAL' AND b.question_type = 'SAME_QUESTION_REPEAT'),
measured AS (
  SELECT *, stance_a = stance_b AS stance_match, stance_score_b - stance_score_a AS stance_score_delta,
         (stance_a = 'support' AND stance_b = 'oppose') OR (stance_a = 'oppose' AND stance_b = 'support') AS contradiction_candidate,
         len(list_intersect(concerns_a, concerns_b))::DOUBLE
           / nullif(len(list_distinct(list_concat(concerns_a, concerns_b))), 0) AS concern_overlap,
         len(list_intersect(acceptance_conditions_a, acceptance_conditions_b))::DOUBLE
           / nullif(len(list_distinct(list_concat(acceptance_conditions_a, acceptance_conditions_b))), 0) AS acceptance_condition_overlap,
         len(list_intersect(string_split(lower(reasoning_summary_a), ' '), string_split(lower(reasoning_summary_b), ' ')))::DOUBLE
           / nullif(len(list_distinct(list_concat(string_split(lower(reasoning_summary_a), ' '), string_split(lower(reasoning_summary_b), ' ')))), 0)
           AS reason_overlap0,
         'comparison_' || substr(sha256(project_id || '|' || run_id || '|' || agent_id || '|' || root_question_id || '|'
           || response_id_a || '|' || response_id_b), 1, 32) AS comparison_id
  FROM pairs),
evaluated AS (
  SELECT * REPLACE (CASE WHEN stance_a IS NULL OR stance_b IS NULL THEN NULL ELSE concern_overlap END AS concern_overlap,
                    CASE WHEN stance_a IS NULL OR stance_b IS NULL THEN NULL ELSE acceptance_condition_overlap END AS acceptance_condition_overlap),
         CASE WHEN stance_a IS NULL OR stance_b IS NULL THEN NULL ELSE reason_overlap0 END AS reason_overlap,
         NOT stance_match OR contradiction_candidate AS needs_human_review
  FROM measured)"""


def panel_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Evaluated repeat pairs of the panel with the agent's region and segment."""
    return compare.evaluate_pairs(compare.repeat_pairs(panel(spark, d), carry=("r_name", "c_mktsegment")))


# --- clicks ----------------------------------------------------------------------------------------------------------

ARMS = ("A", "B", "C")


def stance_of_event(event_type: Column) -> Column:
    """Stance that an event type stands for."""
    return (
        F.when(event_type.isin("purchase", "signup"), "support")
        .when(event_type.isin("view", "click"), "neutral")
        .when(event_type == "error", "oppose")
    )


def arm_of(agent: Column) -> Column:
    """Arm of an agent, read from the first byte of its hash."""
    return choose(ARMS, digest_byte(F.sha2(agent.cast("string"), 256), 0))


def clicks(spark: SparkSession, d: str) -> DataFrame:
    """Events as responses of one long run."""
    events = table(spark, d, "events")
    return events.select(
        F.lit("run_events").alias("run_id"),
        F.col("user_id").alias("agent_id"),
        F.col("event_id").alias("response_id"),
        "event_type",
        stance_of_event(F.col("event_type")).alias("stance"),
        json_integer(F.col("props"), "k").alias("score"),
        arm_of(F.col("user_id")).alias("arm"),
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


CLICKS_SQL = f"""clicks AS (
  SELECT 'run_events' AS run_id, user_id AS agent_id, event_id AS response_id, event_type,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'support' WHEN event_type IN ('view', 'click') THEN 'neutral'
              WHEN event_type = 'error' THEN 'oppose' END AS stance,
         TRY_CAST(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) AS INTEGER) AS score,
         {choose_sql(ARMS, byte_sql("sha256(user_id::VARCHAR)", 0))} AS arm, ts, strftime(ts, '%Y-%m-%d') AS day
  FROM events)"""
