"""Contexts, response expansion and run bookkeeping over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.hashing import choose, digest_byte
from cohortry.operators import cohort, context, design, responses
from cohortry.plans.cohorts import SAMPLE, SAMPLE_SQL, TARGET
from cohortry.plans.registry import query
from cohortry.plans.tables import (
    BOTH_RUNS_SQL, DOCUMENTS, DOCUMENTS_SQL, PANEL_SQL, PEOPLE, PEOPLE_SQL, PRESSURE, RUN, both_runs, byte_sql,
    cells_sql, choose_sql, documents, matrix_cells, panel, panel_cells, panel_nested, people, table,
)


@query("context_level1", f"""WITH {PEOPLE_SQL}, {SAMPLE_SQL}
    SELECT sample_rank, c_custkey AS persona_id, r_name, n_name, c_mktsegment FROM sample JOIN people USING (c_custkey)""")
def context_level1(spark, d) -> DataFrame:
    rows = people(spark, d)
    return context.build_context(rows, PEOPLE, "P1", cohort.draw_sample(rows, TARGET, SAMPLE))


@query("context_level2", f"WITH {PEOPLE_SQL} SELECT c_custkey AS persona_id, r_name, n_name, c_mktsegment, c_acctbal FROM people")
def context_level2(spark, d) -> DataFrame:
    return context.build_context(people(spark, d), PEOPLE, "P2")


@query("context_level3", f"""WITH {DOCUMENTS_SQL}
    SELECT doc_id AS persona_id, lang, source, n_chars, quality, toxic,
      concat_ws(';', 'text=' || md5(text), 'quality_note=' || md5(quality_note), 'toxic_note=' || md5(toxic_note)) AS narratives
    FROM docs""")
def context_level3(spark, d) -> DataFrame:
    rows = context.build_context(documents(spark, d), DOCUMENTS, "P3")
    shown = F.transform("narratives", lambda n: F.concat(n["field_name"], F.lit("="), F.md5(n["text"])))
    return rows.withColumn("narratives", F.array_join(shown, ";"))


@query("narratives_long", f"""WITH {DOCUMENTS_SQL}
    SELECT doc_id AS persona_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS position, field_name,
      md5(text) AS text_md5, length(text)::INTEGER AS text_length
    FROM (SELECT doc_id, 0 AS p, 'text' AS field_name, text FROM docs
          UNION ALL SELECT doc_id, 1, 'quality_note', quality_note FROM docs
          UNION ALL SELECT doc_id, 2, 'toxic_note', toxic_note FROM docs) WHERE text IS NOT NULL""")
def narratives_long(spark, d) -> DataFrame:
    long = context.narratives_long(documents(spark, d), "doc_id", DOCUMENTS.narratives)
    return long.select("persona_id", "position", "field_name", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"))


@query("response_matrix", f"""WITH {PEOPLE_SQL}, {cells_sql()}
    SELECT run_id, agent_id, question_id, question_type, repeat_of_question_id, repeat_index, response_id FROM cells""")
def response_matrix(spark, d) -> DataFrame:
    return matrix_cells(spark, d).select(
        "run_id", "agent_id", "question_id", "question_type", "repeat_of_question_id", "repeat_index", "response_id"
    )


def _order_byte(i: int) -> Column:
    return digest_byte(F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("|arms")), 256), i)


_OB = [byte_sql("sha256(o_orderkey || '|arms')", i) for i in range(2)]


@query("hash_assignment", f"""
    SELECT o_orderkey, {choose_sql(('A', 'B', 'C'), _OB[0])} AS arm, {_OB[1]} % 5 AS fold FROM orders""")
def hash_assignment(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", choose(("A", "B", "C"), _order_byte(0)).alias("arm"), (_order_byte(1) % 5).cast("int").alias("fold")
    )


_PANEL_COLUMNS = ("response_id", "agent_id", "question_id", "repeat_index", "stance", "stance_score", "response_text", "status",
                  "error_type")


@query("response_matrix_scored", f"WITH {PANEL_SQL} SELECT {', '.join(_PANEL_COLUMNS)} FROM panel")
def response_matrix_scored(spark, d) -> DataFrame:
    return panel(spark, d).select(*_PANEL_COLUMNS)


@query("response_errors", f"""WITH {PANEL_SQL} SELECT project_id, run_id, status, error_type, count(*) AS n FROM panel GROUP BY ALL""")
def response_errors(spark, d) -> DataFrame:
    return responses.error_counts(panel(spark, d))


def price_model(cell: dict) -> tuple[str, dict]:
    """A user's generator: refuses negative balances and rates the rest by size; unrated people have no balance."""
    if cell["c_acctbal"] is None or cell["c_acctbal"] < 0:
        raise ValueError("negative balance")
    if cell["rank"] is not None and not isinstance(cell["rank"], int):
        raise TypeError("an integer became something else")
    stance = "support" if cell["c_acctbal"] >= 5000 else "neutral" if cell["c_acctbal"] >= 1000 else "oppose"
    score = {"support": 5, "neutral": 3, "oppose": 1}[stance]
    answer = {"stance": stance, "stance_score": score, "reasoning_summary": "balance", "concerns": [], "acceptance_conditions": []}
    return f"{stance} from {cell['r_name']}", answer


@query("generated_responses", f"""WITH {PEOPLE_SQL}, {cells_sql()}
    SELECT response_id, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'success' END AS status,
      CASE WHEN c_acctbal < 0 THEN 'ValueError' END AS error_type,
      CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal >= 5000 THEN 'support' WHEN c_acctbal >= 1000 THEN 'neutral' ELSE 'oppose' END AS stance,
      CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal >= 5000 THEN 5 WHEN c_acctbal >= 1000 THEN 3 ELSE 1 END AS stance_score,
      CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal >= 5000 THEN 'support' WHEN c_acctbal >= 1000 THEN 'neutral' ELSE 'oppose' END
        || ' from ' || r_name AS response_text
    FROM cells""")
def generated_responses(spark, d) -> DataFrame:
    # the rank is NULL for a part of the people
    rank = F.when(F.col("agent_id") % 3 == 0, F.col("agent_id"))
    cells = matrix_cells(spark, d).select("response_id", "r_name", "c_acctbal", rank.alias("rank"))
    filled = responses.generate_responses(cells, price_model, (ValueError,))
    return filled.select(
        "response_id", "status", "error_type", "structured_response.stance", "structured_response.stance_score", "response_text"
    )


@query("response_trace", f"""WITH {BOTH_RUNS_SQL}
    SELECT response_id, run_id, CASE run_id WHEN 'run_001' THEN 'P2' ELSE 'P1' END AS persona_context_level,
      CASE run_id WHEN 'run_001' THEN 'Market reform' ELSE 'Reform under pressure' END AS title, question_text, stance, r_name, n_name, c_mktsegment
    FROM both_runs""")
def response_trace(spark, d) -> DataFrame:
    asked = both_runs(spark, d)
    rows = asked.select("response_id", "project_id", "run_id", "scenario_id", "agent_id", "question_id", "stance")
    runs = spark.createDataFrame([(r.project_id, r.run_id, r.question_set_id, r.context_level) for r in (RUN, PRESSURE)],
                                 "project_id string, run_id string, question_set_id string, persona_context_level string")
    scenarios = spark.createDataFrame([(RUN.project_id, RUN.scenario_id, "Market reform"), (RUN.project_id, PRESSURE.scenario_id, "Reform under pressure")],
                                      "project_id string, scenario_id string, title string")
    questions = asked.select("project_id", F.lit(RUN.question_set_id).alias("question_set_id"), "question_id", "question_text").distinct()
    contexts = context.build_context(people(spark, d), PEOPLE, "P1")
    traced = responses.trace_responses(rows, runs, scenarios, questions, contexts)
    return traced.select(
        "response_id", "run_id", "persona_context_level", "title", "question_text", "stance", "r_name", "n_name", "c_mktsegment"
    )


@query("retry_set", f"""WITH {PANEL_SQL}
    SELECT project_id, run_id, agent_id, question_id, repeat_index, response_id FROM panel WHERE status <> 'success'
    UNION ALL SELECT 'project_other', run_id, agent_id, question_id, repeat_index, response_id FROM panel""")
def retry_set(spark, d) -> DataFrame:
    # a second project asks the same and has no answers yet: those of the first don't count for it
    cells = panel_cells(spark, d)
    return responses.retry_set(cells.union(cells.withColumn("project_id", F.lit("project_other"))), panel(spark, d))


def turn_questions(spark, d) -> DataFrame:
    """Conversations as question sets: a later user turn repeats the question two turns before it."""
    turns = table(spark, d, "conversations")
    name = lambda turn: F.concat(F.lit("question_"), F.col("conv_id"), F.lit("_"), turn)
    repeat = (F.col("role") == "user") & (F.col("turn") >= 2)
    return turns.select(
        F.concat(F.lit("question_set_"), "conv_id").alias("question_set_id"),
        name(F.col("turn")).alias("question_id"),
        F.when(repeat, "SAME_QUESTION_REPEAT").otherwise("ORIGINAL").alias("question_type"),
        F.when(repeat, name(F.col("turn") - 2)).alias("repeat_of_question_id"),
        "text",
    )


TURNS_SQL = """turn_questions AS (
  SELECT 'question_set_' || conv_id AS question_set_id, 'question_' || conv_id || '_' || turn AS question_id,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'SAME_QUESTION_REPEAT' ELSE 'ORIGINAL' END AS question_type,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'question_' || conv_id || '_' || (turn - 2) END AS repeat_of_question_id, text
  FROM conversations)"""


@query("repeat_count", f"""WITH {TURNS_SQL}
    SELECT question_set_id, CASE WHEN bool_or(question_type = 'SAME_QUESTION_REPEAT') THEN 2 ELSE 1 END AS repeat_count
    FROM turn_questions GROUP BY question_set_id""")
def repeat_count(spark, d) -> DataFrame:
    return responses.repeat_count(turn_questions(spark, d))


@query("run_summary", f"""WITH {PANEL_SQL}
    SELECT project_id, run_id, count(*) AS planned, count(*) AS stored, count(*) FILTER (WHERE status = 'success') AS succeeded,
      count(*) FILTER (WHERE status <> 'success') AS failed, count(DISTINCT error_type) AS error_types FROM panel GROUP BY project_id, run_id""")
def run_summary(spark, d) -> DataFrame:
    return responses.run_summary(panel_cells(spark, d), panel_nested(spark, d))


TEMPLATE = "You live in {nation} ({region}) and work in {segment}. Balance: {balance}."


@query("prompt_text", f"""WITH {PEOPLE_SQL}
    SELECT c_custkey, 'You live in ' || n_name || ' (' || r_name || ') and work in ' || c_mktsegment || '. Balance: '
      || c_acctbal::DECIMAL(18,2)::VARCHAR || '.' AS prompt FROM people""")
def prompt_text(spark, d) -> DataFrame:
    fields = {
        "nation": F.col("n_name"), "region": F.col("r_name"), "segment": F.col("c_mktsegment"),
        "balance": F.col("c_acctbal").cast("decimal(18,2)"),
    }
    return people(spark, d).select("c_custkey", design.prompt_text(TEMPLATE, fields).alias("prompt"))


@query("split_spec", """
    WITH specs AS (SELECT p_partkey, p_type || '|' || p_name || '|' || p_brand AS spec FROM part)
    SELECT p_partkey, split_part(spec, '|', 1) AS variant_label, substr(spec, instr(spec, '|') + 1) AS variant_text,
      CASE WHEN split_part(spec, '|', 1) NOT IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'unsupported variant label' END AS problem FROM specs""")
def split_spec(spark, d) -> DataFrame:
    specs = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_type", "p_name", "p_brand").alias("spec"))
    return design.split_variant_spec(specs, "spec", ("SMALL", "MEDIUM", "LARGE")).drop("spec")


@query("split_question_spec", """
    WITH specs AS (SELECT p_partkey, 'question_' || p_partkey || '|' ||
      CASE WHEN p_size <= 20 THEN 'ORIGINAL|' || p_name WHEN p_size <= 40 THEN 'SAME_QUESTION_REPEAT|' || p_name || '|question_0'
           WHEN p_size <= 45 THEN 'FOLLOW_UP_LIMITED|' || p_name ELSE p_type END AS spec FROM part)
    SELECT p_partkey, split_part(spec, '|', 1) AS question_id, nullif(split_part(spec, '|', 2), '') AS question_type,
      nullif(split_part(spec, '|', 3), '') AS question_text, nullif(split_part(spec, '|', 4), '') AS repeat_of_question_id,
      CASE WHEN len(string_split(spec, '|')) NOT IN (3, 4) THEN 'questions must use id|TYPE|TEXT or id|TYPE|TEXT|repeat_of'
           WHEN split_part(spec, '|', 2) NOT IN ('ORIGINAL', 'SAME_QUESTION_REPEAT') THEN 'unsupported question type' END AS problem
    FROM specs""")
def split_question_spec(spark, d) -> DataFrame:
    size = F.col("p_size")
    rest = (
        F.when(size <= 20, F.concat(F.lit("ORIGINAL|"), "p_name"))
        .when(size <= 40, F.concat(F.lit("SAME_QUESTION_REPEAT|"), "p_name", F.lit("|question_0")))
        .when(size <= 45, F.concat(F.lit("FOLLOW_UP_LIMITED|"), "p_name"))
        .otherwise(F.col("p_type"))
    )
    specs = table(spark, d, "part").select("p_partkey", F.concat(F.lit("question_"), "p_partkey", F.lit("|"), rest).alias("spec"))
    return design.split_question_spec(specs, "spec").drop("spec")

