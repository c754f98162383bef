"""Persona x question expansion, pluggable generators and run bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortry.functions.hashing import digest_id
from cohortry.spec import Question, Run, require_questions

# the natural key of a response; a run id is unique inside its project only
RESPONSE_KEY = ("project_id", "run_id", "agent_id", "question_id", "repeat_index")
# the parts of the displayed response id, whose format is given; it is short, so nothing joins on it
ID_PARTS = ("run_id", "agent_id", "question_id", "repeat_index")

STRUCTURED = T.StructType(
    [
        T.StructField("stance", T.StringType()),
        T.StructField("stance_score", T.IntegerType()),
        T.StructField("reasoning_summary", T.StringType()),
        T.StructField("concerns", T.ArrayType(T.StringType())),
        T.StructField("acceptance_conditions", T.ArrayType(T.StringType())),
    ]
)


def repeat_index(question_type: Column) -> Column:
    """0 for an original, 1 for its repeat; any other type fails the query."""
    return (
        F.when(question_type == "ORIGINAL", F.lit(0))
        .when(question_type == "SAME_QUESTION_REPEAT", F.lit(1))
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported question type: "), question_type)).cast("int"))
    )


def expand_questions(contexts: DataFrame, questions: Sequence[Question]) -> DataFrame:
    """One row per context and question.

    The question set is a parameter, so it travels as one literal array that is exploded in place: no join, no shuffle.
    """
    require_questions(questions)
    entries = [
        F.struct(
            F.lit(q.question_id).alias("question_id"),
            F.lit(q.question_text).alias("question_text"),
            F.lit(q.question_type).alias("question_type"),
            F.lit(q.repeat_of_question_id).cast("string").alias("repeat_of_question_id"),
        )
        for q in questions
    ]
    rows = contexts.select("*", F.inline(F.array(*entries)))
    return rows.withColumn("repeat_index", repeat_index(F.col("question_type")))


def plan_responses(contexts: DataFrame, questions: Sequence[Question], run: Run) -> DataFrame:
    """The planned response cells of a run whose questions are given as plain objects."""
    return plan_cells(expand_questions(contexts, questions), run)


def plan_cells(expanded: DataFrame, run: Run) -> DataFrame:
    """The planned response cells of a run: context, question, run settings and the stable response id."""
    cells = expanded.withColumnRenamed("persona_id", "agent_id")
    settings = F.struct(
        F.lit(run.model).alias("model"),
        F.lit(run.temperature).alias("temperature"),
        F.lit(run.prompt_version).alias("prompt_version"),
    )
    return (
        cells.withColumn("project_id", F.lit(run.project_id))
        .withColumn("cohort_id", F.lit(run.cohort_id))
        .withColumn("scenario_id", F.lit(run.scenario_id))
        .withColumn("run_id", F.lit(run.run_id))
        .withColumn("generation_config", settings)
        .withColumn("response_id", digest_id("response_", 12, *[F.col(c) for c in ID_PARTS]))
    )


def nest_responses(flat: DataFrame) -> DataFrame:
    """Answer columns as the stored ``structured_response`` struct; rows without an answer get NULL."""
    names = STRUCTURED.fieldNames()
    return flat.withColumn("structured_response", F.when(F.col("stance").isNotNull(), F.struct(*names))).drop(*names)


def expand_question_table(contexts: DataFrame, questions: DataFrame, question_set_id: str) -> DataFrame:
    """One row per context and question of a stored question set of any size.

    The set's questions become one array by a scalar subquery, which is exploded in place: no join, no shuffle of contexts.
    """
    mine = questions.where(F.col("question_set_id") == question_set_id)
    entry = F.struct("question_id", "question_text", "question_type", "repeat_of_question_id")
    entries = mine.agg(F.array_sort(F.collect_list(entry))).scalar()
    rows = contexts.withColumn("_questions", entries).select("*", F.inline("_questions")).drop("_questions")
    return rows.withColumn("repeat_index", repeat_index(F.col("question_type")))


class ResponseGenerationError(Exception):
    """An answer that could not be generated; generators raise it or a subclass."""


def generate_responses(
    cells: DataFrame,
    generator: Callable[[dict], tuple[str, dict]],
    failures: tuple[type[Exception], ...] = (ResponseGenerationError,),
) -> DataFrame:
    """Fill planned cells with a user's function, batch by batch.

    ``generator`` gets one cell as a dict (NULL is None) and returns ``(response_text, structured_response dict)``. One of
    the ``failures`` turns that row into an error row named after the exception, and so does an answer without text or
    structure; the run goes on. Any other exception is a fault of the program and ends the run. A lost task runs its cells
    again, so write the result of a generator that is costly or not repeatable before using it twice.
    """
    added = [
        T.StructField("response_text", T.StringType()),
        T.StructField("structured_response", STRUCTURED),
        T.StructField("status", T.StringType()),
        T.StructField("error_type", T.StringType()),
    ]
    schema = T.StructType([*cells.schema.fields, *added])
    kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in added]

    # by name: a class that travels to a worker by value is another object there than one that is imported
    names = {c.__name__ for c in failures}

    def answer(cell: dict) -> tuple:
        try:
            text, structured = generator(cell)
        except Exception as error:
            if not names.intersection(c.__name__ for c in type(error).__mro__):
                raise
            return None, None, "error", type(error).__name__  # one bad cell must not end the run
        if not text or not structured:
            return None, None, "error", "EmptyResponseError"
        return text, structured, "success", None

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            answers = [answer(cell) for cell in batch.to_pylist()]
            columns = [pa.array([a[i] for a in answers], field.type) for i, field in enumerate(kinds)]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in kinds)])

    return cells.mapInArrow(batches, schema)


def retry_set(cells: DataFrame, responses: DataFrame) -> DataFrame:
    """Planned cells that have no successful response yet."""
    done = responses.where(F.col("status") == "success").select(*RESPONSE_KEY)
    return cells.join(done, list(RESPONSE_KEY), "left_anti")


def repeat_count(questions: DataFrame, set_column: str = "question_set_id") -> DataFrame:
    """Per question set: 2 when it holds a repeat question, else 1."""
    repeated = F.max((F.col("question_type") == "SAME_QUESTION_REPEAT").cast("int"))
    return questions.groupBy(set_column).agg((repeated + 1).alias("repeat_count"))


def run_summary(cells: DataFrame, responses: DataFrame) -> DataFrame:
    """Per project and run: planned and stored rows, successes, errors and distinct error types, from one aggregation."""
    planned = cells.select("project_id", "run_id", F.lit(1).alias("planned"), *[F.lit(None).cast("string").alias(c) for c in ("status", "error_type")])
    stored = responses.select("project_id", "run_id", F.lit(0).alias("planned"), "status", "error_type")
    status = F.col("status")
    return planned.unionByName(stored).groupBy("project_id", "run_id").agg(
        F.sum("planned").alias("planned"),
        F.count("status").alias("stored"),
        F.count_if(status == "success").alias("succeeded"),
        F.count_if(status != "success").alias("failed"),
        F.count_distinct("error_type").alias("error_types"),
    )


def error_counts(responses: DataFrame) -> DataFrame:
    """Rows per project, run, status and error type."""
    return responses.groupBy("project_id", "run_id", "status", "error_type").agg(F.count("*").alias("n"))


def trace_responses(
    responses: DataFrame, runs: DataFrame, scenarios: DataFrame, questions: DataFrame, contexts: DataFrame
) -> DataFrame:
    """Each response with its run, scenario, question and agent context.

    Runs (with their question_set_id), scenarios and questions are keyed within their project, questions within their set
    as well. Spark broadcasts record tables of few bytes; hot keys of the other joins are split by adaptive execution.
    """
    traced = responses
    for records, keys in (
        (runs, ["project_id", "run_id"]), (scenarios, ["project_id", "scenario_id"]),
        (questions, ["project_id", "question_set_id", "question_id"]),
    ):
        traced = traced.join(records, keys, "left")
    return traced.join(contexts.withColumnRenamed("persona_id", "agent_id"), ["agent_id"], "left")
