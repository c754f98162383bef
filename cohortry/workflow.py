"""The research steps end to end: inspect, profile, save a cohort, run it, compare it, export it.

Each step reads tables and writes tables. Later steps read what earlier ones wrote, so a lost executor never repeats a
generator and no long lineage builds up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import checks, cohort, compare, context, distributions, inspect, profile, profile_state, responses, review
from cohortry.sources import readers, schemas, store, writers
from cohortry.spec import CohortRequest, Run, TableSpec


def inspect_table(df: DataFrame, out: str, order: Sequence[str], sample_limit: int = 5) -> None:
    """Writes column facts, a masked sample and the table's shape with its fingerprint."""
    writers.write_json(inspect.inspect_columns(df), f"{out}/columns")
    writers.write_json(inspect.masked_sample(df, order, sample_limit), f"{out}/sample")
    summary = inspect.dataset_fingerprint(df).withColumn("n_columns", F.lit(len(df.columns)))
    writers.write_json(summary, f"{out}/summary")


def profile_table(df: DataFrame, spec: TableSpec, out: str, top_n: int = 50) -> None:
    """Writes the tidy profile as CSV and JSON."""
    tidy = profile.profile_tidy(
        df, [c for c in spec.list_fields.values()], spec.range_column, spec.trait_columns, spec.narratives, top_n
    )
    writers.write_json(tidy, f"{out}/profile_json")
    writers.write_profile_csv(df.sparkSession.read.schema(tidy.schema).json(f"{out}/profile_json"), f"{out}/profile_csv")


def save_profile_states(df: DataFrame, spec: TableSpec, out: str, by: Sequence[str]) -> str:
    """Stores the profile states of the parts that ``by`` names; states of other parts stay as they are.

    New or changed parts are profiled alone: pass their rows only.
    """
    texts = profile.present(df, [*spec.list_fields.values(), *spec.narratives])
    states = profile_state.profile_states(df, [spec.range_column], texts, by)
    return writers.write_profile_states(states, out, by)


def stored_profile(spark: SparkSession, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all stored parts, or one for each value of some of the part columns; the table is not read."""
    return profile_state.state_profile(profile_state.merge_states(spark.read.parquet(f"{out}/profile_states"), by))


def save_cohort(
    df: DataFrame, request: CohortRequest, out: str, source_path: str = "", created_at: str | None = None, preview_limit: int = 20
) -> str:
    """Draws and stores a cohort: sample table, ids, safe preview and manifest; refuses samples that cannot be drawn."""
    spark, spec = df.sparkSession, request.filters.spec
    cohort.require_feasible(df, request.filters, request.sampling)
    path = f"{out}/{request.name}"
    cohort.draw_sample(df, request.filters, request.sampling).write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    writers.write_sample_ids(sample, spec.id_column, f"{path}/sample_ids")
    writers.write_preview(cohort.preview(df, sample, spec.id_column, spec.preview, preview_limit), f"{path}/sample_preview")
    row = cohort.manifest(df, request, sample, inspect.dataset_fingerprint(df))
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    writers.write_json(cohort.cohort_record(row, source_path, f"{path}/sample", stamp), f"{path}/manifest")
    return path


def load_plan(spark: SparkSession, out: str, run: Run) -> tuple[DataFrame, DataFrame]:
    """The stored questions and scenario variants that a run names; refuses a run whose records do not exist."""
    def mine(kind: str, key: str) -> DataFrame:
        rows = readers.read_lines(spark, kind, f"{out}/{kind}").where((F.col("project_id") == run.project_id) & (F.col(key) == getattr(run, key)))
        if rows.isEmpty():
            raise ValueError(f"no stored {kind} {getattr(run, key)} in {run.project_id}")
        return rows

    mine("project", "project_id")
    questions = readers.question_rows(mine("question_set", "question_set_id"))
    problems = checks.check_repeat_link(questions).union(checks.check_unique(questions, ["question_set_id", "question_id"]))
    bad = problems.first()
    if bad:
        raise ValueError(f"question set {run.question_set_id}: {bad['rule']} {bad['key']} {bad['detail']}")
    return questions, readers.variant_rows(mine("scenario", "scenario_id"))


def run_questions(
    df: DataFrame,
    spec: TableSpec,
    cohort_path: str,
    run: Run,
    out: str,
    created_at: str,
    generator: Callable[[dict], tuple[str, dict]],
    failures: tuple[type[Exception], ...] = (responses.ResponseGenerationError,),
    lots: int = 0,
) -> str:
    """Asks every sampled entity every question of the run's stored question set; stores the run record and the responses.

    The project, scenario and question set must be stored under ``out``; ``generator`` answers a cell, see
    ``responses.generate_responses``. With ``lots`` the agents are cut into lots that are asked and committed one after the
    other; a run that is started again goes on behind the last committed lot.
    """
    spark = df.sparkSession
    questions, _ = load_plan(spark, out, run)
    sample = spark.read.parquet(f"{cohort_path}/sample")
    context.require_complete(df, spec, sample)
    contexts = context.build_context(df, spec, run.context_level, sample).drop("sample_rank")
    cells = responses.plan_cells(responses.expand_question_table(contexts, questions, run.question_set_id), run)
    stamp = F.lit(created_at).cast("timestamp")

    def filled(some: DataFrame) -> DataFrame:
        answers = responses.generate_responses(some, generator, failures)
        rows = answers.withColumn("agent_id", F.col("agent_id").cast("string")).withColumn("created_at", stamp)
        return rows.select(*schemas.RESPONSE_COLUMNS)

    writers.write_records(run_record(questions, run, created_at), "run", out)
    if not lots:
        return writers.write_responses(filled(cells), out, run.project_id, run.run_id)
    root = f"{out}/response_lots"
    checked = lambda some: writers.checked_responses(filled(some), run.project_id, run.run_id)
    store.fill_lots(cells, checked, root, run.project_id, run.run_id, lots)
    return root


def run_record(questions: DataFrame, run: Run, created_at: str) -> DataFrame:
    """The stored record of a run; two rounds when a question is repeated, else one."""
    return responses.repeat_count(questions).select(
        F.lit(run.project_id).alias("project_id"), F.lit(run.run_id).alias("run_id"), F.lit(run.cohort_id).alias("cohort_id"),
        F.lit(run.scenario_id).alias("scenario_id"), F.lit(run.question_set_id).alias("question_set_id"),
        F.lit(run.context_level).alias("persona_context_level"),
        F.struct(
            F.lit(run.model).alias("model"), F.lit(run.temperature).alias("temperature"),
            F.lit(run.prompt_version).alias("prompt_version"),
        ).alias("generation_config"),
        F.lit(run.seed).cast("bigint").alias("seed"), "repeat_count",
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def read_run(spark: SparkSession, out: str, run: Run, file_format: str = "parquet") -> DataFrame:
    """Flat stored responses of one run; only that run's directory is read.

    A run that was asked in lots is read from its committed lots, another in the format that it was written in: Parquet or
    JSON lines.
    """
    root = f"{out}/response_lots"
    if store.committed(spark, root, run.project_id, run.run_id):
        return compare.flatten_responses(store.read_committed(spark, root, run.project_id, run.run_id, schemas.RESPONSE))
    stored = spark.read.schema(schemas.RESPONSE).format(file_format).load(f"{out}/responses")
    mine = stored.where((F.col("project_id") == run.project_id) & (F.col("run_id") == run.run_id))
    return compare.flatten_responses(mine)


def compare_run(spark: SparkSession, out: str, run: Run, created_at: str) -> str:
    """Pairs the repeats of a stored run with their originals; stores the evaluated pairs and the comparison records."""
    evaluate_run(spark, out, run)
    evaluated = evaluated_run(spark, out, run)
    records = compare.comparison_records(evaluated, run.project_id, F.lit(created_at).cast("timestamp"))
    return writers.write_comparisons(records, out, run.project_id, run.run_id)


def evaluate_run(spark: SparkSession, out: str, run: Run) -> None:
    """Stores the evaluated repeat pairs of a run once, for the comparison records and every export."""
    links = load_plan(spark, out, run)[0].where("repeat_of_question_id IS NOT NULL").select("question_id", "repeat_of_question_id")
    pairs = compare.evaluate_pairs(compare.repeat_pairs(read_run(spark, out, run), links))
    pairs.write.mode("overwrite").parquet(f"{out}/evaluated/{run.project_id}/{run.run_id}")


def evaluated_run(spark: SparkSession, out: str, run: Run) -> DataFrame:
    """The stored evaluated pairs of a run."""
    return spark.read.parquet(f"{out}/evaluated/{run.project_id}/{run.run_id}")


def export_run(
    spark: SparkSession, out: str, run: Run, design_id: str, packet_size: int = 25, seed: int = 0, conditions: DataFrame | None = None
) -> None:
    """Writes the tidy tables of a compared run: responses, comparisons, metrics, rare answers, the review packet and, if
    given, the design's condition matrix."""
    rows, evaluated = read_run(spark, out, run), evaluated_run(spark, out, run)
    provenance = {
        "design_id": design_id, "project_id": run.project_id, "run_id": run.run_id, "cohort_id": run.cohort_id,
        "scenario_id": run.scenario_id, "persona_context_level": run.context_level, "model_condition_id": run.model,
    }
    metrics = [m for m in ("stance_match", "stance_score_delta", "contradiction_candidate", "concern_overlap",
                           "acceptance_condition_overlap", "reason_overlap") if m in evaluated.columns]
    long = compare.metric_results_long(evaluated, metrics)
    mark = distributions.signature(F.col("stance"), F.col("concerns"), F.col("acceptance_conditions"))
    marked = rows.where(F.col("status") == "success").withColumn("signature", mark)
    tables = {
        "responses_long": rows,
        "comparisons_long": evaluated,
        "metric_results_long": long,
        "metric_summary_by_condition": compare.metric_summary(long, ["run_id"]),
        "minority_candidates": distributions.minority_candidates(marked, ["question_id"], "signature", "agent_id"),
        "human_eval_sample": review.review_packet(evaluated, seed, packet_size, design_id),
    }
    if conditions is not None:
        tables["condition_matrix"] = conditions
    for name, table in tables.items():
        writers.write_export(table, f"{out}/exports", name, provenance)


def load_cohort(spark: SparkSession, cohort_path: str, id_column: str) -> DataFrame:
    """``(cohort_id, sample_rank, persona_id)`` of a stored cohort, from its sample table."""
    manifest = readers.read_lines(spark, "cohort", f"{cohort_path}/manifest").select("cohort_id").scalar()
    return readers.cohort_members(spark, cohort_path, id_column).select(manifest.alias("cohort_id"), "sample_rank", "persona_id")
