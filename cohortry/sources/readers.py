"""Readers of stored records and requests; each returns a table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.sources import schemas
from cohortry.spec import CohortFilter, CohortRequest, TableSpec


def _with_corrupt(schema: str) -> str:
    return f"{schema}, {schemas.CORRUPT} string"


def scan(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, cohort: CohortFilter | None = None
) -> DataFrame:
    """Chosen columns of the rows of a Parquet table that match a filter; both reach the scan."""
    table = spark.read.parquet(path)
    matching = table.where(cohort.predicate()) if cohort else table
    return matching.select(*columns) if columns else matching


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses from JSON lines; blank lines give no row, unreadable lines keep their text in ``_corrupt_record``."""
    return (
        spark.read.schema(_with_corrupt(schemas.RESPONSE))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
    )


def read_records(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Every record of a kind under a path or glob as one table; a top-level array gives one row per element."""
    return (
        spark.read.schema(_with_corrupt(schemas.RECORDS[kind]))
        .option("multiLine", "true")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
    )


def read_lines(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Records of a kind that were written as JSON lines."""
    return spark.read.schema(schemas.RECORDS[kind]).json(path)


def cohort_members(spark: SparkSession, cohort_path: str, id_column: str) -> DataFrame:
    """``(sample_rank, persona_id)`` of a stored cohort: all ids of its sample table, whatever their number."""
    sample = spark.read.parquet(f"{cohort_path}/sample")
    return sample.select("sample_rank", F.col(id_column).cast("string").alias("persona_id"))


def question_rows(question_sets: DataFrame) -> DataFrame:
    """One row per question of the question-set records."""
    return question_sets.select("project_id", "question_set_id", F.inline("questions"))


def variant_rows(scenarios: DataFrame) -> DataFrame:
    """One row per scenario variant."""
    return scenarios.select("project_id", "scenario_id", "title", F.inline("variants"))


def read_request(spark: SparkSession, path: str, spec: TableSpec) -> CohortRequest:
    """A cohort request from one small JSON config file."""
    text = spark.read.option("wholetext", "true").text(path).first()[0]
    return CohortRequest.from_dict(json.loads(text), spec)
