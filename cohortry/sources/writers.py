"""Writers of samples, profiles, responses and tidy exports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import vocab

EXPORT_SCHEMA_VERSION = "v1"
# metrics of the tidy profile that are not whole numbers
FRACTION_METRICS = (
    "mean", "median", "mean_length", "median_length", "p95_length", "duplicate_row_ratio", "top_exact_value_ratio",
)


def write_sample_ids(sample: DataFrame, id_column: str, path: str) -> None:
    """One id column with a header, in sample order."""
    ordered = sample.orderBy("sample_rank").select(id_column)
    ordered.write.mode("overwrite").option("header", "true").csv(path)


def write_preview(preview: DataFrame, path: str) -> None:
    """Preview rows with a header; no rows give an empty directory."""
    preview.drop("sample_rank").write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Any result table as JSON lines, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_profile_csv(tidy: DataFrame, path: str) -> None:
    """The tidy profile as CSV, one directory per section; counts are written as whole numbers."""
    metric = F.coalesce(F.col("metric"), F.lit(""))
    fraction = metric.isin(*FRACTION_METRICS) | (F.col("count") != F.floor("count"))
    number = F.when(fraction, F.col("count").cast("string")).otherwise(F.col("count").cast("bigint").cast("string"))
    tidy.withColumn("count", number).write.mode("overwrite").option("header", "true").partitionBy("section").csv(path)


def _in_scope(df: DataFrame, key: str, project_id: str, run_id: str) -> DataFrame:
    """The rows themselves; writing fails on the first row of another project or run, without a second pass."""
    out = df
    for column, value in (("project_id", project_id), ("run_id", run_id)):
        if not re.match(vocab.ID_PATTERNS[column], value):
            raise ValueError(f"invalid {column} for storage path: {value}")
        problem = F.concat(F.lit(f"{column} of "), F.col(key), F.lit(" does not match storage destination"))
        same = F.col(column).eqNullSafe(F.lit(value))
        out = out.withColumn(column, F.when(same, F.col(column)).otherwise(F.raise_error(problem).cast("string")))
    return out


def _within_rules(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """The rows themselves; writing fails on the first row that breaks a rule, given as (message, broken)."""
    first = df.columns[0]
    problem = F.coalesce(*[F.when(broken, F.lit(text)) for text, broken in rules])
    kept = F.when(problem.isNull(), F.col(first)).otherwise(F.raise_error(problem).cast(df.schema[first].dataType))
    return df.withColumn(first, kept)


def id_rules(df: DataFrame, names: Sequence[str]) -> list[tuple[str, Column]]:
    """Ids must match their pattern."""
    return [(f"invalid {c}", ~F.coalesce(F.col(c).cast("string").rlike(vocab.ID_PATTERNS[c]), F.lit(False))) for c in names if c in df.columns]


def response_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """Success needs text and payload and no error type; an error needs its type; statuses and types are closed lists."""
    ok = F.col("status") == "success"
    return [
        *id_rules(df, ("response_id", "question_id")),
        ("unknown status", ~F.coalesce(F.col("status").isin(*vocab.RESPONSE_STATUSES), F.lit(False))),
        ("unknown question type", ~F.coalesce(F.col("question_type").isin(*vocab.QUESTION_TYPES), F.lit(False))),
        ("success without payload", ok & (F.col("response_text").isNull() | F.col("structured_response").isNull())),
        ("success with error_type", ok & F.col("error_type").isNotNull()),
        ("error without error_type", ~ok & F.col("error_type").isNull()),
    ]


def comparison_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """A comparison has two different responses, a known relation and a known review status."""
    reviewed = F.col("human_evaluation.review_status").isin(*vocab.REVIEW_STATUSES)
    return [
        *id_rules(df, ("comparison_id",)),
        ("a response is compared with itself", F.col("response_a_id").eqNullSafe(F.col("response_b_id"))),
        ("unknown question relation", ~F.coalesce(F.col("question_relation").isin(*vocab.RELATIONS), F.lit(False))),
        ("unknown review status", ~F.coalesce(reviewed, F.lit(False))),
    ]


def _write_by(df: DataFrame, path: str, keys: Sequence[str], file_format: str) -> None:
    """Replace only the directories of the key values that are written."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    if file_format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(file_format).save(path)


def write_profile_states(states: DataFrame, root: str, by: Sequence[str]) -> str:
    """States under ``root/profile_states``, one directory per part; only the parts that are written are replaced."""
    path = f"{root}/profile_states"
    _write_by(states, path, by, "parquet")
    return path


def checked_responses(responses: DataFrame, project_id: str, run_id: str) -> DataFrame:
    """The responses themselves; whatever writes them fails on a row that breaks a rule or belongs to another run."""
    return _in_scope(_within_rules(responses, response_rules(responses)), "response_id", project_id, run_id)


def write_responses(
    responses: DataFrame, root: str, project_id: str, run_id: str, file_format: str = "parquet"
) -> str:
    """Responses of one run under ``root/responses``; refuses rows that break a rule or belong to another project or run,
    replaces only this run."""
    path = f"{root}/responses"
    _write_by(checked_responses(responses, project_id, run_id), path, ("project_id", "run_id"), file_format)
    return path


def write_comparisons(
    comparisons: DataFrame, root: str, project_id: str, run_id: str, file_format: str = "parquet"
) -> str:
    """Comparisons of one run under ``root/comparisons`` with the same checks."""
    path = f"{root}/comparisons"
    checked = _within_rules(comparisons, comparison_rules(comparisons))
    _write_by(_in_scope(checked, "comparison_id", project_id, run_id), path, ("project_id", "run_id"), file_format)
    return path


def write_records(records: DataFrame, kind: str, root: str) -> str:
    """Project, scenario, question-set, run or follow-up records, one directory per project and record: other records of
    a project stay."""
    path = f"{root}/{kind}"
    keys = list(dict.fromkeys(("project_id", f"{kind}_id")))
    _write_by(_within_rules(records, id_rules(records, keys)), path, keys, "json")
    return path


def tidy_export(df: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """Flat export rows: provenance columns first, nested cells as JSON text, schema version last."""
    constant = [F.lit(v).alias(k) for k, v in provenance.items() if k not in df.columns]
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*constant, *cells, F.lit(EXPORT_SCHEMA_VERSION).alias("export_schema_version"))


def write_export(df: DataFrame, root: str, name: str, provenance: dict[str, str], file_format: str = "csv") -> str:
    """One tidy export table under ``root``, in a directory for the project and run that the provenance names.

    Columns that identify a person are refused.
    """
    forbidden = sorted(set(df.columns) & set(vocab.EXCLUDED_COLUMNS))
    if forbidden:
        raise ValueError(f"columns that identify a person are never exported: {', '.join(forbidden)}")
    path = "/".join([root, *(provenance[k] for k in ("project_id", "run_id") if k in provenance), name])
    writer = tidy_export(df, provenance).write.mode("overwrite")
    writer = writer.option("header", "true") if file_format == "csv" else writer
    writer.format(file_format).save(path)
    return path
