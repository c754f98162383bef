"""Filtering, seeded sampling, previews and cohort manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import vocab
from cohortry.operators.sampling import bottom_k
from cohortry.spec import CohortFilter, CohortRequest, SamplingSpec

def filter_cohort(df: DataFrame, cohort: CohortFilter) -> DataFrame:
    """Rows that match the filter."""
    return df.where(cohort.predicate())


def matching_count(df: DataFrame, cohort: CohortFilter) -> DataFrame:
    """One row: how many rows match."""
    return filter_cohort(df, cohort).agg(F.count("*").alias("matching_count"))


def sample_feasibility(df: DataFrame, cohort: CohortFilter, sampling: SamplingSpec) -> DataFrame:
    """One row telling whether the sample can be drawn, judged on distinct ids."""
    ids = filter_cohort(df, cohort).select(cohort.spec.id_column).distinct()
    size = F.lit(sampling.sample_size).cast("bigint")
    matching = F.col("matching_ids")
    return ids.agg(F.count(cohort.spec.id_column).alias("matching_ids")).select(
        "matching_ids",
        size.alias("sample_size"),
        F.when(matching == 0, "matching count is zero")
        .when(matching < size, "sample_size is larger than matching count")
        .otherwise("ok")
        .alias("status"),
    )


def require_feasible(df: DataFrame, cohort: CohortFilter, sampling: SamplingSpec) -> None:
    """Raise unless the sample can be drawn; runs one aggregate."""
    status = sample_feasibility(df, cohort, sampling).first()["status"]
    if status != "ok":
        raise ValueError(status)


def draw_sample(df: DataFrame, cohort: CohortFilter, sampling: SamplingSpec, population: Column | None = None) -> DataFrame:
    """``(id, sample_key, sample_rank)`` of the first ``sample_size`` ids along a seeded hash order.

    The order depends only on id and seed, so any partitioning gives the same sample. Ids behind a hash threshold are
    dropped where they are read, so shuffle and sort follow the sample, not the table. ``population`` may tell about how
    many ids match, from a stored profile for example; it saves the scan that estimates it.
    """
    return bottom_k(filter_cohort(df, cohort), cohort.spec.id_column, sampling.seed, sampling.sample_size, population)


def lookup_in_order(df: DataFrame, sample: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the sampled ids with their rank; sort by ``sample_rank`` for list order.

    Spark broadcasts the sample when its bytes are few, so the wide table is not shuffled for it.
    """
    wanted = sample.select(id_column, "sample_rank")
    kept = [id_column, *[c for c in columns if c != id_column]]
    return df.select(*kept).join(wanted, id_column).select("sample_rank", *columns)


def preview(
    df: DataFrame, sample: DataFrame, id_column: str, columns: Sequence[str], limit: int = 20
) -> DataFrame:
    """The first ``limit`` sampled rows in sample order, allow-listed columns only."""
    forbidden = sorted(set(columns) & set(vocab.EXCLUDED_COLUMNS))
    if forbidden:
        raise ValueError(f"columns that identify a person are never exported: {', '.join(forbidden)}")
    head = sample.where(F.col("sample_rank") <= max(limit, 0))
    return lookup_in_order(df, head, id_column, columns).orderBy("sample_rank")


def missing_ids(ids: DataFrame, df: DataFrame, id_column: str) -> DataFrame:
    """Ids of the list that the table does not have."""
    return ids.join(df.select(id_column).distinct(), id_column, "left_anti")


def safe_projection(df: DataFrame, allowed: Sequence[str], excluded: Sequence[str] = vocab.EXCLUDED_COLUMNS) -> DataFrame:
    """Allow-listed columns that exist and are not excluded."""
    return df.select(*[c for c in allowed if c in df.columns and c not in set(excluded)])


def manifest(
    df: DataFrame, request: CohortRequest, sample: DataFrame, source_fingerprint: DataFrame
) -> DataFrame:
    """One row describing the cohort: source, filter, sampling, counts and stable id.

    ``source_fingerprint`` is the one-row result of ``inspect.dataset_fingerprint``. The ids stay in the sample table at
    every size; the row carries their number.
    """
    cohort, sampling = request.filters, request.sampling
    counts = df.agg(
        F.count("*").alias("row_count"), F.count_if(cohort.predicate()).alias("matching_count")
    )
    drawn = sample.agg(F.count("*"))
    canonical = cohort.canonical_json()
    row = counts.withColumn("sampled", drawn.scalar()).withColumn(
        "fingerprint", source_fingerprint.select("fingerprint").scalar()
    )
    identity = F.concat_ws("|", "fingerprint", F.lit(canonical), F.lit(sampling.canonical_json()))
    return row.select(
        F.concat(F.lit("cohort_"), F.substring(F.sha2(identity, 256), 1, 16)).alias("cohort_id"),
        F.lit(request.name).alias("name"),
        F.col("fingerprint").alias("source_fingerprint"),
        "row_count",
        "matching_count",
        F.create_map(*[F.lit(x) for k, v in cohort.payload().items() for x in (k, str(v))])
        .cast("map<string,string>").alias("filters"),
        F.lit(canonical).alias("canonical_filter_json"),
        F.sha2(F.lit(canonical), 256).alias("filter_hash"),
        F.lit(cohort.summary()).alias("human_readable_filter"),
        F.lit(sampling.sample_size).cast("bigint").alias("sample_size"),
        F.lit(sampling.seed).cast("bigint").alias("seed"),
        F.lit(sampling.method).alias("method"),
        "sampled",
    )


def cohort_record(row: DataFrame, source_path: str, sample_path: str, created_at: Column) -> DataFrame:
    """A manifest row in the stored shape of a cohort record; the source is named by its content fingerprint, the ids are
    in the table at ``sample_path``."""
    source = F.struct(
        F.lit(source_path).alias("path"), F.lit(None).cast("string").alias("sha256"),
        F.col("source_fingerprint").alias("fingerprint"), "row_count",
    )
    return row.select(
        "cohort_id", "name", source.alias("source"), "filters", "canonical_filter_json", "filter_hash",
        "human_readable_filter", "matching_count", F.struct("sample_size", "seed", "method").alias("sampling"),
        "sampled", F.lit(sample_path).alias("sample_path"), created_at.alias("created_at"),
    )
