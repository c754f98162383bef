"""Layered context tables for sampled entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.cohort import lookup_in_order, missing_ids
from cohortry.spec import TableSpec

LEVELS = ("P1", "P2", "P3")


def required_columns(spec: TableSpec, level: str) -> list[str]:
    """Columns a level must have; each level contains the one before it."""
    if level not in LEVELS:
        raise ValueError(f"Unsupported context level: {level}")
    extended = () if level == "P1" else spec.extended_context
    return [*spec.base_context, *extended]


def level_columns(spec: TableSpec, level: str, available: Sequence[str]) -> list[str]:
    """Columns read for a level: the required ones, and at P3 every narrative column that exists."""
    wanted = required_columns(spec, level)
    return wanted + ([c for c in spec.narratives if c in available] if level == "P3" else [])


def missing_level_columns(spec: TableSpec, level: str, available: Sequence[str]) -> list[str]:
    """Required columns the table lacks; at P3 all narratives count as missing when none exists."""
    missing = [c for c in required_columns(spec, level) if c not in available]
    no_narrative = level == "P3" and not any(c in available for c in spec.narratives)
    return missing + (list(spec.narratives) if no_narrative else [])


def require_level(spec: TableSpec, level: str, available: Sequence[str]) -> None:
    """Raise when a level cannot be built from the columns at hand."""
    missing = missing_level_columns(spec, level, available)
    if missing:
        raise ValueError(f"missing required {level} columns: {', '.join(missing)}")


def narrative_array(columns: Sequence[str]) -> Column:
    """Narrative columns as an ordered array of ``(field_name, text)`` without the NULL ones."""
    entries = [F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in columns]
    return F.filter(F.array(*entries), lambda n: n["text"].isNotNull())


def build_context(df: DataFrame, spec: TableSpec, level: str, sample: DataFrame | None = None) -> DataFrame:
    """Context rows of one level, keyed by ``persona_id``; with a sample, also ``sample_rank``."""
    require_level(spec, level, df.columns)
    columns = level_columns(spec, level, df.columns)
    rows = df.select(*columns) if sample is None else lookup_in_order(df, sample, spec.id_column, columns)
    plain = required_columns(spec, level)
    out = [F.col(spec.id_column).alias("persona_id"), *[c for c in plain if c != spec.id_column]]
    if sample is not None:
        out.insert(0, F.col("sample_rank"))
    if level == "P3":
        out.append(narrative_array(columns[len(plain):]).alias("narratives"))
    return rows.select(*out)


def require_complete(df: DataFrame, spec: TableSpec, sample: DataFrame, shown: int = 20) -> None:
    """Raise when sampled ids are absent from the source or occur more than once; names the first few."""
    lost = missing_ids(sample.select(spec.id_column), df, spec.id_column).orderBy(spec.id_column).limit(shown)
    ids = [str(r[0]) for r in lost.collect()]
    if ids:
        raise ValueError(f"Missing sampled personas: {', '.join(ids)}")
    seen = df.select(spec.id_column).join(sample.select(spec.id_column), spec.id_column, "left_semi")
    repeated = seen.groupBy(spec.id_column).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    ids = [str(r[0]) for r in repeated.orderBy(spec.id_column).limit(shown).collect()]
    if ids:
        raise ValueError(f"Sampled personas occur more than once: {', '.join(ids)}")


def narratives_long(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """One row per narrative: ``(persona_id, position, field_name, text)``."""
    arrays = df.select(F.col(id_column).alias("persona_id"), narrative_array(columns).alias("narratives"))
    long = arrays.select("persona_id", F.posexplode("narratives").alias("position", "n"))
    return long.select("persona_id", "position", F.col("n.field_name").alias("field_name"), F.col("n.text").alias("text"))
