"""Values a filter may choose from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ascending(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def option_values(df: DataFrame, column: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Distinct values in ascending order; ``allowed`` limits which columns may be asked for."""
    if allowed is not None and column not in allowed:
        raise ValueError(f"Unsupported option column: {column}")
    return df.select(F.col(column).alias("value")).distinct().orderBy(_ascending("value"))


def option_value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with row counts, commonest first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), _ascending("value"))


def dependent_options(df: DataFrame, parent: str, child: str, parents: Sequence = ()) -> DataFrame:
    """Distinct child values under the chosen parents; every child when none is chosen."""
    kept = df.where(F.col(parent).isin(list(parents))) if parents else df
    return kept.select(child).distinct().orderBy(_ascending(child))


def option_search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Distinct values that contain the literal text."""
    return df.where(F.col(column).contains(text)).select(column).distinct().orderBy(_ascending(column))


def invalid_child_values(df: DataFrame, parent: str, child: str, parents: Sequence, requested: DataFrame) -> DataFrame:
    """Requested child values that never occur under the chosen parents."""
    if not parents:
        return requested.select(child).limit(0)
    valid = df.where(F.col(parent).isin(list(parents))).select(child).distinct()
    return requested.select(child).distinct().join(valid, child, "left_anti")


def require_children(df: DataFrame, parent: str, child: str, parents: Sequence, children: Sequence[str]) -> None:
    """Raise when a chosen child value cannot occur under the chosen parents."""
    if not parents or not children:
        return
    requested = df.sparkSession.createDataFrame([(c,) for c in children], f"`{child}` string")
    bad = [r[0] for r in invalid_child_values(df, parent, child, parents, requested).orderBy(child).collect()]
    if bad:
        raise ValueError(f"{child} not present in selected {parent}s: {', '.join(bad)}")


def ordinal_index(column: Column, order: Sequence[str]) -> Column:
    """0-based place of a value in an ordered vocabulary; NULL when it is not a member."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), column)
    return F.nullif(place, F.lit(0)) - 1


def ordinal_observed(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Members of an ordered vocabulary that occur in the table, in vocabulary order, with row counts.

    A table without the column gives no rows.
    """
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "position int, value string, count bigint")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    placed = counts.withColumn("position", ordinal_index(F.col("value"), order).cast("int"))
    return placed.where(F.col("position").isNotNull()).select("position", "value", "count").orderBy("position")
