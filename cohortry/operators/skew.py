"""Building blocks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys meet; the keys come from the left side."""
    named = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    if not keys:
        raise ValueError("a join needs keys")
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return left.join(named, same).drop(*[f"_k_{c}" for c in keys])


def sequence_within_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "sequence"
) -> DataFrame:
    """0-based position of each row within its key, without sorting a whole key in one task.

    ``bucket`` must never decrease along ``order`` (a truncated timestamp, say). Rows are sorted per (key, bucket) and
    the sizes of the earlier buckets are added, so a hot key is split over as many tasks as it has buckets. ``order``
    must be unique within a key. A NULL key is a key of its own; a NULL bucket comes last, as NULL does in the order.
    """
    keyed = df.withColumn("_bucket", bucket)
    cell = [*keys, "_bucket"]
    sizes = keyed.groupBy(*cell).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*cell).orderBy(*[F.col(c).asc_nulls_last() for c in order])) - 1
    placed = null_safe_join(keyed.withColumn("_local", local), offsets, cell)
    return placed.withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint")).drop("_bucket", "_local", "_offset")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """First ``n`` rows of each group with their rank.

    Spark prunes each map task to ``n`` rows per group before the shuffle, so group size does not matter.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(name) <= n)
