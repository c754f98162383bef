"""Distributions by group, shifts between conditions and rare answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.measures import share
from cohortry.operators.skew import null_safe_join


def stance_distribution(df: DataFrame, stance: str, segment: str, variant: str) -> DataFrame:
    """Stance counts and shares overall, per segment, per variant and per both.

    Rows are first counted per finest cell, and the grouping sets run over those few cells. ``level`` tells subtotal rows
    from real NULLs.
    """
    cells = df.groupBy(segment, variant, stance).agg(F.count("*").alias("_n"))
    sets = [[stance], [segment, stance], [variant, stance], [segment, variant, stance]]
    level = F.concat_ws(
        "+",
        F.when(F.grouping(segment) == 0, "segment"),
        F.when(F.grouping(variant) == 0, "variant"),
    )
    counted = cells.groupingSets(sets, segment, variant, stance).agg(
        F.nullif(level, F.lit("")).alias("_level"), F.sum("_n").alias("n")
    )
    counted = counted.withColumn("level", F.coalesce("_level", F.lit("overall"))).drop("_level")
    whole = Window.partitionBy("level", segment, variant)
    return counted.withColumn("share", share(F.col("n"), F.sum("n").over(whole))).select(
        "level", segment, variant, stance, "n", "share"
    )


def item_frequency(df: DataFrame, group: Sequence[str], items: str) -> DataFrame:
    """How often each item of an array column is named per group, and by which share of the group's rows.

    One aggregation: a row counts once for its group, under an item that no list holds, and once for each of its items.
    """
    mark = F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("item"))
    named = F.transform(F.coalesce(F.array_distinct(F.col(items).cast("array<string>")), F.array().cast("array<string>")),
                        lambda i: F.struct(F.lit(False).alias("whole"), i.alias("item")))
    counts = df.select(*group, F.inline(F.concat(F.array(mark), named))).groupBy(*group, "whole", "item").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sized = counts.withColumn("group_rows", F.max(F.when(F.col("whole"), F.col("n"))).over(whole)).where(~F.col("whole"))
    return sized.withColumn("share", share(F.col("n"), F.col("group_rows"))).select(*group, "item", "n", "share")


def category_shares(df: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """Share of each category inside its group, from counted cells."""
    counts = df.groupBy(*group, category).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return counts.withColumn("share", share(F.col("n"), F.sum("n").over(whole)))


def distribution_shift(df: DataFrame, group: Sequence[str], category: str, condition: str, base: str, other: str) -> DataFrame:
    """Total variation distance between two conditions per group: half the summed share differences.

    NULL is a category like any other; a group that lacks a condition has shares of 0 there.
    """
    at = lambda value: F.count_if(F.col(condition) == value)
    counts = df.where(F.col(condition).isin(base, other)).groupBy(*group, category).agg(at(base).alias("_p"), at(other).alias("_q"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    part = lambda c: F.coalesce(share(F.col(c), F.sum(c).over(whole)), F.lit(0.0))
    apart = counts.select(*group, F.abs(part("_p") - part("_q")).alias("_d"))
    return apart.groupBy(*group).agg((F.sum("_d") / 2).alias("total_variation"))


def signature(stance: Column, concerns: Column, conditions: Column) -> Column:
    """Answer signature: stance with the sorted distinct concerns and conditions."""
    listed = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return F.concat_ws("|", stance, listed(concerns), listed(conditions))


def minority_candidates(df: DataFrame, group: Sequence[str], mark: str, key: str, k: int = 1) -> DataFrame:
    """Rows whose signature occurs at most ``k`` times in their group.

    At most ``k + 1`` rows per signature leave each map task, which is enough to tell rare signatures from common ones, so
    a signature held by most rows costs no more than a rare one.
    """
    cell = Window.partitionBy(*group, mark)
    first = df.withColumn("_r", F.row_number().over(cell.orderBy(key))).where(F.col("_r") <= k + 1)
    return first.withColumn("signature_count", F.count("*").over(cell)).where(F.col("signature_count") <= k).drop("_r")


def minority_by_quantile(df: DataFrame, group: Sequence[str], mark: str, key: str, quantile: float) -> DataFrame:
    """Rows whose signature count has ``percent_rank <= quantile`` among the signatures of their group.

    Signatures with the same count share a rank, so the ranks come from the few distinct counts of a group. The rare
    signatures are then joined back; NULL groups and signatures are kept like others.
    """
    keys = [*group, mark]
    counts = df.groupBy(*keys).agg(F.count("*").alias("signature_count"))
    levels = counts.groupBy(*group, "signature_count").agg(F.count("*").alias("_signatures"))
    whole = Window.partitionBy(*group)
    below = whole.orderBy("signature_count").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("_signatures").over(below), F.lit(0))
    rank = F.coalesce(share(smaller, F.sum("_signatures").over(whole) - 1), F.lit(0.0))
    ranked = levels.withColumn("signature_rank", rank).where(F.col("signature_rank") <= quantile)
    limits = ranked.groupBy(*group).agg(F.max("signature_count").alias("_limit"))
    rare = null_safe_join(counts, limits, group).where(F.col("signature_count") <= F.col("_limit")).drop("_limit")
    return null_safe_join(df, rare, keys).select(*df.columns, "signature_count")
