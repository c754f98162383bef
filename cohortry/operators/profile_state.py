"""Profiles as mergeable states: a row of counts and sketches per column that can be stored and added up.

A state row holds exact counts, extremes and sums, a KLL sketch of the numbers (or of text lengths), a theta sketch of the
values and the counters of the commonest values. States of disjoint parts of a table (its partitions, days, sources) merge
into the state of the whole without reading the table again, so a profile follows appends. Each row has a fixed size
whatever the number of rows behind it, and everything is one partial aggregation.

Bounds, with the default parameters: a quantile's rank is within ``rank_error(k)`` of the wanted one (99 % of the time);
a distinct count is exact up to ``2 ** log2_distinct`` values and within about 1.6 % beyond (one standard error is
``2 ** (-log2_distinct / 2)``); the counts of the commonest values are exact up to three quarters of ``tracked`` different
values and estimates beyond. NULL is no value: it is counted by ``n_rows - n``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.measures import share

#: The columns of a state, besides the columns that name the part and the profiled column.
STATE = ("n_rows", "n", "minimum", "maximum", "total", "quantiles", "distinct_values", "top_values")


def rank_error(k: int) -> float:
    """The rank error of a KLL sketch, for one quantile, at 99 % confidence (the constants are the sketch's own)."""
    return 2.296 / k**0.9021


def _row(column: str, number: Column, sketched: list[Column]) -> Column:
    return F.struct(
        F.lit(column).alias("column"), F.count("*").alias("n_rows"), F.count(number).alias("n"), F.min(number).alias("minimum"),
        F.max(number).alias("maximum"), F.sum(number).alias("total"), *sketched,
    )


def _quantiles(number: Column, k: int) -> Column:
    # NaN has no rank in a sketch
    return F.kll_sketch_agg_double(F.when(~F.isnan(number), number), k).alias("quantiles")


def number_states(df: DataFrame, columns: Sequence[str], k: int = 1000) -> DataFrame:
    """``column, n_rows, n, minimum, maximum, total, quantiles`` of numeric columns: one scan, one row per column."""
    rows = [_row(c, F.col(c).cast("double"), [_quantiles(F.col(c).cast("double"), k)]) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def profile_states(
    df: DataFrame, numbers: Sequence[str] = (), texts: Sequence[str] = (), by: Sequence[str] = (),
    k: int = 1000, log2_distinct: int = 12, tracked: int = 2000,
) -> DataFrame:
    """One state per part and column; ``by`` names the columns that cut the table into parts.

    Numbers are profiled by value, texts by their length in code points; both by their values as text.
    """
    rows = []
    for c in (*numbers, *texts):
        text = F.col(c).cast("string")
        number = F.col(c).cast("double") if c in numbers else F.length(text).cast("double")
        top = F.expr(f"approx_top_k_accumulate(cast(`{c}` as string), {tracked}) FILTER (WHERE `{c}` IS NOT NULL)").alias("top_values")
        rows.append(_row(c, number, [_quantiles(number, k), F.theta_sketch_agg(text, log2_distinct).alias("distinct_values"), top]))
    made = df.groupBy(*by).agg(F.array(*rows).alias("_rows"))
    return made.select(*by, F.inline("_rows"))


def merge_states(states: DataFrame, by: Sequence[str] = (), k: int = 1000, log2_distinct: int = 12, tracked: int = 2000) -> DataFrame:
    """Add up states: one for each value of ``by`` and column. Merging is associative, so parts may be merged in any order."""
    return states.groupBy(*by, "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.sum("total").alias("total"), F.kll_merge_agg_double("quantiles", k).alias("quantiles"),
        F.theta_union_agg("distinct_values", log2_distinct).alias("distinct_values"),
        F.expr(f"approx_top_k_combine(top_values, {tracked})").alias("top_values"),
    )


def sketch_quantiles(sketch: Column, n: Column, ranks: Sequence[float]) -> Column:
    """An array of the values at some ranks between 0 and 1; NULL for a sketch of nothing."""
    wanted = F.array(*[F.lit(float(r)) for r in ranks])
    return F.when((n > 0) & (F.kll_sketch_get_n_double(sketch) > 0), F.kll_sketch_get_quantile_double(sketch, wanted))


def state_profile(states: DataFrame, probabilities: Sequence[float] = (0.5, 0.95), top_n: int = 10) -> DataFrame:
    """A state as a profile: counts, extremes, mean, ``q<i>`` per probability, distinct values and the commonest ones.

    ``top`` is ordered by count, then by value, among the values that the state tracks.
    """
    kept = [c for c in states.columns if c not in STATE]
    found = states.withColumn("_q", sketch_quantiles(F.col("quantiles"), F.col("n"), probabilities)).withColumn(
        "_top", F.expr("approx_top_k_estimate(top_values, 2000)"))
    ordered = F.array_sort("_top", lambda x, y: F.when(x["count"] != y["count"], F.when(x["count"] > y["count"], -1).otherwise(1))
                           .when(x["item"] < y["item"], -1).when(x["item"] > y["item"], 1).otherwise(0))
    top = F.transform(F.slice(ordered, 1, top_n), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count")))
    return found.select(
        *kept, "n_rows", "n", share(F.col("n_rows") - F.col("n"), F.col("n_rows")).alias("null_ratio"), "minimum", "maximum",
        share(F.col("total"), F.col("n")).alias("mean"), *[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(probabilities))],
        F.theta_sketch_estimate("distinct_values").alias("distinct_count"), top.alias("top"),
    )
