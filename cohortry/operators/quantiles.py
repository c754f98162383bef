"""Exact quantiles without holding a column's values in one task.

Both functions return one row per profiled column: ``n, minimum, maximum, mean`` and ``q<i>`` per probability, with
linear interpolation between neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.profile_state import number_states, rank_error, sketch_quantiles


def _rank_columns(total: Column, probabilities: Sequence[float]) -> dict[str, Column]:
    """0-based lower and upper rank and the weight between them, per probability."""
    out = {}
    for i, p in enumerate(probabilities):
        at = (total - 1) * F.lit(float(p))
        out |= {f"lo{i}": F.floor(at), f"hi{i}": F.ceil(at), f"w{i}": at - F.floor(at)}
    return out


def _pick(placed: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Values at the wanted ranks from rows ``(column, value, n, end, lo*, hi*, w*)``; ``end`` counts rows up to a value."""
    def at(rank: str) -> Column:
        inside = (F.col(rank) < F.col("end")) & (F.col(rank) >= F.col("end") - F.col("n"))
        return F.max(F.when(inside, F.col("value").cast("double")))

    quantiles = []
    for i in range(len(probabilities)):
        low, high = at(f"lo{i}"), at(f"hi{i}")
        quantiles.append((low + (high - low) * F.max(f"w{i}")).alias(f"q{i}"))
    return placed.groupBy("column").agg(*quantiles)


def histogram_quantiles(hist: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Summary of small-domain values such as text lengths from ``(column, value, n)``.

    The running count sorts the distinct values of one column in one task, so their number must be modest; the sort
    spills.
    """
    per_column = Window.partitionBy("column")
    upto = per_column.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = hist.withColumn("end", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(per_column))
    placed = placed.withColumns(_rank_columns(F.col("total"), probabilities))
    picked = _pick(placed, probabilities)
    stats = hist.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        (F.sum(F.col("value") * F.col("n")).cast("double") / F.sum("n")).alias("mean"),
    )
    # one row per profiled column
    return stats.join(F.broadcast(picked), "column")


def _code(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Which of the even buckets of a slice holds a value: -1 below, ``buckets + 1`` above. Never decreases along the values.

    A slice without a finite width is one bucket.
    """
    width = high - low
    cut = F.when((width > 0) & (width < float("inf")), F.floor((value - low) / width * buckets))
    inside = F.least(F.lit(buckets), F.greatest(F.lit(0), F.coalesce(cut, F.lit(0))))
    return F.when(value < low, -1).when(value > high, buckets + 1).otherwise(inside).cast("int")


def sliced_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000, margin: float | None = None,
    rounds: int = 1, buckets: int = 1 << 16, states: DataFrame | None = None,
) -> DataFrame:
    """Summary of numeric columns with many distinct values; lazy, and exact whatever the sketches say.

    A KLL sketch (``states``, stored ones or else one scan) gives a slice of values around each wanted quantile. One pass
    counts the rows below the slice, above it and in each of its ``buckets`` even parts, which locates the wanted ranks;
    each further round cuts the bucket that holds a rank again, from its smallest to its largest value. Of what is left
    the different values are counted and sorted. A task sorts at most ``buckets + 2`` counters, or at last the different
    values of a bucket: of n rows about ``2 * margin * n / buckets ** rounds``. A poor sketch makes a slice longer and
    never changes the answer. Every pass reads only these columns and drops the rows outside before any shuffle.
    """
    probs, columns = list(probabilities), list(columns)
    k = min(max(accuracy // 10, 8), 65_535)
    margin = rank_error(k) if margin is None else margin
    states = number_states(df, columns, k) if states is None else states.where(F.col("column").isin(columns))
    marks = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-margin, margin)]
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    slices = F.array(*[
        F.struct(F.lit(i).alias("q"), F.get("_marks", F.lit(2 * i)).alias("low"), F.get("_marks", F.lit(2 * i + 1)).alias("high"),
                 F.array_distinct(F.array(F.floor(r), F.ceil(r))).alias("ranks"))
        for i, r in enumerate(at)
    ])
    # one row per column and probability
    slices = states.where("n > 0").withColumn("_marks", sketch_quantiles(F.col("quantiles"), F.col("n"), marks)).select("column", F.inline(slices))
    ranks = slices.select("column", "q", F.explode("ranks").alias("rank"))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value IS NOT NULL")
    value, inside = F.col("value"), (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    parts = slices.select("column", "q", F.coalesce("low", F.lit(float("-inf"))).alias("low"), F.coalesce("high", F.lit(float("inf"))).alias("high"),
                          F.lit(0).cast("bigint").alias("before"))
    for turn in range(rounds + 1):
        rows = long.join(F.broadcast(parts), "column")
        rows = rows if turn == 0 else rows.where(inside)
        key = ["column", "q", "before"]
        if turn < rounds:
            counts = rows.withColumn("code", _code(value, F.col("low"), F.col("high"), buckets)).groupBy(*key, "code").agg(
                F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        else:
            counts = rows.groupBy(*key, value.alias("code")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy(*key).orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("end", F.col("before") + F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
        found = counts.join(F.broadcast(ranks), ["column", "q"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
        if turn < rounds:
            parts = found.select("column", "q", "low", "high", F.col("start").alias("before")).distinct()
    weight = [(F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))) for p in probs]
    ends = found.groupBy("column").agg(*[
        x.alias(f"{name}{i}") for i in range(len(probs))
        for name, x in (("low", F.min(F.when(F.col("q") == i, F.col("code")))), ("high", F.max(F.when(F.col("q") == i, F.col("code")))))
    ])
    summary = states.select("column", "n", "minimum", "maximum", (F.col("total") / F.nullif("n", F.lit(0))).alias("mean"))
    quantiles = [(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * w).alias(f"q{i}") for i, w in enumerate(weight)]
    # one row per column
    return summary.join(F.broadcast(ends), "column", "left").select("column", "n", "minimum", "maximum", "mean", *quantiles)
