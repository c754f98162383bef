"""Seeded samples as bottom-k structures: the k smallest hash keys of distinct ids.

The bottom k of a union is the bottom k of its parts' bottom k, so samples of parts can be stored and merged without
reading the table again (``bottom_states``, ``merge_bottom``). For one sample of a table a hash threshold, computed from
the number of ids, keeps the ids behind it from ever being shuffled (``bottom_k``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.hashing import sample_key

#: Hex digits of a key that are read as a number; they fit a double exactly.
_DIGITS = 13
#: Theta sketches of 2 ** 12 entries; four of their standard errors.
_LOG2_ENTRIES, _SKETCH_ERROR = 12, 4 * 2.0**-6
_BUCKETS = 4096


def key_fraction(key: Column) -> Column:
    """A hex key as a number from 0 up to 1; never decreases along the keys."""
    return F.conv(F.substring(key, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def bottom_fraction(n: int, population: Column) -> Column:
    """The share of the keys that holds the first ``n`` of about ``population`` ids but for one chance in a billion."""
    wanted = n + 6 * n**0.5 + 20
    return F.least(F.lit(1.0), F.lit(wanted) / F.greatest(population.cast("double") * (1 - _SKETCH_ERROR), F.lit(1.0)))


def _up_to(key: Column, limit: Column) -> Column:
    """Whether a key lies below a share of all keys; compares text, which is cheaper than reading every key as a number."""
    digits = F.lower(F.lpad(F.hex((limit * F.lit(float(16**_DIGITS))).cast("bigint")), _DIGITS, "0"))
    return F.substring(key, 1, _DIGITS) <= F.when(limit < 1, digits).otherwise("g")


def below_threshold(keyed: DataFrame, n: int, population: Column | None = None, entity: str | None = None) -> tuple[DataFrame, Column]:
    """The rows whose ``sample_key`` is below the threshold for ``n`` ids, and the threshold.

    Without a population it is estimated by a theta sketch of the ids: one more scan of that column, one row per task.
    """
    if population is None:
        population = keyed.agg(F.theta_sketch_estimate(F.theta_sketch_agg(F.col(entity).cast("string"), _LOG2_ENTRIES))).scalar()
    limit = bottom_fraction(n, population)
    return keyed.where(_up_to(F.col("sample_key"), limit)), limit


def bottom_k(df: DataFrame, entity: str, seed: int, n: int, population: Column | None = None, name: str = "sample_rank") -> DataFrame:
    """``(entity, sample_key, rank)`` of the first ``n`` distinct ids along a seeded hash order.

    Only ids below the threshold are shuffled, about ``n`` of them; they are cut into even buckets of keys, and each bucket
    is ranked on its own. Should the threshold turn out too low, a count of what passed brings in the ids behind it, in the
    same plan; else that part is dropped before it reads anything. ``population`` may come from a stored profile state; a
    wrong one costs time, never exactness.
    """
    keyed = df.select(entity).where(F.col(entity).isNotNull()).withColumn("sample_key", sample_key(F.col(entity), seed))
    passed, limit = below_threshold(keyed, n, population, entity)
    passed = passed.distinct()
    short = passed.agg(F.count("*").alias("_n")).where(F.col("_n") < n).select((F.lit(32) + F.floor(F.col("_n") / (n + 1))).alias("_digits"))
    rest = keyed.where(~_up_to(F.col("sample_key"), limit)).withColumn("_digits", F.length("sample_key").cast("bigint"))
    # at most one row, and mostly none; every key has 32 digits, and a computed column keeps this a hash join
    rest = rest.join(F.broadcast(short), "_digits", "left_semi").drop("_digits").distinct()
    place = F.least(F.floor(key_fraction(F.col("sample_key")) / limit * _BUCKETS), F.lit(_BUCKETS)).cast("int")
    ranked = _ranked_in_buckets(passed.union(rest).withColumn("_bucket", place), entity, n, name)
    return ranked.select(entity, "sample_key", name)


def _ranked_in_buckets(rows: DataFrame, entity: str, n: int, name: str) -> DataFrame:
    """The first ``n`` rows along (sample_key, entity) with their 1-based rank, by buckets that follow the keys."""
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # one row per bucket
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_offset") < n).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("sample_key", entity))
    kept = rows.join(F.broadcast(offsets), "_bucket").withColumn(name, (rank + F.col("_offset")).cast("bigint"))
    return kept.where(F.col(name) <= n)


def bottom_states(df: DataFrame, entity: str, seed: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by, entity, sample_key)``: the ``k`` smallest keys of the distinct ids of each part or stratum, from one scan.

    Each task passes on ``k`` ids per part at most, whatever repeats among its rows. NULL ids take no part; NULL is a part.
    """
    keyed = df.select(*by, entity).where(F.col(entity).isNotNull()).withColumn("sample_key", sample_key(F.col(entity), seed))
    return merge_bottom(keyed, entity, k, by)


def merge_bottom(states: DataFrame, entity: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The bottom ``k`` of the union of some states; parts that ``by`` leaves out are merged."""
    # equal keys share a rank, so that a repeated id takes one place; Spark prunes by it before the shuffle
    place = F.dense_rank().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("sample_key", entity))
    return states.select(*by, entity, "sample_key").withColumn("_place", place).where(F.col("_place") <= k).drop("_place").distinct()
