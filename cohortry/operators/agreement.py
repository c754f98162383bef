"""Rater agreement. Ratings are counted per cell first, so every formula runs over counts.

Two-rater functions take one row per item with a column per rater; the others take long rows ``(item, rating)``.
A coefficient whose chance agreement is complete is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.measures import share


def _confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """Items rated by both, items rated alike, and their ratio."""
    counts = _confusion(df, a, b).agg(
        F.sum("n").alias("n_items"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("n_agree")
    )
    return counts.withColumn("agreement", share(F.col("n_agree"), F.col("n_items")))


def weighted_kappa(df: DataFrame, a: str, b: str, power: int = 2) -> DataFrame:
    """Kappa with distance weights ``|i - j| ** power``; ``power=0`` counts every disagreement alike (Cohen's kappa).

    Expected disagreement needs every pair of the two raters' categories. For a numeric scale it follows from moments:
    ``sum (i-j)^2 n_i m_j = N*Sii + N*Sjj - 2*Si*Sj``; for equal weights it is one minus the matched marginals.
    """
    cells = _confusion(df, a, b)
    if power == 0:
        return _unweighted(cells)
    if power != 2:
        raise ValueError("weights are defined for power 0 and 2")
    i, j, n = F.col("a").cast("double"), F.col("b").cast("double"), F.col("n")
    sums = cells.agg(
        F.sum("n").alias("n_items"),
        F.sum(n * (i - j) * (i - j)).alias("_seen"),
        F.sum(n * i).alias("_si"),
        F.sum(n * j).alias("_sj"),
        F.sum(n * i * i).alias("_sii"),
        F.sum(n * j * j).alias("_sjj"),
    )
    total = F.col("n_items").cast("double")
    expected = (total * F.col("_sii") + total * F.col("_sjj") - 2 * F.col("_si") * F.col("_sj")) / (total * total)
    return sums.select("n_items", (1 - (F.col("_seen") / total) / F.nullif(expected, F.lit(0.0))).alias("kappa"))


def _unweighted(cells: DataFrame) -> DataFrame:
    # marginals of both raters per category, from one long pass over the confusion cells
    sides = F.array(
        F.struct(F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")),
        F.struct(F.col("b").alias("c"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")),
    )
    agreed = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    long = cells.select(agreed.alias("agreed"), F.posexplode(sides).alias("side", "s"))
    per_category = long.groupBy("s.c").agg(
        F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"),
        F.sum(F.when(F.col("side") == 0, F.col("agreed")).otherwise(0)).alias("agreed"),
    )
    sums = per_category.agg(
        F.sum("na").alias("n_items"),
        F.sum("agreed").alias("n_agree"),
        F.sum(F.col("na").cast("double") * F.col("nb").cast("double")).alias("_chance"),
    )
    total = F.col("n_items").cast("double")
    po, pe = F.col("n_agree") / total, F.col("_chance") / (total * total)
    return sums.select(
        "n_items", po.alias("observed"), pe.alias("expected"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa")
    )


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters with observed and chance agreement."""
    return weighted_kappa(df, a, b, power=0)


def _item_counts(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    kept = ratings.where(F.col(rating).isNotNull())
    return kept.groupBy(F.col(item).alias("item"), F.col(rating).alias("c")).agg(F.count("*").alias("n"))


def fleiss_kappa(ratings: DataFrame, item: str, rating: str, raters: int) -> DataFrame:
    """Fleiss' kappa over the items that have exactly ``raters`` ratings."""
    cells = _item_counts(ratings, item, rating)
    sized = cells.withColumn("m", F.sum("n").over(Window.partitionBy("item"))).where(F.col("m") == raters)
    per_category = sized.groupBy("c").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")
    )
    sums = per_category.agg(
        F.sum("n").cast("double").alias("ratings"),
        F.sum("squares").cast("double").alias("squares"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("category_squares"),
    )
    items = F.col("ratings") / raters
    seen = (F.col("squares") - F.col("ratings")) / F.nullif(items * (raters * (raters - 1)), F.lit(0.0))
    chance = F.col("category_squares") / F.nullif(F.col("ratings") * F.col("ratings"), F.lit(0.0))
    return sums.select(
        items.cast("bigint").alias("n_items"), seen.alias("observed"), chance.alias("expected"),
        ((seen - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"),
    )


def krippendorff_alpha(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    """Krippendorff's nominal alpha over the items with two ratings or more; raters may be missing."""
    cells = _item_counts(ratings, item, rating)
    sized = cells.withColumn("m", F.sum("n").over(Window.partitionBy("item"))).where(F.col("m") >= 2)
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    # an item adds (m^2 - sum n^2) / (m - 1) = sum over its cells of n * (m - n) / (m - 1)
    per_category = sized.groupBy("c").agg(F.sum("n").alias("n"), F.sum(n * (m - n) / (m - 1)).alias("disagreement"))
    sums = per_category.agg(
        F.sum("n").cast("double").alias("total"),
        F.sum("disagreement").alias("disagreement"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
    )
    total = F.col("total")
    observed = F.col("disagreement") / F.nullif(total, F.lit(0.0))
    expected = (total * total - F.col("squares")) / F.nullif(total * (total - 1), F.lit(0.0))
    return sums.select(
        total.cast("bigint").alias("n_ratings"), observed.alias("observed"), expected.alias("expected"),
        (1 - observed / F.nullif(expected, F.lit(0.0))).alias("alpha"),
    )


def icc(ratings: DataFrame, item: str, score: str, raters: int) -> DataFrame:
    """ICC(1,1) from one-way analysis of variance over the items with exactly ``raters`` scores."""
    x = F.col(score).cast("double")
    items = ratings.where(x.isNotNull()).groupBy(item).agg(
        F.count("*").alias("k"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance")
    ).where(F.col("k") == raters)
    k = float(raters)
    # means and variances, not differences of large sums of squares
    sums = items.agg(F.count("*").alias("n_items"), F.var_pop("mean").alias("between"), F.avg("variance").alias("within"))
    n = F.col("n_items").cast("double")
    between = k * F.col("between") * n / F.nullif(n - 1, F.lit(0.0))
    within = F.col("within") * k / (k - 1)
    return sums.select(
        "n_items", between.alias("ms_between"), within.alias("ms_within"),
        ((between - within) / F.nullif(between + (k - 1) * within, F.lit(0.0))).alias("icc"),
    )
