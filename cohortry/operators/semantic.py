"""Vector measures for answers that have embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.measures import cosine
from cohortry.operators.skew import null_safe_join, top_per_group


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group.

    Vectors are summed whole by a partial aggregate, so each map task sends one vector per group.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.where(F.col(vector).isNotNull()).groupBy(group).agg(vector_to_array(mean).alias("centroid"))


def pair_similarity(pairs: DataFrame, a: str, b: str, name: str = "semantic_similarity") -> DataFrame:
    """Adds the cosine of two vector columns."""
    return pairs.withColumn(name, cosine(F.col(a), F.col(b)))


def centroid_similarity(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """Cosine of every row's vector to its group's mean; rows without a group are a group.

    Spark broadcasts mean vectors of few bytes, so the table's vectors stay in place; otherwise adaptive execution splits
    large groups.
    """
    joined = null_safe_join(df.select(key, group, vector), centroids(df, group, vector), [group])
    return pair_similarity(joined, vector, "centroid", "similarity").select(key, group, "similarity")


def semantic_outliers(df: DataFrame, key: str, group: str, vector: str, n: int) -> DataFrame:
    """The ``n`` rows of each group that lie farthest from its mean vector."""
    far = centroid_similarity(df, key, group, vector).withColumn("distance", 1 - F.col("similarity")).drop("similarity")
    return top_per_group(far, [group], [F.round("distance", 9).desc_nulls_last(), F.col(key).asc()], n, "outlier_rank")
