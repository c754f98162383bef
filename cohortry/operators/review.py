"""Human-review samples and packets, agent histories and response listings."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.hashing import sample_key
from cohortry.operators.compare import HUMAN_FIELDS
from cohortry.operators.skew import sequence_within_key, top_per_group


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, seed: int, per_stratum: int) -> DataFrame:
    """The first ``per_stratum`` rows of each stratum along a seeded hash order."""
    keyed = df.withColumn("sample_key", sample_key(F.col(key), seed))
    return top_per_group(keyed, strata, [F.col("sample_key").asc(), F.col(key).asc()], per_stratum, "stratum_rank")


def pair_stratum(evaluated: DataFrame) -> Column:
    """Review stratum of a pair.

    No answer, reversal, rare answer (when the pairs carry a boolean ``minority``), metrics in conflict (same stance but
    no shared concern), kept stance, other change.
    """
    match, none = F.col("stance_match"), F.lit(False)
    rare = F.col("minority") if "minority" in evaluated.columns else none
    conflict = match & (F.col("concern_overlap") == 0) if "concern_overlap" in evaluated.columns else none
    return (
        F.when(match.isNull(), "no_answer")
        .when(F.col("contradiction_candidate"), "flipped")
        .when(rare, "minority")
        .when(conflict, "metric_conflict")
        .when(match, "kept")
        .otherwise("shifted")
    )


def review_packet(evaluated: DataFrame, seed: int, per_stratum: int, salt: str) -> DataFrame:
    """Stratified pairs for human review: hashed agent, both answers, automatic metrics, empty rating fields."""
    strata = evaluated.withColumn("stratum", pair_stratum(evaluated))
    drawn = stratified_sample(strata, ["stratum"], "comparison_id", seed, per_stratum)
    anonymous = F.sha2(F.concat(F.col("agent_id").cast("string"), F.lit(salt)), 256)
    shown = [c for c in ("run_id", "comparison_id", "stratum", "stratum_rank", "response_text_a", "response_text_b",
                         "stance_match", "stance_score_delta", "contradiction_candidate", "needs_human_review")
             if c in drawn.columns]
    empty = [F.lit(None).cast("string").alias(f"human_{c}") for c in HUMAN_FIELDS]
    return drawn.select(
        anonymous.alias("anonymized_agent_id"), *shown, F.lit("not_reviewed").alias("review_status"), *empty
    )


def agent_history(responses: DataFrame, agent: str, order: Sequence[str]) -> DataFrame:
    """All responses of one agent in order."""
    return responses.where(F.col("agent_id") == agent).orderBy(*order)


def agent_histories(responses: DataFrame, order: Sequence[str], bucket: Column) -> DataFrame:
    """Every response with its place in its agent's history; see ``sequence_within_key`` for ``bucket``."""
    return sequence_within_key(responses, ["agent_id"], order, bucket, "history_index")


def filter_responses(responses: DataFrame, wanted: Mapping[str, Sequence], search: Mapping[str, str] | None = None) -> DataFrame:
    """Listing filter: OR within a column, AND across columns, literal text search on top."""
    terms = [F.col(c).isin(list(v)) for c, v in wanted.items() if v]
    terms += [F.col(c).contains(t) for c, t in (search or {}).items() if t]
    return responses.where(functools.reduce(operator.and_, terms, F.lit(True)))
