"""Pairing of related responses, pair metrics and recipes over them."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import vocab
from cohortry.functions.hashing import digest_id
from cohortry.functions.measures import hits_per_100, jaccard, mentions, share, token_set
from cohortry.operators.skew import top_per_group
from cohortry.spec import Recipe

PAIR_COLUMNS = ("response_id", "question_id", "question_type", "stance", "stance_score", "response_text", "reasoning_summary",
                "concerns", "acceptance_conditions")
METRIC_VERSION = "v1"
HUMAN_FIELDS = ("stance_consistency", "contradiction", "justified_change", "reviewer_confidence")


def flatten_responses(responses: DataFrame) -> DataFrame:
    """Structured answers as top-level columns; error rows keep NULLs."""
    parts = [F.col(f"structured_response.{c}").alias(c) for c in
             ("stance", "stance_score", "reasoning_summary", "concerns", "acceptance_conditions")]
    return responses.select("*", *parts).drop("structured_response")


def _side(df: DataFrame, keys: Sequence[str], suffix: str, extra: Sequence[str] = ()) -> DataFrame:
    """Pair columns of one side under suffixed names, beside the keys and the extra columns."""
    cols = [c for c in PAIR_COLUMNS if c in df.columns and c not in keys]
    return df.select(*keys, *extra, *[F.col(c).alias(f"{c}_{suffix}") for c in cols])


def repeat_pairs(responses: DataFrame, links: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Each repeat response beside the original it repeats, for the same project, run and agent.

    ``links(question_id, repeat_of_question_id)`` gives the repeat link unless the responses carry it. The join key is the
    original's natural key, so a repeat meets one original and no group is paired with itself. ``carry`` names columns of
    the original that the pairs keep.
    """
    repeats = responses.where(F.col("question_type") == "SAME_QUESTION_REPEAT")
    if links is not None:
        repeats = repeats.drop("repeat_of_question_id").join(links, "question_id")
    originals = responses.where(F.col("question_type") == "ORIGINAL").withColumn("root_question_id", F.col("question_id"))
    repeats = repeats.withColumn("root_question_id", F.col("repeat_of_question_id"))
    keys = [c for c in ("project_id", "run_id", "agent_id") if c in responses.columns] + ["root_question_id"]
    return _side(originals, keys, "a", carry).join(_side(repeats, keys, "b"), keys).withColumn("question_relation", F.lit("SAME_QUESTION_REPEAT"))


def condition_pairs(
    responses: DataFrame, condition: str, baseline: str, on: Sequence[str] = ("agent_id", "question_id"), carry: Sequence[str] = ()
) -> DataFrame:
    """Each response of another condition beside the baseline response with the same key.

    The baseline must hold one response per key (``check_unique`` tells); adaptive execution splits hot keys.
    """
    keys = list(on)
    base = _side(responses.where(F.col(condition) == baseline), keys, "a", carry)
    rest = _side(responses.where(F.col(condition) != baseline), keys, "b", [condition])
    return rest.join(base, keys)


def is_flip(a: Column, b: Column) -> Column:
    """Clear reversal: one side supports, the other opposes."""
    return ((a == "support") & (b == "oppose")) | ((a == "oppose") & (b == "support"))


def evaluate_pairs(pairs: DataFrame) -> DataFrame:
    """Automatic evaluation of response pairs; every measure is NULL when a side has no answer."""
    a, b = F.col("stance_a"), F.col("stance_b")
    out = pairs.withColumn("stance_match", a == b)
    out = out.withColumn("stance_score_delta", F.col("stance_score_b") - F.col("stance_score_a"))
    out = out.withColumn("contradiction_candidate", is_flip(a, b))
    out = out.withColumn("needs_human_review", ~F.col("stance_match") | F.col("contradiction_candidate"))
    for name, source in (("concern_overlap", "concerns"), ("acceptance_condition_overlap", "acceptance_conditions")):
        if f"{source}_a" in pairs.columns:
            out = out.withColumn(name, jaccard(F.col(f"{source}_a"), F.col(f"{source}_b")))
    if "reasoning_summary_a" in pairs.columns:
        words = [token_set(F.col(f"reasoning_summary_{side}")) for side in "ab"]
        out = out.withColumn("reason_overlap", jaccard(*words))
    return out.withColumn("comparison_id", comparison_id(pairs))


def comparison_id(pairs: DataFrame) -> Column:
    """Stable id of a pair over its natural key as far as it is there, and both displayed response ids."""
    key = [c for c in ("project_id", "run_id", "agent_id", "root_question_id", "question_id") if c in pairs.columns]
    return digest_id("comparison_", 32, *[F.col(c) for c in (*key, "response_id_a", "response_id_b")])


def consistency(evaluated: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Stance consistency per group over the pairs that have both answers."""
    return (
        evaluated.where(F.col("stance_match").isNotNull())
        .groupBy(*group_by)
        .agg(
            F.count("*").alias("n_pairs"),
            F.count_if("stance_match").alias("n_match"),
            F.count_if("contradiction_candidate").alias("n_contradiction"),
            F.count_if("needs_human_review").alias("n_review"),
        )
        .withColumn("stance_consistency", share(F.col("n_match"), F.col("n_pairs")))
    )


def changed_agents(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agents (or any key) whose stance changed across their answers."""
    agg = responses.where(F.col("stance").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_responses"), F.count_distinct("stance").alias("n_stances")
    )
    return agg.where(F.col("n_stances") > 1)


def change_reason(evaluated: DataFrame, changed_types: Sequence[str] = vocab.CHANGED_CONDITION_TYPES) -> DataFrame:
    """Why a pair differs: unchanged, the condition changed with the question type, or unexplained."""
    explained = F.col("question_type_b").isin(list(changed_types))
    reason = F.when(F.col("stance_match"), "unchanged").when(explained, "condition_changed").otherwise("unexplained")
    return evaluated.withColumn("change_reason", F.when(F.col("stance_match").isNotNull(), reason))


def metric_values(evaluated: DataFrame, metrics: Sequence[str]) -> dict[str, Column]:
    """Metric columns as doubles; booleans as 0 and 1."""
    types = dict(evaluated.dtypes)
    return {
        m: (F.col(m).cast("int") if types[m] == "boolean" else F.col(m)).cast("double") for m in metrics
    }


def metric_results_long(
    evaluated: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str] = ("run_id", "comparison_id"),
    uncomputed: Mapping[str, str] = vocab.UNCOMPUTED_METRICS,
) -> DataFrame:
    """One row per pair and metric, with status instead of made-up values.

    A pair without both answers gives ``error`` rows; a metric that needs a model gives ``not_computed`` rows with the
    reason, one per pair as for every other metric.
    """
    missing = F.col("stance_match").isNull()
    entries = [
        F.struct(
            F.lit(name).alias("metric_name"),
            F.when(missing, "error").otherwise("computed").alias("status"),
            value.alias("value"),
            F.when(missing, "a side has no answer").cast("string").alias("details"),
        )
        for name, value in metric_values(evaluated, metrics).items()
    ] + [
        F.struct(
            F.lit(name).alias("metric_name"),
            F.lit("not_computed").alias("status"),
            F.lit(None).cast("double").alias("value"),
            F.lit(reason).alias("details"),
        )
        for name, reason in uncomputed.items()
    ]
    review = F.coalesce(F.col("needs_human_review"), F.lit(True))
    return evaluated.select(*keys, review.alias("needs_human_review"), F.inline(F.array(*entries))).withColumn(
        "metric_version", F.lit(METRIC_VERSION)
    )


def metric_summary(long: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Count, mean, range and review flags of each metric per condition."""
    return long.groupBy(*group_by, "metric_name", "metric_version").agg(
        F.count("*").alias("n_rows"),
        F.count("value").alias("n_computed"),
        F.avg("value").alias("mean_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count_if("needs_human_review").alias("n_review"),
    )


def run_recipe(evaluated: DataFrame, recipe: Recipe) -> DataFrame:
    """A recipe's metrics per group as long rows over evaluated pairs; all metrics come from one aggregation."""
    kept = evaluated
    if recipe.filters:
        terms = [F.col(c).isin(list(v)) for c, v in recipe.filters.items()]
        kept = evaluated.where(functools.reduce(operator.and_, terms))
    values = metric_values(kept, recipe.metrics)
    aggs = [F.struct(F.count(v).alias("n"), F.avg(v).alias("value")).alias(f"m_{name}") for name, v in values.items()]
    wide = kept.groupBy(*recipe.group_by).agg(*aggs)
    entries = [
        F.struct(F.lit(name).alias("metric_name"), F.col(f"m_{name}.n").alias("n"), F.col(f"m_{name}.value").alias("value"))
        for name in recipe.metrics
    ]
    return wide.select(
        F.lit(recipe.recipe_id).alias("recipe_id"), *recipe.group_by, F.inline(F.array(*entries))
    )


def run_condition_recipe(
    responses: DataFrame, recipe: Recipe, condition: str, on: Sequence[str] = ("agent_id", "question_id")
) -> DataFrame:
    """A recipe over raw responses: every other condition is paired with ``compare_against`` and evaluated."""
    return run_recipe(evaluate_pairs(condition_pairs(responses, condition, recipe.compare_against, on)), recipe)


def comparison_records(evaluated: DataFrame, project_id: str, created_at: Column) -> DataFrame:
    """Evaluated pairs as stored comparison records, not yet reviewed."""
    automatic = F.struct("stance_match", "stance_score_delta", "contradiction_candidate", "needs_human_review")
    empty = [F.lit(None).cast("string").alias(c) for c in HUMAN_FIELDS]
    return evaluated.select(
        "comparison_id",
        F.lit(project_id).alias("project_id"),
        "run_id",
        F.col("agent_id").cast("string").alias("agent_id"),
        F.col("response_id_a").alias("response_a_id"),
        F.col("response_id_b").alias("response_b_id"),
        "question_relation",
        automatic.alias("automatic_evaluation"),
        F.struct(F.lit("not_reviewed").alias("review_status"), *empty).alias("human_evaluation"),
        created_at.alias("created_at"),
    )


def follow_up_candidates(
    evaluated: DataFrame, parent: Sequence[str] | None = None, flag: Column | None = None
) -> DataFrame:
    """One candidate per parent response: flips first, then other review cases, then the larger score change.

    ``parent`` is the natural key of the parent side, ``flag`` chooses the rows, by default those that need human review.
    """
    keys = ("project_id", "run_id", "agent_id", "root_question_id", "question_id")
    parent = [c for c in keys if c in evaluated.columns] if parent is None else list(parent)
    flagged = evaluated.where(F.col("needs_human_review") if flag is None else flag)
    order = [
        F.col("contradiction_candidate").cast("int").desc(),
        F.abs("stance_score_delta").desc_nulls_last(),
        F.col("comparison_id").asc(),
    ]
    return top_per_group(flagged, parent, order, 1, "candidate_rank").drop("candidate_rank")


def link_follow_ups(responses: DataFrame, follow_ups: DataFrame, on: Sequence[str] = ("project_id", "run_id", "agent_id")) -> DataFrame:
    """Parent response beside its follow-up record.

    Displayed response ids are short, so the natural columns of ``on`` that both tables have must agree as well.
    """
    keys = [c for c in on if c in responses.columns and c in follow_ups.columns]
    parents = responses.select(
        *keys, F.col("response_id").alias("parent_response_id"), F.col("stance").alias("parent_stance"),
        F.col("stance_score").alias("parent_stance_score"),
    )
    return follow_ups.join(parents, [*keys, "parent_response_id"])


def follow_up_records(candidates: DataFrame, question: Column, created_at: Column) -> DataFrame:
    """Follow-up records to be answered, one per candidate pair: the parent side, the question's text and a stable id."""
    own = digest_id("follow_up_", 32, F.col("comparison_id"), question)
    return candidates.select(
        own.alias("follow_up_id"), "project_id", "run_id", F.col("response_id_a").alias("parent_response_id"),
        F.col("agent_id").cast("string").alias("agent_id"),
        F.concat(F.lit("question_"), F.substring(F.sha2(own, 256), 1, 32)).alias("question_id"),
        question.alias("question_text"), F.lit(None).cast("string").alias("response_id"), created_at.alias("created_at"),
    )


def with_attribute_usage(df: DataFrame, text: str, attributes: Sequence[str]) -> DataFrame:
    """Adds how many attribute values occur in the answer text."""
    return df.withColumn("attribute_usage", mentions(F.col(text), [F.col(a) for a in attributes]))


def with_lexicon_scores(df: DataFrame, text: str, lexicons: Mapping[str, str]) -> DataFrame:
    """Adds one score per lexicon: pattern hits per 100 words."""
    return df.withColumns({name: hits_per_100(F.col(text), pattern) for name, pattern in lexicons.items()})


def fact_conflicts(df: DataFrame, text: str, pattern: str, fact: str, known: Sequence[str]) -> DataFrame:
    """Rows whose text states a value that differs from the profile fact.

    Only facts inside ``known`` are compared, so an unrelated fact is not a conflict.
    """
    stated = F.lower(F.regexp_extract(F.lower(F.col(text)), pattern, 1))
    fact_text = F.lower(F.col(fact).cast("string"))
    rows = df.withColumn("stated_value", F.nullif(stated, F.lit("")))
    return rows.where(
        F.col("stated_value").isNotNull() & fact_text.isin([k.lower() for k in known]) & (F.col("stated_value") != fact_text)
    )
