"""Pair metrics, distributions, recipes, rare answers and vector measures over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.measures import jaccard, token_set
from cohortry.operators import compare, design, distributions, responses, semantic
from cohortry.plans.registry import query
from cohortry.plans.tables import (
    BOTH_RUNS_SQL, CLICKS_SQL, PAIRS_SQL, PANEL_SQL, PRESSURE, RUN, both_runs, clicks, panel, panel_nested, panel_pairs, people, r6, table,
)
from cohortry.sources import schemas, store, writers
from cohortry.spec import Recipe


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


# --- pairs -----------------------------------------------------------------------------------------------------------


@query("repeat_pairs", f"""WITH {PAIRS_SQL}
    SELECT project_id, run_id, agent_id, root_question_id, response_id_a, response_id_b, stance_a, stance_b, response_text_a, response_text_b FROM pairs""")
def repeat_pairs(spark, d) -> DataFrame:
    # a second project has the same run and agents but only the originals: nothing pairs across projects
    rows = panel(spark, d)
    other = rows.where(F.col("question_type") == "ORIGINAL").withColumn("project_id", F.lit("project_other"))
    return compare.repeat_pairs(rows.union(other)).select(
        "project_id", "run_id", "agent_id", "root_question_id", "response_id_a", "response_id_b", "stance_a", "stance_b",
        "response_text_a", "response_text_b",
    )


_FACT_COLUMNS = ("response_id", "stance", "stance_score", "response_text")


def stored_fact(spark, d, path: str) -> DataFrame:
    """Both runs as a bucketed table at a path."""
    name = "fact_" + path.rsplit("-", 1)[1]
    return store.save_fact(both_runs(spark, d), name, path, spark.sparkContext.defaultParallelism)


@query("fact_repeat_pairs", f"""WITH {BOTH_RUNS_SQL}
    SELECT a.project_id, a.run_id, a.agent_id, a.question_id AS root_question_id,
      {', '.join(f'{s}.{c} AS {c}_{s}' for s in 'ab' for c in _FACT_COLUMNS)}
    FROM both_runs a JOIN both_runs b ON a.run_id = b.run_id AND a.agent_id = b.agent_id AND b.repeat_of_question_id = a.question_id
    WHERE a.question_type = 'ORIGINAL' AND b.question_type = 'SAME_QUESTION_REPEAT'""")
def fact_repeat_pairs(spark, d) -> DataFrame:
    """Repeat pairs of both runs from the stored fact."""
    return store.fact_pairs(stored_fact(spark, d, store.work_path(spark, "fact")), _FACT_COLUMNS)


@query("committed_run", f"""WITH {PANEL_SQL}
    SELECT response_id, agent_id::VARCHAR AS agent_id, question_id, repeat_index, status, stance, stance_score FROM panel""")
def committed_run(spark, d) -> DataFrame:
    """The first run, committed in three lots of which one is written twice, and read back through the log."""
    root, stored = store.work_path(spark, "lots"), _stored_form(panel_nested(spark, d))
    checked = lambda some: writers.checked_responses(some, RUN.project_id, RUN.run_id)
    store.fill_lots(stored, checked, root, RUN.project_id, RUN.run_id, 3)
    again = store.in_lots(stored, "agent_id", 3).where("_lot = 1").drop("_lot")
    store.commit(checked(again), root, RUN.project_id, RUN.run_id, 1, 3, "json")
    found = compare.flatten_responses(store.read_committed(spark, root, RUN.project_id, RUN.run_id, schemas.RESPONSE))
    return found.select("response_id", "agent_id", "question_id", "repeat_index", "status", "stance", "stance_score")


def _stored_form(rows: DataFrame) -> DataFrame:
    """Nested responses with all columns of the stored record."""
    return rows.withColumn("agent_id", F.col("agent_id").cast("string")).withColumns(
        {"generation_config": F.lit(None).cast(schemas.GENERATION_CONFIG), "created_at": F.lit(None).cast("timestamp")}
    ).select(*schemas.RESPONSE_COLUMNS)


def committed_runs(spark, d) -> str:
    """Where both runs are committed: one in two lots as Parquet, the other whole as JSON lines."""
    root, rows = store.work_path(spark, "runs"), _stored_form(responses.nest_responses(both_runs(spark, d)))
    for lot in range(2):
        part = store.in_lots(rows.where(F.col("run_id") == RUN.run_id), "agent_id", 2).where(F.col("_lot") == lot)
        store.commit(part.drop("_lot"), root, RUN.project_id, RUN.run_id, lot, 2)
    store.commit(rows.where(F.col("run_id") == PRESSURE.run_id), root, RUN.project_id, PRESSURE.run_id, file_format="json")
    return root


@query("stored_runs", f"""WITH {BOTH_RUNS_SQL}
    SELECT run_id, response_id, agent_id::VARCHAR AS agent_id, question_id, repeat_index, status, stance, stance_score FROM both_runs""")
def stored_runs(spark, d) -> DataFrame:
    """Both runs from one reader, though they are stored in different formats and parts."""
    found = store.read_runs(spark, committed_runs(spark, d), schemas.RESPONSE, F.col("project_id") == RUN.project_id)
    return compare.flatten_responses(found).select(
        "run_id", "response_id", "agent_id", "question_id", "repeat_index", "status", "stance", "stance_score")


@query("run_table", f"""WITH {BOTH_RUNS_SQL}
    SELECT project_id, run_id, CASE run_id WHEN '{RUN.run_id}' THEN 2 ELSE 1 END AS lots,
      CASE run_id WHEN '{RUN.run_id}' THEN 2 ELSE 1 END::BIGINT AS committed_lots, count(*) AS stored,
      count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status <> 'success') AS failed,
      count(DISTINCT error_type)::INTEGER AS error_types
    FROM both_runs GROUP BY project_id, run_id""")
def run_table(spark, d) -> DataFrame:
    """What the writes of both runs observed, from their log."""
    return store.run_table(spark, committed_runs(spark, d))


@query("repeat_comparison", f"""WITH {PAIRS_SQL}
    SELECT comparison_id, agent_id, stance_match, stance_score_delta, contradiction_candidate, needs_human_review,
      response_text_a, response_text_b FROM evaluated""")
def repeat_comparison(spark, d) -> DataFrame:
    return compare.evaluate_pairs(compare.repeat_pairs(panel(spark, d))).select(
        "comparison_id", "agent_id", "stance_match", "stance_score_delta", "contradiction_candidate", "needs_human_review",
        "response_text_a", "response_text_b",
    )


@query("stance_consistency", f"""WITH {PAIRS_SQL}
    SELECT r_name, root_question_id, count(*) AS n_pairs, count(*) FILTER (WHERE stance_match) AS n_match,
      count(*) FILTER (WHERE contradiction_candidate) AS n_contradiction, count(*) FILTER (WHERE needs_human_review) AS n_review,
      round(count(*) FILTER (WHERE stance_match)::DOUBLE / count(*), 6) AS stance_consistency
    FROM evaluated WHERE stance_match IS NOT NULL GROUP BY r_name, root_question_id""")
def stance_consistency(spark, d) -> DataFrame:
    return _round(compare.consistency(panel_pairs(spark, d), ["r_name", "root_question_id"]), "stance_consistency")


@query("changed_agents", f"""WITH {CLICKS_SQL}
    SELECT agent_id, day, count(*) AS n_responses, count(DISTINCT stance) AS n_stances FROM clicks WHERE stance IS NOT NULL
    GROUP BY agent_id, day HAVING count(DISTINCT stance) > 1""")
def changed_agents(spark, d) -> DataFrame:
    return compare.changed_agents(clicks(spark, d), ["agent_id", "day"])


@query("set_overlap", r"""
    WITH words AS (SELECT conv_id, turn, list_distinct([w for w in regexp_split_to_array(lower(text), '[ \n\t]+') if w <> '']) AS w FROM conversations)
    SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w))::DOUBLE
      / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS reason_overlap
    FROM words a JOIN words b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def set_overlap(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", token_set(F.col("text")).alias("words"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words"))
    pairs = turns.join(following, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", r6(jaccard(F.col("words"), F.col("next_words"))).alias("reason_overlap"))


@query("pair_overlaps", f"""WITH {PAIRS_SQL}
    SELECT comparison_id, round(concern_overlap, 6) AS concern_overlap, round(acceptance_condition_overlap, 6) AS acceptance_condition_overlap,
      round(reason_overlap, 6) AS reason_overlap
    FROM evaluated""")
def pair_overlaps(spark, d) -> DataFrame:
    evaluated = compare.evaluate_pairs(compare.repeat_pairs(panel(spark, d)))
    return _round(
        evaluated.select("comparison_id", "concern_overlap", "acceptance_condition_overlap", "reason_overlap"),
        "concern_overlap", "acceptance_condition_overlap", "reason_overlap",
    )


_BOTH_SQL = f"""{BOTH_RUNS_SQL},
condition_pairs AS (
  SELECT b.condition, a.agent_id, a.question_id, a.response_id AS response_id_a, b.response_id AS response_id_b, b.r_name,
    a.stance AS stance_a, b.stance AS stance_b, b.stance_score - a.stance_score AS stance_score_delta,
    a.stance = b.stance AS stance_match,
    (a.stance = 'support' AND b.stance = 'oppose') OR (a.stance = 'oppose' AND b.stance = 'support') AS contradiction_candidate
  FROM both_runs a JOIN both_runs b USING (agent_id, question_id) WHERE a.condition = 'ORIGINAL' AND b.condition <> 'ORIGINAL')"""


def condition_pairs(spark, d) -> DataFrame:
    """Evaluated pairs of the pressure condition against the original one."""
    return compare.evaluate_pairs(compare.condition_pairs(both_runs(spark, d), "condition", "ORIGINAL", carry=("r_name",)))


@query("condition_vs_baseline", f"""WITH {_BOTH_SQL}
    SELECT condition, agent_id, question_id, response_id_a, response_id_b, stance_match, stance_score_delta, contradiction_candidate
    FROM condition_pairs""")
def condition_vs_baseline(spark, d) -> DataFrame:
    return condition_pairs(spark, d).select(
        "condition", "agent_id", "question_id", "response_id_a", "response_id_b", "stance_match", "stance_score_delta",
        "contradiction_candidate",
    )


@query("change_reason", f"""WITH {_BOTH_SQL}
    SELECT r_name, CASE WHEN stance_match THEN 'unchanged' WHEN stance_match IS NOT NULL THEN 'condition_changed' END AS change_reason,
      count(*) AS n FROM condition_pairs GROUP BY ALL""")
def change_reason(spark, d) -> DataFrame:
    # the pressure condition is the changed question type of every b side
    pairs = condition_pairs(spark, d).withColumn("question_type_b", F.col("condition"))
    return compare.change_reason(pairs).groupBy("r_name", "change_reason").agg(F.count("*").alias("n"))


# --- texts -----------------------------------------------------------------------------------------------------------


@query("attribute_usage", """
    SELECT p_partkey, contains(lower(p_name), lower(p_type))::INTEGER + contains(lower(p_name), lower(p_brand))::INTEGER
      + contains(lower(p_name), p_size::VARCHAR)::INTEGER AS attribute_usage FROM part""")
def attribute_usage(spark, d) -> DataFrame:
    used = compare.with_attribute_usage(table(spark, d, "part"), "p_name", ["p_type", "p_brand", "p_size"])
    return used.select("p_partkey", "attribute_usage")


# fixed values: lexicons of the example scores
LEXICONS = {
    "specificity": r"[0-9]+",
    "defensiveness": r"(?:the|un|der|que)",
    "clarity": r"(?:yes|no|in|la)",
}


def _lexicon_sql(pattern: str) -> str:
    words = r"len([w for w in regexp_split_to_array(text, '[ \n\t]+') if w <> ''])"
    return f"round(len(regexp_extract_all(lower(text), '{pattern}')) * 100::DOUBLE / nullif({words}, 0), 6)"


@query("lexicon_score", "SELECT conv_id, turn, " + ", ".join(
    f"{_lexicon_sql(p)} AS {n}" for n, p in LEXICONS.items()) + " FROM conversations")
def lexicon_score(spark, d) -> DataFrame:
    scored = compare.with_lexicon_scores(table(spark, d, "conversations"), "text", LEXICONS)
    return _round(scored.select("conv_id", "turn", *LEXICONS), *LEXICONS)


@query("fact_conflict", """
    SELECT p_partkey, p_name, p_type, regexp_extract(lower(p_name), '^(small|large)', 1) AS stated_value FROM part
    WHERE regexp_extract(lower(p_name), '^(small|large)', 1) <> '' AND lower(p_type) IN ('small', 'large')
      AND regexp_extract(lower(p_name), '^(small|large)', 1) <> lower(p_type)""")
def fact_conflict(spark, d) -> DataFrame:
    found = compare.fact_conflicts(table(spark, d, "part"), "p_name", "^(small|large)", "p_type", ["SMALL", "LARGE"])
    return found.select("p_partkey", "p_name", "p_type", "stated_value")


# --- distributions ---------------------------------------------------------------------------------------------------


@query("stance_distribution", f"""WITH {CLICKS_SQL}
    SELECT CASE WHEN grouping(event_type) = 0 AND grouping(arm) = 0 THEN 'segment+variant' WHEN grouping(event_type) = 0 THEN 'segment'
      WHEN grouping(arm) = 0 THEN 'variant' ELSE 'overall' END AS level, event_type, arm, stance, count(*) AS n,
      round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY grouping(event_type), grouping(arm), event_type, arm), 6) AS share
    FROM clicks GROUP BY GROUPING SETS ((stance), (event_type, stance), (arm, stance), (event_type, arm, stance))""")
def stance_distribution(spark, d) -> DataFrame:
    return _round(distributions.stance_distribution(clicks(spark, d), "stance", "event_type", "arm"), "share")


@query("panel_stance_distribution", f"""WITH {PANEL_SQL}
    SELECT CASE WHEN grouping(r_name) = 0 AND grouping(question_id) = 0 THEN 'segment+variant' WHEN grouping(r_name) = 0 THEN 'segment'
      WHEN grouping(question_id) = 0 THEN 'variant' ELSE 'overall' END AS level, r_name, question_id, stance, count(*) AS n,
      round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY grouping(r_name), grouping(question_id), r_name, question_id), 6) AS share
    FROM panel GROUP BY GROUPING SETS ((stance), (r_name, stance), (question_id, stance), (r_name, question_id, stance))""")
def panel_stance_distribution(spark, d) -> DataFrame:
    # error rows keep a NULL stance, which the level column tells from subtotals
    return _round(distributions.stance_distribution(panel(spark, d), "stance", "r_name", "question_id"), "share")


@query("item_frequency", f"""WITH {PANEL_SQL},
    grouped AS (SELECT nullif(r_name, 'ASIA') AS r_name, concerns FROM panel),
    sizes AS (SELECT r_name AS r0, count(*) AS m FROM grouped GROUP BY r_name)
    SELECT r_name, item, count(*) AS n, round(count(*)::DOUBLE / any_value(m), 6) AS share
    FROM (SELECT r_name, unnest(concerns) AS item FROM grouped) g JOIN sizes s ON g.r_name IS NOT DISTINCT FROM s.r0 GROUP BY r_name, item""")
def item_frequency(spark, d) -> DataFrame:
    # one region loses its name: rows without a group are a group
    rows = panel(spark, d).withColumn("r_name", F.nullif("r_name", F.lit("ASIA")))
    return _round(distributions.item_frequency(rows, ["r_name"], "concerns"), "share")


@query("distribution_shift", f"""WITH {CLICKS_SQL},
    halves AS (SELECT * REPLACE (nullif(event_type, 'click') AS event_type, nullif(arm, 'C') AS arm),
      CASE WHEN day < '2024-01-16' THEN 'first' ELSE 'second' END AS half FROM clicks),
    shares AS (SELECT arm, half, event_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY arm, half) AS s FROM halves GROUP BY arm, half, event_type),
    sides AS (SELECT arm, event_type, coalesce(sum(s) FILTER (WHERE half = 'first'), 0) AS p, coalesce(sum(s) FILTER (WHERE half = 'second'), 0) AS q
      FROM shares GROUP BY arm, event_type)
    SELECT arm, round(sum(abs(p - q)) / 2, 6) AS total_variation FROM sides GROUP BY arm""")
def distribution_shift(spark, d) -> DataFrame:
    # one category and one group are NULL
    rows = clicks(spark, d).withColumns({"event_type": F.nullif("event_type", F.lit("click")), "arm": F.nullif("arm", F.lit("C"))})
    halves = rows.withColumn("half", F.when(F.col("day") < "2024-01-16", "first").otherwise("second"))
    return _round(
        distributions.distribution_shift(halves, ["arm"], "event_type", "half", "first", "second"), "total_variation"
    )


# --- rare answers ----------------------------------------------------------------------------------------------------

_MARKED_SQL = f"""{PANEL_SQL},
marked AS (SELECT response_id, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, substr(question_id, 1, 10) AS question_id, concat_ws('|', stance, array_to_string(list_sort(concerns), ','),
    array_to_string(list_sort(acceptance_conditions), ',')) AS signature
  FROM panel WHERE status = 'success'),
counted AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, question_id, signature) AS signature_count FROM marked)"""


def marked_panel(spark, d) -> DataFrame:
    """Successful panel answers with their signature."""
    ok = panel(spark, d).where(F.col("status") == "success")
    mark = distributions.signature(F.col("stance"), F.col("concerns"), F.col("acceptance_conditions"))
    # one segment has no name, and questions are the priorities
    segment, topic = F.nullif("c_mktsegment", F.lit("BUILDING")), F.substring("question_id", 1, 10)
    return ok.select("response_id", segment.alias("c_mktsegment"), topic.alias("question_id"), mark.alias("signature"))


@query("minority_candidates", f"WITH {_MARKED_SQL} SELECT * FROM counted WHERE signature_count <= 1")
def minority_candidates(spark, d) -> DataFrame:
    return distributions.minority_candidates(marked_panel(spark, d), ["c_mktsegment", "question_id"], "signature", "response_id", 1)


@query("minority_quantile", f"""WITH {_MARKED_SQL},
    signatures AS (SELECT DISTINCT c_mktsegment, question_id, signature, signature_count FROM counted),
    ranked AS (SELECT *, percent_rank() OVER (PARTITION BY c_mktsegment, question_id ORDER BY signature_count) AS pr FROM signatures)
    SELECT c.* FROM counted c JOIN ranked r ON c.c_mktsegment IS NOT DISTINCT FROM r.c_mktsegment AND c.question_id = r.question_id
      AND c.signature = r.signature WHERE r.pr <= 0.6""")
def minority_quantile(spark, d) -> DataFrame:
    return distributions.minority_by_quantile(
        marked_panel(spark, d), ["c_mktsegment", "question_id"], "signature", "response_id", 0.6
    )


# --- design and metrics ----------------------------------------------------------------------------------------------


@query("condition_matrix", """
    WITH designs AS (SELECT p_partkey AS design_id, ['ORIGINAL', 'PARAPHRASE', 'FRAMING_CHANGE', 'SOCIAL_PRESSURE'] AS v, ['P1', 'P2', 'P3'] AS l,
      CASE WHEN p_type IN ('SMALL', 'LARGE') THEN ['mock_baseline'] ELSE ['mock_baseline', 'mock_high_consistency'] END AS m FROM part),
    cells AS (SELECT design_id, question_variant_type, persona_context_level, model_condition_id FROM designs,
      unnest(v) a(question_variant_type), unnest(l) b(persona_context_level), unnest(m) c(model_condition_id))
    SELECT *, 'condition_' || substr(sha256(design_id || '|' || question_variant_type || '|' || persona_context_level || '|' || model_condition_id), 1, 16)
      AS condition_id FROM cells""")
def condition_matrix(spark, d) -> DataFrame:
    array = lambda *v: F.array(*[F.lit(x) for x in v])
    models = F.when(F.col("p_type").isin("SMALL", "LARGE"), array("mock_baseline")).otherwise(
        array("mock_baseline", "mock_high_consistency")
    )
    designs = table(spark, d, "part").select(
        F.col("p_partkey").alias("design_id"),
        array("ORIGINAL", "PARAPHRASE", "FRAMING_CHANGE", "SOCIAL_PRESSURE").alias("question_variant_type"),
        array("P1", "P2", "P3").alias("persona_context_level"),
        models.alias("model_condition_id"),
    )
    return design.condition_matrix(designs, ["design_id"], ["question_variant_type", "persona_context_level", "model_condition_id"])


METRICS = ("stance_match", "stance_score_delta", "contradiction_candidate", "concern_overlap")


def _long_sql() -> str:
    rows = [
        f"SELECT run_id, comparison_id, r_name, coalesce(needs_human_review, true) AS needs_human_review, '{m}' AS metric_name, "
        f"CASE WHEN stance_match IS NULL THEN 'error' ELSE 'computed' END AS status, {m}::{'INTEGER::' if m != 'concern_overlap' else ''}DOUBLE AS value, "
        "CASE WHEN stance_match IS NULL THEN 'a side has no answer' END AS details, 'v1' AS metric_version FROM evaluated"
        for m in METRICS
    ]
    reasons = {
        "semantic_similarity": "needs vectors of the answers", "nli_contradiction": "needs an inference model",
        "llm_judge_contradiction": "needs a judging model", "llm_judge_reason_retention": "needs a judging model",
    }
    rows += [
        f"SELECT run_id, comparison_id, r_name, coalesce(needs_human_review, true), '{m}', 'not_computed', NULL, "
        f"'{r}', 'v1' FROM evaluated" for m, r in reasons.items()
    ]
    return f"{PAIRS_SQL}, long AS ({' UNION ALL '.join(rows)})"


@query("metric_results_long", f"""WITH {_long_sql()}
    SELECT run_id, comparison_id, needs_human_review, metric_name, status, round(value, 6) AS value, details, metric_version FROM long""")
def metric_results_long(spark, d) -> DataFrame:
    evaluated = compare.evaluate_pairs(compare.repeat_pairs(panel(spark, d)))
    return _round(compare.metric_results_long(evaluated, METRICS), "value")


@query("metric_summary", f"""WITH {_long_sql()}
    SELECT r_name, metric_name, metric_version, count(*) AS n_rows, count(value) AS n_computed, round(avg(value), 6) AS mean_value,
      round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, count(*) FILTER (WHERE needs_human_review) AS n_review
    FROM long GROUP BY r_name, metric_name, metric_version""")
def metric_summary(spark, d) -> DataFrame:
    long = compare.metric_results_long(panel_pairs(spark, d), METRICS, ["run_id", "comparison_id", "r_name"])
    return _round(compare.metric_summary(long, ["r_name"]), "mean_value", "min_value", "max_value")


RECIPE = Recipe(
    "recipe_question_variation_consistency_v1", ("c_mktsegment", "root_question_id"),
    ("stance_match", "stance_score_delta", "concern_overlap", "contradiction_candidate", "needs_human_review"),
    filters={"r_name": ("ASIA", "EUROPE", "AFRICA")},
)


@query("recipe_summary", f"WITH {PAIRS_SQL} " + " UNION ALL ".join(
    f"SELECT '{RECIPE.recipe_id}' AS recipe_id, c_mktsegment, root_question_id, '{m}' AS metric_name, count({m}) AS n, "
    f"round(avg({m}::{'DOUBLE' if m == 'concern_overlap' else 'INTEGER'}), 6) AS value "
    "FROM evaluated WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY c_mktsegment, root_question_id"
    for m in RECIPE.metrics))
def recipe_summary(spark, d) -> DataFrame:
    return _round(compare.run_recipe(panel_pairs(spark, d), RECIPE), "value")


CONDITION_RECIPE = Recipe("recipe_pressure_v1", ("condition", "question_id"), ("stance_match", "stance_score_delta", "contradiction_candidate"))


@query("condition_recipe", f"WITH {_BOTH_SQL} " + " UNION ALL ".join(
    f"SELECT 'recipe_pressure_v1' AS recipe_id, condition, question_id, '{m}' AS metric_name, count({m}) AS n, "
    f"round(avg({m}::INTEGER), 6) AS value FROM condition_pairs GROUP BY condition, question_id"
    for m in CONDITION_RECIPE.metrics))
def condition_recipe(spark, d) -> DataFrame:
    return _round(compare.run_condition_recipe(both_runs(spark, d), CONDITION_RECIPE, "condition"), "value")


# --- vectors ---------------------------------------------------------------------------------------------------------


@query("cosine_similarity", """
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS semantic_similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    pairs = semantic.pair_similarity(vectors.join(following, "vec_id"), "embedding", "next_embedding")
    return _round(pairs.select("vec_id", "semantic_similarity"), "semantic_similarity")


@query("semantic_outliers", """
    WITH cells AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    means AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
    centroids AS (SELECT label, list(x ORDER BY i) AS c FROM means GROUP BY label),
    far AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], c) AS distance FROM embeddings JOIN centroids USING (label))
    SELECT vec_id, label, round(distance, 6) AS distance,
      row_number() OVER (PARTITION BY label ORDER BY round(distance, 9) DESC NULLS LAST, vec_id)::INTEGER AS outlier_rank
    FROM far QUALIFY outlier_rank <= 5""")
def semantic_outliers(spark, d) -> DataFrame:
    return _round(semantic.semantic_outliers(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 5), "distance")
