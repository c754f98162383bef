"""Review samples, histories, follow-ups, agreement and exports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.hashing import digest_byte
from cohortry.operators import agreement, compare, review
from cohortry.plans.registry import query
from cohortry.plans.tables import CLICKS_SQL, PAIRS_SQL, PANEL_SQL, RUN, byte_sql, clicks, panel, r6, table
from cohortry.sources import history, store
from cohortry.sources.writers import tidy_export


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("stratified_sample", """
    SELECT o_orderkey, o_orderpriority, o_orderstatus, md5(o_orderkey || '|11') AS sample_key,
      row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5(o_orderkey || '|11'), o_orderkey)::INTEGER AS stratum_rank
    FROM orders QUALIFY stratum_rank <= 6""")
def stratified_sample(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return review.stratified_sample(orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 11, 6)


@query("review_packet", f"""WITH {PAIRS_SQL},
    strata AS (SELECT *, CASE WHEN stance_match IS NULL THEN 'no_answer' WHEN contradiction_candidate THEN 'flipped'
      WHEN stance_match AND concern_overlap = 0 THEN 'metric_conflict' WHEN stance_match THEN 'kept' ELSE 'shifted' END AS stratum FROM evaluated)
    SELECT sha256(agent_id || 'packet-1') AS anonymized_agent_id, run_id, comparison_id, stratum,
      row_number() OVER (PARTITION BY stratum ORDER BY md5(comparison_id || '|5'), comparison_id)::INTEGER AS stratum_rank,
      response_text_a, response_text_b, stance_match, stance_score_delta, contradiction_candidate, needs_human_review,
      'not_reviewed' AS review_status, NULL::VARCHAR AS human_stance_consistency, NULL::VARCHAR AS human_contradiction,
      NULL::VARCHAR AS human_justified_change, NULL::VARCHAR AS human_reviewer_confidence
    FROM strata QUALIFY stratum_rank <= 25""")
def review_packet(spark, d) -> DataFrame:
    evaluated = compare.evaluate_pairs(compare.repeat_pairs(panel(spark, d)))
    return review.review_packet(evaluated, seed=5, per_stratum=25, salt="packet-1")


@query("agent_history", f"""WITH {CLICKS_SQL}
    SELECT agent_id, response_id, stance, row_number() OVER (PARTITION BY agent_id ORDER BY ts, response_id) - 1 AS history_index FROM clicks""")
def agent_history(spark, d) -> DataFrame:
    histories = review.agent_histories(clicks(spark, d), ["ts", "response_id"], F.date_trunc("hour", "ts"))
    return histories.select("agent_id", "response_id", "stance", "history_index")


@query("single_agent_history", f"""WITH {CLICKS_SQL} SELECT response_id, day, stance, score FROM clicks WHERE agent_id = 7""")
def single_agent_history(spark, d) -> DataFrame:
    return review.agent_history(clicks(spark, d), 7, ["ts", "response_id"]).select("response_id", "day", "stance", "score")


def stored_clicks(spark, d) -> str:
    """Where the histories of all clicks are stored, clustered by agent and time."""
    path = store.work_path(spark, "history")
    files = 4 * spark.sparkContext.defaultParallelism
    history.save_history(clicks(spark, d), path, files, order=("ts", "response_id"), looked_up=("response_id", "event_type"))
    return path


@query("stored_single_history", f"""WITH {CLICKS_SQL} SELECT response_id, day, stance, score FROM clicks WHERE agent_id = 7""")
def stored_single_history(spark, d) -> DataFrame:
    """The history of one agent from the stored histories; only the files that can hold it are opened."""
    mine = history.read_history(spark, stored_clicks(spark, d), [7], time="ts")
    return review.agent_history(mine, 7, ["ts", "response_id"]).select("response_id", "day", "stance", "score")


@query("stored_listing", f"""WITH {CLICKS_SQL}
    SELECT agent_id, response_id, event_type, stance FROM clicks
    WHERE agent_id IN (3, 7, 11, 400) AND ts < (SELECT min(ts) + to_days(30) FROM clicks) AND event_type IN ('purchase', 'view')""")
def stored_listing(spark, d) -> DataFrame:
    """A listing of four agents' first month from the stored histories."""
    path = stored_clicks(spark, d)
    first = history.file_index(spark, path).agg((F.min("_from") + F.expr("INTERVAL 30 DAYS")).alias("t")).first()["t"]
    mine = history.read_history(spark, path, [3, 7, 11, 400], until=first, time="ts")
    return review.filter_responses(mine, {"event_type": ["purchase", "view"]}).select("agent_id", "response_id", "event_type", "stance")


@query("history_pairs", f"""WITH {CLICKS_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts, response_id) - 1 AS i FROM clicks)
    SELECT a.agent_id, a.response_id AS response_id_a, b.response_id AS response_id_b, a.stance = b.stance AS stance_match,
      b.score - a.score AS stance_score_delta,
      (a.stance = 'support' AND b.stance = 'oppose') OR (a.stance = 'oppose' AND b.stance = 'support') AS contradiction_candidate
    FROM placed a JOIN placed b ON a.agent_id = b.agent_id AND b.i = a.i + 1 WHERE a.i % 2 = 0""")
def history_pairs(spark, d) -> DataFrame:
    # each agent's answers taken two by two: the first asks, the second repeats
    placed = review.agent_histories(clicks(spark, d), ["ts", "response_id"], F.date_trunc("hour", "ts"))
    question = F.concat(F.lit("question_"), F.floor(F.col("history_index") / 2).cast("string"))
    again = F.col("history_index") % 2 == 1
    asked = placed.select(
        "run_id", "agent_id", "response_id", "stance", F.col("score").alias("stance_score"),
        F.when(again, F.concat(question, F.lit("_again"))).otherwise(question).alias("question_id"),
        F.when(again, "SAME_QUESTION_REPEAT").otherwise("ORIGINAL").alias("question_type"),
        F.when(again, question).alias("repeat_of_question_id"),
    )
    return compare.evaluate_pairs(compare.repeat_pairs(asked)).select(
        "agent_id", "response_id_a", "response_id_b", "stance_match", "stance_score_delta", "contradiction_candidate"
    )


@query("response_filter", f"""WITH {PANEL_SQL}
    SELECT response_id, r_name, question_id, stance, response_text FROM panel
    WHERE stance IN ('support', 'oppose') AND r_name IN ('AMERICA', 'EUROPE') AND question_id IN ('question_1_0', 'question_2_0')
      AND contains(response_text, 'R')""")
def response_filter(spark, d) -> DataFrame:
    kept = review.filter_responses(
        panel(spark, d),
        {"stance": ["support", "oppose"], "r_name": ["AMERICA", "EUROPE"], "question_id": ["question_1_0", "question_2_0"]},
        {"response_text": "R"},
    )
    return kept.select("response_id", "r_name", "question_id", "stance", "response_text")


@query("follow_up_candidates", f"""WITH {PAIRS_SQL}
    SELECT comparison_id, response_id_a, response_id_b, contradiction_candidate, stance_score_delta FROM evaluated WHERE needs_human_review
    QUALIFY row_number() OVER (PARTITION BY project_id, run_id, agent_id, root_question_id
      ORDER BY contradiction_candidate DESC, abs(stance_score_delta) DESC NULLS LAST, comparison_id) = 1""")
def follow_up_candidates(spark, d) -> DataFrame:
    chosen = compare.follow_up_candidates(compare.evaluate_pairs(compare.repeat_pairs(panel(spark, d))))
    return chosen.select("comparison_id", "response_id_a", "response_id_b", "contradiction_candidate", "stance_score_delta")


@query("follow_up_link", f"""WITH {CLICKS_SQL}
    SELECT o.o_orderkey AS follow_up_id, c.response_id AS parent_response_id, c.stance AS parent_stance, c.score AS parent_stance_score
    FROM orders o JOIN clicks c ON c.response_id = o.o_custkey""")
def follow_up_link(spark, d) -> DataFrame:
    # every order follows up the event whose id its customer carries
    follow_ups = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("follow_up_id"), F.col("o_custkey").alias("parent_response_id")
    )
    responses = clicks(spark, d).withColumn("stance_score", F.col("score"))
    return compare.link_follow_ups(responses, follow_ups).select(
        "follow_up_id", "parent_response_id", "parent_stance", "parent_stance_score"
    )


# --- agreement -------------------------------------------------------------------------------------------------------


def two_raters(spark, d) -> DataFrame:
    """Labels as two raters of the same question."""
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


_RATERS_SQL = "raters AS (SELECT doc_id, quality AS a, 1 - toxic AS b FROM labels)"


@query("agreement_rate", f"""WITH {_RATERS_SQL}
    SELECT count(*) AS n_items, count(*) FILTER (WHERE a = b) AS n_agree, round(count(*) FILTER (WHERE a = b)::DOUBLE / count(*), 6) AS agreement
    FROM raters WHERE a IS NOT NULL AND b IS NOT NULL""")
def agreement_rate(spark, d) -> DataFrame:
    return _round(agreement.agreement_rate(two_raters(spark, d), "a", "b"), "agreement")


@query("cohen_kappa", f"""WITH {_RATERS_SQL}, total AS (SELECT count(*)::DOUBLE AS n FROM raters),
    pa AS (SELECT a AS c, count(*) AS m FROM raters GROUP BY a), pb AS (SELECT b AS c, count(*) AS m FROM raters GROUP BY b),
    po AS (SELECT count(*) FILTER (WHERE a = b)::DOUBLE / count(*) AS po FROM raters),
    pe AS (SELECT sum(pa.m::DOUBLE * pb.m) / (any_value(n) * any_value(n)) AS pe FROM pa JOIN pb USING (c), total)
    SELECT n::BIGINT AS n_items, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa
    FROM total, po, pe""")
def cohen_kappa(spark, d) -> DataFrame:
    return _round(agreement.cohen_kappa(two_raters(spark, d), "a", "b"), "observed", "expected", "kappa")


def _scale(column: str, i: int):
    # a 1..5 scale: the base rating shifted by a hash byte of the item
    byte = digest_byte(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f"|{column}")), 256), i)
    return (F.col(column) * 3 + byte % 3).cast("int")


def scale_ratings(spark, d) -> DataFrame:
    """Two ordinal ratings per labelled document."""
    return table(spark, d, "labels").select("doc_id", _scale("quality", 0).alias("a"), _scale("toxic", 1).alias("b0")).select(
        "doc_id", "a", (5 - F.col("b0")).alias("b")
    )


_SCALE_SQL = f"""scale AS (SELECT doc_id, quality * 3 + {byte_sql("sha256(doc_id || '|quality')", 0)} % 3 AS a,
    5 - (toxic * 3 + {byte_sql("sha256(doc_id || '|toxic')", 1)} % 3) AS b FROM labels)"""


@query("weighted_kappa", f"""WITH {_SCALE_SQL}, total AS (SELECT count(*)::DOUBLE AS n FROM scale),
    pa AS (SELECT a AS i, count(*) AS m FROM scale GROUP BY a), pb AS (SELECT b AS j, count(*) AS m FROM scale GROUP BY b),
    seen AS (SELECT avg((a - b) * (a - b)) AS o FROM scale),
    chance AS (SELECT sum((i - j) * (i - j) * pa.m::DOUBLE * pb.m) / (any_value(n) * any_value(n)) AS e FROM pa, pb, total)
    SELECT n::BIGINT AS n_items, round(1 - o / nullif(e, 0), 6) AS kappa FROM total, seen, chance""")
def weighted_kappa(spark, d) -> DataFrame:
    return _round(agreement.weighted_kappa(scale_ratings(spark, d), "a", "b"), "kappa")


def ratings_long(spark, d) -> DataFrame:
    """Three raters per labelled document, the third one absent for a part of the items."""
    third = digest_byte(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|third")), 256), 0)
    rated = table(spark, d, "labels").select(
        "doc_id",
        F.explode(
            F.array(F.col("quality"), 1 - F.col("toxic"), F.when(third >= 40, (third % 2).cast("int")))
        ).alias("rating"),
    )
    return rated


_T = byte_sql("sha256(doc_id || '|third')", 0)
_LONG_SQL = f"""ratings AS (SELECT doc_id, quality AS rating FROM labels UNION ALL SELECT doc_id, 1 - toxic FROM labels
  UNION ALL SELECT doc_id, CASE WHEN {_T} >= 40 THEN {_T} % 2 END FROM labels),
cells AS (SELECT doc_id, rating AS c, count(*) AS n FROM ratings WHERE rating IS NOT NULL GROUP BY doc_id, rating),
sized AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS m FROM cells)"""


@query("fleiss_kappa", f"""WITH {_LONG_SQL}, full_items AS (SELECT * FROM sized WHERE m = 3),
    items AS (SELECT doc_id, (sum(n * n) - 3)::DOUBLE / 6 AS p FROM full_items GROUP BY doc_id),
    seen AS (SELECT count(*) AS k, avg(p) AS o FROM items),
    chance AS (SELECT sum(s * s) AS e FROM (SELECT c, sum(n)::DOUBLE / (SELECT 3 * k FROM seen) AS s FROM full_items GROUP BY c))
    SELECT k AS n_items, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / nullif(1 - e, 0), 6) AS kappa FROM seen, chance""")
def fleiss_kappa(spark, d) -> DataFrame:
    return _round(agreement.fleiss_kappa(ratings_long(spark, d), "doc_id", "rating", 3), "observed", "expected", "kappa")


@query("krippendorff_alpha", f"""WITH {_LONG_SQL}, paired AS (SELECT * FROM sized WHERE m >= 2),
    total AS (SELECT sum(n)::DOUBLE AS n FROM paired),
    units AS (SELECT doc_id, (any_value(m) * any_value(m) - sum(n * n))::DOUBLE / (any_value(m) - 1) AS x FROM paired GROUP BY doc_id),
    seen AS (SELECT sum(x) AS x FROM units),
    cats AS (SELECT sum(k * k)::DOUBLE AS q FROM (SELECT sum(n) AS k FROM paired GROUP BY c))
    SELECT n::BIGINT AS n_ratings, round(x / n, 6) AS observed, round((n * n - q) / (n * (n - 1)), 6) AS expected,
      round(1 - (x / n) / nullif((n * n - q) / (n * (n - 1)), 0), 6) AS alpha FROM total, seen, cats""")
def krippendorff_alpha(spark, d) -> DataFrame:
    return _round(agreement.krippendorff_alpha(ratings_long(spark, d), "doc_id", "rating"), "observed", "expected", "alpha")


@query("icc", f"""WITH {_SCALE_SQL}, items AS (SELECT doc_id, a + b AS s, a * a + b * b AS ss FROM scale),
    sums AS (SELECT count(*)::DOUBLE AS n, sum(s)::DOUBLE AS s, sum(ss)::DOUBLE AS ss, sum(s * s)::DOUBLE / 2 AS bt FROM items),
    ms AS (SELECT n, (bt - s * s / (2 * n)) / (n - 1) AS b, (ss - bt) / n AS w FROM sums)
    SELECT n::BIGINT AS n_items, round(b, 6) AS ms_between, round(w, 6) AS ms_within, round((b - w) / nullif(b + w, 0), 6) AS icc FROM ms""")
def icc(spark, d) -> DataFrame:
    long = scale_ratings(spark, d).unpivot("doc_id", ["a", "b"], "rater", "score")
    return _round(agreement.icc(long, "doc_id", "score", 2), "ms_between", "ms_within", "icc")


# --- exports ---------------------------------------------------------------------------------------------------------


@query("responses_long", f"""WITH {PANEL_SQL}
    SELECT 'design_market' AS design_id, 'P2' AS persona_context_level, project_id, run_id, response_id, agent_id, question_id, question_type,
      repeat_index, stance, stance_score, CASE WHEN concerns IS NOT NULL THEN to_json(concerns)::VARCHAR END AS concerns, status, error_type,
      'v1' AS export_schema_version FROM panel""")
def responses_long(spark, d) -> DataFrame:
    rows = panel(spark, d).select(
        "project_id", "run_id", "response_id", "agent_id", "question_id", "question_type", "repeat_index", "stance", "stance_score",
        "concerns", "status", "error_type",
    )
    return tidy_export(rows, {"design_id": "design_market", "persona_context_level": "P2"})


@query("comparisons_long", f"""WITH {PAIRS_SQL}
    SELECT 'design_market' AS design_id, comparison_id, 'project_panel' AS project_id, run_id, agent_id::VARCHAR AS agent_id,
      response_id_a AS response_a_id, response_id_b AS response_b_id, 'SAME_QUESTION_REPEAT' AS question_relation,
      stance_match, stance_score_delta, contradiction_candidate, needs_human_review, 'not_reviewed' AS review_status, 'v1' AS export_schema_version
    FROM evaluated""")
def comparisons_long(spark, d) -> DataFrame:
    evaluated = compare.evaluate_pairs(compare.repeat_pairs(panel(spark, d)))
    records = compare.comparison_records(evaluated, RUN.project_id, F.lit("2026-07-20 12:00:00").cast("timestamp"))
    flat = records.select(
        *[c for c in records.columns if c not in ("automatic_evaluation", "human_evaluation", "created_at")],
        "automatic_evaluation.*", "human_evaluation.review_status",
    )
    return tidy_export(flat, {"design_id": "design_market"})

