"""Constraint checks over the given tables; the rules are chosen so that some rows break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import checks, rules
from cohortry.plans.contexts import TURNS_SQL, turn_questions
from cohortry.plans.registry import query
from cohortry.plans.tables import PANEL_SQL, PEOPLE_SQL, panel_nested, people, table


@query("check_vocabulary", """
    SELECT 'vocabulary' AS rule, o_orderkey::VARCHAR AS key, 'o_orderpriority=' || o_orderpriority AS detail FROM orders
    WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL
    SELECT 'vocabulary', o_orderkey::VARCHAR, 'o_orderstatus=' || o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def check_vocabulary(spark, d) -> DataFrame:
    allowed = {"o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM"), "o_orderstatus": ("O", "F")}
    return checks.check_vocabulary(table(spark, d, "orders"), "o_orderkey", allowed)


@query("check_range_order", """
    SELECT 'range_order' AS rule, l_orderkey || '|' || l_linenumber AS key, 'l_discount > l_tax' AS detail FROM lineitem WHERE l_discount > l_tax""")
def check_range_order(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("line", F.concat_ws("|", "l_orderkey", "l_linenumber"))
    return checks.check_range_order(lines, "line", "l_discount", "l_tax")


@query("check_bounds", """
    SELECT 'bounds' AS rule, doc_id::VARCHAR AS key, 'n_chars' AS detail FROM documents WHERE n_chars < 100 OR n_chars > 5000 UNION ALL
    SELECT 'bounds', doc_id::VARCHAR, 'text' FROM documents WHERE length(text) < 200""")
def check_bounds(spark, d) -> DataFrame:
    return checks.check_bounds(table(spark, d, "documents"), "doc_id", {"n_chars": (100, 5000), "text": (200, None)})


@query("check_unique", """
    SELECT 'unique' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def check_unique(spark, d) -> DataFrame:
    return checks.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_status_payload", f"""WITH {PANEL_SQL}
    SELECT 'status_payload' AS rule, response_id AS key,
      CASE WHEN status = 'success' THEN 'success without payload' ELSE 'error without error_type' END AS detail
    FROM panel WHERE (status = 'success' AND stance = 'neutral') OR (status = 'error' AND r_name = 'ASIA')""")
def check_status_payload(spark, d) -> DataFrame:
    # neutral answers lose their text, and errors of one region their type
    broken = (
        panel_nested(spark, d)
        .withColumn("response_text", F.when(F.col("structured_response.stance") != "neutral", F.col("response_text")))
        .withColumn("error_type", F.when(F.col("r_name") != "ASIA", F.col("error_type")))
    )
    return checks.check_status_payload(broken)


@query("check_scope", f"""WITH {PEOPLE_SQL}
    SELECT 'scope' AS rule, c_custkey::VARCHAR AS key, concat_ws(',', CASE WHEN r_name <> 'ASIA' THEN 'project_id' END,
      CASE WHEN c_mktsegment <> 'BUILDING' THEN 'run_id' END) AS detail
    FROM people WHERE r_name <> 'ASIA' OR c_mktsegment <> 'BUILDING'""")
def check_scope(spark, d) -> DataFrame:
    scoped = people(spark, d).select("c_custkey", F.col("r_name").alias("project_id"), F.col("c_mktsegment").alias("run_id"))
    return checks.check_scope(scoped, "c_custkey", {"project_id": "ASIA", "run_id": "BUILDING"})


@query("check_id_pattern", """
    SELECT 'id_pattern' AS rule, page_id::VARCHAR AS key, 'url' AS detail FROM pages WHERE NOT regexp_matches(url, '^https://[A-Za-z0-9./_-]+$')""")
def check_id_pattern(spark, d) -> DataFrame:
    return checks.check_id_pattern(table(spark, d, "pages"), "page_id", {"url": r"^https://[A-Za-z0-9./_-]+$"})


@query("check_repeat_link", f"""WITH {TURNS_SQL}
    SELECT 'repeat_link' AS rule, q.question_set_id || '|' || q.question_id AS key,
      CASE WHEN t.question_id IS NULL THEN 'target not in set' ELSE 'target is not an original' END AS detail
    FROM turn_questions q LEFT JOIN turn_questions t ON t.question_set_id = q.question_set_id AND t.question_id = q.repeat_of_question_id
    WHERE q.repeat_of_question_id IS NOT NULL AND (t.question_id IS NULL OR t.question_type <> 'ORIGINAL')""")
def check_repeat_link(spark, d) -> DataFrame:
    return checks.check_repeat_link(turn_questions(spark, d))


@query("check_pair_distinct", """
    SELECT 'pair_distinct' AS rule, o_orderkey::VARCHAR AS key, (o_custkey % 50)::VARCHAR AS detail FROM orders WHERE o_custkey % 50 = o_orderkey % 50""")
def check_pair_distinct(spark, d) -> DataFrame:
    pairs = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("response_a_id"), (F.col("o_orderkey") % 50).alias("response_b_id")
    )
    return checks.check_pair_distinct(pairs, "o_orderkey", "response_a_id", "response_b_id")


@query("check_orphans", """
    SELECT 'orphan' AS rule, l_orderkey || '|' || l_linenumber AS key, l_orderkey::VARCHAR AS detail FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def check_orphans(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("line", F.concat_ws("|", "l_orderkey", "l_linenumber"))
    parents = table(spark, d, "orders").where(F.col("o_orderstatus") != "P")
    return checks.check_orphans(lines, "line", "l_orderkey", parents, "o_orderkey")


@query("check_variant_metadata", """
    SELECT 'variant_metadata' AS rule, p_partkey::VARCHAR AS key, f AS detail FROM (
      SELECT p_partkey, p_size, unnest(CASE p_type WHEN 'SMALL' THEN ['frame_label', 'framing_direction', 'modified_text']
        WHEN 'MEDIUM' THEN ['pressure_source', 'pressure_level', 'pressure_text'] WHEN 'LARGE' THEN ['original_question_id', 'repeat_index']
        ELSE ['unknown type'] END) AS f FROM part)
    WHERE f NOT IN ('frame_label', 'pressure_source', 'original_question_id') AND NOT (f = 'modified_text' AND p_size > 25)""")
def check_variant_metadata(spark, d) -> DataFrame:
    return checks.check_variant_metadata(part_variants(spark, d), "p_partkey", "kind", "metadata")


def part_variants(spark, d) -> DataFrame:
    # part types stand for variant types; every row carries a few of the fields
    kinds = F.create_map(
        F.lit("SMALL"), F.lit("FRAMING_CHANGE"), F.lit("MEDIUM"), F.lit("SOCIAL_PRESSURE"),
        F.lit("LARGE"), F.lit("SAME_QUESTION_REPEAT"),
    )
    metadata = F.create_map(
        F.lit("frame_label"), F.col("p_brand"), F.lit("pressure_source"), F.col("p_brand"),
        F.lit("original_question_id"), F.col("p_name"),
        F.lit("modified_text"), F.when(F.col("p_size") > 25, F.col("p_name")),
    )
    return table(spark, d, "part").select(
        "p_partkey", F.coalesce(F.try_element_at(kinds, F.col("p_type")), F.lit("none")).alias("kind"), metadata.alias("metadata")
    )


@query("integrity_report", """WITH v AS (
    SELECT 'orders' AS table_name, 'vocabulary' AS rule, o_orderkey::VARCHAR AS key, 'o_orderpriority=' || o_orderpriority AS detail
      FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL
    SELECT 'orders', 'vocabulary', o_orderkey::VARCHAR, 'o_orderstatus=' || o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL
    SELECT 'orders', 'pair_distinct', o_orderkey::VARCHAR, 'same member' FROM orders WHERE o_custkey % 50 = o_orderkey % 50 UNION ALL
    SELECT 'lineitem', 'range_order', l_orderkey || '|' || l_linenumber, 'l_discount > l_tax' FROM lineitem WHERE l_discount > l_tax UNION ALL
    SELECT 'customer', 'scope', c_custkey::VARCHAR, 'c_mktsegment' FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' UNION ALL
    SELECT 'documents', 'bounds', doc_id::VARCHAR, 'n_chars' FROM documents WHERE n_chars < 100 OR n_chars > 5000 UNION ALL
    SELECT 'documents', 'bounds', doc_id::VARCHAR, 'text' FROM documents WHERE length(text) < 200 UNION ALL
    SELECT 'pages', 'id_pattern', page_id::VARCHAR, 'url' FROM pages WHERE NOT regexp_matches(url, '^https://[A-Za-z0-9./_-]+$') UNION ALL
    SELECT 'part', 'variant_metadata', p_partkey::VARCHAR, f FROM (
      SELECT p_partkey, p_size, unnest(CASE p_type WHEN 'SMALL' THEN ['frame_label', 'framing_direction', 'modified_text']
        WHEN 'MEDIUM' THEN ['pressure_source', 'pressure_level', 'pressure_text'] WHEN 'LARGE' THEN ['original_question_id', 'repeat_index']
        ELSE ['unknown type'] END) AS f FROM part)
    WHERE f NOT IN ('frame_label', 'pressure_source', 'original_question_id') AND NOT (f = 'modified_text' AND p_size > 25))
    SELECT table_name, rule, key, detail, count(*) AS n_rows FROM v GROUP BY ALL UNION ALL
    SELECT 'orders', 'unique', o_orderkey::VARCHAR, count(*)::VARCHAR, count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1 UNION ALL
    SELECT 'lineitem', 'unique', l_orderkey || '|' || l_linenumber, count(*)::VARCHAR, count(*) FROM lineitem
      GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL
    SELECT 'lineitem', 'supplied_once', l_orderkey || '|' || l_suppkey, count(*)::VARCHAR, count(*) FROM lineitem
      GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1 UNION ALL
    SELECT 'lineitem', 'order_of_line', l_orderkey::VARCHAR,
      CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) THEN 'unsuitable parent' ELSE 'no parent' END, count(*) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey UNION ALL
    SELECT 'orders', 'customer_of_order', o_custkey::VARCHAR,
      CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'unsuitable parent' ELSE 'no parent' END, count(*) FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY o_custkey""")
def integrity_report(spark, d) -> DataFrame:
    names = ("orders", "lineitem", "customer", "documents", "pages")
    orders, lines, customers, documents, pages = (table(spark, d, n) for n in names)
    allowed = {"o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM"), "o_orderstatus": ("O", "F")}
    line = ("l_orderkey", "l_linenumber")
    return rules.violations({
        "orders": rules.RuledTable(orders, "o_orderkey", [
            rules.vocabulary(allowed),
            rules.condition("pair_distinct", "o_custkey % 50 = o_orderkey % 50", "same member"),
            rules.Unique(["o_orderkey"]),
            rules.Link(["o_custkey"], "customer", ["c_custkey"], "c_mktsegment <> 'BUILDING'", "customer_of_order"),
        ]),
        "lineitem": rules.RuledTable(lines, line, [
            rules.range_order("l_discount", "l_tax"),
            rules.Unique(line),
            rules.Unique(["l_orderkey", "l_suppkey"], "supplied_once"),
            rules.Link(["l_orderkey"], "orders", ["o_orderkey"], "o_orderstatus <> 'P'", "order_of_line"),
        ]),
        "customer": rules.RuledTable(customers, "c_custkey", [rules.scope({"c_mktsegment": "BUILDING"})]),
        "documents": rules.RuledTable(documents, "doc_id", [rules.bounds({"n_chars": (100, 5000), "text": (200, None)})]),
        "pages": rules.RuledTable(pages, "page_id", [rules.id_pattern({"url": r"^https://[A-Za-z0-9./_-]+$"})]),
        "part": rules.RuledTable(part_variants(spark, d), "p_partkey", [rules.variant_metadata("kind", "metadata")]),
    })
