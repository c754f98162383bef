"""Column profiles over the given tables."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import profile, profile_state
from cohortry.operators.quantiles import sliced_quantiles
from cohortry.plans.cohorts import TRAITS_SQL, _traits
from cohortry.plans.registry import query
from cohortry.plans.tables import DOCUMENTS_SQL, documents, r6, table

PART_COLUMNS = ("p_name", "p_brand", "p_type")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def _counts_sql(relation: str, columns, name: str = "counts") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM {relation} GROUP BY {c}" for c in columns
    )
    return f"{name} AS ({parts})"


@query("categorical_profile", f"""WITH {_counts_sql('part', (*PART_COLUMNS, 'p_partkey'))}
    SELECT "column", count(value) AS distinct_count, count(value) <= 100 AS selectable,
      CASE WHEN "column" = 'p_type' THEN 'Review value order before using as an ordered cohort filter.'
           WHEN count(value) > 100 THEN 'Too many distinct values for direct select UI; normalize or search.'
           ELSE 'Suitable for direct filter UI after research-team label review.' END AS note
    FROM counts GROUP BY "column" """)
def categorical_profile(spark, d) -> DataFrame:
    return profile.categorical_profile(table(spark, d, "part"), (*PART_COLUMNS, "p_partkey"), ordered=("p_type",))


@query("selection_fields", f"""WITH {_counts_sql('part', (*PART_COLUMNS, 'p_partkey'))}
    SELECT CASE WHEN selectable THEN 'direct_select' ELSE 'needs_normalising' END AS use, string_agg("column", ',' ORDER BY "column") AS columns
    FROM (SELECT "column", count(value) <= 100 AS selectable FROM counts GROUP BY "column") GROUP BY selectable""")
def selection_fields(spark, d) -> DataFrame:
    listed = profile.selection_fields(profile.categorical_profile(table(spark, d, "part"), (*PART_COLUMNS, "p_partkey")))
    return listed.withColumn("columns", F.array_join("columns", ","))


@query("value_frequencies", f"""WITH {DOCUMENTS_SQL}, {_counts_sql('docs', ('lang', 'source', 'quality_note', 'n_chars'))}
    SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS LAST)::INTEGER AS rank, value, count,
      round(count::DOUBLE / sum(count) OVER (PARTITION BY "column"), 6) AS ratio
    FROM counts QUALIFY rank <= 5""")
def value_frequencies(spark, d) -> DataFrame:
    columns = ("lang", "source", "quality_note", "n_chars")
    return _round(profile.value_frequencies(documents(spark, d), columns, top_n=5), "ratio")


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS minimum, max({c}) AS maximum, round(avg({c}), 4) AS mean, "
    f"round(median({c}), 6) AS median FROM lineitem" for c in LINE_NUMBERS))
def numeric_profile(spark, d) -> DataFrame:
    result = _round(profile.numeric_profile(table(spark, d, "lineitem"), LINE_NUMBERS), "median")
    return result.withColumn("mean", F.round("mean", 4))


@query("decade_histogram", """
    SELECT (floor(l_quantity / 10) * 10)::INTEGER AS decade, (floor(l_quantity / 10) * 10)::INTEGER || 's' AS label,
      count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS ratio
    FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY decade""")
def decade_histogram(spark, d) -> DataFrame:
    return _round(profile.decade_histogram(table(spark, d, "lineitem"), "l_quantity"), "ratio")


TEXT_NUMBERS = ("o_orderpriority", "priority_code", "mixed")


def _text_numbers(spark, d) -> DataFrame:
    # the digit before the dash, and a column that is a number for open orders only
    orders = table(spark, d, "orders")
    code = F.substring("o_orderpriority", 1, 1)
    mixed = F.when(F.col("o_orderstatus") == "O", F.concat(code, F.lit(".5"))).when(
        F.col("o_orderstatus") == "F", F.concat(code, F.lit("d"))
    )
    return orders.withColumn("priority_code", code).withColumn("mixed", mixed)


_TEXT_NUMBERS_SQL = """numbers AS (
  SELECT *, substr(o_orderpriority, 1, 1) AS priority_code,
    CASE o_orderstatus WHEN 'O' THEN substr(o_orderpriority, 1, 1) || '.5' WHEN 'F' THEN substr(o_orderpriority, 1, 1) || 'd' END AS mixed
  FROM orders)"""


@query("parseability_profile", f"""WITH {_TEXT_NUMBERS_SQL}, {_counts_sql('numbers', TEXT_NUMBERS)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS LAST) AS rank FROM counts),
    stats AS (SELECT "column", count(value) AS distinct_count,
        sum(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN count ELSE 0 END)::DOUBLE
          / sum(CASE WHEN value IS NOT NULL THEN count ELSE 0 END) AS ratio,
        string_agg(coalesce(value, '-'), ',' ORDER BY rank) FILTER (WHERE rank <= 10) AS examples
      FROM ranked GROUP BY "column")
    SELECT "column", distinct_count, round(ratio, 6) AS parseable_ratio, ratio = 1.0 AS numeric_parseable, examples FROM stats""")
def parseability_profile(spark, d) -> DataFrame:
    result = profile.parseability_profile(_text_numbers(spark, d), TEXT_NUMBERS)
    return _round(result, "parseable_ratio").withColumn("examples", F.array_join("examples", ",", "-"))


@query("json_parse_diagnostics", f"""WITH {TRAITS_SQL},
    parsed AS (SELECT 'props' AS "column", regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) AS v FROM traits
      UNION ALL SELECT 'trait', regexp_extract(trait, '"k"\\s*:\\s*([0-9]+)', 1) FROM traits)
    SELECT "column", count(*) AS row_count, count(TRY_CAST(v AS INTEGER)) AS parse_success_count,
      count(*) - count(TRY_CAST(v AS INTEGER)) AS parse_failure_count,
      round((count(*) - count(TRY_CAST(v AS INTEGER)))::DOUBLE / count(*), 6) AS parse_failure_ratio
    FROM parsed GROUP BY "column" """)
def json_parse_diagnostics(spark, d) -> DataFrame:
    return _round(profile.json_parse_diagnostics(_traits(spark, d), ("props", "trait"), "k"), "parse_failure_ratio")


def _length_sql(relation: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", min(length({column})) AS min_length, round(avg(length({column})), 6) AS mean_length, "
        f"round(median(length({column})), 6) AS median_length, round(quantile_cont(length({column}), 0.95), 6) AS p95_length, "
        f"max(length({column})) AS max_length FROM {relation}"
    )


def label_notes(spark, d) -> DataFrame:
    """Labels with the short notes derived from them; most toxic notes are NULL."""
    return table(spark, d, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "kept for quality").alias("quality_note"),
        F.when(F.col("toxic") == 1, "flagged as toxic").alias("toxic_note"),
    )


_NOTES_SQL = """notes AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'kept for quality' END AS quality_note,
    CASE WHEN toxic = 1 THEN 'flagged as toxic' END AS toxic_note FROM labels)"""


@query("text_length_profile", f"WITH {_NOTES_SQL} " + " UNION ALL ".join(
    _length_sql(t, c) for t, c in (("documents", "text"), ("documents", "source"), ("pages", "html"), ("notes", "quality_note"))))
def text_length_profile(spark, d) -> DataFrame:
    # each table is profiled where its texts lie, so no text is moved for a join
    result = (
        profile.text_length_profile(table(spark, d, "documents"), ("text", "source"))
        .unionByName(profile.text_length_profile(table(spark, d, "pages"), ("html",)))
        .unionByName(profile.text_length_profile(label_notes(spark, d), ("quality_note",)))
    )
    return _round(result, "mean_length", "median_length", "p95_length")


def _duplicate_sql(relation: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS distinct_count, round(1 - count({column})::DOUBLE / sum(n), 6) AS duplicate_row_ratio, "
        f"round(max(n)::DOUBLE / sum(n), 6) AS top_exact_value_ratio FROM (SELECT {column}, count(*) AS n FROM {relation} GROUP BY {column})"
    )


@query("text_duplicate_profile", f"WITH {_NOTES_SQL} " + " UNION ALL ".join(
    _duplicate_sql(t, c) for t, c in (("documents", "text"), ("pages", "html"), ("notes", "toxic_note"))))
def text_duplicate_profile(spark, d) -> DataFrame:
    result = (
        profile.text_duplicate_profile(table(spark, d, "documents"), ("text",))
        .unionByName(profile.text_duplicate_profile(table(spark, d, "pages"), ("html",)))
        .unionByName(profile.text_duplicate_profile(label_notes(spark, d), ("toxic_note",)))
    )
    return _round(result, "duplicate_row_ratio", "top_exact_value_ratio")


def _tidy_sql() -> str:
    cats, traits, texts = ("lang", "source"), ("lang",), ("text",)
    parts = [
        'SELECT \'categorical\' AS section, "column", \'distinct_count\' AS value, count(value)::DOUBLE AS count, NULL::DOUBLE AS ratio, NULL AS metric '
        'FROM counts GROUP BY "column"',
        'SELECT \'categorical\', "column", value, count::DOUBLE, round(ratio, 6), \'frequency\' FROM '
        '(SELECT *, count::DOUBLE / sum(count) OVER (PARTITION BY "column") AS ratio, '
        'row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS LAST) AS rank FROM counts) WHERE rank <= 8',
    ]
    for metric, fn in (("minimum", "min"), ("maximum", "max"), ("mean", "avg"), ("median", "median")):
        parts.append(f"SELECT 'age', 'n_chars', '{metric}', round({fn}(n_chars)::DOUBLE, 6), NULL, '{metric}' FROM documents")
    parts.append(
        "SELECT 'age', 'n_chars', (floor(n_chars / 10) * 10)::INTEGER || 's', count(*)::DOUBLE, "
        "round(count(*)::DOUBLE / sum(count(*)) OVER (), 6), 'decade' FROM documents GROUP BY floor(n_chars / 10)"
    )
    for c in traits:
        parts += [
            f"SELECT 'big_five', '{c}', 'distinct_count', count(DISTINCT {c})::DOUBLE, NULL, NULL FROM documents",
            f"SELECT 'big_five', '{c}', 'parseable_ratio', NULL, 0.0, NULL FROM documents LIMIT 1",
            f"SELECT 'big_five', '{c}', {c}, NULL, NULL, 'example' FROM (SELECT DISTINCT {c} FROM documents)",
        ]
    for c in texts:
        for metric, fn in (
            ("min_length", "min({})"), ("mean_length", "avg({})"), ("median_length", "median({})"),
            ("p95_length", "quantile_cont({}, 0.95)"), ("max_length", "max({})"),
        ):
            parts.append(f"SELECT 'narrative', '{c}', '{metric}', round({fn.format(f'length({c})')}::DOUBLE, 6), NULL, '{metric}' FROM documents")
        for metric, expr in (
            ("distinct_count", "count(v)::DOUBLE"), ("duplicate_row_ratio", "round(1 - count(v)::DOUBLE / sum(n), 6)"),
            ("top_exact_value_ratio", "round(max(n)::DOUBLE / sum(n), 6)"),
        ):
            parts.append(f"SELECT 'narrative', '{c}', '{metric}', {expr}, NULL, '{metric}' FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY {c})")
    return f"WITH {_counts_sql('documents', cats)} " + " UNION ALL ".join(f"({p})" for p in parts)


@query("profile_tidy", _tidy_sql())
def profile_tidy(spark, d) -> DataFrame:
    tidy = profile.profile_tidy(
        table(spark, d, "documents"), ("lang", "source"), "n_chars", ("lang",), ("text",), top_n=8
    )
    return _round(tidy, "count", "ratio")


_STATE_TEXTS = ("l_returnflag", "l_linestatus", "note")


def _noted_lines(spark, d) -> DataFrame:
    """Line items with a note that two of three lines lack."""
    note = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
    return table(spark, d, "lineitem").withColumn("note", note)


def _merged_lines(spark, d) -> DataFrame:
    """The state of all line items from the states of their parts, merged twice."""
    parts = profile_state.profile_states(_noted_lines(spark, d), LINE_NUMBERS, _STATE_TEXTS, by=("l_returnflag", "l_linenumber"))
    return profile_state.merge_states(profile_state.merge_states(parts, ["l_returnflag"]))


_STATE_SQL = "lines AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'line ' || l_linenumber END AS note FROM lineitem)"


def _state_sql() -> str:
    rows = []
    for c in (*LINE_NUMBERS, *_STATE_TEXTS):
        v = f"length({c})::DOUBLE" if c in _STATE_TEXTS else c
        few = c != "l_extendedprice"
        top = (f"(SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM lines "
               f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 3))") if c in _STATE_TEXTS else "NULL"
        rows.append(
            f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_ratio, "
            f"min({v}) AS minimum, max({v}) AS maximum, round(avg({v}), 4) AS mean, {f'count(DISTINCT {c})' if few else '-1'}::BIGINT AS distinct_count, "
            f"TRUE AS distinct_in_bound, TRUE AS quantiles_in_bound, {top} AS top FROM lines")
    return f"WITH {_STATE_SQL} " + " UNION ALL ".join(rows)


@query("profile_state_merged", _state_sql())
def profile_state_merged(spark, d) -> DataFrame:
    """A profile from merged states; the sketched figures are held against exact counts and their bounds."""
    lines, probs = _noted_lines(spark, d), (0.25, 0.5, 0.95)
    found = profile_state.state_profile(_merged_lines(spark, d), probs, 3)
    number = {c: F.length(c).cast("double") if c in _STATE_TEXTS else F.col(c).cast("double") for c in (*LINE_NUMBERS, *_STATE_TEXTS)}
    exact = lines.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("exact")) for c in number]).alias("rows")).select(F.inline("rows"))
    # the share of values below and up to each estimate, against the wanted rank
    long = profile.long_values(lines, number).where("value IS NOT NULL").join(F.broadcast(found.select("column", "q0", "q1", "q2")), "column")
    error = 2 * profile_state.rank_error(1000)
    inside = functools.reduce(operator.and_, [
        (F.avg((F.col("value") < F.col(f"q{i}")).cast("int")) <= p + error) & (F.avg((F.col("value") <= F.col(f"q{i}")).cast("int")) >= p - error)
        for i, p in enumerate(probs)])
    ranks = long.groupBy("column").agg(inside.alias("quantiles_in_bound"))
    few = F.col("exact") <= 4096
    shown = F.transform("top", lambda x: F.concat_ws(":", x["value"], x["count"].cast("string")))
    return _round(found.join(exact, "column").join(ranks, "column").select(
        "column", "n_rows", "n", "null_ratio", "minimum", "maximum", F.round("mean", 4).alias("mean"),
        F.when(F.col("column") != "l_extendedprice", F.col("distinct_count")).otherwise(-1).cast("bigint").alias("distinct_count"),
        F.when(few, F.col("distinct_count") == F.col("exact")).otherwise(F.abs(F.col("distinct_count") - F.col("exact")) <= 0.06 * F.col("exact")).alias("distinct_in_bound"),
        "quantiles_in_bound", F.when(F.col("column").isin(*_STATE_TEXTS), F.array_join(shown, ",")).alias("top")), "null_ratio")


@query("profile_state_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(quantile_cont({c}, 0.25), 6) AS q0, round(median({c}), 6) AS q1, "
    f"round(quantile_cont({c}, 0.95), 6) AS q2 FROM lineitem" for c in LINE_NUMBERS))
def profile_state_quantiles(spark, d) -> DataFrame:
    """Exact quantiles cut by merged states, so that no scan is needed for the sketch."""
    found = sliced_quantiles(table(spark, d, "lineitem"), LINE_NUMBERS, [0.25, 0.5, 0.95], states=_merged_lines(spark, d))
    return _round(found.select("column", "n", "q0", "q1", "q2"), "q0", "q1", "q2")
