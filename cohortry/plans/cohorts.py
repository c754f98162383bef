"""Cohort filters, samples, options and inspection over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.json_fields import json_integer, json_label
from cohortry.operators import cohort, inspect, options, sampling
from cohortry.plans.registry import query
from cohortry.plans.tables import DOCUMENTS_SQL, EVENTS, PARTS, PEOPLE, PEOPLE_SQL, documents, people, r6, table
from cohortry.spec import CohortFilter, CohortRequest, SamplingSpec, TableSpec, TraitFilter

TARGET = CohortFilter(
    PEOPLE, minimum=500, maximum=8500, values={"regions": ("ASIA", "EUROPE"), "segments": ("BUILDING", "MACHINERY")}
)
TARGET_SQL = "c_acctbal >= 500 AND c_acctbal <= 8500 AND r_name IN ('ASIA', 'EUROPE') AND c_mktsegment IN ('BUILDING', 'MACHINERY')"
SAMPLE = SamplingSpec(sample_size=20, seed=42)
SAMPLE_SQL = f"""sample AS (
  SELECT c_custkey, sample_key, row_number() OVER (ORDER BY sample_key, c_custkey) AS sample_rank
  FROM (SELECT DISTINCT c_custkey, md5(c_custkey || '|42') AS sample_key FROM people WHERE {TARGET_SQL})
  QUALIFY sample_rank <= 20)"""
LINES = TableSpec(id_column="l_orderkey", range_column="l_quantity")
REQUEST = CohortRequest("asia_europe_builders", TARGET, SAMPLE)


@query("cohort_filter_range", f"""WITH {PEOPLE_SQL}
    SELECT c_custkey, c_acctbal FROM people WHERE c_acctbal >= 1000 AND c_acctbal <= 5000""")
def cohort_filter_range(spark, d) -> DataFrame:
    wanted = CohortFilter(PEOPLE, minimum=1000, maximum=5000)
    return cohort.filter_cohort(people(spark, d), wanted).select("c_custkey", "c_acctbal")


@query("cohort_filter_multi", f"WITH {PEOPLE_SQL} SELECT c_custkey, r_name, n_name, c_mktsegment FROM people WHERE {TARGET_SQL}")
def cohort_filter_multi(spark, d) -> DataFrame:
    return cohort.filter_cohort(people(spark, d), TARGET).select("c_custkey", "r_name", "n_name", "c_mktsegment")


@query("cohort_filter_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(p_name, 'old b')")
def cohort_filter_search(spark, d) -> DataFrame:
    wanted = CohortFilter(PARTS, search="old b")
    return cohort.filter_cohort(table(spark, d, "part"), wanted).select("p_partkey", "p_name", "p_brand")


@query("cohort_filter_json_range", """
    SELECT event_id, user_id, TRY_CAST(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) AS INTEGER) AS k
    FROM events WHERE TRY_CAST(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) AS INTEGER) BETWEEN 40 AND 60""")
def cohort_filter_json_range(spark, d) -> DataFrame:
    wanted = CohortFilter(EVENTS, traits={"props": TraitFilter(40, 60)})
    kept = cohort.filter_cohort(table(spark, d, "events"), wanted)
    return kept.select("event_id", "user_id", json_integer(F.col("props"), "k").alias("k"))


def _traits(spark, d) -> DataFrame:
    # a trait text with score and label, and an unreadable one for error events
    events = table(spark, d, "events")
    text = F.concat(F.lit('{"k": '), json_integer(F.col("props"), "k"), F.lit(', "label": "'), "event_type", F.lit('"}'))
    return events.withColumn("trait", F.when(F.col("event_type") == "error", "invalid-json").otherwise(text))


TRAITS_SQL = """traits AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'invalid-json'
    ELSE '{"k": ' || regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) || ', "label": "' || event_type || '"}' END AS trait
  FROM events)"""


@query("json_label_filter", f"""WITH {TRAITS_SQL}
    SELECT event_id, regexp_extract(trait, '"label"\\s*:\\s*"([^"\\n]+)"', 1) AS label FROM traits
    WHERE regexp_extract(trait, '"label"\\s*:\\s*"([^"\\n]+)"', 1) IN ('purchase', 'view')
      AND TRY_CAST(regexp_extract(trait, '"k"\\s*:\\s*([0-9]+)', 1) AS INTEGER) >= 10""")
def json_label_filter(spark, d) -> DataFrame:
    wanted = CohortFilter(EVENTS, traits={"trait": TraitFilter(score_min=10, labels=("purchase", "view"))})
    return cohort.filter_cohort(_traits(spark, d), wanted).select("event_id", json_label(F.col("trait"), "label").alias("label"))


@query("cohort_count", f"WITH {PEOPLE_SQL} SELECT count(*) AS matching_count FROM people WHERE {TARGET_SQL}")
def cohort_count(spark, d) -> DataFrame:
    return cohort.matching_count(people(spark, d), TARGET)


@query("sample_ids", f"WITH {PEOPLE_SQL}, {SAMPLE_SQL} SELECT c_custkey, sample_key, sample_rank FROM sample")
def sample_ids(spark, d) -> DataFrame:
    return cohort.draw_sample(people(spark, d), TARGET, SAMPLE)


@query("sample_ids_large", """
    SELECT l_orderkey, sample_key, sample_rank FROM (
      SELECT l_orderkey, sample_key, row_number() OVER (ORDER BY sample_key, l_orderkey) AS sample_rank
      FROM (SELECT DISTINCT l_orderkey, md5(l_orderkey || '|7') AS sample_key FROM lineitem WHERE l_quantity >= 2))
    WHERE sample_rank <= 60000""")
def sample_ids_large(spark, d) -> DataFrame:
    lines = CohortFilter(LINES, minimum=2)
    return cohort.draw_sample(table(spark, d, "lineitem"), lines, SamplingSpec(60_000, 7))




@query("sample_states_merged", f"""WITH {PEOPLE_SQL},
    keyed AS (SELECT DISTINCT r_name, c_custkey, md5(c_custkey || '|42') AS sample_key FROM people),
    parts AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY sample_key, c_custkey) AS place FROM keyed)
    SELECT r_name AS part, c_custkey, sample_key FROM parts WHERE place <= 30
    UNION ALL SELECT 'all', c_custkey, sample_key FROM (
      SELECT *, row_number() OVER (ORDER BY sample_key, c_custkey) AS place FROM keyed) WHERE place <= 30""")
def sample_states_merged(spark, d) -> DataFrame:
    """The bottom 30 of every region, and the sample of all regions from these alone."""
    states = sampling.bottom_states(people(spark, d), "c_custkey", 42, 30, ["r_name"])
    whole = sampling.merge_bottom(states, "c_custkey", 30)
    return states.withColumnRenamed("r_name", "part").union(whole.select(F.lit("all"), "c_custkey", "sample_key"))


@query("sample_feasibility", f"""WITH {PEOPLE_SQL}
    SELECT count(DISTINCT c_custkey) AS matching_ids, 20::BIGINT AS sample_size,
      CASE WHEN count(DISTINCT c_custkey) = 0 THEN 'matching count is zero'
           WHEN count(DISTINCT c_custkey) < 20 THEN 'sample_size is larger than matching count' ELSE 'ok' END AS status
    FROM people WHERE {TARGET_SQL}""")
def sample_feasibility(spark, d) -> DataFrame:
    return cohort.sample_feasibility(people(spark, d), TARGET, SAMPLE)


@query("cohort_preview", f"""WITH {PEOPLE_SQL}, {SAMPLE_SQL}
    SELECT sample_rank, c_custkey, r_name, n_name, c_mktsegment, c_acctbal FROM sample JOIN people USING (c_custkey)""")
def cohort_preview(spark, d) -> DataFrame:
    rows = people(spark, d)
    return cohort.preview(rows, cohort.draw_sample(rows, TARGET, SAMPLE), "c_custkey", PEOPLE.preview)


@query("missing_ids", f"""WITH {PEOPLE_SQL}
    SELECT DISTINCT o_custkey AS c_custkey FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM people WHERE {TARGET_SQL})""")
def missing_ids(spark, d) -> DataFrame:
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return cohort.missing_ids(buyers, cohort.filter_cohort(people(spark, d), TARGET), "c_custkey")


_PEOPLE_CELLS = ("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
_PEOPLE_CELLS_SQL = ", ".join(
    f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in [*(f"{c}::VARCHAR" for c in _PEOPLE_CELLS), "c_acctbal::DECIMAL(18,4)::VARCHAR"]
)


@query("cohort_manifest", f"""WITH {PEOPLE_SQL}, {SAMPLE_SQL},
    hashed AS (SELECT *, md5(concat_ws(',', {_PEOPLE_CELLS_SQL})) AS digest FROM people),
    source AS (SELECT sum(('0x' || substr(digest, 1, 16))::UBIGINT)::VARCHAR || '-' || sum(('0x' || substr(digest, 17, 16))::UBIGINT)::VARCHAR
                        AS fingerprint, count(*) AS row_count, count(*) FILTER (WHERE {TARGET_SQL}) AS matching_count FROM hashed),
    drawn AS (SELECT count(*) AS sampled FROM sample)
    SELECT 'cohort_' || substr(sha256(fingerprint || '|' || '{TARGET.canonical_json()}' || '|' || '{SAMPLE.canonical_json()}'), 1, 16) AS cohort_id,
      'asia_europe_builders' AS name, fingerprint AS source_fingerprint, row_count, matching_count,
      '{TARGET.canonical_json()}' AS canonical_filter_json, sha256('{TARGET.canonical_json()}') AS filter_hash,
      'c_acctbal >= 500; c_acctbal <= 8500; r_name in (ASIA, EUROPE); c_mktsegment in (BUILDING, MACHINERY)' AS human_readable_filter,
      20::BIGINT AS sample_size, 42::BIGINT AS seed, 'deterministic_random' AS method, sampled
    FROM source, drawn""")
def cohort_manifest(spark, d) -> DataFrame:
    rows = people(spark, d)
    cells = [*[F.col(c) for c in _PEOPLE_CELLS], F.col("c_acctbal").cast("decimal(18,4)")]
    row = cohort.manifest(rows, REQUEST, cohort.draw_sample(rows, TARGET, SAMPLE), inspect.dataset_fingerprint(rows, cells))
    return row.drop("filters")


@query("safe_projection", "SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer")
def safe_projection(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    return cohort.safe_projection(
        customer, ("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey", "c_phone"), inspect.private_columns(customer)
    )


# --- options ---------------------------------------------------------------------------------------------------------


@query("option_values", "SELECT DISTINCT p_brand AS value FROM part")
def option_values(spark, d) -> DataFrame:
    return options.option_values(table(spark, d, "part"), "p_brand", PARTS.list_fields.values())


@query("option_value_counts", "SELECT source AS value, count(*) AS count FROM documents GROUP BY source")
def option_value_counts(spark, d) -> DataFrame:
    return options.option_value_counts(table(spark, d, "documents"), "source")


@query("dependent_options", f"WITH {PEOPLE_SQL} SELECT DISTINCT n_name FROM people WHERE r_name IN ('ASIA', 'AFRICA')")
def dependent_options(spark, d) -> DataFrame:
    return options.dependent_options(people(spark, d), "r_name", "n_name", ("ASIA", "AFRICA"))


@query("option_search", "SELECT DISTINCT p_name FROM part WHERE contains(p_name, 'ring')")
def option_search(spark, d) -> DataFrame:
    return options.option_search(table(spark, d, "part"), "p_name", "ring")


@query("invalid_child_values", f"""WITH {PEOPLE_SQL}
    SELECT DISTINCT n_name FROM people WHERE n_name NOT IN (SELECT n_name FROM people WHERE r_name IN ('ASIA', 'EUROPE'))""")
def invalid_child_values(spark, d) -> DataFrame:
    rows = people(spark, d)
    return options.invalid_child_values(rows, "r_name", "n_name", ("ASIA", "EUROPE"), rows.select("n_name"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query("ordinal_index", """
    SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
      WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 END::BIGINT AS priority_index FROM orders""")
def ordinal_index(spark, d) -> DataFrame:
    index = options.ordinal_index(F.col("o_orderpriority"), PRIORITIES)
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", index.alias("priority_index"))


@query("ordinal_observed", """
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS position,
      o_orderpriority AS value, count(*) AS count
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') GROUP BY ALL""")
def ordinal_observed(spark, d) -> DataFrame:
    return options.ordinal_observed(table(spark, d, "orders"), "o_orderpriority", (*PRIORITIES, "6-NEVER"))


# --- inspection ------------------------------------------------------------------------------------------------------

_SPARK_TYPE_SQL = """CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint'
  WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'another type' END"""


def _profile_sql(relation: str, columns: tuple[str, ...], typed: bool) -> str:
    rows = []
    for i, c in enumerate(columns):
        kind = _SPARK_TYPE_SQL.format(c=c) + " AS data_type, " if typed else ""
        rows.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", {kind}count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_ratio FROM {relation}"
        )
    return " UNION ALL ".join(rows)


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "quality_note", "toxic_note")


@query("table_schema_profile", _profile_sql("orders", _ORDER_COLUMNS, typed=True))
def table_schema_profile(spark, d) -> DataFrame:
    profile = inspect.null_profile(table(spark, d, "orders"))
    return profile.withColumn("null_ratio", r6(F.col("null_ratio")))


_SHAPES = {"customer": 5, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5}


@query("table_shape", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {n} AS n_columns FROM {t}" for t, n in _SHAPES.items()))
def table_shape(spark, d) -> DataFrame:
    shapes = [inspect.table_shape(table(spark, d, t)).select(F.lit(t).alias("table_name"), "n_rows", "n_columns") for t in _SHAPES]
    result = shapes[0]
    for shape in shapes[1:]:
        result = result.unionByName(shape)
    return result


@query("null_profile", f"WITH {DOCUMENTS_SQL} {_profile_sql('docs', _DOC_COLUMNS, typed=False)}")
def null_profile(spark, d) -> DataFrame:
    profile = inspect.null_profile(documents(spark, d).select(*_DOC_COLUMNS)).drop("data_type")
    return profile.withColumn("null_ratio", r6(F.col("null_ratio")))


# the classes that the rules give these column names
_CLASSES = {
    "pages": {"page_id": "persona_id,demographic", "url": "", "html": ""},
    "customer": {
        "c_custkey": "", "c_name": "sensitive_or_identifying", "c_nationkey": "", "c_acctbal": "", "c_mktsegment": "",
    },
    "events": {"event_id": "persona_id", "ts": "", "user_id": "persona_id", "event_type": "", "value": "", "props": ""},
}


@query("column_classification", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS \"column\", count(*) - count({c}) AS null_count, '{classes}' AS categories, "
    f"{'true' if 'sensitive' in classes else 'false'} AS privacy_risk FROM {t}"
    for t, columns in _CLASSES.items() for c, classes in columns.items()))
def column_classification(spark, d) -> DataFrame:
    result = None
    for name in _CLASSES:
        rows = inspect.inspect_columns(table(spark, d, name)).select(
            F.lit(name).alias("table_name"), "column", "null_count", F.array_join("categories", ",").alias("categories"), "privacy_risk"
        )
        result = rows if result is None else result.unionByName(rows)
    return result


@query("candidate_groups", f"""WITH {DOCUMENTS_SQL}
    SELECT 'documents' AS table_name, 'persona_id' AS category, 'doc_id' AS columns, count(*) - count(doc_id) AS null_count FROM docs
    UNION ALL SELECT 'pages', 'persona_id', 'page_id', count(*) - count(page_id) FROM pages
    UNION ALL SELECT 'pages', 'demographic', 'page_id', count(*) - count(page_id) FROM pages""")
def candidate_groups(spark, d) -> DataFrame:
    def groups(df: DataFrame, name: str) -> DataFrame:
        found = inspect.candidate_groups(inspect.inspect_columns(df))
        return found.select(F.lit(name).alias("table_name"), "category", F.array_join("columns", ",").alias("columns"), "null_count")

    return groups(documents(spark, d), "documents").unionByName(groups(table(spark, d, "pages"), "pages"))


@query("masked_sample", """
    SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '***MASKED***' END AS c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer ORDER BY c_custkey LIMIT 5""")
def masked_sample(spark, d) -> DataFrame:
    return inspect.masked_sample(table(spark, d, "customer"), ["c_custkey"])


@query("mask_table", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type, value,
      CASE WHEN props IS NOT NULL THEN '***MASKED***' END AS props FROM events""")
def mask_table(spark, d) -> DataFrame:
    return inspect.mask_table(table(spark, d, "events"), ["props"])


def _fingerprint_sql(relation: str, columns: tuple[str, ...]) -> str:
    cells = ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    half = lambda at: f"sum(('0x' || substr(digest, {at}, 16))::UBIGINT)::VARCHAR"
    return (f"SELECT '{relation}' AS table_name, count(*) AS n_rows, {half(1)} || '-' || {half(17)} AS fingerprint "
            f"FROM (SELECT md5(concat_ws(',', {cells})) AS digest FROM {relation})")


@query("dataset_fingerprint", _fingerprint_sql("documents", ("doc_id", "text", "lang", "source", "n_chars")) + " UNION ALL "
       + _fingerprint_sql("pages", ("page_id", "url", "html")))
def dataset_fingerprint(spark, d) -> DataFrame:
    tables = [inspect.dataset_fingerprint(table(spark, d, t)).withColumn("table_name", F.lit(t)) for t in ("documents", "pages")]
    return tables[0].unionByName(tables[1]).select("table_name", "n_rows", "fingerprint")
