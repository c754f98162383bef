"""Table-wide constraint checks; each returns the violating rows as ``(rule, key, detail)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import vocab
from cohortry.operators.context import LEVELS, missing_level_columns
from cohortry.spec import TableSpec


def _key(key: str | Sequence[str]) -> Column:
    names = [key] if isinstance(key, str) else list(key)
    return F.concat_ws("|", *[F.col(n).cast("string") for n in names])


def violations(df: DataFrame, rule: str, key: str | Sequence[str], broken: Column, detail: Column) -> DataFrame:
    """Rows where ``broken`` is TRUE; an unknown (NULL) condition is no violation."""
    return df.where(broken).select(F.lit(rule).alias("rule"), _key(key).alias("key"), detail.cast("string").alias("detail"))


def vocabulary_columns(vocabularies: Mapping[str, Sequence]) -> list[Column]:
    """``column=value`` of each column that is outside its vocabulary, else NULL."""
    return [
        F.when(~F.col(c).isin(list(allowed)), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
        for c, allowed in vocabularies.items()
    ]


def check_vocabulary(df: DataFrame, key: str, vocabularies: Mapping[str, Sequence]) -> DataFrame:
    """Non-null values outside a column's closed vocabulary, all columns in one pass."""
    bad = df.select(F.col(key), F.explode(F.array_compact(F.array(*vocabulary_columns(vocabularies)))).alias("detail"))
    return violations(bad, "vocabulary", key, F.lit(True), F.col("detail"))


def check_range_order(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Ranges whose lower end is above the upper end."""
    return violations(df, "range_order", key, F.col(low) > F.col(high), F.lit(f"{low} > {high}"))


def bounds_broken(df: DataFrame, bounds: Mapping[str, tuple]) -> list[tuple[Column, str]]:
    """For each column whether it is outside its bounds, and its name."""
    types, entries = dict(df.dtypes), []
    for column, (low, high) in bounds.items():
        value = F.length(column) if types[column] == "string" else F.col(column)
        broken = F.lit(False)
        if low is not None:
            broken = broken | (value < low)
        if high is not None:
            broken = broken | (value > high)
        entries.append((broken, column))
    return entries


def check_bounds(df: DataFrame, key: str, bounds: Mapping[str, tuple]) -> DataFrame:
    """Numbers outside their closed bounds; an open end is None. For text, the length is bounded."""
    outside = [F.when(broken, F.lit(column)) for broken, column in bounds_broken(df, bounds)]
    bad = df.select(F.col(key), F.explode(F.array_compact(F.array(*outside))).alias("column"))
    return violations(bad, "bounds", key, F.lit(True), F.col("column"))


def check_unique(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    names = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*names).agg(F.count("*").alias("n"))
    return violations(counts, "unique", names, F.col("n") > 1, F.col("n"))


def status_payload_detail() -> Column:
    """What a response's status lacks or forbids."""
    ok = F.col("status") == "success"
    return (
        F.when(ok & (F.col("response_text").isNull() | F.col("structured_response").isNull()), "success without payload")
        .when(ok & F.col("error_type").isNotNull(), "success with error_type")
        .when(~ok & F.col("error_type").isNull(), "error without error_type")
    )


def check_status_payload(responses: DataFrame, key: str = "response_id") -> DataFrame:
    """Success needs text and payload and no error type; error needs an error type."""
    detail = status_payload_detail()
    return violations(responses, "status_payload", key, detail.isNotNull(), detail)


def scope_detail(scope: Mapping[str, str]) -> Column:
    """The columns that differ from the destination, joined by commas."""
    entries = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in scope.items()]
    return F.concat_ws(",", *entries)


def check_scope(df: DataFrame, key: str, scope: Mapping[str, str]) -> DataFrame:
    """Rows whose project or run id differs from the destination."""
    detail = scope_detail(scope)
    return violations(df, "scope", key, detail != "", detail)


def pattern_detail(patterns: Mapping[str, str]) -> Column:
    """The columns that do not match their pattern, joined by commas."""
    entries = [F.when(~F.col(c).cast("string").rlike(p), F.lit(c)) for c, p in patterns.items()]
    return F.concat_ws(",", *entries)


def check_id_pattern(df: DataFrame, key: str, patterns: Mapping[str, str]) -> DataFrame:
    """Ids that do not match their pattern."""
    detail = pattern_detail(patterns)
    return violations(df, "id_pattern", key, detail != "", detail)


def check_repeat_link(questions: DataFrame, set_column: str = "question_set_id") -> DataFrame:
    """Repeat links that are missing, forbidden, unresolved or not aimed at an original."""
    targets = questions.select(
        set_column, F.col("question_id").alias("repeat_of_question_id"), F.col("question_type").alias("_target_type")
    ).distinct()
    # only rows with a link are joined
    has_link = F.col("repeat_of_question_id").isNotNull()
    keys = [set_column, "repeat_of_question_id"]
    linked = questions.where(has_link).join(targets, keys, "left")
    linked = linked.unionByName(questions.where(~has_link), allowMissingColumns=True)
    is_repeat, link = F.col("question_type") == "SAME_QUESTION_REPEAT", F.col("repeat_of_question_id")
    detail = (
        F.when(is_repeat & link.isNull(), "link required")
        .when(~is_repeat & link.isNotNull(), "link not allowed")
        .when(link.isNotNull() & F.col("_target_type").isNull(), "target not in set")
        .when(link.isNotNull() & (F.col("_target_type") != "ORIGINAL"), "target is not an original")
    )
    return violations(linked, "repeat_link", [set_column, "question_id"], detail.isNotNull(), detail)


def check_pair_distinct(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pairs whose two members are the same."""
    return violations(pairs, "pair_distinct", key, F.col(a) == F.col(b), F.col(a))


def check_orphans(child: DataFrame, key: str, link: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    known = parent.select(F.col(parent_key).alias(link)).distinct()
    lost = child.where(F.col(link).isNotNull()).join(known, [link], "left_anti")
    return violations(lost, "orphan", key, F.lit(True), F.col(link))


def metadata_lacking(type_column: str, metadata: str, requirements: Mapping[str, Sequence[str]]) -> list[tuple[Column, str]]:
    """For each required field whether a variant's map lacks it, and its name; of an unknown type only that."""
    kind = F.col(type_column)
    known = F.coalesce(kind.isin(list(requirements)), F.lit(False))
    asked = [(kind == k, field) for k, names in requirements.items() for field in names] + [(~known, "unknown type")]
    return [(a & F.try_element_at(F.col(metadata), F.lit(field)).isNull(), field) for a, field in asked]


def check_variant_metadata(
    variants: DataFrame,
    key: str,
    type_column: str,
    metadata: str,
    requirements: Mapping[str, Sequence[str]] = vocab.VARIANT_REQUIREMENTS,
) -> DataFrame:
    """Required metadata fields that a variant's map lacks; an unknown variant type is reported as such."""
    fields = [F.when(lacking, F.lit(field)) for lacking, field in metadata_lacking(type_column, metadata, requirements)]
    lacking = variants.withColumn("_field", F.explode(F.array_compact(F.array(*fields))))
    return violations(lacking, "variant_metadata", key, F.lit(True), F.col("_field"))


def missing_columns(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows ``(level, column)``: required context columns and trait columns that the table lacks."""
    rows = [(level, c) for level in LEVELS for c in missing_level_columns(spec, level, df.columns)]
    rows += [("trait", c) for c in spec.trait_columns if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, "level string, column string")
