"""Column profiles: value frequencies, numeric and text summaries, and the tidy profile table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import vocab
from cohortry.functions.json_fields import json_integer, numeric_text
from cohortry.functions.measures import share
from cohortry.operators.quantiles import histogram_quantiles, sliced_quantiles
from cohortry.operators.skew import top_per_group

TEXT_QUANTILES = (0.5, 0.95)


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns of the list that the table has, in list order."""
    return [c for c in columns if c in df.columns]


def for_columns(df: DataFrame, columns: Sequence[str], zeros: Sequence[str] = ()) -> DataFrame:
    """One row per asked column: a result by column, with NULL, or 0 in the named counts, where it has no row."""
    asked = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    filled = asked.join(df, "column", "left")
    return filled.withColumns({c: F.coalesce(c, F.lit(0)).cast(df.schema[c].dataType) for c in zeros}) if zeros else filled


def long_values(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Long rows ``(column, value)``, one per cell; all cells must share one type."""
    wide = df.select(*[c.alias(n) for n, c in cells.items()])
    return wide.unpivot([], list(cells), "column", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` for several columns from one scan; values as text, NULL kept as a value."""
    long = long_values(df, {c: F.col(c).cast("string") for c in columns})
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def value_frequencies(df: DataFrame, columns: Sequence[str], top_n: int = 50) -> DataFrame:
    """Commonest values per column with their share of all rows."""
    return _frequencies(value_counts(df, columns), top_n)


def _frequencies(counts: DataFrame, top_n: int) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    order = [F.desc("count"), F.col("value").asc_nulls_last()]
    top = top_per_group(counts, ["column"], order, max(top_n, 0), "rank")
    # one row per profiled column
    return top.join(F.broadcast(totals), "column").select(
        "column", "rank", "value", "count", share(F.col("count"), F.col("total")).alias("ratio")
    )


def categorical_profile(
    df: DataFrame,
    columns: Sequence[str],
    limit: int = vocab.SELECTABLE_LIMIT,
    ordered: Sequence[str] = ("income_bracket",),
) -> DataFrame:
    """Per column: distinct non-null values, whether a filter can list them, and a note."""
    distinct = value_counts(df, columns).groupBy("column").agg(F.count("value").alias("distinct_count"))
    distinct = for_columns(distinct, columns, ["distinct_count"])
    fits = F.col("distinct_count") <= limit
    note = (
        F.when(F.col("column").isin(list(ordered)), vocab.NOTE_ORDERED)
        .when(~fits, vocab.NOTE_TOO_MANY)
        .otherwise(vocab.NOTE_SELECTABLE)
    )
    return distinct.withColumn("selectable", fits).withColumn("note", note)


def selection_fields(profile: DataFrame) -> DataFrame:
    """Columns a filter can list directly and columns that need normalising, one row each; input is the profile."""
    use = F.when(F.col("selectable"), "direct_select").otherwise("needs_normalising")
    listed = profile.groupBy(use.alias("use")).agg(F.array_sort(F.collect_list("column")).alias("columns"))
    return listed.select("use", "columns")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, minimum, maximum, mean and exact median of the non-null values."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return for_columns(sliced_quantiles(doubles, columns, [0.5]), columns, ["n"]).withColumnRenamed("q0", "median")


def decade_histogram(df: DataFrame, column: str, width: int = 10) -> DataFrame:
    """Buckets of ``width`` labelled ``"40s"`` with count and share of the non-null rows."""
    decade = (F.floor(F.col(column) / width) * width).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(decade.alias("decade")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(
        "decade",
        F.concat(F.col("decade").cast("string"), F.lit("s")).alias("label"),
        "count",
        share(F.col("count"), total).alias("ratio"),
    )


def parseability_profile(df: DataFrame, columns: Sequence[str], examples: int = 10) -> DataFrame:
    """Per text column: distinct values, share of non-null cells that are numbers, commonest values as examples.

    Works on the value counts, so each distinct text is parsed once.
    """
    counts = value_counts(df, columns)
    rows = F.col("count")
    stats = counts.groupBy("column").agg(
        F.count("value").alias("distinct_count"),
        F.coalesce(F.sum(F.when(numeric_text(F.col("value")).isNotNull(), rows)), F.lit(0)).alias("parseable"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), rows)), F.lit(0)).alias("filled"),
    )
    order = [F.desc("count"), F.col("value").asc_nulls_last()]
    top = top_per_group(counts, ["column"], order, examples, "rank")
    # at most ``examples`` values per column
    listed = top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("top"))
    ratio = F.coalesce(share(F.col("parseable"), F.col("filled")), F.lit(0.0))
    return for_columns(stats.join(listed, "column"), columns, ["distinct_count"]).select(
        "column",
        "distinct_count",
        ratio.alias("parseable_ratio"),
        (ratio == 1.0).alias("numeric_parseable"),
        F.coalesce(F.transform("top", lambda x: x["value"]), F.array().cast("array<string>")).alias("examples"),
    )


def json_parse_diagnostics(df: DataFrame, columns: Sequence[str], key: str = "t_score") -> DataFrame:
    """Per JSON-in-string column: rows, rows whose integer field parses, failures and failure ratio (NULL if empty)."""
    long = long_values(df, {c: json_integer(F.col(c), key) for c in columns})
    counts = long.groupBy("column").agg(F.count("*").alias("row_count"), F.count("value").alias("parse_success_count"))
    counts = for_columns(counts, columns, ["row_count", "parse_success_count"])
    failures = F.col("row_count") - F.col("parse_success_count")
    return counts.withColumn("parse_failure_count", failures).withColumn(
        "parse_failure_ratio", share(F.col("parse_failure_count"), F.col("row_count"))
    )


def text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, digest, length, count)`` per distinct text, from one scan.

    Texts are compared by SHA-256, so whole texts are hashed where they are read and only 32-byte digests and lengths
    are shuffled. NULL is counted as one entry.
    """
    cells = {c: F.struct(F.unhex(F.sha2(F.col(c).cast("string"), 256)).alias("digest"),
                         F.length(F.col(c).cast("string")).cast("bigint").alias("length")) for c in columns}
    long = long_values(df, cells).select("column", "value.digest", "value.length")
    return long.groupBy("column", "digest", "length").agg(F.count("*").alias("count"))


def _lengths(counts: DataFrame) -> DataFrame:
    filled = counts.where(F.col("length").isNotNull())
    hist = filled.groupBy("column", F.col("length").alias("value")).agg(F.sum("count").alias("n"))
    summary = histogram_quantiles(hist, TEXT_QUANTILES)
    return summary.select(
        "column",
        F.col("minimum").alias("min_length"),
        F.col("mean").alias("mean_length"),
        F.col("q0").alias("median_length"),
        F.col("q1").alias("p95_length"),
        F.col("maximum").alias("max_length"),
    )


def _duplicates(counts: DataFrame) -> DataFrame:
    stats = counts.groupBy("column").agg(
        F.count("digest").alias("distinct_count"), F.max("count").alias("_top"), F.sum("count").alias("_rows")
    )
    return stats.select(
        "column",
        "distinct_count",
        (1 - share(F.col("distinct_count"), F.col("_rows"))).alias("duplicate_row_ratio"),
        share(F.col("_top"), F.col("_rows")).alias("top_exact_value_ratio"),
    )


def text_length_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: minimum, mean, median, interpolated 95th percentile and maximum length in code points."""
    lengths = long_values(df, {c: F.length(F.col(c).cast("string")).cast("bigint") for c in columns})
    return for_columns(_lengths(lengths.groupBy("column", F.col("value").alias("length")).agg(F.count("*").alias("count"))), columns)


def text_duplicate_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: distinct texts, share of duplicate rows, share of the commonest text.

    NULL is not a distinct text but may be the commonest value.
    """
    return for_columns(_duplicates(text_counts(df, columns)), columns, ["distinct_count"])


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Length and duplicate profile of the text columns from one scan."""
    counts = text_counts(df, columns)
    return for_columns(_lengths(counts).join(_duplicates(counts), "column", "right"), columns, ["distinct_count"])


def profile_tidy(
    df: DataFrame,
    categoricals: Sequence[str],
    number: str,
    traits: Sequence[str],
    narratives: Sequence[str],
    top_n: int = 50,
) -> DataFrame:
    """The whole profile as long rows ``(section, column, value, count, ratio, metric)``.

    Columns that the table lacks are skipped, except ``number``. Counts are doubles since the column also holds means.
    The number's section keeps the name ``age`` of the report format.
    """
    categoricals, traits, narratives = (present(df, g) for g in (categoricals, traits, narratives))
    parts = [_number_rows(df, number)]
    if categoricals:
        counts = value_counts(df, categoricals)
        distinct = counts.groupBy("column").agg(F.count("value").alias("n"))
        parts.append(_tidy(distinct, "categorical", F.lit("distinct_count"), F.col("n"), None, F.lit(None)))
        top = _frequencies(counts, top_n)
        parts.append(_tidy(top, "categorical", F.col("value"), F.col("count"), F.col("ratio"), F.lit("frequency")))
    if traits:
        profile = parseability_profile(df, traits)
        cell = lambda value, count, ratio, metric: F.struct(
            value.cast("string").alias("value"), F.lit(count).cast("double").alias("count"),
            F.lit(ratio).cast("double").alias("ratio"), F.lit(metric).cast("string").alias("metric"),
        )
        fixed = F.array(
            cell(F.lit("distinct_count"), F.col("distinct_count"), None, None),
            cell(F.lit("parseable_ratio"), None, F.col("parseable_ratio"), None),
        )
        shown = F.transform("examples", lambda v: cell(v, None, None, "example"))
        rows = profile.select("column", F.inline(F.concat(fixed, shown)))
        parts.append(_tidy(rows, "big_five", F.col("value"), F.col("count"), F.col("ratio"), F.col("metric")))
    if narratives:
        profile = text_profile(df, narratives)
        metrics = [c for c in profile.columns if c != "column"]
        doubles = profile.select("column", *[F.col(m).cast("double").alias(m) for m in metrics])
        long = doubles.unpivot("column", metrics, "metric", "v")
        parts.append(_tidy(long, "narrative", F.col("metric"), F.col("v"), None, F.col("metric")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _number_rows(df: DataFrame, number: str) -> DataFrame:
    metrics = ["minimum", "maximum", "mean", "median"]
    long = numeric_profile(df, [number]).unpivot("column", metrics, "metric", "v")
    rows = _tidy(long, "age", F.col("metric"), F.col("v"), None, F.col("metric"))
    decades = decade_histogram(df, number).withColumn("column", F.lit(number))
    return rows.unionByName(
        _tidy(decades, "age", F.col("label"), F.col("count"), F.col("ratio"), F.lit("decade"))
    )


def _tidy(
    df: DataFrame, section: str, value: Column, count: Column | None, ratio: Column | None, metric: Column
) -> DataFrame:
    empty = F.lit(None)
    return df.select(
        F.lit(section).alias("section"),
        "column",
        value.cast("string").alias("value"),
        (empty if count is None else count).cast("double").alias("count"),
        (empty if ratio is None else ratio).cast("double").alias("ratio"),
        metric.cast("string").alias("metric"),
    )
