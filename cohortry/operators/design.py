"""Experiment design tables: condition matrices, spec strings, prompt texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.hashing import digest_id


def condition_matrix(designs: DataFrame, key: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Every combination of a design's axis values with a stable condition id.

    Each axis is an array column of the design row; axes are exploded one after the other, so the expansion stays in the
    task that read the design. ``axes`` maps to output columns of the same name.
    """
    cells = designs.select(*key, *axes)
    for axis in axes:
        cells = cells.withColumn(axis, F.explode(F.array_distinct(F.col(axis))))
    names = [F.col(c).cast("string") for c in (*key, *axes)]
    return cells.withColumn("condition_id", digest_id("condition_", 16, *names))


def split_variant_spec(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """``LABEL|TEXT`` into fields; the text may hold further bars. ``problem`` says why a spec is refused."""
    parts = F.split(F.col(column), "[|]", 2)
    label = F.get(parts, 0)
    problem = F.when(F.size(parts) != 2, "variants must use LABEL|TEXT").when(
        ~label.isin(list(labels)), "unsupported variant label"
    )
    return df.withColumn("variant_label", label).withColumn("variant_text", F.get(parts, 1)).withColumn("problem", problem)


def split_question_spec(df: DataFrame, column: str, types: Sequence[str] = ("ORIGINAL", "SAME_QUESTION_REPEAT")) -> DataFrame:
    """``id|TYPE|TEXT`` with an optional fourth ``|repeat_of`` into fields."""
    parts = F.split(F.col(column), "[|]")
    problem = F.when(~F.size(parts).isin(3, 4), "questions must use id|TYPE|TEXT or id|TYPE|TEXT|repeat_of").when(
        ~F.get(parts, 1).isin(list(types)), "unsupported question type"
    )
    names = ("question_id", "question_type", "question_text", "repeat_of_question_id")
    out = df
    for i, name in enumerate(names):
        out = out.withColumn(name, F.get(parts, i))
    return out.withColumn("problem", problem)


def prompt_text(template: str, fields: Mapping[str, Column]) -> Column:
    """Template with ``{name}`` holes filled from columns; a NULL field leaves an empty hole."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))
