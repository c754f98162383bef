"""Table inspection: schema, nulls, name classes, masking, fingerprints."""

from __future__ import annotations

import functools
import hashlib
import operator
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import vocab
from cohortry.functions.hashing import row_digest
from cohortry.functions.measures import share


def table_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, null count and null ratio (0 on an empty table), in one pass over the table."""
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"_c{i}") for i, f in enumerate(fields)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                (F.col("_rows") - F.col(f"_c{i}")).alias("null_count"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counts.select("_rows", F.inline(rows)).select(
        "position",
        "column",
        "data_type",
        "null_count",
        F.coalesce(share(F.col("null_count"), F.col("_rows")), F.lit(0.0)).alias("null_ratio"),
    )


def _normal_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def name_matches(name: Column, patterns: Sequence[str], whole_words: bool = False) -> Column:
    """Whether a normalised column name contains one of the patterns."""
    if whole_words:
        return name.rlike("(^|_)(" + "|".join(patterns) + ")(_|$)")
    return functools.reduce(operator.or_, (name.contains(p) for p in patterns))


def column_categories(
    name: Column, patterns: Mapping[str, Sequence[str]] = vocab.COLUMN_PATTERNS, whole_words: bool = False
) -> Column:
    """Categories of a column name, in the order of the pattern table."""
    normal = _normal_name(name)
    parts = []
    for category, words in patterns.items():
        hit = name_matches(normal, words, whole_words)
        if category == vocab.ID_CATEGORY:
            hit = hit | (normal == "id") | normal.endswith("_id")
        parts.append(F.when(hit, F.lit(category)))
    return F.array_compact(F.array(*parts))


def inspect_columns(df: DataFrame, whole_words: bool = False) -> DataFrame:
    """Null profile with name classes and a privacy flag per column."""
    classed = null_profile(df).withColumn("categories", column_categories(F.col("column"), whole_words=whole_words))
    return classed.withColumn("privacy_risk", F.array_contains("categories", vocab.PRIVACY_CATEGORY))


def candidate_groups(inspected: DataFrame) -> DataFrame:
    """Category -> its columns in table order and their NULL cells; the input has one row per column of a table."""
    pairs = inspected.select(F.explode("categories").alias("category"), "position", "column", "null_count")
    listed = pairs.groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("position", "column"))).alias("c"), F.sum("null_count").alias("null_count")
    )
    return listed.select("category", F.transform("c", lambda x: x["column"]).alias("columns"), "null_count")


def private_columns(df: DataFrame) -> list[str]:
    """Names the classifier flags as identifying; works on the schema alone."""
    words = vocab.COLUMN_PATTERNS[vocab.PRIVACY_CATEGORY]
    return [c for c in df.columns if any(w in c.lower().replace(" ", "_") for w in words)]


def display_cell(column: Column, data_type: T.DataType) -> Column:
    """Cell in its display form: bytes as hex, decimals as text, dates and times in ISO form."""
    if isinstance(data_type, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(data_type, T.DecimalType):
        return column.cast("string")
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(column, "SSSSSS")
        return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
    return column


def mask_table(df: DataFrame, private: Sequence[str]) -> DataFrame:
    """Cells in display form, with every non-null cell of the private columns replaced by the mask."""
    hidden = set(private)
    cells = [
        F.when(F.col(f"`{f.name}`").isNotNull(), F.lit(vocab.MASK_TEXT)) if f.name in hidden
        else display_cell(F.col(f"`{f.name}`"), f.dataType)
        for f in df.schema.fields
    ]
    return df.select(*[c.alias(n) for c, n in zip(cells, df.columns, strict=True)])


def masked_sample(df: DataFrame, order: Sequence[str], limit: int = 5) -> DataFrame:
    """The first rows along a key, masked; a negative limit gives no rows."""
    return mask_table(df.orderBy(*order).limit(max(limit, 0)), private_columns(df))


def dataset_fingerprint(df: DataFrame, columns: Sequence[Column] | None = None) -> DataFrame:
    """One row: row count and a content hash that ignores row order and file layout.

    Pass ``columns`` to fix how cells become text, doubles above all.
    """
    cells = list(columns) if columns is not None else [_stable_text(f) for f in df.schema.fields]
    high, low = row_digest(cells)
    digests = df.select(high.cast("decimal(38,0)").alias("h"), low.cast("decimal(38,0)").alias("l"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,0)")).cast("string")
    summed = digests.agg(F.count("*").alias("n_rows"), total("h").alias("h"), total("l").alias("l"))
    return summed.select("n_rows", F.concat_ws("-", "h", "l").alias("fingerprint"))


def _stable_text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(column))
    return column


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file under a path.

    Spark lists the files without reading them; each task then streams its files in blocks, so file size is no matter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", F.col("length").alias("size_bytes"))

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sha256=[_file_digest(p) for p in frame["path"]])

    return listed.mapInPandas(digests, "path string, size_bytes bigint, sha256 string")


def _file_digest(uri: str) -> str:
    # Spark writes local paths as file:/x and leaves blanks as they are; the URI parser wants file:///x, escaped
    filesystem, name = FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", uri), safe=":/@"))
    digest = hashlib.sha256()
    with filesystem.open_input_stream(name) as source:
        while block := source.read(1024 * 1024):
            digest.update(block)
    return digest.hexdigest()
