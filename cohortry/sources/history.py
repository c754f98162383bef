"""Stored histories: files clustered by agent and time, found by an index of what each file holds.

A write cuts the responses by range over (agent, order): a file holds few agents, or a stretch of one agent's time, so an
agent with a third of all rows is spread over many files and no task holds it whole. Beside the files goes an index with
one row per file: the least and greatest agent, the least and greatest time, rows, and rows without agent or time. A
reader asks the index first and opens only files that can hold what is wanted. Within a file sorted row groups are skipped
by their statistics, and columns that are asked by value (``looked_up``) have Bloom filters.

An index is appended as one file when its data are complete, so a write becomes visible at once or not at all. Later
writes add files with ranges of their own; ``compact`` clusters everything anew as the next generation, and readers follow
the greatest generation.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_META = ("_low", "_high", "_from", "_to", "_rows", "_no_agent", "_no_time", "_folder", "_file", "_generation")


def file_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index rows of the current generation; None where nothing is stored."""
    try:
        rows = spark.read.parquet(f"{path}/index")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    newest = rows.agg(F.max("_generation")).first()[0]
    return None if newest is None else rows.where(F.col("_generation") == newest)


def _write(rows: DataFrame, path: str, agent: str, order: Sequence[str], files: int, looked_up: Sequence[str], generation: int) -> None:
    folder = f"{path}/data/{uuid.uuid4().hex}"
    clustered = rows.repartitionByRange(files, agent, *order).sortWithinPartitions(agent, *order)
    writer = clustered.write
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(folder)
    time = order[0]
    index = rows.sparkSession.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("_file")).agg(
        F.min(agent).alias("_low"), F.max(agent).alias("_high"), F.min(time).alias("_from"), F.max(time).alias("_to"),
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(agent).isNull()).alias("_no_agent"),
        F.count_if(F.col(time).isNull()).alias("_no_time"),
    ).withColumns({"_folder": F.lit(folder), "_generation": F.lit(generation)})
    index.select(*_META).coalesce(1).write.mode("append").parquet(f"{path}/index")


def save_history(
    responses: DataFrame, path: str, files: int, agent: str = "agent_id", order: Sequence[str] = ("created_at", "response_id"),
    looked_up: Sequence[str] = ("question_id",),
) -> None:
    """Add responses to the stored histories under a path, as about ``files`` files.

    The first column of ``order`` is the time that ranges are asked by. An empty table adds nothing; NULL agents and times
    are stored like any other.
    """
    index = file_index(responses.sparkSession, path)
    generation = 0 if index is None else index.first()["_generation"]
    _write(responses, path, agent, order, files, [c for c in looked_up if c in responses.columns], generation)


def compact(
    spark: SparkSession, path: str, files: int, agent: str = "agent_id", order: Sequence[str] = ("created_at", "response_id"),
    looked_up: Sequence[str] = ("question_id",),
) -> None:
    """Cluster all that is stored anew; readers see the old files until the new ones are complete."""
    index = file_index(spark, path)
    if index is not None:
        rows, generation = read_history(spark, path), index.first()["_generation"]
        _write(rows, path, agent, order, files, [c for c in looked_up if c in rows.columns], generation + 1)


def _any_of(terms: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, terms, F.lit(False))


def _wanted_files(agents: Sequence[Any] | None, since: Any, until: Any) -> Column:
    """Which index rows can hold rows of the agents in the time asked."""
    held = F.lit(True)
    if agents is not None:
        within = [(F.col("_low") <= F.lit(a)) & (F.col("_high") >= F.lit(a)) for a in agents if a is not None]
        held = _any_of([*within, *[F.col("_no_agent") > 0 for a in agents if a is None]])
    if since is not None:
        held = held & (F.col("_to") >= F.lit(since))
    if until is not None:
        held = held & (F.col("_from") < F.lit(until))
    return F.coalesce(held, F.lit(False))


def history_files(
    spark: SparkSession, path: str, agents: Sequence[Any] | None = None, since: Any = None, until: Any = None
) -> list[str]:
    """The files that can hold rows of the agents (None asks for all) from ``since`` on and before ``until``.

    Their names come to the driver, as the files of any table that Spark plans a scan for.
    """
    index = file_index(spark, path)
    if index is None:
        return []
    found = index.where(_wanted_files(agents, since, until)).select("_folder", "_file").collect()
    return sorted(f"{r['_folder']}/{r['_file']}" for r in found)


def read_history(
    spark: SparkSession, path: str, agents: Sequence[Any] | None = None, since: Any = None, until: Any = None,
    agent: str = "agent_id", time: str = "created_at",
) -> DataFrame:
    """The rows of the agents from ``since`` on and before ``until``; only files that can hold some are opened.

    An agent of None asks for the rows without agent. Rows without a time belong to no range of time.
    """
    index = file_index(spark, path)
    if index is None:
        raise ValueError(f"no history is stored at {path}")
    files = history_files(spark, path, agents, since, until)
    schema = spark.read.parquet(index.select("_folder").first()[0]).schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    if agents is not None:
        known = [a for a in agents if a is not None]
        none = [F.col(agent).isNull()] if len(known) < len(agents) else []
        rows = rows.where(_any_of([*([F.col(agent).isin(known)] if known else []), *none]))
    if since is not None:
        rows = rows.where(F.col(time) >= F.lit(since))
    return rows.where(F.col(time) < F.lit(until)) if until is not None else rows
