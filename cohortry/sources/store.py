"""Stored runs: snapshots behind a commit log, lots that are asked once, and a bucketed fact table.

A write goes to a directory of its own, and becomes visible when one line is appended to the log beside it: a file with a
single row, which a store shows whole or not at all. Readers follow the last line of each run and lot. So a write that
fails leaves what was there before, and a rerun can tell which lots are done. Old directories stay until they are removed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

LOG = (
    "project_id string, run_id string, lot int, lots int, version bigint, path string, n_rows bigint, succeeded bigint, "
    "failed bigint, error_types array<string>"
)
#: The lot of a run that is written as a whole.
WHOLE = -1
#: A pair of a repeat and its original has these in common, and so has the bucket.
FACT_KEY = ("project_id", "run_id", "agent_id", "root_question_id")


def work_path(spark: SparkSession, name: str) -> str:
    """A new directory in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may do without the setting; its own temporary folder serves then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cohortry-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def commit_log(spark: SparkSession, root: str) -> DataFrame:
    """All lines of the log; none where nothing was committed yet."""
    # the folder may not exist yet, and a pattern without a match is no error for the ignoring reader
    try:
        return spark.read.schema(LOG).json(f"{root}/log")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LOG)


def committed(spark: SparkSession, root: str, project_id: str, run_id: str) -> list:
    """The current lines of a run, one per lot; a run written as a whole takes the place of older lots and the other way."""
    mine = commit_log(spark, root).where((F.col("project_id") == project_id) & (F.col("run_id") == run_id))
    line = F.struct("version", "path", "n_rows", "succeeded", "failed", "error_types")
    rows = mine.groupBy("lots", "lot").agg(F.max_by(line, "version").alias("last")).select("lots", "lot", "last.*").collect()
    newest = max(rows, key=lambda r: r["version"], default=None)
    return sorted((r for r in rows if r["lots"] == newest["lots"]), key=lambda r: r["lot"]) if newest else []


def current_lines(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """The current lines of all runs, or of those for which ``wanted``, a condition on project_id and run_id, holds."""
    log = commit_log(spark, root)
    mine = log if wanted is None else log.where(wanted)
    run = Window.partitionBy("project_id", "run_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lot = ["project_id", "run_id", "lots", "lot"]
    rest = F.struct(*[c for c in mine.columns if c not in lot])
    last = mine.groupBy(*lot).agg(F.max_by(rest, "version").alias("last")).select(*lot, "last.*")
    return last.withColumn("newest", F.max_by("lots", "version").over(run)).where("lots = newest").drop("newest")


def run_table(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored run with what its writes observed; the log alone is read."""
    types = F.array_distinct(F.flatten(F.collect_list(F.coalesce("error_types", F.array().cast("array<string>")))))
    return current_lines(spark, root).groupBy("project_id", "run_id").agg(
        F.max("lots").alias("lots"), F.count(F.lit(1)).alias("committed_lots"), F.sum("n_rows").alias("stored"),
        F.sum(F.coalesce("succeeded", F.lit(0))).alias("succeeded"), F.sum(F.coalesce("failed", F.lit(0))).alias("failed"),
        F.size(types).alias("error_types"))


def read_runs(spark: SparkSession, root: str, schema: str, wanted: Column | None = None) -> DataFrame:
    """The current rows of every run that ``wanted`` picks, whatever formats their parts were written in.

    The condition on project_id and run_id is answered by the log, so files of other runs aren't opened; with none, all
    runs are read. The paths of the picked parts come to the driver, which plans their scan; no match gives no row.
    """
    paths = [r["path"] for r in current_lines(spark, root, wanted).select("path").collect()]
    return _read_parts(spark, paths, schema)


def commit(rows: DataFrame, root: str, project_id: str, run_id: str, lot: int = WHOLE, lots: int = 1, file_format: str = "parquet") -> str:
    """Write rows beside what is there, then make them the current ones of the run, or of one of its lots.

    The line in the log has what the writing pass observed: rows, and for responses successes, errors and error types.
    """
    spark, seen = rows.sparkSession, Observation()
    path = f"{root}/data/{uuid.uuid4().hex}.{file_format}"
    metrics = [F.count(F.lit(1)).alias("n_rows")]
    if {"status", "error_type"} <= {*rows.columns}:
        ok = F.col("status") == "success"
        metrics += [F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.collect_set("error_type").alias("error_types")]
    writer = rows.observe(seen, *metrics).write.format(file_format)
    writer.option("ignoreNullFields", "false").save(path) if file_format == "json" else writer.save(path)
    found = seen.get
    version = (commit_log(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    line = (project_id, run_id, lot, lots, version, path, found["n_rows"], found.get("succeeded"), found.get("failed"),
            sorted(found["error_types"]) if "error_types" in found else None)
    spark.createDataFrame([line], LOG).coalesce(1).write.mode("append").json(f"{root}/log")
    return path


def run_metrics(spark: SparkSession, root: str, project_id: str, run_id: str) -> dict:
    """Stored rows, successes, errors and number of error types of a run, from its log alone."""
    rows = committed(spark, root, project_id, run_id)
    return {
        "stored": sum(r["n_rows"] for r in rows), "succeeded": sum(r["succeeded"] or 0 for r in rows),
        "failed": sum(r["failed"] or 0 for r in rows), "error_types": len({e for r in rows for e in r["error_types"] or ()}),
    }


def read_committed(spark: SparkSession, root: str, project_id: str, run_id: str, schema: str) -> DataFrame:
    """The current rows of a run, whatever format its parts were written in; no other run's files are opened."""
    return _read_parts(spark, [r["path"] for r in committed(spark, root, project_id, run_id)], schema)


def _read_parts(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    by_format: dict[str, list[str]] = {}
    for path in paths:
        by_format.setdefault(path.rsplit(".", 1)[1], []).append(path)
    parts = [spark.read.schema(schema).format(f).load(paths) for f, paths in by_format.items()]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_lots(cells: DataFrame, key: str, lots: int) -> DataFrame:
    """The cells with their lot, which depends on the key alone: a rerun cuts the same lots."""
    return cells.withColumn("_lot", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(lots)).cast("int"))


def fill_lots(
    cells: DataFrame, fill: Callable[[DataFrame], DataFrame], root: str, project_id: str, run_id: str, lots: int, key: str = "agent_id"
) -> list[int]:
    """Fill planned cells lot by lot, each committed on its own; lots that are committed already are not filled again.

    Returns the lots that were filled. A lost task repeats its cells; an executor, a job or a driver that fails loses the
    lot that was being filled and none before it. ``lots`` must be the same in a rerun.
    """
    spark = cells.sparkSession
    done = {r["lot"] for r in committed(spark, root, project_id, run_id) if r["lots"] == lots}
    marked, filled = in_lots(cells, key, lots), []
    for lot in sorted(set(range(lots)) - done):
        commit(fill(marked.where(F.col("_lot") == lot).drop("_lot")), root, project_id, run_id, lot, lots)
        filled.append(lot)
    return filled


def with_root(responses: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Responses with ``root_question_id``: the question itself, or the original that it repeats.

    ``links(question_id, repeat_of_question_id)`` gives the link unless the responses carry it.
    """
    if links is not None:
        responses = responses.drop("repeat_of_question_id").join(links, "question_id", "left")
    return responses.withColumn("root_question_id", F.coalesce("repeat_of_question_id", "question_id"))


def save_fact(responses: DataFrame, name: str, path: str, buckets: int, links: DataFrame | None = None) -> DataFrame:
    """Store responses as a table in buckets of a repeat's key, each bucket one sorted file: one exchange, at the write.

    Pairing and everything else by that key reads the buckets as they are. The key has the question, so an agent with a
    third of the responses is spread over all buckets.
    """
    rows = with_root(responses, links).repartition(buckets, *FACT_KEY)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *FACT_KEY).sortBy(*FACT_KEY).saveAsTable(name)
    return responses.sparkSession.table(name)


def open_fact(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """The table over files that ``save_fact`` wrote, in a session that does not know it yet."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    keys = ", ".join(FACT_KEY)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def fact_pairs(fact: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each repeat of a stored fact beside its original: the key, and the columns as ``<name>_a`` and ``<name>_b``.

    Both sides are read in their buckets, so nothing is exchanged.
    """
    sides = []
    for kind, suffix in (("ORIGINAL", "a"), ("SAME_QUESTION_REPEAT", "b")):
        mine = fact.where(F.col("question_type") == kind)
        sides.append(mine.select(*FACT_KEY, *[F.col(c).alias(f"{c}_{suffix}") for c in columns]))
    return sides[0].hint("merge").join(sides[1], list(FACT_KEY))
