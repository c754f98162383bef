"""Reading the given tables, shared work folders and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the given tables, by whatever path Spark can read."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent it is a fresh temporary folder of a local session; a cluster raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session have at most ``rows`` rows: they lie in the JVM and in the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def stored(frame: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """Write a step to the shared folder and read it back, so that a lost executor costs no more than that step."""
    schema = frame.schema
    frame.write.parquet(path, compression=codec)
    return frame.sparkSession.read.schema(schema).parquet(path)


def presence_bits(hashes: DataFrame, log2_bits: int = 23) -> np.ndarray:
    """A bitmap over one column of 64-bit hashes: 2**log2_bits bits whatever the number of rows.

    A hash that occurs always finds its bit set; one that doesn't may find it set too. It only thins out rows before an
    exact join, so its fixed size bounds what is collected and broadcast.
    """
    slots = 1 << (log2_bits - 6)
    h = F.col(hashes.columns[0])
    got = (
        hashes.select(h.bitwiseAND(slots - 1).cast("int").alias("slot"),
                      F.expr(f"shiftleft(1L, cast((`{hashes.columns[0]}` >> 32) & 63 as int))").alias("bits"))
        .groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    out = np.zeros(slots, np.int64)
    out[got["slot"].to_numpy()] = got["bits"].to_numpy()
    return out


def present(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes have their bit set."""
    h = hashed.view(np.int64)
    return (bits[h & (len(bits) - 1)].view(np.uint64) >> ((h >> 32) & 63).astype(np.uint64)) & np.uint64(1) == 1


def is_present(frame: DataFrame, hashed: Column, bits: np.ndarray) -> Column:
    """A column telling whether a 64-bit hash has its bit set."""
    held = frame.sparkSession.sparkContext.broadcast(bits)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(present(held.value, column.to_numpy()), pa.bool_())

    return F.arrow_udf(run, "boolean")(hashed)


def flat_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from concatenated values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def column_sums(
    frame: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int, kind: type = np.float64
) -> np.ndarray:
    """The sum of vectors of one fixed size that ``partial`` makes from the batches of each task.

    Vectors travel in blocks and are added on two levels, so that no group holds a block of every task.
    """
    block = min(size, 1 << 15)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for vector in partial(batches):
            total = vector if total is None else total + vector
        if total is not None:
            parts = [np.ascontiguousarray(total[i:i + block], kind).tobytes() for i in range(0, size, block)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "vector"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), kind) for v in rows.column("vector"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "vector": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, vector binary"
    made = frame.mapInArrow(split, schema).withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(32)))
    got = made.groupBy("block", "lot").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).toArrow()
    out = np.zeros(size, kind)
    for k, vector in zip(got["block"], got["vector"]):
        at = k.as_py() * block
        out[at:at + block] = np.frombuffer(vector.as_buffer(), kind)
    return out
