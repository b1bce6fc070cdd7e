"""Helpers shared by the training-data operators: scratch tables, sampling and whole-text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; a longer text is taken alone and whole.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to Python.
BATCH_BYTES = 8 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir.

    Only a local session that names none (tests) gets a temporary folder; a cluster's executors would not share it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and its size is known."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let texts travel to Python in batches of at most ``most`` bytes; a smaller setting of the session stays.

    A batch is held by the task on both sides, several times over while it is read.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def thin(df: DataFrame, key: str, wanted: DataFrame, bits: int = 20) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``wanted``, kept where they are read.

    The keys' hashes modulo 2**bits are a table of at most 2**bits numbers however many keys there are, so
    they are broadcast. Some other rows stay (all, in the worst case); an exact join must follow.
    """
    place = lambda: F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int").alias("_place")
    places = F.broadcast(wanted.select(place()).distinct())
    return df.withColumn("_place", place()).join(places, "_place", "left_semi").drop("_place")


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, drawn by a hash of ``key``: the same at every run, all if there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) < F.lit(int(rows / n * 1_000_000)))


def remainder(key: str, modulus: int):
    """crc32 of the key written as text, modulo ``modulus``: the fixed split of the learning queries."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of a batch, a few MB at a time, every text whole."""
    data, at = utf8(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in chunks(at):
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def int_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of rows that take ``counts`` of ``values`` in turn."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))
