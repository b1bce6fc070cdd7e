"""Decisions kept current as documents change: each batch replaces the decisions of the keys it touches, readers see whole batches.

Keys are hashed to a fixed number of partitions. A partition has two slots; a batch reads the current slot of the partitions
it touches, leaves out the touched keys, adds their new decisions and writes the other slot. A manifest then says which slot of each
partition is current; it has two slots too, and the one with the greater batch counts, so a reader always finds a whole one.
Partitions that a batch does not touch are neither read nor written, and the size on disk is at most twice that of the decisions,
however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MANIFEST = "batch long, part int, slot int, side int"


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last published batch (-1 for none) and the current slot of each partition that has rows: one entry a partition, a setting."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        newest = rows.agg(F.max("batch")).first()[0]
    except AnalysisException:  # nothing is published yet
        return -1, {}
    return (-1, {}) if newest is None else (newest, {r.part: r.slot for r in rows.where(F.col("batch") == newest).collect() if r.slot >= 0})


def _current(spark: SparkSession, path: str, slots: dict[int, int]) -> DataFrame | None:
    """The rows of the given partitions' slots; only their folders are read."""
    folders = [f"{path}/rows/part={p}/slot={s}" for p, s in sorted(slots.items())]
    return spark.read.option("basePath", f"{path}/rows").parquet(*folders) if folders else None


def apply_batch(rows: DataFrame, number: int, keys: list[str], score: Callable[[DataFrame], DataFrame], path: str, parts: int) -> None:
    """Replace the decisions of the distinct keys of ``rows``. A batch that is published already changes nothing; one that failed half way is done again."""
    spark = rows.sparkSession
    done, slots = _manifest(spark, path)
    if number <= done:
        return
    place = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    touched = rows.select(*keys).distinct().withColumn("part", place)
    mine = sorted(r.part for r in touched.select("part").distinct().collect())
    old = _current(spark, path, {p: slots[p] for p in mine if p in slots})
    new = score(touched.drop("part")).withColumn("part", place)
    if old is not None:
        new = new.unionByName(old.drop("slot").join(touched.drop("part"), keys, "left_anti").select(*new.columns))
    other = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in range(parts) for x in (p, 1 - slots.get(p, 1)))), F.col("part")), F.lit(0))
    out = new.withColumn("slot", other)
    out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "slot").parquet(f"{path}/rows")
    # a touched partition may have lost its last row: only folders that this batch wrote count
    kept = {r.part for r in out.select("part").distinct().collect()}
    now = {p: s for p, s in slots.items() if p not in mine} | {p: 1 - slots.get(p, 1) for p in mine if p in kept}
    entries = [(number, p, now.get(p, -1), number % 2) for p in range(parts)]
    published = spark.createDataFrame(entries, MANIFEST).coalesce(1)
    published.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("side").parquet(f"{path}/manifest")


def rescore(changes: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, parts: int = 64) -> DataStreamWriter:
    """A writer that, for each batch of ``changes``, scores its distinct keys and replaces their decisions under ``path``, a shared folder.

    ``score`` maps keys to decisions, none for a key that has gone, and gives the same for the same keys while a batch runs. ``parts`` stays
    the same for the life of ``path``. One writer at a time.
    """
    return changes.writeStream.foreachBatch(lambda rows, number: apply_batch(rows, number, keys, score, path, parts)).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of all keys as of the last published batch."""
    _, slots = _manifest(spark, path)
    rows = _current(spark, path, slots)
    if rows is None:
        raise ValueError(f"nothing is published under {path}")
    return rows.drop("part", "slot")
