"""Tables that a plan writes once and reads several times, in the folder that driver and executors share, and tables dealt by their size."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir`` and read back, so that it is evaluated once.

    Only a local session without that setting gets a temporary folder, since executors would not share one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(table: DataFrame, *keys: str, most: int = 1_000_000) -> DataFrame:
    """``table`` (as read, whose count is in its files' footers) dealt by ``keys`` to tasks of about ``most`` rows.

    So the tasks grow in number and not in memory. A table that the session's shuffle partitions hold in such tasks stays as it is.
    """
    tasks = math.ceil(table.count() / most)
    return table.repartition(tasks, *keys) if tasks > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else table
