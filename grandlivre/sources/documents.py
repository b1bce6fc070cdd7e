"""Sources and sinks of filings: pages, payloads, uploads, archive entries, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observations import PAYLOAD

PAGE = "struct<page_number:int,status:string,extraction_mode:string,content:string,char_count:int,model_latency_ms:int,error:string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each usable page of the bundles (document_id, pages) at ``path``: status ok, neither empty nor marked empty."""
    bundles = spark.read.schema(f"document_id string, pages array<{PAGE}>").json(path)
    rows = bundles.select("document_id", F.inline("pages"))
    return rows.where("status = 'ok' and trim(content) not in ('', '[PAGE VIDE]')")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Page payloads with an explicit schema; cell values stay text, an absent cell stays null."""
    return spark.read.schema(PAYLOAD).json(path)


def admit(files: DataFrame, magic: str = "%PDF", most_bytes: int = 50 << 20, content_types: tuple[str, ...] | None = None) -> DataFrame:
    """``files`` (path, length, content, content_type) with ``reason``: empty, too large, wrong type, wrong beginning, or null if admitted.

    The type counts only where ``content_types`` names those allowed; parameters after a semicolon do not.
    """
    head = F.substring("content", 1, len(magic)).cast("string")
    reason = F.when(F.coalesce("length", F.lit(0)) == 0, "empty").when(F.col("length") > most_bytes, "too large")
    if content_types is not None:
        kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
        reason = reason.when(~F.coalesce(kind.isin(*content_types), F.lit(False)), "wrong type")
    return files.withColumn("reason", reason.when(head != magic, "wrong magic"))


def split_admitted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted files without ``reason``, and rejected ones with it but without their content."""
    return files.where("reason is null").drop("reason"), files.where("reason is not null").drop("content")


def pick_archive_entry(entries: DataFrame, archive: str = "archive", pages: str = "pages", size: str = "size", path: str = "path", named: DataFrame | None = None) -> DataFrame:
    """(archive, entry, n_entries): of each archive the entry with most pages, then most bytes, then the first path.

    ``named`` (archive, name) asks for an entry: that path, else the first in order whose last part is the name's; an archive
    whose name is not found has none. All of it is one aggregation that combines before the shuffle.
    """
    last = lambda c: F.lower(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1))
    rows = entries.select(F.col(archive).alias("archive"), F.col(pages).alias("_p"), F.col(size).alias("_s"), F.col(path).alias("_path"))
    if named is None:
        rows = rows.withColumn("name", F.lit(None).cast("string"))
    else:
        rows = rows.join(named.select("archive", "name"), "archive", "left")
    # a larger path would win a maximum, so the least path is taken among those of the greatest size
    top = F.max(F.struct("_p", "_s"))
    exact = F.min(F.when(F.col("_path") == F.col("name"), F.col("_path")))
    near = F.min(F.when(last(F.col("_path")) == last(F.col("name")), F.col("_path")))
    best = F.min_by("_path", F.struct((-F.col("_p")).alias("p"), (-F.col("_s")).alias("s"), "_path"))
    out = rows.groupBy("archive").agg(best.alias("_best"), exact.alias("_exact"), near.alias("_near"), F.max("name").alias("_name"), top.alias("_top"), F.count("*").alias("n_entries"))
    return out.select(F.col("archive").alias(archive), F.when(F.col("_name").isNull(), F.col("_best")).otherwise(F.coalesce("_exact", "_near")).alias("entry"), "n_entries")


def batch_summary(done: DataFrame, failed: DataFrame, run_id: str) -> DataFrame:
    """One row for each document: what was extracted, or its ``error``; warnings are cut to the first eight."""
    first = done.withColumn("warnings", F.slice("warnings", 1, 8)) if "warnings" in done.columns else done
    return first.unionByName(failed, allowMissingColumns=True).withColumn("run_id", F.lit(run_id))


def write_json(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Nested rows as JSON lines, nulls kept."""
    writer = df.write.option("ignoreNullFields", False)
    (writer.partitionBy(*partition) if partition else writer).json(path)


def key_value_sheet(df: DataFrame, keys: list[str]) -> DataFrame:
    """A two-column sheet: every other column of a row as (field, value) text."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *(F.col(c).cast("string").alias(c) for c in rest)).unpivot(keys, rest, "field", "value")
