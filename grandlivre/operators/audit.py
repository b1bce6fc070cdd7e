"""Counters and merges of pages, regions, card sides and attempts; limits, ordered lists and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC = "document_id"
# Turns that are tried in this order after the page as it is.
TURNS = [0, 90, 180, 270]


def inspect_pages(stats: DataFrame) -> DataFrame:
    """(document_id, n_pages, n_native, n_scanned, blank_pages, rotated_pages) of ``stats`` (document_id, page_number, text_length, is_blank, declared_rotation).

    A page with text is native, one with neither text nor mark of blankness is scanned; lists are in page order.
    """
    text, blank = F.coalesce("text_length", F.lit(0)) > 0, F.coalesce("is_blank", F.lit(False))
    turned = F.coalesce("declared_rotation", F.lit(0)) != 0
    lists = [F.sort_array(F.collect_list(F.when(blank, F.col("page_number")))).alias("blank_pages"), F.map_from_entries(F.sort_array(F.collect_list(F.when(turned, F.struct("page_number", "declared_rotation"))))).alias("rotated_pages")]
    return stats.groupBy(DOC).agg(F.count("*").alias("n_pages"), F.count_if(text).alias("n_native"), F.count_if(~text & ~blank).alias("n_scanned"), *lists)


def extraction_counters(pages: DataFrame, sections: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts by document, or by ``keys`` such as a lot: pages and, if given, sections (document_id, status) by outcome."""
    keys = keys or [DOC]
    status = F.col("status")
    out = pages.groupBy(*keys).agg(F.count("*").alias("pages_total"), F.count_if(status == "ok").alias("pages_ok"), F.count_if(status == "error").alias("pages_failed"), F.count_if(status.isin("ok", "error")).alias("pages_processed"), F.count_if(status == "skipped").alias("pages_skipped"))
    if sections is None:
        return out
    counts = sections.groupBy(*keys).agg(*(F.count_if(status == s).alias(f"sections_{s}") for s in ("processed", "skipped", "failed")))
    return out.join(counts, keys, "full_outer")


def merge_regions(regions: DataFrame) -> DataFrame:
    """(document_id, page, page_type, columns, metadata, rows): the regions of a page as one payload.

    ``regions`` (document_id, page, ordinal, page_type, columns, metadata map, rows array<struct<label, values map>>) are the
    few parts of a page. The last financial page type counts, else the last; columns are distinct in order, later metadata
    win, equal rows (label and values, whatever the order of cells) count once.
    """
    part = F.struct("ordinal", "page_type", "columns", "metadata", "rows")
    g = regions.groupBy(DOC, "page").agg(F.array_sort(F.collect_list(part), lambda a, b: a["ordinal"].cast("int") - b["ordinal"].cast("int")).alias("r"))
    financial = F.filter("r", lambda x: x["page_type"].isin("BILAN_ACTIF", "BILAN_PASSIF", "CPC", "DETAIL_CPC", "RESULTAT_FISCAL", "ESG"))
    kind = F.coalesce(F.get(financial, F.size(financial) - 1)["page_type"], F.get("r", F.size("r") - 1)["page_type"])
    columns = F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["columns"], F.array().cast("array<string>")))))
    pairs = F.flatten(F.transform("r", lambda x: F.coalesce(F.map_entries(x["metadata"]), F.array().cast("array<struct<key:string,value:string>>"))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    metadata = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))
    cell = "array<struct<key:string,value:string>>"
    rows = F.flatten(F.transform("r", lambda x: F.coalesce(F.transform(x["rows"], lambda y: F.struct(y["label"].alias("label"), F.coalesce(F.array_sort(F.map_entries(y["values"])), F.array().cast(cell)).alias("cells"))), F.array().cast(f"array<struct<label:string,cells:{cell}>>"))))
    once = F.transform(F.array_distinct(rows), lambda y: F.struct(y["label"].alias("label"), F.map_from_entries(y["cells"]).alias("values")))
    return g.select(DOC, "page", kind.alias("page_type"), columns.alias("columns"), metadata.alias("metadata"), once.alias("rows"))


def first_filled(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The first non-empty value of each field in ``order``: sides of a card, pages of a document."""
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.groupBy(*keys).agg(*(F.min_by(full(c), F.when(full(c).isNotNull(), F.col(order))).alias(c) for c in fields))


def best_rotation(attempts: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each document of ``attempts`` (document_id, rotation, fields): as it is if any field is filled, else the first turn that fills one.

    ``warning`` tells which: null, ``rotated`` or ``unreadable`` (then the page as it is).
    """
    filled = sum((F.coalesce(F.trim(F.col(c)) != "", F.lit(False)).cast("int") for c in fields), F.lit(0))
    turn = F.array_position(F.array(*map(F.lit, TURNS)), F.col("rotation"))
    rows = attempts.withColumns({"_n": filled, "_turn": turn}).where("_turn > 0")
    best = F.min_by(F.struct("rotation", *fields, F.col("_n").alias("n_filled")), F.struct((F.col("_n") == 0), "_turn"))
    warning = F.when(F.col("b.n_filled") == 0, "unreadable").when(F.col("b.rotation") != 0, "rotated")
    return rows.groupBy(DOC).agg(best.alias("b")).select(DOC, "b.*", warning.alias("warning"))


def limit_pages(pages: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pages of each document (numbers from 1), with ``truncated``: a message where there were more, else null."""
    n = F.max("page_number").over(Window.partitionBy(DOC))
    note = F.when(n > most, F.concat(F.lit(f"truncated {most}/"), n.cast("string")))
    return pages.withColumn("truncated", note).where(F.col("page_number") <= most)


def sorted_codes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, codes): the distinct values of a column in order; they are codes of a list, not of the data's size."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias("codes"))


def first_n(values: Column, n: int = 8) -> Column:
    """The first ``n`` of an array; null counts as empty."""
    return F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, n)


def distinct_ordered(values: Column) -> Column:
    """Distinct strings in the order of their first appearance, without nulls."""
    return F.array_distinct(F.array_compact(values))
