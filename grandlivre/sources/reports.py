"""Result sheets of scored documents, as tables and as CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.resolve import total_order
from ..operators.scoring import round2
from .documents import key_value_sheet
from .scratch import written_once


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``n`` from 1 in each document, by ``order``."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*total_order(rows, order, keys))))


def export_sheets(decisions: DataFrame, dataset: DataFrame, ratios: DataFrame, controls: DataFrame, keys: list[str], axes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index (one numbered row a document), Synthese (one row a decision's field), Dataset, Ratios, Axes and Controles (numbered by code) by sheet name."""
    by_code = {"Dataset": dataset, "Ratios": ratios} | ({"Axes": axes} if axes is not None else {}) | {"Controles": controls}
    return {"Index": index_sheet(decisions, keys), "Synthese": key_value_sheet(decisions, keys)} | {name: numbered(rows, keys, ["code"]) for name, rows in by_code.items()}


def index_sheet(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Documents of a lot numbered in order of their keys, rows of equal keys by their other columns.

    The rows are dealt into ranges and written once, so ranges and their sizes are those of one evaluation; a number is its place in
    the range and the sizes of the ranges before, so no task sees all rows.
    """
    order = total_order(decisions, keys, [])
    dealt = written_once(decisions.repartitionByRange(*keys).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "index")
    ranked = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))  # a row for each range
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.join(sizes.withColumn("_before", before), "_part").withColumn("n", F.col("_before") + F.col("_n")).select(*decisions.columns, "n")


def axes_rows(decisions: DataFrame, keys: list[str], axes: list[tuple[str, str, float]]) -> DataFrame:
    """(keys, code, score, weight, contribution) of ``axes`` (name, score column, weight)."""
    rows = [F.struct(F.lit(name).alias("code"), F.col(c).cast("double").alias("score"), F.lit(w).alias("weight"), round2(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w).alias("contribution")) for name, c, w in axes]
    return decisions.select(*keys, F.inline(F.array(*rows)))


# Axes of the older sheets.
LEGACY_AXES = [("Axe 1 — Financier", "axis1", 0.75), ("Axe 2 — Comportemental", "axis2", 0.15), ("Axe 3 — Sectoriel", "axis3", 0.10)]


def export_legacy_sheets(decisions: DataFrame, elements: DataFrame, scoring_input: DataFrame, ratios: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Synthese, Elements_PCGM (by number), Donnees_financieres (by field), Ratios (by position) and Axes by sheet name."""
    own = [c for c in decisions.columns if c in keys or c not in ("strengths", "watch_points", "ineligible")]
    return {
        "Synthese": key_value_sheet(decisions.select(own), keys),
        "Elements_PCGM": numbered(elements, keys, ["number"]),
        "Donnees_financieres": numbered(key_value_sheet(scoring_input, keys), keys, ["field"]),
        "Ratios": numbered(ratios, keys, ["pos"]),
        "Axes": axes_rows(decisions, keys, LEGACY_AXES),
    }


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Each sheet as a folder of CSV files with headers; what was there is replaced."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
