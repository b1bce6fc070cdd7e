"""Choosing one value among candidates, and histories of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written_once


def dedupe_first(df: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """The first row of each key in source order; of rows equal there, the least by the other columns in their order, so the choice is total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*total_order(df, ordinal, keys)))).where("_n = 1").drop("_n")


def total_order(df: DataFrame, order: list[str], keys: list[str]) -> list[str]:
    """``order`` and then every other column that can be ordered, so that only equal rows tie."""
    return [*order, *(c for c, kind in df.dtypes if c not in (*order, *keys) and "map<" not in kind)]


def consensus(df: DataFrame, keys: list[str], amount: str, sources: Column | None = None) -> DataFrame:
    """(keys, n_candidates, value, status): one distinct amount is confirmed; several conflict and give null; none is missing.

    Combines before the shuffle. ``sources`` are kept as a sorted list where given: those of a field, a few.
    """
    low, high = F.min(amount).alias("_lo"), F.max(amount).alias("value")
    more = [] if sources is None else [F.sort_array(F.collect_list(sources)).alias("sources")]
    out = df.groupBy(*keys).agg(F.count("*").alias("n_candidates"), low, high, *more)
    status = F.when(F.col("value").isNull(), "missing").when(F.col("_lo") == F.col("value"), "confirmed").otherwise("conflicting")
    return out.withColumns({"status": status, "value": F.when(F.col("_lo") == F.col("value"), F.col("value"))}).drop("_lo")


def pick_best(df: DataFrame, keys: list[str], amount: str, priority: str, band: float = 5.0) -> DataFrame:
    """(keys, n_lower, value, priority, status): the candidate of highest priority; other amounts within ``band`` of it make the field
    conflicting and null, and without any amount there it is missing."""
    ranked = df.withColumn("_top", F.max(priority).over(Window.partitionBy(*keys)))
    near = F.col(priority) >= F.col("_top") - band
    kept = F.when(near, F.col(amount))
    out = ranked.groupBy(*keys).agg(F.count_if(~near).alias("n_lower"), F.min(kept).alias("_lo"), F.max(kept).alias("value"), F.max("_top").alias("priority"))
    status = F.when(F.col("value").isNull(), "missing").when(F.col("_lo") == F.col("value"), "confirmed").otherwise("conflicting")
    return out.withColumns({"status": status, "value": F.when(F.col("_lo") == F.col("value"), F.col("value"))}).drop("_lo")


def yearly_variations(df: DataFrame, key: str, year: str, items: list[str]) -> DataFrame:
    """(key, item, period, variation): (v - p) / |p| over consecutive years that the borrower has; null if p is null or 0 or v is null."""
    before = Window.partitionBy(key).orderBy(year)
    rows = []
    for item in items:
        v, p = F.col(item).cast("double"), F.lag(F.col(item).cast("double")).over(before)
        rows.append(F.struct(F.lit(item).alias("item"), F.when(p != 0, (v - p) / F.abs(p)).alias("variation")))
    period = F.concat_ws("/", F.col(year).cast("string"), F.lag(year).over(before).cast("string"))
    wide = df.select(key, period.alias("period"), F.lag(year).over(before).alias("_p"), F.array(*rows).alias("rows")).where("_p is not null")
    return wide.select(key, "period", F.inline("rows"))


def with_previous(df: DataFrame, key: str, year: str, column: str, alias: str) -> DataFrame:
    """Add the borrower's value of the year before the row's in the table; a value that ``alias`` already gives stays."""
    before = F.lag(column).over(Window.partitionBy(key).orderBy(year))
    return df.withColumn(alias, F.coalesce(F.col(alias), before) if alias in df.columns else before)


def sector_medians(ratios: DataFrame, sector: str, accuracy: int = 10_000) -> DataFrame:
    """(sector, code, median, n) of ratio values; exact medians of doubles.

    The values are written once. Sketches that combine before the shuffle give two values around each median; then one pass
    counts what lies below the lower as one row and ranks only what lies between, about 0.4 % of a group's rows and what ties
    with them. What lies above falls away where it is read.
    """
    rows = written_once(ratios.where("value is not null").select(sector, "code", F.col("value").cast("double").alias("v")), "medians")
    near = F.percentile_approx("v", [0.498, 0.502], accuracy)
    bounds = rows.groupBy(sector, "code").agg(near.alias("_near"), F.count("*").alias("n")).select(sector, "code", "n", F.col("_near")[0].alias("_lo"), F.col("_near")[1].alias("_hi"))
    # equal values travel as one with their count, and so does all that lies below: its place is before every value between
    marked = rows.join(bounds, [sector, "code"]).where("v <= _hi").withColumn("v", F.when(F.col("v") >= F.col("_lo"), F.col("v")))
    counted = marked.groupBy(sector, "code", "v").agg(F.count("*").alias("_c"), F.max("n").alias("n"))
    order = Window.partitionBy(sector, "code").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_c").over(order)).where("v is not null")
    at = lambda k: F.min(F.when(F.col("_to") >= k, F.col("v")))
    out = placed.groupBy(sector, "code").agg(at(F.floor((F.col("n") + 1) / 2)).alias("_a"), at(F.floor(F.col("n") / 2) + 1).alias("_b"), F.max("n").alias("n"))
    return out.select(sector, "code", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "n")


def carry_section(df: DataFrame, keys: list[str], order: list[str], section: str) -> DataFrame:
    """Forward fill of the last section seen; rows of equal order go by their other columns."""
    w = Window.partitionBy(*keys).orderBy(*total_order(df, order, keys)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(section, F.last(section, ignorenulls=True).over(w))


def table_islands(df: DataFrame, keys: list[str], order: list[str], inside: str) -> DataFrame:
    """Number the maximal runs of rows for which ``inside`` holds; other rows go."""
    w = Window.partitionBy(*keys).orderBy(*total_order(df, order, keys))
    start = F.expr(inside) & ~F.coalesce(F.lag(F.expr(inside)).over(w), F.lit(False))
    numbered = df.withColumn("_start", start.cast("int"))
    return numbered.withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(inside).drop("_start")
