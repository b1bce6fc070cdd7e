"""Accounting-identity controls, invalidation and guarded derivations on wide statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agrees(expected: Column, observed: Column) -> Column:
    """Within the larger of 1 and 0.01 % of the expected amount."""
    return F.abs(observed - expected) <= F.greatest(F.lit(1).cast("decimal(20,4)"), F.abs(expected) * F.lit("0.0001").cast("decimal(6,4)"))


def controls(df: DataFrame, keys: list[str], rules: list[tuple[str, str, str, bool, list[str]]]) -> DataFrame:
    """Long rows (keys, code, status, expected, observed, difference, affected) of identity controls.

    A rule is (code, expected expression, observed column, row if untestable, affected fields). Amounts are null
    when a field is not usable; a control whose inputs are null gives ``not_testable`` or no row, as its rule says.
    """
    rows = []
    for code, expected, observed, always, affected in rules:
        e, o = F.expr(expected).cast("decimal(20,4)"), F.col(observed).cast("decimal(20,4)")
        testable = e.isNotNull() & o.isNotNull()
        status = F.when(~testable, "not_testable").when(agrees(e, o), "passed").otherwise("failed")
        rows.append(
            F.struct(
                F.lit(code).alias("code"), status.alias("status"), F.when(testable, e).alias("expected"), F.when(testable, o).alias("observed"),
                F.when(testable, (o - e).cast("decimal(20,4)")).alias("difference"), F.array(*map(F.lit, affected)).alias("affected"), (testable | F.lit(always)).alias("shown"),
            )
        )
    return df.select(*keys, F.inline(F.array(*rows))).where("shown").drop("shown")


def invalidate(values: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` (keys, code, value, status) where fields that a failed control affects become conflicting and null."""
    bad = checks.where("status = 'failed'").select(*keys, F.explode("affected").alias("code")).distinct().withColumn("hit", F.lit(True))
    out = values.join(bad, [*keys, "code"], "left")
    hit = F.col("hit").isNotNull() & F.col("status").isin("confirmed", "derived")
    return out.withColumns({"value": F.when(~hit, F.col("value")), "status": F.when(hit, "conflicting").otherwise(F.col("status"))}).drop("hit")


def derive(df: DataFrame, target: str, formula: str) -> DataFrame:
    """Fill ``target`` from ``formula`` where it is null and all inputs are there; ``<target>_status`` says which."""
    calc = F.expr(formula).cast("decimal(20,4)")
    status = F.when(F.col(target).isNotNull(), "confirmed").when(calc.isNotNull(), "derived").otherwise("missing")
    return df.withColumns({target: F.coalesce(F.col(target), calc), f"{target}_status": status})


def reconcile(df: DataFrame, target: str, formula: str) -> DataFrame:
    """Like ``derive``, and a value that disagrees with the formula is replaced by it."""
    calc, old = F.expr(formula).cast("decimal(20,4)"), F.col(target)
    take = calc.isNotNull() & (old.isNull() | ~agrees(calc, old))
    status = F.when(take, "derived").when(old.isNotNull(), "confirmed").otherwise("missing")
    return df.withColumns({target: F.when(take, calc).otherwise(old), f"{target}_status": status})
