"""Financial ratios of statements: thirteen for the engine form (fractions) and thirteen for the weighted form (percent).

A statement has columns ca, ca_n1, fp, tb, df, rn, caf, clients, fourn, achats, fdr, tn and, for the last
ratio, leasing, cmt, operation; columns that are absent count as null. Nothing is shuffled: ratios are
columns of the statement, unpivoted once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status names of the engine form.
OK, WATCH, BAD, NONE = "Conforme", "À surveiller", "Non conforme", "Non calculable"

# Weighted ratios (code, higher is better, good, watch, weight, essential).
WEIGHTED = [
    ("financial_autonomy", True, 20, 15, 12, True),
    ("debt_ratio", False, 1.5, 2.5, 10, True),
    ("repayment_capacity", False, 3, 5, 12, True),
    ("caf_margin", True, 5, 2, 10, True),
    ("commercial_profitability", True, 5, 2, 8, False),
    ("financial_profitability", True, 10, 5, 8, False),
    ("economic_profitability", True, 5, 2, 6, False),
    ("fdr_ca", True, 0, -5, 8, False),
    ("treasury_days", True, 0, -15, 8, False),
    ("customer_days", False, 60, 90, 10, False),
    ("supplier_days", None, None, None, 8, False),
    ("ca_growth", True, 5, 0, 0, False),
    ("global_debt_after_operation", False, 3, 4, 0, False),
]

# Engine ratios in order; the first eleven count for the score.
ENGINE = [
    "autonomie_financiere", "ratio_endettement", "capacite_remboursement", "caf_sur_ca", "rentabilite_commerciale", "rentabilite_financiere", "rentabilite_economique",
    "fdr_sur_ca", "tresorerie_jours_ca", "delais_clients", "delais_fournisseurs", "croissance_ca", "endettement_global_apres_operation",
]


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def graded(value: Column, good: float | Column, watch: float | Column, higher: bool) -> Column:
    """Threshold class of a value that is not null, in engine names."""
    above = (lambda x: value >= x) if higher else (lambda x: value <= x)
    return F.when(above(good), OK).when(above(watch), WATCH).otherwise(BAD)


def engine_ratio_list(df: DataFrame) -> list[tuple[str, Column, Column]]:
    """(code, value, status) of the engine ratios in order, as columns of doubles.

    Debt and repayment over negative or zero equity or cash flow are not conforming, without a value; margins
    over turnover that is not positive cannot be computed; working capital and cash are graded by sign.
    """
    g = lambda n: _col(df, n, "double")
    ca, n1, fp, tb, debt, rn, caf = (g(n) for n in ("ca", "ca_n1", "fp", "tb", "df", "rn", "caf"))
    fdr, tn, clients, fourn, achats = (g(n) for n in ("fdr", "tn", "clients", "fourn", "achats"))
    both = lambda *c: reduce(lambda a, b: a & b, [x.isNotNull() for x in c])
    none, null = F.lit(NONE), F.lit(None).cast("double")
    out: list[tuple[Column, Column]] = []

    def over(top: Column, base: Column, good: float, watch: float, negative: Column | None = None) -> None:
        ok = both(top, base) & (base > 0)
        value = F.when(ok, top / base)
        status = graded(value, good, watch, True)
        out.append((value, F.when(ok, status if negative is None else F.when(negative, BAD).otherwise(status)).otherwise(none)))

    over(fp, tb, 0.20, 0.10, fp < 0)
    for base, good, watch in ((fp, 2.0, 3.0), (caf, 5.0, 7.0)):
        ok = both(debt, base)
        value = F.when(ok & (base > 0), debt / base)
        out.append((value, F.when(~ok, none).when(base <= 0, BAD).otherwise(graded(value, good, watch, False))))
    over(caf, ca, 0.05, 0.02, caf < 0)
    over(rn, ca, 0.05, 0.02)
    over(rn, fp, 0.10, 0.05)
    over(rn, fp + debt, 0.05, 0.02)
    for top, scale in ((fdr, 1), (tn, 360)):
        value = F.when(both(top, ca) & (ca != 0), top / ca * scale)
        out.append((value, F.when(value.isNull(), none).when(value > 0, OK).when(value == 0, WATCH).otherwise(BAD)))
    customer = F.when(both(clients, ca) & (ca > 0), clients / ca * 360)
    out.append((customer, F.when(customer.isNull(), none).otherwise(graded(customer, 60, 90, False))))
    supplier = F.when(both(fourn, achats) & (achats > 0), fourn / achats * 360)
    out.append((supplier, F.when(supplier.isNull(), none).when(customer.isNull(), WATCH).otherwise(graded(supplier, 0.8 * customer, 0.5 * customer, True))))
    growth = F.when(both(ca, n1) & (n1 != 0), (ca - n1) / F.abs(n1))
    out.append((growth, F.when(growth.isNull(), none).otherwise(graded(growth, 0.05, 0.0, True))))
    parts = F.filter(F.array(g("leasing"), g("cmt"), g("operation")), lambda x: x.isNotNull())
    total = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))
    after = F.when(both(total, fp) & (fp > 0), total / fp)
    out.append((after, F.when(~both(total, fp), none).when(fp <= 0, BAD).otherwise(graded(after, 2.0, 3.0, False))))
    return [(code, v, s) for code, (v, s) in zip(ENGINE, out, strict=True)]


def engine_ratios(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows (keys, pos, code, value, status) of the engine ratios, as doubles."""
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(code).alias("code"), v.alias("value"), s.alias("status")) for i, (code, v, s) in enumerate(engine_ratio_list(df))]
    return df.select(*keys, F.inline(F.array(*rows)))


def with_engine_ratios(df: DataFrame) -> DataFrame:
    """``df`` with a struct (value, status) for each engine ratio, named ``r_`` and its code; nothing is unpivoted."""
    return df.withColumns({f"r_{code}": F.struct(v.alias("value"), s.alias("status")) for code, v, s in engine_ratio_list(df)})


def weighted_ratios(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows (keys, pos, code, value, status, points, max_points) of the weighted ratios, as decimals."""
    return df.select(*keys, F.inline(F.array(*weighted_ratio_list(df))))


def weighted_values(df: DataFrame, keys: list[str], codes: list[str] | None = None) -> DataFrame:
    """Long rows (keys, code, value) of the weighted ratios, or of some, where grades and points are not wanted."""
    some = [F.struct(F.lit(w[0]).alias("code"), r["value"].alias("value")) for w, r in zip(WEIGHTED, weighted_ratio_list(df), strict=True) if codes is None or w[0] in codes]
    return df.select(*keys, F.inline(F.array(*some)))


def weighted_ratio_list(df: DataFrame | dict[str, Column]) -> list[Column]:
    """Structs (pos, code, value, status, points, max_points) of the weighted ratios in order, as decimals, from a table or columns by name.

    Values are graded before they are rounded half up to 0.01, but for supplier days and growth, which are
    graded after. Debt and repayment have no sign guard: over negative equity they grade as conforming.
    """
    g = lambda n: df[n].cast("decimal(20,4)") if isinstance(df, dict) else _col(df, n, "decimal(20,4)")
    ca, n1, fp, tb, debt, rn, caf = (g(n) for n in ("ca", "ca_n1", "fp", "tb", "df", "rn", "caf"))
    fdr, tn, clients, fourn, achats = (g(n) for n in ("fdr", "tn", "clients", "fourn", "achats"))
    div = lambda a, b, scale=1: F.try_divide(a, b) * F.lit(scale)
    days = lambda a, b: div(a, b, 360)
    customer, supplier = days(clients, ca), days(fourn, achats)
    operation = g("leasing") + g("cmt") + g("operation")
    values = [
        div(fp, tb, 100), div(debt, fp), div(debt, caf), div(caf, ca, 100), div(rn, ca, 100), div(rn, fp, 100), div(rn, (fp + debt).cast("decimal(20,4)"), 100), div(fdr, ca, 100),
        days(tn, ca), customer, supplier, F.try_divide((ca - n1).cast("decimal(20,4)"), F.abs(n1)) * 100, F.try_divide(operation.cast("decimal(20,4)"), fp),
    ]
    rows = []
    for i, ((code, higher, good, watch, weight, _), value) in enumerate(zip(WEIGHTED, values, strict=True)):
        shown = F.round(value, 2).cast("decimal(20,2)")
        if higher is None:
            gap = shown - F.round(customer, 2)
            status = F.when(shown.isNull() | customer.isNull(), "non_calculable").when(gap >= 0, "conforme").when(gap >= -30, "a_surveiller").otherwise("non_conforme")
        else:
            x = shown if code == "ca_growth" else value
            above = (lambda t, x=x: x >= F.lit(t).cast("decimal(10,2)")) if higher else (lambda t, x=x: x <= F.lit(t).cast("decimal(10,2)"))
            status = F.when(x.isNull(), "non_calculable").when(above(good), "conforme").when(above(watch), "a_surveiller").otherwise("non_conforme")
        share = F.when(status == "conforme", 1.0).when(status == "a_surveiller", 0.6).otherwise(0.0)
        rows.append(F.struct(F.lit(i).alias("pos"), F.lit(code).alias("code"), shown.alias("value"), status.alias("status"), F.round(share * weight, 2).alias("points"), F.lit(float(weight)).alias("max_points")))
    return rows
