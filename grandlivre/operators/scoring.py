"""Axis scores and credit decisions, from long ratio tables.

Scores of the engine form are binary doubles rounded as such (see ``round2``); others are half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ratios import BAD, ENGINE, NONE, OK, WATCH, WEIGHTED, weighted_ratio_list, with_engine_ratios

# Score from which a class holds, its name and its decision.
GRID = [
    (90.0, "A+", "Excellent", "Accord sans condition"),
    (80.0, "A/B+", "Bon", "Accord — conditions standards"),
    (65.0, "B/B-", "Moyen", "Accord avec garanties complémentaires"),
    (50.0, "C", "Sensible", "Accord conditionné ou refus partiel"),
]

# Default sector medians of the engine form; two of them are better when lower.
MEDIANS = [("rentabilite_commerciale", 0.042), ("autonomie_financiere", 0.21), ("ratio_endettement", 2.3), ("capacite_remboursement", 4.8), ("croissance_ca", 0.06)]
LOWER = ["ratio_endettement", "capacite_remboursement"]


def round2(x: Column) -> Column:
    """Two decimals of a double as its binary value lies: a printed tie that is just below or above one is none.

    x * 200 is an odd number at a tie; the error of that product, from the halves of x, tells the side.
    """
    p, c = x * 200.0, x * 134217729.0
    high = c - (c - x)
    error = (high * 200.0 - p) + (x - high) * 200.0
    tie = (p == F.rint(p)) & (F.pmod(p, F.lit(2.0)) == 1.0)
    return F.when(tie & (error < 0), F.floor(p / 2) / 100.0).when(tie & (error > 0), F.ceil(p / 2) / 100.0).otherwise(F.bround(x, 2))


def grid(score: Column, place: int, otherwise: str) -> Column:
    """Class (place 1), profile (2) or decision (3) of a score."""
    out = F
    for row in GRID:
        out = out.when(score >= row[0], row[place])
    return out.otherwise(otherwise)


def with_engine_axes(df: DataFrame, medians: DataFrame | None = None, sector: str | None = None) -> DataFrame:
    """``df`` (with ``r_`` columns of engine ratios) with counts, axis1 (penalties over eleven ratios, times their coverage) and
    axis3 (share at or better than the median).

    ``medians`` (code, median, and ``sector`` if given) is a rule table: its few rows of a sector become one map and join
    as such; without it the defaults hold, as for a sector that it does not name. Nothing is unpivoted or grouped.
    """
    scored = [F.col(f"r_{c}")["status"] for c in ENGINE[:11]]
    n = lambda tests: sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0)).cast("long")
    default = F.create_map(*(F.lit(x) for row in MEDIANS for x in row))
    if medians is None:
        df = df.withColumn("_medians", default)
    else:
        entry = F.map_from_entries(F.collect_list(F.struct("code", F.col("median").cast("double"))))
        known = medians.where(F.col("code").isin(ENGINE) & F.col("median").isNotNull()).dropDuplicates(["code", *([sector] if sector else [])])
        table = known.groupBy(*([sector] if sector else [])).agg(entry.alias("_m")).where(F.size("_m") > 0)
        joined = df.join(table, sector, "left") if sector else df.join(F.broadcast(table), F.lit(True), "left")
        df = joined.withColumn("_medians", F.coalesce("_m", default)).drop("_m")
    median = {c: F.element_at("_medians", F.lit(c)) for c in ENGINE}
    value = {c: F.col(f"r_{c}")["value"] for c in ENGINE}
    comparable = [median[c].isNotNull() & value[c].isNotNull() for c in ENGINE]
    better = [(value[c] <= median[c]) if c in LOWER else (value[c] >= median[c]) for c in ENGINE]
    counts = {name: n([s == status for s in scored]) for name, status in (("n_ok", OK), ("n_watch", WATCH), ("n_bad", BAD), ("n_none", NONE))}
    df = df.withColumns(counts | {"n_compared": n(comparable), "n_better": n(better)})
    penalised = F.lit(100.0) - 7.5 * F.col("n_watch") - 20.0 * F.col("n_bad")
    coverage = F.round((11 - F.col("n_none")) / 11.0, 4)
    covered = F.when(F.col("n_none") > 0, penalised * coverage).otherwise(penalised)
    axis3 = F.when(F.col("n_compared") > 0, F.round(100.0 * F.col("n_better") / F.col("n_compared"), 2)).otherwise(0.0)
    return df.withColumns({"axis1": F.greatest(F.lit(0.0), round2(covered)), "axis3": axis3}).drop("_medians")


def engine_axes(statements: DataFrame, keys: list[str], medians: DataFrame | None = None, sector: str | None = None) -> DataFrame:
    """(keys, counts, axis1, axis3) of statements."""
    out = with_engine_axes(with_engine_ratios(statements), medians, sector)
    return out.select(*keys, "n_ok", "n_watch", "n_bad", "n_none", "n_compared", "n_better", "axis1", "axis3")


def status_lists(df: DataFrame) -> dict[str, Column]:
    """Codes of the eleven scored ratios by status, in order, from ``r_`` columns."""
    of = lambda status: F.array_compact(F.array(*(F.when(F.col(f"r_{c}")["status"] == status, F.lit(c)) for c in ENGINE[:11])))
    return {"conforming": of(OK), "to_watch": of(WATCH), "not_conforming": of(BAD), "not_calculable": of(NONE)}


def engine_behaviour(df: DataFrame, keys: list[str]) -> DataFrame:
    """axis2 and coverage from given metrics; absent metrics are null and zero is a given value.

    Columns: incidents, rejects, unpaid, domiciliation, debit_days, overdraft, gap, kept (commitments honoured).
    """
    given = [F.col(c).isNotNull().cast("int") for c in ("incidents", "rejects", "unpaid", "domiciliation", "debit_days", "overdraft", "gap", "kept")]
    count = sum(given[1:], given[0])
    lose = lambda c, points: F.when(c, float(points)).otherwise(0.0)
    penalty = (
        lose(F.col("incidents") > 0, 40) + lose(F.col("rejects") > 0, 15) + lose(F.col("unpaid") > 0, 25) + lose(F.col("domiciliation") < 80, 10)
        + lose(F.col("debit_days") > 30, 15) + lose(F.col("overdraft") > 75, 10) + lose(F.abs("gap") > 3, 10) + lose(~F.col("kept"), 20)
    )
    return df.select(*keys, F.when(count > 0, F.greatest(F.lit(0.0), 100.0 - penalty)).alias("axis2"), F.round(count / 8.0, 4).alias("coverage2"))


def engine_decision(axes: DataFrame) -> DataFrame:
    """Add score, class, decision, recommendation and blocking of the engine form to rows with axis1, axis2, axis3, bam, incidents and unpaid.

    Absent behaviour counts as 0; incidents and unpaid bills together call for a manual review; a refused rating scores 0.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in axes.columns else F.lit(0)
    no = F.coalesce(F.col("bam") >= 7, F.lit(False))
    blocking = F.when(no, "NO_GO").when(zero("incidents") + zero("unpaid") > 0, "MANUAL_REVIEW")
    score = F.col("axis1") * 0.75 + F.coalesce("axis2", F.lit(0.0)) * 0.15 + F.col("axis3") * 0.10
    return axes.withColumns(
        {
            "score": F.when(no, 0.0).otherwise(round2(score)),
            "risk_class": F.when(no, "D/F").otherwise(grid(score, 1, "D/F")),
            "decision": F.when(no, "Rejeté (Cotation BAM)").otherwise(grid(score, 2, "Risqué")),
            "recommendation": F.when(no, "Refus automatique — cotation BAM en zone de refus (7/8/9)").otherwise(grid(score, 3, "Refus recommandé / systématique")),
            "blocking": blocking,
        }
    )


def weighted_axis(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Financial axis of statements: points of 100, whether it can be computed, and the codes of essential ratios that cannot."""
    df = statements.select(*keys, *(r.alias(f"_{i}") for i, r in enumerate(weighted_ratio_list(statements))))
    rows = [F.col(f"_{i}") for i in range(len(WEIGHTED))]
    missing = sorted(((w[0], F.when(r["status"] == "non_calculable", w[0])) for w, r in zip(WEIGHTED, rows, strict=True) if w[5]), key=lambda m: m[0])
    total = lambda name: sum((r[name] for r in rows[1:]), rows[0][name])
    out = df.select(*keys, total("points").alias("points"), total("max_points").alias("max_points"), F.concat_ws(",", *(m for _, m in missing)).alias("missing"))
    return out.withColumns({"calculable": F.col("missing") == "", "financial": F.round(F.col("points") / F.col("max_points") * 100, 2)})


def weighted_decision(axis: DataFrame) -> DataFrame:
    """Class and decision from the financial axis alone: provisional where it holds, a manual review where it does not."""
    score = F.when(F.col("calculable"), F.col("financial"))
    return axis.withColumns(
        {
            "score": score,
            "risk_class": F.when(score.isNull(), "NON_EVALUABLE").otherwise(grid(score, 1, "D/F")),
            "decision": F.when(score.isNull(), "Revue manuelle").otherwise("Revue manuelle (score financier provisoire)"),
            "blocking": F.when(score.isNull(), "INSUFFICIENT_DATA").otherwise("PARTIAL_DATA"),
        }
    )


# Points of the weighted behaviour axis (metric, points by bound, at least or at most, points otherwise).
BEHAVIOUR = [
    ("domiciliation", [(80, 20), (60, 12)], True, 4),
    ("overdraft", [(40, 15), (70, 8)], False, 0),
    ("debit_days", [(45, 15), (90, 8)], False, 0),
    ("gap", [(5, 15), (15, 8)], False, 0),
    ("leasing_delays", [(0, 15)], False, 0),
]
# Ratios compared with sector medians, and whether higher is better.
SECTOR = [("commercial_profitability", True), ("financial_autonomy", True), ("debt_ratio", False), ("repayment_capacity", False), ("ca_growth", True)]
# Weights of the axes and severe ratings.
AXES = [("financial", 0.75), ("behavioral", 0.15), ("sector", 0.10)]
SEVERE_RATINGS = [7, 8, 9]


def weighted_behaviour(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, behavioral, behavioral_ok, blocking): points of 100 from given metrics, null metrics give none.

    Metrics worth less than 70 points in all leave the axis without a score; anything in ``blocking`` (severe
    rating, incidents, unpaid bills, rejects, leasing delays) leaves the score but makes it unusable.
    """
    points, covered = F.lit(0), F.lit(0)
    for name, bounds, least, otherwise in BEHAVIOUR:
        x = F.abs(F.col(name)) if name == "gap" else F.col(name)
        scale = F
        for bound, worth in bounds:
            scale = scale.when(x >= bound if least else x <= bound, worth)
        points = points + F.when(x.isNull(), 0).otherwise(scale.otherwise(otherwise))
        covered = covered + F.when(x.isNull(), 0).otherwise(bounds[0][1])
    trio = [F.col(c) for c in ("incidents", "rejects", "unpaid")]
    given = trio[0].isNotNull() & trio[1].isNotNull() & trio[2].isNotNull()
    points = points + F.when(given & (trio[0] == 0) & (trio[1] == 0) & (trio[2] == 0), 20).otherwise(0)
    covered = covered + F.when(given, 20).otherwise(0)
    reasons = [("BAM", F.col("bam").isin(SEVERE_RATINGS)), ("incidents", trio[0] > 0), ("impayés", trio[2] > 0), ("rejets", trio[1] > 0), ("leasing", F.col("leasing_delays") > 0)]
    blocking = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons]))
    enough = covered >= 70
    out = df.select(*keys, F.when(enough, points).otherwise(0).cast("double").alias("behavioral"), enough.alias("_enough"), blocking.alias("blocking"))
    return out.select(*keys, "behavioral", (F.col("_enough") & (F.size("blocking") == 0)).alias("behavioral_ok"), "blocking")


def weighted_sector(ratios: DataFrame, keys: list[str], medians: DataFrame, sector: str) -> DataFrame:
    """(keys, sector_score, sector_ok): share of compared ratios on the better side of their sector's median, of three at least.

    ``medians`` (sector, code, median) joins by sector and code; Spark carries it to the tasks where it is small.
    """
    wanted = ratios.where(F.col("code").isin([c for c, _ in SECTOR]) & F.col("value").isNotNull())
    pairs = wanted.join(medians.select(sector, "code", "median").where("median is not null"), [sector, "code"])
    lower = [c for c, up in SECTOR if not up]
    better = F.when(F.col("code").isin(lower), F.col("value") <= F.col("median")).otherwise(F.col("value") >= F.col("median"))
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(better).alias("_b"))
    enough = F.col("_n") >= 3
    return counts.select(*keys, F.when(enough, F.round(F.col("_b") * 100 / F.col("_n"), 2)).otherwise(0.0).alias("sector_score"), enough.alias("sector_ok"))


def final_score(df: DataFrame, allow_partial: bool | Column) -> DataFrame:
    """Add final and partial from financial, behavioral, sector_score and their ``_ok`` flags (null is false).

    The weighted mean of the axes that hold; without the financial one, or without any other unless
    ``allow_partial``, there is none. ``partial`` says that an axis is left out.
    """
    names = {"financial": ("financial", "financial_ok"), "behavioral": ("behavioral", "behavioral_ok"), "sector": ("sector_score", "sector_ok")}
    ok = {a: F.coalesce(F.col(names[a][1]), F.lit(False)) for a, _ in AXES}
    exact = lambda x: x.cast("decimal(12,4)")
    top = sum((F.when(ok[a], exact(F.col(names[a][0])) * exact(F.lit(w))).otherwise(exact(F.lit(0))) for a, w in AXES), F.lit(0))
    base = sum((F.when(ok[a], exact(F.lit(w))).otherwise(exact(F.lit(0))) for a, w in AXES), F.lit(0))
    every = ok["behavioral"] & ok["sector"]
    usable = ok["financial"] & (every | (allow_partial if isinstance(allow_partial, Column) else F.lit(allow_partial)))
    return df.withColumns({"final": F.when(usable, F.round(F.try_divide(top, base), 2).cast("double")), "partial": usable & ~every})


def credit_decision(df: DataFrame) -> DataFrame:
    """Add risk_class, decision and blocking_status from final, partial and blocking (array of reasons; null counts as none).

    Reasons that name a rating, unpaid bills or fraud are severe. Any reason rules out agreement.
    """
    reasons = F.coalesce(F.col("blocking"), F.array().cast("array<string>"))
    severe = F.exists(reasons, lambda r: r.contains("BAM") | F.lower(r).contains("impayé") | F.lower(r).contains("fraude"))
    blocked, none = F.size(reasons) > 0, F.col("final").isNull()
    risk = F.when(blocked, F.when(severe & (F.col("final") < 50), "D/F").otherwise("NON_EVALUABLE")).when(none, "NON_EVALUABLE").otherwise(grid(F.col("final"), 1, "D/F"))
    plain = F.when(F.col("partial"), "Revue manuelle (score financier provisoire)").otherwise(grid(F.col("final"), 3, "Refus recommandé"))
    decision = F.when(blocked, F.when(severe, "Refus recommandé").otherwise("Revue manuelle")).when(none, "Revue manuelle").otherwise(plain)
    status = F.when(blocked, F.when(severe, "BLOCKING_CRITERIA").otherwise("INSUFFICIENT_DATA")).when(none, "INSUFFICIENT_DATA").when(F.col("partial"), "PARTIAL_DATA")
    return df.withColumns({"risk_class": risk, "decision": decision, "blocking_status": status})
