"""Analysis of resolved datasets in the weighted form: identity controls, invalidation, axes, composition into a decision.

A dataset is what ``resolution.to_dataset`` gives: one row for each document, a struct (value, status, warnings,
sources) for each field. Controls and invalidation are columns of that row; behaviour and sector join by keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.candidates import DATASET
from . import scoring as S
from .controls import agrees
from .ratios import WEIGHTED, weighted_ratio_list
from .resolution import AMOUNT, DOC, FIELD, NOTES, RATIO_FIELDS, usable

# Identity controls, in order: code, first, sign, second (or none), observed field, affected fields.
CONTROLS = [
    ("bilan_equilibre", "TOTAL_ACTIF", 0, None, "TOTAL_PASSIF", ["TOTAL_ACTIF", "TOTAL_PASSIF", "TOTAL_BILAN"]),
    ("tresorerie_nette", "TRESORERIE_ACTIF", -1, "TRESORERIE_PASSIF", "TRESORERIE_NETTE", ["TRESORERIE_ACTIF", "TRESORERIE_PASSIF", "TRESORERIE_NETTE"]),
    ("resultat_exploitation", "PRODUITS_EXPLOITATION", -1, "CHARGES_EXPLOITATION", "RESULTAT_EXPLOITATION", ["PRODUITS_EXPLOITATION", "CHARGES_EXPLOITATION", "RESULTAT_EXPLOITATION"]),
    ("resultat_financier", "PRODUITS_FINANCIERS", -1, "CHARGES_FINANCIERES", "RESULTAT_FINANCIER", ["PRODUITS_FINANCIERS", "CHARGES_FINANCIERES", "RESULTAT_FINANCIER"]),
    ("resultat_courant", "RESULTAT_EXPLOITATION", 1, "RESULTAT_FINANCIER", "RESULTAT_COURANT", ["RESULTAT_EXPLOITATION", "RESULTAT_FINANCIER", "RESULTAT_COURANT"]),
    ("resultat_non_courant", "PRODUITS_NON_COURANTS", -1, "CHARGES_NON_COURANTES", "RESULTAT_NON_COURANT", ["PRODUITS_NON_COURANTS", "CHARGES_NON_COURANTES", "RESULTAT_NON_COURANT"]),
    ("resultat_avant_impot", "RESULTAT_COURANT", 1, "RESULTAT_NON_COURANT", "RESULTAT_AVANT_IMPOT", ["RESULTAT_COURANT", "RESULTAT_NON_COURANT", "RESULTAT_AVANT_IMPOT"]),
    ("resultat_net", "RESULTAT_AVANT_IMPOT", -1, "IMPOT_SUR_RESULTATS", "RESULTAT_NET", ["RESULTAT_AVANT_IMPOT", "IMPOT_SUR_RESULTATS", "RESULTAT_NET"]),
]
# Fields without which the financial axis does not hold.
ESSENTIAL = ["CHIFFRE_AFFAIRES", "RESULTAT_NET", "TOTAL_BILAN", "FONDS_PROPRES"]
_ROW = f"struct<code:string,status:string,expected:{AMOUNT},observed:{AMOUNT},difference:{AMOUNT},tolerance:{AMOUNT},affected:array<string>>"


def _inputs(rule: tuple) -> tuple[Column, Column]:
    """Expected and observed amount of a control, null where an input is absent or unsure."""
    _, first, sign, second, observed, _ = rule
    value = lambda c: F.when(usable(c), F.col(c)["value"])
    expected = value(first) if second is None else (value(first) + value(second) if sign > 0 else value(first) - value(second))
    return expected.cast(AMOUNT), value(observed)


def _control(rule: tuple, expected: Column, seen: Column) -> Column:
    """The row of a control, null if it gives none.

    The balance always gives one, net cash also where it is still to be derived; the others only if all inputs are usable.
    """
    code, _, _, second, observed, affected = rule
    testable = expected.isNotNull() & seen.isNotNull()
    tolerance = F.greatest(F.lit(1).cast(AMOUNT), (F.abs(expected) * F.lit("0.0001").cast("decimal(6,4)")).cast(AMOUNT))
    row = lambda status, e, o, fields: F.struct(F.lit(code).alias("code"), status.alias("status"), e.alias("expected"), o.alias("observed"), (o - e).cast(AMOUNT).alias("difference"), F.when(o.isNotNull(), tolerance).alias("tolerance"), F.array(*map(F.lit, fields)).alias("affected")).cast(_ROW)
    none = F.lit(None).cast(AMOUNT)
    out = F.when(testable, row(F.when(agrees(expected, seen), "passed").otherwise("failed"), expected, seen, affected))
    if second is None:
        return out.otherwise(row(F.lit("not_testable"), none, none, ["TOTAL_BILAN"]))
    if code == "tresorerie_nette":
        return out.when(expected.isNotNull() & (F.col(observed)["status"] == "missing"), row(F.lit("not_testable"), expected, none, affected[:2]))
    return out


def _rows(dataset: DataFrame) -> tuple[DataFrame, list[Column], list[str]]:
    """``dataset`` with the inputs of its controls as columns, the controls' rows over them, and the names of these columns.

    As columns of their own the inputs are computed once; in the rows' expressions each would be repeated a dozen times.
    """
    names = [(f"_e_{rule[0]}", f"_o_{rule[0]}") for rule in CONTROLS]
    df = dataset.withColumns({n: x for pair, rule in zip(names, CONTROLS, strict=True) for n, x in zip(pair, _inputs(rule), strict=True)})
    return df, [_control(rule, F.col(e), F.col(o)) for rule, (e, o) in zip(CONTROLS, names, strict=True)], [n for pair in names for n in pair]


def with_controls(dataset: DataFrame) -> DataFrame:
    """``dataset`` with ``controls``: an array of its controls' rows, in order."""
    df, rows, names = _rows(dataset)
    return df.withColumn("controls", F.array_compact(F.array(*rows))).drop(*names)


def controls(dataset: DataFrame) -> DataFrame:
    """Long rows (document_id, code, status, expected, observed, difference, tolerance, affected).

    Rows that a control does not give are left out after they are unpacked: inside ``array_compact``, a lambda, all would be interpreted.
    """
    df, rows, _ = _rows(dataset)
    return df.select(DOC, F.inline(F.array(*rows))).where("code is not null")


def invalidate(dataset: DataFrame) -> DataFrame:
    """``dataset`` (with ``controls``) in which what a failed control affects is conflicting and null, with a warning for each."""
    failed = F.filter("controls", lambda c: c["status"] == "failed")
    df = dataset.withColumn("_failed", F.transform(failed, lambda c: F.struct(c["code"].alias("code"), c["affected"].alias("affected"))))
    touched = sorted({f for rule in CONTROLS for f in rule[5]})

    def by(field: str) -> Column:
        return F.get(F.filter("_failed", lambda c: F.array_contains(c["affected"], field)), F.lit(0))["code"]

    df = df.withColumns({f"_by_{f}": F.when(F.col(f)["status"].isin("confirmed", "derived"), by(f)) for f in touched})
    said = F.array_compact(F.array(*(F.concat(F.lit(f"Champ {f} invalidé suite au contrôle "), F.col(f"_by_{f}"), F.lit(".")) for f in touched)))
    lost = {f: F.when(F.col(f"_by_{f}").isNotNull(), F.col(f).withField("value", F.lit(None).cast(AMOUNT)).withField("status", F.lit("conflicting")).withField("warnings", F.array_append(F.col(f)["warnings"], F.concat(F.lit("control "), F.col(f"_by_{f}")))).cast(FIELD)).otherwise(F.col(f)) for f in touched}
    return df.withColumns({"warnings": F.concat("warnings", said)} | lost).drop("_failed", *(f"_by_{f}" for f in touched))


def financial_axis(dataset: DataFrame, mode: str = "STRICT") -> DataFrame:
    """``dataset`` with financial (points of 100), financial_ok and financial_blocking; STRICT scores 0 where anything blocks, REVIEW shows the score.

    Essential fields that are absent or unsure, invalidated fields, essential conflicts and essential ratios without a value block.
    """
    amounts = {n: F.when(usable(c), F.col(c)["value"]) for n, c in RATIO_FIELDS.items()}
    df = dataset.withColumns({f"_r{i}": r for i, r in enumerate(weighted_ratio_list(amounts))})
    rows = [F.col(f"_r{i}") for i in range(len(WEIGHTED))]
    lacking = [F.when(~usable(c), F.lit(f"Champ essentiel manquant ou non fiable : {c.lower()}")) for c in ESSENTIAL]
    wrong = F.filter("warnings", lambda w: F.lower(w).contains("invalidé") | (F.lower(w).contains("conflicting") & F.split(w, " ")[0].isin(ESSENTIAL)))
    no_ratio = reduce(lambda a, b: a | b, [(r["status"] == "non_calculable") for w, r in zip(WEIGHTED, rows, strict=True) if w[5]])
    blocking = F.concat(F.array_compact(F.array(*lacking)), wrong, F.array_compact(F.array(F.when(no_ratio, F.lit("Au moins un ratio financier essentiel est non calculable.")))))
    total = lambda name: sum((r[name] for r in rows[1:]), rows[0][name])
    score = F.round(total("points") / total("max_points") * 100, 2).cast("double")
    df = df.withColumn("financial_blocking", blocking)
    blocked = F.size("financial_blocking") > 0
    df = df.withColumns({"financial": F.when(blocked, 0.0).otherwise(score) if mode.upper() == "STRICT" else score, "financial_ok": ~blocked, "ratios": F.array(*rows)})
    return df.drop(*(f"_r{i}" for i in range(len(WEIGHTED))))


def merge_reasons(*arrays: Column, most: int | None = None) -> Column:
    """Reasons of all arrays, each once, in order; null arrays count as empty; the first ``most`` if given."""
    none = F.array().cast(NOTES)
    out = F.array_distinct(F.concat(*(F.coalesce(a, none) for a in arrays)))
    return out if most is None else F.slice(out, 1, most)


def assemble_case(dataset: DataFrame, behaviour: DataFrame | None, medians: DataFrame | None, sectors: DataFrame | None) -> DataFrame:
    """The document's dataset beside its behaviour (document_id, metrics) and its sector's medians as a map; absent ones are null.

    ``sectors`` (document_id, sector) and ``medians`` (sector, code, median) go together; documents without either stay.
    """
    df = dataset
    if behaviour is not None:
        df = df.join(S.weighted_behaviour(behaviour, [DOC]).withColumnRenamed("blocking", "behaviour_blocking"), DOC, "left")
    else:
        df = df.withColumns({"behavioral": F.lit(None).cast("double"), "behavioral_ok": F.lit(None).cast("boolean"), "behaviour_blocking": F.lit(None).cast(NOTES)})
    if medians is not None and sectors is not None:
        table = medians.where(F.col("code").isin([c for c, _ in S.SECTOR]) & F.col("median").isNotNull()).groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("code", F.col("median").cast("double")))).alias("medians"))
        return df.join(sectors.select(DOC, "sector"), DOC, "left").join(table, "sector", "left")
    return df.withColumns({"sector": F.lit(None).cast("string"), "medians": F.lit(None).cast("map<string,double>")})


def analyse(dataset: DataFrame, behaviour: DataFrame | None = None, medians: DataFrame | None = None, sectors: DataFrame | None = None, mode: str = "STRICT", vision: bool = False) -> DataFrame:
    """(document_id, controls, ratios, financial, behavioral, sector_score, final, risk_class, decision, blocking_status, blocking, soft).

    Controls first, then what they invalidate, ratios and axes. A document without behaviour or sector is scored on the axes
    it has, provisionally; with both a missing axis blocks. Anything that blocks takes the final score away. On the vision
    path STRICT counts failed controls as blocking.
    """
    df = assemble_case(financial_axis(invalidate(with_controls(dataset)), mode), behaviour, medians, sectors)
    by_code = {w[0]: F.get("ratios", F.lit(i))["value"].cast("double") for i, w in enumerate(WEIGHTED)}
    pairs = []
    for code, up in S.SECTOR:
        median, own = F.element_at("medians", F.lit(code)), by_code[code]
        pairs.append((median.isNotNull() & own.isNotNull(), own >= median if up else own <= median))
    count = lambda tests: sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
    df = df.withColumns({"_n": count([t for t, _ in pairs]), "_b": count([t & b for t, b in pairs])})
    df = df.withColumns({"sector_ok": F.col("_n") >= 3, "sector_score": F.when(F.col("_n") >= 3, F.round(F.col("_b") * 100 / F.col("_n"), 2)).otherwise(0.0)})
    partial_allowed = F.col("behavioral_ok").isNull() | F.col("medians").isNull()
    df = S.final_score(df, partial_allowed)
    say = lambda test, text: F.array_compact(F.array(F.when(test, F.lit(text))))
    no_axis = {a: say(~F.coalesce(F.col(c), F.lit(False)), f"Axe {a} non calculable.") for a, c in (("financial", "financial_ok"), ("behavioral", "behavioral_ok"), ("sector", "sector_ok"))}
    other = merge_reasons(F.col("behaviour_blocking"), no_axis["behavioral"], no_axis["sector"])
    failed = F.transform(F.filter("controls", lambda c: c["status"] == "failed"), lambda c: F.concat(F.lit("Contrôle comptable échoué : "), c["code"]))
    hard = merge_reasons(F.col("financial_blocking"), F.when(~partial_allowed, other), no_axis["financial"], failed if vision and mode.upper() == "STRICT" else F.lit(None).cast(NOTES))
    df = df.withColumns({"blocking": hard, "soft": F.when(partial_allowed, other).otherwise(F.array().cast(NOTES))})
    out = S.credit_decision(df.withColumn("partial", F.col("partial") & (F.size("soft") > 0)))
    shown = F.when(F.size("blocking") == 0, F.col("final")).alias("final")
    return out.select(DOC, "controls", "ratios", "financial", "behavioral", "sector_score", shown, "risk_class", "decision", "blocking_status", "blocking", "soft", "warnings")


def document_kpis(analysed: DataFrame, values: DataFrame) -> DataFrame:
    """(document_id, n_ratios, n_calculable, n_fields): ratios that have a value, and fields of ``values`` (document_id, code, value) that do."""
    filled = values.groupBy(DOC).agg(F.count_if(F.col("value").isNotNull()).alias("n_fields"))
    n = analysed.select(DOC, F.size("ratios").alias("n_ratios"), F.size(F.filter("ratios", lambda r: r["value"].isNotNull())).alias("n_calculable"))
    return n.join(filled, DOC, "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))


def mapping_audit(cands: DataFrame, values: DataFrame) -> DataFrame:
    """(document_id, candidates_by_field map, candidates_total, resolved, missing, conflicting): counts and sorted lists of codes.

    Maps and lists hold a few dozen fields at most.
    """
    code = lambda test: F.sort_array(F.collect_set(F.when(test, F.col("code"))))
    status = F.col("status")
    lists = values.groupBy(DOC).agg(code(status.isin("confirmed", "derived") & F.col("value").isNotNull()).alias("resolved"), code(status == "missing").alias("missing"), code(status == "conflicting").alias("conflicting"))
    return _with_counts(lists, cands)


def dataset_audit(cands: DataFrame, dataset: DataFrame) -> DataFrame:
    """``mapping_audit`` of a dataset, whose rows hold a document's fields already: they are listed there and not made rows and grouped again."""
    field = lambda c, name: F.col(c)[name]
    listed = lambda test: F.array_compact(F.array(*(F.when(test(c), F.lit(c)) for c in sorted(set(DATASET) & set(dataset.columns)))))
    lists = dataset.select(
        DOC, listed(lambda c: field(c, "status").isin("confirmed", "derived") & field(c, "value").isNotNull()).alias("resolved"),
        listed(lambda c: field(c, "status") == "missing").alias("missing"), listed(lambda c: field(c, "status") == "conflicting").alias("conflicting"),
    )
    return _with_counts(lists, cands)


def _with_counts(lists: DataFrame, cands: DataFrame) -> DataFrame:
    """A document's lists of codes beside the counts of its candidates."""
    counts = cands.groupBy(DOC, "field_code").agg(F.count("*").alias("n")).groupBy(DOC).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_code", "n")))).alias("candidates_by_field"), F.sum("n").alias("candidates_total"))
    return lists.join(counts, DOC, "full_outer")
