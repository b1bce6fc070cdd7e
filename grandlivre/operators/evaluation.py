"""Evaluation of cases in the engine form: eligibility, synthesis, response, overrides, block reasons, extract-and-score.

A case is a row with the statement columns of ``ratios`` and, where known, behaviour (``scoring.engine_behaviour``). All
of it is columns; the only joins are those that bring a borrower's behaviour and a sector's medians.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import format_ratio
from . import scoring as S
from .ratios import BAD, ENGINE, NONE, OK, WATCH, with_engine_ratios

# Inputs without which nothing is decided, and how they are called.
CRITICAL = {"ca": "chiffre d'affaires", "tb": "total bilan", "fp": "fonds propres", "rn": "résultat net", "df": "dettes financières", "caf": "CAF", "fdr": "fonds de roulement"}
# Fields of an extraction without which nothing is decided.
CRITICAL_FIELDS = {"CHIFFRE_AFFAIRES": "chiffre d'affaires", "TOTAL_BILAN": "total bilan", "FONDS_PROPRES": "fonds propres", "RESULTAT_NET": "résultat net", "CAF": "CAF", "FDR": "fonds de roulement"}
LEAST_RATIOS, LEAST_COMPLETENESS = 8, 50.0
# Label, formula, threshold and unit of the engine ratios, in their order.
METADATA = [
    ("Autonomie financière", "FP ÷ Total Bilan", "≥ 20 %", "%"),
    ("Ratio d'endettement", "Endettement ÷ FP", "≤ 1,5x (indic. — conforme jusqu'à 2,0x)", "x"),
    ("Capacité de remboursement", "Dettes de fin. ÷ CAF", "≤ 3 ans (indic. — conforme jusqu'à 5 ans)", "ans"),
    ("Capacité d'autofinancement", "CAF ÷ CA", "≥ 5 %", "%"),
    ("Rentabilité commerciale", "RN ÷ CA", "≥ 5 %", "%"),
    ("Rentabilité financière", "RN ÷ FP", "> 10 %", "%"),
    ("Rentabilité économique", "RN ÷ (FP + Dettes fin.)", "> coût moyen dette (5 %)", "%"),
    ("FDR / CA", "Fonds de roulement ÷ CA", "> 0 %", "%"),
    ("Trésorerie en jours de CA", "Trésorerie nette ÷ CA × 360", "> 0 jour", "j"),
    ("Délais clients", "(Clients ÷ CA) × 360", "≤ 60 j (à surveiller ≤ 90 j)", "j"),
    ("Délais fournisseurs", "(Fournisseurs ÷ Achats) × 360", "≥ délais clients", "j"),
    ("Croissance du CA", "(CA N − CA N-1) ÷ CA N-1", "≥ 5 %", "%"),
    ("Endettement global après opération", "(Leasing + CMT + Nouveau financement) ÷ FP", "≤ 2,0x (à surveiller ≤ 3,0x)", "x"),
]
# The inputs of each ratio, in order, and how inputs are called where they are absent.
INPUTS = [["fp", "tb"], ["df", "fp"], ["df", "caf"], ["caf", "ca"], ["rn", "ca"], ["rn", "fp"], ["rn", "fp", "df"], ["fdr", "ca"], ["tn", "ca"], ["clients", "ca"], ["fourn", "achats"], ["ca", "ca_n1"], ["fp", "leasing", "cmt", "operation"]]
NAMES = CRITICAL | {
    "tn": "trésorerie nette", "clients": "créances clients", "fourn": "dettes fournisseurs", "achats": "achats", "ca_n1": "CA N-1", "leasing": "encours leasing", "cmt": "crédit moyen terme (CMT)",
    "operation": "nouveau financement demandé",
}


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _told(*tests: tuple[Column, str | Column]) -> Column:
    """The texts whose tests hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in tests)))


def ratio_details(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows (keys, pos, code, label, formula, threshold, unit, value, status, shown, reason) of the thirteen ratios.

    A ratio that cannot be computed says which inputs are absent.
    """
    wide = with_engine_ratios(df)
    rows = []
    for i, (code, (label, formula, threshold, unit), inputs) in enumerate(zip(ENGINE, METADATA, INPUTS, strict=True)):
        r = F.col(f"r_{code}")
        absent = F.concat_ws(", ", *(F.when(_given(df, n).isNull(), NAMES[n]) for n in inputs))
        reason = F.when((r["status"] == NONE) & (absent != ""), F.concat(F.lit("Non calculable : donnée(s) absente(s) — "), absent, F.lit(".")))
        lits = [F.lit(x).alias(n) for n, x in (("pos", i), ("code", code), ("label", label), ("formula", formula), ("threshold", threshold), ("unit", unit))]
        rows.append(F.struct(*lits, r["value"].alias("value"), r["status"].alias("status"), format_ratio(r["value"], F.lit(unit)).alias("shown"), reason.alias("reason")))
    return wide.select(*keys, F.inline(F.array(*rows)))


def calculable(codes: list[str] = ENGINE) -> Column:
    """How many of the ratios have a status, from ``r_`` columns."""
    return sum(((F.col(f"r_{c}")["status"] != NONE).cast("int") for c in codes), F.lit(0))


def _too_few() -> Column:
    n = calculable()
    return F.when(n < LEAST_RATIOS, F.concat(F.lit("Couverture ratios insuffisante : "), n.cast("string"), F.lit(f"/{len(ENGINE)} (< {LEAST_RATIOS}).")))


def eligibility_manual(df: DataFrame) -> DataFrame:
    """Add ineligible (reasons, empty if the case may be decided), financial_coverage and ratio_coverage to rows with ``r_`` columns."""
    tests = [(_given(df, c).isNull(), f"Champ critique manquant : {name}.") for c, name in CRITICAL.items()]
    share = sum((_given(df, c).isNotNull().cast("int") for c in CRITICAL), F.lit(0)) / len(CRITICAL)
    reasons = F.array_compact(F.array_append(_told(*tests), _too_few()))
    return df.withColumns({"ineligible": reasons, "financial_coverage": F.round(share, 4), "ratio_coverage": F.round(calculable() / len(ENGINE), 4)})


def eligibility_extraction(df: DataFrame, usable: dict[str, Column], mode: str = "actual") -> DataFrame:
    """As ``eligibility_manual`` for an extraction: ``usable`` says by field whether its value may be scored; ``mode`` other than actual blocks."""
    tests = [(~F.coalesce(usable[c], F.lit(False)), f"Champ critique indisponible ou non fiable : {name}.") for c, name in CRITICAL_FIELDS.items()]
    reasons = F.array_compact(F.array_append(_told(*tests), _too_few()))
    if mode != "actual":
        reasons = F.array_append(reasons, F.lit("Le mode de scoring n'autorise pas une décision réelle."))
    share = sum((F.coalesce(usable[c], F.lit(False)).cast("int") for c in CRITICAL_FIELDS), F.lit(0)) / len(CRITICAL_FIELDS)
    return df.withColumns({"ineligible": reasons, "financial_coverage": F.round(share, 4), "ratio_coverage": F.round(calculable() / len(ENGINE), 4)})


def behaviour_signals(df: DataFrame) -> Column:
    """What a borrower's behaviour gives cause to watch, in order; null metrics say nothing."""
    n = lambda name, text: F.concat(_given(df, name).cast("long").cast("string"), F.lit(text))
    over = lambda name, test: F.coalesce(test(_given(df, name)), F.lit(False))
    return _told(
        (over("incidents", lambda x: x > 0), n("incidents", " incident(s) de paiement déclaré(s)")),
        (over("rejects", lambda x: x > 0), n("rejects", " rejet(s) de prélèvement")),
        (over("unpaid", lambda x: x > 0), n("unpaid", " effet(s) impayé(s)")),
        (over("domiciliation", lambda x: x < 80), F.format_string("Domiciliation du CA insuffisante (%.0f %% < 80 %%)", _given(df, "domiciliation").cast("double"))),
        (over("debit_days", lambda x: x > 30), F.concat(F.lit("Recours au découvert : "), _given(df, "debit_days").cast("long").cast("string"), F.lit(" j/an en position débitrice"))),
        (over("overdraft", lambda x: x > 75), F.format_string("Utilisation élevée de l'autorisation de découvert (%.0f %%)", _given(df, "overdraft").cast("double"))),
        (over("gap", lambda x: F.abs(x) > 3), F.format_string("Écart flux bancaires / CA déclaré de %+.1f %% (à justifier)", _given(df, "gap").cast("double"))),
        (over("kept", lambda x: ~x.cast("boolean")), "Retards constatés sur les engagements de leasing en cours"),
    )


def synthesis(df: DataFrame) -> DataFrame:
    """Add strengths and watch_points (arrays of text) to rows with ``r_`` columns, axis counts, axis2, coverage2 and behaviour."""
    r = {c: F.col(f"r_{c}") for c in ENGINE}
    absent = F.col("axis2").isNull()
    signals = behaviour_signals(df)
    partial = F.when(~absent & (F.col("coverage2") < 1), F.lit("Couverture comportementale partielle."))
    growth, autonomy = r["croissance_ca"]["value"], r["autonomie_financiere"]
    good = lambda c: r[c]["status"] == OK
    strengths = _told(
        (growth >= 0.05, F.format_string("Croissance solide du chiffre d'affaires (%+.1f%%).", growth * 100)),
        (good("autonomie_financiere") & autonomy["value"].isNotNull(), F.format_string("Structure financière saine : autonomie financière à %.1f%%.", autonomy["value"] * 100)),
        (good("tresorerie_jours_ca") & good("fdr_sur_ca"), "Trésorerie nette et fonds de roulement positifs."),
        (~absent & (F.size(signals) == 0) & partial.isNull(), "Comportement bancaire irréprochable : aucun signal négatif relevé."),
        (F.try_divide("n_better", "n_compared") >= 0.6, F.concat(F.lit("Bon positionnement sectoriel : au-dessus de la médiane sur "), F.col("n_better").cast("string"), F.lit(" indicateur(s) sur "), F.col("n_compared").cast("string"), F.lit("."))),
    )
    rows = []
    for code, (label, _, threshold, unit) in zip(ENGINE, METADATA, strict=True):
        kind = F.when(r[code]["status"] == BAD, "non conforme").when(r[code]["status"] == WATCH, "à surveiller")
        rows.append((kind.isNotNull(), F.concat(F.lit(f"{label} "), kind, F.lit(" ("), format_ratio(r[code]["value"], F.lit(unit)), F.lit(f" — seuil {threshold})."))))
    none = F.lit("Données comportementales non renseignées.")
    watch = F.concat(_told((absent, none)), _told(*rows), F.when(absent, F.array(none)).otherwise(F.array_compact(F.array_append(signals, partial))))
    return df.withColumns({"strengths": strengths, "watch_points": watch})


def evaluate(cases: DataFrame, keys: list[str], medians: DataFrame | None = None, sector: str | None = None) -> DataFrame:
    """(keys, axis1, axis2, axis3, score, risk_class, decision, recommendation, blocking, ineligible, strengths, watch_points).

    ``cases`` are statements with axis2, coverage2, bam and behaviour where known. A case that may not be decided is
    ``Non évaluable`` and says why; its axes stay.
    """
    for name, kind in [("axis2", "double"), ("coverage2", "double"), ("bam", "int")]:
        if name not in cases.columns:
            cases = cases.withColumn(name, F.lit(None).cast(kind))
    df = synthesis(eligibility_manual(S.engine_decision(S.with_engine_axes(with_engine_ratios(cases), medians, sector))))
    return df.select(*keys, "axis1", "axis2", "axis3", *refused(F.size("ineligible") > 0, F.array_join("ineligible", " ; ")), "ineligible", "strengths", "watch_points")


def refused(test: Column, why: Column) -> list[Column]:
    """Score and decision columns, replaced where ``test`` holds."""
    put = lambda name, x: F.when(test, x).otherwise(F.col(name)).alias(name)
    return [put("score", F.lit(None).cast("double")), put("risk_class", F.lit("Non évaluable")), put("decision", F.lit("Revue manuelle")), put("recommendation", why), put("blocking", F.lit("INSUFFICIENT_DATA"))]


def apply_overrides(statements: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Statements in which a value that ``overrides`` gives replaces the own one; keys are unique in ``overrides``."""
    shared = [c for c in overrides.columns if c not in keys and c in statements.columns]
    joined = statements.alias("s").join(overrides.alias("o"), keys, "left")
    return joined.select(*keys, *(F.coalesce(F.col(f"o.{c}"), F.col(f"s.{c}")).alias(c) if c in shared else F.col(f"s.{c}") for c in statements.columns if c not in keys))


def block_reason(failed: Column, admitted: Column, why_not: Column, completeness: Column, sections: Column, values: dict[str, Column], states: dict[str, Column]) -> Column:
    """The one message for which an extraction is not scored, or null.

    ``failed`` and ``admitted`` are flags of the document, ``sections`` a map of complete sections, ``values`` the needed
    amounts by name and ``states`` the doubtful state of a field by name (null if it is sound).
    """
    lost = F.filter(F.array(*map(F.lit, ("BILAN_ACTIF", "BILAN_PASSIF", "CPC"))), lambda s: ~F.coalesce(F.element_at(sections, s), F.lit(False)))
    absent = _told(*((v.isNull(), n) for n, v in values.items()))
    doubtful = _told(*((s.isNotNull(), F.concat(F.lit(f"{n} ("), s, F.lit(")"))) for n, s in states.items()))
    part = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, ", ")))
    details = F.concat_ws(" ; ", F.format_string(f"complétude %.1f%% (< {LEAST_COMPLETENESS:.0f}%%)", completeness), part("sections absentes : ", lost), part("données absentes : ", absent), part("données non fiables : ", doubtful))
    short = F.coalesce(completeness < LEAST_COMPLETENESS, F.lit(True)) | (F.size(lost) > 0) | (F.size(absent) > 0) | (F.size(doubtful) > 0)
    return (
        F.when(failed, "Extraction OCR échouée — aucune donnée exploitable, scoring non lancé.")
        .when(~admitted, F.coalesce(why_not, F.lit("Scoring non lancé : document non admissible au scoring automatique.")))
        .when(short, F.concat(F.lit("Scoring non lancé : extraction insuffisante ("), details, F.lit("). Aucune décision de crédit ne peut être déduite de ce résultat.")))
    )


def extract_and_score(extractions: DataFrame, keys: list[str], overrides: DataFrame | None = None, medians: DataFrame | None = None) -> DataFrame:
    """Evaluate extractions (keys, statement columns, completeness, sections, states map, failed, admitted, why_not).

    Given values replace extracted ones; a block reason replaces the decision but not the axes; failed documents have no
    score at all.
    """
    facts = ["completeness", "sections", "states", "failed", "admitted", "why_not"]
    cases = apply_overrides(extractions, overrides, keys) if overrides is not None else extractions
    values = {name: F.col(c) for c, name in CRITICAL.items()}
    states = {name: F.element_at("states", F.lit(code)) for code, name in CRITICAL_FIELDS.items()}
    why = block_reason(F.col("failed"), F.col("admitted"), F.col("why_not"), F.col("completeness"), F.col("sections"), values, states)
    reasons = cases.select(*keys, "failed", why.alias("block_reason"))
    scored = evaluate(cases.drop(*facts), keys, medians).join(reasons, keys)
    axes = [F.when(~F.col("failed"), F.col(c)).alias(c) for c in ("axis1", "axis2", "axis3")]
    return scored.select(*keys, *axes, *refused(F.col("block_reason").isNotNull(), F.col("block_reason")), "block_reason")
