"""Candidates to dataset, with the golden values of a whole filing and the odd cases of single fields."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from grandlivre import queries_filings as Q
from grandlivre.functions import labels as L
from grandlivre.operators import analysis as A
from grandlivre.operators import resolution as R
from grandlivre.operators import vision as V

CANDIDATE = "document_id string, ordinal long, field_code string, raw_value string, period string, nature string, confidence double, page_number int, page_type string, raw_label string, column_name string, column_role string, source_excerpt string, orientation int, warnings array<string>"
T, N1 = "SECTION_TOTAL", "EXERCICE_N1"
# code, value, page type, label, column, role, period, nature, page
FILING = [
    ("TOTAL_ACTIF", "22 303 497,11", "BILAN_ACTIF", "TOTAL GENERAL I+II+III", "Net", "NET_N", "N", "GRAND_TOTAL", 2),
    ("ACTIFS_IMMOBILISES", "338 562,41", "BILAN_ACTIF", "TOTAL I", "Net", "NET_N", "N", T, 2),
    ("ACTIF_CIRCULANT", "21 763 766,88", "BILAN_ACTIF", "TOTAL II", "Net", "NET_N", "N", T, 2),
    ("STOCKS", "949 635,00", "BILAN_ACTIF", "TOTAL STOCKS", "Net", "NET_N", "N", "DETAIL", 2),
    ("TRESORERIE_ACTIF", "201 167,82", "BILAN_ACTIF", "TOTAL TRESORERIE-ACTIF", "Net", "NET_N", "N", T, 2),
    ("TOTAL_PASSIF", "22 303 497,11", "BILAN_PASSIF", "TOTAL I+II+III", "Exercice", "EXERCICE_N", "N", "GRAND_TOTAL", 3),
    ("FONDS_PROPRES", "9 114 715,17", "BILAN_PASSIF", "TOTAL DES CAPITAUX PROPRES", "Exercice", "EXERCICE_N", "N", T, 3),
    ("DETTES_FINANCIERES", "133 308,11", "BILAN_PASSIF", "TOTAL DES DETTES DE FINANCEMENT", "Exercice", "EXERCICE_N", "N", T, 3),
    ("PASSIF_CIRCULANT", "13 055 473,83", "BILAN_PASSIF", "TOTAL DU PASSIF CIRCULANT", "Exercice", "EXERCICE_N", "N", T, 3),
    ("TRESORERIE_PASSIF", "0,00", "BILAN_PASSIF", "Trésorerie-Passif", "Exercice", "EXERCICE_N", "N", "DETAIL", 3),
    ("CHIFFRE_AFFAIRES", "13 404 177,00", "CPC", "Chiffre d'affaires", "Taux du exercice", "UNKNOWN", "N", "DETAIL", 4),
    ("CHIFFRE_AFFAIRES", "24 105 417,32", "CPC", "Chiffre d'affaires", "Exercice précédent", N1, "N_MINUS_1", "DETAIL", 4),
    ("RESULTAT_NET_XIII", "1 179 809,16", "CPC", "XIII Résultat net", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", T, 5),
    ("RESULTAT_NET_XVI", "1 179 809,16", "CPC", "XVI Résultat net", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", T, 5),
    ("RESULTAT_NET", "670 378,06", "CPC", "Résultat net", "Exercice précédent", N1, "N_MINUS_1", "DETAIL", 5),
    ("ACHATS_REVENDUS", "9 295 560,07", "CPC", "Achats revendus", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", "DETAIL", 4),
    ("ACHATS_CONSOMMES", "430 367,29", "CPC", "Achats consommés", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", "DETAIL", 4),
    ("CHARGES_INTERETS", "95 394,47", "CPC", "Charges d'intérêts", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", "DETAIL", 5),
    ("PRODUITS_FINANCIERS", "7 082,15", "CPC", "Produits financiers", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", T, 5),
    ("CHARGES_FINANCIERES", "200 928,82", "CPC", "Charges financières", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", T, 5),
    ("RESULTAT_COURANT", "1 187 736,60", "CPC", "Résultat courant", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", T, 5),
    ("PRODUITS_NON_COURANTS", "64 027,85", "CPC", "Produits non courants", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", "DETAIL", 5),
    ("CHARGES_NON_COURANTES", "71 955,29", "CPC", "Charges non courantes", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", "DETAIL", 5),
    ("RESULTAT_NON_COURANT", "-7 927,44", "CPC", "Résultat non courant", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", T, 5),
    ("RESULTAT_AVANT_IMPOT", "1 179 809,16", "CPC", "Résultat avant impôts", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", T, 5),
    ("IMPOT_SUR_RESULTATS", "0,00", "CPC", "Impôts sur les résultats", "3 = 1 + 2", "TOTAL_EXERCICE_N", "N", "DETAIL", 5),
    ("REDEVANCES_CREDIT_BAIL", "21 729,13", "DETAIL_CPC", "Redevances de crédit-bail", "Exercice", "EXERCICE_N", "N", "DETAIL", 6),
]
CPC, PASSIF = ("CPC", "TOTAL_EXERCICE_N"), ("BILAN_PASSIF", "EXERCICE_N")
line = lambda code, raw, label, where, page=1, column=None, period="N", nature="DETAIL": (code, raw, where[0], label, column, where[1], period, nature, page)
ODD = {
    "gross": [line("ACTIFS_IMMOBILISES", "32 512 391,02", "TOTAL I", ("BILAN_ACTIF", "NET_N"), column="Net", nature=T), line("ACTIFS_IMMOBILISES", "99 999 999,00", "TOTAL I", ("BILAN_ACTIF", "BRUT"), column="Brut", nature=T)],
    "before": [line("TOTAL_ACTIF", "43 807 944,82", "TOTAL GENERAL I+II+III", ("BILAN_ACTIF", "NET_N"), column="Net", nature="GRAND_TOTAL"), line("TOTAL_ACTIF", "40 074 741,35", "TOTAL GENERAL I+II+III", ("BILAN_ACTIF", N1), column="Exercice précédent", period="N_MINUS_1", nature="GRAND_TOTAL")],
    "part": [line("TOTAL_ACTIF", "10 000,00", "TOTAL I", ("BILAN_ACTIF", "NET_N"), column="Net", nature="GRAND_TOTAL")],
    "outlier": [line("CHIFFRE_AFFAIRES", "13.404.177,00", "Chiffres d'affaires", CPC, 4), line("RESULTAT_COURANT", "1.187.736,60", "RESULTAT COURANT (III - VI)", CPC, 4), line("RESULTAT_EXPLOITATION", "12.022.593,73", "Résultat d'exploitation (1 - II)", CPC, 4)],
    "pages": [line("RESULTAT_EXPLOITATION", "89 598,00", "Résultat d'exploitation", CPC, 5), line("RESULTAT_EXPLOITATION", "85 958,00", "VI. (+/-) RESULTAT D'EXPLOITATION", CPC, 9)],
    "sales": [line("CHIFFRE_AFFAIRES", "4 746 419,00", "Ventes de marchandises (en l'état)", CPC, 5)],
    "bare": [line("DEDUCTIONS", "85 958,00", "Total", ("RESULTAT_FISCAL", "NET_N"), 8), line("DEDUCTIONS", "0,00", "DEDUCTIONS FISCALES", ("RESULTAT_FISCAL", "NET_N"), 8)],
    "bought": [
        line("ACHATS_REVENDUS", "9.295.560,07", "Achats revendus de marchandises", CPC, 4), line("ACHATS_REVENDUS", "9 116 859,07", "ACHATS de marchandises", CPC, 6),
        line("ACHATS_CONSOMMES", "430.367,29", "Achat consommés de matières et de fourniture", CPC, 4), line("CHIFFRE_AFFAIRES", "9 116 859,07", "ACHATS de marchandises", CPC, 6),
    ],
    "wrong": [
        line("CHIFFRE_AFFAIRES", "13.404.177,00", "Chiffres d'affaires", CPC, 4), line("CHIFFRE_AFFAIRES", "9 116 859,07", "ACHATS de marchandises", CPC, 6), line("CHIFFRE_AFFAIRES", "13.404.177,00", "Total", CPC, 7),
        line("RESULTAT_NET", "1.187.736,60", "RESULTAT COURANT (III - VI)", CPC, 4), line("RESULTAT_NET", "1.179.809,16", "Résultat net de l'exercice (2)", PASSIF, 3),
        line("RESULTAT_FISCAL", "1.179.809,16", "RESULTAT NET ( XI - XII )", ("RESULTAT_FISCAL", "NET_N"), 5),
    ],
    "amounts": [
        line("ACTIFS_IMMOBILISES", "338.562,41", "338.562,41", ("BILAN_ACTIF", "UNKNOWN"), 2), line("ACTIF_CIRCULANT", "21.763.766,88", "21.763.766,88", ("BILAN_ACTIF", "UNKNOWN"), 2),
        line("TRESORERIE_ACTIF", "201.167,82", "201.167,82", ("BILAN_ACTIF", "UNKNOWN"), 2), line("FONDS_PROPRES", "9.114.715,17", "9.114.715,17", ("BILAN_PASSIF", "UNKNOWN"), 3),
        line("CHARGES_FINANCIERES", "200.928,82", "TOTAL V", CPC, 4), line("CHARGES_FINANCIERES", "0.00", "0.00", CPC, 6), line("REPORT_DEFICITAIRE", "1.187.736,60", "RESULTAT COURANT ( Report )", ("RESULTAT_FISCAL", "TOTAL_EXERCICE_N"), 5),
    ],
    "tie": [line("CLIENTS", "100,00", "Clients et comptes rattachés", ("BILAN_ACTIF", "NET_N")), line("CLIENTS", "200,00", "clients et comptes rattaches", ("BILAN_ACTIF", "NET_N"))],
    "none": [line("UNKNOWN", "5,00", "?", CPC)],
}


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(d, i, c, v, p, n, 0.9, page, kind, lab, col, role, f"| {lab} | {v} |", 0, []) for d, lines in {"whole": FILING, **ODD}.items() for i, (c, v, kind, lab, col, role, p, n, page) in enumerate(lines)]
    return spark.createDataFrame(rows, CANDIDATE)


@pytest.fixture(scope="module")
def fields(candidates):
    resolved = R.resolved_fields(V.common_candidates(candidates)).cache()
    rows = {r.document_id: r.asDict(recursive=True) for r in resolved.collect()}
    return resolved, {d: {k: (v["value"], v["status"]) for k, v in r.items() if isinstance(v, dict) and v["status"]} for d, r in rows.items()}


def test_a_whole_filing(fields):
    got = {k: v for k, v in fields[1]["whole"].items()}
    want = {c: D(v.replace(" ", "").replace(",", ".")) for c, v, *_, p, _, _ in FILING if p == "N" and not c.startswith("RESULTAT_NET_X")}
    want |= {"CHIFFRE_AFFAIRES_N1": D("24105417.32"), "RESULTAT_NET_N1": D("670378.06"), "RESULTAT_NET": D("1179809.16"), "TOTAL_BILAN": D("22303497.11"), "RESULTAT_FINANCIER": D("-193846.67"), "ACHATS_TOTAL": D("9725927.36"), "TRESORERIE_NETTE": D("201167.82")}
    assert {k: got[k][0] for k in want} == want
    assert got["RESULTAT_FINANCIER"][1] == "derived" and got["TOTAL_BILAN"][1] == "confirmed" and got["ENCOURS_LEASING"] == (None, "missing") and got["RESULTAT_EXPLOITATION"] == (None, "missing")


def test_odd_cases(fields):
    got = fields[1]
    assert got["gross"]["ACTIFS_IMMOBILISES"][0] == D("32512391.02")
    assert got["before"]["TOTAL_BILAN_N1"][0] == D("40074741.35") and got["before"]["TOTAL_ACTIF"][0] == D("43807944.82")
    assert "TOTAL_ACTIF" not in got["part"] and got["part"]["TOTAL_BILAN"] == (None, "missing")
    assert got["outlier"]["RESULTAT_EXPLOITATION"] == (None, "missing")
    assert got["pages"]["RESULTAT_EXPLOITATION"] == (D("89598.00"), "confirmed")
    assert got["sales"]["CHIFFRE_AFFAIRES"] == (D("4746419.00"), "confirmed")
    assert got["bare"]["DEDUCTIONS"] == (D("0.00"), "confirmed")
    assert got["bought"]["ACHATS_REVENDUS"] == (D("9295560.07"), "confirmed") and got["bought"]["ACHATS_TOTAL"][0] == D("9725927.36")
    assert got["wrong"]["CHIFFRE_AFFAIRES"] == (D("13404177.00"), "confirmed") and got["wrong"]["RESULTAT_NET"] == (D("1179809.16"), "confirmed") and "RESULTAT_FISCAL" not in got["wrong"]
    assert got["amounts"]["TOTAL_BILAN"][0] == D("22303497.11") and got["amounts"]["CHARGES_FINANCIERES"][0] == D("200928.82") and "REPORT_DEFICITAIRE" not in got["amounts"]
    assert got["tie"]["CLIENTS"] == (None, "conflicting")
    assert "none" not in got


def test_where_values_come_from(candidates):
    competing = R.slots(R.prepare(V.common_candidates(candidates)))
    data = R.to_dataset(R.fields_of(competing), vision=True)
    rows = R.provenance(data, competing.withColumn("clash", F.lit(1))).collect()
    behind = {}
    for r in sorted(rows, key=lambda r: (r.source, r.place)):
        behind.setdefault((r.document_id, r.code), []).append((r.raw_label, r.page_number))
    at = lambda code, doc="whole": behind[doc, code]
    sides, net = [("TOTAL GENERAL I+II+III", 2), ("TOTAL I+II+III", 3)], [("XIII Résultat net", 5), ("XVI Résultat net", 5)]
    equity, fixed, debts = ("TOTAL DES CAPITAUX PROPRES", 3), ("TOTAL I", 2), ("TOTAL DES DETTES DE FINANCEMENT", 3)
    cash = [("TOTAL TRESORERIE-ACTIF", 2), ("Trésorerie-Passif", 3)]
    assert at("TOTAL_BILAN") == sides and at("RESULTAT_NET") == net and at("STOCKS") == [("TOTAL STOCKS", 2)] and at("TRESORERIE_NETTE") == cash
    assert at("RESULTAT_FINANCIER") == [("Produits financiers", 5), ("Charges financières", 5)] and at("ACHATS_TOTAL") == [("Achats revendus", 4), ("Achats consommés", 4)]
    # current sides give the working capital, and it goes on into its own derivation; cash stands there once
    current = [("TOTAL II", 2), cash[0], ("TOTAL DU PASSIF CIRCULANT", 3), cash[1]]
    assert at("FDR") == current and at("BFDR") == current
    assert at("CLIENTS", "tie") == [("Clients et comptes rattachés", 1), ("clients et comptes rattaches", 1)]  # both readings of a conflict
    parts = [at(c, "amounts")[0] for c in ("ACTIFS_IMMOBILISES", "ACTIF_CIRCULANT", "TRESORERIE_ACTIF")]
    assert at("TOTAL_ACTIF", "amounts") == parts == at("TOTAL_BILAN", "amounts")  # a total of its parts, and the balance from it
    assert at("FDR", "amounts") == [at("FONDS_PROPRES", "amounts")[0], parts[0]] and ("none", "STOCKS") not in behind and ("whole", "ENCOURS_LEASING") not in behind
    assert equity in at("FONDS_PROPRES") and fixed in at("ACTIFS_IMMOBILISES") and debts in at("DETTES_FINANCIERES")


def test_dataset_of_the_filing(fields):
    resolved = fields[0]
    text, vision = ({r.document_id: r for r in R.to_dataset(resolved, v).collect()}["whole"] for v in (False, True))
    assert text.TRESORERIE_NETTE.value == D("201167.82") and text.FDR.value == D("21763766.88") + D("201167.82") - D("13055473.83")
    assert text.CAF.status == "missing" and vision.BFDR.value == vision.FDR.value - vision.TRESORERIE_NETTE.value
    part = {r.document_id: r for r in R.to_dataset(resolved, True).collect()}["amounts"]
    assert part.FDR.value == D("9114715.17") - D("338562.41")  # absent debts count as 0 here alone
    long = R.dataset_values(R.to_dataset(resolved)).where("document_id = 'tie' and code = 'CLIENTS'").first()
    assert (long.value, long.status) == (None, "conflicting")
    st = R.statement_of(R.to_dataset(resolved)).where("document_id = 'whole'").first()
    assert (st.ca, st.ca_n1, st.leasing) == (D("13404177.0000"), D("24105417.3200"), None)


def test_replies_of_a_model(spark):
    replies = [
        ("d", 1, "CPC", '```json\n{"candidates": [{"field_code": "ca", "value": 12.5, "period": "N-1", "evidence": {"column_role": "4"}}, {"field_code": "", "value": 1}, {"field_code": "X"}]}\n```'),
        ("d", 2, "CPC", 'Here: {"field_code": "RN", "raw_value": "7,00", "nature": "odd", "confidence": 0}'),
        ("d", 3, "CPC", '[{"field_code": "CAPITAUX_PROPRES", "raw_value": " 1 ", "label": "x"}]'),
        ("d", 4, "CPC", "no JSON"),
        ("d", 5, "CPC", None),
    ]
    got = V.coerce_candidates(spark.createDataFrame(replies, "document_id string, page_number int, page_type string, reply string")).orderBy("ordinal")
    assert [(r.field_code, r.raw_value, r.period, r.nature, r.confidence, r.raw_label, r.column_role) for r in got.collect()] == [
        ("CHIFFRE_AFFAIRES", "12.5", "N_MINUS_1", "DETAIL", 0.7, "ca", "EXERCICE_N1"), ("RESULTAT_NET", "7,00", "N", "DETAIL", 0.7, "RN", "UNKNOWN"), ("FONDS_PROPRES", "1", "N", "DETAIL", 0.7, "x", "UNKNOWN"),
    ]
    assert got.where(V.valid_candidate()).count() == 3
    schema = "struct<page_type:string,rows:array<struct<label:string>>>"
    texts = spark.createDataFrame([('x {"page_type": "CPC", "rows": [{"label": "a"}]} y',), ('{"page_type": "CPC", "rows": [{"lab',), ("nothing",), (None,)], "t string")
    assert [r.p and (r.p.page_type, r.p.rows and r.p.rows[0].label) for r in texts.select(V.lenient_payload(F.col("t"), schema).alias("p")).collect()] == [("CPC", "a"), ("CPC", None), None, None]


def test_attempts_and_codes(spark):
    rows = [("d", 1, 1, "CPC", ["X", "Y", "Z"], 5), ("d", 1, 2, "CPC", ["ACHATS"], 6), ("d", 1, 3, "CPC", ["A"] * 9, 7), ("d", 2, 1, "ESG", [], 1), ("d", 2, 2, "CPC", [], 2)]
    got = {r.page_number: (r.attempt, r.meaningful, r.latency_ms, r.n_attempts) for r in V.best_attempt(spark.createDataFrame(rows, "document_id string, page_number int, attempt int, page_type string, codes array<string>, latency_ms long")).collect()}
    assert got == {1: (1, False, 11, 2), 2: (1, False, 3, 2)}
    cands = spark.createDataFrame([("CPC", "CA"), ("CPC", "STOCKS"), ("FREE", "ANY")], "page_type string, field_code string")
    allowed = spark.createDataFrame([("CPC", "CA")], "page_type string, field_code string")
    assert sorted(r.field_code for r in V.allowed_codes(cands, allowed).collect()) == ["ANY", "CA"]


def test_provenance(spark, candidates):
    values = spark.createDataFrame([("whole", "STOCKS", "total stocks", "949 635,00"), ("whole", "OTHER", "Résultat net", "670 378,06"), ("whole", "NONE", "x", "1")], "document_id string, code string, raw_label string, raw_value string")
    got = {r.code: (r.page_type, r.column_role) for r in V.patch_provenance(values, candidates).collect()}
    assert got == {"STOCKS": ("BILAN_ACTIF", "NET_N"), "OTHER": ("CPC", "EXERCICE_N1"), "NONE": (None, None)}
    assert V.union_candidates(candidates.where("document_id = 'whole'"), candidates.where("document_id = 'whole'").withColumn("ordinal", F.col("ordinal") + 99)).count() == len(FILING)


def test_texts_are_folded_once(candidates):
    """A rule names its label many times; the plan must not fold it as often."""
    plan = R.prepare(V.common_candidates(candidates))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 60


def test_folds_of_odd_texts(spark):
    odd = ["", "  Total  Général_1   x ", "DETTEES, dettees d’œuvre", "été !!", "Solid es / − 12,5", "a b\tc", "XdetteesX", "ßİ", "--"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*odd, None])], "i int, t string")
    got = {r.i: (r.o, r.s, r.m) for r in rows.select("i", L.fold(F.col("t")).alias("o"), L.fold(F.col("t"), "strict").alias("s"), L.strip_markers(F.col("t")).alias("m")).collect()}
    assert got[0] == ("", "", "") and got[9] == ("", "", None)
    assert got[1][:2] == ("total general_1 x", "total general 1 x")
    assert got[2][0] == "dettes dettes d oeuvre" and got[3][:2] == ("ete", "ete") and got[4][0] == "soldes 12 5" and got[5][0] == "a b c" and got[6][0] == "xdetteesx" and got[8][:2] == ("", "")


def test_audit_makes_its_candidates_once(spark):
    """They are counted and resolved, and were made from the order tables for each."""
    out = Q.mapping_audits(spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_move_once(spark):
    """Choices are within a document: candidates were shuffled once more for their copies, their sections and their order."""
    cands = spark.range(10).selectExpr("cast(id as string) document_id", "id ordinal", "'CAF' field_code", "'1,00' raw_value", "'ESG' page_type", "'x' raw_label", "'y' column_name", "'NET_N' column_role", "'N' period", "'DETAIL' nature", "1 page_number", "0.9d confidence", "'z' source_excerpt", "array('w') warnings")
    out = R.resolved_fields(V.common_candidates(cands)).select("document_id", "CAF")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_steps_of_folds(spark):
    """Folds made step by step, with a shorter way for plain texts, are the folds made at once."""
    odd = ["", " Total  Général_1 x ", "DETTEES d’œuvre", "Æ é !!", "Solid es / − 12,5", "a b\tc_D", "ßİ", "1 234,50", "́ȩ́", "K½²", "Ａb", "日本 x", "-_-"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*odd, None])], "i int, t string")
    whole = rows.select("i", L.fold(F.col("t")).alias("o"), L.fold(F.col("t"), "strict").alias("s"), L.normalize_label(F.col("t")).alias("n"))
    steps = L.with_folds(rows, o="t").withColumn("l", L.latin(F.col("t"))).select("i", "o", L.strict(F.col("l")).alias("s"), L.normal(F.col("l")).alias("n"))
    assert sorted(whole.collect()) == sorted(steps.collect())


def test_reasons_are_told_once_a_group(spark, candidates):
    """Candidates are counted by what reasons read and then judged; they were judged one by one."""
    cands = V.common_candidates(candidates)
    rows = R.prepare(cands).groupBy("field_code", "reasons", "ok").agg(F.count("*").alias("n")).collect()
    out = R.reason_counts(cands)
    key = lambda r: (r.field_code, tuple(r.reasons), r.ok, r.n)
    assert sorted(map(key, rows)) == sorted(map(key, out.collect())) and any(r.n > 1 for r in rows)
    plan = Q.candidate_reasons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(plan) if "count(1)" in x)
    assert any("stock_variation" in x for x in plan[:first]) and not any("stock_variation" in x for x in plan[first:])


def test_audit_lists_a_row_of_fields(spark, candidates):
    """A document's fields stand in one row and are listed there; they were made rows and grouped again."""
    cands = V.common_candidates(candidates)
    data = R.to_dataset(R.resolved_fields(cands)).localCheckpoint()
    rows = A.mapping_audit(cands, R.dataset_values(data)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, A.dataset_audit(cands, data).collect())) and any(r.conflicting for r in rows) and any(r.missing for r in rows)
    assert "collect_set" not in Q.mapping_audits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
