"""Sections and fields of page text."""

import time
from decimal import Decimal as D

from pyspark.sql import functions as F

from grandlivre.functions import labels as L
from grandlivre.functions.pages import amounts_in, clean_identity
from grandlivre.operators import native as N
from grandlivre.operators import classify
from grandlivre.operators import resolve as W
from grandlivre.operators import sections as S
from grandlivre.operators import tables as T

LONG = "ligne de texte assez longue pour compter "


def split(spark, *texts):
    rows = [("d", i + 1, "ok", t) for i, t in enumerate(texts)]
    got = S.split_sections(spark.createDataFrame(rows, "document_id string, page_number int, status string, content string"))
    return [(r.page_number, r.section, r.text) for r in got.orderBy("page_number", "part").collect()]


def test_starts_and_ends(spark):
    df = spark.createDataFrame([("x Bilan - Actif y BILAN PASSIF bilan passif",), ("",)], "t string")
    got = [[tuple(s) for s in r[0]] for r in df.select(S.section_starts(F.col("t"))).collect()]
    assert got == [[(2, "BILAN_ACTIF"), (18, "BILAN_PASSIF"), (31, "BILAN_PASSIF")], []]
    near = df.select(S.section_starts(F.col("t"), S.STARTS, 14)).first()[0]
    assert [s.pos for s in near] == [2, 18]  # 13 after the last kept one
    ends = S.segment_end(spark.createDataFrame([("d", 0, 9), ("d", 4, 9)], "k string, start int, n int"), ["k"], "start", "n")
    assert sorted((r.start, r.end) for r in ends.collect()) == [(0, 4), (4, 9)]


def test_pages_continue_sections(spark):
    got = split(spark, "Bilan Actif " + LONG, LONG, "[PAGE VIDE]", LONG * 2 + "Compte de produits et charges " + LONG, "short")
    assert [g[:2] for g in got] == [(1, "BILAN_ACTIF"), (2, "BILAN_ACTIF"), (4, "BILAN_ACTIF"), (4, "CPC"), (5, "CPC")]
    assert split(spark, LONG, "Capitaux propres et dettes de financement " + LONG)[1][1] == "BILAN_PASSIF" and split(spark, LONG)[0][1] == "AUTRE"
    two = split(spark, "Identification du contribuable " + LONG + "\nImmobilisations corporelles 12 " + LONG)
    assert [g[1] for g in two] == ["IDENTIFICATION", "BILAN_ACTIF"] and two[1][2].startswith("Immobilisations")


def test_parts_and_chunks(spark):
    text = "Capitaux propres 1\n" + "a" * 30 + "\nDettes de financement 2\n" + "b" * 30
    df = spark.createDataFrame([("d", "BILAN_PASSIF", text), ("d", "AUTRE", "x\n" * 40)], "document_id string, section string, text string")
    got = [(r.section, r.chunk, len(r.text)) for r in S.chunk_sections(df, 100).collect()]
    assert got[0][0] == "BILAN_PASSIF" and len([g for g in got if g[0] == "BILAN_PASSIF"]) == 2 - (len(text) <= 100)
    assert [r.text for r in S.chunk_sections(df.where("section = 'BILAN_PASSIF'"), 90).collect()] == ["SOUS-SECTION : CAPITAUX_PROPRES\n\nCapitaux propres 1\n" + "a" * 30, "SOUS-SECTION : DETTES_FINANCEMENT\n\nDettes de financement 2\n" + "b" * 30]
    assert all(n <= 30 for _, _, n in [(r.section, r.chunk, len(r.text)) for r in S.chunk_sections(df.where("section = 'AUTRE'"), 30).collect()])


def test_amounts(spark):
    df = spark.createDataFrame([("a 1234,56 b 12345,00 c 1 234,50 d 1.234.567,89 e 12.50 f 7",), (None,)], "t string")
    got = df.select(amounts_in(F.col("t")).alias("a"), amounts_in(F.col("t"), "grouped").alias("b")).collect()
    assert got[0].a == ["1234,56", "12345,00", "1 234,50", "1.234.567,89", "12.50"] and got[0].b == ["1234,56", "12345,00", "1 234,50", "567,89"] and got[1].a == []
    assert spark.range(1).select(*(c.alias(n) for n, c in clean_identity({"a": F.lit(" x "), "b": F.lit(None).cast("string")}, ("a",)).items())).first().asDict() == {"a": "X", "b": ""}


def test_native_text(spark):
    text = "Chiffres d'affaires\n1 500,00 2 000,00\n" + "-" * 600 + "\nTrésorerie-Actif 900,00 100,00 250,00 180,00\n" + "-" * 600 + "\nClients et comptes rattachés page 7 seulement"
    got = {r.code: (r.raw_value, r.parsed_value) for r in N.native_observations(spark.createDataFrame([("d", text), ("e", None)], "document_id string, text string")).collect()}
    assert got["CHIFFRE_AFFAIRES"] == ("2 000,00", D("2000.0000")) and got["CA_N1"][1] == D("2000.0000") and got["TRESORERIE_ACTIF"][1] == D("250.0000") and "CREANCES_CLIENTS" not in got
    words = N.keyword_amounts(spark.createDataFrame([("d", "Le résultat net : 1 234,50 et Total du bilan ............. 99")], "document_id string, text string"))
    assert {r.code: r.value for r in words.collect()} == {"RESULTAT_NET": D("1234.5000"), "TOTAL_BILAN": D("99.0000")}
    meta = N.extract_metadata(F.col("t"))
    pages = spark.createDataFrame([("Référence liasse : R1\nRaison Sociale :\n SOCIETE X\nIdentifiant fiscal :\n 12 34567\nau titre de la période du 01/01/2023 au 31/12/2023",), ("Identification du contribuable\nAdresse x\n12,5\nMAISON Y\nTableau : 1",), (None,)], "t string")
    a, b, c = pages.select(*(v.alias(k) for k, v in meta.items())).collect()
    assert (a.reference, a.entreprise, a.identification_fiscale, a.exercice, a.date_fin_exercice) == ("R1", "SOCIETE X", "12 34567", "2023", "31/12/2023") and b.entreprise == "MAISON Y" and c.entreprise is None


def test_reports(spark):
    text = "Rapport des Éléments Financiers\n3 Chiffre d'affaires 12 000,00 MAD CPC\n18 Résultat net 500,00 MAD Bénéficiaire CPC\n13 Trésorerie à l'actif 0,00 MAD Bilan Actif\nÉléments Bruts de Calcul\n| Stocks | 7,00 MAD | Bilan Passif | x |\nAchats 5,00 MAD CPC y\nAchats 6,00 MAD CPC z"
    texts = spark.createDataFrame([("d", text)], "document_id string, text string")
    lines, parts = N.report_lines(texts), N.report_components(texts)
    assert [(r.number, r.code, r.note) for r in lines.orderBy("line").collect()] == [(3, "CHIFFRE_AFFAIRES", None), (18, "RESULTAT_NET", "Bénéficiaire"), (13, "TRESORERIE_ACTIF", None)]
    assert sorted((r.label, r.value) for r in parts.collect()) == [("Achats", D("5.0000")), ("Stocks", D("7.0000"))]
    judged = N.assess_sections(lines, parts)
    assert {r.code: (r.value, r.confidence) for r in judged.collect()} == {"CHIFFRE_AFFAIRES": (D("12000.0000"), 0.9), "RESULTAT_NET": (D("500.0000"), 0.9), "TRESORERIE_ACTIF": (None, 0.0)}
    row = N.report_scoring_input(judged).first()
    assert (row.chiffre_affaires, row.tresorerie_nette) == (D("12000.0000"), None)
    kinds = texts.select(N.is_report(F.col("text")), N.is_native_filing(F.col("text"))).first()
    assert tuple(kinds) == (True, False)
    gates = N.forecast_gate(spark.createDataFrame([("forecast_financial_statements", "actual"), ("tax_return", "actual"), ("tax_return", "interim")], "document_type string, period_type string")).collect()
    assert [(r.admitted, r.mode) for r in gates] == [(False, "forecast_review"), (True, "actual"), (False, "forecast_review")]


def test_recovery(spark):
    pages = [
        ("d", 1, "CPC", "Compte de produits et charges\nVentes de marchandises 4 746 419,00 1,00\nCharges\n89 598,00 III. RESULTAT D'EXPLOITATION (I-II)"),
        ("d", 2, "BILAN_PASSIF", "DETTES DE FINANCEMENT (C)\nprovisions durables 5,00\nTresorerie - passif\nTOTAL III 77,00 et la suite du texte"),
        ("e", 1, None, "Achats revendus de marchandises 12,50 et encore du texte pour faire quarante"),
    ]
    cands = spark.createDataFrame([("e", 5, "CHIFFRE_AFFAIRES", "1,00", 1)], "document_id string, ordinal long, field_code string, raw_value string, page_number int")
    got = N.recover(cands, spark.createDataFrame(pages, "document_id string, page_number int, page_type string, text string"))
    assert sorted((r.document_id, r.field_code, r.raw_value) for r in got.collect()) == [
        ("d", "CHIFFRE_AFFAIRES", "4 746 419,00"), ("d", "DETTES_FINANCIERES", "0,00"), ("d", "RESULTAT_EXPLOITATION", "89 598,00"), ("d", "TRESORERIE_PASSIF", "0,00"), ("e", "ACHATS_REVENDUS", "12,50"), ("e", "CHIFFRE_AFFAIRES", "1,00"),
    ]


def test_tables_with_sections(spark):
    pages = [("d", 1, "ok", "Bilan actif\n| Libellé | Brut | Net | Net |\n|---|---|---|---|\n| Stocks | 1 | 2 | 3 |\n| -- | 9 | 9 | 9 |\n|  | 1 | 1 | 1 |\n| CPC inside | 4 |"), ("d", 2, "ok", "suite\n| a | |\n| b | 5 |"), ("d", 3, "error", "x"), ("d", 4, "ok", "Compte de produits et charges plus bas"), ("d", 5, "ok", "| one |\n| two |")]
    got = T.financial_rows(spark.createDataFrame(pages, "document_id string, page_number int, status string, content string")).orderBy("page_number", "row").collect()
    assert [(r.page_number, r.section, r.raw_label, r["values"]) for r in got] == [(1, "BILAN_ACTIF", "Stocks", {"brut": "1", "net_n": "3"}), (1, "BILAN_ACTIF", "CPC inside", {"brut": "4", "net_n": None}), (2, "BILAN_ACTIF", "b", {"value": "5"})]


def test_small_rules(spark):
    df = spark.createDataFrame([("IDENTIFICATION", 1, "x"), ("IDENTIFICATION", 2, "x"), ("IDENTIFICATION", 2, "identification du contribuable"), ("CPC", 2, None)], "t string, n int, f string")
    assert [r[0] for r in df.select(classify.demote_identification(F.col("t"), F.col("n"), F.col("f"))).collect()] == ["IDENTIFICATION", None, "IDENTIFICATION", "CPC"]
    years = spark.createDataFrame([(1, 2020, 5.0, None), (1, 2021, 6.0, 1.0), (1, 2022, 7.0, None)], "k int, y int, ca double, ca_n1 double")
    assert [r.ca_n1 for r in W.with_previous(years, "k", "y", "ca", "ca_n1").orderBy("y").collect()] == [None, 1.0, 6.0]
    words = spark.createDataFrame([("ﬁnance² Ａ", "Dettees  d'Été"), (None, None)], "a string, b string")
    got = words.select(L.normalize_label_full(F.col("a")).alias("full"), L.fold(F.col("b")).alias("ocr"), L.fold(F.col("b"), "strict").alias("strict"), L.fold(F.col("b"), "loose").alias("loose")).collect()
    assert tuple(got[0]) == ("finance2 a", "dettes d ete", "dettees d ete", "dettees d'ete") and tuple(got[1]) == ("", "", "", "")
    one = spark.range(1).select(L.strip_markers(F.lit(" 12 </think> ")).alias("m"), L.strip_fences(F.lit("```json\n{}\n```")).alias("f"), L.is_grand_total(F.lit("TOTAL I")).alias("no"), L.is_grand_total(F.lit("**Total général I + II + III**")).alias("yes"), L.token_overlap(F.lit("a b c"), F.lit("b c d")).alias("o"), L.column_nature(F.lit("Net exercice N-1")).alias("c"), T.md_column(F.lit("")).alias("v")).first()
    assert tuple(one) == ("12", "{}", False, True, 0.5, "net_n_1", "value")


def test_keyword_signs_and_recovered_zeros(spark):
    texts = [("a", "Résultat net : −5 000,00"), ("b", "Résultat net : -5 000,00 et la suite"), ("c", "Résultat net de l'exercice 7")]
    got = {r.document_id: (r.raw_value, r.value) for r in N.keyword_amounts(spark.createDataFrame(texts, "document_id string, text string")).collect()}
    assert got == {"a": ("−5 000,00", D("-5000.0000")), "b": ("-5 000,00", D("-5000.0000")), "c": ("7", D("7.0000"))}
    far, near = "x" * 500, "x" * 100
    pages = [
        ("far", 1, "BILAN_PASSIF", f"DETTES DE FINANCEMENT (C) {far} 1 000,00 fin"), ("near", 1, "BILAN_PASSIF", f"DETTES DE FINANCEMENT (C) {near} 1 000,00 fin"),
        ("digits", 1, "BILAN_PASSIF", f"DETTES DE FINANCEMENT (C) 12,345 {far} fin"), ("closed", 1, "BILAN_PASSIF", f"DETTES DE FINANCEMENT (C) {far} 1 000,00 provisions durables"),
        ("two", 1, "CPC", "Compte de produits et charges 1,00 12 000,00 13 000,00 III. RESULTAT D'EXPLOITATION"), ("none", 1, "CPC", "Compte de produits et charges 1,00 puis III. RESULTAT D'EXPLOITATION"),
    ]
    cands = spark.createDataFrame([], "document_id string, ordinal long, field_code string, raw_value string, page_number int")
    out = N.recover(cands, spark.createDataFrame(pages, "document_id string, page_number int, page_type string, text string")).where("field_code in ('DETTES_FINANCIERES', 'RESULTAT_EXPLOITATION')")
    assert sorted((r.document_id, r.raw_value) for r in out.collect()) == [("digits", "0,00"), ("far", "0,00"), ("two", "12 000,00")]


def test_native_fallback(spark):
    text = (
        "Bilan (actif)\nIMMOBILISATIONS CORPORELLES (C)\n 12 000,00 11 000,00\nTOTAL II (F+G+H+I)\nTOTAL II (F+G+H+I)\n 5 500\nTOTAL III\nTOTAL III\n 77 000,10\nBilan (passif)\nCAPITAUX PROPRES (A) 9 000,00 8 000,00\n"
        "DETTES DE FINANCEMENT (C) 50 3 000,00 -4 000,00\nPROVISIONS DURABLES 99 000,00\nAchats revendus de marchandises\n 2 222,00\n" + "z" * 400 + "\nCAF 9 999 999 999 999,00\nCrédit bail 400"
    )
    texts = spark.createDataFrame([("d", text), ("e", None), ("f", "rien"), ("g", "x" * 40 + "IMMOBILISATIONS CORPORELLES (C) 700 " + "y" * 10), ("h", "Résultat net 5 000,00")], "document_id string, text string")
    got = {(r.document_id, r.code): float(r.value) for r in N.native_fallback(texts).collect()}
    assert got == {
        ("d", "ACTIFS_IMMOBILISES"): 77000.1, ("d", "ACTIF_CIRCULANT"): 5500.0, ("d", "TOTAL_BILAN"): 77000.1, ("d", "FONDS_PROPRES"): 99000.0, ("d", "DETTES_BANCAIRES_MLT"): -4000.0, ("d", "ACHATS_REVENDUS"): 2222.0, ("d", "ENCOURS_LEASING"): 400.0,
        ("h", "RESULTAT_NET"): 5000.0,
    }
    assert {(r.document_id, r.source) for r in N.native_values(texts).collect()} == {("d", "observed"), ("g", "fallback"), ("h", "observed")} - ({("g", "fallback")} if ("g", "ACTIFS_IMMOBILISES") not in got else set())


def test_many_hits_stay_linear(spark):
    text = "Bilan actif 1 000,00\n" * 100_000
    row = spark.range(1).select(F.lit("Caisse 1 000,00 ").alias("a")).select(F.repeat("a", F.lit(20_000)).alias("text"), F.lit("d").alias("document_id"))
    began = time.time()
    found = N.native_observations(row).collect()
    assert [(r.code, r.parsed_value) for r in found] == [("CAISSE", D("1000.0000"))]
    at = spark.createDataFrame([(text,), ("",), (None,), ("no",)], "t string").select(S.positions(F.col("t"), "(?i)bilan").alias("p")).collect()
    assert at[0].p == list(range(0, len(text), 21)) and [r.p for r in at[1:]] == [[], None, []]
    assert time.time() - began < 120


def test_labels_are_found_in_one_scan(spark):
    """Each text was scanned twice, for what follows a label and for what comes before it."""
    text = "caisse -- total i 1\n(x) total ii" + "." * 9 + "caisse caisse"
    labels = ["caisse", "total i", "total ii", "(x)"]
    for before in (0, 5):
        rows = spark.createDataFrame([(text,)], "t string").select(N.label_windows(F.col("t"), labels, before, 4).alias("w"))
        led = "\n" * before + text
        want = [(i, led[p : p + before + len(x) + 4]) for p in range(len(text)) for i, x in enumerate(labels) if text.startswith(x, p)]
        assert sorted((w.label, w.window) for w in rows.first().w) == sorted(want)
        assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
