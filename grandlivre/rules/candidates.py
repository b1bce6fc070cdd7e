"""Rules of candidate resolution: where a field may stand, in which column, and how candidates are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The fields that each section may give.
SECTION_FIELDS = {
    "BILAN_ACTIF": ["TOTAL_ACTIF", "TOTAL_BILAN", "ACTIFS_IMMOBILISES", "ACTIF_CIRCULANT", "STOCKS", "CLIENTS", "TRESORERIE_ACTIF"],
    "BILAN_PASSIF": ["TOTAL_PASSIF", "TOTAL_BILAN", "FONDS_PROPRES", "RESULTAT_NET", "DETTES_FINANCIERES", "PASSIF_CIRCULANT", "FOURNISSEURS", "TRESORERIE_PASSIF"],
    "CPC": [
        "CHIFFRE_AFFAIRES", "RESULTAT_NET", "RESULTAT_NET_XIII", "RESULTAT_NET_XVI", "RESULTAT_EXPLOITATION", "PRODUITS_EXPLOITATION", "CHARGES_EXPLOITATION", "PRODUITS_FINANCIERS",
        "CHARGES_FINANCIERES", "RESULTAT_FINANCIER", "RESULTAT_COURANT", "PRODUITS_NON_COURANTS", "CHARGES_NON_COURANTES", "RESULTAT_NON_COURANT", "RESULTAT_AVANT_IMPOT",
        "IMPOT_SUR_RESULTATS", "ACHATS_REVENDUS", "ACHATS_CONSOMMES", "CHARGES_INTERETS", "DOTATIONS_AMORTISSEMENTS", "PRODUITS_CESSION_IMMOBILISATIONS",
        "VALEUR_NETTE_IMMOBILISATIONS_CEDEES", "CAF",
    ],
    "DETAIL_CPC": ["REDEVANCES_CREDIT_BAIL"],
    "RESULTAT_FISCAL": ["RESULTAT_FISCAL", "REINTEGRATIONS", "DEDUCTIONS", "IS_DU", "COTISATION_MINIMALE", "REPORT_DEFICITAIRE"],
}

# Fields that are also kept for the year before; the others are for the current year alone.
TWO_YEARS = ["CHIFFRE_AFFAIRES", "RESULTAT_NET", "FONDS_PROPRES", "TOTAL_ACTIF", "TOTAL_PASSIF", "TOTAL_BILAN"]
# Fields whose value of the year before has a code of its own.
PREVIOUS_CODES = {c: f"{c}_N1" for c in ("CHIFFRE_AFFAIRES", "RESULTAT_NET", "TOTAL_BILAN", "FONDS_PROPRES", "DETTES_FINANCIERES")}
# The column that a section's current amounts stand in, and the income statement's field without that rule.
CURRENT_ROLE = {"BILAN_ACTIF": "NET_N", "BILAN_PASSIF": "EXERCICE_N", "CPC": "TOTAL_EXERCICE_N"}
ANY_ROLE = ["CAF"]

# Points of a candidate by nature, for the expected section, the period and the matching column.
NATURE = {"GRAND_TOTAL": 400, "SECTION_TOTAL": 300, "SUBTOTAL": 200, "DETAIL": 100, "DERIVED_DISPLAYED": 50, "UNKNOWN": 0}
# Sections in which a field is expected.
EXPECTED = {
    "BILAN_ACTIF": ["STOCKS", "CLIENTS", "TRESORERIE_ACTIF", "ACTIF_CIRCULANT", "ACTIFS_IMMOBILISES", "TOTAL_ACTIF"],
    "BILAN_PASSIF": ["FOURNISSEURS", "DETTES_FINANCIERES", "FONDS_PROPRES", "PASSIF_CIRCULANT", "TRESORERIE_PASSIF", "TOTAL_PASSIF", "RESULTAT_NET"],
    "CPC": ["CHIFFRE_AFFAIRES", "RESULTAT_NET", "RESULTAT_NET_XIII", "RESULTAT_NET_XVI", "CHARGES_INTERETS", "REDEVANCES_CREDIT_BAIL"],
    "DETAIL_CPC": ["REDEVANCES_CREDIT_BAIL"],
}
# Wording that marks the field's own line.
HINTS = {
    "CLIENTS": ["clients et comptes rattaches"],
    "FOURNISSEURS": ["fournisseurs et comptes rattaches"],
    "CHIFFRE_AFFAIRES": ["chiffre d affaires"],
    "FONDS_PROPRES": ["total des capitaux propres"],
    "CHARGES_INTERETS": ["charges d interets"],
    "STOCKS": ["stocks"],
    "DETTES_FINANCIERES": ["dettes de financement", "total dettes de financement"],
    "TRESORERIE_ACTIF": ["total iii tresorerie actif", "tresorerie actif"],
    "TRESORERIE_PASSIF": ["total iii tresorerie passif", "tresorerie passif"],
    "CHARGES_FINANCIERES": ["charges financieres", "total v", "total des charges financieres"],
    "ACHATS_REVENDUS": ["achats revendus", "achats revendus de marchandises"],
    "ACHATS_CONSOMMES": ["achats consommes", "achat consommes"],
}
# Printed zeros.
ZEROS = ["0", "0 00", "0.00", "0,00"]
# Names under which the current total column of the income statement is read.
CPC_TOTAL_COLUMN = [
    "3 1 2", "3 = 1 + 2", "3=1+2", "totaux de l exercice", "totaux de lexercice", "total de l exercice", "total de lexercice", "taux du exercice", "taux de l exercice", "taux de lexercice",
]

# Fields of the dataset, in order.
DATASET = [
    "CHIFFRE_AFFAIRES", "CHIFFRE_AFFAIRES_N1", "RESULTAT_NET", "RESULTAT_NET_N1", "RESULTAT_EXPLOITATION", "TOTAL_BILAN", "TOTAL_BILAN_N1", "TOTAL_ACTIF", "TOTAL_PASSIF",
    "FONDS_PROPRES", "FONDS_PROPRES_N1", "ACTIFS_IMMOBILISES", "ACTIF_CIRCULANT", "PASSIF_CIRCULANT", "STOCKS", "CLIENTS", "FOURNISSEURS", "TRESORERIE_ACTIF", "TRESORERIE_PASSIF",
    "TRESORERIE_NETTE", "DETTES_FINANCIERES", "DETTES_FINANCIERES_N1", "DETTES_BANCAIRES_CT", "PRODUITS_EXPLOITATION", "CHARGES_EXPLOITATION", "PRODUITS_FINANCIERS",
    "CHARGES_FINANCIERES", "RESULTAT_FINANCIER", "RESULTAT_COURANT", "PRODUITS_NON_COURANTS", "CHARGES_NON_COURANTES", "RESULTAT_NON_COURANT", "RESULTAT_AVANT_IMPOT",
    "IMPOT_SUR_RESULTATS", "ACHATS_REVENDUS", "ACHATS_CONSOMMES", "ACHATS_TOTAL", "CHARGES_INTERETS", "DOTATIONS_AMORTISSEMENTS", "CAF", "FDR", "BFDR", "RESULTAT_FISCAL",
    "REINTEGRATIONS", "DEDUCTIONS", "IS_DU", "COTISATION_MINIMALE", "REPORT_DEFICITAIRE", "REDEVANCES_CREDIT_BAIL", "ENCOURS_LEASING", "CMT", "NOUVEAU_FINANCEMENT",
]


def allowed_fields(spark: SparkSession) -> DataFrame:
    """(section, field_code, expected) rows of the rules, at most a few dozen."""
    return spark.createDataFrame([(s, f, f in EXPECTED.get(s, [])) for s, fields in SECTION_FIELDS.items() for f in fields], "section string, field_code string, expected boolean")
