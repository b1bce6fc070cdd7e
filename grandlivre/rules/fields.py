"""The registry of observed fields, exclusions, metadata names and elements of an extraction result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NET, _GROSS, _YEAR, _ANY = ["net_n"], ["brut", "amortissement_provision", "net_n_1"], ["net_n", "exercice"], ["total_exercice", "exercice", "net_n"]
_CPC = ["total_exercice", "exercice"]
# Code, label, sections, aliases, preferred columns, forbidden columns, key of the scoring input, element number.
FIELDS = [
    ("ACTIFS_IMMOBILISES", "Actifs immobilisés", ["BILAN_ACTIF"], ["total i actif immobilise", "total actif immobilise", "actif immobilise", "actifs immobilises", "immobilisations"], _NET, _GROSS, "actifs_immobilises", 1),
    ("TOTAL_BILAN", "Total du bilan", ["BILAN_ACTIF", "BILAN_PASSIF"], ["total general", "total general i ii iii", "total actif", "total du bilan", "total passif"], _NET, _GROSS, "total_bilan", 2),
    ("CHIFFRE_AFFAIRES", "Chiffre d'affaires", ["CPC"], ["chiffre d affaires", "chiffres d affaires", "ventes de biens et services produits", "produits d exploitation"], _ANY, [], "chiffre_affaires", 3),
    ("CA_EXPORT", "CA à l'export", ["CPC"], ["dont a l export", "ventes a l export", "chiffre d affaires export", "ca a l export", "ca export"], _ANY, [], "ca_export", 4),
    ("CA_N1", "Chiffre d'affaires N-1", ["CPC", "BILAN_ACTIF", "AUTRE"], ["chiffre d affaires n 1", "chiffre d affaires exercice precedent", "ca n 1"], ["net_n_1", "exercice"], [], "ca_n1", None),
    ("DETTES_BANCAIRES_MLT", "Dettes bancaires MLT", ["BILAN_PASSIF"], ["dettes de financement", "emprunts aupres des etablissements de credit", "emprunts bancaires", "dettes bancaires moyen et long terme", "emprunts et dettes assimilées", "autres dettes de financement"], _YEAR, ["net_n_1"], "dettes_financieres", 5),
    ("DETTES_BANCAIRES_CT", "Dettes bancaires CT", ["BILAN_PASSIF"], ["tresorerie passif", "credits de tresorerie", "banques soldes crediteurs", "concours bancaires courants", "dettes bancaires court terme"], _YEAR, [], "dettes_bancaires_ct", 6),
    ("CREDITS_TRESORERIE", "Crédits de trésorerie", ["BILAN_PASSIF"], ["credits de tresorerie", "credit de tresorerie"], _YEAR, [], None, None),
    ("BANQUES_SOLDES_CREDITEURS", "Banques, soldes créditeurs", ["BILAN_PASSIF"], ["banques soldes crediteurs", "banques creditrices", "soldes crediteurs de banques"], _YEAR, [], None, None),
    ("PASSIF_CIRCULANT", "Passif circulant", ["BILAN_PASSIF"], ["passif circulant", "total ii passif circulant", "total passif circulant"], _YEAR, ["net_n_1"], "passif_circulant", 7),
    ("DETTES_FOURNISSEURS", "Dettes fournisseurs", ["BILAN_PASSIF"], ["fournisseurs et comptes rattaches", "fournisseurs", "dettes fournisseurs"], _YEAR, [], "fournisseurs", 8),
    ("COMPTE_COURANT_ASSOCIES", "Compte courant d'associés", ["BILAN_PASSIF"], ["comptes d associes crediteurs", "associes comptes courants", "comptes courants d associes", "associes", "compte courant d associes"], _YEAR, [], "compte_courant_associes", 9),
    ("TRESORERIE_PASSIF", "Trésorerie au passif", ["BILAN_PASSIF"], ["tresorerie passif", "total iii tresorerie passif", "tresorerie passif total"], _YEAR, [], "tresorerie_passif", 10),
    ("ACTIF_CIRCULANT", "Actif circulant", ["BILAN_ACTIF"], ["actif circulant", "total ii actif circulant", "total actif circulant"], _NET, _GROSS, "actif_circulant", 11),
    ("CREANCES_CLIENTS", "Créances clients", ["BILAN_ACTIF"], ["clients et comptes rattaches", "clients", "creances clients", "clients debiteurs"], _NET, _GROSS, "clients", 12),
    ("TRESORERIE_ACTIF", "Trésorerie à l'actif", ["BILAN_ACTIF"], ["tresorerie actif", "total iii tresorerie actif", "tresorerie"], _NET, ["brut", "net_n_1"], "tresorerie_actif", 13),
    ("CAISSE", "Caisse", ["BILAN_ACTIF"], ["caisse regies d avances et accreditifs", "caisse", "caisse et regies d avances"], _NET, ["brut", "net_n_1"], "caisse", 14),
    ("ACHATS_REVENDUS", "Achats revendus", ["CPC"], ["achats revendus de marchandises", "achats de marchandises", "achats revendus"], _CPC, [], "achats", 15),
    ("ACHATS_CONSOMMES", "Achats consommés de matières et fournitures", ["CPC"], ["achats consommes de matieres et fournitures", "achats consommes", "matieres et fournitures"], _CPC, [], None, None),
    ("AUTRES_CHARGES_EXTERNES", "Autres charges externes", ["CPC"], ["autres charges externes"], _CPC, [], None, None),
    ("IMPOTS_TAXES", "Impôts et taxes", ["CPC"], ["impots et taxes", "impots taxes"], _CPC, [], None, None),
    ("CHARGES_PERSONNEL", "Charges de personnel", ["CPC"], ["charges de personnel", "charges personnel"], _CPC, [], None, None),
    ("AUTRES_CHARGES_EXPLOITATION", "Autres charges d'exploitation", ["CPC"], ["autres charges d exploitation"], _CPC, [], None, None),
    ("DOTATIONS_EXPLOITATION", "Dotations d'exploitation", ["CPC"], ["dotations d exploitation", "dotations aux amortissements et provisions d exploitation"], _CPC, [], None, None),
    ("AUTRES_CHARGES", "Autres charges", ["CPC"], ["autres charges"], _CPC, [], None, 16),
    ("CHARGES_INTERETS", "Charges d'intérêts", ["CPC"], ["charges d interets", "interets des emprunts et dettes", "charges financieres d interets", "charges d interets et frais assimiles"], _CPC, [], "frais_financiers", 17),
    ("RESULTAT_NET", "Résultat net", ["CPC", "BILAN_PASSIF", "AUTRE"], ["resultat net de l exercice", "resultat net", "benefice net", "perte nette"], ["total_exercice", "net_n", "exercice"], ["exercices_precedents"], "resultat_net", 18),
    ("FONDS_PROPRES", "Fonds propres", ["BILAN_PASSIF"], ["total des capitaux propres", "capitaux propres", "capitaux propres assimilés", "fonds propres", "total i financement permanent"], _YEAR, [], "fonds_propres", None),
    ("CAF", "Capacité d'autofinancement", ["CPC", "AUTRE"], ["capacite d autofinancement", "caf", "autofinancement", "capacite d autofinancement globale"], _ANY, [], "caf", None),
    ("AMORTISSEMENTS", "Dotations aux amortissements", ["CPC"], ["dotations d exploitation", "dotations aux amortissements et provisions", "dotations aux amortissements"], _CPC, ["amortissement_provision", "brut", "net_n"], "amortissements", None),
    ("FDR", "Fonds de roulement", ["BILAN_PASSIF", "AUTRE"], ["fonds de roulement", "fonds de roulement fonctionnel"], _YEAR, [], "fdr", None),
]
# The field whose empty line counts as zero, and totals that are sums of components.
ZERO_IF_EMPTY = ["CA_EXPORT"]
COMPONENTS = {
    "DETTES_BANCAIRES_CT": ["CREDITS_TRESORERIE", "BANQUES_SOLDES_CREDITEURS"],
    "TRESORERIE_PASSIF": ["CREDITS_TRESORERIE", "BANQUES_SOLDES_CREDITEURS"],
    "AUTRES_CHARGES": ["ACHATS_CONSOMMES", "AUTRES_CHARGES_EXTERNES", "IMPOTS_TAXES", "CHARGES_PERSONNEL", "AUTRES_CHARGES_EXPLOITATION", "DOTATIONS_EXPLOITATION"],
}
# Wording that rules a label out for a field.
EXCLUSIONS = {
    "CHARGES_INTERETS": ["autres charges d exploitation", "autres charges externes", "charges de personnel", "dotations d exploitation"],
    "AMORTISSEMENTS": ["amortissements et provisions", "cumul des amortissements"],
    "TRESORERIE_PASSIF": ["passif circulant", "total passif circulant"],
    "DETTES_BANCAIRES_CT": ["passif circulant", "dettes de financement"],
}
# Names under which identification data are printed.
METADATA = {
    "reference": ["reference", "numero de depot", "n depot", "reference du depot", "sis"],
    "entreprise": ["raison sociale", "denomination sociale", "entreprise", "societe", "nom ou raison sociale"],
    "identification_fiscale": ["identifiant fiscal", "identification fiscale", "if", "n if"],
    "exercice": ["exercice", "annee", "periode"],
    "date_debut_exercice": ["date de debut", "du", "periode du", "date debut exercice"],
    "date_fin_exercice": ["date de fin", "au", "periode au", "date fin exercice"],
}
# Fields that count for completeness, beside the sign of the result.
REQUIRED = [
    "ACTIFS_IMMOBILISES", "TOTAL_BILAN", "CHIFFRE_AFFAIRES", "DETTES_BANCAIRES_MLT", "DETTES_BANCAIRES_CT", "PASSIF_CIRCULANT", "DETTES_FOURNISSEURS", "COMPTE_COURANT_ASSOCIES",
    "TRESORERIE_PASSIF", "ACTIF_CIRCULANT", "CREANCES_CLIENTS", "TRESORERIE_ACTIF", "ACHATS_REVENDUS", "AUTRES_CHARGES", "CHARGES_INTERETS", "RESULTAT_NET", "FONDS_PROPRES",
]
#: Fields that derivations add to those of the registry.
DERIVED = ["DETTES_FINANCIERES", "TRESORERIE_NETTE", "TYPE_RESULTAT"]
# The scoring input's key of fields that are named otherwise or derived.
SCORING_KEYS = {f[0]: f[6] for f in FIELDS if f[6] and f[0] not in ("DETTES_BANCAIRES_MLT", "CAISSE")} | {"DETTES_FINANCIERES": "dettes_financieres", "TRESORERIE_NETTE": "tresorerie_nette"}
ELEMENTS = sorted([(f[7], f[0], f[1]) for f in FIELDS if f[7]] + [(19, "TYPE_RESULTAT", "Type de résultat")])


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table: one row a field, at most a few dozen."""
    rows = [(*f[:6], f[0] in ZERO_IF_EMPTY, EXCLUSIONS.get(f[0], []), i) for i, f in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "code string, label string, sections array<string>, aliases array<string>, preferred array<string>, forbidden array<string>, zero_if_empty boolean, exclusions array<string>, pos int")


def aliases(spark: SparkSession) -> DataFrame:
    """(code, alias, pos) of the registry, in its order."""
    rows = [(f[0], a, i * 100 + j) for i, f in enumerate(FIELDS) for j, a in enumerate(f[3])]
    return spark.createDataFrame(rows, "code string, alias string, pos int")
