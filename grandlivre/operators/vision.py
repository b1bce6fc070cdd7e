"""Candidates as a vision model gives them: coercion of lenient JSON, repair, conversion, attempts, provenance.

Everything is columns over rows (document_id, page_number, ...); the only shuffles are those of windows and joins by
document. Rows that cannot stand are dropped where the rule says so, and ``valid_candidate`` tells which could not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import apart, parse_ocr_amount
from ..functions.labels import latin, names_grand_total, normal, normalize_label, strict, strip_fences, with_folds
from .resolution import DOC, NOTES, canonical_role
from .resolve import dedupe_first

# Names under which models give codes, periods and column roles, and the names that are allowed.
CODE_NAMES = {
    "TOTAL_GENERAL": "TOTAL_ACTIF", "CA": "CHIFFRE_AFFAIRES", "CHIFFRE_D_AFFAIRES": "CHIFFRE_AFFAIRES", "CHIFFRE_D'AFFAIRES": "CHIFFRE_AFFAIRES", "RN": "RESULTAT_NET",
    "RESULTAT_NET_DE_L_EXERCICE": "RESULTAT_NET", "CAPITAUX_PROPRES": "FONDS_PROPRES",
}
PERIOD_NAMES = {"N-1": "N_MINUS_1", "N1": "N_MINUS_1", "N_1": "N_MINUS_1", "EXERCICE_PRECEDENT": "N_MINUS_1", "PREV": "N_MINUS_1", "N_MINUS_1": "N_MINUS_1"}
ROLE_NAMES = {
    "NET": "NET_N", "NET_EXERCICE": "NET_N", "EXERCICE": "EXERCICE_N", "EXERCICE_PRECEDENT": "EXERCICE_N1", "N-1": "EXERCICE_N1", "TOTALS": "TOTAL_EXERCICE_N", "TOTAUX": "TOTAL_EXERCICE_N",
    "3": "TOTAL_EXERCICE_N", "4": "EXERCICE_N1",
}
ROLES = ["IDENTITY_VALUE", "BRUT", "AMORT_PROV", "NET_N", "EXERCICE_N", "TOTAL_EXERCICE_N", "EXERCICE_N1", "MONTANT_N", "MONTANT_N1", "UNKNOWN"]
NATURES = ["DETAIL", "SUBTOTAL", "SECTION_TOTAL", "GRAND_TOTAL"]
# The line a field stands in, for candidates whose label is only the amount.
LINES = {
    "TOTAL_ACTIF": "TOTAL GENERAL I+II+III", "TOTAL_PASSIF": "TOTAL I+II+III", "ACTIFS_IMMOBILISES": "TOTAL I", "ACTIF_CIRCULANT": "TOTAL II", "TRESORERIE_ACTIF": "TOTAL TRESORERIE-ACTIF",
    "TRESORERIE_PASSIF": "TOTAL III TRESORERIE-PASSIF", "FONDS_PROPRES": "TOTAL DES CAPITAUX PROPRES", "DETTES_FINANCIERES": "TOTAL DES DETTES DE FINANCEMENT",
    "PASSIF_CIRCULANT": "TOTAL DU PASSIF CIRCULANT", "STOCKS": "TOTAL STOCKS", "CLIENTS": "Clients et comptes rattachés", "FOURNISSEURS": "Fournisseurs et comptes rattachés",
    "CHIFFRE_AFFAIRES": "Chiffre d'affaires", "RESULTAT_NET": "Résultat net", "RESULTAT_EXPLOITATION": "Résultat d'exploitation", "CHARGES_FINANCIERES": "Charges financières",
    "RESULTAT_COURANT": "Résultat courant",
}
# The column of a page type's amounts where none is told.
PAGE_ROLES = {"IDENTIFICATION": "EXERCICE_N", "BILAN_ACTIF": "NET_N", "BILAN_PASSIF": "EXERCICE_N", "CPC": "TOTAL_EXERCICE_N", "DETAIL_CPC": "EXERCICE_N", "RESULTAT_FISCAL": "EXERCICE_N", "ESG": "EXERCICE_N"}
SECTION_TOTALS = ["ACTIFS_IMMOBILISES", "ACTIF_CIRCULANT", "FONDS_PROPRES", "DETTES_FINANCIERES", "PASSIF_CIRCULANT", "TRESORERIE_ACTIF", "TRESORERIE_PASSIF"]
# Fields of a management balance page that the income statement takes.
ESG_FIELDS = [
    "CHIFFRE_AFFAIRES", "RESULTAT_EXPLOITATION", "RESULTAT_COURANT", "RESULTAT_NET", "RESULTAT_NET_XIII", "RESULTAT_NET_XVI", "ACHATS_CONSOMMES", "ACHATS_REVENDUS",
    "DOTATIONS_AMORTISSEMENTS", "CHARGES_FINANCIERES", "PRODUITS_EXPLOITATION", "CHARGES_EXPLOITATION", "CAF", "RESULTAT_NET_ESG",
]
# Codes by which a page's reading is known to fit its type.
MEANINGFUL = {
    "IDENTIFICATION": ["RAISON_SOCIALE", "IDENTIFIANT_FISCAL", "ICE", "ADRESSE", "DATE_DEBUT_EXERCICE", "DATE_FIN_EXERCICE", "EXERCICE"],
    "BILAN_ACTIF": ["TOTAL_ACTIF", "STOCKS", "CLIENTS", "TRESORERIE_ACTIF", "ACTIF_CIRCULANT", "ACTIFS_IMMOBILISES"],
    "BILAN_PASSIF": ["FONDS_PROPRES", "DETTES_FINANCIERES", "TOTAL_PASSIF", "FOURNISSEURS", "PASSIF_CIRCULANT", "TRESORERIE_PASSIF", "DETTES_BANCAIRES_CT"],
    "CPC": [
        "CHIFFRE_AFFAIRES", "RESULTAT_NET", "RESULTAT_NET_XIII", "RESULTAT_NET_XVI", "RESULTAT_EXPLOITATION", "RESULTAT_COURANT", "RESULTAT_FINANCIER", "CHARGES_FINANCIERES", "ACHATS",
        "ACHATS_REVENDUS", "ACHATS_CONSOMMES", "FRAIS_FINANCIERS", "AMORTISSEMENTS", "DOTATIONS_AMORTISSEMENTS",
    ],
    "DETAIL_CPC": ["REDEVANCES_CREDIT_BAIL", "ACHATS"],
    "RESULTAT_FISCAL": ["RESULTAT_FISCAL", "REINTEGRATIONS", "DEDUCTIONS", "IS_DU", "COTISATION_MINIMALE", "REPORT_DEFICITAIRE"],
    "ESG": ["CAF", "FDR", "BFDR", "TRESORERIE_NETTE"],
}

_EVIDENCE = "raw_label:string,column_name:string,column_role:string,source_excerpt:string"
#: What of a model's candidate is read; values may be numbers or text.
ITEM = f"struct<field_code:string,raw_value:string,value:string,period:string,nature:string,confidence:double,raw_label:string,label:string,column_name:string,column_role:string,source_excerpt:string,evidence:struct<{_EVIDENCE}>,warnings:array<string>>"


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def json_body(text: Column) -> Column:
    """The outermost braces of a reply, without code fences; a reply that begins with one is taken as it is."""
    bare = strip_fences(text)
    return F.when(bare.rlike(r"^[\[{]"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))


def lenient_payload(text: Column, schema: str) -> Column:
    """A reply parsed as ``schema``; from a damaged one only its page type is kept, null if there is none.

    The schema must name page_type; a null page_type in the result with a null input for the rest is an error row.
    """
    body = json_body(text)
    whole = F.from_json(body, schema)
    kind = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r'"page_type"\s*:\s*"([^"]*)"', 1), F.lit(""))
    sound = F.try_parse_json(body).isNotNull()
    return F.when(sound, whole).when(kind.isNotNull(), F.from_json(F.to_json(F.struct(kind.alias("page_type"))), schema))


def candidate_items(text: Column) -> Column:
    """The candidates of a reply as an array of ``ITEM``: a list, an object that holds one, or a single candidate."""
    body = json_body(text)
    listed = F.from_json(body, f"array<{ITEM}>")
    held = F.from_json(body, f"struct<candidates:array<{ITEM}>,field_code:string>")
    single = F.array(F.from_json(body, ITEM))
    none = F.array().cast(f"array<{ITEM}>")
    return F.coalesce(F.when(body.startswith("["), listed).when(held["candidates"].isNotNull(), held["candidates"]).when(held["field_code"].isNotNull(), single), none)


def coerce_candidates(replies: DataFrame) -> DataFrame:
    """(document_id, page_number, page_type, ordinal, ...) candidates of ``replies`` (document_id, page_number, page_type, reply).

    Names are brought to the allowed ones, texts cut to their lengths; candidates without value or code go.
    """
    one = replies.select(DOC, "page_number", "page_type", F.posexplode(candidate_items(F.col("reply"))).alias("place", "c"))
    c = F.col("c")
    shape = lambda x: F.upper(F.replace(F.trim(x), F.lit(" "), F.lit("_")))
    code, value = F.upper(F.trim(c["field_code"])), F.trim(F.coalesce(c["raw_value"], c["value"]))
    code = F.coalesce(_lookup(CODE_NAMES, code), code)
    full = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))
    label = full(c["evidence"]["raw_label"], c["raw_label"], c["label"], c["field_code"])
    role = shape(F.coalesce(full(c["evidence"]["column_role"], c["column_role"]), F.lit("UNKNOWN")))
    role, nature = F.coalesce(_lookup(ROLE_NAMES, role), role), F.upper(F.trim(F.coalesce(c["nature"], F.lit("DETAIL"))))
    # a confidence of 0 counts as not given
    return one.where((value != "") & (code != "")).select(
        DOC, "page_number", "page_type", (F.col("page_number") * 1000 + F.col("place")).cast("long").alias("ordinal"), code.alias("field_code"), F.left(value, F.lit(64)).alias("raw_value"),
        F.coalesce(_lookup(PERIOD_NAMES, shape(c["period"])), F.lit("N")).alias("period"), F.when(nature.isin(NATURES), nature).otherwise("DETAIL").alias("nature"),
        F.coalesce(F.nullif(c["confidence"], F.lit(0.0)), F.lit(0.7)).alias("confidence"), F.left(label, F.lit(120)).alias("raw_label"),
        full(c["evidence"]["column_name"], c["column_name"]).alias("column_name"), F.when(role.isin(ROLES), role).otherwise("UNKNOWN").alias("column_role"),
        F.left(full(c["evidence"]["source_excerpt"], c["source_excerpt"], F.concat(label, F.lit("|"), value)), F.lit(160)).alias("source_excerpt"), F.lit(0).alias("orientation"),
        F.coalesce(c["warnings"], F.array().cast(NOTES)).alias("warnings"),
    )


def valid_candidate() -> Column:
    """Whether a candidate keeps the limits of its lengths, confidence and enumerations."""
    within = lambda n, lo, hi: F.length(n).between(lo, hi)
    ok = within("raw_value", 1, 64) & within("raw_label", 1, 180) & (F.col("column_name").isNull() | within("column_name", 0, 100)) & within("source_excerpt", 1, 240)
    ok = ok & F.col("confidence").between(0, 1) & F.col("period").isin("N", "N_MINUS_1") & F.col("column_role").isin(ROLES)
    return F.coalesce(ok & F.col("nature").isin([*NATURES, "DERIVED_DISPLAYED", "UNKNOWN"]), F.lit(False))


def allowed_codes(cands: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates whose code its page type may give; a page type that ``allowed`` (page_type, field_code) does not name may give all."""
    ruled = allowed.select("page_type").distinct().withColumn("_ruled", F.lit(True))
    kept = allowed.select("page_type", "field_code").distinct().withColumn("_kept", F.lit(True))
    out = cands.join(ruled, "page_type", "left").join(kept, ["page_type", "field_code"], "left")
    return out.where(F.col("_ruled").isNull() | F.col("_kept").isNotNull()).select(cands.columns)


def is_meaningful(page_type: Column, codes: Column) -> Column:
    """Whether the codes read from a page hold one by which its type is known."""
    wanted = F.element_at(F.create_map(*(x for k, v in MEANINGFUL.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), page_type)
    return F.coalesce(F.arrays_overlap(codes, wanted), F.lit(False))


def insufficient_payload(page_type: Column, n_rows: Column, n_metadata: Column) -> Column:
    """Whether a page's payload should be read again: under three rows of a financial page, two of another, no identity."""
    financial = page_type.isin("BILAN_ACTIF", "BILAN_PASSIF", "CPC")
    rows, metadata = F.coalesce(n_rows, F.lit(0)), F.coalesce(n_metadata, F.lit(0))
    return F.when(page_type == "IDENTIFICATION", (metadata == 0) & (rows < 2)).when(financial, rows < 3).otherwise(rows < 2)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """One row for each page of ``attempts`` (document_id, page_number, attempt, page_type, codes array, latency_ms).

    Attempts after the first meaningful one do not count; of the rest the one with most candidates stays, a meaningful one if
    equal, then the earlier; ``latency_ms`` sums all that count. Attempts of one number are taken in the order of page type,
    codes and latency, so that only equal rows tie.
    """
    page = Window.partitionBy(DOC, "page_number").orderBy("attempt", "page_type", "codes", "latency_ms")
    good = is_meaningful(F.col("page_type"), F.col("codes"))
    done = F.coalesce(F.max(good.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = attempts.withColumns({"meaningful": good, "_done": done}).where("_done = 0")
    best = F.min(F.struct((-F.size("codes")).alias("_size"), (~F.col("meaningful")).alias("_rest"), "attempt", "page_type", "codes", "meaningful"))
    return rows.groupBy(DOC, "page_number").agg(best.alias("b"), F.sum("latency_ms").alias("latency_ms"), F.count("*").alias("n_attempts")).select(
        DOC, "page_number", *(f"b.{c}" for c in ("attempt", "page_type", "codes", "meaningful")), "latency_ms", "n_attempts"
    )


# Fixed value: a folded label that is only an amount.
ONLY_AMOUNT = r"^[\s.]*-?\d{1,3}(?:[.\s]\d{3})*(?:[,.]\d{1,2})?\s*$"


def amount_like(label: Column, raw: Column) -> Column:
    """Whether a label is empty or only repeats an amount."""
    return _only_amount(normalize_label(label), normalize_label(raw))


def _only_amount(label: Column, raw: Column) -> Column:
    return (label == "") | (label == raw) | label.rlike(ONLY_AMOUNT)


def repair(cands: DataFrame) -> DataFrame:
    """Mend what such readings often get wrong: codes by labels, missing columns, amounts as labels, natures of totals, excerpts."""
    return _repaired(cands).drop("_label", "_value")


def _repaired(cands: DataFrame) -> DataFrame:
    """``repair`` with the normal forms of label and value, ``_label`` and ``_value``: each text is folded once, as a column."""
    c, lit = F.col, F.lit
    cands = cands.withColumns({"_label": latin(c("raw_label")), "_value": latin(c("raw_value")), "field_code": apart("field_code")})
    cands = cands.withColumns({"_words": strict(c("_label")), "_label": normal(c("_label")), "_value": normal(c("_value")), "field_code": apart("field_code")})
    has = c("_words").contains
    code = c("field_code")
    bought = (code == "CHIFFRE_AFFAIRES") & has("achat") & ~has("affaires")
    mended = (
        F.when(bought & has("revendu"), "ACHATS_REVENDUS").when(bought & has("consom"), "ACHATS_CONSOMMES")
        .when((code == "ACHATS_REVENDUS") & has("achat") & ~has("revendu") & ~has("consom"), "UNKNOWN").when((code == "RESULTAT_NET") & has("resultat courant"), "RESULTAT_COURANT").otherwise(code)
    )
    note = lambda notes, test, text: F.when(test, F.array_append(notes, text)).otherwise(notes)
    out = cands.withColumns({"_code": mended, "warnings": F.coalesce("warnings", F.array().cast(NOTES))})
    out = out.withColumns({"warnings": note(c("warnings"), c("_code") != code, "code_by_label"), "field_code": c("_code")}).drop("_code", "_words")
    given = F.when(c("period") == "N_MINUS_1", "EXERCICE_N1").otherwise(_lookup(PAGE_ROLES, c("page_type")))
    vague = c("column_role").isNull() | c("column_role").isin("", "UNKNOWN", "MONTANT_N", "IDENTITY_VALUE")
    out = out.withColumns({"_role": F.when(vague, F.coalesce(given, c("column_role"))).otherwise(c("column_role"))})
    out = out.withColumns({"warnings": note(c("warnings"), ~c("_role").eqNullSafe(c("column_role")), "role_by_page"), "column_role": c("_role")}).drop("_role")
    bare = _only_amount(c("_label"), c("_value"))
    zero_charge = c("field_code").isin("CHARGES_FINANCIERES", "CHARGES_INTERETS", "FRAIS_FINANCIERS") & (parse_ocr_amount(c("raw_value")) == 0)
    line = F.when(bare & ~F.coalesce(zero_charge, lit(False)), _lookup(LINES, c("field_code")))
    out = out.withColumn("_line", line)
    out = out.withColumns({"warnings": note(c("warnings"), c("_line").isNotNull(), "label_was_amount"), "raw_label": F.coalesce("_line", "raw_label"), "_label": F.when(c("_line").isNotNull(), normalize_label(c("_line"))).otherwise(c("_label"))}).drop("_line")
    partial = c("_label").rlike(r"(?i)\btotal (i|ii|iii)\b") & ~names_grand_total(c("_label"))
    grand = c("field_code").isin("TOTAL_ACTIF", "TOTAL_PASSIF") & ~partial
    nature = F.when(grand, "GRAND_TOTAL").when((c("nature") == "DETAIL") & c("field_code").isin(SECTION_TOTALS), "SECTION_TOTAL").otherwise(c("nature"))
    out = out.withColumn("_nature", nature)
    out = out.withColumns({"warnings": note(c("warnings"), c("_nature") != c("nature"), "nature_of_total"), "nature": c("_nature")}).drop("_nature")
    excerpt = F.when(F.trim(F.coalesce("source_excerpt", lit(""))).isin("", "ligne|montant"), F.concat("raw_label", lit("|"), "raw_value")).otherwise(c("source_excerpt"))
    cut = F.left("raw_label", lit(180))
    label = F.when(F.length("raw_label") > 180, normalize_label(cut)).otherwise(c("_label"))
    return out.withColumns({"field_code": apart("field_code"), "_label": label, "raw_label": cut, "source_excerpt": F.left(excerpt, lit(240))})


def to_common(cands: DataFrame) -> DataFrame:
    """Candidates of the common form: sections by page type, codes and columns narrowed; other pages' candidates go.

    Candidates come section by section, in the order in which a document's sections first appear.
    """
    c = F.col
    esg = c("page_type") == "ESG"
    out = cands.where(~c("page_type").isin("AUTRE", "VIDE") & (~esg | c("field_code").isin(ESG_FIELDS)))
    known = c("page_type").isin([p for p in PAGE_ROLES if p != "ESG"])
    totals = c("field_code").isin("TOTAL_ACTIF", "TOTAL_PASSIF") & (c("period") == "N_MINUS_1")
    code = F.when(c("field_code").isin("RESULTAT_COMPTABLE", "RESULTAT_NET_ESG"), "RESULTAT_NET").when(totals, "TOTAL_BILAN").otherwise(c("field_code"))
    narrow = {"MONTANT_N": "EXERCICE_N", "IDENTITY_VALUE": "EXERCICE_N", "MONTANT_N1": "EXERCICE_N1"}
    role = F.when(c("column_role").isin("BRUT", "AMORT_PROV", "NET_N", "EXERCICE_N", "TOTAL_EXERCICE_N", "EXERCICE_N1"), c("column_role")).otherwise(F.coalesce(_lookup(narrow, c("column_role")), F.lit("UNKNOWN")))
    out = out.withColumns({"section": F.when(esg, "CPC").when(known, c("page_type")).otherwise("AUTRE"), "field_code": code, "column_role": role})
    out = with_folds(out, _column="column_name").withColumn("column_role", canonical_role(c("section"), c("_column"), c("column_role"))).drop("_column")
    first = F.min("ordinal").over(Window.partitionBy(DOC, "section"))
    order = Window.partitionBy(DOC).orderBy("_first", "ordinal")
    return out.withColumn("_first", first).withColumn("ordinal", F.row_number().over(order).cast("long")).drop("_first")


def common_candidates(cands: DataFrame) -> DataFrame:
    """Repaired vision candidates, each (code, period, label, value) of a document once, in the common form.

    They are dealt by document once; every choice here and in ``resolution`` is within a document and needs no other shuffle.
    """
    return to_common(dedupe_first(_repaired(cands.repartition(DOC)), [DOC, "field_code", "period", "_label", "_value"], ["ordinal"]).drop("_label", "_value"))


def patch_provenance(values: DataFrame, originals: DataFrame) -> DataFrame:
    """``values`` (document_id, code, raw_label, raw_value) with page_type, orientation and column_role of the candidate behind them.

    The last candidate of the same code, label and value; without one the first of the same label and value.
    """
    key = lambda df: df.withColumns({"_l": normalize_label(F.col("raw_label")), "_v": normalize_label(F.col("raw_value"))})
    facts = F.struct("page_type", "orientation", "column_role")
    keyed = key(originals)
    exact = keyed.groupBy(DOC, F.col("field_code").alias("_c"), "_l", "_v").agg(F.max_by(facts, F.col("ordinal")).alias("_exact"))
    near = keyed.groupBy(DOC, "_l", "_v").agg(F.min_by(facts, F.col("ordinal")).alias("_near"))
    code = F.when(F.col("code").isin("RESULTAT_NET_XIII", "RESULTAT_NET_XVI"), "RESULTAT_NET").otherwise(F.col("code"))
    out = key(values).withColumn("_c", code).join(exact, [DOC, "_c", "_l", "_v"], "left").join(near, [DOC, "_l", "_v"], "left")
    return out.select(*values.columns, F.coalesce("_exact", "_near").alias("_f")).select(*values.columns, "_f.*")


def union_candidates(*tables: DataFrame) -> DataFrame:
    """All candidates, absent columns null, each (code, period, label, value) of a document once, earlier tables first."""
    whole = tables[0].withColumn("_table", F.lit(0))
    for i, table in enumerate(tables[1:], 1):
        whole = whole.unionByName(table.withColumn("_table", F.lit(i)), allowMissingColumns=True)
    keyed = whole.withColumns({"_label": normalize_label(F.col("raw_label")), "_value": normalize_label(F.col("raw_value"))})
    return dedupe_first(keyed, [DOC, "field_code", "period", "_label", "_value"], ["_table", "ordinal"]).drop("_label", "_value", "_table")
