"""From candidate amounts to a dataset of fields: eligibility, priority, choice, special fields, derivations.

Candidates are rows (document_id, ordinal, field_code, raw_value, period, nature, confidence, page_number, section,
raw_label, column_name, column_role, source_excerpt, warnings array<string>); ``ordinal`` is the source order, which
breaks ties. One shuffle by document serves everything: windows and aggregations are by document and slot, and a
document's fields, a few dozen however large the corpus, become columns of one row.

A slot is a choice to be made: mostly a field, and for the net result one of its four printed places. A field is a
struct (value, status, warnings, sources), null if nothing was found. Absent amounts stay null.

``sources`` names the slots that a value comes from, and goes through choices, sums and derivations as the value does;
it is as short as a formula. ``provenance`` turns it into the candidates behind every value with one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import AMOUNT, apart, is_mixed_comma, with_ocr_amount
from ..functions.labels import fold, is_grand_total, is_revenue_label, strip_markers, with_folds
from ..rules import candidates as RULES
from .candidates import agree

NOTES = "array<string>"
#: Slots behind a value; ``every`` if all candidates of equal rank are meant and not the first alone.
SOURCES = "array<struct<slot:string,every:boolean>>"
FIELD = f"struct<value:{AMOUNT},status:string,warnings:{NOTES},sources:{SOURCES}>"
#: What ``provenance`` tells about a candidate, where the candidates have it.
EVIDENCE = ["ordinal", "page_number", "page_type", "section", "nature", "period", "raw_label", "raw_value", "amount", "column_name", "column_role", "confidence", "orientation", "source_excerpt"]
#: Priorities this near to the best one count as equal.
BAND = 5.0
DOC = "document_id"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def canonical_role(section: Column, name: Column, role: Column) -> Column:
    """The column's role by its folded name, where the section's layout tells it."""
    before = name.contains("precedent")
    cpc = F.when(_any(name, RULES.CPC_TOTAL_COLUMN), "TOTAL_EXERCICE_N").when(name.contains("exercice precedent") | (name == "4"), "EXERCICE_N1")
    assets = F.when(name.contains("net") & ~before, "NET_N").when(before, "EXERCICE_N1").when(name.contains("brut"), "BRUT")
    liabilities = F.when(before, "EXERCICE_N1").when(name.contains("exercice"), "EXERCICE_N")
    detail = F.when(before, "EXERCICE_N1").when(_any(name, ["exercice", "totaux", "3 1 2"]), "EXERCICE_N")
    return F.coalesce(F.when(section == "CPC", cpc).when(section == "BILAN_ACTIF", assets).when(section == "BILAN_PASSIF", liabilities).when(section == "DETAIL_CPC", detail), role)


def period_of_role(role: Column, period: Column) -> Column:
    """The period that a column's role implies; others leave it."""
    return F.when(role == "EXERCICE_N1", "N_MINUS_1").when(role.isin("NET_N", "EXERCICE_N", "TOTAL_EXERCICE_N"), "N").otherwise(period)


def dataset_key(code: Column, period: Column, section: Column, label: Column) -> Column:
    """The field that a candidate competes for: codes of the year before, and numbered lines of the net result."""
    before = F.element_at(F.create_map(*(F.lit(x) for pair in RULES.PREVIOUS_CODES.items() for x in pair)), code)
    key = F.when(period == "N_MINUS_1", F.coalesce(before, code)).otherwise(code)
    return F.when((key == "RESULTAT_NET") & (section == "CPC"), F.when(label.contains("xiii"), "RESULTAT_NET_XIII").when(label.contains("xvi"), "RESULTAT_NET_XVI").otherwise(key)).otherwise(key)


def _noted(old: Column, new: Column, note: str) -> Column:
    """The candidate's warnings, with ``note`` where a value was changed."""
    notes = F.coalesce("warnings", F.array().cast(NOTES))
    return F.when(~old.eqNullSafe(new), F.array_append(notes, note)).otherwise(notes)


def canonicalize(cands: DataFrame) -> DataFrame:
    """Markers stripped, roles and periods by columns, ``label`` (folded) and ``key`` added; unknown codes go."""
    c = F.col
    out = cands.withColumns({n: strip_markers(c(n)) for n in ("raw_value", "source_excerpt", "raw_label")} | {"field_code": apart("field_code")})
    # folded once each: a rule names its label many times, and the plan would fold it as often
    out = with_folds(out, label="raw_label", _column="column_name").withColumn("field_code", apart("field_code"))
    out = out.withColumn("_role", canonical_role(c("section"), c("_column"), c("column_role"))).drop("_column")
    out = out.withColumns({"warnings": _noted(c("column_role"), c("_role"), "role_from_column"), "column_role": c("_role")})
    out = out.withColumn("_period", period_of_role(c("column_role"), c("period")))
    out = out.withColumns({"warnings": _noted(c("period"), c("_period"), "period_from_role"), "period": c("_period")}).drop("_role", "_period")
    return out.where("field_code <> 'UNKNOWN'").withColumn("key", dataset_key(c("field_code"), c("period"), c("section"), c("label")))


def _told(*notes: Column) -> Column:
    """Those of ``notes`` (without commas) that are not null, as an array. Joined and parted again: generated code, which a lambda over an array of all is not."""
    told = F.concat_ws(",", *notes)
    return F.when(told == "", F.array().cast(NOTES)).otherwise(F.split(told, ","))


def reasons() -> Column:
    """Why a canonical candidate may not stand for its field: an array, empty if it may."""
    code, section, role, period, label = (F.col(n) for n in ("field_code", "section", "column_role", "period", "label"))
    allowed = reduce(lambda a, b: a | b, [(section == s) & code.isin(fields) for s, fields in RULES.SECTION_FIELDS.items()])
    current_role = F.element_at(F.create_map(*(F.lit(x) for pair in RULES.CURRENT_ROLE.items() for x in pair)), section)
    is_ = lambda *codes: code.isin(*codes)
    has = lambda *words: _any(label, list(words))
    net = is_("RESULTAT_NET", "RESULTAT_NET_XIII", "RESULTAT_NET_XVI")
    result = has("resultat d exploitation", "resultat dexploitation")
    tests = [
        ("section", ~allowed),
        ("previous_year_column", (period == "N_MINUS_1") & (role != "EXERCICE_N1")),
        ("current_column", (period == "N") & allowed & ~is_(*RULES.ANY_ROLE) & (role != current_role)),
        ("not_the_grand_total", is_("TOTAL_PASSIF", "TOTAL_ACTIF", "TOTAL_BILAN") & ~((F.col("nature") == "GRAND_TOTAL") & is_grand_total(F.col("raw_label")))),
        ("stock_variation", is_("STOCKS") & has("variation")),
        ("customer_credit", is_("CLIENTS") & has("crediteur")),
        ("customer_label", is_("CLIENTS") & ~has("clients et comptes rattaches") & (label != "clients")),
        ("supplier_debit", is_("FOURNISSEURS") & has("debiteur")),
        ("supplier_label", is_("FOURNISSEURS") & ~has("fournisseurs et comptes rattaches") & (label != "fournisseurs")),
        ("conversion_gap", is_("DETTES_FINANCIERES") & has("augmentation des dettes", "diminution des dettes", "ecart de conversion")),
        ("result_to_allocate", net & has("instance d affectation", "instance daffectation")),
        ("current_result", net & has("resultat courant") & ~has("resultat net")),
        ("other_charges", is_("CHARGES_INTERETS") & has("autres charges financieres")),
        ("not_revenue", is_("CHIFFRE_AFFAIRES") & ~is_revenue_label(label)),
        ("not_deductions", is_("DEDUCTIONS") & ~has("deduct")),
        ("not_resold", is_("ACHATS_REVENDUS") & ~has("revendu")),
        ("not_operating_result", is_("RESULTAT_EXPLOITATION") & ~result),
        ("income_statement_line", is_("RESULTAT_FISCAL") & has("resultat net") & (has("xi", "xv") | ~has("resultat net fiscal") & ~has("resultat fiscal"))),
        ("not_a_deficit", is_("REPORT_DEFICITAIRE") & ~has("deficit")),
        ("rent_not_debt", is_("ENCOURS_LEASING") & has("redevance")),
        ("debt_not_rent", is_("REDEVANCES_CREDIT_BAIL") & has("encours") & ~has("redevance")),
    ]
    supported = (period == "N") | ((period == "N_MINUS_1") & code.isin(RULES.TWO_YEARS))
    found = _told(*(F.when(test, F.lit(name)) for name, test in tests))
    return F.when(supported, found).otherwise(F.array(F.lit("period")))


def priority() -> Column:
    """Rank of a canonical candidate among those of its field; see the rules for the points."""
    code, section, role, period, label = (F.col(n) for n in ("field_code", "section", "column_role", "period", "label"))
    points = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    expected = reduce(lambda a, b: a | b, [(section == s) & code.isin(fields) for s, fields in RULES.EXPECTED.items()])
    hinted = reduce(lambda a, b: a | b, [(code == f) & _any(label, words) for f, words in RULES.HINTS.items()])
    page = F.least(F.col("page_number").cast("double"), F.lit(20.0)) * 0.5
    net = code.isin("RESULTAT_NET", "RESULTAT_NET_XIII", "RESULTAT_NET_XVI") & (section == "CPC")
    charges, resold = code == "CHARGES_FINANCIERES", code == "ACHATS_REVENDUS"
    nature = F.coalesce(F.element_at(F.create_map(*(x for n, p in RULES.NATURE.items() for x in (F.lit(n), F.lit(float(p))))), F.col("nature")), F.lit(0.0))
    return (
        nature + F.col("confidence") * 20.0 + points(expected, 100) + points(period.isin("N", "N_MINUS_1"), 80)
        + points(((period == "N") & role.isin("NET_N", "EXERCICE_N", "TOTAL_EXERCICE_N")) | ((period == "N_MINUS_1") & (role == "EXERCICE_N1")), 60) + points(hinted, 50)
        + points((code == "CHIFFRE_AFFAIRES") & label.contains("chiffre d affaires"), 40)
        - points((code == "CHIFFRE_AFFAIRES") & label.contains("ventes de marchandises") & ~label.contains("chiffre"), 40)
        + points(net & _any(label, ["xiii", "xvi"]), 50) + points(net, 30) - points((code == "RESULTAT_NET") & (section == "BILAN_PASSIF"), 20)
        - points(charges & fold(F.col("raw_value")).isin(RULES.ZEROS) & ~label.contains("charges"), 120)
        - points(charges & F.regexp_replace(label, "[ ,.]", "").rlike(r"^\d+$"), 80) - F.when(charges | resold, page).otherwise(0.0)
        + F.when(resold, F.when(label.contains("revendu"), 80.0).otherwise(-100.0)).otherwise(0.0)
    )


def prepare(cands: DataFrame) -> DataFrame:
    """Canonical candidates with amount, reasons, ok (eligible with an amount) and priority."""
    out = with_ocr_amount(canonicalize(cands), "raw_value", "amount").withColumns({"reasons": reasons(), "priority": priority(), "key": apart("key")})
    return out.withColumn("ok", (F.size("reasons") == 0) & F.col("amount").isNotNull())


def reason_counts(cands: DataFrame) -> DataFrame:
    """(field_code, reasons, ok, n): eligible and refused candidates by field and reason, as ``prepare`` tells them.

    No reason reads an amount, so candidates are counted by what reasons read and by whether they have an amount, and each such group is judged once.
    """
    read = ["field_code", "section", "column_name", "column_role", "period", "nature", "raw_label"]
    rows = with_ocr_amount(cands.select(*read, strip_markers(F.col("raw_value")).alias("_raw")), "_raw", "_amount")
    rows = rows.select(apart("field_code"), *read[1:], F.col("_amount").isNotNull().alias("_has"))
    # the code is read with its count: a filter on the code alone would be moved below and fold every candidate's label once more to mend it
    groups = rows.groupBy(*read, "_has").agg(F.count("*").alias("_n")).withColumn("field_code", F.when(F.col("_n") > 0, F.col("field_code")))
    text = F.lit(None).cast("string")
    judged = canonicalize(groups.withColumns({"raw_value": text, "source_excerpt": text, "warnings": F.lit(None).cast(NOTES)})).withColumn("reasons", reasons())
    return judged.groupBy("field_code", "reasons", ((F.size("reasons") == 0) & F.col("_has")).alias("ok")).agg(F.sum("_n").alias("n"))


def slots(prepared: DataFrame) -> DataFrame:
    """A row for each candidate and slot in which it competes: its field as such (``ANY:`` before the code), and the
    narrower choice that some fields prefer, in which only the lowest tier that the document has is left.
    """
    key, label, section, role, amount = (F.col(n) for n in ("key", "label", "section", "column_role", "amount"))
    doc = Window.partitionBy(DOC)
    first = lambda test: F.min_by(F.when(test, amount), F.when(test, F.col("ordinal"))).over(doc)
    current = (F.col("period") == "N") & amount.isNotNull()
    df = prepared.withColumns({"_ca": first((key == "CHIFFRE_AFFAIRES") & is_revenue_label(label) & current), "_rc": first((key == "RESULTAT_COURANT") & current)})
    rc = F.when(F.col("_rc") != 0, F.abs("_rc"))
    sound = amount.isNotNull() & ~label.contains("produits d exploitation") & ~F.coalesce(amount > F.col("_ca"), F.lit(False))
    sound = sound & ~F.coalesce(F.abs(amount - F.col("_rc")) > rc * 2.5 + 10000, F.lit(False))
    named = _any(label, ["resultat d exploitation", "resultat dexploitation"])
    unlabelled_zero = fold(F.col("raw_value")).isin(RULES.ZEROS) & ~_any(label, ["charges", "total v"])
    total = F.col("nature").isin("SECTION_TOTAL", "SUBTOTAL", "GRAND_TOTAL") | label.contains("total") | label.startswith("dettes de financement")
    net_line = (F.col("period") == "N") & label.contains("resultat net")
    place = lambda slot, tier: F.struct(slot.alias("slot"), (F.lit(tier) if isinstance(tier, int) else tier).cast("int").alias("tier"))
    # incoherent operating results go; where nothing tells turnover or current result they are the last resort
    last_resort = F.col("_ca").isNull() & F.col("_rc").isNull()
    preference = F.when(sound & named, 0).when(sound & (label.rlike(r"\bvi\b") | F.col("raw_label").contains("+/-")), 1).when(sound, 2).when(named, 3).otherwise(4)
    narrow = (
        F.when(key == "STOCKS", place(key, F.when(F.col("nature") == "SECTION_TOTAL", 0).otherwise(1)))
        .when(key == "DETTES_FINANCIERES", place(key, F.when(total, 0).otherwise(1)))
        .when((key == "CHIFFRE_AFFAIRES") & is_revenue_label(label), place(key, F.when(label.contains("chiffre") & label.contains("affaires"), 0).otherwise(1)))
        .when((key == "ACHATS_REVENDUS") & label.contains("revendu"), place(key, 0))
        .when(key == "CHARGES_FINANCIERES", place(key, F.when(unlabelled_zero, 1).otherwise(0)))
        .when((key == "RESULTAT_EXPLOITATION") & (sound | last_resort), place(key, preference))
        .when((key == "RESULTAT_NET") & (section == "CPC") & (role == "TOTAL_EXERCICE_N") & net_line, place(F.lit("NET_CPC"), 0))
        .when((key == "RESULTAT_NET") & (section == "BILAN_PASSIF") & net_line, place(F.lit("NET_BILAN"), 0))
    )
    df = df.withColumns({"_narrow": narrow, "key": apart("key")})
    own = place(F.concat(F.lit("ANY:"), key), 0)
    both = df.withColumn("_place", F.explode(F.when(F.col("_narrow").isNull(), F.array(own)).otherwise(F.array(own, F.col("_narrow"))))).drop("_narrow")
    out = both.select("*", "_place.slot", "_place.tier").drop("_place")
    # operating results: the earliest page of named lines, then those nearest to the current result. One least triple of a slot tells
    # tier, page and distance; absent pages and distances come last in it.
    operating = F.col("slot") == "RESULTAT_EXPLOITATION"
    named_line = operating & F.col("tier").isin(0, 3)
    away = F.when(operating, F.abs(amount - F.col("_rc")))
    rank = F.struct("tier", F.when(named_line, F.coalesce("page_number", F.lit(2**31 - 1))).alias("page"), away.isNull().alias("far"), away.alias("away"))
    out = out.withColumn("_least", F.min(rank).over(Window.partitionBy(DOC, "slot")))
    least = F.col("_least")
    out = out.where((F.col("tier") == least["tier"]) & (~named_line | (F.col("page_number") == least["page"])))
    near = F.when(least["away"] <= F.abs("_rc") * 1.5 + 5000, least["away"])
    return out.where(near.isNull() | (away <= near + 1)).withColumn("told", F.col("_ca").isNotNull() | F.col("_rc").isNotNull()).drop("tier", "_least", "_ca", "_rc")


def ranked(cands: DataFrame) -> DataFrame:
    """Candidates of slots with priority (null where a candidate may not stand) and near: within ``BAND`` of the slot's best."""
    out = cands.withColumn("priority", F.when(F.col("ok"), F.col("priority"))).withColumn("_top", F.max("priority").over(Window.partitionBy(DOC, "slot")))
    return out.withColumn("near", F.coalesce(F.col("priority") >= F.col("_top") - BAND, F.lit(False))).drop("_top")


def pick(cands: DataFrame) -> DataFrame:
    """(document_id, slot, field, best, n_candidates): the choice among the eligible candidates of each slot, null if there is none.

    Several amounts within ``BAND`` of the best priority conflict; a suspected shift of rows makes customers,
    suppliers and stocks ambiguous. ``best`` is the first amount by priority and source order whatever the status.
    """
    near = F.col("near")
    shifted = F.array_join("warnings", "\n").contains("suspected_row_shift")
    first = F.max_by(F.struct("amount", shifted.alias("shifted"), is_mixed_comma(F.col("raw_value")).alias("mixed"), "page_number"), F.when(F.col("ok"), F.struct("priority", -F.col("ordinal"))))
    least, most = F.min(F.when(near, F.col("amount"))), F.max(F.when(near, F.col("amount")))
    picks = ranked(cands).groupBy(DOC, "slot").agg(first.alias("_b"), least.alias("_lo"), most.alias("_hi"), F.count_if("ok").alias("n_candidates"), F.max("told").alias("told"))
    code, b = F.regexp_replace("slot", "^ANY:", ""), F.col("_b")
    status = F.when(code.isin("CLIENTS", "FOURNISSEURS", "STOCKS") & b["shifted"], "ambiguous").when(F.col("_lo") != F.col("_hi"), "conflicting").otherwise("confirmed")
    note = lambda test, text: F.when(test, F.lit(text) if isinstance(text, str) else text)
    confirmed = status == "confirmed"
    notes = _told(
        note(status == "ambiguous", "row_shift_needs_review"), note(status == "conflicting", "equal_priority_other_amounts"), note(confirmed & b["mixed"], "mixed_commas_read"),
        note(confirmed & (F.col("n_candidates") > 1), F.concat((F.col("n_candidates") - 1).cast("string"), F.lit(" lower candidates"))), note(confirmed & b["shifted"], "row_shift_suspected"),
    )
    field = F.struct(F.when(confirmed, b["amount"]).alias("value"), status.alias("status"), notes.alias("warnings"), source(F.col("slot"), status == "conflicting").alias("sources"))
    return picks.select(DOC, apart("slot"), F.when(F.col("n_candidates") > 0, field).alias("field"), b["amount"].alias("best"), b["page_number"].alias("page"), "n_candidates", "told")


def source(slot: Column, every: Column) -> Column:
    """Sources of one slot."""
    return F.array(F.struct(slot.alias("slot"), every.alias("every"))).cast(SOURCES)


def sources(*codes: str) -> Column:
    """The sources of field columns, one after the other, each once; none of an absent field."""
    return F.array_distinct(F.concat(*(F.coalesce(F.col(c)["sources"], F.array().cast(SOURCES)) for c in codes)))


def make(value: Column, status: str | Column, note: str | Column | None = None, sources: Column | None = None) -> Column:
    """A field; without sources it comes from nowhere."""
    status = F.lit(status) if isinstance(status, str) else status
    none = F.array().cast(NOTES)
    notes = none if note is None else F.array(F.lit(note)) if isinstance(note, str) else F.when(note.isNotNull(), F.array(note)).otherwise(none)
    return F.struct(value.cast(AMOUNT).alias("value"), status.alias("status"), notes.alias("warnings"), (F.array().cast(SOURCES) if sources is None else sources).alias("sources")).cast(FIELD)


def usable(code: str) -> Column:
    """Whether a field column is confirmed or derived and has a value."""
    return F.coalesce(F.col(code)["status"].isin("confirmed", "derived") & F.col(code)["value"].isNotNull(), F.lit(False))


def amount(code: str) -> Column:
    return F.col(code)["value"]


def is_open(code: str) -> Column:
    """Whether a field has no value or is missing."""
    return F.col(code).isNull() | amount(code).isNull() | (F.col(code)["status"] == "missing")


_CODES = sorted({c for fields in RULES.SECTION_FIELDS.values() for c in fields} | set(RULES.DATASET))


def resolved_fields(cands: DataFrame) -> DataFrame:
    """One row for each document: a column for each field, after special rules, derivations and defaults."""
    return fields_of(slots(prepare(cands)))


def fields_of(competing: DataFrame) -> DataFrame:
    """``resolved_fields`` of candidates that are in their slots already, for callers that need both and write them once."""
    picked = pick(competing)
    # a document's slots, at most two for each field
    df = picked.groupBy(DOC).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("field", "best", "told").alias("pick")))).alias("m"))
    at = lambda slot: F.element_at("m", F.lit(slot))
    own = lambda c: at(f"ANY:{c}")["field"]
    special = ["STOCKS", "DETTES_FINANCIERES", "CHARGES_FINANCIERES", "CHIFFRE_AFFAIRES", "ACHATS_REVENDUS", "RESULTAT_EXPLOITATION"]
    fields = {c: F.coalesce(at(c)["field"], own(c)) if c in special else own(c) for c in _CODES}
    known = lambda c: F.map_contains_key("m", f"ANY:{c}")
    missing = make(F.lit(None), "missing")
    # turnover, resold purchases and the operating result have a row even if nothing was proposed
    fields["CHIFFRE_AFFAIRES"] = F.coalesce(fields["CHIFFRE_AFFAIRES"], F.when(~known("CHIFFRE_AFFAIRES"), missing))
    fields["ACHATS_REVENDUS"] = F.coalesce(fields["ACHATS_REVENDUS"], missing)
    told = at("ANY:RESULTAT_EXPLOITATION")["told"]  # whether turnover or current result was read
    fields["RESULTAT_EXPLOITATION"] = F.coalesce(at("RESULTAT_EXPLOITATION")["field"], F.when(known("RESULTAT_EXPLOITATION") & told, make(F.lit(None), "missing", "all_incoherent")), own("RESULTAT_EXPLOITATION"), missing)
    fields["ENCOURS_LEASING"] = F.coalesce(fields["ENCOURS_LEASING"], make(F.lit(None), "missing", "no_documented_leasing"))
    df = df.withColumns(fields | {"_xiii": at("ANY:RESULTAT_NET_XIII")["best"], "_xvi": at("ANY:RESULTAT_NET_XVI")["best"], "_cpc": at("NET_CPC")["best"], "_passif": at("NET_BILAN")["best"]})
    df = df.withColumns({"RESULTAT_NET": F.coalesce(net_result(*map(F.col, ("_xiii", "_xvi", "_cpc", "_passif"))), F.col("RESULTAT_NET"))})
    parts = ["ACTIFS_IMMOBILISES", "ACTIF_CIRCULANT", "TRESORERIE_ACTIF"]
    whole = F.when(reduce(lambda a, b: a & b, map(usable, parts)), make(sum((amount(c) for c in parts[1:]), amount(parts[0])), "derived", "sum_of_three_parts", sources(*parts)))
    df = df.withColumn("TOTAL_ACTIF", F.when(usable("TOTAL_ACTIF"), F.col("TOTAL_ACTIF")).otherwise(F.coalesce(whole, F.col("TOTAL_ACTIF"))))
    df = df.withColumn("TOTAL_BILAN", balance_total())
    df = df.withColumn("ACHATS_TOTAL", F.when(usable("ACHATS_REVENDUS") & usable("ACHATS_CONSOMMES"), make(amount("ACHATS_REVENDUS") + amount("ACHATS_CONSOMMES"), "derived", "resold_plus_consumed", sources("ACHATS_REVENDUS", "ACHATS_CONSOMMES"))).otherwise(F.col("ACHATS_TOTAL")))
    return derive_results(df).drop("m", "_xiii", "_xvi", "_cpc", "_passif")


def net_result(xiii: Column, xvi: Column, cpc: Column, passif: Column) -> Column:
    """The net result from its four printed places; null if none of them decides."""
    numbered = xiii.isNotNull() & xvi.isNotNull()
    same = numbered & agree(xiii, xvi)
    lines, income, sheet = (F.concat(*(source(F.lit(s), F.lit(False)) for s in names)) for names in (["ANY:RESULTAT_NET_XIII", "ANY:RESULTAT_NET_XVI"], ["NET_CPC"], ["NET_BILAN"]))
    return (
        F.when(same, make(xiii, "confirmed", F.when(~agree(xiii, passif), "balance_sheet_differs"), lines))
        .when(numbered & passif.isNotNull(), make(passif, "confirmed", "lines_differ", sheet))
        .when(numbered, make(F.lit(None), "conflicting", "lines_differ", lines))
        .when(agree(cpc, passif), make(cpc, "confirmed", None, F.concat(income, sheet)))
        .when(cpc.isNotNull() & passif.isNotNull(), make(passif, "confirmed", "income_statement_differs", sheet))
        .when(cpc.isNotNull() | passif.isNotNull(), make(F.coalesce(cpc, passif), "confirmed", None, F.when(cpc.isNotNull(), income).otherwise(sheet)))
    )


def balance_total() -> Column:
    """The balance total: both sides agreeing, one side alone, or none."""
    a, b = usable("TOTAL_ACTIF"), usable("TOTAL_PASSIF")
    both = sources("TOTAL_ACTIF", "TOTAL_PASSIF")
    return (
        F.when(a & b & agree(amount("TOTAL_ACTIF"), amount("TOTAL_PASSIF")), make(amount("TOTAL_ACTIF"), "confirmed", None, both))
        .when(a & b, make(F.lit(None), "conflicting", "sides_differ", both))
        .when(a, make(amount("TOTAL_ACTIF"), "derived", "assets_alone", sources("TOTAL_ACTIF")))
        .when(b, make(amount("TOTAL_PASSIF"), "derived", "liabilities_alone", sources("TOTAL_PASSIF")))
        .otherwise(make(F.lit(None), "missing"))
    )


# Results that are computed from others, in order: target, first, sign, second.
RESULTS = [
    ("RESULTAT_FINANCIER", "PRODUITS_FINANCIERS", -1, "CHARGES_FINANCIERES"),
    ("RESULTAT_NON_COURANT", "PRODUITS_NON_COURANTS", -1, "CHARGES_NON_COURANTES"),
    ("RESULTAT_AVANT_IMPOT", "RESULTAT_COURANT", 1, "RESULTAT_NON_COURANT"),
]


def derive_results(df: DataFrame) -> DataFrame:
    """Results that their parts give: absent ones are filled, readings that disagree replaced.

    The net result is derived only if it has no row at all; net cash and total purchases only where open.
    """
    for target, first, sign, second in RESULTS:
        calc = (amount(first) + amount(second) if sign > 0 else amount(first) - amount(second)).cast(AMOUNT)
        both = usable(first) & usable(second)
        wrong = usable(target) & ~agree(amount(target), calc)
        df = df.withColumn(target, F.when(both & wrong, make(calc, "derived", "reading_replaced", sources(target, first, second))).when(both & is_open(target), make(calc, "derived", "from_parts", sources(first, second))).otherwise(F.col(target)))
    both = usable("RESULTAT_AVANT_IMPOT") & usable("IMPOT_SUR_RESULTATS")
    df = df.withColumn("RESULTAT_NET", F.when(both & F.col("RESULTAT_NET").isNull(), make(amount("RESULTAT_AVANT_IMPOT") - amount("IMPOT_SUR_RESULTATS"), "derived", "before_tax_less_tax", sources("RESULTAT_AVANT_IMPOT", "IMPOT_SUR_RESULTATS"))).otherwise(F.col("RESULTAT_NET")))
    both = usable("TRESORERIE_ACTIF") & usable("TRESORERIE_PASSIF")
    return df.withColumn("TRESORERIE_NETTE", F.when(both & F.col("TRESORERIE_NETTE").isNull(), make(amount("TRESORERIE_ACTIF") - amount("TRESORERIE_PASSIF"), "derived", "assets_less_liabilities", sources("TRESORERIE_ACTIF", "TRESORERIE_PASSIF"))).otherwise(F.col("TRESORERIE_NETTE")))


def to_dataset(resolved: DataFrame, vision: bool = False) -> DataFrame:
    """One row for each document: every dataset field (``missing`` where absent), simple derivations, ``warnings``.

    Net cash, working capital and cash flow are derived where missing; on the vision path also working capital from
    equity, debts (the one place where absent debts count as 0) and fixed assets, working capital needs and purchases.
    """
    noted = F.flatten(F.array(*(F.when(F.col(c)["status"] == "conflicting", F.array_prepend(F.col(c)["warnings"], f"{c} conflicting.")).otherwise(F.coalesce(F.col(c)["warnings"], F.array().cast(NOTES))) for c in RULES.DATASET)))
    df = resolved.select(DOC, noted.alias("warnings"), *(F.coalesce(F.col(c), make(F.lit(None), "missing")).alias(c) for c in RULES.DATASET))
    missing = lambda c: F.col(c)["status"] == "missing"
    every = lambda *codes: reduce(lambda a, b: a & b, map(usable, codes))

    def put(df: DataFrame, target: str, when: Column, value: Column, note: str, *parts: str) -> DataFrame:
        return df.withColumn(target, F.when(when, make(value, "derived", note, sources(*parts))).otherwise(F.col(target)))

    cash = amount("TRESORERIE_ACTIF") - amount("TRESORERIE_PASSIF")
    df = put(df, "TRESORERIE_NETTE", missing("TRESORERIE_NETTE") & every("TRESORERIE_ACTIF", "TRESORERIE_PASSIF"), cash, "assets_less_liabilities", "TRESORERIE_ACTIF", "TRESORERIE_PASSIF")
    current = ("ACTIF_CIRCULANT", "TRESORERIE_ACTIF", "PASSIF_CIRCULANT", "TRESORERIE_PASSIF")
    df = put(df, "FDR", missing("FDR") & every(*current), amount("ACTIF_CIRCULANT") + amount("TRESORERIE_ACTIF") - amount("PASSIF_CIRCULANT") - amount("TRESORERIE_PASSIF"), "current_sides", *current)
    df = put(df, "CAF", missing("CAF") & every("RESULTAT_NET", "DOTATIONS_AMORTISSEMENTS"), amount("RESULTAT_NET") + amount("DOTATIONS_AMORTISSEMENTS"), "simple_cash_flow", "RESULTAT_NET", "DOTATIONS_AMORTISSEMENTS")
    if vision:
        df = put(df, "TRESORERIE_NETTE", is_open("TRESORERIE_NETTE") & every("TRESORERIE_ACTIF", "TRESORERIE_PASSIF"), cash, "assets_less_liabilities", "TRESORERIE_ACTIF", "TRESORERIE_PASSIF")
        debts = F.when(usable("DETTES_FINANCIERES"), amount("DETTES_FINANCIERES")).otherwise(F.lit(0).cast(AMOUNT))
        df = put(df, "FDR", is_open("FDR") & every("FONDS_PROPRES", "ACTIFS_IMMOBILISES"), amount("FONDS_PROPRES") + debts - amount("ACTIFS_IMMOBILISES"), "permanent_capital", "FONDS_PROPRES", "DETTES_FINANCIERES", "ACTIFS_IMMOBILISES")
        df = put(df, "BFDR", is_open("BFDR") & every("FDR", "TRESORERIE_NETTE"), amount("FDR") - amount("TRESORERIE_NETTE"), "working_capital_less_cash", "FDR", "TRESORERIE_NETTE")
        df = put(df, "ACHATS_TOTAL", is_open("ACHATS_TOTAL") & every("ACHATS_REVENDUS", "ACHATS_CONSOMMES"), amount("ACHATS_REVENDUS") + amount("ACHATS_CONSOMMES"), "resold_plus_consumed", "ACHATS_REVENDUS", "ACHATS_CONSOMMES")
    return df


def dataset_values(dataset: DataFrame, keys: list[str] = [DOC], codes: list[str] = RULES.DATASET) -> DataFrame:  # noqa: B006
    """Long rows (keys, code, value, status, warnings) of a dataset, or of those fields of it that are wanted; others are not made."""
    cells = [F.struct(F.lit(c).alias("code"), F.col(c)["value"].alias("value"), F.col(c)["status"].alias("status"), F.col(c)["warnings"].alias("warnings")) for c in RULES.DATASET if c in codes]
    return dataset.select(*keys, F.inline(F.array(*cells)))


def provenance(dataset: DataFrame, competing: DataFrame) -> DataFrame:
    """The candidates behind every value of a dataset (or of ``resolved_fields``), from the slots that gave it.

    Rows (document_id, code, status, source, place, slot, and of ``EVIDENCE`` what the candidates have): ``source`` counts
    the sources of a value in the order of its formula, ``place`` the candidates of one source by rank and source order.
    A conflict shows all candidates of equal rank, other values the first. Values that come from nowhere have no row.
    """
    codes = [c for c in _CODES if c in dataset.columns]
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c)["status"].alias("status"), F.col(c)["sources"].alias("sources")) for c in codes)))
    named = dataset.select(DOC, cells).select(DOC, "code", "status", F.posexplode("sources").alias("source", "_s")).select(DOC, "code", "status", "source", "_s.*")
    order = Window.partitionBy(DOC, "slot").orderBy(F.col("priority").desc(), "ordinal")
    standing = ranked(competing).where("near").withColumn("place", F.row_number().over(order)).select(DOC, "slot", "place", *(c for c in EVIDENCE if c in competing.columns))
    return named.join(standing, [DOC, "slot"]).where("every or place = 1").drop("every")


# The columns that ratio operators read, and the fields that give them.
RATIO_FIELDS = {
    "ca": "CHIFFRE_AFFAIRES", "ca_n1": "CHIFFRE_AFFAIRES_N1", "fp": "FONDS_PROPRES", "tb": "TOTAL_BILAN", "df": "DETTES_FINANCIERES", "rn": "RESULTAT_NET", "caf": "CAF",
    "clients": "CLIENTS", "fourn": "FOURNISSEURS", "achats": "ACHATS_TOTAL", "fdr": "FDR", "tn": "TRESORERIE_NETTE", "leasing": "ENCOURS_LEASING", "cmt": "CMT", "operation": "NOUVEAU_FINANCEMENT",
}


def statement_of(dataset: DataFrame) -> DataFrame:
    """The dataset's usable amounts under the names that ratio operators read; others are null."""
    return dataset.select(DOC, *(F.when(usable(c), amount(c)).alias(n) for n, c in RATIO_FIELDS.items()))
