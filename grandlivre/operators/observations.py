"""From page payloads to resolved fields: observations, registry matching, choice, sums, derivations, checks, results.

Payloads are rows (document_id, page, page_type, table_title, columns array<string>, rows array<struct<label, values
map<string,string>, listed array<string>, empty boolean, confidence double>>, metadata map<string,string>, elements
map<string,string>, empty_fields array<string>); absent columns count as null. One table cell is one observation;
``ordinal`` is the source order, which breaks ties.

Labels meet the registry as distinct normal labels, so the only join without equality is that of distinct labels with
its hundred aliases. Choices are windows by document and field; a document's fields become columns of one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.amounts import AMOUNT, parse_amount, sum_present, unmarked, unmarked_amount
from ..functions.labels import header_nature, label_similarity, latin, normal, normalize_label
from ..rules import fields as RULES
from ..sources.scratch import written_once
from .resolve import total_order

DOC = "document_id"
#: Schema of payload files.
PAYLOAD = (
    "document_id string, page int, page_type string, table_title string, columns array<string>, rows array<struct<label:string,values:map<string,string>,listed:array<string>,empty:boolean,confidence:double>>,"
    " metadata map<string,string>, elements map<string,string>, empty_fields array<string>"
)
# Weights of an observation's score, the least label score, and the factor of cells without columns.
LABEL, SECTION, COLUMN, PERIOD, TABLE, LEAST, LEGACY = 0.40, 0.20, 0.25, 0.10, 0.05, 0.55, 0.85
# Two scores this near with other amounts are ambiguous; candidates kept for audit; confidence that is usable.
GAP, KEPT, USABLE = 0.08, 5, 0.65

FIELD = (
    f"struct<value:{AMOUNT},calculated:{AMOUNT},status:string,confidence:double,validation:string,calculation:string,eligible:boolean,column:string,page:int,raw_label:string,source:string,"
    f"reason:string,missing:array<string>,candidates:array<struct<value:{AMOUNT},score:double,column:string,page:int,method:string>>>"
)


def payload_observations(payloads: DataFrame) -> DataFrame:
    """A row for each table cell, empty line, metadatum and, where a page has no rows, legacy element."""
    for name, kind in [("table_title", "string"), ("columns", "array<string>"), ("metadata", "map<string,string>"), ("elements", "map<string,string>"), ("empty_fields", "array<string>")]:
        if name not in payloads.columns:
            payloads = payloads.withColumn(name, F.lit(None).cast(kind))
    none = lambda kind: F.lit(None).cast(kind)
    base = payloads.withColumn("section", F.upper(F.coalesce(F.nullif("page_type", F.lit("")), F.lit("AUTRE"))))
    rows = base.select(DOC, "page", "section", "table_title", "columns", F.posexplode("rows").alias("row_index", "r"))
    label = F.trim(F.coalesce(F.col("r.label"), F.lit("")))
    pairs = F.transform("r.listed", lambda v, i: F.struct(F.coalesce(F.get("columns", i), F.concat(F.lit("col_"), i.cast("string"))).alias("key"), v.alias("value")))
    cells = F.coalesce(pairs, F.map_entries("r.values"), F.array().cast("array<struct<key:string,value:string>>"))
    empty = F.coalesce(F.col("r.empty"), F.lit(False))
    lines = rows.where(label != "").select(DOC, "page", "section", "table_title", "row_index", label.alias("raw_label"), cells.alias("cells"), empty.alias("empty"), F.col("r.confidence").alias("model_confidence"))
    # a line without cells is an observation only if it is said to be empty
    lone = F.when((F.size("cells") == 0) & F.col("empty"), F.array(F.struct(none("string").alias("key"), none("string").alias("value"))))
    table = lines.select("*", F.posexplode(F.coalesce(lone, F.col("cells"))).alias("place", "cell"))
    table = table.select(
        DOC, "page", "section", "table_title", "raw_label", F.col("cell.value").alias("raw_value"), "row_index", F.col("cell.key").alias("column_name"), "empty", F.lit("payload").alias("method"), "model_confidence",
        (F.col("row_index") * 1000 + F.col("place")).cast("long").alias("_order"),
    )
    meta = base.select(DOC, "page", F.lit("IDENTIFICATION").alias("section"), none("string").alias("table_title"), F.posexplode("metadata").alias("place", "raw_label", "raw_value")).where(F.trim("raw_value") != "")
    meta = meta.select(DOC, "page", "section", "table_title", "raw_label", "raw_value", none("int").alias("row_index"), none("string").alias("column_name"), F.lit(False).alias("empty"), F.lit("metadata").alias("method"), none("double").alias("model_confidence"), (F.lit(10**6) + F.col("place")).cast("long").alias("_order"))
    flat = base.where(F.coalesce(F.size("rows"), F.lit(0)) <= 0).select(DOC, "page", "section", "empty_fields", F.posexplode("elements").alias("place", "code", "raw_value"))
    names = F.create_map(*(F.lit(x) for f in RULES.FIELDS for x in f[:2]))
    flat = flat.select(
        DOC, "page", "section", F.concat(F.lit("CODE:"), F.col("code")).alias("table_title"), F.coalesce(F.element_at(names, F.col("code")), F.col("code")).alias("raw_label"), "raw_value",
        none("int").alias("row_index"), none("string").alias("column_name"), F.coalesce(F.array_contains("empty_fields", F.col("code")), F.lit(False)).alias("empty"), F.lit("legacy_flat").alias("method"),
        F.when(parse_amount(F.col("raw_value")).isNotNull(), 0.55).alias("model_confidence"), (F.lit(2 * 10**6) + F.col("place")).cast("long").alias("_order"),
    )
    out = table.unionByName(meta).unionByName(flat)
    # texts that a rule reads several times are columns first, so that each is made once and the rule's generated code stays short
    headed = (F.col("method") == "payload") & (F.col("column_name") != "")
    out = out.withColumns({"_text": F.when(F.col("method") != "metadata", unmarked(F.col("raw_value"))), "_header": F.when(headed, latin(F.col("column_name"))), "_label": latin(F.col("raw_label"))})
    out = out.withColumns({"normalized_label": normal(F.col("_label")), "_header": normal(F.col("_header"))})
    nature = F.when(F.col("_header").isNull(), "unknown").otherwise(header_nature(F.col("_header")))
    out = out.withColumns({"parsed_value": unmarked_amount(F.col("_text")), "value_nature": nature})
    return out.withColumns({"line_present_empty": F.col("empty") & F.col("parsed_value").isNull(), "ordinal": F.col("page").cast("long") * 10**7 + F.col("_order")}).drop("_order", "empty", "_text", "_header", "_label")


def match_registry(labels: DataFrame, spark: SparkSession, least: float = LEAST) -> DataFrame:
    """(normalized_label, code, label_score) of ``labels`` (normalized_label, distinct): best alias of each field, exclusions out."""
    known = F.broadcast(RULES.aliases(spark).select("code", normalize_label(F.col("alias")).alias("_alias")))
    score = label_similarity(F.col("normalized_label"), F.col("_alias"))
    near = labels.join(known, score >= least).groupBy("normalized_label", "code").agg(F.max(score).alias("label_score"))
    banned = F.create_map(*(x for c, words in RULES.EXCLUSIONS.items() for x in (F.lit(c), F.array(*map(F.lit, words)))))
    hit = F.exists(F.coalesce(F.element_at(banned, F.col("code")), F.array().cast("array<string>")), lambda w: F.col("normalized_label").contains(w))
    return near.where(~hit)


def score_observations(obs: DataFrame) -> DataFrame:
    """Observations by field: ``obs`` with code, score and match (``alias`` or ``exact_code``); forbidden columns reject."""
    spark = obs.sparkSession
    named = F.when(F.col("table_title").startswith("CODE:"), F.substring("table_title", 6, 200))
    matches = match_registry(obs.select("normalized_label").distinct(), spark).groupBy("normalized_label").agg(F.collect_list(F.struct("code", "label_score")).alias("found"))  # a label's fields, at most 31
    exact = F.when(named.isin([f[0] for f in RULES.FIELDS]), F.array(F.struct(named.alias("code"), F.lit(1.0).alias("label_score"), F.lit("exact_code").alias("match"))))
    alias = F.transform(F.filter("found", lambda x: ~x["code"].eqNullSafe(named)), lambda x: F.struct(x["code"].alias("code"), x["label_score"].alias("label_score"), F.lit("alias").alias("match")))
    none = F.array().cast("array<struct<code:string,label_score:double,match:string>>")
    rows = obs.join(matches, "normalized_label", "left").withColumn("_m", F.explode(F.concat(F.coalesce(exact, none), F.coalesce(alias, none)))).drop("found")
    rules = F.broadcast(RULES.registry(spark).select("code", "sections", "preferred", "forbidden", "zero_if_empty"))
    rows = rows.select(*obs.columns, "_m.*").join(rules, "code")
    nature, section = F.coalesce("value_nature", F.lit("unknown")), F.col("section")
    rank = F.array_position("preferred", nature)
    column = F.when(F.size("preferred") == 0, 0.5).when(rank > 0, 1.0 - 0.1 * (rank - 1)).when(nature == "unknown", 0.25).otherwise(0.0)
    place = F.when(F.coalesce(section, F.lit("")) == "", 0.3).when(F.array_contains("sections", section), 1.0).otherwise(0.1)
    period = F.when(nature.isin("net_n", "total_exercice", "exercice", "unknown"), 1.0).otherwise(0.5)
    table = F.when(F.coalesce("table_title", F.lit("")) != "", 0.8).otherwise(0.5)
    total = LABEL * F.col("label_score") + SECTION * place + COLUMN * column + PERIOD * period + TABLE * table
    out = rows.where(~F.array_contains("forbidden", nature))
    return out.withColumn("score", F.when(F.col("method").contains("legacy"), total * LEGACY).otherwise(total)).drop("preferred", "forbidden")


def top_candidates(scored: DataFrame, n: int = KEPT) -> DataFrame:
    """The ``n`` best observations with an amount of each document and field, numbered from 1."""
    own = Window.partitionBy(DOC, "code").orderBy(F.desc("score"), *total_order(scored, ["ordinal"], [DOC, "code", "score"]))
    return scored.where("parsed_value is not null").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n)


def resolve_fields(scored: DataFrame) -> DataFrame:
    """(document_id, code, field) for each field with an observation: the best one, ambiguous if the next is near with another amount."""
    own = Window.partitionBy(DOC, "code").orderBy(F.col("parsed_value").isNull(), F.desc("score"), *total_order(scored, ["ordinal"], [DOC, "code", "score"]))
    ranked = scored.withColumn("_n", F.row_number().over(own)).where(F.col("parsed_value").isNull() | (F.col("_n") <= KEPT))
    amount, nth = F.col("parsed_value").isNotNull(), lambda k: (F.col("_n") == k) & F.col("parsed_value").isNotNull()
    facts = F.struct("parsed_value", "score", F.coalesce("value_nature", "column_name").alias("column"), "page", "raw_label", "section", "match", "model_confidence")
    empty = F.col("line_present_empty") & ~amount
    kept = F.struct("_n", F.struct(F.col("parsed_value").alias("value"), "score", F.coalesce("value_nature", "column_name").alias("column"), "page", F.col("match").alias("method")).alias("c"))
    g = ranked.groupBy(DOC, "code").agg(
        F.max(F.when(nth(1), facts)).alias("a"), F.max(F.when(nth(2), F.struct("parsed_value", "score"))).alias("b"), F.max_by(F.when(empty, F.col("raw_label")), F.when(empty, F.col("ordinal"))).alias("empty_label"),
        F.max(empty).alias("any_empty"), F.first("zero_if_empty").alias("zero_if_empty"), F.first("sections").alias("sections"), F.sort_array(F.collect_list(F.when(amount, kept))).alias("top"),
    )
    a, b = F.col("a"), F.col("b")
    doubt = F.coalesce((a["parsed_value"] != b["parsed_value"]) & (F.abs(a["score"] - b["score"]) < GAP), F.lit(False))
    sure = F.least(F.lit(0.99), F.greatest(F.lit(0.35), a["score"]))
    sure = F.when(doubt, F.least(sure, F.lit(0.55))).otherwise(sure)
    sure = F.when(F.coalesce(a["column"], F.lit("unknown")) == "unknown", F.least(sure, F.lit(0.65))).otherwise(sure)
    sure = F.when(a["model_confidence"].isNotNull(), F.round((sure + a["model_confidence"]) / 2, 4)).otherwise(sure)
    found = field(a["parsed_value"], F.when(doubt, "ambiguous").otherwise("detected"), sure, a["match"], column=a["column"], page=a["page"], raw_label=a["raw_label"], source=a["section"], candidates=F.transform("top", lambda t: t["c"]))
    zero = field(F.lit(0), "detected_zero", 0.7, "empty_line", raw_label=F.col("empty_label"), source=F.col("sections")[0])
    return g.select(DOC, "code", F.when(a.isNotNull(), found).when(F.col("any_empty") & F.col("zero_if_empty"), zero).otherwise(field(None, "not_detected", 0.0, None)).alias("field"))


def field(value, status, confidence, reason, **more) -> Column:
    """A resolved field; what is not given is null, and the field may be scored."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {"value": value, "status": status, "confidence": confidence, "reason": reason, "eligible": True} | more
    kinds = {"missing": "array<string>", "candidates": f"array<struct<value:{AMOUNT},score:double,column:string,page:int,method:string>>"}
    order = ["value", "calculated", "status", "confidence", "validation", "calculation", "eligible", "column", "page", "raw_label", "source", "reason", "missing", "candidates"]
    types = {"value": AMOUNT, "calculated": AMOUNT, "confidence": "double", "eligible": "boolean", "page": "int"} | kinds
    return F.struct(*(lit(given.get(n)).cast(types.get(n, "string")).alias(n) for n in order)).cast(FIELD)


def changed(code: str, **more) -> Column:
    """A field with some parts replaced."""
    out = F.col(code)
    for name, value in more.items():
        out = out.withField(name, value if isinstance(value, Column) else F.lit(value))
    return out.cast(FIELD)


def value(code: str) -> Column:
    return F.col(code)["value"]


_CODES = [f[0] for f in RULES.FIELDS]
_SECTION = {f[0]: f[2][0] for f in RULES.FIELDS}


def wide(resolved: DataFrame) -> DataFrame:
    """One row for each document, a column for each field of the registry and each derived one (null until derived)."""
    m = resolved.groupBy(DOC).agg(F.map_from_entries(F.collect_list(F.struct("code", "field"))).alias("m"))
    return m.select(DOC, *(F.coalesce(F.element_at("m", F.lit(c)), field(None, "not_detected", 0.0, None)).alias(c) for c in _CODES), *(F.lit(None).cast(FIELD).alias(c) for c in RULES.DERIVED))


def sum_components(df: DataFrame) -> DataFrame:
    """Totals from their components, partial sums included; a confident line that is called a total stays and is compared."""
    for code, parts in RULES.COMPONENTS.items():
        total = sum_present(*(value(p) for p in parts)).cast(AMOUNT)
        f = F.col(code)
        printed = value(code).isNotNull() & f["status"].isin("detected", "ambiguous") & (f["confidence"] >= 0.7) & normalize_label(f["raw_label"]).contains("total")
        differs = F.abs(value(code) - total) > 1
        kept = F.when(differs, changed(code, calculated=total, validation="divergent", status="conflicting", confidence=F.least(f["confidence"], F.lit(0.6)))).otherwise(changed(code, calculated=total, validation="consistent"))
        summed = field(total, "derived", 0.9, "sum_of_components", calculated=total, validation="consistent", source=_SECTION[code], candidates=f["candidates"])
        df = df.withColumn(code, F.when(total.isNull(), f).when(F.coalesce(printed, F.lit(False)), kept).otherwise(summed))
    return df


def derive_fields(df: DataFrame) -> DataFrame:
    """Debts, net cash, working capital, sign of the result, cash flow and depreciation; partial sums are never scored."""
    mlt, ct = value("DETTES_BANCAIRES_MLT"), value("DETTES_BANCAIRES_CT")
    lacking = lambda *codes: F.array_compact(F.array(*(F.when(value(c).isNull(), F.lit(c)) for c in codes)))
    done = {"validation": "consistent", "calculation": "complete"}
    debts = F.when(mlt.isNotNull() & ct.isNotNull(), field(mlt + ct, "derived", 0.9, "mlt_plus_ct", calculated=mlt + ct, **done)).when(
        mlt.isNotNull() | ct.isNotNull(),
        field(None, "incomplete", 0.4, "mlt_plus_ct", calculated=F.coalesce(mlt, ct), validation="not_validated", calculation="partial", missing=lacking("DETTES_BANCAIRES_MLT", "DETTES_BANCAIRES_CT"), eligible=False),
    )
    cash = value("TRESORERIE_ACTIF") - value("TRESORERIE_PASSIF")
    capital = value("FONDS_PROPRES") + mlt - value("ACTIFS_IMMOBILISES")
    fdr = F.when(value("FDR").isNotNull(), F.col("FDR")).when(capital.isNotNull(), field(capital, "derived", 0.85, "permanent_capital_less_fixed_assets", calculated=capital, **done))
    fdr = fdr.otherwise(field(None, "incomplete", 0.3, "working_capital_needs_all_parts", validation="not_validated", calculation="unavailable", missing=lacking("FONDS_PROPRES", "DETTES_BANCAIRES_MLT", "ACTIFS_IMMOBILISES"), eligible=False))
    rn = value("RESULTAT_NET")
    sign = F.when(rn > 0, "Bénéficiaire").when(rn < 0, "Déficitaire").otherwise("Nul")
    # a depreciation of 0 counts as absent, as where it comes from
    worn = F.coalesce(F.nullif(value("AMORTISSEMENTS"), F.lit(0).cast(AMOUNT)), value("DOTATIONS_EXPLOITATION"))
    flow, own = (rn + worn).cast(AMOUNT), value("CAF")
    estimate = field(None, "estimated", 0.45, "result_plus_depreciation", calculated=flow, validation="not_validated", calculation="incomplete_estimate", missing=F.array(F.lit("CAF_DIRECTE_ESG")), eligible=False)
    agrees = F.abs(own - flow) <= 1
    checked = F.when(agrees, changed("CAF", calculated=flow, calculation="complete", validation="consistent")).otherwise(changed("CAF", calculated=flow, calculation="complete", validation="divergent", eligible=False))
    caf = F.when(own.isNull() & flow.isNotNull(), estimate).when(flow.isNotNull(), checked).otherwise(F.col("CAF"))
    take = (value("AMORTISSEMENTS").isNull() | (F.col("AMORTISSEMENTS")["status"] == "ambiguous")) & value("DOTATIONS_EXPLOITATION").isNotNull()
    out = df.withColumns({"DETTES_FINANCIERES": debts, "TRESORERIE_NETTE": F.when(cash.isNotNull(), field(cash, "derived", 0.92, "assets_less_liabilities", calculated=cash, **done)), "FDR": fdr, "CAF": caf})
    out = out.withColumn("TYPE_RESULTAT", F.when(rn.isNotNull(), field(None, "derived", 0.95, sign, calculation="complete", source="Dérivé")))
    return out.withColumn("AMORTISSEMENTS", F.when(take, changed("DOTATIONS_EXPLOITATION", status="detected", reason="operating_depreciation")).otherwise(F.col("AMORTISSEMENTS")))


# Checks (code, fields, expected, observed, tolerance, status and severity of a failure, validation that a failure gives).
CHECKS = [
    ("TOTAL_ACTIF_EQ_TOTAL_PASSIF", ["TOTAL_BILAN", "TOTAL_PASSIF"], ["TOTAL_PASSIF"], "TOTAL_BILAN", "0.01", "warning", "high", "warning"),
    ("TRESORERIE_NETTE_EQ_ACTIF_MINUS_PASSIF", ["TRESORERIE_ACTIF", "TRESORERIE_PASSIF", "TRESORERIE_NETTE"], ["TRESORERIE_ACTIF", "-TRESORERIE_PASSIF"], "TRESORERIE_NETTE", "0.01", "failed", "high", "invalidated"),
    ("DETTES_FIN_EQ_MLT_PLUS_CT", ["DETTES_BANCAIRES_MLT", "DETTES_BANCAIRES_CT", "DETTES_FINANCIERES"], ["DETTES_BANCAIRES_MLT", "DETTES_BANCAIRES_CT"], "DETTES_FINANCIERES", "0.01", "failed", "high", "invalidated"),
    ("TRESO_PASSIF_EQ_COMPONENTS", ["CREDITS_TRESORERIE", "BANQUES_SOLDES_CREDITEURS", "TRESORERIE_PASSIF"], ["CREDITS_TRESORERIE", "BANQUES_SOLDES_CREDITEURS"], "TRESORERIE_PASSIF", "0.01", "warning", "medium", "warning"),
    ("CAF_DIRECTE_EQ_CAF_CALCULEE", ["CAF"], [], "CAF", "1", "warning", "medium", None),
]


def _check(rule: tuple, liabilities: Column) -> tuple[Column, Column]:
    """The row of a check (null if it gives none) and the validation that it leaves on its observed field."""
    code, fields, parts, observed, tolerance, failure, severity, after = rule
    amount = lambda c: liabilities if c == "TOTAL_PASSIF" else value(c)
    seen = value(observed)
    if parts:
        expected = reduce(lambda x, y: x + y, [-amount(p[1:]) if p[0] == "-" else amount(p) for p in parts]).cast(AMOUNT)
        # only the balance and the debts need both sides; net cash is left untold where its parts are there and it is not
        silent = expected.isNotNull() & seen.isNull() if code.startswith("TRESORERIE_NETTE") else F.lit(False)
        shown = ~silent
    else:
        expected, shown = F.col("CAF")["calculated"], F.col("CAF")["calculated"].isNotNull()
    testable = expected.isNotNull() & seen.isNotNull()
    wrong = testable & (F.abs(seen - expected) > F.lit(tolerance).cast(AMOUNT))
    status = F.when(~testable, "insufficient_data").when(wrong, failure).otherwise("passed")
    told = F.when(testable, expected) if code not in ("TOTAL_ACTIF_EQ_TOTAL_PASSIF", "CAF_DIRECTE_EQ_CAF_CALCULEE") else expected
    row = F.struct(
        F.lit(code).alias("check_code"), status.alias("status"), F.when(wrong, severity).otherwise("info").alias("severity"), F.array(*map(F.lit, fields)).alias("fields"), told.alias("expected"),
        seen.alias("actual"), F.when(testable, F.abs(seen - expected).cast(AMOUNT)).alias("difference"), F.lit(float(tolerance)).alias("tolerance"),
    )
    kept = F.coalesce(F.col("CAF")["validation"], F.lit("divergent")) if after is None else F.lit(after)
    return F.when(shown, row), F.when(wrong, kept).when(testable, "consistent")


def accounting_checks(df: DataFrame, liabilities: Column | None = None) -> DataFrame:
    """Long rows (document_id, check_code, status, severity, fields, expected, actual, difference, tolerance).

    ``liabilities`` is the total of the other side where it was read on its own.
    """
    return df.select(DOC, F.inline(check_rows(liabilities)))


def check_rows(liabilities: Column | None = None) -> Column:
    """The rows of a document's checks as an array."""
    side = F.lit(None).cast(AMOUNT) if liabilities is None else liabilities
    return F.array_compact(F.array(*(_check(rule, side)[0] for rule in CHECKS)))


def validate_fields(df: DataFrame, liabilities: Column | None = None) -> DataFrame:
    """``df`` with each check's outcome as the validation of its observed field."""
    side = F.lit(None).cast(AMOUNT) if liabilities is None else liabilities
    return df.withColumns({rule[3]: F.when((mark := _check(rule, side)[1]).isNotNull() & F.col(rule[3]).isNotNull(), changed(rule[3], validation=mark)).otherwise(F.col(rule[3])) for rule in CHECKS})


def is_usable(code: str, least: float = USABLE) -> Column:
    """Whether a field may be scored: eligible, detected or derived, not invalidated, and confident enough."""
    f = F.col(code)
    ok = f["eligible"] & f["status"].isin("detected", "detected_zero", "derived") & (f["confidence"] >= least)
    return F.coalesce(ok & ~F.coalesce(f["validation"].isin("invalidated", "divergent", "incomplete", "failed"), F.lit(False)), F.lit(False))


def detected(code: str) -> Column:
    """Whether a field has a value that was detected or derived."""
    return F.coalesce(value(code).isNotNull() & F.col(code)["status"].isin("detected", "detected_zero", "derived"), F.lit(False))


def completeness(df: DataFrame) -> Column:
    """Percent of the required fields that are detected, the sign of the result among them; one decimal."""
    found = reduce(lambda a, b: a + b, [detected(c).cast("int") for c in RULES.REQUIRED]) + F.col("TYPE_RESULTAT").isNotNull().cast("int")
    return F.round(100.0 * found / (len(RULES.REQUIRED) + 1), 1)


def section_flags(df: DataFrame, seen: DataFrame) -> DataFrame:
    """(document_id, detected, extraction_complete, validated, completeness): maps by section.

    ``seen`` (document_id, section) are the sections of the document's pages.
    """
    sections = ["BILAN_ACTIF", "BILAN_PASSIF", "CPC"]
    codes = {s: [f[0] for f in RULES.FIELDS if s in f[2] and f[7]] for s in sections}
    every = lambda tests: reduce(lambda a, b: a & b, tests)
    as_map = lambda test: F.create_map(*(x for s in sections for x in (F.lit(s), test(s))))
    found = seen.where(F.col("section").isin(sections)).groupBy(DOC).agg(F.collect_set("section").alias("_seen"))
    joined = df.join(found, DOC, "left")
    here = lambda s: F.coalesce(F.array_contains("_seen", s), F.lit(False))
    complete = lambda s: every([detected(c) for c in codes[s]])
    valid = lambda s: every([F.coalesce(F.col(c)["validation"] == "consistent", F.lit(False)) for c in codes[s]])
    return joined.select(DOC, as_map(here).alias("detected"), as_map(complete).alias("extraction_complete"), as_map(valid).alias("validated"), as_map(lambda s: here(s) & complete(s)).alias("completeness"))


def elements(df: DataFrame) -> DataFrame:
    """Long rows (document_id, number, code, label, value, status, confidence, note) of the nineteen elements, in order."""
    return df.select(DOC, F.inline(element_rows()))


def element_rows() -> Column:
    """The rows of a document's elements as an array."""
    rows = []
    for number, code, label in RULES.ELEMENTS:
        f = F.col(code)
        rows.append(F.struct(F.lit(number).alias("number"), F.lit(code).alias("code"), F.lit(label).alias("label"), f["value"].alias("value"), F.coalesce(f["status"], F.lit("not_detected")).alias("status"), F.coalesce(f["confidence"], F.lit(0.0)).alias("confidence"), (f["reason"] if code == "TYPE_RESULTAT" else F.lit(None).cast("string")).alias("note")))
    return F.array(*rows)


def scoring_input(df: DataFrame) -> DataFrame:
    """One row for each document: the usable fields under the keys of the scoring request, others null."""
    return df.select(DOC, *(F.when(is_usable(c), value(c)).alias(k) for c, k in RULES.SCORING_KEYS.items()), *(F.lit(None).cast(AMOUNT).alias(k) for k in ("encours_leasing", "cmt", "nouveau_financement")))


def document_metadata(obs: DataFrame, payloads: DataFrame | None = None, pages: int = 8) -> DataFrame:
    """(document_id, reference, entreprise, ...): identification data, from the first pages' metadata, else from labels.

    The earliest non-empty value counts; labels of financial sections count on the first five pages only.
    """
    names = list(RULES.METADATA)
    known = [(m, normalize_label(F.lit(a))) for m, aliases in RULES.METADATA.items() for a in aliases]
    score = {m: F.greatest(*(label_similarity(F.col("normalized_label"), a) for k, a in known if k == m), F.lit(0.0)) for m in names}
    # labels are scored once each, however many observations have them; a filter on the scores would be moved below the distinct and score every observation
    fits = obs.select("normalized_label").distinct().select("normalized_label", F.array_compact(F.array(*(F.when(score[m] >= 0.7, F.lit(m)) for m in names))).alias("_fits"))
    text = F.trim("raw_value")
    open_ = (F.coalesce("section", F.lit("AUTRE")).isin("IDENTIFICATION", "AUTRE")) | (F.col("page") <= 5)
    take = lambda m: F.array_contains("_fits", m) & (text != "") & open_
    out = obs.select(DOC, "normalized_label", "raw_value", "section", "page", "ordinal").join(fits, "normalized_label", "left").groupBy(DOC).agg(*(F.min_by(F.when(take(m), text), F.when(take(m), F.col("ordinal"))).alias(m) for m in names))
    if payloads is None:
        return out
    first = Window.partitionBy(DOC).orderBy("page", *(F.element_at("metadata", F.lit(m)) for m in names))
    early = payloads.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= pages)
    own = lambda m: F.nullif(F.trim(F.element_at("metadata", F.lit(m))), F.lit(""))
    given = early.groupBy(DOC).agg(*(F.min_by(own(m), F.when(own(m).isNotNull(), F.col("page"))).alias(f"_{m}") for m in names))
    return out.join(given, DOC, "full_outer").select(DOC, *(F.coalesce(f"_{m}", m).alias(m) for m in names))


def resolve(payloads: DataFrame) -> DataFrame:
    """Payloads to validated fields, one row a document."""
    return resolve_observations(written_once(payload_observations(payloads), "observations"))


def resolve_observations(obs: DataFrame) -> DataFrame:
    """Observations to validated fields; ``obs``, which gives its labels and then meets their fields, is best written once before."""
    return validate_fields(derive_fields(sum_components(wide(resolve_fields(score_observations(obs))))))
