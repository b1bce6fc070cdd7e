"""Registered queries of filings: observations, candidates, sections, texts, analysis and audit, each with the same question in DuckDB SQL.

The given tables hold no filings, so filings are printed from the order tables: a borrower's year is a document, its
amounts become payload lines, candidates and text, some of them wrong on purpose. The SQL states what the rules must
make of them, from the amounts and not from the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pages as P
from .functions.labels import column_nature, fold, is_grand_total, token_overlap
from .operators import analysis as A
from .operators import audit
from .operators import evaluation as E
from .operators import native as N
from .operators import observations as O
from .operators import resolution as R
from .operators import resolve as W
from .operators import scoring as S
from .operators import sections as C
from .operators import tables as T
from .operators import vision as V
from .plans.statements import ST_SQL, statements
from .rules.candidates import DATASET
from .sources import documents as D
from .sources import reports
from .sources.scratch import dealt, written_once
from .streaming import jobs

DOC = "document_id"
YEAR_BEFORE, TOTAL = "Exercice précédent", "Total de l'exercice"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements under a document id of borrower and year."""
    st = statements(spark, sf_dir).withColumns({"leasing": F.col("ta"), "cmt": F.col("tp"), "operation": F.col("clients")})
    return st.withColumn(DOC, F.concat_ws("-", F.col("k").cast("string"), F.col("y").cast("string")))


def printed(amount: Column) -> Column:
    """An amount as printed: blanks between thousands, a decimal comma, a minus in front; null stays null."""
    cents = F.round(F.abs(amount) * 100).cast("long")
    body = F.concat(F.replace(F.format_number(F.floor(cents / 100).cast("long"), 0), F.lit(","), F.lit(" ")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(amount < 0, F.concat(F.lit("-"), body)).otherwise(body)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages a document. Every third borrower's income statement prints turnover twice; every fourth leaves the export line empty."""
    st = _filings(spark, sf_dir)
    k = F.col("k")
    row = lambda label, cells, empty=F.lit(False): F.struct(F.lit(label).alias("label"), F.map_from_arrays(F.array(*(F.lit(n) for n in cells)), F.array(*cells.values())).alias("values"), F.lit(None).cast("array<string>").alias("listed"), empty.alias("empty"), F.lit(None).cast("double").alias("confidence"))
    none = F.struct(F.lit("Dont à l'export").alias("label"), F.create_map().cast("map<string,string>").alias("values"), F.lit(None).cast("array<string>").alias("listed"), F.lit(True).alias("empty"), F.lit(None).cast("double").alias("confidence"))
    assets = F.array(row("TOTAL GENERAL", {"Brut": printed(F.col("tb") * 2), "Net exercice N": printed(F.col("tb"))}), row("Clients et comptes rattachés", {"Net exercice N": printed(F.col("clients"))}), row("TOTAL III - TRESORERIE-ACTIF", {"Net exercice N": printed(F.col("ta"))}))
    liabilities = F.array(row("Total des capitaux propres", {"Exercice N": printed(F.col("fp"))}), row("Dettes de financement", {"Exercice N": printed(F.col("df"))}), row("Crédits de trésorerie", {"Exercice N": printed(F.col("tp"))}), row("Banques, soldes créditeurs", {"Exercice N": F.when(k % 2 == 0, "100,00").otherwise("50,00")}))
    income = F.array(row("Chiffre d'affaires", {TOTAL: printed(F.col("ca"))}), row("Résultat net de l'exercice", {TOTAL: printed(F.col("rn"))}), row("Dotations d'exploitation", {TOTAL: printed(F.col("am"))}), F.when(k % 3 == 0, row("Chiffres d'affaires", {TOTAL: F.lit("1,00")})), F.when(k % 4 == 0, none))
    page = lambda n, kind, rows: F.struct(F.lit(n).alias("page"), F.lit(kind).alias("page_type"), F.lit(kind).alias("table_title"), F.array_compact(rows).alias("rows"))
    pages = F.array(page(8, "BILAN_ACTIF", assets), page(9, "BILAN_PASSIF", liabilities), page(11, "CPC", income))
    ident = F.create_map(F.lit("reference"), F.col(DOC), F.lit("exercice"), F.col("y").cast("string"))
    return st.select(DOC, ident.alias("_m"), F.inline(pages)).select(DOC, "page", "page_type", "table_title", "rows", F.when(F.col("page") == 8, F.col("_m")).alias("metadata"))


def payload_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations counted by kind of value: every cell of every page."""
    obs = O.payload_observations(_payloads(spark, sf_dir))
    return obs.groupBy("section", "value_nature", "method").agg(F.count("*").alias("n"), F.count("parsed_value").alias("n_amounts"), F.count_if("line_present_empty").alias("n_empty"), F.round(F.sum("parsed_value").cast("double"), 2).alias("total"))


def observed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved, derived and validated fields of every document."""
    df = O.resolve(_payloads(spark, sf_dir))
    codes = ["TOTAL_BILAN", "CHIFFRE_AFFAIRES", "CA_EXPORT", "CREANCES_CLIENTS", "FONDS_PROPRES", "DETTES_BANCAIRES_MLT", "DETTES_BANCAIRES_CT", "DETTES_FINANCIERES", "TRESORERIE_PASSIF", "TRESORERIE_NETTE", "RESULTAT_NET", "CAF"]
    cell = lambda c: F.struct(F.lit(c).alias("code"), F.col(c)["value"].cast("double").alias("value"), F.coalesce(F.col(c)["status"], F.lit("absent")).alias("status"), O.is_usable(c).alias("usable"))
    return df.select(DOC, F.inline(F.array(*map(cell, codes))))


def extraction_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, completeness, checks and metadata of every document."""
    payloads = written_once(_payloads(spark, sf_dir), "payloads")
    obs = written_once(O.payload_observations(payloads), "observations")
    df = O.resolve_observations(obs)
    count = lambda rows, test: F.size(F.filter(rows, test))
    own = df.select(
        DOC, O.completeness(df).alias("completeness"), F.when(O.is_usable("RESULTAT_NET"), O.value("RESULTAT_NET")).cast("double").alias("scored_result"), O.element_rows().alias("e"), O.check_rows().alias("c"),
    ).select(
        DOC, "completeness", "scored_result", count(F.col("e"), lambda x: x["value"].isNotNull()).alias("n_elements"), F.get(F.filter("e", lambda x: x["code"] == "TYPE_RESULTAT"), F.lit(0))["note"].alias("sign"),
        count(F.col("c"), lambda x: x["status"] == "passed").alias("n_passed"), count(F.col("c"), lambda x: x["status"] == "insufficient_data").alias("n_untested"),
    )
    sections = payloads.groupBy(DOC).agg(F.size(F.collect_set(F.when(F.col("page_type").isin("BILAN_ACTIF", "BILAN_PASSIF", "CPC"), F.col("page_type")))).alias("n_sections"))
    meta = O.document_metadata(obs, payloads).select(DOC, "reference", "exercice")
    return own.join(sections, DOC).join(meta, DOC)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen candidates a document at most. Turnover also stands in a purchase line, the balance differs for every fifth borrower, and so on."""
    st = _filings(spark, sf_dir)
    k, c = F.col("k"), F.col
    add = lambda x, n: (x + F.lit(n)).cast("decimal(20,4)")
    one = lambda code, value, kind, label, column, role, period="N", nature="DETAIL", page=4: (value, F.struct(
        F.lit(code).alias("field_code"), F.lit(kind).alias("page_type"), F.lit(label).alias("raw_label"), F.lit(column).alias("column_name"), F.lit(role).alias("column_role"), F.lit(period).alias("period"), F.lit(nature).alias("nature"), F.lit(page).alias("page_number")
    ))
    total, year = ("3 = 1 + 2", "TOTAL_EXERCICE_N"), ("Exercice", "EXERCICE_N")
    rows = [
        one("TOTAL_ACTIF", c("tb"), "BILAN_ACTIF", "TOTAL GENERAL I+II+III", "Net", "NET_N", nature="GRAND_TOTAL", page=2),
        one("TOTAL_ACTIF", add(c("tb"), 777), "BILAN_ACTIF", "TOTAL I", "Net", "NET_N", nature="GRAND_TOTAL", page=2),
        one("TOTAL_PASSIF", F.when(k % 5 == 0, add(c("tb"), 50000)).when(k % 5 != 1, c("tb")), "BILAN_PASSIF", "TOTAL I+II+III", *year, nature="GRAND_TOTAL", page=3),
        one("FONDS_PROPRES", c("fp"), "BILAN_PASSIF", "TOTAL DES CAPITAUX PROPRES", *year, nature="SECTION_TOTAL", page=3),
        one("DETTES_FINANCIERES", c("df"), "BILAN_PASSIF", "TOTAL DES DETTES DE FINANCEMENT", *year, nature="SECTION_TOTAL", page=3),
        one("DETTES_FINANCIERES", add(c("df"), 9), "BILAN_PASSIF", "Emprunts", *year, page=3),
        one("CHIFFRE_AFFAIRES", c("ca"), "CPC", "Chiffre d'affaires", "Taux du exercice", "UNKNOWN"),
        one("CHIFFRE_AFFAIRES", add(c("ca"), 1000), "CPC", "Achats de marchandises", *total, page=6),
        one("RESULTAT_NET_XIII", c("rn"), "CPC", "XIII Résultat net", *total, nature="SECTION_TOTAL", page=5),
        one("RESULTAT_NET_XVI", F.when(k % 7 == 0, add(c("rn"), 5000)).otherwise(c("rn")), "CPC", "XVI Résultat net", *total, nature="SECTION_TOTAL", page=5),
        one("RESULTAT_NET", F.when(k % 7 == 0, c("rn")), "BILAN_PASSIF", "Résultat net de l'exercice", *year, page=3),
        one("CLIENTS", c("clients"), "BILAN_ACTIF", "Clients et comptes rattachés", "Net", "NET_N", page=2),
        one("CLIENTS", F.when(k % 6 == 0, add(c("clients"), 10)), "BILAN_ACTIF", "Clients et comptes rattachés", "Net", "NET_N", page=2),
        one("TRESORERIE_ACTIF", c("ta"), "BILAN_ACTIF", "TOTAL TRESORERIE-ACTIF", "Net", "NET_N", nature="SECTION_TOTAL", page=2),
        one("TRESORERIE_PASSIF", c("tp"), "BILAN_PASSIF", "Trésorerie-Passif", *year, page=3),
        one("PRODUITS_FINANCIERS", c("achats"), "CPC", "Produits financiers", *total, nature="SECTION_TOTAL", page=5),
        one("CHARGES_FINANCIERES", c("fourn"), "CPC", "Charges financières", *total, nature="SECTION_TOTAL", page=5),
        one("RESULTAT_FINANCIER", add(c("achats") - c("fourn"), 1), "CPC", "Résultat financier", *total, nature="SECTION_TOTAL", page=5),
    ]
    # only amounts become rows, and are printed there; the rest of a line is looked up by its place
    amounts = st.select(DOC, F.posexplode(F.array(*(value for value, _ in rows))).alias("_i", "_v")).where("_v is not null")
    some = amounts.select(DOC, F.col("_i").cast("long").alias("ordinal"), printed(F.col("_v")).alias("raw_value"), F.get(F.array(*(line for _, line in rows)), F.col("_i")).alias("c"))
    some = some.select(DOC, "ordinal", "c.field_code", "raw_value", *(f"c.{n}" for n in ("page_type", "raw_label", "column_name", "column_role", "period", "nature", "page_number")))
    return some.withColumns({"confidence": F.lit(0.9), "source_excerpt": F.concat_ws("|", "raw_label", "raw_value"), "orientation": F.lit(0), "warnings": F.array().cast("array<string>")})


_PICKED = ["TOTAL_ACTIF", "TOTAL_BILAN", "FONDS_PROPRES", "DETTES_FINANCIERES", "CHIFFRE_AFFAIRES", "RESULTAT_NET", "CLIENTS", "TRESORERIE_NETTE", "RESULTAT_FINANCIER", "ENCOURS_LEASING"]


def resolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every document from its candidates: eligibility, priority, ties, special rules and derivations."""
    data = R.to_dataset(R.resolved_fields(V.common_candidates(_candidates(spark, sf_dir))), vision=True)
    values = R.dataset_values(data, codes=_PICKED)
    return values.select(DOC, "code", F.col("value").cast("double").alias("value"), "status")


def value_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, section, column and reading behind every value of every document, through conflicts, sums and derivations."""
    competing = written_once(R.slots(R.prepare(V.common_candidates(_candidates(spark, sf_dir)))), "competing")
    fields = written_once(R.fields_of(competing), "fields")  # one row a document; what follows is planned from its columns alone
    found = R.provenance(R.to_dataset(fields, vision=True), competing)
    return found.select(DOC, "code", "status", "source", "place", "page_number", "section", "column_role", "raw_label", F.col("amount").cast("double").alias("amount"))


def candidate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible and refused candidates by field and reason."""
    counts = R.reason_counts(V.common_candidates(_candidates(spark, sf_dir)))
    return counts.select("field_code", F.array_join("reasons", ",").alias("reasons"), "ok", "n")


def mapping_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and resolved, missing and conflicting fields of every document."""
    cands = written_once(V.common_candidates(_candidates(spark, sf_dir)), "candidates")  # counted and resolved
    out = A.dataset_audit(cands, R.to_dataset(R.resolved_fields(cands)))
    return out.select(DOC, "candidates_total", F.size("candidates_by_field").alias("n_fields"), F.size("conflicting").alias("n_conflicting"), F.array_join("conflicting", ",").alias("conflicting"))


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of statements with printed results beside them; every fourth borrower's financial result is wrong."""
    st = _filings(spark, sf_dir)
    st = W.with_previous(st, "k", "y", "ca", "ca_n1")
    given = {c: F.col(n) for n, c in R.RATIO_FIELDS.items() if n in st.columns and c != "ACHATS_TOTAL"} | {"ACHATS_TOTAL": F.col("achats"), "TOTAL_ACTIF": F.col("tb"), "TOTAL_PASSIF": F.col("tb"), "TRESORERIE_ACTIF": F.col("ta"), "TRESORERIE_PASSIF": F.col("tp")}
    wrong = F.when(F.col("k") % 4 == 0, F.col("achats") - F.col("fourn") + 1000).otherwise(F.col("achats") - F.col("fourn"))
    given |= {"PRODUITS_FINANCIERS": F.col("achats"), "CHARGES_FINANCIERES": F.col("fourn"), "RESULTAT_FINANCIER": wrong, "ENCOURS_LEASING": F.col("ta"), "CMT": F.col("tp"), "NOUVEAU_FINANCEMENT": F.col("clients")}
    field = lambda x: F.when(x.isNotNull(), R.make(x, "confirmed")).otherwise(R.make(F.lit(None), "missing"))
    return st.select(DOC, "k", "y", "seg", F.array().cast("array<string>").alias("warnings"), *(field(given[c]).alias(c) if c in given else R.make(F.lit(None), "missing").alias(c) for c in DATASET))


def dataset_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity controls of every dataset, with both outcomes."""
    rows = A.controls(_datasets(spark, sf_dir))
    return rows.select(DOC, "code", "status", F.col("difference").cast("double").alias("difference"), F.size("affected").alias("n_affected"))


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each order whose identities hold, hold within the tolerance, fail, or cannot be tested, by its key."""
    k, t = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(20,4)")
    num = lambda x: (F.lit(x) if isinstance(x, (int, float)) else x).cast("decimal(20,4)")
    add = lambda test, x: F.when(test, num(x)).otherwise(num(0))
    half, tenth = F.floor(t / 2).cast("decimal(20,4)"), F.floor(t / 10).cast("decimal(20,4)")
    operating, financial, other = t - half + add(k % 3 == 0, 5000), num(2000) + add(k % 5 == 0, 50), tenth - 10 + add(k % 2 == 0, 2)
    current = operating + financial + add(k % 4 == 0, 9999) + num(0.5)
    before = current + other
    values = {
        "TOTAL_ACTIF": t, "TOTAL_PASSIF": F.when(k % 9 > 0, t + add(k % 8 == 0, 100)), "TOTAL_BILAN": t, "TRESORERIE_ACTIF": num(500), "TRESORERIE_PASSIF": F.when(k % 10 > 0, num(200)),
        "TRESORERIE_NETTE": F.when(k % 11 > 0, F.when(k % 13 == 0, num(777)).otherwise(num(300))), "PRODUITS_EXPLOITATION": t, "CHARGES_EXPLOITATION": half, "RESULTAT_EXPLOITATION": operating,
        "PRODUITS_FINANCIERS": num(3000), "CHARGES_FINANCIERES": num(1000), "RESULTAT_FINANCIER": financial, "RESULTAT_COURANT": current, "PRODUITS_NON_COURANTS": F.when(k % 7 > 0, tenth),
        "CHARGES_NON_COURANTES": num(10), "RESULTAT_NON_COURANT": other, "RESULTAT_AVANT_IMPOT": before, "IMPOT_SUR_RESULTATS": num(700), "RESULTAT_NET": before - 700 - add(k % 3 == 1, 1) - add(k % 17 == 0, 1000),
    }
    unsure = lambda c: F.when((F.col("k") % 6 == 0) & F.lit(c == "RESULTAT_AVANT_IMPOT"), "conflicting")
    field = lambda c, v: R.make(num(v), F.coalesce(unsure(c), F.when(v.isNull(), "missing").otherwise("confirmed"))).alias(c)
    amounts = _read(spark, sf_dir, "orders").select(k.alias("k"), *(num(v).alias(c) for c, v in values.items()))
    return amounts.select(F.col("k").cast("string").alias(DOC), F.array().cast("array<string>").alias("warnings"), *(field(c, F.col(c)) for c in values))


def control_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight identity controls: passed, failed, not testable, or no row where an input is absent or unsure."""
    rows = A.controls(_identities(spark, sf_dir))
    return rows.select(DOC, "code", "status", F.col("difference").cast("double").alias("difference"), F.col("tolerance").cast("double").alias("tolerance"))


def invalidated_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the failed controls of every order's dataset invalidate."""
    out = A.invalidate(A.with_controls(_identities(spark, sf_dir)))
    fields = sorted({f for rule in A.CONTROLS for f in rule[5]})
    lost = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f)["status"].alias("status"), F.size(F.col(f)["warnings"]).alias("n")) for f in fields)), lambda x: x["n"] > 0)
    return out.select(DOC, F.size("warnings").alias("n_warnings"), F.inline(lost)).select(DOC, "n_warnings", "field", "status")


def analysed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financial axis and provisional decision of every dataset after its controls."""
    out = A.analyse(_datasets(spark, sf_dir))
    return out.select(DOC, F.col("financial").cast("double").alias("financial"), F.col("final").cast("double").alias("final"), "risk_class", "decision", "blocking_status", F.size("blocking").alias("n_blocking"), F.size(F.filter("ratios", lambda r: r["value"].isNotNull())).alias("n_calculable"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: some begin a section, some are of a kind that none tells, every eleventh is empty."""
    t = F.col("turn")
    head = F.when(t % 5 == 1, "Bilan Actif\n").when(t % 5 == 3, "Compte de produits et charges\n").otherwise("")
    body = F.when(t % 11 == 10, "[PAGE VIDE]").otherwise(F.concat(head, F.lit("texte de page sans marque "), F.regexp_replace(F.col("text"), r"[^a-z ]", " ")))
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias(DOC), F.col("turn").alias("page_number"), F.lit("ok").alias("status"), body.alias("content"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page, carried on over pages that begin none."""
    return C.split_sections(_pages(spark, sf_dir)).groupBy(DOC, "page_number").agg(F.count("*").alias("n_parts"), F.max("section").alias("section"))


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts in chunks of at most 2,000 characters."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.lit("AUTRE").alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    out = C.chunk_sections(docs, 2000).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"))
    return out.select("doc_id", (F.col("n_chunks") >= 1).alias("any"), (F.col("chars") + F.col("n_chunks")).alias("chars_and_breaks"))


def _printed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order: its lines' amounts in reading order, under labels."""
    line = F.concat(F.lit("Poste "), F.col("l_linenumber").cast("string"), F.lit(" : "), printed(F.col("l_extendedprice").cast("decimal(20,4)")), F.lit(" MAD"))
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("r"), F.sum(F.col("l_extendedprice").cast("decimal(20,4)")).alias("total"))
    lines = F.array_join(F.transform("r", lambda x: x["line"]), "\n")
    far = F.lit("\n" + "." * 400 + "\n")
    text = F.concat(lines, far, F.lit("Chiffres d'affaires "), printed(F.col("total")), far, F.lit("Résultat net "), F.when(F.col("l_orderkey") % 2 == 0, printed(F.col("total") - 1)).otherwise(F.lit("néant")))
    return rows.select(F.col("l_orderkey").alias(DOC), text.alias("text"))


def amounts_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts found in every order's text, in both forms, and their sum."""
    df = _printed_orders(spark, sf_dir).select(DOC, P.amounts_in(F.col("text")).alias("a"), P.amounts_in(F.col("text"), "grouped").alias("b"))
    total = F.aggregate(F.transform("a", lambda x: F.translate(x, ", ", ".").cast("decimal(20,4)")), F.lit(0).cast("decimal(24,4)"), lambda s, x: (s + x).cast("decimal(24,4)"))
    return df.select(DOC, F.size("a").alias("n_cents"), F.size("b").alias("n_grouped"), total.cast("double").alias("total"))


def native_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts near labels of every order's text."""
    found = N.native_observations(_printed_orders(spark, sf_dir))
    return found.select(DOC, "code", "section", F.col("parsed_value").cast("double").alias("value"))


def keyword_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.keyword_amounts(_printed_orders(spark, sf_dir)).select(DOC, "code", F.col("value").cast("double").alias("value"))


def fallback_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of every filing's text: of even borrowers near labels, of odd ones by the older search, whose labels the other does not know."""
    far, x = F.lit("\n" + "." * 600 + "\n"), lambda c: F.coalesce(printed(F.col(c)), F.lit("néant"))
    older = F.concat(F.lit("IMMOBILISATIONS CORPORELLES (C)\n"), x("ai"), far, F.lit("Bilan (passif)"), far, F.lit("Charges financières "), x("achats"))
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Résultat net de l'exercice "), x("tb"))).otherwise(older)
    return N.native_values(_filings(spark, sf_dir).select(DOC, text.alias("text"))).select(DOC, "code", F.col("value").cast("double").alias("value"), "source")


def signed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results after a keyword, losses with the sign that print uses."""
    rn = F.col("rn")
    amount = F.when(rn < 0, F.concat(F.lit("−"), printed(-rn))).otherwise(printed(rn))
    texts = _filings(spark, sf_dir).where("rn is not null").select(DOC, F.concat(F.lit("Texte libre. Résultat net de l'exercice : "), amount, F.lit(" MAD")).alias("text"))
    return N.keyword_amounts(texts).select(DOC, "code", F.col("value").cast("double").alias("value"))


def recovered_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debts that a page shows as empty: no amount up to the next section, or in the 400 characters after the heading if none follows."""
    k = F.col("k")
    amount = F.when(k % 5 == 0, "12,345").otherwise("1 000,00")
    text = F.concat(F.lit("Bilan passif de l'exercice clos. DETTES DE FINANCEMENT (C) "), F.repeat(F.lit("x"), (k * 7 % 800).cast("int")), F.lit(" "), amount, F.when(k % 3 == 0, " PROVISIONS DURABLES").otherwise(" fin"))
    st = _filings(spark, sf_dir)
    none = st.where("false").select(DOC, F.lit(1).cast("long").alias("ordinal"), F.lit("").alias("field_code"), F.lit("").alias("raw_value"), F.lit(1).alias("page_number"))
    out = N.recover(none, st.select(DOC, F.lit(1).alias("page_number"), F.lit("BILAN_PASSIF").alias("page_type"), text.alias("text")))
    return out.select(DOC, "field_code", "raw_value", "confidence")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _filings(spark, sf_dir)
    line = lambda n, label, x, source: F.concat(F.lit(f"{n} {label} "), printed(F.coalesce(x, F.lit(0).cast("decimal(20,4)"))), F.lit(f" MAD {source}"))
    zero = F.lit(0).cast("decimal(20,4)")
    lines = [F.lit("Rapport des Éléments Financiers"), line(3, "Chiffre d'affaires", F.col("ca"), "CPC"), line(2, "Total du bilan", F.col("tb"), "Bilan Actif"), line(10, "Trésorerie au passif", F.when(F.col("k") % 3 == 0, zero).otherwise(F.col("tp")), "Bilan Passif")]
    lines += [F.lit("Éléments Bruts de Calcul"), F.concat(F.lit("| Stocks | "), printed(F.col("tb")), F.lit(" MAD | Bilan Actif | x |")), F.concat(F.lit("Achats "), printed(F.coalesce("ca", zero)), F.lit(" MAD CPC y")), F.lit("Achats 1,00 MAD CPC z")]
    return st.select(DOC, F.concat_ws("\n", *lines).alias("text"))


def report_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of indicator reports; sections without any amount lose theirs."""
    texts = _reports(spark, sf_dir)
    judged = N.assess_sections(N.report_lines(texts), N.report_components(texts))
    return judged.select(DOC, "number", "code", F.col("value").cast("double").alias("value"), "confidence")


def recovered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the candidates that page text fills, by field."""
    st = _filings(spark, sf_dir)
    cands = _candidates(spark, sf_dir).where(~((F.col("field_code") == "CHIFFRE_AFFAIRES") & F.col(DOC).endswith("7")))
    text = F.concat(F.lit("Compte de produits et charges\nChiffres d affaires "), F.coalesce(printed(F.col("ca")), F.lit("néant")), F.lit("\n"), F.lit("Achats revendus de marchandises "), F.coalesce(printed(F.col("achats")), F.lit("-")))
    pages = st.select(DOC, F.lit(4).alias("page_number"), F.lit("CPC").alias("page_type"), text.alias("text"))
    extra = N.recover(cands, pages).where(F.array_contains("warnings", "from_native_text"))
    return extra.select(DOC, "field_code", F.translate("raw_value", ", ", ".").cast("double").alias("value"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of JSON replies, one reply an order: fenced, single or listed."""
    lines = _read(spark, sf_dir, "lineitem")
    item = F.struct(F.when(F.col("l_linenumber") == 1, "ca").otherwise("STOCKS").alias("field_code"), F.col("l_quantity").cast("string").alias("value"), F.when(F.col("l_returnflag") == "A", "N-1").otherwise("N").alias("period"), F.lit(0.5).alias("confidence"))
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("c"))
    form = F.col("l_orderkey") % 3
    body = F.to_json(F.struct(F.col("c").alias("candidates")))
    reply = F.when(form == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(form == 1, F.to_json("c")).otherwise(F.concat(F.lit("Voici : "), body))
    replies = grouped.select(F.col("l_orderkey").alias(DOC), F.lit(1).alias("page_number"), F.lit("CPC").alias("page_type"), reply.alias("reply"))
    out = V.coerce_candidates(replies).where(V.valid_candidate())
    return out.groupBy(DOC).agg(F.count("*").alias("n"), F.count_if(F.col("field_code") == "CHIFFRE_AFFAIRES").alias("n_revenue"), F.count_if(F.col("period") == "N_MINUS_1").alias("n_before"), F.sum(F.col("raw_value").cast("double")).alias("total"))


def page_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that stays for each order: the first that reads a known code ends the row."""
    lines = _read(spark, sf_dir, "lineitem")
    codes = F.slice(F.array(*(F.lit(c) for c in ("A", "B", "C"))), F.lit(1), (F.col("l_linenumber") % 3 + 1).cast("int"))
    known = F.when(F.col("l_returnflag") == "A", F.array_append(codes, "CAF")).otherwise(codes)
    rows = lines.select(F.col("l_orderkey").alias(DOC), F.lit(1).alias("page_number"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("attempt"), F.lit("ESG").alias("page_type"), known.alias("codes"), F.col("l_quantity").cast("long").alias("latency_ms"))
    return V.best_attempt(rows).select(DOC, "attempt", "meaningful", "latency_ms", "n_attempts")


def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the pages of every conversation, and those beyond its fifth."""
    turns = _read(spark, sf_dir, "conversations")
    length = F.when(F.col("turn") % 4 != 3, F.length("text")).otherwise(0)
    stats = turns.select(F.col("conv_id").alias(DOC), F.col("turn").alias("page_number"), length.alias("text_length"), (F.col("turn") % 8 == 7).alias("is_blank"), F.when(F.col("role") == "user", 90).otherwise(0).alias("declared_rotation"))
    counts = audit.inspect_pages(stats).select(DOC, "n_pages", "n_native", "n_scanned", F.size("blank_pages").alias("n_blank"), F.size("rotated_pages").alias("n_rotated"))
    kept = audit.limit_pages(stats, 5).groupBy(DOC).agg(F.count("*").alias("n_kept"), F.max("truncated").alias("truncated"))
    return counts.join(kept, DOC, "left")


def card_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-empty comment and mode of an order's lines, and the first turn of it that shows one."""
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(DOC), "l_linenumber", (F.col("l_linenumber").cast("long") * 10**15 + F.col("l_partkey").cast("long") * 10**9 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("side"), F.when(F.col("l_returnflag") == "N", F.col("l_suppkey").cast("string")).otherwise(" ").alias("mode"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("flag"))
    first = audit.first_filled(lines, [DOC], "side", ["mode", "flag"])
    turns = lines.where("l_linenumber <= 4").groupBy(DOC, "l_linenumber").agg(F.max("mode").alias("mode"), F.max("flag").alias("flag")).withColumn("rotation", ((F.col("l_linenumber") - 1) * 90).cast("int"))
    best = audit.best_rotation(turns, ["mode", "flag"]).select(DOC, "rotation", "n_filled", "warning")
    return first.join(best, DOC, "left")


def folded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text, folded in three ways, and how many words the folds share with the text before."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    strict, loose = fold(F.col("line"), "strict"), fold(F.col("line"), "loose")
    out = lines.select("doc_id", F.length(strict).alias("s"), F.length(loose).alias("l"), (token_overlap(strict, strict) == 1).cast("int").alias("same"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("s").alias("strict"), F.sum("l").alias("loose"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_with_words"))


def column_natures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of payload columns and labels, by what they are taken for."""
    heads = F.array(*map(F.lit, ["Brut", "Amortissements et provisions", "Net exercice N", "Net exercice N-1", "Exercice précédent", TOTAL, "Total exercice (N)", "zzz", ""]))
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.element_at(heads, (F.col("p_partkey") % 9 + 1).cast("int")).alias("h"), F.when(F.col("p_partkey") % 2 == 0, "TOTAL GENERAL I+II+III").otherwise("TOTAL I").alias("t"))
    return parts.groupBy(column_nature(F.col("h")).alias("nature"), is_grand_total(F.col("t")).alias("grand")).agg(F.count("*").alias("n"))


def overridden_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions scored with given values: financial debts of every second borrower are given, documents with gaps are blocked."""
    st = _filings(spark, sf_dir).select(DOC, "k", *("ca", "fp", "tb", "df", "rn", "caf", "clients", "fourn", "achats", "fdr", "tn"))
    every = F.map_from_arrays(F.array(*map(F.lit, ("BILAN_ACTIF", "BILAN_PASSIF", "CPC"))), F.array(F.lit(True), F.lit(True), F.col("k") % 9 != 0))
    cases = st.withColumns({"completeness": F.when(F.col("k") % 10 == 0, 40.0).otherwise(90.0), "sections": every, "states": F.create_map().cast("map<string,string>"), "failed": F.col("k") % 50 == 0, "admitted": F.lit(True), "why_not": F.lit(None).cast("string")})
    given = st.where("k % 2 = 0").select(DOC, F.lit(1000).cast("decimal(20,4)").alias("df"), F.lit(2000).cast("decimal(20,4)").alias("fdr"))
    out = E.extract_and_score(cases.drop("k"), [DOC], given)
    return out.select(DOC, (F.col("block_reason").isNotNull()).alias("blocked"), F.col("axis1").isNull().alias("no_axis"))


def lot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document of a lot, extracted or failed, numbered."""
    st = _filings(spark, sf_dir)
    done = st.where("ca is not null").select(DOC, F.col("tb").cast("double").alias("total"), F.transform(F.sequence(F.lit(1), (F.col("k") % 12 + 1).cast("int")), lambda i: i.cast("string")).alias("warnings"))
    lost = st.where("ca is null").select(DOC, F.lit("no lines").alias("error"))
    rows = D.batch_summary(done, lost, "lot")
    return reports.index_sheet(rows, [DOC]).select(DOC, F.col("n").cast("long").alias("n"), F.coalesce(F.size("warnings"), F.lit(0)).alias("n_warnings"), "error", "run_id")


def axes_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = S.engine_axes(W.with_previous(_filings(spark, sf_dir), "k", "y", "ca", "ca_n1"), [DOC]).withColumn("axis2", F.lit(None).cast("double"))
    return reports.axes_rows(axes, [DOC], reports.LEGACY_AXES)


def ratio_sheet_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine ratios with labels, units and the inputs that they lack, counted."""
    rows = E.ratio_details(W.with_previous(_filings(spark, sf_dir), "k", "y", "ca", "ca_n1"), [DOC])
    return rows.groupBy("code", "status", "unit").agg(F.count("*").alias("n"), F.count("reason").alias("n_reasons"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step, share and state of every user's job, from its events until it expires."""
    kind = F.col("event_type")
    event = F.when(kind == "view", "page_extracted").when(kind == "click", "page_skipped").when(kind == "error", "page_failed").otherwise("running_controls")
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", event.alias("event"), F.when(kind != "purchase", (F.col("event_id") % 10).cast("int")).alias("page"), F.lit("CPC").alias("page_type"), F.lit(None).cast("int").alias("count"), F.lit(None).cast("string").alias("error"))
    state = jobs.job_state(events).select("job_id", "state", "n_financial", "n_skipped", "n_failed")
    alive = jobs.expire(events, 24 * 3600).groupBy("job_id").agg(F.count("*").alias("n_alive"))
    return state.join(alive, "job_id")


def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: empty, too large, of a wrong type or beginning, or admitted."""
    pages = _read(spark, sf_dir, "pages")
    content = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    files = pages.select("page_id", F.octet_length(content).cast("long").alias("length"), content.alias("content"), F.when(F.col("page_id") % 3 == 0, "text/plain").otherwise("Text/HTML; charset=utf-8").alias("content_type"))
    return D.admit(files, magic="<!DO", most_bytes=3000, content_types=("text/html",)).select("page_id", "reason")


def financial_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems printed as a table an order, read back with section, label and named columns."""
    rows = dealt(_read(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", F.format_string("| Poste %d | %s |  | %s |", F.col("l_linenumber").cast("int"), "l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("line"))
    body = F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "line")))["line"], "\n")
    o = F.col("l_orderkey") % 3
    head = F.when(o == 0, "Bilan - Actif").when(o == 1, "Compte de produits et charges").otherwise("Autre page")
    pages = rows.groupBy("l_orderkey").agg(body.alias("b")).select(F.col("l_orderkey").alias(DOC), F.lit(1).alias("page_number"), F.lit("ok").alias("status"), F.concat(head, F.lit("\n| Poste | Brut | Vide | Net |\n|---|:--|---|---|\n"), F.col("b"), F.lit("\nfin")).alias("content"))
    out = T.financial_rows(pages)
    return out.select(DOC, "section", "normalized_label", F.element_at("values", F.lit("brut")).alias("brut"), F.element_at("values", F.lit("net_n")).cast("int").alias("net"), F.element_at("values", F.lit("vide")).isNull().alias("vide"))


QUERIES = [
    financial_table_rows, payload_cells, observed_fields, extraction_results, resolved_candidates, value_provenance, candidate_reasons, mapping_audits, dataset_controls, analysed_cases, page_sections, section_chunks, amounts_in_text, native_amounts,
    keyword_values, report_elements, recovered_candidates, model_replies, page_attempts, page_counters, card_sides, folded_labels, column_natures, overridden_scores, lot_summary, axes_sheet, ratio_sheet_details,
    job_states, upload_admission, control_outcomes, invalidated_datasets, fallback_amounts, signed_keywords, recovered_zeros,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql(axes: str, weighted: str, grid: Callable[[str], str]) -> dict[str, str]:
    """``axes`` and ``weighted`` are the CTEs of the engine axes and the weighted ratios; ``grid`` the classes of a score."""
    p = lambda x: f"round({x}, 2)"
    f = f"{ST_SQL}, f AS (SELECT *, k || '-' || y document_id, CASE WHEN k % 2 = 0 THEN 100 ELSE 50 END bank FROM st)"
    num = lambda x: f"CAST({x} AS DOUBLE)"
    lines = lambda section, nature, method, *cells: " UNION ALL ".join(f"SELECT '{section}' section, '{nature}' value_nature, '{method}' AS method, CAST({x} AS DECIMAL(20,4)) v, {e} e FROM f WHERE {w}" for x, e, w in cells)
    cell = lambda x, w="true": (p(x), "false", w)
    cells = [
        lines("BILAN_ACTIF", "brut", "payload", cell("tb * 2")), lines("BILAN_ACTIF", "net_n", "payload", cell("tb"), cell("clients"), cell("ta")), lines("BILAN_PASSIF", "net_n", "payload", cell("fp"), cell("df"), cell("tp"), cell("bank")),
        lines("CPC", "total_exercice", "payload", cell("ca"), cell("rn"), cell("am"), cell("1.00", "k % 3 = 0")), lines("CPC", "unknown", "payload", ("NULL", "true", "k % 4 = 0")), lines("IDENTIFICATION", "unknown", "metadata", ("NULL", "false", "true"), ("NULL", "false", "true")),
    ]
    cash = f"coalesce({p('ta')}, {p('tp')}) - (coalesce({p('tp')}, 0) + bank)"
    ct = f"(coalesce({p('tp')}, 0) + bank)"
    field = lambda code, x, status, usable: f"SELECT document_id, '{code}' code, {num(x)} AS value, {status} AS status, {usable} usable FROM f"
    plain = lambda code, x: field(code, p(x), f"CASE WHEN {x} IS NULL THEN 'not_detected' ELSE 'detected' END", f"{x} IS NOT NULL")
    fields = [
        plain("TOTAL_BILAN", "tb"), field("CHIFFRE_AFFAIRES", f"coalesce({p('ca')}, CASE WHEN k % 3 = 0 THEN 1 END)", "CASE WHEN k % 3 = 0 AND ca IS NOT NULL THEN 'ambiguous' WHEN k % 3 = 0 OR ca IS NOT NULL THEN 'detected' ELSE 'not_detected' END", "CASE WHEN k % 3 = 0 THEN ca IS NULL ELSE ca IS NOT NULL END"),
        field("CA_EXPORT", "CASE WHEN k % 4 = 0 THEN 0 END", "CASE WHEN k % 4 = 0 THEN 'detected_zero' ELSE 'not_detected' END", "k % 4 = 0"), plain("CREANCES_CLIENTS", "clients"), plain("FONDS_PROPRES", "fp"), plain("DETTES_BANCAIRES_MLT", "df"),
        field("DETTES_BANCAIRES_CT", ct, "'derived'", "true"), field("DETTES_FINANCIERES", f"{p('df')} + {ct}", "CASE WHEN df IS NULL THEN 'incomplete' ELSE 'derived' END", "df IS NOT NULL"), field("TRESORERIE_PASSIF", ct, "'derived'", "true"),
        field("TRESORERIE_NETTE", cash, f"CASE WHEN ({cash}) IS NULL THEN 'absent' ELSE 'derived' END", f"({cash}) IS NOT NULL"), plain("RESULTAT_NET", "rn"), field("CAF", "NULL", "CASE WHEN rn IS NULL THEN 'not_detected' ELSE 'estimated' END", "false"),
    ]
    n = lambda *tests: " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests)
    both = "achats IS NOT NULL AND fourn IS NOT NULL"
    given = {
        "TOTAL_ACTIF": "2", "TOTAL_PASSIF": "CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END", "FONDS_PROPRES": "1", "DETTES_FINANCIERES": "CASE WHEN df IS NULL THEN 0 ELSE 2 END", "CHIFFRE_AFFAIRES": "CASE WHEN ca IS NULL THEN 0 ELSE 2 END",
        "RESULTAT_NET_XIII": n("rn IS NOT NULL"), "RESULTAT_NET_XVI": n("rn IS NOT NULL"), "RESULTAT_NET": n("rn IS NOT NULL AND k % 7 = 0"), "CLIENTS": n("clients IS NOT NULL", "clients IS NOT NULL AND k % 6 = 0"), "TRESORERIE_ACTIF": n("ta IS NOT NULL"),
        "TRESORERIE_PASSIF": n("tp IS NOT NULL"), "PRODUITS_FINANCIERS": n("achats IS NOT NULL"), "CHARGES_FINANCIERES": n("fourn IS NOT NULL"), "RESULTAT_FINANCIER": n(both),
    }
    refused = {"TOTAL_ACTIF": ("not_the_grand_total", "1"), "CHIFFRE_AFFAIRES": ("not_revenue", n("ca IS NOT NULL"))}
    reasons = [f"SELECT '{c}' field_code, '' reasons, true ok, ({g}) - ({refused[c][1] if c in refused else 0}) x FROM f" for c, g in given.items()] + [f"SELECT '{c}', '{r}', false, {x} FROM f" for c, (r, x) in refused.items()]
    pick = lambda code, x, status: f"SELECT document_id, '{code}' code, {num(x)} AS value, {status} AS status FROM f"
    told = lambda x, status="'confirmed'": f"CASE WHEN ({x}) IS NULL THEN 'missing' ELSE {status} END"
    net = f"{p('ta')} - {p('tp')}"
    picks = [
        pick("TOTAL_ACTIF", p("tb"), "'confirmed'"), pick("TOTAL_BILAN", f"CASE WHEN k % 5 <> 0 THEN {p('tb')} END", "CASE k % 5 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'derived' ELSE 'confirmed' END"), pick("FONDS_PROPRES", p("fp"), "'confirmed'"), pick("DETTES_FINANCIERES", p("df"), told("df")),
        pick("CHIFFRE_AFFAIRES", p("ca"), told("ca")), pick("RESULTAT_NET", p("rn"), told("rn")), pick("CLIENTS", f"CASE WHEN k % 6 <> 0 THEN {p('clients')} END", told("clients", "CASE WHEN k % 6 = 0 THEN 'conflicting' ELSE 'confirmed' END")), pick("TRESORERIE_NETTE", net, told(net, "'derived'")),
        pick("RESULTAT_FINANCIER", "achats - fourn + 1", told("achats - fourn")), pick("ENCOURS_LEASING", "NULL", "'missing'"),
    ]
    assets, equity, income = "2, 'BILAN_ACTIF', 'NET_N'", "3, 'BILAN_PASSIF', 'EXERCICE_N'", "5, 'CPC', 'TOTAL_EXERCICE_N'"
    behind = lambda code, status, where, label, x, when, source=0, place=1: (
        f"SELECT document_id, '{code}' code, {status} AS status, {source} source, {place} place, {where}, '{label}', {num(x)} FROM f WHERE ({x}) IS NOT NULL AND {when}"
    )
    read = "'confirmed'"
    sheet = "CASE k % 5 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'derived' ELSE 'confirmed' END"
    other = f"{p('tb')} + CASE WHEN k % 5 = 0 THEN 50000 ELSE 0 END"
    sources = [
        behind("TOTAL_ACTIF", read, assets, "TOTAL GENERAL I+II+III", p("tb"), "true"), behind("TOTAL_PASSIF", read, equity, "TOTAL I+II+III", other, "k % 5 <> 1"),
        behind("TOTAL_BILAN", sheet, assets, "TOTAL GENERAL I+II+III", p("tb"), "true"), behind("TOTAL_BILAN", sheet, equity, "TOTAL I+II+III", other, "k % 5 <> 1", 1),
        behind("FONDS_PROPRES", read, equity, "TOTAL DES CAPITAUX PROPRES", p("fp"), "true"), behind("DETTES_FINANCIERES", read, equity, "TOTAL DES DETTES DE FINANCEMENT", p("df"), "true"),
        behind("CHIFFRE_AFFAIRES", read, income.replace("5", "4", 1), "Chiffre d''affaires", p("ca"), "true"), behind("RESULTAT_NET", read, income, "XIII Résultat net", p("rn"), "k % 7 <> 0"),
        behind("RESULTAT_NET", read, income, "XVI Résultat net", p("rn"), "k % 7 <> 0", 1), behind("RESULTAT_NET", read, equity, "Résultat net de l''exercice", p("rn"), "k % 7 = 0"),
        behind("CLIENTS", "CASE WHEN k % 6 = 0 THEN 'conflicting' ELSE 'confirmed' END", assets, "Clients et comptes rattachés", p("clients"), "true"), behind("CLIENTS", "'conflicting'", assets, "Clients et comptes rattachés", f"{p('clients')} + 10", "k % 6 = 0", place=2),
        behind("TRESORERIE_ACTIF", read, assets, "TOTAL TRESORERIE-ACTIF", p("ta"), "true"), behind("TRESORERIE_PASSIF", read, equity, "Trésorerie-Passif", p("tp"), "true"),
        behind("TRESORERIE_NETTE", "'derived'", assets, "TOTAL TRESORERIE-ACTIF", p("ta"), "tp IS NOT NULL"), behind("TRESORERIE_NETTE", "'derived'", equity, "Trésorerie-Passif", p("tp"), "ta IS NOT NULL", 1),
        behind("PRODUITS_FINANCIERS", read, income, "Produits financiers", p("achats"), "true"), behind("CHARGES_FINANCIERES", read, income, "Charges financières", p("fourn"), "true"),
        behind("RESULTAT_FINANCIER", read, income, "Résultat financier", p("achats - fourn + 1"), "true"),
    ]
    folded = lambda keep: f"trim(regexp_replace({keep}, '\\s+', ' ', 'g'))"
    strict, loose = folded("regexp_replace(lower(strip_accents(l)), '[^a-z0-9]', ' ', 'g')"), folded("lower(strip_accents(l))")
    inputs = {"ca": "ca", "fp": "fp", "tb": "tb", "df": "df", "rn": "rn", "caf": "caf", "fdr": "fdr", "tn": "tn", "clients": "clients", "fourn": "fourn", "achats": "achats", "ca_n1": "n1", "leasing": "ta", "cmt": "tp", "operation": "clients"}
    lacking = " ".join(f"WHEN '{c}' THEN {' OR '.join(f'{inputs[i]} IS NULL' for i in needs)}" for c, needs in zip(E.ENGINE, E.INPUTS, strict=True))
    units = " ".join(f"WHEN '{c}' THEN '{m[3]}'" for c, m in zip(E.ENGINE, E.METADATA, strict=True))
    order = "o AS (SELECT l_orderkey document_id, sum(CAST(l_extendedprice AS DECIMAL(20,4))) total, count(*) n FROM lineitem GROUP BY 1)"
    sides = "t AS (SELECT l_orderkey document_id, l_linenumber ln, CAST(l_linenumber AS BIGINT) * 1000000000000000 + CAST(l_partkey AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) side, CASE WHEN l_returnflag = 'N' THEN CAST(l_suppkey AS VARCHAR) ELSE ' ' END m, CASE WHEN l_linestatus = 'F' THEN l_returnflag END fl FROM lineitem)"
    d = lambda x: f"CAST({x} AS DECIMAL(20,4))"
    identities = f"""h AS (SELECT o_orderkey k, {d('o_totalprice')} t, {d('floor(' + d('o_totalprice') + ' / 2)')} half, {d('floor(' + d('o_totalprice') + ' / 10)')} tenth FROM orders),
      g AS (SELECT *, t - half + CASE WHEN k % 3 = 0 THEN 5000 ELSE 0 END op, CASE WHEN k % 5 = 0 THEN 2050 ELSE 2000 END fi, tenth - 10 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END oth FROM h),
      i AS (SELECT k::VARCHAR document_id, *, {d("op + fi + 0.5::DECIMAL(4,1) + CASE WHEN k % 4 = 0 THEN 9999 ELSE 0 END")} cur, k % 6 = 0 unsure, CASE WHEN k % 9 > 0 THEN t + CASE WHEN k % 8 = 0 THEN 100 ELSE 0 END END tpas,
        CASE WHEN k % 10 > 0 THEN 200 END tp, CASE WHEN k % 11 > 0 THEN CASE WHEN k % 13 = 0 THEN 777 ELSE 300 END END tnet, CASE WHEN k % 7 > 0 THEN tenth END pnc FROM g)"""
    tested = lambda code, e, o, names, when: f"SELECT document_id, '{code}' code, CASE WHEN abs({d(o)} - {d(e)}) <= greatest(1, abs({d(e)}) * 0.0001) THEN 'passed' ELSE 'failed' END AS status, {d(e)} e, {d(o)} o, {names} affected FROM i WHERE {when}"
    empty = lambda code, e, names, when: f"SELECT document_id, '{code}', 'not_testable', {d(e)}, NULL, {names} FROM i WHERE {when}"
    names = lambda *xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    tax = "cur + oth - 700 - CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END - CASE WHEN k % 17 = 0 THEN 1000 ELSE 0 END"
    outcomes = "r AS (" + " UNION ALL ".join([
        tested("bilan_equilibre", "t", "tpas", names("TOTAL_ACTIF", "TOTAL_PASSIF", "TOTAL_BILAN"), "tpas IS NOT NULL"), empty("bilan_equilibre", "NULL", names("TOTAL_BILAN"), "tpas IS NULL"),
        tested("tresorerie_nette", "300", "tnet", names("TRESORERIE_ACTIF", "TRESORERIE_PASSIF", "TRESORERIE_NETTE"), "tp IS NOT NULL AND tnet IS NOT NULL"), empty("tresorerie_nette", "300", names("TRESORERIE_ACTIF", "TRESORERIE_PASSIF"), "tp IS NOT NULL AND tnet IS NULL"),
        tested("resultat_exploitation", "t - half", "op", names("PRODUITS_EXPLOITATION", "CHARGES_EXPLOITATION", "RESULTAT_EXPLOITATION"), "true"), tested("resultat_financier", "2000", "fi", names("PRODUITS_FINANCIERS", "CHARGES_FINANCIERES", "RESULTAT_FINANCIER"), "true"),
        tested("resultat_courant", "op + fi", "cur", names("RESULTAT_EXPLOITATION", "RESULTAT_FINANCIER", "RESULTAT_COURANT"), "true"), tested("resultat_non_courant", "pnc - 10", "oth", names("PRODUITS_NON_COURANTS", "CHARGES_NON_COURANTES", "RESULTAT_NON_COURANT"), "pnc IS NOT NULL"),
        tested("resultat_avant_impot", "cur + oth", "cur + oth", names("RESULTAT_COURANT", "RESULTAT_NON_COURANT", "RESULTAT_AVANT_IMPOT"), "NOT unsure"), tested("resultat_net", "cur + oth - 700", tax, names("RESULTAT_AVANT_IMPOT", "IMPOT_SUR_RESULTATS", "RESULTAT_NET"), "NOT unsure"),
    ]) + ")"
    return {
        "financial_table_rows": "SELECT l_orderkey document_id, CASE l_orderkey % 3 WHEN 0 THEN 'BILAN_ACTIF' WHEN 1 THEN 'CPC' ELSE 'AUTRE' END section, 'poste ' || CAST(l_linenumber AS INTEGER) normalized_label, l_returnflag brut, CAST(trunc(l_quantity) AS INTEGER) net, true AS vide FROM lineitem",
        "payload_cells": f"WITH {f}, c AS ({' UNION ALL '.join(cells)}) SELECT section, value_nature, method, count(*) n, count(v) n_amounts, count(*) FILTER (e) n_empty, round(CAST(sum(v) AS DOUBLE), 2) total FROM c GROUP BY 1, 2, 3",
        "observed_fields": f"WITH {f} {' UNION ALL '.join(fields)}",
        "extraction_results": f"""WITH {f} SELECT document_id, round(100.0::DOUBLE * ({n("tb IS NOT NULL", "CASE WHEN k % 3 = 0 THEN ca IS NULL ELSE ca IS NOT NULL END", "df IS NOT NULL", "clients IS NOT NULL", "clients IS NOT NULL", "ta IS NOT NULL OR tp IS NOT NULL", "rn IS NOT NULL", "rn IS NOT NULL", "fp IS NOT NULL", "am IS NOT NULL")} + 2) / 18, 1) completeness,
          {n("tb IS NOT NULL", "ca IS NOT NULL OR k % 3 = 0", "k % 4 = 0", "df IS NOT NULL", "clients IS NOT NULL", "clients IS NOT NULL", "ta IS NOT NULL OR tp IS NOT NULL", "am IS NOT NULL", "rn IS NOT NULL")} + 2 n_elements,
          CASE WHEN {p("rn")} > 0 THEN 'Bénéficiaire' WHEN {p("rn")} < 0 THEN 'Déficitaire' WHEN rn IS NOT NULL THEN 'Nul' END sign, {n("ta IS NOT NULL OR tp IS NOT NULL", "df IS NOT NULL", "tp IS NOT NULL")} n_passed,
          1 + {n("ta IS NULL AND tp IS NULL", "df IS NULL", "tp IS NULL", "rn IS NOT NULL")} n_untested, 3 n_sections, {num(p("rn"))} scored_result, document_id reference, CAST(y AS VARCHAR) exercice FROM f""",
        "resolved_candidates": f"WITH {f} {' UNION ALL '.join(picks)}",
        "value_provenance": f"WITH {f}, s(document_id, code, status, source, place, page_number, section, column_role, raw_label, amount) AS ({' UNION ALL '.join(sources)}) SELECT * FROM s",
        "candidate_reasons": f"WITH {f}, r AS ({' UNION ALL '.join(reasons)}) SELECT field_code, reasons, ok, CAST(sum(x) AS BIGINT) n FROM r GROUP BY 1, 2, 3 HAVING sum(x) > 0",
        "mapping_audits": f"""WITH {f}, g AS (SELECT document_id, {' + '.join(f'({g})' for g in given.values())} candidates_total, {n(*(f'({g}) > 0' for g in given.values()))} n_fields, CASE WHEN k % 6 = 0 AND clients IS NOT NULL THEN 'CLIENTS' END a, CASE WHEN k % 5 = 0 THEN 'TOTAL_BILAN' END b FROM f)
        SELECT document_id, candidates_total, n_fields, {n("a IS NOT NULL", "b IS NOT NULL")} n_conflicting, concat_ws(',', a, b) conflicting FROM g""",
        "dataset_controls": f"""WITH {f} SELECT document_id, 'bilan_equilibre' code, 'passed' AS status, 0.0::DOUBLE difference, 3 n_affected FROM f UNION ALL SELECT document_id, 'tresorerie_nette', 'passed', 0.0, 3 FROM f WHERE tn IS NOT NULL
        UNION ALL SELECT document_id, 'resultat_financier', CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'passed' END, CASE WHEN k % 4 = 0 THEN 1000.0 ELSE 0.0 END, 3 FROM f WHERE {both}""",
        "analysed_cases": f"""{weighted}, fa AS (SELECT k, y, round(sum(points) / sum(weight) * 100, 2) financial, count(value) n,
          count(*) FILTER (status = 'non_calculable' AND code IN ('financial_autonomy', 'debt_ratio', 'repayment_capacity', 'caf_margin')) nc FROM w GROUP BY k, y),
        b AS (SELECT st.k || '-' || st.y document_id, financial, n n_calculable, {n("ca IS NULL", "rn IS NULL", "nc > 0")} + CASE WHEN st.k % 4 = 0 AND {both} THEN 3 ELSE 0 END bad FROM fa JOIN st ON fa.k = st.k AND fa.y = st.y)
        SELECT document_id, CASE WHEN bad > 0 THEN 0.0 ELSE financial END financial, CASE WHEN bad = 0 THEN financial END final, CASE WHEN bad > 0 THEN 'NON_EVALUABLE' ELSE {grid("financial")} END risk_class,
          CASE WHEN bad > 0 THEN 'Revue manuelle' ELSE 'Revue manuelle (score financier provisoire)' END decision, CASE WHEN bad > 0 THEN 'INSUFFICIENT_DATA' ELSE 'PARTIAL_DATA' END blocking_status, CASE WHEN bad > 0 THEN bad + 1 ELSE 0 END n_blocking, n_calculable FROM b""",
        "page_sections": """SELECT conv_id document_id, turn page_number, CAST(1 AS BIGINT) n_parts, coalesce(last_value(CASE turn % 5 WHEN 1 THEN 'BILAN_ACTIF' WHEN 3 THEN 'CPC' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'AUTRE') section
          FROM conversations WHERE text IS NOT NULL AND turn % 11 <> 10""",
        "section_chunks": "SELECT doc_id, true AS any, length(coalesce(text, '')) + 1 chars_and_breaks FROM documents",
        "amounts_in_text": f"WITH {order} SELECT document_id, n + 1 + {n('document_id % 2 = 0')} n_cents, n + 1 + {n('document_id % 2 = 0')} n_grouped, CAST(total * 2 + CASE WHEN document_id % 2 = 0 THEN total - 1 ELSE 0 END AS DOUBLE) total FROM o",
        "native_amounts": f"WITH {order} SELECT document_id, 'CHIFFRE_AFFAIRES' code, 'CPC' section, {num('total')} AS value FROM o UNION ALL SELECT document_id, 'CA_N1', 'CPC', {num('total')} FROM o UNION ALL SELECT document_id, 'RESULTAT_NET', 'CPC', {num('total - 1')} FROM o WHERE document_id % 2 = 0",
        "keyword_values": f"WITH {order} SELECT document_id, 'CHIFFRE_AFFAIRES' code, {num('total')} AS value FROM o UNION ALL SELECT document_id, 'RESULTAT_NET', {num('total - 1')} FROM o WHERE document_id % 2 = 0",
        "report_elements": f"""WITH {f} SELECT document_id, 3 number, 'CHIFFRE_AFFAIRES' code, {num(f"nullif({p('ca')}, 0)")} AS value, CASE WHEN {p('ca')} <> 0 THEN 0.9::DOUBLE ELSE 0 END confidence FROM f UNION ALL SELECT document_id, 2, 'TOTAL_BILAN', {num(p('tb'))}, 0.9 FROM f
        UNION ALL SELECT document_id, 10, 'TRESORERIE_PASSIF', {num(f"CASE WHEN k % 3 <> 0 THEN nullif({p('tp')}, 0) END")}, CASE WHEN k % 3 <> 0 AND {p('tp')} <> 0 THEN 0.9 ELSE 0 END FROM f""",
        "recovered_candidates": f"WITH {f} SELECT document_id, 'ACHATS_REVENDUS' field_code, {num(p('achats'))} AS value FROM f WHERE achats IS NOT NULL UNION ALL SELECT document_id, 'CHIFFRE_AFFAIRES', {num(p('ca'))} FROM f WHERE ca IS NOT NULL AND document_id LIKE '%7'",
        "model_replies": "SELECT l_orderkey document_id, count(*) n, count(*) FILTER (l_linenumber = 1) n_revenue, count(*) FILTER (l_returnflag = 'A') n_before, CAST(sum(l_quantity) AS DOUBLE) total FROM lineitem GROUP BY 1",
        "page_attempts": """WITH a AS (SELECT l_orderkey document_id, l_linenumber * 10000000 + l_partkey attempt, l_returnflag = 'A' good, l_linenumber % 3 + 1 + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END s, CAST(l_quantity AS BIGINT) q FROM lineitem),
        b AS (SELECT *, coalesce(bool_or(good) OVER (PARTITION BY document_id ORDER BY attempt, good, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) done FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s DESC, good DESC, attempt) r,
          sum(q) OVER (PARTITION BY document_id) latency_ms, count(*) OVER (PARTITION BY document_id) n_attempts FROM b WHERE NOT done) SELECT document_id, attempt, good meaningful, CAST(latency_ms AS BIGINT) latency_ms, n_attempts FROM c WHERE r = 1""",
        "page_counters": """WITH c AS (SELECT conv_id document_id, turn t, CASE WHEN turn % 4 <> 3 THEN coalesce(length(text), 0) ELSE 0 END n, turn % 8 = 7 b, role = 'user' u FROM conversations)
        SELECT document_id, count(*) n_pages, count(*) FILTER (n > 0) n_native, count(*) FILTER (n = 0 AND NOT b) n_scanned, CAST(count(*) FILTER (b) AS INTEGER) n_blank, CAST(count(*) FILTER (u) AS INTEGER) n_rotated, nullif(count(*) FILTER (t <= 5), 0) n_kept,
          CASE WHEN max(t) > 5 AND count(*) FILTER (t <= 5) > 0 THEN 'truncated 5/' || max(t) END truncated FROM c GROUP BY 1""",
        "card_sides": f"""WITH {sides}, g AS (SELECT document_id, first(m ORDER BY side) FILTER (trim(m) <> '') AS mode, first(fl ORDER BY side) FILTER (fl IS NOT NULL) flag FROM t GROUP BY 1),
        t4 AS (SELECT document_id, ln, max(m) m, max(fl) fl FROM t WHERE ln <= 4 GROUP BY 1, 2), u AS (SELECT *, CASE WHEN trim(m) <> '' THEN 1 ELSE 0 END + CASE WHEN fl IS NOT NULL THEN 1 ELSE 0 END n FROM t4), v AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN n = 0 THEN 1 ELSE 0 END, ln) r FROM u)
        SELECT g.document_id, g.mode, flag, CAST((ln - 1) * 90 AS INTEGER) rotation, n n_filled, CASE WHEN n = 0 THEN 'unreadable' WHEN ln > 1 THEN 'rotated' END AS warning FROM g LEFT JOIN v ON g.document_id = v.document_id AND r = 1""",
        "folded_labels": f"WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) l FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, {strict} s, {loose} z FROM x) SELECT doc_id, count(*) n_lines, CAST(sum(length(s)) AS BIGINT) strict, CAST(sum(length(z)) AS BIGINT) loose, count(*) FILTER (s <> '') n_with_words FROM y GROUP BY 1",
        "column_natures": """SELECT CASE p_partkey % 9 WHEN 0 THEN 'brut' WHEN 1 THEN 'amortissement_provision' WHEN 2 THEN 'net_n' WHEN 3 THEN 'net_n_1' WHEN 4 THEN 'net_n_1' WHEN 5 THEN 'total_exercice' WHEN 6 THEN 'net_n' ELSE 'unknown' END nature, p_partkey % 2 = 0 AS grand, count(*) n FROM part GROUP BY 1, 2""",
        "overridden_scores": f"""WITH {f} SELECT document_id, k % 50 = 0 OR k % 10 = 0 OR k % 9 = 0 OR ca IS NULL OR tb IS NULL OR fp IS NULL OR rn IS NULL OR caf IS NULL OR (k % 2 <> 0 AND (df IS NULL OR fdr IS NULL)) blocked, k % 50 = 0 no_axis FROM f""",
        "lot_summary": f"WITH {f} SELECT document_id, row_number() OVER (ORDER BY document_id) n, CASE WHEN ca IS NULL THEN 0 ELSE least(8, k % 12 + 1) END n_warnings, CASE WHEN ca IS NULL THEN 'no lines' END AS error, 'lot' run_id FROM f",
        "axes_sheet": f"""{axes}, s AS (SELECT k || '-' || y document_id, CAST(axis1 AS DOUBLE) a, CAST(axis3 AS DOUBLE) c FROM axes) SELECT document_id, 'Axe 1 — Financier' code, a score, 0.75::DOUBLE weight, CAST(printf('%.2f', a * 0.75::DOUBLE) AS DOUBLE) contribution FROM s
        UNION ALL SELECT document_id, 'Axe 2 — Comportemental', NULL, 0.15, 0.0 FROM s UNION ALL SELECT document_id, 'Axe 3 — Sectoriel', c, 0.1, CAST(printf('%.2f', c * 0.1::DOUBLE) AS DOUBLE) FROM s""",
        "ratio_sheet_details": f"{axes}, x AS (SELECT r.code, r.status, CASE r.code {lacking} END lacks FROM r JOIN d ON r.k = d.k AND r.y = d.y) SELECT code, status, CASE code {units} END unit, count(*) n, count(*) FILTER (status = '{E.NONE}' AND lacks) n_reasons FROM x GROUP BY 1, 2, 3",
        "job_states": """WITH e AS (SELECT user_id job_id, ts, event_type t, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR g FROM events), a AS (SELECT *, coalesce(bool_or(g) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING), false) dead FROM e)
        SELECT job_id, 'processing' AS state, count(*) FILTER (t = 'view') n_financial, count(*) FILTER (t = 'click') n_skipped, count(*) FILTER (t = 'error') n_failed, count(*) FILTER (NOT dead) n_alive FROM a GROUP BY 1""",
        "upload_admission": "WITH u AS (SELECT page_id, coalesce(html, '') h FROM pages) SELECT page_id, CASE WHEN strlen(h) = 0 THEN 'empty' WHEN strlen(h) > 3000 THEN 'too large' WHEN page_id % 3 = 0 THEN 'wrong type' WHEN NOT starts_with(h, '<!DO') THEN 'wrong magic' END reason FROM u",
        "control_outcomes": f"WITH {identities}, {outcomes} SELECT document_id, code, status, CAST(o - e AS DOUBLE) difference, CASE WHEN o IS NOT NULL AND e IS NOT NULL THEN CAST(greatest(1, abs(e) * 0.0001) AS DECIMAL(20,4))::DOUBLE END tolerance FROM r",
        "invalidated_datasets": f"""WITH {identities}, {outcomes}, x AS (SELECT DISTINCT document_id, unnest(affected) field FROM r WHERE status = 'failed'),
        y AS (SELECT x.* FROM x JOIN i ON i.document_id = x.document_id WHERE NOT (field = 'TOTAL_PASSIF' AND tpas IS NULL) AND NOT (field = 'TRESORERIE_NETTE' AND tnet IS NULL) AND NOT (field = 'TRESORERIE_PASSIF' AND tp IS NULL)
          AND NOT (field = 'PRODUITS_NON_COURANTS' AND pnc IS NULL) AND NOT (field = 'RESULTAT_AVANT_IMPOT' AND unsure))
        SELECT document_id, CAST(count(*) OVER (PARTITION BY document_id) AS INTEGER) n_warnings, field, 'conflicting' AS status FROM y""",
        "fallback_amounts": f"""WITH {f} SELECT document_id, 'RESULTAT_NET' code, {num(p('tb'))} AS value, 'observed' AS source FROM f WHERE k % 2 = 0 UNION ALL SELECT document_id, 'ACTIFS_IMMOBILISES', {num(p('ai'))}, 'fallback' FROM f WHERE k % 2 = 1 AND ai IS NOT NULL
        UNION ALL SELECT document_id, 'CHARGES_INTERETS', {num(p('achats'))}, 'fallback' FROM f WHERE k % 2 = 1 AND achats IS NOT NULL""",
        "signed_keywords": f"WITH {f} SELECT document_id, 'RESULTAT_NET' code, {num(p('rn'))} AS value FROM f WHERE rn IS NOT NULL",
        "recovered_zeros": f"WITH {f} SELECT document_id, 'DETTES_FINANCIERES' field_code, '0,00' raw_value, 0.8::DOUBLE confidence FROM f WHERE k % 5 = 0 OR (k % 3 <> 0 AND k * 7 % 800 > 390)",
    }
