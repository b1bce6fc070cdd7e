"""Registered queries of the accounting operators, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_documents, queries_filings
from .functions.amounts import apart, is_explicit_zero, parse_amount, parse_ocr_amount, safe_divide, sum_present
from .functions.labels import label_similarity, normalize_label
from .operators import controls as X
from .operators import evaluation as E
from .operators import ratios as R
from .operators import resolve as W
from .operators import scoring as S
from .plans.statements import ST_SQL, statements
from .sources.documents import key_value_sheet, pick_archive_entry
from .sources.scratch import dealt
from .streaming import jobs

KEYS = ["k", "y"]
CONTROLS = [
    ("bilan_equilibre", "tb", "other_tb", True, ["TOTAL_BILAN"]),
    ("tresorerie_nette", "ta - tp", "tn", True, ["TRESORERIE_NETTE"]),
    ("resultat_net", "caf - am", "rn", False, ["RESULTAT_NET"]),
    ("dettes", "fdr - fp + ai", "df", False, ["DETTES_FINANCIERES", "FDR"]),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Readings that disagree with their identities for some borrowers, so that every control shows both outcomes.
DISPUTED = {"other_tb": "CASE WHEN k % 6 = 0 THEN tb + 5000 WHEN k % 6 > 1 THEN tb END", "tn": "CASE WHEN k % 3 = 0 THEN tn + 500 ELSE tn END", "rn": "CASE WHEN k % 4 = 0 THEN rn + 2000 ELSE rn END", "df": "CASE WHEN k % 5 = 0 THEN df + 7000 ELSE df END"}


def _with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with the year before, and amounts that stand for leasing, term credit and new financing."""
    st = statements(spark, sf_dir).withColumns({"leasing": F.col("ta"), "cmt": F.col("tp"), "operation": F.col("clients")})
    return W.with_previous(st, "k", "y", "ca", "ca_n1")


def _disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).withColumns({n: F.expr(e).cast("decimal(20,4)") for n, e in DISPUTED.items()})


def _doubles(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def statement_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = statements(spark, sf_dir)
    return st.select("k", "y", "seg", *(F.col(c).cast("double").alias(c) for c in ("ca", "achats", "clients", "fourn", "rn", "caf", "tn", "tb", "df", "ai", "fp", "fdr")))


def g1_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(R.engine_ratios(_with_previous(spark, sf_dir), KEYS), 4, "value").select(*KEYS, "code", "value", "status")


def g1_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.engine_axes(_with_previous(spark, sf_dir), KEYS)


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    events = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(
        F.count_if((kind == "error") & (value > 90)).cast("int").alias("incidents"), F.count_if(kind == "error").cast("int").alias("rejects"),
        F.countDistinct(F.when(kind == "error", F.to_date("ts"))).cast("int").alias("debit_days"), F.count_if(kind == "purchase").cast("double").alias("domiciliation"),
    )
    absent = {c: F.lit(None).cast("double") for c in ("overdraft", "gap")}
    return events.withColumns(absent | {"unpaid": F.lit(0), "kept": F.lit(None).cast("boolean"), "bam": (F.col("k") % 9).cast("int")})


def g1_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.engine_behaviour(_behaviour(spark, sf_dir), ["k"])


def g1_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for every statement; borrowers without events have no behaviour, which counts as 0."""
    behaviour = _behaviour(spark, sf_dir)
    metrics = ["bam", "incidents", "rejects", "unpaid", "domiciliation", "debit_days", "overdraft", "gap", "kept"]
    axis2 = S.engine_behaviour(behaviour, ["k", *metrics])
    out = E.evaluate(_with_previous(spark, sf_dir).join(axis2, "k", "left"), KEYS)
    return out.select(*KEYS, "axis1", "axis2", "axis3", "score", "risk_class", "decision", "blocking", F.size("ineligible").alias("n_reasons"), F.size("strengths").alias("n_strengths"), F.size("watch_points").alias("n_watch_points"))


def g3_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.weighted_ratios(_with_previous(spark, sf_dir), KEYS)
    return out.select(*KEYS, "code", F.col("value").cast("double").alias("value"), "status", F.col("points").cast("double").alias("points"))


def g3_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.weighted_decision(S.weighted_axis(_with_previous(spark, sf_dir), KEYS))
    return out.select(*KEYS, F.col("financial").cast("double").alias("financial"), "missing", "risk_class", "decision", "blocking")


def accounting_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.controls(_disputed(spark, sf_dir), KEYS, CONTROLS)
    return out.select(*KEYS, "code", "status", F.col("difference").cast("double").alias("difference"), F.array_join("affected", ",").alias("affected"))


def invalidated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _disputed(spark, sf_dir)
    names = {"TOTAL_BILAN": "tb", "TRESORERIE_NETTE": "tn", "RESULTAT_NET": "rn", "CHIFFRE_AFFAIRES": "ca"}
    wide = st.select(*KEYS, *(F.col(c).alias(n) for n, c in names.items()))
    values = wide.unpivot(KEYS, list(names), "code", "value").withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("confirmed"))
    out = X.invalidate(values, X.controls(st, KEYS, CONTROLS), KEYS)
    return out.groupBy("code", "status").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(30,4)")).cast("double"), 2).alias("total"))


def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = statements(spark, sf_dir).withColumns({"tn": F.when(F.col("k") % 3 != 0, F.col("tn")), "fdr": F.when(F.col("k") % 4 == 0, F.col("fdr") + 5).otherwise(F.col("fdr"))})
    out = X.reconcile(X.derive(st, "tn", "ta - tp"), "fdr", "fp + df - ai")
    return _doubles(out.select(*KEYS, "tn", "tn_status", "fdr", "fdr_status"), 4, "tn", "fdr")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    form = lambda sep, dec: F.concat(F.replace(grouped, F.lit(","), F.lit(sep)), F.lit(dec), rest)
    n = F.col("l_linenumber") % 6
    raw = (
        F.when(n == 0, form(" ", ",")).when(n == 1, form(".", ",")).when(n == 2, F.concat(F.lit("("), form(" ", ","), F.lit(")"))).when(n == 3, F.concat(form(" ", ","), F.lit("-")))
        .when(n == 4, F.concat(F.lit("MAD "), form("", "."))).otherwise(F.lit(" - "))
    )
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))


def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, ocr = parse_amount(F.col("raw")), parse_ocr_amount(F.col("raw"))
    out = _printed(spark, sf_dir).select(apart("l_orderkey"), "l_linenumber", parsed.alias("v"), ocr.alias("ocr"), "raw").withColumn("zero", is_explicit_zero(F.col("raw"), F.col("ocr")))
    sums = [F.sum("v").cast("double").alias("total"), F.sum("ocr").cast("double").alias("total_ocr"), F.count("v").alias("n_values"), F.count_if("zero").alias("n_zero")]
    return out.groupBy("l_orderkey").agg(*sums)


def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text as a label, counted by document."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    label = normalize_label(F.col("line"))
    return lines.select("doc_id", label.alias("label")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("label")).alias("n_chars"), F.min("label").alias("first"), F.max("label").alias("last"))


def label_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    out = parts.select("p_name", "p_type", label_similarity(normalize_label(F.col("p_name")), normalize_label(F.substring_index("p_name", " ", 1))).alias("same"), label_similarity(normalize_label(F.col("p_type")), normalize_label(F.col("p_name"))).alias("other"))
    return _doubles(out, 6, "same", "other")


def yearly_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(W.yearly_variations(statements(spark, sf_dir), "k", "y", ["ca", "rn", "fdr"]), 4, "variation")


def sector_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.weighted_values(_with_previous(spark, sf_dir), ["seg"])
    return _doubles(W.sector_medians(out, "seg"), 4, "median")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(_read(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("code"), F.col("l_quantity").cast("decimal(20,4)").alias("amount"), "l_discount")
    return rows.withColumn("priority", F.round(F.col("l_discount") * 100) * 2)


def value_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(W.consensus(_candidates(spark, sf_dir), ["l_orderkey", "code"], "amount"), 4, "value")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(W.pick_best(_candidates(spark, sf_dir), ["l_orderkey", "code"], "amount", "priority"), 4, "value", "priority")


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.dedupe_first(_candidates(spark, sf_dir), ["l_orderkey", "code"], ["l_linenumber"])
    return out.select("l_orderkey", "code", "l_linenumber", F.col("amount").cast("double").alias("amount"))


def carried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("section"))
    return W.carry_section(turns, ["conv_id"], ["turn"], "section")


def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    out = W.table_islands(events, ["user_id"], ["ts", "event_id"], "event_type = 'click'")
    return out.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def present_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = statements(spark, sf_dir)
    cols = [F.col(c) for c in ("ta", "tp", "clients")]
    return st.select(*KEYS, sum_present(*cols).cast("double").alias("total"), F.round(safe_divide(F.col("ta"), F.col("tp")).cast("double"), 4).alias("ratio"))


def statement_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = statements(spark, sf_dir).select(*KEYS, F.col("seg").alias("segment"), F.col("y").alias("exercice"))
    return key_value_sheet(st, KEYS)


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    entries = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("archive"), F.col("url").alias("path"), F.length("html").alias("size"), (F.col("page_id") % 7).alias("pages"))
    return pick_archive_entry(entries)


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("page")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", event.alias("event"), F.lit(10).alias("total"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(_job_events(spark, sf_dir)).drop("last_ts")


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.history(_job_events(spark, sf_dir), 5).select("job_id", "event_id", "age")


def _named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "purchase", "result_ready").when((kind == "error") & (F.col("value") > 90), "job_failed").when(kind == "error", "page_failed").when(kind == "view", "page_skipped").otherwise("page_extracted")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", event.alias("event"))


def terminal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.terminal_once(_named_events(spark, sf_dir)).select("job_id", "event", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of each job sees before its stream ends."""
    seen = jobs.until_terminal(_named_events(spark, sf_dir))
    last = F.max_by("event", F.struct("ts", "event_id"))
    return seen.groupBy("job_id").agg(F.count("*").alias("n_events"), last.alias("last_event"), F.max("event_id").alias("greatest_id"), F.count_if(F.col("event") == "page_extracted").alias("n_pages"))


def live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.live_windows(_job_events(spark, sf_dir)).groupBy("job_id").agg(F.count("*").alias("n_lives"), F.max("n").alias("most_events"))


QUERIES = [
    statement_view, g1_decision, g1_ratios, g1_axes, g1_behaviour, g3_ratios, g3_decision, accounting_controls, invalidated_fields, derived_fields, parse_amounts, normalized_labels, label_similarities,
    yearly_variations, sector_medians, value_consensus, best_candidates, first_candidates, carried_sections, table_islands, present_sums, statement_sheet, archive_entries, job_progress, job_history,
    terminal_events, streamed_events, live_jobs,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES} | queries_documents.queries() | queries_filings.queries()


def _engine_sql() -> str:
    """The engine ratios as a table r (k, y, seg, pos, code, value, status)."""
    grade = lambda v, good, watch, up: f"CASE WHEN {v} {'>=' if up else '<='} {good} THEN '{R.OK}' WHEN {v} {'>=' if up else '<='} {watch} THEN '{R.WATCH}' ELSE '{R.BAD}' END"
    rows = []

    def row(value: str, status: str) -> None:
        rows.append(f"SELECT k, y, seg, {len(rows)} pos, '{R.ENGINE[len(rows)]}' code, CAST({value} AS DOUBLE) AS value, {status} AS status FROM d")

    def over(top: str, base: str, good: float, watch: float, negative: str = "false") -> None:
        v = f"CASE WHEN {base} > 0 THEN {top} / {base} END"
        row(v, f"CASE WHEN ({v}) IS NULL THEN '{R.NONE}' WHEN {negative} THEN '{R.BAD}' ELSE {grade(f'({v})', good, watch, True)} END")

    over("fp", "tb", 0.2, 0.1, "fp < 0")
    for base, good, watch in (("fp", 2, 3), ("caf", 5, 7)):
        v = f"CASE WHEN {base} > 0 THEN df / {base} END"
        row(v, f"CASE WHEN df IS NULL OR {base} IS NULL THEN '{R.NONE}' WHEN {base} <= 0 THEN '{R.BAD}' ELSE {grade(f'({v})', good, watch, False)} END")
    over("caf", "ca", 0.05, 0.02, "caf < 0")
    over("rn", "ca", 0.05, 0.02)
    over("rn", "fp", 0.10, 0.05)
    over("rn", "(fp + df)", 0.05, 0.02)
    for top, scale in (("fdr", 1), ("tn", 360)):
        v = f"{top} / nullif(ca, 0) * {scale}"
        row(v, f"CASE WHEN ({v}) IS NULL THEN '{R.NONE}' WHEN ({v}) > 0 THEN '{R.OK}' WHEN ({v}) = 0 THEN '{R.WATCH}' ELSE '{R.BAD}' END")
    customer = "(CASE WHEN ca > 0 THEN clients / ca * 360 END)"
    row(customer, f"CASE WHEN {customer} IS NULL THEN '{R.NONE}' ELSE {grade(customer, 60, 90, False)} END")
    supplier = "(CASE WHEN achats > 0 THEN fourn / achats * 360 END)"
    row(supplier, f"CASE WHEN {supplier} IS NULL THEN '{R.NONE}' WHEN {customer} IS NULL THEN '{R.WATCH}' ELSE {grade(supplier, f'0.8 * {customer}', f'0.5 * {customer}', True)} END")
    growth = "((ca - n1) / abs(nullif(n1, 0)))"
    row(growth, f"CASE WHEN {growth} IS NULL THEN '{R.NONE}' ELSE {grade(growth, 0.05, 0, True)} END")
    after = "(CASE WHEN coalesce(ta, tp, clients) IS NOT NULL AND fp > 0 THEN (coalesce(ta, 0) + coalesce(tp, 0) + coalesce(clients, 0)) / fp END)"
    row(after, f"CASE WHEN coalesce(ta, tp, clients) IS NULL OR fp IS NULL THEN '{R.NONE}' WHEN fp <= 0 THEN '{R.BAD}' ELSE {grade(after, 2, 3, False)} END")
    names = ("ca", "achats", "clients", "fourn", "rn", "caf", "ta", "tp", "tn", "tb", "df", "fp", "fdr")
    doubles = ", ".join(f"CAST({c} AS DOUBLE) {c}" for c in names)
    return f"WITH {ST_SQL}, d AS (SELECT k, y, seg, {doubles}, CAST(lag(ca) OVER (PARTITION BY k ORDER BY y) AS DOUBLE) n1 FROM st), r AS (" + " UNION ALL ".join(rows) + ")"


def _weighted_sql() -> str:
    """The weighted ratios as a table w (k, y, seg, code, value, status, points, weight), in whole numbers.

    Amounts are ten-thousandths, so quotients are compared with their bounds and rounded half up without an error; as
    doubles some that lie on a half went to the wrong side.
    """
    values = {
        "financial_autonomy": ("fp", "tb", 100), "debt_ratio": ("df", "fp", 1), "repayment_capacity": ("df", "caf", 1), "caf_margin": ("caf", "ca", 100),
        "commercial_profitability": ("rn", "ca", 100), "financial_profitability": ("rn", "fp", 100), "economic_profitability": ("rn", "(fp + df)", 100), "fdr_ca": ("fdr", "ca", 100),
        "treasury_days": ("tn", "ca", 360), "customer_days": ("clients", "ca", 360), "supplier_days": ("fourn", "achats", 360), "ca_growth": ("(ca - n1)", "abs(n1)", 100), "global_debt_after_operation": ("(ta + tp + clients)", "fp", 1),
    }

    def cents(code: str) -> str:
        top, base, scale = values[code]
        return f"(CASE WHEN {base} <> 0 THEN sign({top}) * sign({base}) * ((2 * 100 * {scale} * abs({top}) + abs({base})) // (2 * abs({base}))) END)"

    rows = []
    for code, up, good, watch, weight, _ in R.WEIGHTED:
        top, base, scale = values[code]
        if up is None:
            gap = f"({cents(code)} - {cents('customer_days')})"
            status = f"CASE WHEN {gap} IS NULL THEN 'non_calculable' WHEN {gap} >= 0 THEN 'conforme' WHEN {gap} >= -3000 THEN 'a_surveiller' ELSE 'non_conforme' END"
        else:
            op = ">=" if up else "<="
            beyond = lambda t: f"{cents(code)} {op} {round(t * 100)}" if code == "ca_growth" else f"10 * {scale} * {top} * sign({base}) {op} {round(t * 10)} * abs({base})"  # noqa: B023, E731
            status = f"CASE WHEN {cents(code)} IS NULL THEN 'non_calculable' WHEN {beyond(good)} THEN 'conforme' WHEN {beyond(watch)} THEN 'a_surveiller' ELSE 'non_conforme' END"
        rows.append(f"SELECT k, y, seg, '{code}' code, CAST({cents(code)} AS DOUBLE) / 100 AS value, {status} AS status, {weight} weight FROM d")
    names = ("ca", "achats", "clients", "fourn", "rn", "caf", "ta", "tp", "tn", "tb", "df", "fp", "fdr")
    whole = ", ".join(f"CAST({c} * 10000 AS HUGEINT) {c}" for c in names)
    points = "CAST(round(weight * CASE status WHEN 'conforme' THEN 1.0 WHEN 'a_surveiller' THEN 0.6 ELSE 0 END, 2) AS DOUBLE)"
    return f"WITH {ST_SQL}, d AS (SELECT k, y, seg, {whole}, CAST(lag(ca) OVER (PARTITION BY k ORDER BY y) * 10000 AS HUGEINT) n1 FROM st), w0 AS (" + " UNION ALL ".join(rows) + f"), w AS (SELECT *, {points} points FROM w0)"


def _grid_sql(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {g[0]} THEN '{g[1]}'" for g in S.GRID) + " ELSE 'D/F' END"


def oracle_sql() -> dict[str, str]:
    engine, weighted = _engine_sql(), _weighted_sql()
    medians = " ".join(f"WHEN '{c}' THEN {m}" for c, m in S.MEDIANS)
    lower = ", ".join(f"'{c}'" for c in S.LOWER)
    axes = f"""{engine}, m AS (SELECT *, CASE code {medians} END med FROM r),
    c AS (SELECT k, y, count(*) FILTER (pos < 11 AND status = '{R.OK}') n_ok, count(*) FILTER (pos < 11 AND status = '{R.WATCH}') n_watch, count(*) FILTER (pos < 11 AND status = '{R.BAD}') n_bad,
      count(*) FILTER (pos < 11 AND status = '{R.NONE}') n_none, count(*) FILTER (med IS NOT NULL AND value IS NOT NULL) n_compared,
      count(*) FILTER (CASE WHEN code IN ({lower}) THEN value <= med ELSE value >= med END) n_better FROM m GROUP BY k, y),
    axes AS (SELECT *, greatest(0.0, CAST(printf('%.2f', CAST((100 - 7.5 * n_watch - 20 * n_bad) * CASE WHEN n_none > 0 THEN round((11 - n_none) / 11.0::DOUBLE, 4) ELSE 1 END AS DOUBLE)) AS DOUBLE)) axis1,
      CASE WHEN n_compared > 0 THEN round(100.0::DOUBLE * n_better / n_compared, 2) ELSE 0.0 END axis3 FROM c)"""
    behaviour = """b AS (SELECT user_id k, count(*) FILTER (event_type = 'error' AND value > 90) incidents, count(*) FILTER (event_type = 'error') rejects,
      count(DISTINCT CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END) debit_days, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) dom FROM events GROUP BY 1),
    bh AS (SELECT k, incidents, rejects, dom, debit_days, k % 9 bam, CAST(greatest(0, 100 - CASE WHEN incidents > 0 THEN 40 ELSE 0 END - CASE WHEN rejects > 0 THEN 15 ELSE 0 END - CASE WHEN dom < 80 THEN 10 ELSE 0 END
      - CASE WHEN debit_days > 30 THEN 15 ELSE 0 END) AS DOUBLE) axis2, CAST(0.625 AS DOUBLE) coverage2 FROM b)"""
    checks = " UNION ALL ".join(
        f"SELECT k, y, '{code}' code, CASE WHEN e IS NULL OR o IS NULL THEN 'not_testable' WHEN abs(o - e) <= greatest(1, abs(e) * 0.0001) THEN 'passed' ELSE 'failed' END AS status, CAST(o - e AS DOUBLE) difference, '{','.join(a)}' affected "
        f"FROM (SELECT k, y, {e} e, {o} o FROM ds)" + ("" if always else " WHERE e IS NOT NULL AND o IS NOT NULL")
        for code, e, o, always, a in CONTROLS
    )
    disputed = "ds AS (SELECT * REPLACE (" + ", ".join(f"CAST({e} AS DECIMAL(20,4)) AS {n}" for n, e in DISPUTED.items() if n != "other_tb") + f"), CAST({DISPUTED['other_tb']} AS DECIMAL(20,4)) other_tb FROM st)"
    folded = "regexp_replace(regexp_replace(replace(replace(lower(strip_accents({})), 'œ', 'oe'), 'æ', 'ae'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
    similar = """CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) THEN 0.75 + 0.25 * length({b}) / length({a})
      WHEN contains({b}, {a}) THEN CASE WHEN length({a}) / length({b}) >= 0.9 THEN 0.7 + 0.2 * length({a}) / length({b}) ELSE 0.0 END
      WHEN len(list_intersect(string_split({a}, ' '), string_split({b}, ' '))) / len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' ')))) >= 0.5
      THEN len(list_intersect(string_split({a}, ' '), string_split({b}, ' '))) / len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' ')))) ELSE 0.0 END"""
    cand = "c AS (SELECT l_orderkey, l_linenumber, l_returnflag code, CAST(l_quantity AS DECIMAL(20,4)) amount, round(l_discount * 100) * 2 priority FROM lineitem)"
    event = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'page' END"
    named = """n AS (SELECT user_id job_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'result_ready' WHEN event_type = 'error' AND value > 90 THEN 'job_failed' WHEN event_type = 'error' THEN 'page_failed'
      WHEN event_type = 'view' THEN 'page_skipped' ELSE 'page_extracted' END ev FROM events)"""
    job = f"j AS (SELECT user_id job_id, event_id, ts, {event} ev FROM events)"
    return {
        "statement_view": f"WITH {ST_SQL} SELECT k, y, seg, " + ", ".join(f"CAST({c} AS DOUBLE) {c}" for c in ("ca", "achats", "clients", "fourn", "rn", "caf", "tn", "tb", "df", "ai", "fp", "fdr")) + " FROM st",
        "g1_ratios": f"{engine} SELECT k, y, code, round(value, 4) AS value, status FROM r",
        "g1_axes": f"{axes} SELECT k, y, n_ok, n_watch, n_bad, n_none, n_compared, n_better, CAST(axis1 AS DOUBLE) axis1, CAST(axis3 AS DOUBLE) axis3 FROM axes",
        "g1_behaviour": f"WITH {behaviour} SELECT k, axis2, coverage2 FROM bh",
        "g1_decision": f"""{axes}, {behaviour}, q AS (SELECT k, y, count(*) FILTER (status <> '{R.NONE}') calc, count(*) FILTER (status IN ('{R.WATCH}', '{R.BAD}')) n_poor,
          count(*) FILTER (code = 'croissance_ca' AND value >= 0.05) + count(*) FILTER (code = 'autonomie_financiere' AND status = '{R.OK}' AND value IS NOT NULL)
          + CASE WHEN count(*) FILTER (code IN ('tresorerie_jours_ca', 'fdr_sur_ca') AND status = '{R.OK}') = 2 THEN 1 ELSE 0 END strong FROM r GROUP BY k, y),
        s AS (SELECT axes.k, axes.y, CAST(axis1 AS DOUBLE) axis1, axis2, CAST(axis3 AS DOUBLE) axis3, bam, incidents, axis1 * 0.75::DOUBLE + coalesce(axis2, 0) * 0.15::DOUBLE + axis3 * 0.10::DOUBLE s,
          CASE WHEN d.ca IS NULL THEN 1 ELSE 0 END + CASE WHEN d.tb IS NULL THEN 1 ELSE 0 END + CASE WHEN d.fp IS NULL THEN 1 ELSE 0 END + CASE WHEN d.rn IS NULL THEN 1 ELSE 0 END + CASE WHEN d.df IS NULL THEN 1 ELSE 0 END
          + CASE WHEN d.caf IS NULL THEN 1 ELSE 0 END + CASE WHEN d.fdr IS NULL THEN 1 ELSE 0 END + CASE WHEN calc < 8 THEN 1 ELSE 0 END reasons,
          strong + CASE WHEN n_compared > 0 AND n_better / n_compared >= 0.6 THEN 1 ELSE 0 END strong,
          n_poor + CASE WHEN axis2 IS NULL THEN 2 ELSE 1 + CASE WHEN incidents > 0 THEN 1 ELSE 0 END + CASE WHEN rejects > 0 THEN 1 ELSE 0 END + CASE WHEN dom < 80 THEN 1 ELSE 0 END + CASE WHEN debit_days > 30 THEN 1 ELSE 0 END END watch
          FROM axes JOIN q ON axes.k = q.k AND axes.y = q.y JOIN d ON d.k = q.k AND d.y = q.y LEFT JOIN bh ON axes.k = bh.k)
        SELECT k, y, axis1, axis2, axis3, CASE WHEN reasons > 0 THEN NULL WHEN bam >= 7 THEN 0.0 ELSE CAST(printf('%.2f', s) AS DOUBLE) END score, CASE WHEN reasons > 0 THEN 'Non évaluable' WHEN bam >= 7 THEN 'D/F' ELSE {_grid_sql("s")} END risk_class,
          CASE WHEN reasons > 0 THEN 'Revue manuelle' WHEN bam >= 7 THEN 'Rejeté (Cotation BAM)' ELSE CASE {" ".join(f"WHEN s >= {g[0]} THEN '{g[2]}'" for g in S.GRID)} ELSE 'Risqué' END END decision,
          CASE WHEN reasons > 0 THEN 'INSUFFICIENT_DATA' WHEN bam >= 7 THEN 'NO_GO' WHEN incidents > 0 THEN 'MANUAL_REVIEW' END blocking,
          CAST(reasons AS INTEGER) n_reasons, CAST(strong AS INTEGER) n_strengths, CAST(watch AS INTEGER) n_watch_points FROM s""",
        "g3_ratios": f"{weighted} SELECT k, y, code, value, status, points FROM w",
        "g3_decision": f"""{weighted}, fa AS (SELECT k, y, round(sum(points) / sum(weight) * 100, 2) financial,
          coalesce(string_agg(CASE WHEN status = 'non_calculable' AND code IN ('financial_autonomy', 'debt_ratio', 'repayment_capacity', 'caf_margin') THEN code END, ',' ORDER BY code), '') missing FROM w GROUP BY k, y)
        SELECT k, y, financial, missing, CASE WHEN missing <> '' THEN 'NON_EVALUABLE' ELSE {_grid_sql("financial")} END risk_class, CASE WHEN missing <> '' THEN 'Revue manuelle' ELSE 'Revue manuelle (score financier provisoire)' END decision,
          CASE WHEN missing <> '' THEN 'INSUFFICIENT_DATA' ELSE 'PARTIAL_DATA' END blocking FROM fa""",
        "accounting_controls": f"WITH {ST_SQL}, {disputed} {checks}",
        "invalidated_fields": f"""WITH {ST_SQL}, {disputed}, x AS ({checks}), v AS (SELECT k, y, 'TOTAL_BILAN' code, tb AS value FROM ds UNION ALL SELECT k, y, 'TRESORERIE_NETTE', tn FROM ds UNION ALL SELECT k, y, 'RESULTAT_NET', rn FROM ds
          UNION ALL SELECT k, y, 'CHIFFRE_AFFAIRES', ca FROM ds), f AS (SELECT DISTINCT k, y, unnest(string_split(affected, ',')) code, true hit FROM x WHERE status = 'failed'),
        u AS (SELECT v.code, value, CASE WHEN value IS NULL THEN 'missing' WHEN hit THEN 'conflicting' ELSE 'confirmed' END AS status FROM v LEFT JOIN f ON v.k = f.k AND v.y = f.y AND v.code = f.code)
        SELECT code, status, count(*) n, round(CAST(sum(CASE WHEN status = 'confirmed' THEN value END) AS DOUBLE), 2) total FROM u GROUP BY 1, 2""",
        "derived_fields": f"""WITH {ST_SQL}, e AS (SELECT k, y, CASE WHEN k % 3 <> 0 THEN tn END tn, ta - tp c1, CASE WHEN k % 4 = 0 THEN fdr + 5 ELSE fdr END fdr, fp + df - ai c2 FROM st)
        SELECT k, y, CAST(coalesce(tn, c1) AS DOUBLE) tn, CASE WHEN tn IS NOT NULL THEN 'confirmed' WHEN c1 IS NOT NULL THEN 'derived' ELSE 'missing' END tn_status,
          CAST(CASE WHEN c2 IS NOT NULL AND abs(fdr - c2) > greatest(1, abs(c2) * 0.0001) THEN c2 ELSE fdr END AS DOUBLE) fdr,
          CASE WHEN c2 IS NOT NULL AND (fdr IS NULL OR abs(fdr - c2) > greatest(1, abs(c2) * 0.0001)) THEN 'derived' WHEN fdr IS NOT NULL THEN 'confirmed' ELSE 'missing' END fdr_status FROM e""",
        "parse_amounts": """WITH p AS (SELECT l_orderkey, CASE WHEN l_linenumber % 6 = 5 THEN NULL WHEN l_linenumber % 6 IN (2, 3) THEN -CAST(l_extendedprice AS DECIMAL(20,4)) ELSE CAST(l_extendedprice AS DECIMAL(20,4)) END v FROM lineitem)
        SELECT l_orderkey, CAST(sum(v) AS DOUBLE) total, CAST(sum(v) AS DOUBLE) total_ocr, count(v) n_values, count(*) FILTER (v = 0) n_zero FROM p GROUP BY 1""",
        "normalized_labels": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) x FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, trim({folded.format('x')}) b FROM l) SELECT doc_id, count(*) n_lines, CAST(sum(length(b)) AS BIGINT) n_chars, min(b) AS first, max(b) AS last FROM n GROUP BY 1",
        "label_similarities": f"WITH p AS (SELECT DISTINCT p_name, p_type, trim({folded.format('p_name')}) a, trim({folded.format("string_split(p_name, ' ')[1]")}) b, trim({folded.format('p_type')}) t FROM part) SELECT p_name, p_type, round(CAST({similar.format(a='a', b='b')} AS DOUBLE), 6) AS same, round(CAST({similar.format(a='t', b='a')} AS DOUBLE), 6) AS other FROM p",
        "yearly_variations": f"""WITH {ST_SQL}, u AS (SELECT k, y, 'ca' item, CAST(ca AS DOUBLE) v FROM st UNION ALL SELECT k, y, 'rn', CAST(rn AS DOUBLE) FROM st UNION ALL SELECT k, y, 'fdr', CAST(fdr AS DOUBLE) FROM st),
        g AS (SELECT *, lag(v) OVER (PARTITION BY k, item ORDER BY y) p, lag(y) OVER (PARTITION BY k, item ORDER BY y) py FROM u)
        SELECT k, item, y || '/' || py AS period, round((v - p) / abs(nullif(p, 0)), 4) variation FROM g WHERE py IS NOT NULL""",
        "sector_medians": f"{weighted} SELECT seg, code, round(median(value), 4) AS median, count(*) n FROM w WHERE value IS NOT NULL GROUP BY 1, 2",
        "value_consensus": f"WITH {cand} SELECT l_orderkey, code, count(*) n_candidates, CAST(CASE WHEN count(DISTINCT amount) = 1 THEN max(amount) END AS DOUBLE) AS value, CASE count(DISTINCT amount) WHEN 0 THEN 'missing' WHEN 1 THEN 'confirmed' ELSE 'conflicting' END AS status FROM c GROUP BY 1, 2",
        "best_candidates": f"""WITH {cand}, t AS (SELECT *, max(priority) OVER (PARTITION BY l_orderkey, code) top FROM c)
        SELECT l_orderkey, code, count(*) FILTER (priority < top - 5) n_lower, max(top) priority,
          CAST(CASE WHEN count(DISTINCT CASE WHEN priority >= top - 5 THEN amount END) = 1 THEN max(CASE WHEN priority >= top - 5 THEN amount END) END AS DOUBLE) AS value,
          CASE WHEN count(DISTINCT CASE WHEN priority >= top - 5 THEN amount END) > 1 THEN 'conflicting' ELSE 'confirmed' END AS status FROM t GROUP BY 1, 2""",
        "first_candidates": f"WITH {cand} SELECT l_orderkey, code, l_linenumber, CAST(amount AS DOUBLE) amount FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, code ORDER BY l_linenumber, amount) = 1",
        "carried_sections": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations",
        "table_islands": """WITH a AS (SELECT *, event_type = 'click' c, lag(event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events),
        b AS (SELECT *, sum(CASE WHEN c AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) i FROM a)
        SELECT user_id, CAST(i AS BIGINT) AS island, count(*) n, min(event_id) first_event FROM b WHERE c GROUP BY 1, 2""",
        "present_sums": f"WITH {ST_SQL} SELECT k, y, CAST(CASE WHEN ta IS NULL AND tp IS NULL AND clients IS NULL THEN NULL ELSE coalesce(ta, 0) + coalesce(tp, 0) + coalesce(clients, 0) END AS DOUBLE) total, round(CAST(ta AS DOUBLE) / nullif(CAST(tp AS DOUBLE), 0), 4) ratio FROM st",
        "statement_sheet": f"WITH {ST_SQL} SELECT k, y, 'segment' AS field, seg AS value FROM st UNION ALL SELECT k, y, 'exercice', CAST(y AS VARCHAR) FROM st",
        "archive_entries": """WITH e AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) archive, url, page_id % 7 p, length(html) s FROM pages), t AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY p DESC, s DESC, url) r, count(*) OVER (PARTITION BY archive) n FROM e)
        SELECT archive, url AS entry, n AS n_entries FROM t WHERE r = 1""",
        "job_progress": f"""WITH {job}, g AS (SELECT job_id, count(*) FILTER (ev = 'page') n_pages, count(*) FILTER (ev = 'skipped') n_skipped, count(*) FILTER (ev = 'failed') n_failed, bool_or(ev = 'completed') done FROM j GROUP BY 1)
        SELECT job_id, n_pages, n_skipped, n_failed, CAST(CASE WHEN done THEN 100 ELSE least(80, 15 + floor(70.0 * n_pages / 10)) END AS INTEGER) pct, CASE WHEN done THEN 'completed' ELSE 'running' END state FROM g""",
        "job_history": f"WITH {job} SELECT job_id, event_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS INTEGER) age FROM j QUALIFY age <= 5",
        "terminal_events": f"WITH {named} SELECT job_id, ev AS event, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM n WHERE ev IN ('result_ready', 'job_failed') QUALIFY row_number() OVER (PARTITION BY job_id, ev ORDER BY ts, event_id) = 1",
        "streamed_events": f"""WITH {named}, e AS (SELECT *, count(*) FILTER (ev IN ('result_ready', 'job_failed')) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ended FROM n)
        SELECT job_id, count(*) n_events, arg_max(ev, (ts, event_id)) last_event, max(event_id) greatest_id, count(*) FILTER (ev = 'page_extracted') n_pages FROM e WHERE ended = 0 GROUP BY 1""",
        "live_jobs": f"""WITH {job}, a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY job_id ORDER BY ts) + INTERVAL 60 MINUTE THEN 0 ELSE 1 END s FROM j),
        b AS (SELECT *, sum(s) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) life FROM a), c AS (SELECT job_id, life, count(*) n FROM b GROUP BY 1, 2)
        SELECT job_id, count(*) n_lives, max(n) most_events FROM c GROUP BY 1""",
    } | queries_documents.oracle_sql(weighted, folded, similar) | queries_filings.oracle_sql(axes, weighted, _grid_sql)
