"""Evaluation, analysis, audit, sinks and job state."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from grandlivre.operators import analysis as A
from grandlivre.operators import audit
from grandlivre.operators import evaluation as E
from grandlivre.operators import resolution as R
from grandlivre.operators import scoring as S
from grandlivre.rules.candidates import DATASET
from grandlivre.sources import documents, reports
from grandlivre.streaming import jobs

CASE = dict(k=1, ca=38500.0, ca_n1=34200.0, fp=6200.0, tb=24800.0, df=11400.0, rn=1480.0, caf=3200.0, clients=8341.0, fourn=4000.0, achats=22500.0, fdr=3619.0, tn=535.0, leasing=3200.0, cmt=8200.0, operation=4800.0)
METRICS = "incidents int, rejects int, unpaid int, domiciliation double, debit_days int, overdraft double, gap double, kept boolean"


def test_evaluation(spark):
    rows = [CASE | {"k": k} | x for k, x in enumerate([{}, {}, {"fdr": None}, {"df": None, "caf": None, "clients": None, "tn": None}, {}])]
    cases = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in CASE if c != "k"))
    seen = spark.createDataFrame([(0, 0, 0, 0, 96.0, 41, 38.0, -4.2, True, 3), (1, 0, 0, 2, None, None, None, None, None, 7), (2, 0, 0, 0, 96.0, 41, 38.0, -4.2, True, 3), (4, 0, 0, 1, None, None, None, None, None, None)], f"k int, {METRICS}, bam int")
    axis2 = S.engine_behaviour(seen, ["k", "bam", *(m.split()[0] for m in METRICS.split(", "))])
    got = {r.k: r for r in E.evaluate(cases.join(axis2, "k", "left"), ["k"]).collect()}
    assert (got[0].axis1, got[0].axis2, got[0].axis3, got[0].score, got[0].risk_class, got[0].recommendation, got[0].blocking) == (85.0, 75.0, 80.0, 83.0, "A/B+", "Accord — conditions standards", None)
    assert got[0].strengths[0] == "Croissance solide du chiffre d'affaires (+12.6%)." and "Rentabilité commerciale à surveiller (3.8% — seuil ≥ 5 %)." in got[0].watch_points
    assert (got[1].score, got[1].blocking) == (0.0, "NO_GO") and got[4].blocking == "MANUAL_REVIEW"  # unpaid bills count
    assert (got[2].score, got[2].risk_class, got[2].ineligible) == (None, "Non évaluable", ["Champ critique manquant : fonds de roulement."])
    assert got[3].axis2 is None and len(got[3].ineligible) == 3 and got[3].ineligible[2].startswith("Couverture ratios insuffisante")
    lists = S.status_lists(cases)
    wide = E.with_engine_ratios(cases).where("k = 0").select(*(c.alias(n) for n, c in lists.items())).first()
    assert sorted(wide.to_watch) == ["delais_clients", "rentabilite_commerciale"] and wide.not_calculable == []
    details = {r.code: r for r in E.ratio_details(cases.where("k = 3"), ["k"]).collect()}
    assert details["ratio_endettement"].reason == "Non calculable : donnée(s) absente(s) — dettes financières." and details["autonomie_financiere"].shown == "25.0%"


def test_medians_of_sectors(spark):
    cases = spark.createDataFrame([CASE | {"k": k, "seg": s} for k, s in ((1, "a"), (2, "b"), (3, "c"))])
    medians = spark.createDataFrame([("a", "croissance_ca", 0.5), ("b", "croissance_ca", 0.01), ("b", "autonomie_financiere", 0.1)], "seg string, code string, median double")
    got = {r.k: (r.n_compared, r.axis3) for r in S.engine_axes(cases, ["k"], medians, "seg").collect()}
    assert got == {1: (1, 0.0), 2: (2, 100.0), 3: (5, 80.0)}
    assert S.engine_axes(cases, ["k"], medians.where("seg = 'a'").drop("seg")).first().n_compared == 1


def test_extract_and_score(spark):
    cols = "k int, " + ", ".join(f"{c} double" for c in CASE if c != "k")
    rows = [tuple([k] + [CASE[c] if not (k == 2 and c == "caf") else None for c in CASE if c != "k"]) for k in (1, 2, 3, 4)]
    full = {"BILAN_ACTIF": True, "BILAN_PASSIF": True, "CPC": True}
    facts = [(1, 94.4, full, {}, False, True, None), (2, 94.4, full, {}, False, True, None), (3, 40.0, {"CPC": True}, {"CAF": "estimated"}, False, True, None), (4, 0.0, {}, {}, True, True, None)]
    df = spark.createDataFrame(rows, cols).join(spark.createDataFrame(facts, "k int, completeness double, sections map<string,boolean>, states map<string,string>, failed boolean, admitted boolean, why_not string"), "k")
    given = spark.createDataFrame([(2, 3200.0)], "k int, caf double")
    got = {r.k: r for r in E.extract_and_score(df, ["k"], given).collect()}
    assert got[1].score is not None and got[1].block_reason is None and got[2].score == got[1].score  # the given value fills the gap
    assert got[3].score is None and got[3].axis1 == 85.0 and "complétude 40.0% (< 50%) ; sections absentes : BILAN_ACTIF, BILAN_PASSIF ; données non fiables : CAF (estimated)" in got[3].block_reason
    assert got[4].axis1 is None and got[4].risk_class == "Non évaluable"
    usable = {c: F.lit(c != "CAF") for c in E.CRITICAL_FIELDS}
    ok = E.eligibility_extraction(E.with_engine_ratios(df.where("k = 1")), usable, "forecast_review").first()
    assert ok.ineligible[0].endswith("CAF.") and len(ok.ineligible) == 2


def dataset(spark, **documents):
    """Datasets of confirmed amounts."""
    cell = lambda v: (D(str(v)), "confirmed", [], []) if v is not None else (None, "missing", [], [])
    rows = [(d, [], *(cell(f.get(c)) for c in DATASET)) for d, f in documents.items()]
    return spark.createDataFrame(rows, f"document_id string, warnings array<string>, {', '.join(f'{c} {R.FIELD}' for c in DATASET)}")


WHOLE = dict(
    CHIFFRE_AFFAIRES=38500, CHIFFRE_AFFAIRES_N1=34200, FONDS_PROPRES=6200, TOTAL_BILAN=24800, DETTES_FINANCIERES=11400, RESULTAT_NET=1480, CAF=3200, FDR=3600, TRESORERIE_NETTE=500, CLIENTS=8340, FOURNISSEURS=5600, ACHATS_TOTAL=31500,
    ENCOURS_LEASING=3200, CMT=8200, NOUVEAU_FINANCEMENT=4800, TOTAL_ACTIF=24800, TOTAL_PASSIF=24800,
)


def test_controls_that_pass_and_fail(spark):
    rows = dataset(
        spark, good=WHOLE | dict(TRESORERIE_ACTIF=600, TRESORERIE_PASSIF=100, PRODUITS_FINANCIERS=10, CHARGES_FINANCIERES=4, RESULTAT_FINANCIER=6.5), bad=WHOLE | dict(TOTAL_PASSIF=24000, TRESORERIE_ACTIF=600, TRESORERIE_PASSIF=50, RESULTAT_AVANT_IMPOT=2000, IMPOT_SUR_RESULTATS=100),
        bare=dict(TRESORERIE_ACTIF=6, TRESORERIE_PASSIF=1),
    )
    got = sorted((r.document_id, r.code, r.status, r.difference) for r in A.controls(rows).collect())
    assert got == [
        ("bad", "bilan_equilibre", "failed", D("-800.0000")), ("bad", "resultat_net", "failed", D("-420.0000")), ("bad", "tresorerie_nette", "failed", D("-50.0000")), ("bare", "bilan_equilibre", "not_testable", None),
        ("bare", "tresorerie_nette", "not_testable", None), ("good", "bilan_equilibre", "passed", D("0.0000")), ("good", "resultat_financier", "passed", D("0.5000")), ("good", "tresorerie_nette", "passed", D("0.0000")),
    ]
    bad = A.invalidate(A.with_controls(rows)).where("document_id = 'bad'").first()
    assert bad.TOTAL_BILAN.status == "conflicting" and bad.RESULTAT_NET.value is None and bad.CLIENTS.status == "confirmed"
    assert "Champ TOTAL_BILAN invalidé suite au contrôle bilan_equilibre." in bad.warnings


def test_controls_are_compiled(spark, capsys):
    from grandlivre.queries_filings import control_outcomes

    control_outcomes(spark, "/root/testdata/sf0.001").explain()
    assert "lambda" not in capsys.readouterr().out  # inside a lambda all eight controls would be interpreted for each row


def test_identities_are_fields(spark):
    from grandlivre.queries_filings import _identities

    rows = _identities(spark, "/root/testdata/sf0.001")
    whole = spark.range(1).select(R.make(F.lit(None), "missing").alias("f")).schema["f"].dataType.simpleString()
    assert {f.dataType.simpleString() for f in rows.schema if f.name not in ("document_id", "warnings")} == {whole}
    lost = A.invalidate(A.with_controls(rows)).where("TOTAL_ACTIF.status = 'conflicting'").first()
    assert lost.TOTAL_ACTIF.value is None and lost.TOTAL_ACTIF.warnings == ["control bilan_equilibre"] and lost.TOTAL_ACTIF.sources == []


def test_analysis(spark):
    rows = dataset(spark, good=WHOLE, alone=WHOLE, bad=WHOLE | dict(TOTAL_PASSIF=1), severe=WHOLE, poor={})
    metrics = [("good", 96.0, 38.0, 41, -4.2, 0, 0, 0, 0, 3), ("bad", 96.0, 38.0, 41, -4.2, 0, 0, 0, 0, 3), ("severe", 96.0, 38.0, 41, -4.2, 0, 0, 0, 0, 8)]
    behaviour = spark.createDataFrame(metrics, "document_id string, domiciliation double, overdraft double, debit_days int, gap double, leasing_delays int, incidents int, rejects int, unpaid int, bam int")
    medians = spark.createDataFrame([("t", c, m) for c, m in (("commercial_profitability", 4.0), ("financial_autonomy", 20.0), ("debt_ratio", 1.5), ("repayment_capacity", 3.0), ("ca_growth", 5.0))], "sector string, code string, median double")
    sectors = spark.createDataFrame([(d, "t") for d in ("good", "bad", "severe")], "document_id string, sector string")
    got = {r.document_id: r for r in A.analyse(rows, behaviour, medians, sectors).collect()}
    good = got["good"]
    assert (good.financial, good.behavioral, good.sector_score) == (80.8, 100.0, 40.0) and good.final == round(80.8 * 0.75 + 100 * 0.15 + 40 * 0.10, 2) and good.blocking == [] and good.risk_class == "B/B-"
    assert (got["alone"].final, got["alone"].blocking_status) == (80.8, "PARTIAL_DATA")
    assert got["bad"].final is None and got["bad"].blocking_status == "INSUFFICIENT_DATA" and any("invalidé" in b for b in got["bad"].blocking)
    assert got["severe"].blocking_status == "BLOCKING_CRITERIA" and got["severe"].decision == "Refus recommandé"
    assert got["poor"].final is None and len(got["poor"].blocking) == 6 and got["poor"].financial == 0.0
    review = {r.document_id: r for r in A.analyse(rows, mode="REVIEW").collect()}
    assert review["bad"].financial > 0 and review["bad"].final is None
    strict = A.analyse(dataset(spark, x=WHOLE | dict(PRODUITS_FINANCIERS=10, CHARGES_FINANCIERES=4, RESULTAT_FINANCIER=600)), vision=True).first()
    assert strict.blocking[-1] == "Contrôle comptable échoué : resultat_financier"
    values = R.dataset_values(rows)
    kpis = {r.document_id: (r.n_ratios, r.n_calculable, r.n_fields) for r in A.document_kpis(A.analyse(rows), values).collect()}
    assert kpis["good"] == (13, 13, len(WHOLE)) and kpis["poor"] == (13, 0, 0)
    cands = spark.createDataFrame([("good", "CAF"), ("good", "CAF"), ("other", "CMT")], "document_id string, field_code string")
    audit_rows = {r.document_id: r for r in A.mapping_audit(cands, values).collect()}
    assert audit_rows["good"].candidates_by_field == {"CAF": 2} and "CAF" in audit_rows["good"].resolved and audit_rows["other"].candidates_total == 1 and "CMT" in audit_rows["poor"].missing


def test_audit(spark):
    stats = spark.createDataFrame([("d", 2, 0, True, 90), ("d", 1, 50, False, 0), ("d", 3, 0, None, None)], "document_id string, page_number int, text_length int, is_blank boolean, declared_rotation int")
    row = audit.inspect_pages(stats).first()
    assert (row.n_pages, row.n_native, row.n_scanned, row.blank_pages, row.rotated_pages) == (3, 1, 1, [2], {2: 90})
    assert [(r.page_number, r.truncated) for r in audit.limit_pages(stats, 2).orderBy("page_number").collect()] == [(1, "truncated 2/3"), (2, "truncated 2/3")]
    pages = spark.createDataFrame([("d", "ok"), ("d", "error"), ("d", "skipped")], "document_id string, status string")
    counts = audit.extraction_counters(pages, spark.createDataFrame([("d", "processed"), ("e", "failed")], "document_id string, status string")).orderBy("document_id").collect()
    assert (counts[0].pages_total, counts[0].pages_ok, counts[0].pages_processed, counts[0].sections_processed, counts[1].sections_failed) == (3, 1, 2, 1, 1)
    regions = spark.createDataFrame(
        [("d", 1, 1, "CPC", ["a", "b"], {"x": "1", "y": "2"}, [("l", {"a": "1", "b": "2"})]), ("d", 1, 2, "AUTRE", ["b", "c"], {"x": "3"}, [("l", {"b": "2", "a": "1"}), ("l", {"a": "9"})]), ("d", 1, 3, None, None, None, None)],
        "document_id string, page int, ordinal int, page_type string, columns array<string>, metadata map<string,string>, rows array<struct<label:string,values:map<string,string>>>",
    )
    r = audit.merge_regions(regions).first()
    assert (r.page_type, r.columns, r.metadata, [(x.label, x["values"]) for x in r.rows]) == ("CPC", ["a", "b", "c"], {"x": "3", "y": "2"}, [("l", {"a": "1", "b": "2"}), ("l", {"a": "9"})])
    sides = spark.createDataFrame([("d", 1, " ", "A"), ("d", 2, "B", "C")], "document_id string, side int, name string, number string")
    assert tuple(audit.first_filled(sides, ["document_id"], "side", ["name", "number"]).first()) == ("d", "B", "A")
    turns = spark.createDataFrame([("a", 0, "", None), ("a", 270, "x", ""), ("a", 90, "y", None), ("b", 0, "z", ""), ("b", 90, "w", "v"), ("c", 0, "", None), ("c", 180, None, "")], "document_id string, rotation int, name string, number string")
    assert sorted((r.document_id, r.rotation, r.name, r.warning) for r in audit.best_rotation(turns, ["name", "number"]).collect()) == [("a", 90, "y", "rotated"), ("b", 0, "z", None), ("c", 0, "", "unreadable")]
    one = spark.range(1).select(audit.first_n(F.array(*map(F.lit, "abc")), 2).alias("a"), audit.first_n(F.lit(None).cast("array<string>")).alias("n"), audit.distinct_ordered(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b"))).alias("d")).first()
    assert (one.a, one.n, one.d) == (["a", "b"], [], ["b", "a"]) and audit.sorted_codes(pages, ["document_id"], "status").first().codes == ["error", "ok", "skipped"]
    assert A.merge_reasons is not None and spark.range(1).select(A.merge_reasons(F.array(F.lit("x"), F.lit("y")), F.lit(None).cast("array<string>"), F.array(F.lit("y"), F.lit("z")), most=2)).first()[0] == ["x", "y"]


def test_sources(spark, tmp_path):
    bundle = '{"document_id": "d", "pages": [{"page_number": 1, "status": "ok", "content": "é"}, {"page_number": 2, "status": "error", "content": "x"}, {"page_number": 3, "status": "ok", "content": "[PAGE VIDE]"}, {"page_number": 4, "status": "ok", "content": null}]}'
    (tmp_path / "pages.json").write_text(bundle)
    assert [(r.page_number, r.content) for r in documents.read_pages(spark, str(tmp_path / "pages.json")).collect()] == [(1, "é")]
    (tmp_path / "payloads.json").write_text('{"document_id": "d", "page": 1, "rows": [{"label": "a", "values": {"x": "1,00", "y": null}}]}')
    assert documents.read_payloads(spark, str(tmp_path / "payloads.json")).first().rows[0]["values"] == {"x": "1,00", "y": None}
    files = spark.createDataFrame([("a", 5, bytearray(b"%PDF-"), "application/pdf; x"), ("b", 0, bytearray(), "application/pdf"), ("c", 9, bytearray(b"%PDF"), "application/pdf"), ("d", 4, bytearray(b"GIF8"), "application/pdf"), ("e", 4, bytearray(b"%PDF"), "text/html"), ("f", 4, bytearray(b"%PDF"), None)], "path string, length long, content binary, content_type string")
    kept, out = documents.split_admitted(documents.admit(files, most_bytes=8, content_types=("application/pdf",)))
    assert [r.path for r in kept.collect()] == ["a"] and {r.path: r.reason for r in out.collect()} == {"b": "empty", "c": "too large", "d": "wrong magic", "e": "wrong type", "f": "wrong type"}
    entries = spark.createDataFrame([("z", "a/x.pdf", 2, 9), ("z", "b/y.pdf", 2, 10), ("z", "c\\\\X.PDF", 1, 1), ("w", "q.pdf", 1, 1)], "archive string, path string, pages int, size int")
    named = spark.createDataFrame([("z", "other/X.pdf"), ("w", "none.pdf")], "archive string, name string")
    assert {r.archive: (r.entry, r.n_entries) for r in documents.pick_archive_entry(entries).collect()} == {"z": ("b/y.pdf", 3), "w": ("q.pdf", 1)}
    assert {r.archive: r.entry for r in documents.pick_archive_entry(entries, named=named).collect()} == {"z": "a/x.pdf", "w": None}
    done, lost = spark.createDataFrame([("a", [str(i) for i in range(20)])], "name string, warnings array<string>"), spark.createDataFrame([("b", "broken")], "name string, error string")
    documents.write_json(documents.batch_summary(done, lost, "r1"), str(tmp_path / "out"), ["run_id"])
    back = {r.name: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert len(back["a"].warnings) == 8 and back["b"].error == "broken" and back["a"].run_id == "r1"


def test_sheets(spark, tmp_path):
    decisions = spark.createDataFrame([("b", 1.0, 2.0, None), ("a", 3.0, 4.0, 5.0), ("c", 1.0, 1.0, 1.0)], "k string, axis1 double, axis2 double, axis3 double")
    rows = spark.createDataFrame([("a", "y", 2), ("a", "x", 1)], "k string, code string, number int").withColumn("pos", F.col("number"))
    sheets = reports.export_sheets(decisions, rows, rows, rows, ["k"], reports.axes_rows(decisions, ["k"], reports.LEGACY_AXES))
    assert [(r.n, r.k) for r in sheets["Index"].orderBy("n").collect()] == [(1, "a"), (2, "b"), (3, "c")] and {(r.n, r.code) for r in sheets["Ratios"].collect()} == {(1, "x"), (2, "y")}
    legacy = reports.export_legacy_sheets(decisions, rows, decisions, rows, ["k"])
    assert set(legacy) == {"Synthese", "Elements_PCGM", "Donnees_financieres", "Ratios", "Axes"} and legacy["Donnees_financieres"].where("k = 'a'").orderBy("n").first().field == "axis1"
    assert {(r.code, r.contribution) for r in legacy["Axes"].where("k = 'b'").collect()} == {("Axe 1 — Financier", 0.75), ("Axe 2 — Comportemental", 0.3), ("Axe 3 — Sectoriel", 0.0)}
    reports.write_sheets(sheets, str(tmp_path / "book"))
    assert spark.read.option("header", True).csv(str(tmp_path / "book/Index")).count() == 3


def test_job_state(spark, tmp_path):
    at = lambda m: f"2024-01-01 10:{m:02d}:00"
    rows = [
        ("a", at(0), "job_started", None, None, None, None), ("a", at(1), "pages_rendered", None, None, 10, None), ("a", at(2), "page_extracted", 3, "CPC", None, None), ("a", at(3), "page_skipped", 4, "VIDE", None, None),
        ("b", at(0), "pages_rendered", None, None, 2, None), ("b", at(1), "page_failed", 1, "CPC", None, "bad"), ("b", at(2), "job_failed", None, None, None, "stopped"), ("c", at(0), "result_ready", None, None, None, None),
    ]
    events = spark.createDataFrame(rows, "job_id string, ts string, event string, page int, page_type string, count int, error string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.job_id: (r.step, r.pct, r.message, r.state, r.n_financial, r.n_skipped, r.n_failed, r.error) for r in jobs.job_state(events).collect()}
    assert got == {"a": ("extracting_page", 43, "Page 4/10 — VIDE", "processing", 1, 1, 0, None), "b": ("failed", 50, "Page 1/2 — CPC", "failed", 0, 0, 1, "stopped"), "c": ("completed", 100, "Analyse terminée", "completed", 0, 0, 0, None)}
    late = [("a", "2024-01-01 10:00:00", "x"), ("a", "2024-01-01 10:50:00", "y"), ("a", "2024-01-01 12:00:00", "late"), ("a", "2024-01-01 12:01:00", "later"), ("b", "2024-01-01 12:00:00", "x")]
    table = spark.createDataFrame(late, "job_id string, ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.job_id, r.event) for r in jobs.expire(table).collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_jobs_expire_by_timer_and_replay(spark, tmp_path):
    """A timer ends a job that nothing more comes for; a later reader gets exactly the last events, in order, and then live ones."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    minute = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    schema = "job_id string, ts timestamp, event string, reader string"
    batches = [
        [("a", minute(k / 1000), f"e{k:04d}", None) for k in range(700)] + [("b", minute(0), "only", None), ("c", minute(0), "x", None), ("c", minute(90), "too late", None)],
        [("a", minute(30), "subscribe", "r1"), ("a", minute(31), "page_extracted", None)],
        [("a", minute(75), "result_ready", None), ("a", minute(76), "after", None), ("a", minute(77), "subscribe", "r2"), ("d", minute(200), "x", None)],
        [("b", minute(201), "ignored", None), ("d", minute(202), "y", None)],
        [("d", minute(203), "z", None)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = jobs.live_events(stream, 3600, 500, "200 minutes" if n < 2 else "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    of = lambda job, kind, reader=None: sorted((r.n, r.event) for r in got if (r.job_id, r.kind, r.reader) == (job, kind, reader))
    assert of("a", "event") == [(k + 1, f"e{k:04d}") for k in range(700)] + [(701, "page_extracted"), (702, "result_ready"), (703, "after")]
    assert of("a", "replay", "r1") == [(k + 1, f"e{k:04d}") for k in range(200, 700)] and of("a", "event", "r1") == [(701, "page_extracted"), (702, "result_ready")]
    assert of("a", "replay", "r2") == [(k + 1, f"e{k:04d}") for k in range(203, 700)] + [(701, "page_extracted"), (702, "result_ready")] and not of("a", "event", "r2")
    ends = {r.job_id: r.ts.replace(tzinfo=None) for r in got if r.kind == "expired"}
    assert ends == {"a": minute(136), "b": minute(60), "c": minute(60)} and of("b", "event") == [(1, "only")] and of("c", "event") == [(1, "x")]
    assert of("d", "event") == [(1, "x"), (2, "y"), (3, "z")]


def test_streams_end_at_a_terminal_event(spark):
    rows = [("a", 1, 1, "page_extracted"), ("a", 2, 2, "result_ready"), ("a", 2, 3, "after"), ("b", 5, 1, "x"), ("c", 1, 1, "job_failed"), ("c", 1, 2, "job_failed")]
    events = spark.createDataFrame(rows, "job_id string, ts int, event_id int, event string")
    assert sorted((r.job_id, r.event_id) for r in jobs.until_terminal(events).collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    assert sorted((r.job_id, r.event_id, r.event) for r in jobs.terminal_once(events).collect()) == [("a", 2, "result_ready"), ("c", 1, "job_failed")]

