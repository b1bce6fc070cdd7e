"""Page, candidate and weighted scoring operators on small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from grandlivre.functions import pages as P
from grandlivre.functions.labels import label_similarity, normalize_label
from grandlivre.operators import candidates as K
from grandlivre.operators import classify as C
from grandlivre.operators import scoring as S
from grandlivre.operators import tables as T
from grandlivre.sources import reports
from grandlivre.streaming.rescore import apply_batch, latest, rescore


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_page_classification(spark):
    rows = [
        (1, 1, "Identification du contribuable\nRaison sociale : X"), (1, 2, "BILAN (ACTIF)\nImmobilisations corporelles"), (1, 3, "Stocks, capitaux propres"), (1, 4, "court"), (1, 5, "Détail des postes du CPC ; produits d'exploitation ; charges d’exploitation"),
        (1, 6, "rien de connu dans cette page"), (2, 1, "Chiffre d'affaires de la période"), (2, 2, None), (3, 1, "Capacité d'autofinancement"),
    ]
    df = spark.createDataFrame(rows, "d long, p int, t string")
    got = {(r.d, r.p): r.page_type for r in C.classify_pages(df, "d", "p", "t").collect()}
    assert got == {(1, 1): "IDENTIFICATION", (1, 2): "BILAN_ACTIF", (1, 3): "BILAN_ACTIF", (1, 4): None, (1, 5): "DETAIL_CPC", (1, 6): None, (2, 1): "CPC", (2, 2): None, (3, 1): "ESG"}
    assert C.classify_pages(df.where("false"), "d", "p", "t").count() == 0
    tries = lambda a, b: one(spark, C.types_to_try(F.lit(a), F.lit(b).cast("string")))[0]
    assert tries("CPC", "BILAN_ACTIF") == ["CPC", "BILAN_PASSIF", "BILAN_ACTIF"] and tries("AUTRE", None) == ["BILAN_ACTIF", "BILAN_PASSIF", "CPC"] and tries("IDENTIFICATION", None) == ["IDENTIFICATION", "BILAN_ACTIF", "BILAN_PASSIF"]


def test_simple_and_document_types(spark):
    simple = lambda t, v=False: one(spark, C.simple_page_type(F.lit(t).cast("string"), F.lit(v)))[0]
    assert [simple(x) for x in ("Bilan (Actif)", "annexe et provisions", "autre", " \n", None)] == ["BILAN_ACTIF", "PROVISIONS", "AUTRE", "BLANCHE", "BLANCHE"] and simple("", True) == "SCAN"
    df = spark.createDataFrame([(1, "Bilan (actif)"), (1, "bilan (passif)"), (2, "bilan (actif) Budget"), (3, None), (4, "Liasse fiscale"), (5, "bilan (actif)")], "d long, t string")
    got = {r.d: (r.document_type, r.period_type, r.confidence) for r in C.document_types(df, "d", "t").collect()}
    unknown = ("unknown", "unknown", 0.55)
    assert got == {1: ("financial_statements", "actual", 0.8), 2: ("forecast_financial_statements", "forecast", 0.9), 3: unknown, 4: ("tax_return", "actual", 0.75), 5: unknown}
    blank = lambda n, kind, b: one(spark, C.blank_or_other(F.repeat(F.lit("x"), F.lit(n)), F.lit(kind).cast("string"), F.lit(b).cast("boolean")))[0]
    assert (blank(5, None, None), blank(40, None, True), blank(20, None, False), blank(20, "CPC", True)) == ("VIDE", "AUTRE", "AUTRE", "VIDE")


def test_page_text(spark):
    get = lambda c: one(spark, c)[0]
    assert get(P.clean_text(F.lit(" a \t b\r\n\r\n\r\n\r\nc "))) == "a b\n\nc" and get(P.clean_text(F.lit(None).cast("string"))) == ""
    assert get(P.amounts_in(F.lit("ventes 10 472 949,06 et -3,50 puis 12"))) == ["10 472 949,06", "-3,50"]
    assert list(one(spark, *P.company_number(F.lit(" 25725 / RABAT ")))) == ["25725", "RABAT"] and list(one(spark, *P.company_number(F.lit(None).cast("string")))) == ["", ""]
    assert get(P.table_quality(F.lit("|a|b|\n|1|2|\n|3|\nx"))) == pytest.approx(2 / 3) and get(P.table_quality(F.lit("  |a|b| \n x"))) == 1.0 and get(P.table_quality(F.lit("a\nb\nc\nd"))) == 0.5 and get(P.table_quality(F.lit(None).cast("string"))) == 0.0
    long = "\n".join(["ligne de texte sans tableau " * 2] * 5)
    assert [get(P.insufficient_text(F.lit(x))) for x in ("[PAGE VIDE]", "court", long)] == [False, True, False]
    assert get(P.merge_overlap(F.lit("a\nB  c\nd"), F.lit("b C\nD\ne"))) == "a\nB  c\nd\ne" and get(P.merge_overlap(F.lit("a"), F.lit("b"))) == "a\nb"
    assert get(P.merge_overlap(F.lit(None).cast("string"), F.lit("b"))) == "b" and get(P.merge_overlap(F.lit("a"), F.lit("A"))) == "a"
    assert [get(P.format_size(F.lit(x))) for x in (12, 2048, 3 << 20)] == ["12 o", "2.0 Ko", "3.0 Mo"]
    assert [get(P.format_ratio(F.lit(v).cast("double"), F.lit(u))) for v, u in ((0.253, "%"), (64.0, "j"), (1.5, "x"), (2.0, "ans"), (None, "%"))] == ["25.3%", "64 j", "1.50x", "2.00 ans", "n/c"]
    assert get(P.needs_vision(F.lit(500), F.lit(0.1), F.lit(8), F.lit(20))) and not get(P.needs_vision(F.lit(500), F.lit(0.1), F.lit(8), F.lit(19))) and get(P.needs_vision(F.lit(None).cast("int"), F.lit(0.1), F.lit(0), F.lit(0)))


def test_candidates(spark):
    df = spark.createDataFrame([(1, 100.0, 100.5), (2, 100.0, 200.0), (3, None, 5.0), (4, None, None)], "d long, a double, b double")
    assert [(r.balance, r.balance_status) for r in K.resolve_balance(df, "a", "b").orderBy("d").collect()] == [(100.0, "confirmed"), (None, "conflicting"), (5.0, "derived"), (None, "missing")]
    rows = [(1, 10.0, 10.0, None, None), (2, 10.0, 10.0, None, 500.0), (3, 10.0, 50.0, None, 50.0), (4, 10.0, 50.0, 10.0, None), (5, 10.0, None, 20.0, 90.0), (6, None, None, 20.0, None), (7, None, None, None, None)]
    out = K.resolve_net_result(spark.createDataFrame(rows, "d long, a double, b double, c double, e double"), "a", "b", "c", "e").orderBy("d").collect()
    assert [(r.net_result, r.net_status, r.net_warning) for r in out] == [
        (10.0, "confirmed", None), (10.0, "confirmed", "balance_differs"), (50.0, "confirmed", "lines_differ"), (None, "conflicting", "lines_differ"), (90.0, "confirmed", "income_differs"), (20.0, "confirmed", None), (None, "missing", None),
    ]
    tiers = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 1, "z"), (2, None, "w")], "d long, n int, v string")
    assert sorted(r.v for r in K.prefer_tier(tiers, ["d"], F.col("n")).collect()) == ["y", "z"]
    labels = spark.createDataFrame([(1, "Total chiffre d'affaires"), (2, "inconnu"), (3, None), (4, "Stocks")], "i long, l string")
    aliases = spark.createDataFrame([("CA", "chiffre d affaires", 0), ("ST", "stocks", 1), ("ST2", "STOCKS", 2)], "code string, alias string, pos int")
    assert {r.i: r.code for r in K.match_labels(labels, "l", aliases).collect()} == {1: "CA", 2: None, 3: None, 4: "ST"}


def test_weighted_decision_with_all_axes(spark):
    base = dict(k=1, domiciliation=96.0, overdraft=38.0, debit_days=41, gap=-4.2, leasing_delays=0, incidents=0, rejects=0, unpaid=0, bam=3)
    rows = [base, base | dict(k=2, bam=7), base | dict(k=3, overdraft=None, debit_days=None, gap=None), base | dict(k=4, domiciliation=60.0, unpaid=1)]
    schema = "k long, domiciliation double, overdraft double, debit_days int, gap double, leasing_delays int, incidents int, rejects int, unpaid int, bam int"
    got = {r.k: (r.behavioral, r.behavioral_ok, r.blocking) for r in S.weighted_behaviour(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {1: (100.0, True, []), 2: (100.0, False, ["BAM"]), 3: (0.0, False, []), 4: (72.0, False, ["impayés"])}
    ratios = spark.createDataFrame([(1, "s", "debt_ratio", 1.0), (1, "s", "ca_growth", 1.0), (1, "s", "financial_autonomy", 30.0), (2, "s", "debt_ratio", 1.0)], "k long, seg string, code string, value double")
    medians = spark.createDataFrame([("s", "debt_ratio", 1.5), ("s", "ca_growth", 5.0), ("s", "financial_autonomy", 20.0)], "seg string, code string, median double")
    assert {r.k: (r.sector_score, r.sector_ok) for r in S.weighted_sector(ratios, ["k"], medians, "seg").collect()} == {1: (66.67, True), 2: (0.0, False)}
    cases = [
        (1, 80.0, True, 100.0, True, 60.0, True, []), (2, 80.0, True, None, None, None, None, None), (3, 40.0, False, 100.0, True, 60.0, True, []), (4, 30.0, True, 0.0, False, 60.0, True, ["BAM"]), (5, 95.0, True, 0.0, False, 60.0, True, ["rejets"]),
    ]
    df = spark.createDataFrame(cases, "k long, financial double, financial_ok boolean, behavioral double, behavioral_ok boolean, sector_score double, sector_ok boolean, blocking array<string>")
    out = {r.k: (r.final, r.risk_class, r.blocking_status) for r in S.credit_decision(S.final_score(df, True)).collect()}
    assert out == {1: (81.0, "A/B+", None), 2: (80.0, "A/B+", "PARTIAL_DATA"), 3: (None, "NON_EVALUABLE", "INSUFFICIENT_DATA"), 4: (33.53, "D/F", "BLOCKING_CRITERIA"), 5: (90.88, "NON_EVALUABLE", "INSUFFICIENT_DATA")}
    assert {r.k for r in S.final_score(df, False).where("final is not null").collect()} == {1}


def test_tables_and_chunks(spark):
    text = "titre\n| poste | N | N-1 |\n|---|---|---|\n| Ventes | 10,00 | |\n|  | 5,00 | 1,00 |\n| Stocks | 3,00 | 2,00 | x |\nsuite\n| a | b |\n| c | d |"
    df = spark.createDataFrame([(1, text), (2, None), (3, "|seul|"), (4, "")], "d long, t string")
    got = sorted(tuple(r) for r in T.parse_tables(df, ["d"], "t").fillna("null").collect())
    assert got == sorted([(1, 1, 2, "Ventes", "N", "10,00"), (1, 1, 2, "Ventes", "N-1", "null"), (1, 1, 4, "Stocks", "N", "3,00"), (1, 1, 4, "Stocks", "N-1", "2,00"), (1, 1, 4, "Stocks", "col_3", "x"), (1, 2, 1, "c", "b", "d")])
    cut = lambda t, n: one(spark, T.chunks(F.lit(t).cast("string"), n))[0]
    assert cut("aa\nbb\ncccccccc\nd", 5) == ["aa\nbb", "cccccccc", "d"] and cut(None, 5) == [] and cut("", 5) == [] and cut("abc", 1) == ["abc"]


def test_rescore(spark, tmp_path):
    """Touched keys are replaced, others stay, the size does not grow with batches, and a batch that runs twice changes nothing."""
    values = spark.createDataFrame([(k, float(k)) for k in range(200)], "k long, v double")
    out = str(tmp_path / "out")
    values.limit(0).select("k").write.parquet(str(tmp_path / "in"))
    score = lambda factor: lambda keys: keys.join(values, "k").withColumn("v", F.col("v") * factor)

    def run(factor, keys):
        spark.createDataFrame([(k,) for k in keys], "k long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
        rescore(stream, ["k"], score(factor), out, str(tmp_path / "check"), 4).trigger(availableNow=True).start().awaitTermination()
        return {r.k: r.v for r in latest(spark, out).collect()}

    size = lambda: sum(f.stat().st_size for f in (tmp_path / "out").rglob("*.parquet"))
    want = {k: float(k) for k in range(200)}
    assert run(1, [*range(200), 5, 5]) == want
    sizes = []
    for n in range(5):
        want |= {k: k * 2.0 + n * k for k in range(n, 200, 9)}
        assert run(2 + n, range(n, 200, 9)) == want
        sizes.append(size())
    assert max(sizes[1:]) <= sizes[0] * 1.2
    before, keys = latest(spark, out).collect(), spark.createDataFrame([(3,), (900,)], "k long")
    apply_batch(keys, 5, ["k"], score(100), out, 4)  # published already
    assert sorted(latest(spark, out).collect()) == sorted(before)
    apply_batch(keys, 6, ["k"], score(100), out, 4)
    assert {r.k: r.v for r in latest(spark, out).collect()} == want | {3: 300.0}
    gone = [k for k in range(200)]
    apply_batch(spark.createDataFrame([(k,) for k in gone], "k long"), 7, ["k"], lambda keys: score(1)(keys).where("k = 7"), out, 4)
    assert [tuple(r) for r in latest(spark, out).collect()] == [(7, 7.0)]


def test_long_documents_are_one_scan(spark):
    rows = spark.range(100_000).select(F.lit("d").alias("d"), F.col("id").alias("p"), F.when(F.col("id") == 0, "bilan passif capitaux propres").when(F.col("id") == 99_999, "rien de connu ici").otherwise("immobilisations corporelles et capitaux propres").alias("t"))
    out = C.classify_pages(rows.repartition(5), "d", "p", "t")
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page_type, r["count"]) for r in out.groupBy("page_type").count().collect()} == {("BILAN_PASSIF", 99_999), (None, 1)}


def test_matching_equals_the_nested_loop(spark):
    rng = random.Random(4)
    words = ["dettes", "de", "financement", "clients", "et", "comptes", "rattaches", "ca", "a", "total", "capitaux", "propres", "stocks", "ab", "abc"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    names = [text(5) for _ in range(150)] + ["", "Créances clients", "x", "--"]
    aliases = [(f"c{i % 40}", text(4), i) for i in range(120)] + [("e", "", 500), ("short", "c", 501), ("long", "dettes de financement clients et comptes", 502)]
    names += ["dettes de financement clients et compte", "ca", "abcab"]
    rows, table = spark.createDataFrame(list(enumerate(names)), "i int, l string"), spark.createDataFrame(aliases, "code string, alias string, pos int")
    for least in (0.5, 0.7, 0.9):
        every = rows.select("i", normalize_label(F.col("l")).alias("a")).crossJoin(table.select("code", normalize_label(F.col("alias")).alias("b"), "pos")).withColumn("s", label_similarity(F.col("a"), F.col("b"))).where(F.col("s") >= least)
        want = {r.i: (r.b.code, r.b.s) for r in every.groupBy("i").agg(F.min(F.struct((-F.col("s")).alias("m"), "pos", "code", "s")).alias("b")).collect()}
        got = {r.i: (r.code, r.similarity) for r in K.match_labels(rows, "l", table, least).collect()}
        assert got == {i: want.get(i, (None, None)) for i in range(len(names))}
    many = spark.range(20_001).select(F.concat(F.lit("c"), F.col("id")).alias("code"), F.concat(F.lit("compte numero "), F.col("id")).alias("alias"), F.col("id").alias("pos"))
    one = spark.createDataFrame([(1, "Compte numéro 20000"), (2, "rien")], "i int, l string")
    assert {r.i: r.code for r in K.match_labels(one, "l", many).collect()} == {1: "c20000", 2: None}


def test_sheets(spark, tmp_path):
    decisions = spark.createDataFrame([(1, 83.0, "A/B+")], "k long, score double, risk_class string")
    long = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0)], "k long, code string, value double")
    sheets = reports.export_sheets(decisions, long, long, long.where("false"), ["k"])
    assert sorted((r.code, r.n) for r in sheets["Ratios"].collect()) == [("a", 1), ("b", 2)]
    reports.write_sheets(sheets, str(tmp_path))
    back = spark.read.option("header", True).csv(str(tmp_path / "Synthese"))
    assert sorted((r.field, r.value) for r in back.collect()) == [("risk_class", "A/B+"), ("score", "83.0")]
