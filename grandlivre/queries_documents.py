"""Registered queries of page, candidate and weighted scoring operators, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pages as P
from .operators import candidates as K
from .operators import classify as C
from .operators import ratios as R
from .operators import resolve as W
from .operators import scoring as S
from .operators import tables as T
from .plans.statements import ST_SQL, statements
from .sources.reports import numbered
from .sources.scratch import dealt, written_once

KEYS = ["k", "y"]
# Marker words of the generated texts, so that every rule is met; the fixed markers are exercised by tests.
WORDS = [("EN", ["the", "of", "and", "with"], 3), ("DE", ["der", "die", "ung", "ver"], 4), ("FR", ["que", "eau", "ment"], 3), ("ES", ["cion", "dad"], 1)]
GOES_ON = {"EN": ["ing", "to"], "DE": ["sch", "keit"], "FR": ["tion", "le"]}
DOC_WORDS = [("first", "a", 0.9, ["license"], []), ("second", "b", 0.8, ["http"], []), ("third", "c", 0.75, [], ["the", "ing"])]
PAGE_WORDS = [("LICENCE", ["license"]), ("LINK", ["http", "www."]), ("ENGLISH", [" the "])]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_pages(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", WORDS, GOES_ON, "ES")


def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_types(_read(spark, sf_dir, "conversations"), "conv_id", "text", DOC_WORDS)


def simple_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", C.simple_page_type(F.col("text"), F.col("doc_id") % 2 == 0, PAGE_WORDS).alias("page_type"))


def page_text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    out = _read(spark, sf_dir, "documents").withColumn("words", F.size(F.split(F.coalesce(text, F.lit("")), " ")))
    vision = P.needs_vision(F.length(text), (F.col("doc_id") % 10) / 10.0, F.col("doc_id") % 12, F.col("words"))
    return out.select("doc_id", F.round(P.table_quality(text), 6).alias("quality"), P.insufficient_text(text).alias("insufficient"), vision.alias("vision"))


def overlapping_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in two parts that share up to forty lines, and joined again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(text, r"^\s+|\s+$", "").alias("t"))
    lines, n = F.split("t", "\n"), F.size(F.split("t", "\n"))
    half, shared = (n / 2).cast("int"), F.least(F.lit(40), (n / 4).cast("int"))
    top, bottom = F.array_join(F.slice(lines, F.lit(1), half + shared), "\n"), F.replace(F.array_join(F.slice(lines, half + 1, n), "\n"), F.lit(" "), F.lit("  "))
    return docs.select("doc_id", F.size(F.split(P.merge_overlap(top, bottom), "\n")).cast("long").alias("n_lines"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = statements(spark, sf_dir).withColumn("other", F.when(F.col("k") % 3 == 0, F.col("ta")).when(F.col("k") % 3 == 1, F.col("tp")))
    return K.resolve_balance(st, "ta", "other").select(*KEYS, F.col("balance").cast("double").alias("balance"), "balance_status")


def net_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rn = F.col("k"), F.col("rn")
    st = statements(spark, sf_dir).select(*KEYS, rn.alias("xiii"), F.when(k % 4 == 0, rn).when(k % 4 == 1, rn + 5000).alias("xvi"), F.when(k % 3 > 0, rn).alias("income"), F.when(k % 5 > 1, F.when(k % 2 == 0, rn).otherwise(rn + 7000)).alias("balance"))
    out = K.resolve_net_result(st, "xiii", "xvi", "income", "balance")
    return out.select(*KEYS, F.col("net_result").cast("double").alias("net_result"), "net_status", "net_warning")


def preferred_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity")
    tier = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).when(F.col("l_quantity") > 10, 2)
    return K.prefer_tier(rows, ["l_orderkey"], tier).select("l_orderkey", "l_linenumber", "l_returnflag")


def dense_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("code")).agg(F.max(F.col("l_quantity").cast("double")).alias("value")).withColumn("status", F.lit("confirmed"))
    return K.densify(rows, ["l_orderkey"], ["A", "N", "R"])


def matched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part")
    aliases = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("alias"), F.col("n_nationkey").alias("pos"))
    rows = parts.crossJoin(F.broadcast(aliases.where("pos = 7").select(F.col("alias").alias("one")))).select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", "one")).otherwise(F.col("p_name")).alias("label"))
    return K.match_labels(rows, "label", aliases).select("p_partkey", "code", F.round("similarity", 6).alias("similarity"))


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    n = lambda test: F.count_if(test).cast("int")
    events = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(
        n((kind == "error") & (value > 97)).alias("incidents"), n((kind == "error") & (value > 98)).alias("rejects"), n((kind == "error") & (value > 99)).alias("unpaid"),
        (n(kind == "purchase") * 5).alias("domiciliation"), (n(kind == "click") * 4).alias("overdraft"), (n(kind == "error") * 6).alias("debit_days"), (n(kind == "view") - 8).alias("gap"),
    )
    return events.withColumns({"leasing_delays": F.when(F.col("k") % 3 > 0, F.lit(0)), "overdraft": F.when(F.col("k") % 4 > 0, F.col("overdraft")), "bam": (F.col("k") % 12).cast("int")})


def weighted_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.weighted_behaviour(_behaviour(spark, sf_dir), ["k"])
    return out.select("k", "behavioral", "behavioral_ok", F.array_join("blocking", ",").alias("blocking"))


def _sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only compared ratios, written once: they give the medians and then meet them."""
    ratios = R.weighted_values(W.with_previous(statements(spark, sf_dir), "k", "y", "ca", "ca_n1"), [*KEYS, "seg"], [c for c, _ in S.SECTOR])
    ratios = written_once(ratios.where("value is not null"), "ratios")
    return S.weighted_sector(ratios, KEYS, W.sector_medians(ratios, "seg"), "seg")


def weighted_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sector(spark, sf_dir)


def complete_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    sector = _sector(spark, sf_dir)
    st = W.with_previous(statements(spark, sf_dir), "k", "y", "ca", "ca_n1")
    axis = S.weighted_axis(st, KEYS).select(*KEYS, F.col("financial").cast("double").alias("financial"), F.col("calculable").alias("financial_ok"))
    case = axis.join(sector, KEYS, "left").join(S.weighted_behaviour(_behaviour(spark, sf_dir), ["k"]), "k", "left")
    return S.credit_decision(S.final_score(case, True)).select(*KEYS, "final", "partial", "risk_class", "decision", "blocking_status")


def parsed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems printed as one table an order between other lines, and read back."""
    rows = dealt(_read(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", F.format_string("| %d | %s |  | %s |", F.col("l_linenumber").cast("int"), "l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("line"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "line")))["line"]
    head = F.array(F.lit("avant | après"), F.lit("| n | flag | vide |"), F.lit("|---|:--|---|"))
    text = F.array_join(F.concat(head, lines, F.array(F.lit("fin"))), "\n")
    return T.parse_tables(rows.groupBy("l_orderkey").agg(text.alias("text")), ["l_orderkey"], "text")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 400)).alias("chunk", "t"))
    return parts.select("doc_id", "chunk", F.length("t").cast("long").alias("n_chars"))


def ratio_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = statements(spark, sf_dir).withColumns({"leasing": F.col("ta"), "cmt": F.col("tp"), "operation": F.col("clients")})
    out = R.weighted_ratios(W.with_previous(st, "k", "y", "ca", "ca_n1"), KEYS)
    return numbered(out.select(*KEYS, "code", "status"), KEYS, ["code"])


QUERIES = [
    page_types, document_types, simple_page_types, page_text_checks, overlapping_pages, balances, net_results, preferred_candidates, dense_fields, matched_labels, weighted_behaviour, weighted_sector, complete_decision,
    parsed_tables, text_chunks, ratio_sheet,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql(weighted: str, folded: str, similar: str) -> dict[str, str]:
    """SQL by query; the weighted ratios, the normal form of a label and the similarity are those of the accounting queries."""
    count = lambda words, t: "(" + " + ".join(f"CAST(contains({t}, '{w}') AS INT)" for w in words) + ")"
    label = f"trim({folded.format(chr(39) + chr(39) + ' || coalesce(text, ' + chr(39) + chr(39) + ')')})"
    scores = ", ".join(f"{count(w, 't')} s{i}" for i, (_, w, _) in enumerate(WORDS))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(WORDS))) + ")"
    pick = "CASE WHEN s3 > 0 THEN 'ES' " + " ".join(f"WHEN s{i} = {best} THEN '{n}'" for i, (n, _, _) in enumerate(WORDS)) + " END"
    least = "CASE " + " ".join(f"WHEN kind = '{n}' THEN {m}" for n, _, m in WORDS) + " END"
    on = " OR ".join(f"(r.last = '{n}' AND {count(w, 's.t')} > 0)" for n, w in GOES_ON.items())
    choose = "CASE WHEN s.kind IS NOT NULL AND s.weak AND ({on}) THEN r.last ELSE s.kind END"
    any_ = lambda w, t: f"coalesce(bool_or({' OR '.join(f'contains(lower({t}), {chr(39)}{x}{chr(39)})' for x in w)}), false)"
    doc_when = lambda k, other: "CASE " + " ".join(f"WHEN {' AND '.join(any_([x], 'text') for x in every) if every else any_(some, 'text')} THEN {r[k]!r}" for r in DOC_WORDS for some, every in [r[3:5]]) + f" ELSE {other} END"
    page_when = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{x}{chr(39)})' for x in w)} THEN '{n}'" for n, w in PAGE_WORDS)
    agree = lambda a, b: f"abs({a} - {b}) <= greatest(1, abs({a}) * 0.0001)"
    points = """CASE WHEN dom >= 80 THEN 20 WHEN dom >= 60 THEN 12 ELSE 4 END + CASE WHEN odr IS NULL THEN 0 WHEN odr <= 40 THEN 15 WHEN odr <= 70 THEN 8 ELSE 0 END
      + CASE WHEN debit <= 45 THEN 15 WHEN debit <= 90 THEN 8 ELSE 0 END + CASE WHEN abs(gap) <= 5 THEN 15 WHEN abs(gap) <= 15 THEN 8 ELSE 0 END + CASE WHEN k % 3 > 0 THEN 15 ELSE 0 END
      + CASE WHEN inc = 0 AND rej = 0 AND unp = 0 THEN 20 ELSE 0 END"""
    behaviour = f"""e AS (SELECT user_id k, count(*) FILTER (event_type = 'error' AND value > 97) inc, count(*) FILTER (event_type = 'error' AND value > 98) rej, count(*) FILTER (event_type = 'error' AND value > 99) unp,
        count(*) FILTER (event_type = 'purchase') * 5 dom, CASE WHEN user_id % 4 > 0 THEN count(*) FILTER (event_type = 'click') * 4 END odr, count(*) FILTER (event_type = 'error') * 6 debit,
        count(*) FILTER (event_type = 'view') - 8 gap FROM events GROUP BY user_id),
      f AS (SELECT k, {points} p, 70 + CASE WHEN odr IS NULL THEN 0 ELSE 15 END + CASE WHEN k % 3 > 0 THEN 15 ELSE 0 END c,
        concat_ws(',', CASE WHEN k % 12 IN (7, 8, 9) THEN 'BAM' END, CASE WHEN inc > 0 THEN 'incidents' END, CASE WHEN unp > 0 THEN 'impayés' END, CASE WHEN rej > 0 THEN 'rejets' END) blocking FROM e),
      bh AS (SELECT k, CAST(CASE WHEN c >= 70 THEN p ELSE 0 END AS DOUBLE) behavioral, c >= 70 AND blocking = '' behavioral_ok, blocking FROM f)"""
    lower = ", ".join(f"'{c}'" for c, up in S.SECTOR if not up)
    wanted = ", ".join(f"'{c}'" for c, _ in S.SECTOR)
    sector = f"""md AS (SELECT seg, code, median(value) med FROM w WHERE value IS NOT NULL GROUP BY 1, 2),
      sc AS (SELECT k, y, count(*) n, count(*) FILTER (CASE WHEN w.code IN ({lower}) THEN value <= med ELSE value >= med END) b FROM w JOIN md ON w.seg = md.seg AND w.code = md.code
        WHERE w.code IN ({wanted}) AND value IS NOT NULL GROUP BY k, y),
      se AS (SELECT k, y, CASE WHEN n >= 3 THEN round(b * 100.0 / n, 2) ELSE 0 END::DOUBLE sector_score, n >= 3 sector_ok FROM sc)"""
    essential = ", ".join(f"'{w[0]}'" for w in R.WEIGHTED if w[5])
    grid = lambda place, other: "CASE " + " ".join(f"WHEN final >= {g[0]} THEN '{g[place]}'" for g in S.GRID) + f" ELSE '{other}' END"
    lines = r"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    table = f"list_filter({lines.format(t='t')}, lambda x: starts_with(x, '|') AND ends_with(x, '|'))"
    return {
        "page_types": f"""WITH RECURSIVE a AS (SELECT conv_id, turn, {label} t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) n FROM conversations), b AS (SELECT *, {scores} FROM a),
          c AS (SELECT *, {best} best, CASE WHEN length(t) >= 12 AND {best} > 0 THEN {pick} END kind FROM b), s AS (SELECT *, kind <> 'ES' AND best < {least} weak FROM c),
          r AS (SELECT conv_id, turn, n, kind AS page_type, kind AS last FROM s WHERE n = 1 UNION ALL
            SELECT s.conv_id, s.turn, s.n, {choose.format(on=on)}, coalesce({choose.format(on=on)}, r.last) FROM r JOIN s ON s.conv_id = r.conv_id AND s.n = r.n + 1)
          SELECT conv_id, turn, page_type FROM r""",
        "document_types": f"SELECT conv_id, {doc_when(0, repr('unknown'))} AS document_type, {doc_when(1, repr('unknown'))} AS period_type, CAST({doc_when(2, 0.55)} AS DOUBLE) AS confidence FROM conversations GROUP BY conv_id",
        "simple_page_types": f"SELECT doc_id, CASE WHEN coalesce(regexp_replace(text, '\\s+', '', 'g'), '') = '' THEN CASE WHEN doc_id % 2 = 0 THEN 'SCAN' ELSE 'BLANCHE' END {page_when} ELSE 'AUTRE' END AS page_type FROM documents",
        "page_text_checks": f"""WITH d AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') t FROM documents), l AS (SELECT *, {lines.format(t="t")} ls, {table} tl FROM d),
          q AS (SELECT *, CASE WHEN len(tl) = 0 THEN CASE WHEN len(ls) >= 4 THEN 0.5 ELSE 0 END::DOUBLE
            ELSE list_max(map_values(list_histogram(list_transform(tl, lambda x: length(x) - length(replace(x, '|', '')))))) / len(tl)::DOUBLE END q FROM l)
          SELECT doc_id, round(q, 6) quality, t <> '[PAGE VIDE]' AND (length(t) < 120 OR len(ls) < 4 OR (len(tl) >= 3 AND q < 0.7)) insufficient,
            coalesce(length(text), 0) < 40 OR doc_id % 10 >= 5 OR (doc_id % 12 >= 8 AND len(string_split(coalesce(text, ''), ' ')) >= 20) vision FROM q""",
        "overlapping_pages": r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10)) ls FROM documents), h AS (SELECT *, len(ls) // 2 half, least(40, len(ls) // 4) shared FROM d),
          p AS (SELECT doc_id, regexp_replace(array_to_string(ls[1:half + shared], chr(10)), '^\s+|\s+$', '', 'g') a, regexp_replace(array_to_string(ls[half + 1:], chr(10)), '^\s+|\s+$', '', 'g') b FROM h),
          l AS (SELECT doc_id, CASE WHEN a = '' THEN [] ELSE list_transform(string_split(lower(a), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) END a,
            CASE WHEN b = '' THEN [] ELSE list_transform(string_split(lower(b), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) END b FROM p)
          SELECT doc_id, greatest(1, len(a) + len(b) - coalesce(list_max(list_filter(range(1, least(30, len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[1:k])), 0))::BIGINT n_lines FROM l""",
        "balances": f"""WITH {ST_SQL}, cand AS (SELECT k, y, ta a, CASE WHEN k % 3 = 0 THEN ta WHEN k % 3 = 1 THEN tp END b FROM st)
          SELECT k, y, CAST(CASE WHEN a IS NULL OR b IS NULL OR {agree('a', 'b')} THEN coalesce(a, b) END AS DOUBLE) balance,
            CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN a IS NULL OR b IS NULL THEN 'derived' WHEN {agree('a', 'b')} THEN 'confirmed' ELSE 'conflicting' END balance_status FROM cand""",
        "net_results": f"""WITH {ST_SQL}, cand AS (SELECT k, y, rn a, CASE WHEN k % 4 = 0 THEN rn WHEN k % 4 = 1 THEN rn + 5000 END b, CASE WHEN k % 3 > 0 THEN rn END c, CASE WHEN k % 5 > 1 THEN CASE WHEN k % 2 = 0 THEN rn ELSE rn + 7000 END END d FROM st),
          v AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN {agree('a', 'b')} THEN a ELSE d END WHEN {agree('c', 'd')} THEN c ELSE coalesce(d, c) END v FROM cand)
          SELECT k, y, CAST(v AS DOUBLE) net_result, CASE WHEN v IS NOT NULL THEN 'confirmed' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'conflicting' ELSE 'missing' END net_status,
            CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN NOT ({agree('a', 'b')}) THEN 'lines_differ' WHEN NOT ({agree('a', 'd')}) THEN 'balance_differs' END
              WHEN NOT ({agree('c', 'd')}) THEN 'income_differs' END net_warning FROM v""",
        "preferred_candidates": """WITH t AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 1 WHEN l_quantity > 10 THEN 2 END tier FROM lineitem)
          SELECT l_orderkey, l_linenumber, l_returnflag FROM t QUALIFY tier = min(tier) OVER (PARTITION BY l_orderkey)""",
        "dense_fields": """WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), v AS (SELECT l_orderkey, l_returnflag code, CAST(max(l_quantity) AS DOUBLE) v FROM lineitem GROUP BY 1, 2)
          SELECT o.l_orderkey, c.code, v AS value, CASE WHEN v IS NULL THEN 'missing' ELSE 'confirmed' END AS status FROM o CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(code) LEFT JOIN v ON v.l_orderkey = o.l_orderkey AND v.code = c.code""",
        "matched_labels": f"""WITH a AS (SELECT n_nationkey code, trim({folded.format('n_name')}) b FROM nation), p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || (SELECT n_name FROM nation WHERE n_nationkey = 7) ELSE p_name END l FROM part),
          n AS (SELECT p_partkey, trim({folded.format('l')}) a FROM p), s AS (SELECT p_partkey, code, CAST({similar.format(a='n.a', b='a.b')} AS DOUBLE) s FROM n CROSS JOIN a),
          m AS (SELECT p_partkey, max_by(code, struct_pack(s := s, p := -code)) code, max(s) s FROM s WHERE s >= 0.7 GROUP BY 1)
          SELECT n.p_partkey, m.code, round(m.s, 6) similarity FROM n LEFT JOIN m ON n.p_partkey = m.p_partkey""",
        "parsed_tables": """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag f, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) q FROM lineitem),
          r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, f, q) + 1 n FROM l)
          SELECT l_orderkey, CAST(1 AS INTEGER) AS block, CAST(n AS INTEGER) AS row, CAST(l_linenumber AS VARCHAR) AS label, c.name AS column, CASE c.name WHEN 'flag' THEN f WHEN 'col_3' THEN q END AS value
          FROM r CROSS JOIN (VALUES ('flag'), ('vide'), ('col_3')) c(name)""",
        "text_chunks": """WITH RECURSIVE l AS (SELECT doc_id, u.n, length(u.line) len FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n) u WHERE text <> ''),
          r AS (SELECT doc_id, n, 0 AS chunk, len AS size FROM l WHERE n = 1 UNION ALL
            SELECT l.doc_id, l.n, r.chunk + CASE WHEN r.size + 1 + l.len <= 400 THEN 0 ELSE 1 END, CASE WHEN r.size + 1 + l.len <= 400 THEN r.size + 1 + l.len ELSE l.len END FROM r JOIN l ON l.doc_id = r.doc_id AND l.n = r.n + 1)
          SELECT doc_id, chunk, max(size)::BIGINT AS n_chars FROM r GROUP BY 1, 2""",
        "ratio_sheet": f"{weighted} SELECT k, y, code, status, CAST(row_number() OVER (PARTITION BY k, y ORDER BY code) AS INTEGER) n FROM w",
        "weighted_behaviour": f"WITH {behaviour} SELECT k, behavioral, behavioral_ok, blocking FROM bh",
        "weighted_sector": f"{weighted}, {sector} SELECT k, y, sector_score, sector_ok FROM se",
        "complete_decision": f"""{weighted}, {sector}, {behaviour}, fa AS (SELECT k, y, round(sum(points) / sum(weight) * 100, 2) financial, count(*) FILTER (code IN ({essential}) AND status = 'non_calculable') = 0 financial_ok FROM w GROUP BY k, y),
          j AS (SELECT fa.*, sector_score, coalesce(sector_ok, false) sk, behavioral, coalesce(behavioral_ok, false) bk, coalesce(blocking, '') bl FROM fa LEFT JOIN se ON fa.k = se.k AND fa.y = se.y LEFT JOIN bh ON fa.k = bh.k),
          g AS (SELECT *, CASE WHEN financial_ok THEN CAST(round((CAST(financial AS DECIMAL(18,4)) * 75 + CASE WHEN bk THEN CAST(behavioral AS DECIMAL(18,4)) * 15 ELSE 0 END + CASE WHEN sk THEN CAST(sector_score AS DECIMAL(18,4)) * 10 ELSE 0 END)
            / CAST(75 + CASE WHEN bk THEN 15 ELSE 0 END + CASE WHEN sk THEN 10 ELSE 0 END AS DOUBLE) + 1e-9, 2) AS DOUBLE) END final, bl LIKE '%BAM%' OR bl LIKE '%impayé%' severe, financial_ok AND NOT (sk AND bk) partial FROM j)
          SELECT k, y, final, partial, CASE WHEN bl <> '' THEN CASE WHEN severe AND final < 50 THEN 'D/F' ELSE 'NON_EVALUABLE' END WHEN final IS NULL THEN 'NON_EVALUABLE' ELSE {grid(1, 'D/F')} END risk_class,
            CASE WHEN bl <> '' THEN CASE WHEN severe THEN 'Refus recommandé' ELSE 'Revue manuelle' END WHEN final IS NULL THEN 'Revue manuelle' WHEN partial THEN 'Revue manuelle (score financier provisoire)' ELSE {grid(3, 'Refus recommandé')} END decision,
            CASE WHEN bl <> '' THEN CASE WHEN severe THEN 'BLOCKING_CRITERIA' ELSE 'INSUFFICIENT_DATA' END WHEN final IS NULL THEN 'INSUFFICIENT_DATA' WHEN partial THEN 'PARTIAL_DATA' END blocking_status FROM g""",
    }
