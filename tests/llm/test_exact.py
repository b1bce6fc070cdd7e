"""Operators with exact results, against brute-force versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grandlivre.llm import bpe, components, decontaminate, jaccard_join, queries, suffix_dedup, topk, url_filter, warc
from grandlivre.llm.common import scratch


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, common = line(60), line(25)
    rows = [(0, None), (1, ""), (2, "short"), (3, "---"), (4, "ab " * 20000), (5, "x" * 3000)]
    for i in range(10, 90):
        parts = [line(rng.randint(5, 120))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 1), common)
        if i % 7 == 0:
            parts.insert(0, passage)
        rows.append((i, "\n".join(parts)))
    base = rows[20][1] + " " + line(100)
    for i in range(100, 130):
        w = base.split(" ")
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, rows[10][1]) for i in range(200, 215)]
    rng.shuffle(rows)
    return spark.createDataFrame([(d, t, "mine", 7) for d, t in rows], "doc_id long, text string, doc string, n_removed int")


def brute_dedup(docs, length=100):
    seen, out = set(), {}
    for d, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[d] = (len(raw), int(gone.sum()), len(edges) // 2, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [1000, 3])
def test_suffix_dedup(corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 9 if hot == 3 else 1 << 16)
    monkeypatch.setattr(suffix_dedup, "REMEMBERED", 20 if hot == 3 else 50_000)
    want = brute_dedup([(r.doc_id, r.text) for r in corpus.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.deduplicate(corpus).collect()}
    assert got == want
    assert suffix_dedup.deduplicate(corpus.where("false")).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 70))).encode() for _ in range(300)]
    strings += [b"z" * 60 + s[:20] for s in strings] + [b"z" * 80, b"z\0", b"z", b""]
    rows = np.frombuffer(b"".join(s.ljust(88, b"\0") for s in strings), np.uint8).reshape(-1, 88)
    group = np.array([i % 2 for i in range(len(strings))])
    order, common = suffix_dedup.deep_shallow(rows, np.array([len(s) for s in strings]), group)
    assert [(group[i], strings[i]) for i in order] == sorted((group[i], s) for i, s in enumerate(strings))
    assert common[0] == -1
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            assert common[k] == next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [2000, 7])
def test_jaccard_join(corpus, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = {r.doc_id: grams(r.text) for r in corpus.collect()}
    rep = {d: min([e for e in docs if docs[e] == s], default=d) if s else d for d, s in docs.items()}
    links, label = {d: 0 for d in docs}, dict(rep)
    edges = [(a, b) for a, b in combinations(sorted(set(rep.values())), 2) if docs[a] and len(docs[a] & docs[b]) >= 0.8 * len(docs[a] | docs[b])]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    for _ in range(50):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.rep_id, r.n_links, r.class_id) for r in jaccard_join.similar(corpus).collect()}
    assert got == {d: (rep[d], links[rep[d]], label[rep[d]]) for d in docs}
    assert len(edges) > 50
    assert jaccard_join.similar(corpus.where("false")).count() == 0


def test_jaccard_join_of_repeated_rows_and_ids(spark):
    long = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(3)]
    near = [t + " end" for t in long]
    rows = [(1, long[0]), (1, long[0]), (2, near[0]), (2, near[0]), (3, long[1]), (4, long[1]), (4, near[2]), (5, long[2]), (6, None), (6, None)]
    got = Counter(tuple(r) for r in jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 1, 1, 1): 2, (2, 2, 1, 1): 2, (3, 3, 0, 3): 1, (4, 3, 0, 3): 1, (4, 4, 1, 4): 1, (5, 5, 1, 4): 1, (6, 6, 0, 6): 2})


def test_rows_without_an_id_come_back(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "a"), (None, text, "b"), (None, None, "c"), (2, text, "d")], "doc_id long, text string, more string")
    got = suffix_dedup.deduplicate(docs, carry=("more",)).collect()
    size = len(text)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept), r.more) for r in got) == [(0, 0, 0, 0, b"", "c"), (0, size, 0, 0, text.encode(), "b"), (1, size, 0, 0, text.encode(), "a"), (2, size, size, 1, b"", "d")]
    assert Counter(map(tuple, jaccard_join.similar(docs).collect())) == Counter({(1, 1, 0, 1): 1, (2, 1, 0, 1): 1, (None, None, 0, None): 2})


def test_hubs_meet_written_tables(spark):
    """A node, component or payload that very many rows share is joined from a table, not from an aggregate."""
    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    got = components.connected_components(hub.union(spark.createDataFrame([(200_000, 200_001)], "u long, v long")))
    assert got.groupBy("component").count().orderBy("component").collect() == [(0, 100_001), (200_000, 2)]
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), F.col("id")).alias("url"), F.lit("same").alias("html"))
    aggregates = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert aggregates(components._star(hub, True)) == 1 and aggregates(url_filter.judge(pages, [("block", "x.net", "/")])) == 0


def test_chains_of_likeness_are_not_one_group(spark):
    """Texts that each share half with the next are linked to nothing, and groups stay small."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 40])) for i in range(150)]
    rows += [(200 + i, " ".join(words[i * 20 : i * 20 + 40]) + " tail") for i in range(150)]
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id % 200 and r.n_links == 1 for r in got)


def test_posterior_table():
    assert jaccard_join.least_matches(24, 0.8) < 24 * 0.8
    assert jaccard_join.least_matches(240, 0.8) < 240 * 0.8
    assert jaccard_join.least_matches(240, 0.8) > 240 * 0.6


def brute_decontaminate(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, own in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= own
        out[d] = (len(w), len(hit), frozenset(found))
    return out


def test_decontaminate(spark, corpus):
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    long = next(t for d, t in docs if d == 21).split()
    items = [(1, " ".join(long[:12])), (2, " ".join(long[:12]).upper()), (3, "never seen words"), (4, None), (5, ""), (6, "short"), (7, "ab " * 12), (8, " ".join(long[5:30])), (9, "x" * 3000)]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    want = brute_decontaminate(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, frozenset(r["items"])) for r in decontaminate.decontaminate(corpus, table).collect()}
    assert got == want
    spans = {r.doc_id: sum(e - s for s, e in r.spans) for r in decontaminate.decontaminate(corpus, table).collect()}
    assert spans == {d: x[1] for d, x in want.items()}
    assert decontaminate.decontaminate(corpus, table.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(corpus.where("false"), table).count() == 0


def test_decontaminate_repeated_rows_and_null_ids(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))
    item, other = line(14), line(12)
    items = [(1, item), (2, other), (3, "single")]
    docs = [(1, line(8) + " " + item)] * 2 + [(2, "a single word")] * 3 + [(3, item + " " + line(5)), (3, item + " " + line(9)), (3, line(30))]
    docs += [(None, line(4) + " " + other)] * 2 + [(None, item), (None, line(20)), (None, None), (4, other), (5, line(20))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, *brute_decontaminate([(d, t)], items)[d]) for d, t in docs)
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, frozenset(r["items"])) for r in got) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "d x b a"), (3, "a " + "y " * 50 + "d b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    got = {r.doc: r.distance for r in decontaminate.proximity_matches(docs, items, slop=5).collect()}
    assert got[1] == 0 and set(got) >= {1}


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


def test_bpe(spark, corpus, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = vocabulary
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    odd = [(900, "aaaa" * 2000), (901, "日本語🙂 \n\n\t<|endoftext|>  x"), (902, "ab" * 3000 + " " * 500), (903, "\u00a0don't 12345")]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = {r.doc_id: own.encode_ordinary(r.text or "") for r in docs.collect()}
    rows = bpe.round_trip(docs, path, pattern).collect()
    assert {r.doc_id: r.ids for r in rows} == want
    assert {r.doc_id: bytes(r.decoded) for r in rows} == {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path, pattern).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert digest == {d: (len(i), sha(",".join(map(str, i)).encode()), sha(texts[d])) for d, i in want.items()}
    back = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == texts
    assert bpe.digests(corpus.where("false"), path, pattern).count() == 0


def test_topk(spark):
    rng = np.random.RandomState(2)
    rows = [(i, (rng.randn(8) * (1 + i % 5)).astype(float).tolist(), "x") for i in range(700)]
    rows += [(700, None, ""), (701, [1.0, None] * 4, ""), (702, [float("nan")] * 8, ""), (703, [float("inf")] * 8, ""), (704, [0.0] * 8, ""), (705, [1.0, 2.0], "")]
    rows += [(800 + i, rows[5][1], "tie") for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    whole = {i: np.floor(64 * np.array(v + [0.0] * (8 - len(v)))) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in (i for i in whole if i % 20 == 0):
        best = sorted(((-int(v @ whole[q]), i) for i, v in whole.items() if i != q))[:20]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    vectors = table.where(topk.usable(table.embedding)).select("vec_id", topk.quantize(table.embedding).alias("embedding"))
    for block in (8192, 64):
        topk.BLOCK = block
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()}
        assert got == want
    topk.BLOCK = 8192
    twice = topk.top_k(vectors, vectors.where("vec_id % 20 = 0").union(vectors.where("vec_id % 20 = 0")))
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in twice.collect()} == want and twice.count() == len(want)
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5000, 5200)] + [(None, 3), (4, 4)]
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)


def test_url_filter(spark):
    pages = [
        (1, "http://a.example.org/es/x", '<link rel="canonical" href="http://plain.net/1">'),  # blocked by rule, and its alias
        (2, "http://plain.net/1#top", ""),
        (3, "HTTP://Other.NET/2?x=1", "<META http-equiv=refresh content='0; URL=http://plain.net/1'>"),
        (4, "http://shop.com/fr/1", '<link href="//both.net/b" rel=canonical>'),  # allowed by rule
        (5, "http://shop.com/de/1", '<link rel=canonical href="http://both.net/b">'),  # blocked by rule
        (6, "http://both.net/b", None),  # one alias is blocked, one explicitly allowed: allowed
        (7, None, None),
        (8, "no address", "<link rel=canonical href=http://plain.net/1>"),
        (9, "http://notexample.org/es/", ""),
        (9, "http://notexample.org/es/", ""),
        (10, "x://example.org/en/12", "y" * 200000),
        (11, "http://far.net/r", ""),
        (12, "http://a.net/x/y/page?a=1&b=2", "<!-- <link rel=canonical href=elsewhere> --><link rel=canonical href='http://x.net/1'><link rel=canonical href='../../z/./de'>"),
        (13, "http://a.net/z/de", '<base href="/de/"><link rel=canonical href="q?x=1&amp;y=2">'),
        (14, "http://a.net/de/q?x=1&y=2", "<meta http-equiv=refresh content='0;url=http://a.com/de/..//de/'><meta http-equiv=refresh content='1;url=http://shop.com/de/1'>"),
        (15, "http://x.net/1", None),
        (16, "http://x.net", "<link rel=canonical href='http://y.net/'>"),
        (17, "http://y.net/", None),
    ]
    table = spark.createDataFrame([(*p, "mine") for p in pages], "page_id long, url string, html string, component string")
    redirects = spark.createDataFrame([("http://far.net/r", "http://Other.NET/2?x=1")], "from_url string, to_url string")
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge(table, queries.RULES, redirects).collect() if r.page_id != 7)
    assert got == [
        (1, "a.example.org", "example.org/es/", "block"), (2, "plain.net", None, "block"), (3, "other.net", None, "block"), (4, "shop.com", "com/fr/", "allow"),
        (5, "shop.com", "com/de/", "block"), (6, "both.net", None, "allow"), (8, "", None, "allow"), (9, "notexample.org", "org/", "allow"), (9, "notexample.org", "org/", "allow"),
        (10, "example.org", "example.org/en/1", "block"), (11, "far.net", None, "block"),
        (12, "a.net", None, "allow"), (13, "a.net", None, "allow"), (14, "a.net", None, "allow"), (15, "x.net", None, "allow"), (16, "x.net", None, "allow"), (17, "y.net", None, "allow"),
    ]
    parts = {r.page_id: r.component for r in url_filter.judge(table, queries.RULES, redirects).collect()}
    assert parts[12] == parts[13] == parts[14] == parts[15] == parts[5] and parts[16] == parts[17] != parts[12]
    null = [r for r in url_filter.judge(table, queries.RULES).collect() if r.page_id == 7][0]
    assert (null.host, null.path, null.rule, null.verdict) == ("", "", None, "allow")
    assert url_filter.judge(table.where("false"), queries.RULES).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_warc(spark, version):
    tricky = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nhttp://a 0.0.0.0 20240101000000 text/html 3\nabc\n"
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", tricky), (4, None, None), (5, "http://a b/\n5", ""), (6, "http://a/6", "é" * 60000), (7, "http://a/1", "same")]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(table, arc, version)
    read = warc.read_arc(spark, arc)
    assert {r.page_id: bytes(r.payload) for r in read.collect()} == {p: (h or "").encode() for p, _, h in pages}
    warc.write_warc(warc.convert(read), out)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(warc.read_warc(spark, out)).collect()}
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(p, last.get(h or "", p))
    assert got == {p: (len((h or "").encode()), warc.sha1((h or "").encode()), "response" if last[h or ""] == p else "revisit", None if last[h or ""] == p else last[h or ""]) for p, _, h in pages}
    only_long = scratch(spark, "warc")
    warc.write_warc(warc.convert(read, least_bytes=1000), only_long)
    assert {r.record_type for r in warc.read_warc(spark, only_long).collect()} == {"response"}


def test_warc_of_repeated_rows_and_many_archives(spark, monkeypatch):
    """Rows of one page and address with other payloads keep their own bytes; null ids stay null; archives are rolled."""
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 4)
    pages = [(1, "u", "one"), (1, "u", "another one"), (1, "u", "one"), (None, "u", "one"), (None, None, None), *((i, f"u{i}", "x" * (i % 5)) for i in range(2, 30))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(table, arc)
    assert spark.read.format("binaryFile").load(arc).count() > 5
    warc.write_warc(warc.convert(warc.read_arc(spark, arc)), out)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(warc.read_warc(spark, out)).collect())
    top = {}
    for p, _, h in pages:
        top[h or ""] = max(-1 if p is None else p, top.get(h or "", -1))
    want = Counter()
    for p, _, h in pages:
        first = top[h or ""] == (-1 if p is None else p)
        want[(p, len(h or ""), warc.sha1((h or "").encode()), "response" if first else "revisit", None if first else top[h or ""])] += 1
    assert got == want


def test_warc_of_an_empty_table_and_damage(spark):
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), arc)
    warc.write_warc(warc.convert(warc.read_arc(spark, arc)), out)
    assert warc.resolve_revisits(warc.read_warc(spark, out)).count() == 0
    with pytest.raises(ValueError, match="cut off"):
        list(warc.arc_records(b"filedesc://x 0.0.0.0 20240101000000 text/plain 99\n1 0 x\n"))
