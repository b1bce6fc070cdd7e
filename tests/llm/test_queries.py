"""The registered queries on small written tables: against SQL where there is one, else against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from grandlivre.llm import bpe, queries

from .test_exact import brute_decontaminate, brute_dedup, grams

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, item = line(60), line(14)
    texts = [line(rng.randint(5, 90)) for _ in range(40)] + [None, "", "---", "x" * 900]
    texts[3] += " " + item.upper()
    texts[5], texts[7] = passage + texts[5], texts[7] + passage
    texts += [texts[1], texts[1], texts[2] + " end"]
    docs = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    docs += [docs[3], docs[3]]  # repeated rows
    at = str(tmp_path_factory.mktemp("tables"))
    write = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long, hits string")
    write("benchmark", [(1, item), (2, item), (3, None), (4, "never seen"), (5, texts[2])], "item_id long, text string")
    vectors = [(i, [float(rng.randint(-3, 3)) / 7 for _ in range(6)]) for i in range(90)] + [(100, None), (120, [None] * 6), (140, [float("nan")] * 6), (160, [float("inf")] * 6)]
    vectors += [(i, vectors[4][1]) for i in range(200, 230)] + [vectors[20], vectors[20]]
    write("embeddings", vectors, "vec_id long, embedding array<double>")
    urls = ["http://a.example.org/es/x", "http://example.org/en/12?q", "https://Shop.COM/de/1#f", "http://shop.com/fr/", "no url", None, "http://x.net", "http://notexample.org/es/"]
    pages = [(i, urls[i % 8], [None, "", "same", "é" * 50, "same"][i % 5]) for i in range(40)] + [(3, "other", "more"), (3, "other", "more")]
    write("pages", pages, "page_id long, url string, html string")
    return at


def run(spark, folder, name):
    return [r.asDict() for r in queries.queries()[name](spark, folder).collect()]


@pytest.mark.parametrize("name", ["op1_topk", "op2_url_filter", "op8_warc"])
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r[n] for n in names) for r in run(spark, folder, name)) == Counter(want.fetchall())


def test_suffix_dedup_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = brute_dedup(docs.items())
    got = run(spark, folder, "op5_suffix_dedup")
    assert len(got) == len(docs) + 2 and {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {(d, a, b, c, sha(k)) for d, (a, b, c, k) in want.items()}


def test_decontaminate_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {(d, n, hit, len(found), sha(",".join(sorted(map(str, found))).encode()), hit > 0) for d, (n, hit, found) in brute_decontaminate(docs.items(), items).items()}
    got = run(spark, folder, "op10_decontaminate")
    assert len(got) == len(docs) + 2 and {tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got} == want


def test_jaccard_query(spark, folder):
    docs = {r.doc_id: grams(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    near = lambda a, b: bool(docs[a]) and len(docs[a] & docs[b]) >= 0.8 * len(docs[a] | docs[b])
    label = {d: d for d in docs}
    for _ in range(5):
        for a in docs:
            label[a] = min([label[b] for b in docs if near(a, b)] + [label[a]])
    got = run(spark, folder, "op9_jaccard_join")
    assert len(got) == len(docs) + 2 and {(r["doc_id"], r["class_id"]) for r in got} == set(label.items())


def test_bpe_query(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = Counter((d, len(i := own.encode_ordinary(t)), sha(",".join(map(str, i)).encode()), sha(t.encode())) for d, t in rows)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in run(spark, folder, "op3_bpe")) == want
