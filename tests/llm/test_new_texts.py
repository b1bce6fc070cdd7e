"""Alignment, main text and the prefix trie against brute force, on fixtures with the odd cases."""

import hashlib
import random
import zlib
from collections import Counter
from functools import partial

import pytest

from grandlivre.llm import alignment, extraction, prefix_trie, queries

sha = lambda b: hashlib.sha256(b).hexdigest()


# ---- alignment


def models():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_align(texts):
    """Rows of the contract with the tokenizers' own libraries and plain lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = models()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    of = alignment.printed_bytes()
    rows, links = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [[sum(map(len, raw[: k + 1])) for k in range(len(raw))] for raw in (raw_a, raw_b)]
        common = [e for e in ends[0] if e in ends[1]]
        groups, i, j = [], 0, 0
        for e in common:
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            i, j = p, q
        rows.append((len(ids_a), len(ids_b), len(groups), sha(";".join(groups).encode())))
        links.append([(x, y) for x, e in zip(ids_a, ends[0], strict=True) for y, f in zip(ids_b, ends[1], strict=True) if e == f])
    count = Counter(x for one in links for x in one)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return [(*r[:3], len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), r[3]) for r, own in zip(rows, links, strict=True)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéßñ字🙂 ") for _ in range(rng.randint(1, 7)))
    made = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(30)]
    odd = [None, "", " ", "  two  spaces ", "\t\n tab", "<|endoftext|> </s> <0x41> <unk>", "▁ is a letter here", "x" * 4000, "é   \x00 \x7f", "A" + " " * 9, "naïve café 123456", "don't they'll 3.14"]
    return made + odd + [made[0], made[0]]


def test_alignment_against_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 600)
    monkeypatch.setattr(alignment, "PAIRS", 7)
    rows = [(k if k != 4 else None, t, 1, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, block int, links string").repartition(3)
    got = alignment.align(docs, *models()).collect()
    assert alignment.align(docs, *models()).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((k if k != 4 else None, *w) for k, w in enumerate(brute_align(texts)))
    assert Counter(map(tuple, got)) == want and any(w[1] for w in want) and sum(w[1] == 0 for w in want) >= 2
    assert alignment.align(docs.where("false"), *models()).collect() == []


# ---- main text


def page(body, head="<head><title>Site</title><style>p{}</style></head>"):
    return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


LONG = "A paragraph that is long enough to tell that this part of the page is its article, with several clauses."
MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(6)) + "</ul></nav>"
CASES = [
    (page(f"{MENU}<div class='ad'>Buy now, a very long advert line that says many things about what it sells.</div><article><h1>T</h1><p>a<p>{LONG}<br>more <b>bo</b>ld</article><footer>&copy; x</footer>"),
     f"T a {LONG} more bold"),
    (page(f"<header><h2>Site name</h2></header>{MENU}<div id=c><h1>Title here</h1><p>Short.</p><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div class='sidebar'>{LONG}</div><footer><p>{LONG}</p></footer>"),
     f"Title here Short. {LONG} {LONG} End."),
    (page(f"<div class='cookie-notice'>{LONG}</div><main><h1>H</h1><article><p>{LONG}</p><aside>{LONG}</aside><p>tail</p></article></main><section id='comments'><article><p>{LONG}</p></article></section>"),
     f"H {LONG} tail"),
    (page(f"<form action='/'><article><p>{LONG}</p></article><input name=q><label>Search this site</label></form>"), LONG),
    (page(f"<article><header><h1>Own title</h1></header><p>{LONG}</p><form><p>{LONG}</p></form><div class='comment-list'><p>{LONG}</p></div></article>"), f"Own title {LONG}"),
    (page("<article><p>x &lt;b&gt; &amp;amp; &#233;&#x41; &copy 1 &nbsp; y</p></article>"), "x <b> &amp; éA © 1 y"),
    (page("<script>var t='<article><p>no</p></article>';</script><article><p>Enoipa.</p><!-- <p>gone</p> --><noscript>no</noscript><textarea>no</textarea></article>"), "Enoipa."),
    (page(f"{MENU}<p>{LONG}</p><h2>3 Comments</h2><p>{LONG}</p>"), LONG),
    (page(f"{MENU}<p>{LONG}</p><p>Copyright 2020 Somebody</p><div hidden>{LONG}</div><div role='contentinfo'>{LONG}</div>"), LONG),
    (page(f"<div class='has-sidebar no-comments'><p>{LONG}</p></div>", head="<head><title>unclosed head</title>"), LONG),
    (page(f"<article class='post tag-ads comment-open'><p title='a > b'>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>"), f"{LONG} one two c1 c2"),
    (page(f"<nav><ul><li>menu never closed<article><p>{LONG}</p></article>"), LONG),
    (page(MENU + "<footer>&copy; nobody</footer>"), ""),
    ("plain text without markup", "plain text without markup"),
    ("<p>broken <a href='x>never ends", "broken <a href='x>never ends"),
    (None, ""), ("", ""), ("<article></article>", ""), (page(f"<article>{'<p>' + LONG + '</p>' * 3}</article>") * 1, LONG),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_main_text(case):
    assert extraction.main_text(CASES[case][0]) == CASES[case][1]


def test_block_distribution():
    import numpy as np

    lengths = np.array([0, 5, 0, 0, 0, 90, 10, 0, 0, 70, 0, 0, 0, 3])
    assert extraction.block_sums(lengths).tolist() == [5, 5, 0, 90, 100, 100, 10, 70, 70, 70, 0, 3, 3, 3]
    assert extraction.stretches(lengths, 80, np.zeros(14, bool)) == [(3, 10)]
    assert extraction.stretches(lengths, 1, np.zeros(14, bool)) == [(0, 2), (3, 10), (11, 14)]


def test_extract_rows(spark):
    rows = [(k, None if k % 2 else f"u{k}", h, "clash") for k, (h, _) in enumerate(CASES)] + [(None, "u", CASES[0][0], "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = Counter((r[0], r[1], t := CASES[r[0] or 0][1], len(t)) for r in rows)
    out = extraction.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and Counter(map(tuple, out.collect())) == want
    assert extraction.extract(pages.where("false")).collect() == []
    long = page("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")
    assert extraction.main_text(long) == " ".join([LONG] * 5000)


# ---- prefix trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: (t[:2], len(t[3].encode()), hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    convs = {c: [t[2:] for t in turns] for c, turns in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    own = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own[p]
    ends = lambda p: sha(",".join(map(str, sorted(c for c, s in built.items() if s == p))).encode())
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def talks(seed, n=60, few=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        same = c if rng.random() < 0.6 else c // 10
        own = random.Random(same)
        rows += [(c, t, own.choice(["user", "assistant", None]), own.choice(["a", "b", "é", "", None][: few + 2])) for t in range(own.randint(1, 14))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed, monkeypatch):
    rows = talks(seed) + [(None, 1, "user", "x"), (7, None, "user", "first"), (7, 2, "z", "tie"), (7, 2, "y", "tie"), (7, 2, "y", "tie"), (-3, 0, "user", "a"), (-5, 0, "user", "b"), (1000, 0, None, "字" * 300)]
    rows += [(2000 + 5 * k, t, "user", "copy") for k in range(80) for t in range(3)]
    random.Random(seed).shuffle(rows)
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, node string")
    monkeypatch.setattr(prefix_trie, "plant", partial(prefix_trie.plant, block_keys=4, chunk=3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter(map(tuple, prefix_trie.prefix_trie(table.repartition(3)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_trie(rows)
    assert prefix_trie.prefix_trie(table.where("false")).collect() == []


def test_long_conversations_share_their_start(spark):
    rows = [(c, t, "user", f"{t}" if t < 900 + c else f"{c}.{t}") for c in range(0, 20, 5) for t in range(1000)]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert Counter(map(tuple, prefix_trie.prefix_trie(table).collect())) == brute_trie(rows)


def test_radix_tree_layouts_grow():
    rng = random.Random(1)
    for fan in (1, 4, 5, 16, 17, 48, 49, 256):
        tree, heads = prefix_trie.Tree(), rng.sample(range(256), fan)
        keys = {bytes([x]) + bytes(19) + tail for x in heads for tail in (b"", bytes(20), bytes(19) + b"\1", b"\2" * 40)}
        for k in rng.sample(sorted(keys), len(keys)):
            tree.insert(k, (1, len(k), None))
        kind = {1: type(None), 4: prefix_trie.Sorted, 16: prefix_trie.Sorted, 48: prefix_trie.Indexed, 256: prefix_trie.Direct}
        if fan > 1:
            assert type(tree.root.below) is kind[min(x for x in (4, 16, 48, 256) if x >= fan)]
        prefixes = {k[:d] for k in keys for d in range(0, len(k) + 1, 20)}
        made = prefix_trie.walk(tree)
        assert Counter(p.depth for p in made) == Counter(len(p) // 20 for p in prefixes) and made[-1].n == len(keys)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(talks(9), "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    rows = [(k, "u", page(f"<nav>menu</nav><article><h1>T{k}</h1><p>a &amp; <b>b</b>{k}</p></article><footer>f</footer>")) for k in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", ["op12_extract", "op13_prefix_trie"])
def test_queries_against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, folder).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
