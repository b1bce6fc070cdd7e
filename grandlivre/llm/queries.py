"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, extraction, jaccard_join, language, prefix_trie, quality, suffix_dedup, topk, toxicity, url_filter, warc
from .common import remainder, scratch

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pre-token pattern that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantize(F.col("embedding")).alias("embedding"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), *vocabulary())


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.where(remainder("doc_id", 4) != 2))
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _learned(module, label: str, modulus: int, out: int) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        held = F.coalesce(remainder("doc_id", modulus) == out, F.lit(False))  # rows without an id are neither held out nor learned from
        model = module.train(docs, _table(spark, sf_dir, "labels").where(remainder("doc_id", modulus) != out), label)
        scored = module.score(docs, model)
        return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

    return query


op6_quality = _learned(quality, "quality", 3, 1)
op7_toxicity = _learned(toxicity, "toxic", 5, 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(_table(spark, sf_dir, "pages"), arc)
    read = warc.read_arc(spark, arc)
    warc.write_warc(warc.convert(read), out)
    return warc.resolve_revisits(warc.read_warc(spark, out))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__ if f.__name__ != "query" else k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    rule = """CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END"""
    return {
        "op1_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id query_id, c.vec_id vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) score
          FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        # the given pages hold no canonical or refresh links, so here a page without a rule has no alias
        "op2_url_filter": f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages), r AS (SELECT *, {rule} AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
        "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
        m AS (SELECT page_id, strlen(h) n, max(page_id) OVER (PARTITION BY h) top, sha1(h) x FROM p),
        w AS (SELECT *, list_transform(range(0, 40), lambda i: CAST(strpos('0123456789abcdef', x[i + 1]) - 1 AS INTEGER)) q FROM m),
        g AS (SELECT *, list_transform(range(0, 160), lambda i: (q[i // 4 + 1] >> (3 - i % 4)) & 1) b FROM w)
        SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(0, 32),
          lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[b[5*i+1] * 16 + b[5*i+2] * 8 + b[5*i+3] * 4 + b[5*i+4] * 2 + b[5*i+5] + 1]), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g""",
        # the given pages mark their article; references in them are those named here
        "op12_extract": r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) x FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') x FROM a),
        c AS (SELECT page_id, url, replace(replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>') x FROM b),
        d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
        SELECT page_id, url, text, length(text) AS n_chars FROM d""",
        # crc32 step by step: a byte is xored in, then eight shifts (-1) follow; subtrees are found by taking each node to all its ancestors
        "op13_prefix_trie": """WITH t AS (SELECT conv_id, sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) s, strlen(coalesce(text, '')) b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) k
          FROM conversations WHERE conv_id IS NOT NULL),
        i AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 g, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
            lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 9 h FROM t),
        r AS (SELECT i.conv_id, 0 part, k, s, b FROM i JOIN t ON t.conv_id = g WHERE k <= h UNION ALL SELECT i.conv_id, 1, k, s, b FROM i JOIN t ON t.conv_id = i.conv_id WHERE k > h),
        l AS (SELECT conv_id, string_agg(s, '' ORDER BY part, k) key, list(b ORDER BY part, k) bs, count(*) n FROM r GROUP BY conv_id),
        c AS (SELECT i.conv_id, coalesce(key, '') key, coalesce(bs, []) bs, coalesce(n, 0) n FROM i LEFT JOIN l USING (conv_id)),
        m AS (SELECT conv_id, d, substr(key, 1, 64 * d) node, CASE WHEN d = 0 THEN 0 ELSE bs[d] END b, d = n AS last FROM (SELECT *, unnest(range(0, n + 1)) d FROM c)),
        n AS (SELECT node, d depth, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * max(b) saved, coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') ends FROM m GROUP BY node, d),
        k AS (SELECT n.*, count(u.node) n_children FROM n LEFT JOIN n u ON u.depth = n.depth + 1 AND substr(u.node, 1, 64 * n.depth) = n.node GROUP BY ALL),
        a AS (SELECT substr(node, 1, 64 * d) top, sum(saved) saved, count(*) FILTER (n_children = 0) leaves FROM (SELECT *, unnest(range(0, depth + 1)) d FROM k) GROUP BY top)
        SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
        FROM k JOIN a ON a.top = k.node LEFT JOIN n p ON p.depth = k.depth - 1 AND p.node = substr(k.node, 1, 64 * (k.depth - 1))""",
    }
