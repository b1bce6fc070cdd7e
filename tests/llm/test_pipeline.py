"""The pipeline's stages on a small corpus with planted cases, against brute-force versions of what they decide."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from grandlivre.llm.common import materialize


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    item, passage = line(30), line(60)
    texts = {i: line(rng.randint(80, 150)) for i in range(60)}
    toxic = set(range(1, 60, 6))
    for i in toxic:
        texts[i] += " vile folk"
    texts |= {100 + i: texts[0] for i in range(5)}
    near = texts[2].split()
    near[40] = "changed"
    texts[110] = " ".join(near)
    texts[120] = line(50) + " " + item + " " + line(20)
    texts |= {130: line(40) + " " + passage, 131: passage + " " + line(40)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(200, None, None, None, None), (201, "", "en", "s", 0), (None, "no id", None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), name)
        kept.append(now)
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    everything = set(texts) | {200, 201, None}
    assert ids[0] == everything - toxic
    assert ids[1] == ids[0] - {100, 101, 102, 103, 104, 110}
    assert ids[2] == ids[1]
    cut = {r.doc_id: r.text for r in kept[2].collect()}
    before = {r.doc_id: r.text for r in kept[1].collect()}
    assert {d for d in cut if cut[d] != before[d]} == {131} and passage[:90] not in cut[131] and cut[131] in texts[131]
    assert ids[3] == ids[2] - {120}
    final = {r.doc_id: r for r in kept[4].collect()}
    assert set(final) == ids[3]
    assert all(final[d].decoded_sha256 == hashlib.sha256((cut[d] or "").encode()).hexdigest() for d in final)
    assert all(k.columns == docs.columns for k in kept[:4])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_cut_repeats_keeps_odd_rows(spark):
    passage = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [
        (1, passage, "en", "a", 7), (2, "vor é" + passage + "ü nach", "de", "b", 8), (2, "vor é" + passage + "ü nach", "de", "b", 8), (3, None, "fr", None, 9), (None, passage, "en", "d", 10), (4, "", None, None, 0),
        (5, passage + " 5", "en", "e", 11), (5, None, None, "c", None), (5, "short", None, "c", 5), (6, passage, "en", "f", 12),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("absent", F.lit("extra"))
    got = Counter(tuple(r) for r in P.cut_repeats(spark, docs, "").collect())
    assert got == Counter([rows[0], *[(2, "vor éü nach", "de", "b", 11)] * 2, *rows[3:9], (6, "", "en", "f", 0)])
    assert P.cut_repeats(spark, docs.where("false"), "").count() == 0
