"""Language, quality and toxicity: held-out accuracy on planted texts, and the odd rows."""

import random

import numpy as np
import pytest

from grandlivre.llm import language, quality, toxicity
from grandlivre.llm.queries import op4_language, op6_quality, op7_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(300):
        letters, lang = [("abcdefgh", "aa"), ("stuvwxyzé", "bb")][i % 2]
        words = [word(letters) for _ in range(rng.randint(15, 60))]
        toxic, good = int(i % 5 == 0), int(i % 7 != 0)
        if toxic:
            words[3:3] = ["vile", "folk"]
        elif i % 5 == 1:
            words[3:3] = ["vile"]
        elif i % 5 == 2:
            words[3:3] = ["folk"]
        text = " ".join(words) if good else "!! ".join(words).upper()
        rows.append((i, text, lang, toxic, good, "own column"))
    rows += [(300, None, None, None, None, ""), (301, "", "aa", 0, 1, ""), (302, "12 34 !!", "aa", 0, 1, ""), (303, "abc " * 30000, "aa", 0, 1, ""), (303, "abc " * 30000, "aa", 0, 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int, score string")


def test_language(docs):
    model = language.train(docs.where("doc_id % 4 != 2"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == 305
    held = [(p, want[d]) for d, p, _ in got if d < 300 and d % 4 == 2]
    assert sum(p == w for p, w in held) / len(held) > 0.98
    assert {(d, p, s) for d, p, s in got if d in (300, 301, 302)} == {(d, "und", 0.0) for d in (300, 301, 302)}
    assert all(0 <= s <= 1 for _, _, s in got)
    assert 0.01 < model.temperature < 10
    seen = language.document_frequencies(docs.where("doc_id % 4 != 2"))[0] > 0
    assert 20 < (model.weights != 0).any(0).sum() < 0.9 * seen.sum()  # the elastic net leaves some weights at zero


def test_language_counts_only_what_may_be_learned_from(docs, monkeypatch):
    seen = []
    count = language.document_frequencies
    monkeypatch.setattr(language, "document_frequencies", lambda d, *a: seen.append(count(d, *a)) or seen[-1])
    language.train(docs.where("doc_id % 4 != 2"))
    assert seen[0][1] == docs.where("doc_id % 4 != 2").count()


def test_two_trainings_give_equal_models(docs):
    again = docs.repartition(3, "text")
    a, b = (language.train(d.where("doc_id % 4 != 2")) for d in (docs, again))
    assert (a.weights == b.weights).all() and a.temperature == b.temperature
    a, b = (toxicity.train(d, d.select("doc_id", "toxic")) for d in (docs, again))
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()
    a, b = (quality.train(d, d.select("doc_id", "quality")) for d in (docs, again))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_copies_of_a_text_take_their_greatest_label(spark):
    table = spark.createDataFrame([(i, "same words", i % 2) for i in range(6)], "doc_id long, text string, toxic int")
    assert [tuple(r)[:2] for r in toxicity.labelled_sample(table, table, "toxic", 100).collect()] == [("same words", 1)]


def test_rows_without_an_id(spark, tmp_path):
    docs = [(i, ["aa bb cc", "xx yy zz"][i % 2] + f" {i}", "en" if i % 2 else "de", "s", 9) for i in range(40)] + [(None, "aa bb", "de", "s", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (op4_language, op6_quality, op7_toxicity):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == 41 and [r.held_out for r in rows if r.doc_id is None] == [False]


def test_language_without_languages(spark, docs):
    assert language.train(docs.where("false")) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_labels(docs, module, label):
    model = module.train(docs, docs.where("doc_id % 3 != 1").select("doc_id", label), label)
    got = module.score(docs, model).collect()
    want = {r.doc_id: r[label] for r in docs.collect()}
    held = [(int(r.score >= 0.5), want[r.doc_id]) for r in got if r.doc_id < 300 and r.doc_id % 3 == 1]
    assert len(got) == 305 and sum(p == w for p, w in held) / len(held) > 0.95


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels(spark, docs, module, label):
    model = module.train(docs, docs.where("false").select("doc_id", label), label)
    assert len({round(r.score, 6) for r in module.score(docs, model).collect()}) == 1
    assert module.score(docs.where("false"), model).count() == 0


def test_pairs_of_terms_are_learned():
    """Two terms that are harmless alone: no sum of weights separates them."""
    import numpy as np

    rows = [np.array(x) for x in ([0], [1], [0, 1], [2])] * 100
    y = np.array([0.0, 0, 1, 0] * 100)
    rng = np.random.RandomState(0)
    model = toxicity.FactorizationMachine(np.zeros(0), 0.0, np.zeros(3), rng.normal(0, 0.02, (3, 4)))
    model.fit(rows, y, 60, 0.1, 0.0)
    own, slot = np.repeat(np.arange(4), [1, 1, 2, 1]), np.array([0, 1, 0, 1, 2])
    assert ((model.raw(own, slot, 4) > 0) == [False, False, True, False]).all()


def test_the_label_weight_reaches_the_fit(docs, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity.FactorizationMachine, "fit", lambda self, rows, y, epochs, rate, l2, positive: given.append(positive))
    toxicity.train(docs, docs.select("doc_id", "toxic"))
    toxicity.train(docs, docs.select("doc_id", "toxic"), positive=3.5)
    assert given == [2.0, 3.5]


def test_train_finds_words_that_are_toxic_only_together(spark):
    """Every word of the two pairs is as common in toxic texts as in others, so none tells anything alone."""
    rng = random.Random(8)
    rows = []
    for i in range(1000):
        a, b = i % 2, i // 2 % 2
        words = ["w%d" % (rng.random() ** 3 * 2000) for _ in range(40)] + ["red" if a else "blue", "cat" if b else "dog"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table.where("doc_id % 5 != 0").select("doc_id", "toxic"))
    held = [(int(r.score >= 0.5), rows[r.doc_id][2]) for r in toxicity.score(table, model).collect() if r.doc_id % 5 == 0]
    assert sum(p == w for p, w in held) / len(held) > 0.95


@pytest.mark.parametrize(("query", "column", "least"), [(op4_language, "lang", 0.97), (op6_quality, "quality", 0.93), (op7_toxicity, "toxic", 0.95)])
def test_queries_on_held_out_rows(spark, query, column, least):
    got = query(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/{'documents' if column == 'lang' else 'labels'}.parquet")
    want = {r.doc_id: r[column] for r in table.collect()}
    pred = "lang_pred" if column == "lang" else "predicted"
    held = [(r[pred], want[r.doc_id]) for r in got if r.held_out and want.get(r.doc_id) is not None and r[pred] != "und"]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(p == w for p, w in held) / len(held) >= least


def test_quality_learns_from_all_pairs():
    """The weights are the least of the loss of every pair, each counted once."""
    rng = np.random.RandomState(1)
    x = rng.rand(70, quality.FEATURES)
    y = np.arange(70) % 3 % 2
    x[y == 1, 0] += 0.4
    model = quality.fit_pairs(x, y)
    z = quality.expand(x, model.mean, model.spread)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    p = 1 / (1 + np.exp(-d @ model.weights))
    assert np.abs(d.T @ (p - 1) / len(d) + 1e-2 * model.weights).max() < 1e-6
    grad, hessian = quality.pair_sums(z[y == 1], z[y == 0], model.weights, block=7)
    assert np.abs(grad - d.T @ (p - 1) / len(d)).max() < 1e-9
    assert np.abs(hessian - (d * (p * (1 - p))[:, None]).T @ d / len(d)).max() < 1e-5
