"""Trained operators: held-out accuracy at sf0.01, gradients, odd rows."""

import numpy as np
import pytest

from retention.llm import langid, quality, queries, toxicity
from retention.llm.common import Platt, labelled_sample

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.93), ("op6_quality", "quality", 0.98)])
def test_held_out_auc(spark, name, label, least):
    """At sf0.1: sf0.01 has 33 toxic texts to learn from."""
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = found.where("held_out").select("score", label, "predicted").collect()
    score, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert auc(score, y) > least and all(r[2] == (r[0] >= 0.3) for r in rows)


def test_langid_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES["op8_langid"](spark, SF)
    assert found.count() == docs.count()
    held = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert held.where("lang = lang_pred").count() > 0.95 * held.count()


def test_gru_gradients():
    net = toxicity.BiGru(1)
    win = toxicity.Windows(["some words of a text that ends soon", " ".join(f"w{i}" for i in range(40)), ""])
    rows, y = win.rows(np.arange(len(win.at))), np.array([1, 0, 1, 0], dtype=np.float32)[:len(win.at)]
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss():
        out = net.forward(net.tables(net.vectors(win.words)[0]), rows)
        return -(y * np.log(toxicity.sigmoid(out)) + (1 - y) * np.log(1 - toxicity.sigmoid(out))).mean()

    g = net.step(win.words, rows, y)
    r = np.random.default_rng(0)
    for k, p in net.p.items():
        hot = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in [*hot, r.integers(p.size)]:
            at, old = np.unravel_index(i, p.shape), p.ravel()[i]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3 + 0.1 * abs(g[k][at]), k


def test_scoring_layout_matches_forward():
    net = toxicity.BiGru(2)
    texts = ["", "a few words", " ".join(f"word{i % 50}" for i in range(100)), None, " ".join("xy" for _ in range(33))]
    win = toxicity.Windows(texts)
    slow = net.forward(net.tables(net.vectors(win.words)[0]), win.rows(np.arange(len(win.at))))
    assert np.allclose(net.logits(win), slow, atol=1e-4)
    assert win.count.tolist() == [1, 1, 6, 1, 2]


def test_toxicity_reads_every_character():
    """Texts without white space: scripts that have none, and words joined by punctuation."""
    for n in range(25, 200):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        words = toxicity.words_of(run)
        grams = {w[i:i + 5] for w in words for i in range(len(w) - 4)}
        assert grams == {run[i:i + 5] for i in range(n - 4)} and max(map(len, words)) <= toxicity.LONGEST
    assert toxicity.words_of("don't " + "_".join(["some-words", "joined,by/marks", "ไม่ดีเลย"])) == [
        "don't", "some", "words", "joined", "by", "marks", "ไม่ดีเลย"]
    assert len(set(toxicity._word_ids(["д" * 12 + x for x in "абвг"]).tolist())) == 4
    g = np.random.default_rng(0)
    clean = ["".join(map(chr, g.integers(0x4E00, 0x4E40, 200))) for _ in range(60)]
    model = toxicity.ToxicityModel().fit([t[:150] + "毒死坏蛋" * 6 + t[150:] for t in clean], clean)
    fresh = "".join(map(chr, g.integers(0x4E00, 0x4E40, 400)))
    late, none = model.score([fresh + "毒死坏蛋" * 6, fresh])
    assert late > 0.7 > 0.4 > none


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    tox = toxicity.ToxicityModel().fit(["bad vile words"] * 4, ["fine good words"] * 4)
    good = quality.CompressionClassifier().fit(["a plain sentence of words"] * 8, ["### ||| %%%"] * 8)
    lang = langid.LanguageModel(0, np.zeros(langid.ROWS, dtype=int)).fit({"en": ["the words of it"] * 6, "fr": ["les mots où"] * 6})
    for model, score in ((tox, toxicity.score), (good, quality.score)):
        rows = score(docs, model).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        assert score(make_docs([]), model).count() == 0
    kept = toxicity.keep_clean(docs, tox, most=2)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)
    assert quality.keep_good(docs, good, least=2).count() == 0
    rows = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, lang).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (8, "und", 0.0), (9, "und", 0.0)} <= rows
    assert {r[1] for r in rows} <= {"en", "fr", "und"}


def test_models_of_no_or_one_label(spark, make_docs):
    docs = make_docs([(1, "a text"), (2, "b text"), (3, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for marks in (none, one):
        for op in (quality, toxicity):
            rows = op.score(docs, op.fit(docs, marks)).collect()
            assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    lang = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, lang).collect()} == {"und"}


def test_quality_scores_do_not_depend_on_the_sample_size(spark, make_docs):
    """86 % of the labelled rows are good; a small sample holds as many of each label, a large one all rows."""
    g = np.random.default_rng(3)
    vocab = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo") for b in ("ran", "sti", "lo") for c in "aeiou"]
    labels = [int(i % 50 >= 7) for i in range(1500)]
    lean = np.array([np.r_[np.ones(30) * (1 + y), np.ones(30) * (2 - y)] / 90 for y in labels])
    texts = [" ".join(g.choice(vocab, 30, p=p)) for p in lean]
    docs = make_docs(list(enumerate(texts))).drop("label")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, quality int")
    odds = []
    for per_label in (150, 2000):
        p = quality.fit(docs, marks, per_label=per_label).score(texts)
        assert abs(p.mean() - 0.86) < 0.06
        odds.append(np.log(p / (1 - p)))
    assert abs(np.median(odds[0] - odds[1])) < 0.6  # ln(0.86 / 0.14) = 1.8 apart without the share


def test_platt_separates():
    x = np.r_[np.zeros(50), np.ones(50)]
    curve = Platt().fit(x, x)
    assert curve(np.array([1.0]))[0] > 0.9 > 0.1 > curve(np.array([0.0]))[0]
    assert abs(curve.towards(0.01, 0.5)(np.array([0.5]))[0] - 0.01) < 0.01


def test_long_texts_are_drawn_for_training(make_docs, spark):
    docs = make_docs([(1, "long " * 60_000), (2, "short"), (3, None)])
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    assert labelled_sample(docs, marks, "doc_id", "text", "toxic", 100, [1, 0]) == {1: ["long " * 60_000], 0: ["short"]}


def test_blank_texts_score_as_empty_ones():
    model = quality.CompressionClassifier().fit(["good words in a line"] * 40, ["b@d %% w0rds"] * 40)
    scores = model.score([None, "", " ", "\n\t  "])
    assert len(set(scores.tolist())) == 1


def test_joined_words_are_read_one_by_one():
    assert toxicity.words_of("you_stupid_idiot") == toxicity.words_of("you_stupid_idiot_and_more_words")[:3] == ["you", "stupid", "idiot"]


def test_one_label_warns():
    with pytest.warns(UserWarning):
        assert set(toxicity.ToxicityModel().fit(["bad"], []).score(["a", None])) == {1.0}


def test_temperature_lies_inside_its_grid():
    texts = {"aa": [f"abra kadabra {i} alaka zam" for i in range(60)], "bb": [f"hokus pokus {i} fidi bus" for i in range(60)]}
    model = langid.LanguageModel(120, np.ones(langid.ROWS)).fit(texts)
    assert 0.01 < model.temperature < 20
    assert model.predict(["abra kadabra", "pokus hokus", None, "12"])[0] == ["aa", "bb", "und", "und"]
