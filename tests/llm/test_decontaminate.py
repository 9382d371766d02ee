import random

import numpy as np

from retention.llm import decontaminate as D
from retention.llm import queries


def naive_sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -D.MISMATCH), h[i, j + 1] - D.GAP, h[i + 1, j] - D.GAP)
    return h.max()


def test_smith_waterman_against_naive():
    g = random.Random(2)
    pairs = [([g.randrange(1, 6) for _ in range(g.randint(1, 15))], [g.randrange(0, 6) for _ in range(g.randint(0, 25))])
             for _ in range(200)]
    best, _ = D.smith_waterman([np.array(a) for a, _ in pairs], [np.array(b, dtype=int) for _, b in pairs])
    assert np.allclose(best, [naive_sw(a, b) for a, b in pairs], atol=1e-3)


def _corpus():
    g = random.Random(4)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(g.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs = [(i, " ".join(word() for _ in range(150))) for i in range(60)]

    def edit(text, share):
        return " ".join(word() if g.random() < share else w for w in text.split())

    planted = {}
    for k in range(20):
        item = items[k % 12]
        copy = edit(item[1], [0, 0.1, 0.2, 0.25][k % 4])
        head, tail = docs[k][1][:300], docs[k][1][300:]
        docs[k] = (k, f"{head}\n{copy.upper() if k % 2 else copy}, {tail}")
        planted[k] = item[0]
    return docs, items, planted


def test_finds_edited_copies_and_nothing_else(spark, make_docs, monkeypatch):
    docs, items, planted = _corpus()
    df, bench = make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (20_000, 5):
        monkeypatch.setattr(D, "BLOCK_ITEMS", block)
        found = D.find_passages(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in found} == set(planted.items())
        assert all(D.words_of(dict(docs)[r.doc_id])[r.first_word:r.end_word] == r.passage.encode().split() for r in found)
        kept = D.keep_uncontaminated(df, bench)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - set(planted)


def test_odd_rows_and_items(spark, make_docs, odd_rows):
    bench = spark.createDataFrame([(1, None), (None, "lone words here"), (2, ""), (3, "word"), (4, "123 456"), (5, "a b c d e f"),
                                   (5, "a b c d e f")], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = make_docs(odd_rows)
    assert D.find_passages(docs, none).count() == 0
    assert D.find_passages(make_docs([]), bench).count() == 0
    assert D.keep_uncontaminated(docs, none).count() == len(odd_rows)
    got = sorted((r.doc_id or 0, r.item_id or 0, r.score) for r in D.find_passages(docs, bench).collect())
    assert got == [(0, 0, 1.0), *[(i, 5, 1.0) for i in (1, 1, 1, 1, 6, 6)]]
    # among so few words none carries enough information
    assert D.find_passages(docs.where("doc_id <> 5"), bench).count() == 0


def test_shared_passage_stays_a_seed(make_docs, spark):
    """An item that most documents hold is still found in each of them."""
    docs, items, _ = _corpus()
    docs = [(i, f"{t} {items[0][1]}") if i % 3 else (i, t) for i, t in docs]
    found = D.find_passages(make_docs(docs * 3), spark.createDataFrame(items[:1], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in found} >= {i for i, _ in docs if i % 3}


def test_exact_copies_of_every_item(make_docs, spark, tmp_path):
    """Items without a seed, and scripts without spaces; also by the registered query."""
    han = "机器学习模型在训练数据中看到测试题目的答案就会得到过高的分数"
    items = [(1, "word"), (2, "red herring"), (3, "a b c d"), (4, han), (5, "日本"), (6, "ทดสอบภาษาไทย"), (7, "?!"), (8, None)]
    docs = [(1, "One Word."), (2, "no words"), (3, "a red, herring"), (4, "a b c e a b c d f"), (5, f"前言。{han}，后记"),
            (6, "在日本。"), (7, "日 本"), (8, "นี่ทดสอบภาษาไทยครับ"), (9, "red"), (10, None), (11, "word word"), (12, "passwords")]
    expect = {(1, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 5), (8, 6), (11, 1)}
    for padding in (0, 300):  # bits of a word grow with the table
        df = make_docs(docs + [(100 + i, f"filler{i} " * 50) for i in range(padding)])
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        sf = f"{tmp_path}/{padding}"
        df.write.parquet(f"{sf}/documents.parquet")
        bench.write.parquet(f"{sf}/benchmark.parquet")
        found = queries.QUERIES["op4_decontaminate"](spark, sf).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expect
        assert {(r.doc_id, r.item_id) for r in found if r.score == 1.0} == expect
        assert sorted(r.first_word for r in found if r.doc_id == 11) == [0, 1]
        kept = {r.doc_id for r in D.keep_uncontaminated(df, bench, whole=True).collect()}
        assert kept == {2, 9, 10, 12, *range(100, 100 + padding)}
